"""Archive records: SOFT text, and the XML of samples and publications, parsed from columns of text."""

from __future__ import annotations

from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fields of the parsed records.
SERIES = "accession string, title string, summary string, organism string, n_samples int, platform_ids array<string>, ftp_link string, pmids array<string>, doi string, bioproject string, sra_accession string, samples array<map<string,string>>"
SAMPLE = "accession string, title string, source string, organism string, characteristics map<string,string>, molecule string, platform string, description string, treatment_protocol string, growth_protocol string, extract_protocol string, data_processing string, series_ids array<string>, biosample_accession string"
BIOSAMPLE = "accession string, title string, organism string, taxonomy_id string, attributes map<string,string>"
BIOPROJECT = "accession string, title string, description string, organism string, data_type string, scope string"
PUBLICATION = "pmid long, doi string, title string, journal string, publication_date date, authors array<string>, pmc_id string"
SECTION = "section_title string, section_text string"
#: Fields that identify a resolved entity, in order.
IDENTITY = {
    "gene": ("ensembl_gene_id", "organism"), "molecule": ("pubchem_cid",), "protein": ("uniprot_id", "organism"),
    "guide_rna": ("chromosome", "target_start", "target_end", "target_strand", "assembly"), "cell_line": ("cellosaurus_id",), "ontology": ("ontology_term_id",),
}
#: Names of months.
_MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def _grouped(pairs: Column) -> Column:
    """A map from each key of an array of (k, v) to the list of its values, in order."""
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.transform(F.filter(pairs, lambda p: p["k"] == k), lambda p: p["v"])))


def soft_fields(text: Column) -> Column:
    """map<field, values> of SOFT text: the lines ``!field = value``, a field's values in order."""
    lines = F.filter(F.split(text, r"\r?\n"), lambda x: x.rlike(r"^!\S+\s*=") & (F.regexp_extract(x, r"^!([^\s=]+)\s*=", 1) != ""))
    return _grouped(F.transform(lines, lambda x: F.struct(F.regexp_extract(x, r"^!([^\s=]+)\s*=", 1).alias("k"), F.trim(F.regexp_extract(x, r"^![^\s=]+\s*=\s*(.*)", 1)).alias("v"))))


def characteristics(values: Column) -> Column:
    """map<key, value> of ``key: value`` entries, keys in lower case, the last of a key; an entry without a value maps to empty, a blank one is left out."""
    kept = F.filter(values, lambda x: F.trim(x) != "")
    key = lambda x: F.lower(F.trim(F.when(F.instr(x, ": ") > 0, F.substring_index(x, ": ", 1)).otherwise(x)))
    pairs = F.transform(kept, lambda x: F.struct(key(x).alias("k"), F.when(F.instr(x, ": ") > 0, F.trim(F.regexp_replace(x, r"(?s)^.*?: ", ""))).otherwise("").alias("v")))
    return F.transform_values(_grouped(pairs), lambda _, v: F.element_at(v, -1))


def geo_samples(df: DataFrame, text: str = "text") -> DataFrame:
    """(accession, title, source, organism, characteristics, molecule, platform, series_ids) of one sample's SOFT text a row."""
    fields = df.select(soft_fields(F.col(text)).alias("f"))
    one = lambda k: F.try_element_at(F.try_element_at("f", F.lit(k)), F.lit(1))
    many = lambda k: F.coalesce(F.try_element_at("f", F.lit(k)), F.array().cast("array<string>"))
    return fields.select(
        one("Sample_geo_accession").alias("accession"), one("Sample_title").alias("title"), one("Sample_source_name_ch1").alias("source"), one("Sample_organism_ch1").alias("organism"),
        characteristics(many("Sample_characteristics_ch1")).alias("characteristics"), one("Sample_molecule_ch1").alias("molecule"), one("Sample_platform_id").alias("platform"), many("Sample_series_id").alias("series_ids"),
    )


def _root(xml: str | None) -> ElementTree.Element | None:
    """The root element; null, text that is no XML, and XML that declares entities give None."""
    if xml is None or "<!ENTITY" in xml:
        return None
    try:
        return ElementTree.fromstring(xml)
    except ElementTree.ParseError:
        return None


def _text(element: ElementTree.Element | None) -> str:
    return "" if element is None else "".join(element.itertext()).strip()


def sections(body: ElementTree.Element, above: str | None = None) -> Iterator[tuple[str | None, str]]:
    """(title, text) of the sections with paragraphs of their own; a nested one is titled ``outer > inner``."""
    for section in body.findall("sec"):
        head = section.find("title")
        own = head.text.strip() if head is not None and head.text else None
        title = " > ".join(x for x in (above, own) if x) or None
        paragraphs = [t for t in map(_text, section.findall("p")) if t]
        if paragraphs:
            yield title, "\n\n".join(paragraphs)
        yield from sections(section, title)


def abstract(root: ElementTree.Element) -> Iterator[tuple[str | None, str]]:
    """(label, text) of the parts of an abstract; unlabelled ones are titled ``Abstract``."""
    parts = root.findall(".//Abstract/AbstractText") or [e for e in [root.find(".//Abstract")] if e is not None]
    for part in parts:
        if text := _text(part):
            yield part.get("Label") or "Abstract", text


def _all_sections(xml: str | None) -> list[dict] | None:
    root = _root(xml)
    if root is None:
        return None
    body = root.find(".//body")
    found = sections(body) if body is not None else abstract(root)
    return [{"section_title": title, "section_text": text} for title, text in found]


def _date(article: ElementTree.Element):
    import datetime

    places = [*article.findall(".//Article/ArticleDate"), *article.findall(".//Article/Journal/JournalIssue/PubDate")]
    for place in places:
        year, month, day = ((place.findtext(x) or "").strip() for x in ("Year", "Month", "Day"))
        if year.isdigit():
            number = int(month) if month.isdigit() else _MONTHS.index(month.lower()[:3]) + 1 if month.lower()[:3] in _MONTHS else 1
            return datetime.date(int(year), number, int(day) if day.isdigit() else 1)
        season = (place.findtext("MedlineDate") or "")[:4]
        if len(season) == 4 and season.isdigit():
            return datetime.date(int(season), 1, 1)
    return None


def _publication(xml: str | None) -> dict | None:
    root = _root(xml)
    article = None if root is None else root if root.tag == "PubmedArticle" else root.find(".//PubmedArticle")
    number = "" if article is None else (article.findtext(".//MedlineCitation/PMID") or "").strip()
    if not number.isdigit():
        return None
    ids = {e.get("IdType"): e.text for e in article.findall(".//PubmedData/ArticleIdList/ArticleId") if e.text}
    authors = []
    for author in article.findall(".//Article/AuthorList/Author"):
        last, fore = author.findtext("LastName"), author.findtext("ForeName")
        if name := (f"{fore} {last}" if last and fore else last or author.findtext("CollectiveName")):
            authors.append(name)
    journal = article.findtext(".//Article/Journal/Title") or article.findtext(".//MedlineJournalInfo/MedlineTA")
    return {"pmid": int(number), "doi": ids.get("doi"), "title": _text(article.find(".//Article/ArticleTitle")), "journal": journal.strip() if journal else None, "publication_date": _date(article), "authors": authors, "pmc_id": ids.get("pmc")}


def _biosample(xml: str | None) -> dict | None:
    root = _root(xml)
    sample = None if root is None else root if root.tag == "BioSample" else root.find(".//BioSample")
    if sample is None:
        return None
    organism = sample.find(".//Description/Organism")
    named = ((e.get("harmonized_name") or e.get("attribute_name"), (e.text or "").strip()) for e in sample.findall(".//Attribute"))
    attribute = lambda name: "" if organism is None else organism.get(name, "")
    return {"accession": sample.get("accession", ""), "title": sample.findtext(".//Description/Title") or "", "organism": attribute("taxonomy_name"), "taxonomy_id": attribute("taxonomy_id"), "attributes": {k: v for k, v in named if k}}


def _parsed(parse, schema: str):
    """An Arrow-batched function over XML texts; XML has no parser among the column functions that keeps the nesting."""

    @F.pandas_udf(f"struct<{schema}>")
    def run(texts: pd.Series) -> pd.DataFrame:
        names = [part.split(" ")[0] for part in schema.split(", ")]
        rows = [parse(t) or dict.fromkeys(names) for t in texts]
        return pd.DataFrame({n: pd.Series([r[n] for r in rows], dtype=object) for n in names})

    return run


def publications(df: DataFrame, xml: str = "xml") -> DataFrame:
    """(pmid, doi, title, journal, publication_date, authors, pmc_id) of one article's XML a row; rows without a number are left out."""
    return df.select(_parsed(_publication, PUBLICATION)(F.col(xml)).alias("r")).select("r.*").where("pmid is not null")


def biosamples(df: DataFrame, xml: str = "xml") -> DataFrame:
    """(accession, title, organism, taxonomy_id, attributes) of one sample's XML a row; other rows are left out."""
    return df.select(_parsed(_biosample, BIOSAMPLE)(F.col(xml)).alias("r")).select("r.*").where("accession is not null")


def full_text(xml: Column | str) -> Column:
    """array<(section_title, section_text)> of an article's XML: of its body, else of its abstract; null for text that is no XML."""

    @F.pandas_udf(f"array<struct<{SECTION}>>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([_all_sections(t) for t in texts], dtype=object)

    return run(xml)
