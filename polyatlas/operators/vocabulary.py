"""Resolution of names against reference vocabularies, and walks over ontologies."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from polyatlas.functions import labels
from polyatlas.operators.order import checkpointed

CANONICAL, SINGLE, AMBIGUOUS, FUZZY, NONE = 1.0, 0.9, 0.7, 0.7, 0.0
#: Of compounds found by number or structure.
MOLECULE = 0.95
# Ontology prefixes of an entity, and of a development stage by organism.
PREFIXES = {
    "cell_type": ("CL",), "tissue": ("UBERON",), "disease": ("MONDO",), "organism": ("NCBITaxon",), "assay": ("EFO",),
    "development_stage": ("HsapDv", "MmusDv"), "ethnicity": ("HANCESTRO",), "sex": ("PATO",),
}
STAGE_PREFIX = {"human": "HsapDv", "homo_sapiens": "HsapDv", "mouse": "MmusDv", "mus_musculus": "MmusDv"}


def resolve_aliases(inputs: DataFrame, aliases: DataFrame) -> DataFrame:
    """(ordinal, value, resolved, confidence, alternatives) for every input (ordinal, value).

    ``aliases`` has (alias in lower case, id, is_canonical), of one organism. One
    canonical id gives 1.0; else one id at all 0.9; else the least id, canonical
    ones first, 0.7; no match 0.0. alternatives are the other ids in order. Every
    spelling of a name resolves, whatever its case.
    """
    ids = aliases.groupBy("alias", "id").agg(F.bool_or("is_canonical").alias("canonical"))
    best = ids.groupBy("alias").agg(F.array_sort(F.collect_set("id")).alias("ids"), F.count_if("canonical").alias("n_canonical"), F.min(F.when(F.col("canonical"), F.col("id"))).alias("first_canonical"))
    best = best.select("alias", "ids", F.coalesce("first_canonical", F.get("ids", F.lit(0))).alias("resolved"), F.when(F.col("n_canonical") == 1, CANONICAL).when(F.size("ids") == 1, SINGLE).otherwise(AMBIGUOUS).alias("confidence"))
    out = inputs.join(best, F.lower(F.col("value")) == F.col("alias"), "left")
    none = F.array().cast(aliases.select(F.array("id")).schema[0].dataType)
    return out.select("ordinal", "value", "resolved", F.coalesce("confidence", F.lit(NONE)).alias("confidence"), F.coalesce(F.array_remove("ids", F.col("resolved")), none).alias("alternatives"))


def resolve_gene_ids(inputs: DataFrame, features: DataFrame) -> DataFrame:
    """(ordinal, value, resolved, symbol, confidence) of stable gene ids: the part before the version, found exactly.

    Of several assemblies of a gene the newest counts, unknown ones last.
    """
    newest = Window.partitionBy("ensembl_gene_id").orderBy(F.desc_nulls_last("assembly"), "symbol")
    known = features.withColumn("_r", F.row_number().over(newest)).where("_r = 1").select("ensembl_gene_id", "symbol")
    out = inputs.join(known, F.substring_index("value", ".", 1) == F.col("ensembl_gene_id"), "left")
    return out.select("ordinal", "value", F.col("ensembl_gene_id").alias("resolved"), "symbol", F.when(F.col("ensembl_gene_id").isNotNull(), CANONICAL).otherwise(NONE).alias("confidence"))


def resolve_genes(inputs: DataFrame, aliases: DataFrame, features: DataFrame, input_type: str = "auto") -> DataFrame:
    """(ordinal, value, resolved, confidence) of gene names and ids; ``auto`` tells them by their form."""
    if input_type not in ("auto", "symbol", "ensembl_id"):
        raise ValueError("input_type must be auto, symbol or ensembl_id")
    is_id = labels.is_ensembl_gene_id(F.col("value")) if input_type == "auto" else F.lit(input_type == "ensembl_id")
    names = resolve_aliases(inputs.where(~is_id), aliases).select("ordinal", "value", "resolved", "confidence")
    return names.union(resolve_gene_ids(inputs.where(is_id), features).select("ordinal", "value", "resolved", "confidence"))


def detect_organism(ids: DataFrame, organisms: DataFrame) -> DataFrame:
    """(value, organism) by the longest id prefix, ``unknown`` without one; ``organisms`` has (prefix, name)."""
    known = organisms.where("prefix is not null")
    hit = ids.select("value").distinct().join(F.broadcast(known), F.substring_index("value", ".", 1).startswith(F.col("prefix")), "left")
    return hit.groupBy("value").agg(F.coalesce(F.max_by("name", F.length("prefix")), F.lit("unknown")).alias("organism"))


def resolve_compounds(inputs: DataFrame, synonyms: DataFrame) -> DataFrame:
    """(ordinal, value, resolved, cid, confidence): controls by themselves 1.0, titles 1.0, synonyms 0.9, else 0.0.

    ``synonyms`` has (synonym in lower case, synonym_original, cid, is_title);
    among equals the least cid counts. Names are cleaned of salts and forms.
    """
    pick = Window.partitionBy("synonym").orderBy(F.desc("is_title"), "cid")
    best = synonyms.withColumn("_r", F.row_number().over(pick)).where("_r = 1").drop("_r")
    out = inputs.join(best, F.lower(labels.clean_compound_name(F.col("value"))) == F.col("synonym"), "left")
    control = labels.is_control_compound(F.col("value"))
    return out.select(
        "ordinal", "value", F.when(control, F.upper(F.trim("value"))).otherwise(F.col("synonym_original")).alias("resolved"), F.when(~control, F.col("cid")).alias("cid"),
        F.when(control | F.coalesce("is_title", F.lit(False)), CANONICAL).when(F.col("synonym").isNotNull(), SINGLE).otherwise(NONE).alias("confidence"),
    )


def entity_prefixes(entity: str, organism: str | None = None) -> tuple[str, ...]:
    if entity == "development_stage" and organism and organism.lower() in STAGE_PREFIX:
        return (STAGE_PREFIX[organism.lower()],)
    if entity not in PREFIXES:
        raise ValueError(f"no ontology for entity {entity}")
    return PREFIXES[entity]


def resolve_terms(inputs: DataFrame, terms: DataFrame) -> DataFrame:
    """(ordinal, value, term_id, resolved, confidence): exact name 1.0, synonym 0.9, else 0.0, case and outer blanks aside.

    ``terms`` has (term_id, name, synonyms joined by " | ", is_obsolete); the
    least term id counts where several share a key.
    """
    live = terms.where(~F.coalesce("is_obsolete", F.lit(False)))
    names = live.select(F.lower(F.trim("name")).alias("key"), F.lit(0).alias("level"), "term_id", "name")
    synonyms = live.where("synonyms is not null and synonyms <> ''").select(F.explode(F.split("synonyms", r" \| ")).alias("s"), "term_id", "name")
    keys = names.union(synonyms.select(F.lower(F.trim("s")), F.lit(1), "term_id", "name")).groupBy("key").agg(F.min(F.struct("level", "term_id", "name")).alias("m"))
    out = inputs.join(keys, F.lower(F.trim("value")) == F.col("key"), "left")
    confidence = F.when(F.col("m.level") == 0, CANONICAL).when(F.col("m.level") == 1, SINGLE).otherwise(NONE)
    return out.select("ordinal", "value", F.col("m.term_id").alias("term_id"), F.col("m.name").alias("resolved"), confidence.alias("confidence"))


def resolve_sex(inputs: DataFrame) -> DataFrame:
    """(ordinal, value, term_id, resolved, confidence) by the fixed map of sexes."""
    term = labels.sex_term(F.col("value"))
    return inputs.select("ordinal", "value", term.alias("term_id"), labels.sex_term(F.col("value"), 1).alias("resolved"), F.when(term.isNotNull(), CANONICAL).otherwise(NONE).alias("confidence"))


def resolve_cell_lines(inputs: DataFrame, lines: DataFrame, synonyms: DataFrame) -> DataFrame:
    """Like ``resolve_terms`` over (id, name) and (id, synonym), then by shared words: the best text score, confidence 0.7."""
    from polyatlas.operators.search import bm25

    terms = lines.select(F.col("id").alias("term_id"), "name", F.lit(None).cast("string").alias("synonyms"), F.lit(False).alias("is_obsolete"))
    more = synonyms.join(lines, "id").select(F.col("id").alias("term_id"), "name", F.col("synonym").alias("synonyms"), F.lit(False).alias("is_obsolete"))
    exact = resolve_terms(inputs, terms.union(more))
    left = exact.where("confidence = 0").select(F.col("ordinal").alias("query"), F.col("value").alias("text"))
    hits = bm25(left, synonyms.select(F.concat_ws("\t", "id", "synonym").alias("doc"), F.col("synonym").alias("text")))
    top = hits.groupBy("query").agg(F.max_by(F.substring_index("doc", "\t", 1), F.struct("score", F.col("doc"))).alias("_id")).join(lines.select(F.col("id").alias("_id"), F.col("name").alias("_name")), "_id")
    full = exact.join(top, F.col("ordinal") == F.col("query"), "left")
    return full.select("ordinal", "value", F.coalesce("term_id", "_id").alias("term_id"), F.coalesce("resolved", "_name").alias("resolved"), F.when((F.col("confidence") == 0) & F.col("_id").isNotNull(), FUZZY).otherwise(F.col("confidence")).alias("confidence"))


def resolve_terms_of(inputs: DataFrame, terms: DataFrame, entity: str, organism: str | None = None) -> DataFrame:
    """Router: sexes by the fixed map, other entities among the terms of their prefixes."""
    if entity == "sex":
        return resolve_sex(inputs)
    return resolve_terms(inputs, terms.where(F.substring_index("term_id", ":", 1).isin(*entity_prefixes(entity, organism))))


def resolve_cell_types(inputs: DataFrame, terms: DataFrame) -> DataFrame:
    return resolve_terms_of(inputs, terms, "cell_type")


def resolve_tissues(inputs: DataFrame, terms: DataFrame) -> DataFrame:
    return resolve_terms_of(inputs, terms, "tissue")


def resolve_diseases(inputs: DataFrame, terms: DataFrame) -> DataFrame:
    return resolve_terms_of(inputs, terms, "disease")


def resolve_organisms(inputs: DataFrame, terms: DataFrame) -> DataFrame:
    return resolve_terms_of(inputs, terms, "organism")


def resolve_assays(inputs: DataFrame, terms: DataFrame) -> DataFrame:
    return resolve_terms_of(inputs, terms, "assay")


def term_ids(inputs: DataFrame, terms: DataFrame, entity: str, organism: str | None = None) -> DataFrame:
    """(ordinal, value, term_id) of the router's result."""
    return resolve_terms_of(inputs, terms, entity, organism).select("ordinal", "value", "term_id")


def resolve_proteins(inputs: DataFrame, aliases: DataFrame, proteins: DataFrame) -> DataFrame:
    """``resolve_aliases`` over accessions, with (protein_name, gene_name, sequence, sequence_length) of ``proteins`` (uniprot_id, ...) beside; null without a record."""
    names = ("protein_name", "gene_name", "sequence", "sequence_length")
    known = proteins.groupBy("uniprot_id").agg(F.min(F.struct(*names)).alias("_p")).select(F.col("uniprot_id").alias("_id"), "_p.*")
    return resolve_aliases(inputs, aliases).join(known, F.col("resolved") == F.col("_id"), "left").drop("_id")


def resolve_molecules(inputs: DataFrame, compounds: DataFrame, synonyms: DataFrame, input_type: str = "name") -> DataFrame:
    """(ordinal, value, resolved, cid, canonical_smiles, confidence) of names, structures or numbers of compounds (cid, name, canonical_smiles).

    Names go by ``resolve_compounds``. A number of a known compound gives 0.95,
    its own text where it has no name; a structure that is, but for blanks
    around it, one of the table's 0.95, the least number of equals. Structures
    are not brought into canonical form.
    """
    if input_type not in ("name", "smiles", "cid"):
        raise ValueError("input_type must be name, smiles or cid")
    known = compounds.select(F.col("cid").alias("_cid"), F.col("name").alias("_name"), F.col("canonical_smiles").alias("_smiles"))
    if input_type == "name":
        named = resolve_compounds(inputs, synonyms)
        out = named.join(known, F.col("cid") == F.col("_cid"), "left")
        return out.select("ordinal", "value", "resolved", "cid", F.col("_smiles").alias("canonical_smiles"), "confidence")
    if input_type == "cid":
        out = inputs.join(known, F.expr("try_cast(trim(value) as bigint)") == F.col("_cid"), "left")
    else:
        first = known.where("_smiles is not null").groupBy("_smiles").agg(F.min(F.struct("_cid", "_name")).alias("m")).select("_smiles", "m.*")
        out = inputs.join(first, F.trim("value") == F.col("_smiles"), "left")
    hit = F.col("_cid").isNotNull()
    return out.select("ordinal", "value", F.when(hit, F.coalesce("_name", F.col("_cid").cast("string"))).alias("resolved"), F.col("_cid").alias("cid"), F.col("_smiles").alias("canonical_smiles"), F.when(hit, MOLECULE).otherwise(NONE).alias("confidence"))


def _alternatives(resolutions: DataFrame):
    return F.size("alternatives") if "alternatives" in resolutions.columns else F.lit(0)


def report(resolutions: DataFrame) -> DataFrame:
    """(total, resolved, unresolved, ambiguous) of a resolution; ambiguous are those with alternatives."""
    found = F.count_if(F.col("resolved").isNotNull())
    return resolutions.agg(F.count("*").alias("total"), found.alias("resolved"), (F.count("*") - found).alias("unresolved"), F.count_if(_alternatives(resolutions) > 0).alias("ambiguous"))


def report_frame(resolutions: DataFrame) -> DataFrame:
    """The resolution as a flat table: alternatives joined by "; ", empty without any."""
    return resolutions.withColumn("alternatives", F.array_join("alternatives", "; ")) if "alternatives" in resolutions.columns else resolutions


def ambiguous_values(resolutions: DataFrame) -> DataFrame:
    """The values with alternatives."""
    return resolutions.where(_alternatives(resolutions) > 0).select("value")


def unresolved_values(resolutions: DataFrame) -> DataFrame:
    return resolutions.where("resolved is null").select("value")


def edges(terms: DataFrame) -> DataFrame:
    """(child, parent) of (term_id, parent_ids) within one prefix."""
    pairs = terms.select(F.col("term_id").alias("child"), F.explode("parent_ids").alias("parent"))
    return pairs.where(F.substring_index("child", ":", 1) == F.substring_index("parent", ":", 1)).distinct()


def walk(links: DataFrame, starts: DataFrame, max_depth: int | None = None, down: bool = False) -> DataFrame:
    """(start, node, depth) of all ancestors, or descendants, of ``starts`` (start); the least depth of each, cycle-safe.

    One join a level over the nodes met newly; each level is a checkpoint, so a
    lost executor costs one level. It goes on to the last level, or to
    ``max_depth``.
    """
    near, far = ("parent", "child") if down else ("child", "parent")
    step = links.select(F.col(near).alias("node"), F.col(far).alias("next")).distinct()
    seen = starts.select("start", F.col("start").alias("node"), F.lit(0).alias("depth")).distinct()
    frontier = seen
    for depth in count(1) if max_depth is None else range(1, max_depth + 1):
        fresh = frontier.join(step, "node").select("start", F.col("next").alias("node")).distinct().join(seen.select("start", "node"), ["start", "node"], "left_anti")
        frontier = checkpointed(fresh.withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen = seen.union(frontier)
    return seen.where("depth > 0")


def siblings(links: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, node) of the other children of each start's parents."""
    up = starts.join(links, F.col("start") == F.col("child")).select("start", "parent")
    return up.join(links, "parent").where("child <> start").select("start", F.col("child").alias("node")).distinct()


def lookup_sequences(names: DataFrame, assembly: DataFrame) -> DataFrame:
    """(name, sequence_name, role) of each distinct name: by UCSC name, then bare name, then GenBank, then RefSeq; else ``other``."""
    keys = None
    for level, column in enumerate(("ucsc_name", "sequence_name", "genbank_accession", "refseq_accession")):
        part = assembly.where(F.col(column).isNotNull()).select(F.col(column).alias("key"), F.struct(F.lit(level).alias("level"), F.col("sequence_name"), F.col("sequence_role")).alias("m"))
        keys = part if keys is None else keys.union(part)
    best = keys.groupBy("key").agg(F.min("m").alias("m"))
    out = names.select("name").distinct().join(best, F.col("name") == F.col("key"), "left")
    return out.select("name", F.col("m.sequence_name").alias("sequence_name"), F.coalesce("m.sequence_role", F.lit("other")).alias("role"))


def append_to_cache(cache: DataFrame, fresh: DataFrame, path: str) -> DataFrame:
    """Adds the rows of ``fresh`` (guide_sequence, ...) that ``cache`` lacks to the table at ``path``, upper-cased, one of each sequence, and gives the whole."""
    new = fresh.withColumn("guide_sequence", F.upper("guide_sequence")).where("guide_sequence is not null").dropDuplicates(["guide_sequence"])
    new = new.join(cache.select("guide_sequence"), "guide_sequence", "left_anti").select(*cache.columns)
    checkpointed(new).write.mode("append").parquet(path)
    return cache.sparkSession.read.schema(cache.schema).parquet(path)


def resolve_cached(inputs: DataFrame, cache: DataFrame) -> DataFrame:
    """(ordinal, value, found, cached columns) of sequences looked up, upper-cased, in a table of earlier results."""
    known = cache.dropDuplicates(["guide_sequence"])
    return inputs.join(known, F.upper(F.col("value")) == F.col("guide_sequence"), "left").withColumn("found", F.col("guide_sequence").isNotNull())
