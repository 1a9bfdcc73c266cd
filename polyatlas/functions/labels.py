"""Classifiers of perturbation, compound, sequence and publication labels, all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Negative-control spellings.
GENETIC_CONTROLS = (
    "non-targeting", "nontargeting", "non_targeting", "nt", "scramble", "scrambled", "safe-targeting", "safe_targeting", "safetargeting",
    "luciferase", "lacz", "gfp", "rfp", "luc", "intergenic", "empty", "empty vector", "empty_vector",
    "negative_control", "negative control", "neg_ctrl", "control", "ctrl",
)
CHEMICAL_CONTROLS = (
    "dmso", "vehicle", "pbs", "untreated", "unperturbed", "no treatment", "no_treatment", "mock", "media", "medium", "water", "ethanol", "etoh",
    "saline", "control", "ctrl", "negative_control", "negative control", "neg_ctrl",
)
# Control type of a spelling, where it isn't the spelling itself.
CONTROL_TYPES = {
    "nontargeting": ("non-targeting", "nontargeting", "non_targeting", "nt"),
    "scramble": ("scramble", "scrambled"),
    "safe-targeting": ("safe-targeting", "safe_targeting", "safetargeting"),
    "empty_vector": ("empty", "empty vector", "empty_vector"),
    "DMSO": ("dmso",),
    "PBS": ("pbs",),
    "untreated": ("untreated", "unperturbed", "no treatment", "no_treatment"),
    "media": ("media", "medium"),
    "ethanol": ("ethanol", "etoh"),
    "control": ("control", "ctrl", "negative_control", "negative control", "neg_ctrl"),
}
# Perturbation methods and their patterns, the first that matches wins.
METHODS = (
    ("CRISPRko", r"crispr[\s_-]?ko|crispr.*knockout|cas9.*ko"),
    ("CRISPRi", r"crispr[\s_-]?i|crispr.*interference|dcas9.*krab"),
    ("CRISPRa", r"crispr[\s_-]?a|crispr.*activation|dcas9.*vp64|dcas9.*p65"),
    ("siRNA", r"\bsi[\s_-]?rna\b|small.interfering.rna"),
    ("shRNA", r"\bsh[\s_-]?rna\b|short.hairpin.rna"),
    ("ASO", r"\baso\b|antisense.oligo"),
    ("overexpression", r"overexpression|over[\s_-]?express|oe\b|orf\b|gain.of.function"),
    ("CRISPRko", r"\bcrispr\b"),
)
METHOD_NAMES = ("CRISPRko", "CRISPRi", "CRISPRa", "siRNA", "shRNA", "ASO", "overexpression", "other")
COMBINATION = r"\s*[+&;|]\s*|\s*,\s+"
# Salt words and parenthesised forms that follow a compound's name.
SALTS = (
    "hydrochloride|hcl|dihydrochloride|sodium|potassium|calcium|sulfate|sulphate|phosphate|acetate|citrate|tartrate|fumarate|maleate|malate"
    "|mesylate|methanesulfonate|tosylate|trifluoroacetate|tfa|bromide|chloride|iodide|nitrate|succinate|besylate|benzenesulfonate|hemisulfate"
    "|monohydrate|dihydrate|trihydrate|hydrate|salt"
)
FORM = r"(?i)\s*\([^)]*(?:salt|form|hydrate|anhydrous|free\s+base)[^)]*\)\s*$"
# Sequence role of an assembly report's role and location.
ROLES = {
    ("assembled-molecule", "Chromosome"): "chromosome",
    ("assembled-molecule", "Mitochondrion"): "mitochondrial",
    ("unlocalized-scaffold", None): "unlocalized",
    ("unplaced-scaffold", None): "scaffold",
    ("alt-scaffold", None): "alt_locus",
    ("fix-patch", None): "patch",
    ("novel-patch", None): "patch",
}
# Sex terms.
SEX = {"female": ("PATO:0000383", "female"), "male": ("PATO:0000384", "male"), "unknown": ("PATO:0000461", "unknown sex"), "other": ("PATO:0000461", "unknown sex")}


def _plain(value: Column) -> Column:
    return F.lower(F.trim(value))


def is_control_label(value: Column) -> Column:
    """Whether a label is a negative control of any kind, case and outer blanks aside."""
    return _plain(value).isin(*dict.fromkeys(GENETIC_CONTROLS + CHEMICAL_CONTROLS))


def is_control_compound(value: Column) -> Column:
    return _plain(value).isin(*CHEMICAL_CONTROLS)


def negative_control_type(value: Column) -> Column:
    """Canonical kind of a negative control, null for other labels."""
    v = _plain(value)
    out = F.when(is_control_label(value), v)
    for name, spellings in CONTROL_TYPES.items():
        out = F.when(v.isin(*spellings), F.lit(name)).otherwise(out)
    return out


def split_combination(value: Column) -> Column:
    """The trimmed, non-empty members of a combined perturbation."""
    return F.filter(F.transform(F.split(F.trim(value), COMBINATION), lambda x: F.trim(x)), lambda x: x != "")


def perturbation_method(value: Column) -> Column:
    """The first method whose pattern is found; bare CRISPR counts as knock-out."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(METHODS):
        out = F.when(value.rlike("(?i)" + pattern), F.lit(name)).otherwise(out)
    return out


def clean_compound_name(value: Column) -> Column:
    """A name without a trailing parenthesised form, cut from its first salt word on."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(value), FORM, ""), rf"(?i)\s*\b({SALTS})\b.*$", ""))


def sequence_role(role: Column, location: Column) -> Column:
    out = F.lit("other")
    for (r, where), name in ROLES.items():
        out = F.when((role == r) & (location == where if where else F.lit(True)), F.lit(name)).otherwise(out)
    return out


def is_ensembl_gene_id(value: Column) -> Column:
    return F.substring_index(value, ".", 1).rlike(r"^ENS[A-Z]*G\d+(\.\d+)?$")


def is_placeholder_symbol(value: Column) -> Column:
    """Provisional symbols: accession-based or clone names."""
    return value.rlike(r"^[A-Z]{2}\d{6}\.\d+$") | value.rlike(r"^\d+[A-Z]\d+Rik$")


def publication_id_type(value: Column) -> Column:
    """pmid, doi or title."""
    v = F.trim(value)
    doi = v.startswith("10.") | v.contains("/10.") | F.lower(v).startswith("doi:")
    return F.when(v.startswith("PMID:") | v.rlike(r"^\d+$"), F.lit("pmid")).when(doi, F.lit("doi")).otherwise(F.lit("title"))


def sex_term(value: Column, field: int = 0) -> Column:
    """Term id (0) or label (1) of a sex, null if unknown to the map."""
    v, out = _plain(value), F.lit(None).cast("string")
    for name, pair in SEX.items():
        out = F.when(v == name, F.lit(pair[field])).otherwise(out)
    return out


def soft_fields(text: Column) -> Column:
    """array<struct<key, value>> of the ``!key = value`` lines of a SOFT record, in order."""
    lines = F.filter(F.split(text, "\r?\n"), lambda x: x.rlike(r"^!\S+\s*="))
    return F.transform(lines, lambda x: F.struct(F.regexp_extract(x, r"^!(\S+?)\s*=\s*(.*)", 1).alias("key"), F.trim(F.regexp_extract(x, r"^!(\S+?)\s*=\s*(.*)", 2)).alias("value")))


def perturbation_search_string(types: Column, uids: Column) -> Column:
    """``SM:uid GP:uid BIO:uid`` tokens of parallel lists, joined by blanks."""
    code = lambda t: F.when(t == "small_molecule", "SM").when(t == "genetic_perturbation", "GP").when(t == "biologic_perturbation", "BIO").otherwise(t)
    return F.array_join(F.zip_with(types, uids, lambda t, u: F.concat(code(t), F.lit(":"), u)), " ")
