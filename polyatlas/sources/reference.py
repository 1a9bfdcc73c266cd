"""Reference vocabularies as Parquet tables under one configured path."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: The columns of the vocabulary tables.
TABLES = {
    "organisms": "common_name string, scientific_name string, ncbi_taxonomy_id long, ensembl_prefix string, ensembl_species_name string",
    "genomic_features": "ensembl_gene_id string, symbol string, ncbi_gene_id long, biotype string, chromosome string, organism string, assembly string",
    "genomic_feature_aliases": "alias string, alias_original string, ensembl_gene_id string, organism string, is_canonical boolean, source string, assembly string",
    "ontology_terms": "ontology_term_id string, ontology_prefix string, name string, definition string, synonyms string, parent_ids array<string>, is_obsolete boolean",
    "compounds": "pubchem_cid long, name string, canonical_smiles string",
    "compound_synonyms": "synonym string, synonym_original string, pubchem_cid long, is_title boolean",
    "proteins": "uniprot_id string, protein_name string, gene_name string, organism string, ncbi_taxonomy_id long, sequence string, sequence_length long",
    "protein_aliases": "alias string, alias_original string, uniprot_id string, organism string, is_canonical boolean, source string",
    "guide_rnas": "guide_sequence string, organism string, chromosome string, target_start long, target_end long, target_strand string, intended_gene_name string, intended_ensembl_gene_id string, target_context string, assembly string, blat_pct_match double, confidence double, resolved_value string, alternatives string",
    "cell_lines": "cellosaurus_id string, cell_line_name string, species string, ncbi_taxonomy_id long, disease string, sex string, category string, cross_references string",
    "cell_line_synonyms": "synonym string, synonym_original string, cellosaurus_id string, is_primary_name boolean, source string",
}

_CONFIGURED: dict[str, str] = {}


def set_reference_path(path: str) -> None:
    """The path that ``reference`` opens, on any file system Spark knows."""
    _CONFIGURED["path"] = path.rstrip("/")


def reference(spark: SparkSession, path: str | None = None) -> "Reference":
    """The tables under ``path``, else under the configured one; raises if there is none or it has no table of organisms."""
    path = path or _CONFIGURED.get("path")
    if path is None:
        raise RuntimeError("no reference path: use set_reference_path()")
    found = Reference(spark, path)
    if not found.exists():
        raise RuntimeError(f"no reference tables at {path}")
    return found


class Reference:
    """Vocabulary tables, each a Parquet folder named after it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _has(self, name: str) -> bool:
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(target)

    def exists(self) -> bool:
        """Whether the tables are filled, as the one of organisms tells."""
        return self._has("organisms")

    def schema(self, name: str) -> T.StructType:
        if name not in TABLES:
            raise KeyError(f"no vocabulary table {name}; known are {sorted(TABLES)}")
        return T._parse_datatype_string(TABLES[name])

    def table(self, name: str) -> DataFrame:
        schema = self.schema(name)
        if not self._has(name):
            raise FileNotFoundError(f"no table {name} at {self.path}")
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def write(self, name: str, data: DataFrame | Iterable[dict], mode: str = "overwrite") -> DataFrame:
        """Write rows as the table, in its columns; missing ones become null."""
        from polyatlas.operators.schema import align_obs

        schema = self.schema(name)
        if not isinstance(data, DataFrame):
            data = self.spark.createDataFrame([{f.name: row.get(f.name) for f in schema} for row in data], schema)
        align_obs(data, schema).write.mode(mode).parquet(f"{self.path}/{name}")
        return self.table(name)

    def write_chunks(self, name: str, chunks: Iterable[list[dict]]) -> DataFrame:
        """Write a table from lists of rows that come one after the other; no rows at all raise."""
        written = None
        for chunk in chunks:
            if chunk:
                written = self.write(name, chunk, "overwrite" if written is None else "append")
        if written is None:
            raise ValueError(f"no rows for {name}")
        return written
