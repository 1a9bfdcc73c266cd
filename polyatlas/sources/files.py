"""Text formats: coordinate triplets, fragment files, assembly reports. Compressed files read as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyatlas.functions import labels

MAX_FRAGMENT = 65535


def read_coo(spark: SparkSession, path: str, separator: str = "\t", gene_col: int = 0, cell_col: int = 1, value_col: int = 2, one_indexed: bool = True, value_type: str = "int") -> DataFrame:
    """(row, local_index, value) of header-less triplets; they needn't be sorted."""
    width = max(gene_col, cell_col, value_col) + 1
    raw = spark.read.csv(path, sep=separator, schema=", ".join(f"c{i} string" for i in range(width)))
    shift = 1 if one_indexed else 0
    return raw.select((F.col(f"c{cell_col}").cast("long") - shift).alias("row"), (F.col(f"c{gene_col}").cast("long") - shift).alias("local_index"), F.col(f"c{value_col}").cast(value_type).alias("value"))


def read_bed_fragments(spark: SparkSession, path: str, barcode_col: int = 3) -> DataFrame:
    """(chrom, start, length, barcode) of a fragment file; a length over 65535 or below zero fails the read."""
    raw = spark.read.csv(path, sep="\t", schema=", ".join(f"c{i} string" for i in range(max(3, barcode_col + 1))))
    length = F.col("c2").cast("long") - F.col("c1").cast("long")
    checked = F.when(length.between(0, MAX_FRAGMENT), length).otherwise(F.raise_error(F.concat(F.lit("fragment length out of range: "), length.cast("string"))))
    return raw.select(F.col("c0").alias("chrom"), F.col("c1").cast("long").alias("start"), checked.cast("int").alias("length"), F.col(f"c{barcode_col}").alias("barcode"))


def primary_sequences(assembly: DataFrame) -> DataFrame:
    """The sequences of the primary assembly, the organelles among them."""
    return assembly.where("is_primary_assembly")


def chromosomes(assembly: DataFrame) -> DataFrame:
    """The sequences that are whole chromosomes."""
    return assembly.where("sequence_role = 'chromosome'")


def read_assembly_report(spark: SparkSession, path: str) -> DataFrame:
    """Sequences of an assembly report; comments, blank lines and lines of fewer than ten columns fall out."""
    c = F.split("value", "\t")
    text = lambda i: F.get(c, F.lit(i))
    known = lambda i: F.nullif(text(i), F.lit("na"))
    lines = spark.read.text(path).where(~F.col("value").startswith("#") & (F.trim("value") != "") & (F.size(c) >= 10))
    return lines.select(
        text(0).alias("sequence_name"), labels.sequence_role(text(1), text(3)).alias("sequence_role"), text(2).alias("assigned_molecule"), text(3).alias("location_type"),
        known(4).alias("genbank_accession"), known(6).alias("refseq_accession"), text(7).alias("assembly_unit"), text(8).cast("long").alias("sequence_length"), known(9).alias("ucsc_name"),
        text(7).isin("Primary Assembly", "non-nuclear").alias("is_primary_assembly"),
    )
