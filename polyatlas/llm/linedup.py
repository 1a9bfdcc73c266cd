"""Removal of boilerplate lines that spread over many sites."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialize, row_key, unused

MIN_SITES = 10
LG_K = 12
#: Estimates within this share of the threshold are counted exactly; over ten times the sketch's standard error.
MARGIN = 0.2
_BLANKS = " \t\x0b\x0c\r"


def _lines(docs: DataFrame) -> DataFrame:
    """One row for each line that holds a word: its 128-bit digest (blanks around it aside), site and place."""
    split = docs.select(row_key().alias("row_key"), "doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("site"), F.posexplode(F.split(F.col("text").cast("string"), "\n")).alias("at", "line"))
    split = split.withColumn("line", F.btrim("line", F.lit(_BLANKS))).where("line <> ''")
    return split.select("row_key", "doc_id", F.xxhash64("site").alias("site"), "at", F.unhex(F.md5("line")).alias("line"))


def spread_lines(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """(line, keep): lines found on ``min_sites`` sites or more, with the place that stays.

    Lines seen on one site only fall out by their least and greatest site. For
    the others HyperLogLog sketches of the sites, built in each task, merge by
    aggregation; lines whose estimate is within 20 % of the threshold get an
    exact distinct count.
    """
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id"), F.col("row_key"), F.col("at"))
    seen = lines.groupBy("line").agg(F.min("site").alias("a"), F.max("site").alias("b"), F.min(place).alias("keep")).where("a <> b").select("line", "keep")
    seen = materialize(seen, "seen")
    shared = lines.join(seen.select("line"), "line", "left_semi")
    sketches = shared.groupBy("line").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K))).alias("sites"))
    sketches = materialize(sketches.where(F.col("sites") >= (1 - MARGIN) * min_sites), "sketches")
    near = sketches.where(F.col("sites") <= (1 + MARGIN) * min_sites).select("line")
    exact = shared.join(near, "line", "left_semi").groupBy("line").agg(F.count_distinct("site").alias("n")).where(F.col("n") >= min_sites).select("line")
    spread = sketches.where(F.col("sites") > (1 + MARGIN) * min_sites).select("line").union(exact)
    return seen.join(spread, "line", "left_semi")


def line_dedup(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """``docs`` with boilerplate lines cut from ``text``; the columns stay, and so does every row.

    A line (a \\n-split piece, compared without the blanks around it) found on
    ``min_sites`` distinct values of ``source`` or more stays only where it
    first occurs: in the row of least doc_id, at its first place. Lines without
    a word stay. A null source is a site of its own, a null text stays null,
    rows equal in doc_id and text are treated alike. Columns of any name are kept.
    """
    lines = materialize(_lines(docs), "lines")
    spread = materialize(spread_lines(lines, min_sites), "spread")
    hit = lines.join(spread, "line").where((F.col("row_key") != F.col("keep.row_key")) | (F.col("at") != F.col("keep.at")))
    row, key, drop = unused(docs.columns, "row", "key", "drop")
    drops = hit.groupBy("row_key").agg(F.collect_set("at").alias(drop)).withColumnRenamed("row_key", key)
    # a merge join at every size: a broadcast of what was dropped would grow with the input
    out = docs.withColumn(row, row_key()).join(materialize(drops, "drops").hint("merge"), F.col(row) == F.col(key), "left")
    pieces = F.split(F.col("text").cast("string"), "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(pieces) - 1), F.col(drop))
    kept = F.array_join(F.transform(stay, lambda i: F.get(pieces, i)), "\n")
    return out.select(*(F.when(F.col(drop).isNull(), F.col("text")).otherwise(kept).alias("text") if c == "text" else F.col(c) for c in docs.columns))
