"""Fragments and ranges: half-open intervals on named chromosomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polyatlas.operators.order import places

BIN = 1 << 14
BLOCK = 128
# Order of the named chromosomes, after the numbered ones.
NAMED = {"chrX": 0, "chrY": 1, "chrM": 2}
MAX_CHROMOSOMES = 256
PROMOTER = 2000


def chromosome_order(fragments: DataFrame) -> DataFrame:
    """(chrom, rank): numbered ones by number, then X, Y, M, then the others by name; over 256 raise."""
    names = fragments.select("chrom").distinct()
    number = F.expr(r"try_cast(regexp_extract(chrom, '^chr(\\d+)$', 1) as int)")
    named = F.lit(None).cast("int")
    for name, rank in NAMED.items():
        named = F.when(F.col("chrom") == name, F.lit(rank)).otherwise(named)
    kind = F.when(number.isNotNull(), 0).when(named.isNotNull(), 1).otherwise(2)
    order = names.select("chrom", (F.row_number().over(Window.orderBy(kind, F.coalesce(number, named), "chrom")) - 1).alias("rank"))
    return order.select("chrom", F.when(F.col("rank") < MAX_CHROMOSOMES, F.col("rank")).otherwise(F.raise_error(F.lit("more than 256 chromosomes")).cast("int")).alias("rank"))


def overlap_join(fragments: DataFrame, ranges: DataFrame, width: int = BIN, keep: tuple[str, ...] = ()) -> DataFrame:
    """All pairs of ``fragments`` (chrom, start, length, ...) and ``ranges`` (range_id, chrom, start, end) that overlap.

    Both sides are dealt to the bins they touch and joined on (chrom, bin); a
    pair counts only in the first bin it shares, so none comes twice. ``keep``
    are further columns of the ranges to return.
    """
    f = fragments.withColumn("_end", F.col("start") + F.col("length")).where("length > 0")
    f = f.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("_end") - 1) / width))))
    r = ranges.where("end > start").select("range_id", *keep, F.col("chrom").alias("_chrom"), F.col("start").alias("_rs"), F.col("end").alias("_re"))
    r = r.withColumn("_rbin", F.explode(F.sequence(F.floor(F.col("_rs") / width), F.floor((F.col("_re") - 1) / width))))
    pairs = f.join(r, (F.col("chrom") == F.col("_chrom")) & (F.col("_bin") == F.col("_rbin")))
    first = F.greatest(F.floor(F.col("start") / width), F.floor(F.col("_rs") / width))
    hit = pairs.where((F.col("start") < F.col("_re")) & (F.col("_end") > F.col("_rs")) & (F.col("_bin") == first))
    return hit.select(*fragments.columns, "range_id", F.col("_rs").alias("range_start"), F.col("_re").alias("range_end"), *keep)


def query_region(fragments: DataFrame, chrom: str, start: int, end: int) -> DataFrame:
    """The fragments that overlap one region."""
    return fragments.where((F.col("chrom") == F.lit(chrom)) & (F.col("start") < end) & (F.col("start") + F.col("length") > start))


def peak_set(ranges: DataFrame) -> DataFrame:
    """(range_id, chrom, start, end, name): ranges numbered by chromosome and start, named after their place if nameless."""
    named = F.coalesce(F.nullif("name", F.lit("")), F.concat_ws("", "chrom", F.lit(":"), "start", F.lit("-"), "end"))
    at = Window.partitionBy("chrom").orderBy("start", "end", "name")
    total = ranges.groupBy("chrom").agg(F.count("*").alias("_n"))
    before = total.select("chrom", (F.sum("_n").over(Window.orderBy("chrom")) - F.col("_n")).alias("_before"))
    out = ranges.withColumn("name", named).withColumn("_i", F.row_number().over(at) - 1).join(F.broadcast(before), "chrom")
    return out.select((F.col("_before") + F.col("_i")).alias("range_id"), "chrom", "start", "end", "name")


def n_ranges(ranges: DataFrame) -> int:
    """How many ranges there are, those on unknown chromosomes too."""
    return ranges.count()


def count_matrix(fragments: DataFrame, ranges: DataFrame, cells: DataFrame | None = None, width: int = BIN) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(obs, var, x): (cell, n_fragments), (range_id, chrom, start, end, name, n_cells), and counts (cell, range_id, n).

    obs has every cell of ``cells`` (cell), or of the fragments, and var every
    range of ``peak_set(ranges)``, those that no fragment touches and those on
    chromosomes without fragments too: they are rows of zeros and zero columns.
    """
    peaks = peak_set(ranges)
    x = count_fragments(fragments, peaks, width)
    everyone = (fragments if cells is None else cells).select("cell").distinct()
    obs = everyone.join(fragments_per(fragments, "cell"), "cell", "left").select("cell", F.coalesce("n", F.lit(0)).alias("n_fragments"))
    x = x if cells is None else x.join(everyone, "cell", "left_semi")
    var = peaks.join(x.groupBy("range_id").agg(F.count("*").alias("n_cells")), "range_id", "left").fillna(0, ["n_cells"])
    return obs, var.select("range_id", "chrom", "start", "end", "name", "n_cells"), x


def joint_chromosomes(layouts: DataFrame) -> DataFrame:
    """(chrom, global_chrom): the union of the chromosomes of groups (grp, chrom), numbered from 0 in order of name."""
    return layouts.select("chrom").where("chrom is not null").distinct().select("chrom", (F.row_number().over(Window.orderBy("chrom")) - 1).alias("global_chrom"))


def joint_fragments(fragments: DataFrame, cells: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(fragments, offsets, chromosomes) of ``cells`` (cell): fragments with their joint chromosome number, where each cell's begin and end in that order, and the numbers.

    Cells without fragments have an empty range. Numbers are of the chromosomes
    that the chosen cells' fragments lie on, in order of name.
    """
    from polyatlas.operators.matrix import offsets

    own = fragments.join(cells.select("cell").distinct(), "cell", "left_semi")
    names = joint_chromosomes(own)
    counts = cells.select("cell").distinct().join(fragments_per(own, "cell"), "cell", "left").select("cell", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    return own.join(names, "chrom"), offsets(counts, "cell", "n"), names


class GenomeSorted:
    """Fragments ordered for region queries: written once in genome order, read by region."""

    def __init__(self, fragments: DataFrame):
        self.fragments = fragments

    @classmethod
    def write(cls, fragments: DataFrame, path: str) -> "GenomeSorted":
        genome_sorted(fragments).write.mode("errorifexists").parquet(path)
        return cls.open(fragments.sparkSession, path)

    @classmethod
    def open(cls, spark, path: str) -> "GenomeSorted":
        return cls(spark.read.parquet(path))

    @property
    def chrom_names(self) -> list[str]:
        """At most MAX_CHROMOSOMES names, in order."""
        return [r["chrom"] for r in chromosome_order(self.fragments).orderBy("rank").collect()]

    @property
    def n_fragments(self) -> int:
        return self.fragments.count()

    def query_region(self, chrom: str, start: int, end: int) -> DataFrame:
        """Fragments that overlap the region; files and row groups of other places are skipped by their bounds. An unknown chromosome gives none."""
        return query_region(self.fragments, chrom, start, end)


def count_fragments(fragments: DataFrame, ranges: DataFrame, width: int = BIN) -> DataFrame:
    """(cell, range_id, n): how many fragments of each cell overlap each range; pairs of none have no row."""
    return overlap_join(fragments, ranges, width).groupBy("cell", "range_id").agg(F.count("*").cast("int").alias("n"))


def fragments_per(fragments: DataFrame, key: str) -> DataFrame:
    """(key, n) of fragments by cell or chromosome."""
    return fragments.groupBy(key).agg(F.count("*").alias("n"))


def cell_sorted(fragments: DataFrame) -> DataFrame:
    """Fragments in order of cell, chromosome and start within ranges of cells."""
    return fragments.repartitionByRange("cell").sortWithinPartitions("cell", "chrom", "start")


def write_cell_sorted(fragments: DataFrame, path: str) -> DataFrame:
    """Fragments written once in order of cell, so that a cell's are in few places, and read again."""
    cell_sorted(fragments).write.mode("errorifexists").parquet(path)
    return fragments.sparkSession.read.parquet(path)


def genome_sorted(fragments: DataFrame) -> DataFrame:
    """Fragments in order of chromosome and start within ranges of both, for region scans."""
    return fragments.repartitionByRange("chrom", "start").sortWithinPartitions("chrom", "start", "length", "cell")


def end_max(fragments: DataFrame, block: int = BLOCK) -> DataFrame:
    """(chrom, block, end_max): the greatest end of each run of ``block`` fragments of a chromosome in order of start.

    Blocks start anew with each chromosome, so one never spans two of them. Only
    a row for each chromosome is sent to all tasks; places come from ranges.
    """
    sizes = fragments_per(fragments, "chrom")
    first = sizes.select("chrom", (F.sum("n").over(Window.orderBy("chrom")) - F.col("n")).alias("_first"))
    placed = places(fragments.where("chrom is not null"), ["chrom", "start", "length", "cell"], "_place").join(F.broadcast(first), "chrom")
    at = placed.withColumn("block", F.floor((F.col("_place") - F.col("_first")) / block))
    return at.groupBy("chrom", "block").agg(F.max(F.col("start") + F.col("length")).alias("end_max"))


def tile_matrix(fragments: DataFrame, chrom: str, start: int, end: int, width: int) -> DataFrame:
    """(cell, tile, n) of the tiles of a region, by the fragments' start."""
    own = query_region(fragments, chrom, start, end).where((F.col("start") >= start) & (F.col("start") < end))
    return own.groupBy("cell", F.floor((F.col("start") - start) / width).alias("tile")).agg(F.count("*").alias("n"))


def _tss(strand: Column, start: Column, end: Column) -> Column:
    return F.when(strand == "-", end).otherwise(start)


def annotate_coordinates(coords: DataFrame, genes: DataFrame, features: DataFrame) -> DataFrame:
    """(id, gene, alternatives, target_context, confidence) of each coordinate (id, chrom, start, end).

    ``genes`` (gene, chrom, start, end, strand) overlap a coordinate with closed
    ends; the nearest by transcription start is chosen, with confidence 1.0 for
    one gene, 0.9 for two, else 0.5. ``features`` (feature_type, transcript,
    chrom, start, end, strand) give the context of the midpoint: coding exon,
    untranslated exon by strand, intron, promoter, other; no gene: intergenic.
    """
    c = coords.select("id", F.col("chrom").alias("_c"), F.col("start").alias("_s"), F.col("end").alias("_e"), F.floor((F.col("start") + F.col("end")) / 2).alias("mid"))
    closed = lambda df, names: df.select(F.lit(0).alias("range_id"), "chrom", "start", (F.col("end") + 1).alias("end"), F.col("start").alias("from"), F.col("end").alias("to"), *names)
    whole = c.select("id", "mid", F.col("_c").alias("chrom"), F.col("_s").alias("start"), (F.col("_e") - F.col("_s") + 1).alias("length"))
    hit = overlap_join(whole, closed(genes, ("gene", "strand")), keep=("gene", "strand", "from", "to")).select("id", "mid", "gene", "strand", F.col("from").alias("start"), F.col("to").alias("end"))
    tss = _tss(F.col("strand"), F.col("start"), F.col("end"))
    near = F.min(F.struct(F.abs(F.col("mid") - tss).alias("d"), F.col("gene"), tss.alias("tss"), F.col("strand"))).alias("best")
    best = hit.groupBy("id", "mid").agg(near, F.array_sort(F.collect_set("gene")).alias("genes"))
    cds = features.where("feature_type = 'cds'").groupBy("transcript").agg(F.min("start").alias("cds_min"))
    middle = c.select("id", "mid", F.col("_c").alias("chrom"), F.col("mid").alias("start"), F.lit(1).alias("length"))
    names = ("feature_type", "transcript", "strand")
    inside = overlap_join(middle, closed(features, names), keep=names).select("id", "mid", *names).join(cds, "transcript", "left")
    five = (F.col("strand") == "-") != (F.col("mid") < F.col("cds_min"))
    utr = F.when(F.col("cds_min").isNull(), "other").when(five, "5_UTR").otherwise("3_UTR")
    what = F.when(F.col("feature_type") == "cds", F.struct(F.lit(0).alias("k"), F.lit("exon").alias("v"))).when(F.col("feature_type") == "exon", F.struct(F.lit(1).alias("k"), utr.alias("v"))).when(F.col("feature_type") == "transcript", F.struct(F.lit(2).alias("k"), F.lit("intron").alias("v")))
    context = inside.groupBy("id").agg(F.min(what).alias("w"))
    ahead = F.when(F.col("best.strand") == "-", (F.col("mid") > F.col("best.tss")) & (F.col("mid") <= F.col("best.tss") + PROMOTER)).otherwise((F.col("mid") < F.col("best.tss")) & (F.col("mid") >= F.col("best.tss") - PROMOTER))
    full = coords.select("id").join(best, "id", "left").join(context, "id", "left")
    n = F.size("genes")
    return full.select(
        "id", F.col("best.gene").alias("gene"), F.array_remove(F.coalesce("genes", F.array().cast("array<string>")), F.coalesce(F.col("best.gene"), F.lit(""))).alias("alternatives"),
        F.when(F.col("best").isNull(), "intergenic").when(F.col("w.v").isNotNull(), F.col("w.v")).when(ahead, "promoter").otherwise("other").alias("target_context"),
        F.when(F.col("best").isNull(), 0.0).when(n == 1, 1.0).when(n == 2, 0.9).otherwise(0.5).alias("confidence"),
    )


def best_alignment(hits: DataFrame) -> DataFrame:
    """(guide, chromosome, start, end, strand, pct_matched) of each guide's best hit on a primary chromosome."""
    primary = hits.where(F.col("chromosome").rlike(r"^chr(\d{1,2}|[XY])$"))
    return primary.groupBy("guide").agg(F.max_by(F.struct("chromosome", "start", "end", "strand", "pct_matched"), "pct_matched").alias("h")).select("guide", "h.*")
