"""Differential statistics between groups of cells, as grouped plans over all targets at once."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from polyatlas.functions.stats import normal_sf, t_two_sided

EPSILON = 1e-9
COLUMNS = ("feature", "target_mean", "ref_mean", "target_n", "ref_n", "fold_change", "percent_change", "p_value", "statistic", "fdr", "target")


def normalise(values: DataFrame, target_sum: float = 1e4) -> DataFrame:
    """(uid, feature, x float) = log1p of values scaled to ``target_sum`` a cell; cells of sum zero or less stay unscaled."""
    total = F.sum("value").over(Window.partitionBy("uid"))
    scaled = F.when(total > 0, F.col("value") * F.lit(target_sum) / total).otherwise(F.col("value"))
    return values.select("uid", "feature", F.log1p(scaled).cast("float").alias("x"))


def group_sizes(cells: DataFrame) -> DataFrame:
    """(grp, n) of (uid, grp)."""
    return cells.groupBy("grp").agg(F.count("*").alias("n"))


def pseudobulk(values: DataFrame, cells: DataFrame, geometric: bool = True) -> DataFrame:
    """(grp, feature, mean) over all cells of a group, zeros included: of x, or back from the mean of log1p."""
    sums = values.join(cells, "uid").groupBy("grp", "feature").agg(F.sum(F.col("x").cast("double") if geometric else F.expm1(F.col("x").cast("double"))).alias("s"))
    mean = F.col("s") / F.col("n")
    return sums.join(F.broadcast(group_sizes(cells)), "grp").select("grp", "feature", (F.expm1(mean) if geometric else mean).alias("mean"))


def rank_sums(values: DataFrame, cells: DataFrame, control) -> DataFrame:
    """(target, feature, u, tie, n_a, n_b): U of each target against the control, ties averaged, zeros one block at the bottom.

    One row for each target and each feature with a positive value in any group.
    U counts, for each cell of the target, the control's cells below it, and half
    of those equal to it. Counts of (feature, value) run once along each feature
    for the control and serve all targets, so the control is shuffled once
    however many targets there are; zeros are counted from the group sizes.
    """
    counts = values.where("x > 0").join(cells, "uid").groupBy("feature", "grp", "x").agg(F.count("*").alias("c"))
    sizes = group_sizes(cells)
    is_control = F.col("grp") == F.lit(control)
    targets = sizes.where(~is_control).select(F.col("grp").alias("target"), F.col("n").alias("n_a"))
    n_b = sizes.where(is_control).select(F.col("n").alias("n_b"))
    b = F.when(is_control, F.col("c")).otherwise(0)
    cube = lambda c: F.pow(c.cast("double"), F.lit(3.0)) - c
    upto = F.sum(b).over(Window.partitionBy("feature").orderBy("x").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    equal = F.sum(b).over(Window.partitionBy("feature", "x"))
    ranked = counts.select("feature", "grp", "x", "c", equal.alias("equal"), upto.alias("upto"))
    ref = ranked.where(is_control).groupBy("feature").agg(F.sum("c").alias("sb"), F.sum(cube(F.col("c"))).alias("tie_b"))
    above = F.sum(F.col("c") * (F.col("upto") - F.col("equal") / 2))
    own = ranked.where(~is_control).groupBy(F.col("grp").alias("target"), "feature").agg(F.sum("c").alias("sa"), above.alias("above"), F.sum(cube(F.col("c") + F.col("equal")) - cube(F.col("equal"))).alias("tie_a"))
    grid = counts.select("feature").distinct().join(F.broadcast(targets), F.lit(True)).join(F.broadcast(n_b), F.lit(True))
    full = grid.join(own, ["target", "feature"], "left").join(ref, "feature", "left").fillna(0, ["sa", "above", "tie_a", "sb", "tie_b"])
    a0, b0 = F.col("n_a") - F.col("sa"), F.col("n_b") - F.col("sb")
    u = F.col("above") + F.col("sa") * b0 + a0 * b0 / 2
    return full.select("target", "feature", u.cast("double").alias("u"), (F.col("tie_a") + F.col("tie_b") + cube(a0 + b0)).alias("tie"), "n_a", "n_b")


def rank_sums_dense(values: DataFrame, cells: DataFrame, control) -> DataFrame:
    """``rank_sums`` of a dense table (uid, values array<number>): every stored value takes part, negative ones too, and null counts as zero.

    The features are the places in the arrays; arrays of unequal length, or none
    at all, raise.
    """
    lengths = values.agg(F.count_distinct(F.size("values")).alias("n"), F.coalesce(F.max(F.size("values")), F.lit(0)).alias("most")).first()
    if lengths["n"] != 1 or lengths["most"] < 1:
        raise ValueError("dense values must be arrays of one length, at least 1")
    flat = values.select("uid", F.posexplode("values").alias("feature", "x")).select("uid", "feature", F.coalesce("x", F.lit(0)).cast("double").alias("x"))
    counts = flat.join(cells, "uid").groupBy("feature", "grp", "x").agg(F.count("*").alias("c"))
    is_control = F.col("grp") == F.lit(control)
    b = F.when(is_control, F.col("c")).otherwise(0)
    cube = lambda c: F.pow(c.cast("double"), F.lit(3.0)) - c
    upto = F.sum(b).over(Window.partitionBy("feature").orderBy("x").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    equal = F.sum(b).over(Window.partitionBy("feature", "x"))
    ranked = counts.select("feature", "grp", "x", "c", equal.alias("equal"), upto.alias("upto"))
    ref = ranked.where(is_control).groupBy("feature").agg(F.sum("c").alias("n_b"), F.sum(cube(F.col("c"))).alias("tie_b"))
    own = ranked.where(~is_control).groupBy(F.col("grp").alias("target"), "feature").agg(F.sum("c").alias("n_a"), F.sum(F.col("c") * (F.col("upto") - F.col("equal") / 2)).alias("u"), F.sum(cube(F.col("c") + F.col("equal")) - cube(F.col("equal"))).alias("tie_a"))
    return own.join(ref, "feature").select("target", "feature", F.col("u").cast("double").alias("u"), (F.col("tie_a") + F.col("tie_b")).alias("tie"), "n_a", "n_b")


def mann_whitney(ranks: DataFrame, alternative: str = "two-sided", continuity: bool = True) -> DataFrame:
    """``ranks`` plus p_value by the tie-corrected normal approximation."""
    a, b = F.col("n_a").cast("double"), F.col("n_b").cast("double")
    n, half = a + b, F.lit(0.5 if continuity else 0.0)
    variance = a * b / 12 * ((n + 1) - F.when(n > 1, F.col("tie") / (n * (n - 1))).otherwise(0.0))
    u, mean = F.col("u"), a * b / 2
    if alternative == "two-sided":
        z, times = F.greatest(u, a * b - u) - mean - half, 2
    elif alternative == "greater":
        z, times = u - mean - half, 1
    elif alternative == "less":
        z, times = mean - u - half, 1
    else:
        raise ValueError("alternative must be two-sided, less or greater")
    p = F.least(F.lit(1.0), times * normal_sf(F.when(variance > 0, z / F.sqrt(variance)).otherwise(0.0)))
    return ranks.withColumn("p_value", F.when(variance > 0, p).otherwise(1.0))


def welch(values: DataFrame, cells: DataFrame, control) -> DataFrame:
    """(target, feature, statistic, df, n_a, n_b) of Welch's t from sums over all cells; no variance gives 0."""
    x = F.col("x").cast("double")
    # sums of the differences from one stored value of the feature keep digits that x * x would lose
    shift = values.groupBy("feature").agg(F.avg(x).alias("shift"))
    moved = values.join(shift, "feature").withColumn("d", x - F.col("shift"))
    sums = moved.join(cells, "uid").groupBy("grp", "feature").agg(F.sum("d").alias("s1"), F.sum(F.col("d") * F.col("d")).alias("s2"), F.count("*").alias("k"), F.first("shift").alias("shift"))
    sums = sums.join(F.broadcast(group_sizes(cells)), "grp")
    zeros = F.col("n") - F.col("k")
    s1, s2 = F.col("s1") - zeros * F.col("shift"), F.col("s2") + zeros * F.col("shift") * F.col("shift")
    stats = sums.select("grp", "feature", "n", (s1 / F.col("n") + F.col("shift")).alias("mean"), ((s2 - s1 * s1 / F.col("n")) / (F.col("n") - 1)).alias("var"))
    sizes = group_sizes(cells)
    features = stats.select("feature").distinct()
    n_ref = sizes.where(F.col("grp") == F.lit(control)).select(F.col("n").alias("n_b"))
    grid = features.join(F.broadcast(sizes.where(F.col("grp") != F.lit(control)).select(F.col("grp").alias("target"), F.col("n").alias("n_a"))), F.lit(True)).join(F.broadcast(n_ref), F.lit(True))
    a = stats.select(F.col("grp").alias("target"), "feature", F.col("mean").alias("ma"), F.greatest("var", F.lit(0.0)).alias("va"))
    b = stats.where(F.col("grp") == F.lit(control)).select("feature", F.col("mean").alias("mb"), F.greatest("var", F.lit(0.0)).alias("vb"))
    full = grid.join(a, ["target", "feature"], "left").join(b, "feature", "left").fillna(0.0, ["ma", "va", "mb", "vb"])
    va, vb = F.col("va") / F.col("n_a"), F.col("vb") / F.col("n_b")
    se = F.sqrt(va + vb)
    t = F.when(se > 0, (F.col("ma") - F.col("mb")) / se).otherwise(0.0)
    df = F.when(se > 0, (va + vb) * (va + vb) / (va * va / (F.col("n_a") - 1) + vb * vb / (F.col("n_b") - 1))).otherwise((F.col("n_a") + F.col("n_b") - 2).cast("double"))
    return full.select("target", "feature", t.alias("statistic"), df.alias("df"), "n_a", "n_b")


def benjamini_hochberg(df: DataFrame, by: str = "target", p: str = "p_value") -> DataFrame:
    """``df`` plus fdr: the step-up adjusted p-values within each ``by``."""
    n = F.count("*").over(Window.partitionBy(by))
    rank = F.row_number().over(Window.partitionBy(by).orderBy(p))
    scored = df.withColumn("_r", rank).withColumn("_q", F.col(p) * n / F.col("_r"))
    least = F.min("_q").over(Window.partitionBy(by).orderBy(F.desc("_r")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return scored.withColumn("fdr", F.least(F.lit(1.0), F.greatest(F.lit(0.0), least))).drop("_r", "_q")


def fold_changes(means: DataFrame, control) -> DataFrame:
    """(target, feature, target_mean, ref_mean, fold_change, percent_change) of (grp, feature, mean); a missing mean is zero."""
    ref = means.where(F.col("grp") == F.lit(control)).select("feature", F.col("mean").alias("ref_mean"))
    targets = means.where(F.col("grp") != F.lit(control)).select("grp").distinct().select(F.col("grp").alias("target"))
    grid = means.select("feature").distinct().join(F.broadcast(targets), F.lit(True))
    own = means.select(F.col("grp").alias("target"), "feature", F.col("mean").alias("target_mean"))
    full = grid.join(own, ["target", "feature"], "left").join(ref, "feature", "left").fillna(0.0, ["target_mean", "ref_mean"])
    t, r = F.col("target_mean") + EPSILON, F.col("ref_mean") + EPSILON
    return full.select("target", "feature", "target_mean", "ref_mean", F.log2(t / r).alias("fold_change"), ((t - r) / r).alias("percent_change"))


def dex(values: DataFrame, cells: DataFrame, target: Sequence, control, test: str = "mwu", target_sum: float = 1e4, geometric_mean: bool = True) -> DataFrame:
    """One row for each target and feature, in the columns of ``COLUMNS``.

    ``values`` has (uid, feature, value) of the features to compare, ``cells``
    (uid, grp). Values are normalised after the restriction to these features.
    Empty targets, and for the t-test targets of one cell, fall out with a
    warning; an empty control raises.
    """
    if test not in ("mwu", "ttest"):
        raise ValueError("test must be mwu or ttest")
    chosen = cells.where(F.col("grp").isin(*target, control)).select("uid", "grp")
    sizes = {r["grp"]: r["n"] for r in group_sizes(chosen).collect()}  # one row for each named group
    if not sizes.get(control):
        raise ValueError(f"control {control} has no cells")
    least = 2 if test == "ttest" else 1
    kept = [t for t in dict.fromkeys(target) if t != control and sizes.get(t, 0) >= least]
    for t in set(target) - set(kept) - {control}:
        warnings.warn(f"target {t} has too few cells and is left out", stacklevel=2)
    chosen = chosen.where(F.col("grp").isin(*kept, control))
    x = normalise(values.where("value <> 0").join(chosen.select("uid"), "uid", "left_semi"), target_sum)
    change = fold_changes(pseudobulk(x, chosen, geometric_mean), control)
    if test == "mwu":
        tested = mann_whitney(rank_sums(x, chosen, control)).select("target", "feature", "n_a", "n_b", F.col("u").alias("statistic"), "p_value")
    else:
        tested = welch(x, chosen, control).select("target", "feature", "n_a", "n_b", "statistic", t_two_sided(F.col("statistic"), F.col("df")).alias("p_value"))
    full = tested.join(change, ["target", "feature"]).select("*", F.col("n_a").alias("target_n"), F.col("n_b").alias("ref_n"))
    return benjamini_hochberg(full).select(*COLUMNS)
