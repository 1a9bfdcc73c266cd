"""Ragged matrices in coordinate form: layouts, feature spaces and reconstruction.

A layout table has (grp, local_index, feature_uid, global_index); a value table
(uid, grp, local_index, one column for each layer). Groups may have different
features; a query joins them by global index.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyatlas.operators.order import places, running_sum

UNION, INTERSECTION = "union", "intersection"


def build_layout(features: DataFrame, registry: DataFrame) -> DataFrame:
    """(grp, local_index, feature_uid, global_index) of (grp, local_index, feature_uid); see ``layout_errors`` for the checks."""
    known = registry.select(F.col("uid").alias("feature_uid"), "global_index")
    return features.select("grp", "local_index", "feature_uid").join(known, "feature_uid", "left").select("grp", "local_index", "feature_uid", "global_index")


def layout_errors(layout: DataFrame, registry: DataFrame) -> DataFrame:
    """(grp, n, null_uids, null_globals, repeats, unresolved) for each group: all but n are zero in a sound layout."""
    known = registry.select(F.col("uid").alias("feature_uid"), F.lit(True).alias("known"))
    joined = layout.join(known, "feature_uid", "left")
    return joined.groupBy("grp").agg(
        F.count("*").alias("n"), F.count_if(F.col("feature_uid").isNull()).alias("null_uids"), F.count_if(F.col("global_index").isNull()).alias("null_globals"),
        (F.count("feature_uid") - F.count_distinct("feature_uid")).alias("repeats"), F.count_if(F.col("known").isNull() & F.col("feature_uid").isNotNull()).alias("unresolved"),
    )


def reindex(registry: DataFrame) -> DataFrame:
    """``registry`` in which features without a global index get the next ones, in order of uid; given ones never change.

    Ids are places in ranges of uids, shifted by the totals of the ranges before,
    so no task numbers all features.
    """
    fresh = registry.where("global_index is null").select("uid")
    top = registry.agg((F.coalesce(F.max("global_index"), F.lit(-1)) + 1).alias("base"))
    ids = places(fresh, ["uid"], "place").join(F.broadcast(top), F.lit(True)).select("uid", (F.col("base") + F.col("place")).alias("fresh"))
    return registry.join(ids, "uid", "left").withColumn("global_index", F.coalesce("global_index", "fresh").cast("long")).select(*registry.columns)


def sync_layout(layout: DataFrame, registry: DataFrame) -> DataFrame:
    """``layout`` whose missing global indexes are filled from the registry."""
    known = registry.where("global_index is not null").select(F.col("uid").alias("feature_uid"), F.col("global_index").alias("_g"))
    return layout.join(known, "feature_uid", "left").withColumn("global_index", F.coalesce("global_index", "_g")).select(*layout.columns)


def feature_space(layout: DataFrame, groups: DataFrame, join: str = UNION) -> DataFrame:
    """(global_index) of the features of ``groups`` (grp): of any of them, or of all."""
    if join not in (UNION, INTERSECTION):
        raise ValueError(f"feature join must be {UNION} or {INTERSECTION}, not {join}")
    groups = groups.select("grp").distinct()
    own = layout.where("global_index is not null").join(groups, "grp", "left_semi")
    if join == UNION:
        return own.select("global_index").distinct()
    total = groups.agg(F.count("*").alias("n_groups"))
    counted = own.select("grp", "global_index").distinct().groupBy("global_index").agg(F.count("*").alias("n"))
    return counted.join(F.broadcast(total), F.col("n") == F.col("n_groups")).select("global_index")


def resolve_features(registry: DataFrame, uids: Sequence) -> DataFrame:
    """(feature_uid, global_index) of the wanted features, each once; raises if any is unknown or has no index."""
    spark = registry.sparkSession
    wanted = spark.createDataFrame([(u,) for u in dict.fromkeys(uids)], f"feature_uid {registry.schema['uid'].dataType.simpleString()}")
    found = wanted.join(registry.select(F.col("uid").alias("feature_uid"), "global_index"), "feature_uid", "left")
    missing = [r[0] for r in found.where("global_index is null").orderBy("feature_uid").limit(5).collect()]
    if missing:
        raise ValueError(f"features unknown or without an index, first {missing}")
    return found


def reconstruct_sparse(values: DataFrame, cells: DataFrame, layout: DataFrame, features: DataFrame, layers: Sequence[str]) -> DataFrame:
    """(uid, global_index, layers...) of the stored values of ``cells`` (uid, grp) at ``features`` (global_index).

    Local indexes become global ones by a join with the layout; values stored
    twice for a cell and feature add up. Groups come first in the join, so whole
    partitions of other groups fall out.
    """
    wanted = layout.join(features, "global_index", "left_semi").select("grp", "local_index", "global_index")
    own = values.select("uid", "grp", "local_index", *layers).join(cells.select("uid", "grp"), ["uid", "grp"], "left_semi")
    return own.join(wanted, ["grp", "local_index"]).groupBy("uid", "global_index").agg(*(F.sum(x).alias(x) for x in layers))


def csc_order(values: DataFrame) -> DataFrame:
    """The same values range-partitioned and sorted by feature, for scans of few features."""
    return values.repartitionByRange("grp", "local_index").sortWithinPartitions("grp", "local_index", "uid")


def reconstruct_dense(values: DataFrame, cells: DataFrame, layout: DataFrame, features: DataFrame, layer: str) -> DataFrame:
    """(uid, values array<float>) over ``features`` in order of global index, zero where a cell's group lacks one.

    ``values`` has an array for each cell (uid, grp, layer). Each group's layout
    becomes one list of places to gather, joined by group, and each cell's array
    is gathered in its row: values are neither exploded nor shuffled by feature.
    Places outside an array, and null entries, give zero.
    """
    order = features.agg(F.array_sort(F.collect_set("global_index")).alias("g"))
    wanted = layout.join(features, "global_index", "left_semi").groupBy("grp").agg(F.map_from_entries(F.collect_set(F.struct("global_index", "local_index"))).alias("m"))
    gather = wanted.join(order, F.lit(True)).select("grp", F.transform("g", lambda g: F.coalesce(F.element_at("m", g), F.lit(-1)).cast("int")).alias("at"))
    own = values.join(cells.select("uid", "grp"), ["uid", "grp"], "left_semi").select("uid", "grp", F.col(layer).alias("v"))
    zero = F.lit(0.0).cast("float")
    full = own.join(gather, "grp", "left").join(order, F.lit(True))
    # where a group has none of the features its cells are all zero
    none = F.transform("g", lambda g: zero)
    return full.select("uid", F.coalesce(F.transform("at", lambda i: F.coalesce(F.when(i >= 0, F.get("v", i)).cast("float"), zero)), none).alias("values"))


def values_per_cell(values: DataFrame, layer: str) -> DataFrame:
    """(uid, nnz) of the non-zero values of each cell."""
    return values.groupBy("uid").agg(F.count_if(F.col(layer) != 0).alias("nnz"))


def offsets(counts: DataFrame, key: str, count: str) -> DataFrame:
    """``counts`` with (begin, end) of each key in order: running sums within ranges of keys, shifted by the totals before."""
    done = running_sum(counts, [key], count, "end")
    return done.select(*counts.columns, (F.col("end") - F.col(count)).alias("begin"), "end")


def dense_shape_errors(values: DataFrame, layer: str) -> DataFrame:
    """(length, n) of each array length; more than one row means cells of different shape."""
    return values.groupBy(F.size(layer).alias("length")).agg(F.count("*").alias("n"))


def union_layers(layers: dict[str, DataFrame]) -> DataFrame:
    """(uid, local_index, layers...) over the joint sparsity of several (uid, local_index, value) tables, zero where one has none."""
    parts = None
    for name, df in layers.items():
        part = df.select("uid", "local_index", *(F.col("value").alias(n) if n == name else F.lit(None).cast(df.schema["value"].dataType).alias(n) for n in layers))
        parts = part if parts is None else parts.unionByName(part)
    return parts.groupBy("uid", "local_index").agg(*(F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in layers))
