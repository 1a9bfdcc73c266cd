"""Connected components of a link table, without bringing links to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialize


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node of ``links``; root is the smallest node of its component.

    Nodes are of any ordered type. Alternates the large-star and small-star
    steps, so a chain of n nodes takes O(log n) rounds, and each round's links
    are written to the shared folder; rounds end when one leaves the set of
    links as it was. A star step groups by node through ``min`` and a join, both
    of which spread a hub over tasks (partial aggregation, skew-join splitting).
    Null ends and loops are ignored; no links give no rows.
    """
    edges = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    edges = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    before = None
    while True:
        # large star: each larger neighbour of u links to the least of u and its neighbours
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialize(large, "cc")
        # small star: u and its smaller neighbours link to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialize(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "cc")
        n = edges.count()
        if before is not None and before[0] == n and edges.join(before[1], ["u", "v"], "left_anti").isEmpty():
            break
        before = n, edges
    roots = edges.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
    own = roots.select(F.col("root").alias("node"), "root").distinct()
    return roots.union(own)
