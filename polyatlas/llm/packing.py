"""Best-fit packing of texts into sequences under source and copy conflicts."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialize

CAPACITY = 2048
ROWS_PER_SHARD = 8192


class BinPool:
    """Open bins ordered by what room they have left.

    Each bin carries one bitmap of the sources and duplicate clusters it holds.
    Bins of equal room share a bucket that also keeps the intersection of their
    bitmaps, so a bucket in which every bin conflicts is passed in one step.
    """

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.rooms: list[int] = []
        self.buckets: dict[int, list[int]] = {}
        self.common: dict[int, int] = {}
        self.maps: list[int] = []
        self.fill: list[int] = []

    def _put(self, which: int, room: int) -> None:
        if room == 0:
            return
        bucket = self.buckets.get(room)
        if bucket:
            bucket.append(which)
            self.common[room] &= self.maps[which]
            return
        if bucket is None:
            self.rooms.insert(bisect_left(self.rooms, room), room)
        self.buckets[room] = [which]
        self.common[room] = self.maps[which]

    def place(self, size: int, mask: int) -> tuple[int, int]:
        """(bin, start) in the tightest compatible bin, or a new one.

        The search goes from the least room that fits to ever larger ones, and
        within a room from the oldest bin on, until a bin has none of the bits.
        """
        rooms = self.rooms
        for i in range(bisect_left(rooms, size), len(rooms)):
            room = rooms[i]
            if self.common[room] & mask:
                continue
            bucket = self.buckets[room]
            for j, which in enumerate(bucket):
                if not self.maps[which] & mask:
                    del bucket[j]
                    if not bucket:
                        del rooms[i], self.buckets[room], self.common[room]
                    start = self.fill[which]
                    self.fill[which] += size
                    self.maps[which] |= mask
                    self._put(which, room - size)
                    return which, start
            common = self.maps[bucket[0]]
            for which in bucket:
                common &= self.maps[which]
            self.common[room] = common
        self.maps.append(mask)
        self.fill.append(size)
        self._put(len(self.maps) - 1, self.capacity - size)
        return len(self.maps) - 1, 0


def pack_items(sizes: Iterable[int], sources: Iterable[int], clusters: Iterable[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, start) of each item in the given order; equal non-negative source or cluster numbers conflict."""
    pool = BinPool(capacity)
    out = []
    for size, source, cluster in zip(sizes, sources, clusters, strict=True):
        mask = (1 << source if source >= 0 else 0) | (1 << cluster if cluster >= 0 else 0)
        out.append(pool.place(size, mask))
    return out


def best_fit(items: DataFrame, capacity: int = CAPACITY, rows_per_shard: int = ROWS_PER_SHARD) -> DataFrame:
    """(doc_id, piece, size, offset, bin_id, start) for every piece of ``items`` (doc_id, source, cluster, n_tokens).

    A text longer than ``capacity`` fills whole bins with its first pieces; its
    last piece is packed like a short text. Rows are dealt by hash into shards of
    about ``rows_per_shard``, each packed by itself, longest first: a piece goes
    to the bin with the least room that fits and holds neither its source nor its
    duplicate cluster, else to a new bin. A bin's tokens never pass ``capacity``.

    Null source or cluster conflicts with nothing; null or non-positive sizes
    take no room and get no row; ties go by doc_id, then source and cluster;
    repeated rows are dealt apart and packed each; extra columns are ignored.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    items = items.select("doc_id", F.col("source").cast("string").alias("source"), F.col("cluster").cast("long").alias("cluster"), F.col("n_tokens").cast("long").alias("n_tokens")).where("n_tokens > 0").withColumn("nth", F.monotonically_increasing_id())
    shards = max(1, -(-items.count() // rows_per_shard))
    full = F.expr(f"(n_tokens - 1) div {capacity}")
    last = items.select("doc_id", "source", "cluster", full.alias("piece"), (F.col("n_tokens") - full * capacity).alias("size"), F.pmod(F.xxhash64("doc_id", "source", "n_tokens", "nth"), F.lit(shards)).alias("shard"))
    whole = items.where(F.col("n_tokens") > capacity).select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), full - 1)).alias("piece"))
    whole = whole.select("doc_id", "piece", F.lit(capacity).cast("long").alias("size"), (F.col("piece") * capacity).alias("offset"), F.concat_ws("-", F.lit("w"), F.col("doc_id").cast("string"), F.col("piece").cast("string")).alias("bin_id"), F.lit(0).cast("long").alias("start"))

    def run(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values(["size", "doc_id", "source", "cluster"], ascending=[False, True, True, True], kind="stable")
        names = shard["cluster"]
        twice = names[names.notna() & names.duplicated(keep=False)].unique()
        source = pd.factorize(shard["source"])[0]
        cluster = pd.Index(twice).get_indexer(names) if len(twice) else np.full(len(shard), -1)
        width = int(source.max()) + 1 if len(source) else 0
        cluster = np.where(cluster >= 0, cluster + width, -1)
        placed = pack_items(shard["size"].tolist(), source.tolist(), cluster.tolist(), capacity)
        prefix = f"s{int(shard['shard'].iloc[0])}-"
        return pd.DataFrame({"doc_id": shard["doc_id"], "piece": shard["piece"], "size": shard["size"], "offset": shard["piece"] * capacity, "bin_id": [f"{prefix}{b}" for b, _ in placed], "start": [s for _, s in placed]})

    kind = items.schema["doc_id"].dataType.simpleString()
    packed = last.groupBy("shard").applyInPandas(run, f"doc_id {kind}, piece long, size long, offset long, bin_id string, start long")
    return packed.union(whole)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, rows_per_shard: int = ROWS_PER_SHARD) -> DataFrame:
    """``best_fit`` of documents: a text's tokens are its words and one end, its cluster is that of its exact copies."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    items = docs.select("doc_id", "source", F.xxhash64(text).alias("cluster"), (F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")) + 1).cast("long").alias("n_tokens"))
    return best_fit(materialize(items, "items"), capacity, rows_per_shard)
