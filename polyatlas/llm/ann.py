"""Approximate nearest neighbours by robust-pruned graphs over shards."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import materialize

DEGREE = 32
BUILD_BEAM = 48
SEARCH_BEAM = 96
ALPHA = 1.2
SHARD_VECTORS = 4096
QUERY_BLOCK = 1024
NEIGHBOURS = 10


def _distances(x: np.ndarray, queries: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Squared distance to the rows ``ids`` (-1: infinite), from the differences, so no common offset costs digits."""
    gap = x[ids] - queries[:, None, :]
    d = np.einsum("qkd,qkd->qk", gap, gap)
    d[ids < 0] = np.inf
    return d


def _unit(x: np.ndarray) -> float:
    """A power of two by which the greatest component is about one, so that no square leaves the range of doubles."""
    return float(2.0 ** -np.clip(np.frexp(np.abs(x).max(initial=1e-300))[1], -1000, 1020))


def _lengths(gap: np.ndarray) -> np.ndarray:
    """Euclidean lengths along the last axis; the plain sum of squares wherever that is in range."""
    with np.errstate(over="ignore"):
        plain = (gap * gap).sum(axis=-1)
    if np.isfinite(plain).all() and (plain > 1e-280).all():
        return np.sqrt(plain)
    most = np.maximum(np.abs(gap).max(axis=-1, initial=0.0), 1e-300)
    scaled = most * np.sqrt(((gap / most[..., None]) ** 2).sum(axis=-1))
    return np.where(np.isfinite(plain) & (plain > 1e-280), np.sqrt(plain), scaled)


def beam_search(x: np.ndarray, graph: np.ndarray, entries: np.ndarray, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, distances) of the ``beam`` best vectors met by greedy search for each query, best first, all queries in step.

    Each step expands the best vector of the beam not expanded so far; a query
    ends when all of its beam is expanded.
    """
    q = len(queries)
    ids = np.full((q, beam), -1, dtype=np.int64)
    dist = np.full((q, beam), np.inf)
    done = np.ones((q, beam), dtype=bool)
    k = min(beam, len(entries))
    start = _distances(x, queries, np.broadcast_to(entries[:k], (q, k)))
    order = np.argsort(start, axis=1, kind="stable")
    ids[:, :k], dist[:, :k], done[:, :k] = entries[:k][order], np.take_along_axis(start, order, 1), False
    seen = np.zeros((q, len(x)), dtype=bool)
    np.put_along_axis(seen, ids[:, :k], True, axis=1)
    live = np.arange(q)
    while len(live):
        open_ = ~done[live]
        first = open_.argmax(axis=1)
        some = open_[np.arange(len(live)), first]
        live, first = live[some], first[some]
        if not len(live):
            break
        done[live, first] = True
        near = graph[ids[live, first]].astype(np.int64)
        fresh = (near >= 0) & ~seen[live[:, None], np.maximum(near, 0)]
        near = np.where(fresh, near, -1)
        r, c = np.nonzero(fresh)
        seen[live[r], near[r, c]] = True
        d = _distances(x, queries[live], near)
        all_d = np.concatenate((dist[live], d), axis=1)
        best = np.argsort(all_d, axis=1, kind="stable")[:, :beam]
        dist[live] = np.take_along_axis(all_d, best, 1)
        ids[live] = np.take_along_axis(np.concatenate((ids[live], near), axis=1), best, 1)
        done[live] = np.take_along_axis(np.concatenate((done[live], ~fresh), axis=1), best, 1)
    return ids, dist


def _prune(x: np.ndarray, points: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Robust pruning of each point's candidates: the nearest stays, and drops those alpha times closer to it than to the point."""
    n, k = candidates.shape
    valid = (candidates >= 0) & (candidates != points[:, None])
    y = x[np.maximum(candidates, 0)]
    d = np.where(valid, ((y - x[points][:, None, :]) ** 2).sum(axis=2), np.inf)
    order = np.argsort(d, axis=1, kind="stable")
    candidates, d, y = np.take_along_axis(candidates, order, 1), np.take_along_axis(d, order, 1), np.take_along_axis(y, order[:, :, None], 1)
    z = y - x[points][:, None, :]  # around the point, so that a common offset costs no digits
    square = (z * z).sum(2)
    between = square[:, :, None] + square[:, None, :] - 2 * z @ z.transpose(0, 2, 1)
    out = np.full((n, degree), -1, dtype=np.int32)
    used, alive = np.zeros(n, dtype=np.int64), np.isfinite(d)
    for j in range(k):
        take = np.flatnonzero(alive[:, j] & (used < degree))
        if not len(take):
            continue
        out[take, used[take]] = candidates[take, j]
        used[take] += 1
        alive[take] &= ~(alpha * alpha * between[take, j, :] <= d[take])
    return out


def build_graph(x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA, batch: int = 256, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(graph, entries) of one shard's vectors.

    Vectors join in random order, in growing batches: greedy search over the
    graph so far proposes neighbours, robust pruning keeps diverse ones, and the
    edges are reversed under the same pruning. A second pass over all vectors
    relaxes the pruning by ``alpha``.
    """
    n = len(x)
    graph = np.full((n, degree), -1, dtype=np.int32)
    rng = np.random.default_rng(seed)
    centre = int(((x - x.mean(axis=0)) ** 2).sum(axis=1).argmin())
    entries = np.unique(np.concatenate(([centre], rng.choice(n, min(n, 8), replace=False))))
    for relaxed in (1.0, alpha):
        order, i = rng.permutation(n), 0
        while i < n:
            rows = order[i : i + (batch if relaxed > 1 else max(8, min(batch, i)))]
            i += len(rows)
            found, _ = beam_search(x, graph, entries, x[rows], beam)
            inside = np.broadcast_to(rows, (len(rows), len(rows)))[:, :64] if i <= 64 else np.full((len(rows), 1), -1)
            graph[rows] = _prune(x, rows, _distinct(np.concatenate((found, graph[rows], inside), axis=1)), degree, relaxed)
            src, dst = np.repeat(rows, degree), graph[rows].ravel()
            keep = dst >= 0
            src, dst = src[keep], dst[keep]
            by = np.argsort(dst, kind="stable")
            src, dst = src[by], dst[by]
            target, first, count = np.unique(dst, return_index=True, return_counts=True)
            extra = np.full((len(target), int(count.max()) if len(count) else 0), -1, dtype=np.int64)
            extra[np.repeat(np.arange(len(target)), count), np.arange(len(dst)) - np.repeat(first, count)] = src
            both = _distinct(np.concatenate((graph[target], extra), axis=1))
            size = (both >= 0).sum(axis=1)
            few = size <= degree
            packed = -np.sort(-both, axis=1)[:, :degree]
            graph[target[few], : packed.shape[1]] = packed[few]
            if (~few).any():
                graph[target[~few]] = _prune(x, target[~few], both[~few], degree, relaxed)
    return graph, entries


def _distinct(ids: np.ndarray) -> np.ndarray:
    """Each row's ids once, repeats turned to -1."""
    out = np.sort(ids, axis=1)
    out[:, 1:][out[:, 1:] == out[:, :-1]] = -1
    return out


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id long, v array<double>) of the rows that take part: vectors not null, not empty or zero, all components finite."""
    v = F.col("embedding").cast("array<double>")
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return base.where(fine & F.exists("v", lambda c: c != 0))


def build_index(vectors: DataFrame, shard_vectors: int = SHARD_VECTORS) -> DataFrame:
    """(shard, dim, n, vectors, ids, graph, entries): one row of binary columns for each shard of distinct vectors.

    Equal vectors are one node, with their NEIGHBOURS + 1 least ids: a search
    returns the least ids among equals, so no other id could ever be returned.
    Nodes are dealt by the hash of the vector, so shards are even whatever
    repeats; vectors of other lengths get shards of their own.
    """
    first = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))  # cut to the limit in each task before the shuffle
    least = vectors.distinct().withColumn("nth", first).where(F.col("nth") <= NEIGHBOURS + 1)
    nodes = least.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    nodes = materialize(nodes, "nodes")
    shards = max(1, -(-nodes.count() // shard_vectors))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(group["v"].to_numpy())
        ids = np.full((len(x), NEIGHBOURS + 1), -1, dtype=np.int64)
        for i, own in enumerate(group["ids"]):
            ids[i, : len(own)] = own
        graph, entries = build_graph(x * _unit(x))
        return pd.DataFrame({"shard": [int(group["shard"].iloc[0])], "dim": [x.shape[1]], "n": [len(x)], "vectors": [x.tobytes()], "ids": [ids.tobytes()], "graph": [graph.tobytes()], "entries": [entries.astype(np.int64).tobytes()]})

    dealt = nodes.select("v", "ids", F.size("v").alias("dim"), F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int").alias("shard"))
    return materialize(dealt.groupBy("shard", "dim").applyInPandas(run, "shard int, dim int, n int, vectors binary, ids binary, graph binary, entries binary"), "index")


def search(index: DataFrame, queries: DataFrame, k: int = NEIGHBOURS, beam: int = SEARCH_BEAM) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` (10 at most) nearest found for each query (vec_id, v), other than itself.

    Queries go in blocks of fixed size to every shard's graph, all in double
    precision; the beam is measured on the original vectors, and the best of
    all shards are kept, ties to the smaller id. Repeated query rows ask once. A
    query id with several vectors asks with each, a candidate id with several
    counts once, at its least distance. Queries cost one search a shard each.

    A shard and a block meet by a merge join: Spark rates a block's copies for
    all shards as one row, and would send them all to the driver. Pairs go to
    Python a few at a time, as each holds a whole shard.
    """
    if k > NEIGHBOURS:
        raise ValueError(f"k must be {NEIGHBOURS} at most")
    queries = materialize(queries.select("vec_id", "v").distinct(), "queries")
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    shards = (index.agg(F.max("shard")).first()[0] or 0) + 1
    dealt = queries.select("vec_id", "v", F.size("v").alias("dim"), F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).alias("block"))
    grouped = dealt.groupBy("dim", "block").agg(F.collect_list(F.struct("vec_id", "v")).alias("q"))
    asked = grouped.select("dim", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.col("q.vec_id").alias("query_ids"), F.flatten("q.v").alias("query_vectors"))
    pairs = asked.hint("merge").join(index, ["shard", "dim"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                dim, n = row["dim"], row["n"]
                x = np.frombuffer(row["vectors"]).reshape(n, dim)
                ids = np.frombuffer(row["ids"], dtype=np.int64).reshape(n, -1)
                graph = np.frombuffer(row["graph"], dtype=np.int32).reshape(n, -1)
                unit = _unit(x)
                low = x * unit
                mine, q = np.array(row["query_ids"], dtype=np.int64), np.array(row["query_vectors"]).reshape(-1, dim)
                for a in range(0, len(q), 256):
                    found, _ = beam_search(low, graph, np.frombuffer(row["entries"], dtype=np.int64), np.clip(q[a : a + 256] * unit, -1e150, 1e150), beam)
                    exact = _lengths(x[np.maximum(found, 0)] - q[a : a + 256, None, :])
                    who = ids[np.maximum(found, 0)]
                    good = (who >= 0) & (found >= 0)[:, :, None] & (who != mine[a : a + 256, None, None])
                    r, c, e = np.nonzero(good)
                    d, v = exact[r, c], who[r, c, e]
                    order = np.lexsort((v, d, r))
                    r, d, v = r[order], d[order], v[order]
                    again = np.lexsort((np.arange(len(v)), v, r))  # an id with several vectors counts at its nearest
                    once = np.ones(len(v), dtype=bool)
                    once[again[1:]] = (v[again[1:]] != v[again[:-1]]) | (r[again[1:]] != r[again[:-1]])
                    r, d, v = r[once], d[once], v[once]
                    nth = np.arange(len(r)) - np.searchsorted(r, r)
                    keep = nth < k
                    yield pa.RecordBatch.from_arrays([pa.array(mine[a : a + 256][r[keep]]), pa.array(v[keep]), pa.array(d[keep])], ["query_id", "vec_id", "score"])

    pairs = pairs.select("shard", "dim", "n", "vectors", "ids", "graph", "entries", "query_ids", "query_vectors")
    found = materialize(pairs.mapInArrow(run, "query_id long, vec_id long, score double"), "found")
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", nth).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
