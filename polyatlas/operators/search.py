"""Vector and text search by plain aggregation."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
FUSION = 60


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def distance(a: Column, b: Column, metric: str = "l2") -> Column:
    """l2, cosine (one minus the similarity) or dot (negated product), in double precision."""
    if metric == "l2":
        return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))
    if metric == "cosine":
        return 1 - _dot(a, b) / (F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b)))
    if metric == "dot":
        return -_dot(a, b)
    raise ValueError("metric must be l2, cosine or dot")


def nearest(df: DataFrame, column: str, query: Sequence[float], k: int, key: str, metric: str = "l2") -> DataFrame:
    """``df`` plus distance: the ``k`` nearest rows, exactly, ties by ``key``; each task keeps k rows."""
    vector = F.lit([float(x) for x in query])
    return df.withColumn("distance", distance(F.col(column), vector, metric)).orderBy("distance", key).limit(k)


def nearest_each(df: DataFrame, column: str, key: str, queries: DataFrame, k: int, metric: str = "l2", chunk: int = 4096, block: int = 256) -> DataFrame:
    """(query, rank, ``key``, distance): the ``k`` nearest rows for each query (query, vector), exactly, ties by ``key``; a row isn't its own neighbour.

    Rows are dealt by hash into chunks and queries into blocks of bounded size;
    each block meets each chunk once, where only its k best leave the task.
    Null vectors, and those of another length than the query's, take no part.
    """
    if metric not in ("l2", "cosine", "dot"):
        raise ValueError("metric must be l2, cosine or dot")
    rows = df.select(F.col(key).alias("id"), F.col(column).cast("array<double>").alias("v")).where("id is not null and v is not null")
    asked = queries.select(F.col("query").alias("id"), F.col("vector").cast("array<double>").alias("v")).where("id is not null and v is not null")

    def packed(part: DataFrame, size: int) -> DataFrame:
        n = max(1, -(-part.count() // size))
        dealt = part.groupBy(F.size("v").alias("dim"), F.pmod(F.xxhash64("id", "v"), F.lit(n)).alias("place"))
        return dealt.agg(F.collect_list(F.struct("id", "v")).alias("r")).select("dim", "place", F.col("r.id").alias("ids"), F.flatten("r.v").alias("flat"))

    both = packed(rows, chunk).select("dim", F.col("ids").alias("row_ids"), F.col("flat").alias("row_flat")).join(packed(asked, block).select("dim", "ids", "flat"), "dim")
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                x, q = (np.array(row[c]).reshape(-1, row["dim"]) for c in ("row_flat", "flat"))
                ids, mine = pa.array(row["row_ids"]), row["ids"]
                order = np.argsort(np.array(row["row_ids"]), kind="stable")
                for i, name in enumerate(mine):
                    if metric == "l2":
                        d = np.sqrt(((x - q[i]) ** 2).sum(axis=1))
                    elif metric == "dot":
                        d = -(x * q[i]).sum(axis=1)
                    else:
                        with np.errstate(invalid="ignore", divide="ignore"):
                            d = 1 - (x * q[i]).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((q[i] * q[i]).sum()))
                    by = order[np.argsort(d[order], kind="stable")]
                    best = [j for j in by[: k + 1].tolist() if row["row_ids"][j] != name][:k] if len(set(row["row_ids"])) == len(by) else [j for j in by.tolist() if row["row_ids"][j] != name][:k]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(best), type=ids.type), ids.take(pa.array(best, type=pa.int64())), pa.array(d[best])], ["query", "id", "distance"])

    found = both.select("dim", "row_ids", "row_flat", "ids", "flat").mapInArrow(run, f"query {kind}, id {kind}, distance double")
    nth = F.row_number().over(Window.partitionBy("query").orderBy("distance", "id"))
    return found.withColumn("rank", nth).where(F.col("rank") <= k).select("query", "rank", F.col("id").alias(key), "distance")


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def bm25(queries: DataFrame, docs: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """(query, doc, score) of all documents (doc, text) that share a word with a query (query, text).

    Only the words of the queries are counted in the documents, before any
    shuffle; document lengths come from the same pass.
    """
    asked = queries.select("query", F.explode(F.array_distinct(tokens(F.col("text")))).alias("word"))
    sized = docs.select("doc", tokens(F.col("text")).alias("ws")).withColumn("n", F.size("ws"))
    total = sized.agg(F.count("*").alias("docs"), F.avg("n").alias("mean"))
    found = sized.select("doc", "n", F.explode("ws").alias("word")).join(asked.select("word").distinct(), "word", "left_semi").groupBy("doc", "n", "word").agg(F.count("*").alias("tf"))
    rarity = found.groupBy("word").agg(F.count("*").alias("df"))
    scored = found.join(rarity, "word").join(F.broadcast(total), F.lit(True))
    weight = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("n") / F.col("mean")))
    return asked.join(scored.select("word", "doc", weight.alias("w")), "word").groupBy("query", "doc").agg(F.sum("w").alias("score"))


def fuse(vector_hits: DataFrame, text_hits: DataFrame, constant: int = FUSION) -> DataFrame:
    """(key, score): reciprocal-rank fusion of (key, distance) and (key, score) hits."""
    a = vector_hits.select("key", (1 / (constant + F.row_number().over(Window.orderBy("distance", "key")))).alias("s"))
    b = text_hits.select("key", (1 / (constant + F.row_number().over(Window.orderBy(F.desc("score"), "key")))).alias("s"))
    return a.union(b).groupBy("key").agg(F.sum("s").alias("score"))
