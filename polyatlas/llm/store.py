"""Written intermediate tables in the folder that all executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_WRITTEN: ContextVar[list[str] | None] = ContextVar("written", default=None)
#: Bytes of a batch of rows on the way to Python; one row may be larger.
BATCH_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder only where that is unset and all runs on one machine, else it raises."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = _LOCAL.setdefault("dir", tempfile.mkdtemp(prefix="polyatlas-"))
    return path.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet and read it back, which cuts the lineage and survives lost executors.

    Python functions in it get their rows in batches of about BATCH_BYTES: the
    engine's own are up to sixteen times as large, in memory once for each task
    on either side and again in what is made of them.
    """
    spark, schema = df.sparkSession, df.schema
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, BATCH_BYTES)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_BATCH, before)
    if (written := _WRITTEN.get()) is not None:
        written.append(path)
    return spark.read.schema(schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Spark removes the shuffle files of plans that nothing refers to only when the driver collects garbage; so let it."""
    gc.collect()
    spark._jvm.System.gc()


@contextmanager
def last_written(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end the tables that ``materialize`` wrote inside, but the last one, and lets Spark clean up their shuffles: for a result that is whole in that one. After an error all stay."""
    token = _WRITTEN.set([])
    try:
        yield
        jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
        for path in _WRITTEN.get()[:-1]:
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(conf).delete(place, True)
        release(spark)
    finally:
        _WRITTEN.reset(token)


def row_key() -> "F.Column":
    """A 128-bit key of a document row, equal for rows of equal doc_id and text, so repeated ids stay apart; null text counts as empty."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    mark = F.when(F.col("doc_id").isNull(), F.lit("-")).otherwise(F.length(name).cast("string"))
    return F.unhex(F.md5(F.concat(mark, F.lit(":"), name, F.coalesce(F.col("text").cast("string"), F.lit("")))))


def unused(columns: list[str], *names: str) -> list[str]:
    """Each of ``names``, with underscores added until no column of ``columns`` has the name in any case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
