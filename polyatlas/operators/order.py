"""Places in a total order, and running sums along it, without one task that sorts everything."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """Sets and gives the checkpoint folder: that in ``spark.checkpoint.dir``; a temporary one only where all runs on one machine, else it raises."""
    context = spark.sparkContext
    if (now := context.getCheckpointDir()) is not None:
        return now
    path = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="polyatlas-")
    context.setCheckpointDir(path)
    return path


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder, so that every use sees the same rows and a lost executor costs no more."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def running_sum(df: DataFrame, order: list[Column | str], value: Column | str, name: str) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` up to and with each row in the order, which should leave few ties.

    Rows are dealt to ranges of the order; sums run within a range and are
    shifted by the totals of the ranges before it, one row each.
    """
    part, before, total = (f"{name}__{x}" for x in ("part", "before", "total"))
    ranged = checkpointed(df.repartitionByRange(*order).withColumn(part, F.spark_partition_id()))
    inside = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = ranged.groupBy(part).agg(F.sum(value).alias(total))
    shift = totals.select(part, (F.sum(total).over(Window.orderBy(part)) - F.col(total)).alias(before))
    # a range is one task's rows already; only the shifts, a row for each range, are sent to all
    out = ranged.withColumn(name, F.sum(value).over(inside)).join(F.broadcast(shift), part)
    return out.withColumn(name, F.col(before) + F.col(name)).drop(part, before)


def places(df: DataFrame, order: list[Column | str], name: str) -> DataFrame:
    """``df`` with ``name``: each row's place in the order, from 0."""
    one = f"{name}__one"
    return running_sum(df.withColumn(one, F.lit(1).cast("long")), order, one, name).withColumn(name, F.col(name) - 1).drop(one)
