"""Deterministic batch plans for training loops, and the batches themselves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polyatlas.operators.order import places


def assign_groups(groups: DataFrame, workers: int) -> DataFrame:
    """(grp, worker): the largest group first, each to the worker with the fewest cells so far.

    Only (grp, n) comes to the driver, a row for each group of cells, and only
    if there are several workers.
    """
    if workers <= 1:
        return groups.select("grp", F.lit(0).alias("worker"))
    loads = [0] * workers
    placed = []
    for grp, n in sorted(((r["grp"], r["n"]) for r in groups.select("grp", "n").collect()), key=lambda x: (-x[1], str(x[0]).zfill(20))):
        w = loads.index(min(loads))
        loads[w] += n
        placed.append((grp, w))
    return groups.sparkSession.createDataFrame(placed, f"grp {groups.schema['grp'].dataType.simpleString()}, worker int")


def shuffle_key(uid: Column, seed: int, epoch: int) -> Column:
    """A reproducible random order that any engine can compute."""
    return F.md5(F.concat_ws(":", uid.cast("string"), F.lit(str(seed + epoch))))


def _loads(sizes: DataFrame, dealt: DataFrame, batch_size: int, drop_last: bool) -> list[int]:
    """Batches of each worker, by its number; one row a worker comes to the driver."""
    per = F.floor(F.col("n") / batch_size) if drop_last else F.ceil(F.col("n") / batch_size)
    rows = sizes.join(dealt, "grp").groupBy("worker").agg(F.sum("n").alias("n")).select("worker", per.cast("long").alias("b")).collect()
    loads = {r["worker"]: r["b"] for r in rows}
    return [loads.get(w, 0) for w in range(max(loads, default=-1) + 1)]


def batch_plan(cells: DataFrame, batch_size: int = 1024, shuffle: bool = True, seed: int = 0, epoch: int = 0, drop_last: bool = False, workers: int = 1) -> DataFrame:
    """(uid, grp, worker, ordinal, worker_batch, batch) of cells (uid, grp).

    Groups are dealt to workers; a worker's cells are shuffled by a hash of uid
    and seed + epoch, or kept in order of group and uid. Batches count in turns
    over the workers. drop_last leaves out a worker's short batch. Places within
    a worker come from ranges of the order and their totals, so no task sorts a
    whole worker, and a batch's number from the workers' loads, so none counts
    all batches.
    """
    if batch_size < 1:
        raise ValueError("batch_size must be positive")
    sizes = cells.groupBy("grp").agg(F.count("*").alias("n"))
    dealt = assign_groups(sizes, workers)
    loads = _loads(sizes, dealt, batch_size, drop_last)
    keyed = (cells.select("uid", "grp", F.lit(0).alias("worker")) if workers <= 1 else cells.select("uid", "grp").join(F.broadcast(dealt), "grp")).withColumn("_k", shuffle_key(F.col("uid"), seed, epoch))
    placed = places(keyed, ["worker", "_k", "uid"] if shuffle else ["worker", "grp", "uid"], "_place")
    if workers > 1:
        first = keyed.groupBy("worker").agg(F.count("*").alias("_n"))
        first = first.select("worker", (F.sum("_n").over(Window.orderBy("worker")) - F.col("_n")).alias("_first"))
        placed = placed.join(F.broadcast(first), "worker")
    else:
        placed = placed.withColumn("_first", F.lit(0))
    placed = placed.withColumn("ordinal", F.col("_place") - F.col("_first")).withColumn("worker_batch", F.floor(F.col("ordinal") / batch_size))
    b, w = F.col("worker_batch"), F.col("worker")
    load = F.array(*(F.lit(x).cast("long") for x in loads or [0]))
    if drop_last:
        placed = placed.where(b < F.get(load, w))
    # whole turns before this one, then the workers ahead in this turn
    before = F.aggregate(load, F.lit(0).cast("long"), lambda acc, x: acc + F.least(x, b))
    ahead = F.aggregate(F.slice(load, F.lit(1), w), F.lit(0).cast("long"), lambda acc, x: acc + F.when(x > b, 1).otherwise(0))
    return placed.select("uid", "grp", "worker", "ordinal", "worker_batch", (before + ahead).alias("batch"))


def plan_length(cells: DataFrame, batch_size: int, drop_last: bool = False, workers: int = 1) -> int:
    """Number of batches of an epoch."""
    sizes = cells.groupBy("grp").agg(F.count("*").alias("n"))
    return sum(_loads(sizes, assign_groups(sizes, workers), batch_size, drop_last))


def group_ids(cells: DataFrame) -> DataFrame:
    """(grp, group_id) of cells (grp), numbered from 0 in order of grp; a cell without a group has none."""
    names = cells.where("grp is not null").select("grp").distinct()
    return names.select("grp", (F.row_number().over(Window.orderBy("grp")) - 1).alias("group_id"))


def dense_rows(batches: DataFrame, n_features: int) -> DataFrame:
    """(batch, uid, values array<double>): the rows of ``sparse_batches`` over all features, zero where there is no value."""
    rows = batches.select("batch", F.posexplode("uids").alias("i", "uid"), "offsets", "indices", "values")
    at, end = F.get("offsets", F.col("i")), F.get("offsets", F.col("i") + 1)
    size = (end - at).cast("int")
    entries = F.arrays_zip(F.slice("indices", (at + 1).cast("int"), size).alias("k"), F.slice("values", (at + 1).cast("int"), size).alias("v"))
    filled = rows.withColumn("m", F.map_from_entries(entries))
    return filled.select("batch", "uid", F.transform(F.sequence(F.lit(0).cast("long"), F.lit(n_features - 1).cast("long")), lambda g: F.coalesce(F.element_at("m", g).cast("double"), F.lit(0.0))).alias("values"))


def sparse_batches(plan: DataFrame, values: DataFrame, layer: str) -> DataFrame:
    """(batch, uids, offsets, indices, values): each batch's rows in plan order as flat compressed rows.

    ``values`` has (uid, global_index, layer); a cell without values is an empty row.
    """
    rows = values.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct(F.col("global_index").alias("i"), F.col(layer).alias("v")))).alias("r"))
    full = plan.join(rows, "uid", "left").withColumn("r", F.coalesce("r", F.array().cast(rows.schema["r"].dataType)))
    whole = full.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("ordinal", "uid", "r"))).alias("c"))
    flat = F.flatten(F.transform("c", lambda x: x["r"]))
    sizes = F.aggregate("c", F.array(F.lit(0).cast("long")), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + F.size(x["r"]))))
    return whole.select("batch", F.transform("c", lambda x: x["uid"]).alias("uids"), sizes.alias("offsets"), F.transform(flat, lambda x: x["i"]).alias("indices"), F.transform(flat, lambda x: x["v"]).alias("values"))


def dense_batches(plan: DataFrame, rows: DataFrame) -> DataFrame:
    """(batch, uids, values array of arrays): each batch's rows (uid, values) in plan order; cells without a row fall out."""
    whole = plan.join(rows, "uid").groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("ordinal", "uid", "values"))).alias("c"))
    return whole.select("batch", F.transform("c", lambda x: x["uid"]).alias("uids"), F.transform("c", lambda x: x["values"]).alias("values"))
