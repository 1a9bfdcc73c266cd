"""The fluent query over one version of an atlas."""

from __future__ import annotations

import warnings
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from polyatlas.operators import batches, intervals, matrix, schema, search
from polyatlas.operators import dex as differences
from polyatlas.operators.order import places


#: Local indexes of pinned features that go into a scan's condition; more are joined.
LOCAL_INDEXES = 1000


@dataclass(frozen=True)
class MatrixResult:
    """obs (uid, ...), var (global_index, feature_uid, ...) and x (uid, global_index, layers...), all lazy."""

    obs: DataFrame
    var: DataFrame | None
    x: DataFrame | None
    layers: tuple[str, ...] = ()


@dataclass(frozen=True)
class MultimodalResult:
    """All selected cells, what each present modality holds, and a boolean column for each in ``present``."""

    obs: DataFrame
    mod: Mapping[str, object]
    present: DataFrame

    def __getitem__(self, space: str):
        return self.mod[space]

    def to_mudata(self) -> dict[str, MatrixResult]:
        """The modalities that are matrices, by space; others are left out with a warning."""
        for space, held in self.mod.items():
            if not isinstance(held, MatrixResult):
                warnings.warn(f"{space} has no matrix and is left out", stacklevel=2)
        return {s: held for s, held in self.mod.items() if isinstance(held, MatrixResult)}

    def __contains__(self, space: str) -> bool:
        return space in self.mod

    def __repr__(self) -> str:
        return f"MultimodalResult({', '.join(self.mod)})"


@dataclass(frozen=True)
class MultimodalDataset:
    """A batch plan (uid, grp, worker, ordinal, worker_batch, batch, a boolean for each space, metadata) and the batches of each space's present cells."""

    plan: DataFrame
    batches: Mapping[str, DataFrame | None]

    def groups(self) -> DataFrame:
        """(uid, grp) in the order of the plan; the greatest number is that of cells without the first space."""
        return self.plan.select("uid", "grp", "worker", "ordinal").orderBy("worker", "ordinal").select("uid", "grp")

    def n_cells(self) -> int:
        return self.plan.count()

    def dense(self, space: str, n_features: int) -> DataFrame:
        """(batch, uid, values): the rows of a space, those of a sparse one filled with zeros."""
        held = self.batches[space]
        return batches.dense_rows(held, n_features) if "offsets" in held.columns else held.select("batch", F.inline(F.arrays_zip("uids", "values"))).withColumnRenamed("uids", "uid")


@dataclass(frozen=True)
class AtlasVersion:
    """Tables of one version: cells, and by space registries, layouts and values."""

    cells: DataFrame
    registries: Mapping[str, DataFrame] = field(default_factory=dict)
    layouts: Mapping[str, DataFrame] = field(default_factory=dict)
    values: Mapping[str, DataFrame] = field(default_factory=dict)
    datasets: DataFrame | None = None
    version: int | None = None
    #: By space, values kept in order of feature, and the groups that are in them whole.
    by_feature: Mapping[str, tuple[DataFrame, tuple[str, ...]]] = field(default_factory=dict)

    def schemas(self) -> dict[str, str]:
        """The columns of every table, as DDL."""
        tables = {"cells": self.cells, "datasets": self.datasets}
        for kind, held in (("registry", self.registries), ("layouts", self.layouts), ("values", self.values)):
            tables |= {f"{s}_{kind}": df for s, df in held.items()}
        return {n: ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema) for n, df in tables.items() if df is not None}

    def chromosomes(self, space: str) -> DataFrame:
        """(global_index, chrom) of an interval space in order of global index: the registry's names, or those of its fragments, numbered by name."""
        if space in self.registries:
            return self.registries[space].select("global_index", F.col("uid").alias("chrom")).orderBy("global_index")
        return intervals.joint_chromosomes(self.values[space]).select(F.col("global_chrom").alias("global_index"), "chrom").orderBy("global_index")

    def query(self) -> AtlasQuery:
        return AtlasQuery(self)

    def list_datasets(self) -> DataFrame:
        return self.datasets

    def feature_registry(self, space: str) -> DataFrame:
        if space not in self.registries:
            raise KeyError(f"{space} has no feature registry")
        return self.registries[space]

    def join_feature_metadata(self, df: DataFrame, space: str, columns: Sequence[str], on: str = "feature") -> DataFrame:
        """``df`` with columns of the registry, null where a feature is unknown."""
        registry = self.feature_registry(space)
        free = [c for c in registry.columns if c not in ("uid", "global_index")]
        if unknown := [c for c in columns if c not in free]:
            raise ValueError(f"no registry columns {unknown}; there are {free}")
        return df.join(registry.select(F.col("uid").alias("_uid"), *columns), F.col(on) == F.col("_uid"), "left").drop("_uid")

    def feature_layout(self, space: str, grp) -> DataFrame:
        """(local_index, feature_uid, global_index) of one group in its own order."""
        return self.layouts[space].where(F.col("grp") == F.lit(grp)).select("local_index", "feature_uid", "global_index").orderBy("local_index")

    def find_datasets_with_features(self, uids: Sequence, space: str) -> DataFrame:
        """(global_feature_uid, dataset columns) of the datasets whose layout has a feature."""
        hit = self.layouts[space].where(F.col("feature_uid").isin(*uids)).select(F.col("feature_uid").alias("global_feature_uid"), "grp").distinct()
        return hit.join(self.datasets, "grp").drop("layout_uid")


@dataclass(frozen=True)
class AtlasQuery:
    """Each method gives a changed copy; nothing runs before a terminal's result is used."""

    atlas: AtlasVersion
    _where: str | Column | None = None
    _select: tuple[str, ...] | None = None
    _limit: int | None = None
    _balanced: tuple[int, str] | None = None
    _spaces: tuple[str, ...] | None = None
    _layers: Mapping[str, tuple[str, ...]] = field(default_factory=dict)
    _features: Mapping[str, tuple] = field(default_factory=dict)
    _join: str = matrix.UNION
    _search: tuple | None = None

    def where(self, condition: str | Column) -> AtlasQuery:
        """A later condition replaces an earlier one."""
        return replace(self, _where=condition)

    def select(self, columns: list[str]) -> AtlasQuery:
        if not isinstance(columns, list):
            raise ValueError("select takes a list of columns")
        return replace(self, _select=tuple(dict.fromkeys(columns)))

    def limit(self, n: int) -> AtlasQuery:
        """The first ``n`` cells by uid."""
        if self._balanced:
            raise ValueError("limit and balanced_limit exclude each other")
        return replace(self, _limit=n)

    def balanced_limit(self, n: int, column: str) -> AtlasQuery:
        """``n`` divided by the number of values of ``column``, null included; null itself returns no cells."""
        if self._limit is not None:
            raise ValueError("limit and balanced_limit exclude each other")
        return replace(self, _balanced=(n, column))

    def search(self, query: str | Sequence[float] | None = None, *, vector: Sequence[float] | None = None, vector_column: str | None = None, text: str | None = None, text_column: str | Sequence[str] | None = None, k: int = 10, metric: str = "l2", prefilter: bool = False, query_type: str = "auto") -> AtlasQuery:
        """The ``k`` cells nearest to a vector, best for a text, or both by rank fusion; conditions follow unless ``prefilter``.

        A text is searched in one column or in several as one. ``query_type`` is
        auto, vector, fts or hybrid; any but auto must fit what is given.
        """
        if isinstance(query, str):
            text = query
        elif query is not None:
            vector = query
        if vector is None and text is None:
            raise ValueError("search needs a vector or a text")
        if (vector is not None and vector_column is None) or (text is not None and text_column is None):
            raise ValueError("name the column to search")
        found = "hybrid" if vector is not None and text is not None else "vector" if vector is not None else "fts"
        if query_type not in ("auto", found):
            raise ValueError(f"a search of type {query_type} needs other input than that of {found}")
        if text_column is not None and not isinstance(text_column, str):
            text_column = tuple(text_column)
        return replace(self, _search=(vector, vector_column, text, text_column, k, metric, prefilter))

    def feature_spaces(self, *spaces: str) -> AtlasQuery:
        if unknown := [s for s in spaces if s not in self.pointers(all_=True)]:
            raise ValueError(f"unknown spaces {unknown}; known are {self.pointers(all_=True)}")
        return replace(self, _spaces=tuple(spaces))

    def layers(self, space: str, names: Sequence[str]) -> AtlasQuery:
        return replace(self, _layers={**self._layers, space: tuple(names)})

    def features(self, uids: Sequence, space: str) -> AtlasQuery:
        if space not in self.atlas.registries:
            raise ValueError(f"{space} has no feature registry")
        return replace(self, _features={**self._features, space: tuple(uids)})

    def feature_join(self, join: str) -> AtlasQuery:
        """Checked when the query is built into a plan."""
        return replace(self, _join=join)

    # plan parts

    def pointers(self, all_: bool = False) -> list[str]:
        names = schema.pointer_columns(self.atlas.cells.schema)
        return names if all_ or self._spaces is None else [n for n in names if n in self._spaces]

    def _searched(self, cells: DataFrame) -> DataFrame:
        vector, vector_column, text, text_column, k, metric, _ = self._search
        near = search.nearest(cells, vector_column, vector, k, "uid", metric).select("uid", F.col("distance").alias("_distance")) if vector is not None else None
        asked = cells.sparkSession.createDataFrame([(0, text)], "query int, text string") if text is not None else None
        best = search.bm25(asked, cells.select(F.col("uid").alias("doc"), (F.col(text_column) if isinstance(text_column, str) else F.concat_ws(" ", *text_column)).alias("text"))).orderBy(F.desc("score"), "doc").limit(k).select(F.col("doc").alias("uid"), F.col("score").alias("_score")) if text is not None else None
        if near is not None and best is not None:
            both = search.fuse(near.select(F.col("uid").alias("key"), F.col("_distance").alias("distance")), best.select(F.col("uid").alias("key"), F.col("_score").alias("score")))
            return cells.join(both.orderBy(F.desc("score"), "key").limit(k).select(F.col("key").alias("uid"), F.col("score").alias("_score")), "uid")
        return cells.join(near if near is not None else best, "uid")

    def cells(self) -> DataFrame:
        """The selected cells with all columns."""
        df = self.atlas.cells
        after = self._search is None or self._search[-1]
        if self._where is not None and after:
            df = df.where(self._where)
        if self._search is not None:
            df = self._searched(df)
        if self._where is not None and not after:
            df = df.where(self._where)
        if self._limit is not None:
            df = df.orderBy("uid").limit(self._limit)
        if self._balanced is not None:
            n, column = self._balanced
            groups = df.agg((F.count_distinct(column) + F.max(F.when(F.col(column).isNull(), 1).otherwise(0))).alias("_groups"))
            nth = F.row_number().over(Window.partitionBy(column).orderBy("uid"))
            # the share can't pass n, which lets the window keep n rows a group in each task
            ranked = df.where(F.col(column).isNotNull()).withColumn("_nth", nth).where(F.col("_nth") <= n)
            df = ranked.join(F.broadcast(groups), F.col("_nth") <= F.expr(f"{int(n)} div _groups")).drop("_nth", "_groups")
        return df

    def obs(self) -> DataFrame:
        """Selected cells without pointers and hidden columns."""
        df = self.cells()
        names = [f.name for f in df.schema if f.name not in schema.pointer_columns(df.schema) and not f.name.startswith("_")]
        if self._select is not None:
            names = [n for n in dict.fromkeys(("uid", *self._select)) if n in df.columns]
        return df.select(*names)

    def _present(self, space: str, cells: DataFrame | None = None) -> DataFrame:
        cells = self.cells() if cells is None else cells
        return cells.where(F.col(space).isNotNull()).select("uid", F.col(f"{space}.grp").alias("grp"))

    def _feature_space(self, space: str, cells: DataFrame) -> DataFrame:
        layout, kind = self.atlas.layouts[space], schema.get_space(space).kind
        if space in self._features:
            if self._join != matrix.UNION and kind == schema.SPARSE:
                raise ValueError("pinned features and a feature join exclude each other")
            return matrix.resolve_features(self.atlas.registries[space], self._features[space]).select("global_index")
        return matrix.feature_space(layout, cells, self._join)

    def _values(self, space: str) -> DataFrame:
        """Values of a space; for pinned features those kept in order of feature, by the local indexes wanted, and the plain ones of groups not kept so."""
        values = self.atlas.values[space]
        if space not in self.atlas.by_feature or space not in self._features:
            return values
        kept, groups = self.atlas.by_feature[space]
        wanted = self.atlas.layouts[space].where(F.col("feature_uid").isin(*self._features[space]) & F.col("grp").isin(*groups))
        local = [r[0] for r in wanted.select("local_index").distinct().limit(LOCAL_INDEXES + 1).collect()]
        if len(local) <= LOCAL_INDEXES:  # reaches the scan, so row groups of other features are skipped
            kept = kept.where(F.col("local_index").isin(*local))
        return kept.unionByName(values.where(~F.col("grp").isin(*groups)).select(*kept.columns))

    # terminals

    def to_frame(self) -> DataFrame:
        return self.obs()

    def to_row_ids(self) -> DataFrame:
        """(uid, pointers, row_id): the selected cells that have any space, numbered from 0 in order of uid."""
        cells = self.cells()
        any_ = F.coalesce(*(F.when(F.col(s).isNotNull(), True) for s in self.pointers()), F.lit(False))
        return places(cells.where(any_).select("uid", *self.pointers()), ["uid"], "row_id")

    def count(self, group_by: str | list[str] | None = None) -> int | DataFrame:
        """The number of cells, or (keys, count) in order of the keys, after the limits."""
        if group_by is None:
            return self.cells().select("uid").count()
        keys = [group_by] if isinstance(group_by, str) else list(group_by)
        return self.cells().groupBy(*keys).agg(F.count("*").alias("count")).orderBy(*keys)

    def to_matrix(self, space: str | None = None) -> MatrixResult:
        """The first active space, or the one named. If no cell has it, obs of all cells and no matrix."""
        space = space or self.pointers()[0]
        kind = schema.get_space(space)
        if kind.kind == schema.INTERVAL:
            raise NotImplementedError("intervals have no matrix; count them over ranges")
        layers = kind.check_layers(self._layers.get(space, ()))
        cells = self._present(space)
        features = self._feature_space(space, cells)
        layout, values = self.atlas.layouts[space], self._values(space)
        if kind.reconstruct is not None:
            x = kind.reconstruct(values, cells, layout, features, layers)
        elif kind.kind == schema.SPARSE:
            x = matrix.reconstruct_sparse(values, cells, layout, features, layers)
        else:
            x = matrix.reconstruct_dense(values, cells, layout, features, layers[0])
        registry = self.atlas.registries[space]
        var = registry.join(features, "global_index", "left_semi")
        obs = self.obs()
        if self._is_empty(cells):
            return MatrixResult(obs, None, None, layers)
        return MatrixResult(obs.join(cells.select("uid"), "uid", "left_semi"), var, x, layers)

    @staticmethod
    def _is_empty(cells: DataFrame) -> bool:
        return cells.isEmpty()

    def to_mudata(self) -> dict[str, MatrixResult]:
        """Matrices by space; spaces without one are left out with a warning."""
        out = {}
        for space in self.pointers():
            kind = schema.get_space(space)
            if kind.kind == schema.INTERVAL or not kind.registered:
                warnings.warn(f"{space} has no matrix and is left out", stacklevel=2)
            else:
                out[space] = self.to_matrix(space)
        return out

    def to_multimodal(self) -> MultimodalResult:
        """All cells; a space that no cell has is left out."""
        cells = self.cells()
        mod: dict[str, object] = {}
        for space in self.pointers():
            if self._is_empty(self._present(space, cells)):
                continue
            kind = schema.get_space(space)
            mod[space] = self.to_fragments(space) if kind.kind == schema.INTERVAL else self.to_array(space)[0] if not kind.registered else self.to_matrix(space)
        return MultimodalResult(self.obs(), mod, cells.select("uid", *(F.col(s).isNotNull().alias(s) for s in self.pointers())))

    def to_joint_fragments(self, space: str) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(fragments, cell offsets, chromosomes) of the selected cells over the union of their chromosomes; see ``intervals.joint_fragments``."""
        return intervals.joint_fragments(self.to_fragments(space), self._present(space).select(F.col("uid").alias("cell")))

    def dex(self, space: str, by: str, target: Sequence | None, control, layer: str | None = None, **options) -> DataFrame:
        """``dex.dex`` of the selected cells, grouped by the column ``by``: the targets, or all other values, against the control.

        Only features that every group of cells under comparison measured take
        part, and values are normalised over these.
        """
        cells = self.cells().where(F.col(space).isNotNull() & F.col(by).isNotNull())
        grouped = cells.select("uid", F.col(by).alias("grp"))
        if target is None:
            target = sorted(r[0] for r in grouped.where(F.col("grp") != F.lit(control)).select("grp").distinct().collect())
        chosen = replace(self, _join=matrix.INTERSECTION, _features={k: v for k, v in self._features.items() if k != space})
        chosen = chosen._compared(by, [*target, control]).layers(space, [layer] if layer else [])
        result = chosen.to_matrix(space)
        if result.x is None:
            raise ValueError(f"no cell of the groups has {space}")
        if schema.get_space(space).kind == schema.DENSE:
            order = F.posexplode("values").alias("feature", "value")
            values = result.x.select("uid", order)
        else:
            values = result.x.select("uid", F.col("global_index").alias("feature"), F.col(result.layers[0]).alias("value"))
        return differences.dex(values, grouped, target, control, **options)

    def _compared(self, by: str, groups: Sequence) -> AtlasQuery:
        """The same query over the cells of some values of ``by`` only."""
        cells = self.cells().where(F.col(by).isin(*groups))
        return replace(self, atlas=replace(self.atlas, cells=cells), _where=None, _limit=None, _balanced=None, _search=None)

    def to_fragments(self, space: str) -> DataFrame:
        """Fragments of the selected cells, on the names of their chromosomes."""
        if schema.get_space(space).kind != schema.INTERVAL:
            raise TypeError(f"{space} holds no intervals")
        return self.atlas.values[space].join(self._present(space).select(F.col("uid").alias("cell")), "cell", "left_semi")

    def to_array(self, space: str, layer: str | None = None) -> tuple[DataFrame, DataFrame]:
        """((uid, array), obs) of the cells that have the space; arrays of unequal length raise."""
        layer = layer or schema.get_space(space).check_layers(())[0]
        cells = self._present(space)
        rows = self.atlas.values[space].join(cells, ["uid", "grp"], "left_semi").select("uid", layer)
        if len(matrix.dense_shape_errors(rows, layer).limit(2).collect()) > 1:
            raise ValueError(f"cells of {space} differ in shape")
        return rows, self.obs().join(cells.select("uid"), "uid", "left_semi")

    def to_batches(self, batch_size: int = 1024) -> Iterator[list]:
        """Obs rows in lists of ``batch_size``, fetched partition by partition."""
        batch = []
        for row in self.obs().toLocalIterator(prefetchPartitions=True):
            batch.append(row)
            if len(batch) == batch_size:
                yield batch
                batch = []
        if batch:
            yield batch

    def to_cell_dataset(self, space: str, layer: str | None = None, **plan) -> tuple[DataFrame, DataFrame]:
        """(batch plan, sparse batches) of one space; see ``batches.batch_plan`` for the options."""
        chosen = self.layers(space, [layer]) if layer else self
        result = chosen.to_matrix(space)
        steps = batches.batch_plan(self._present(space), **plan)
        return steps, batches.sparse_batches(steps, result.x, result.layers[0])

    def to_multimodal_dataset(self, spaces: Sequence[str], layers: Mapping[str, str] | None = None, metadata: Sequence[str] = (), **plan) -> MultimodalDataset:
        """A batch plan over all cells by the group of the first space, and the batches of each space.

        Cells without the first space come last, as a group of their own. Layers
        are ``counts`` where a space allows it, else its first required one.
        """
        cells = self.cells()
        numbered = batches.group_ids(cells.select(F.col(f"{spaces[0]}.grp").cast("string").alias("grp")))
        sentinel = numbered.agg(F.count("*").alias("n"))
        own = cells.select("uid", F.col(f"{spaces[0]}.grp").cast("string").alias("grp")).join(numbered, "grp", "left").join(F.broadcast(sentinel), F.lit(True))
        steps = batches.batch_plan(own.select("uid", F.coalesce("group_id", "n").alias("grp")), **plan)
        steps = steps.join(cells.select("uid", *(F.col(s).isNotNull().alias(s) for s in spaces), *metadata), "uid")
        held = {}
        for s in spaces:
            kind = schema.get_space(s)
            layer = (layers or {}).get(s) or ("counts" if "counts" in kind.allowed else kind.check_layers(())[0])
            present = steps.where(F.col(s)).select("uid", "batch", "ordinal")
            if kind.kind == schema.SPARSE:
                x = self.layers(s, [layer]).to_matrix(s).x
                held[s] = None if x is None else batches.sparse_batches(present, x, layer)
            elif kind.kind == schema.DENSE:
                rows = self.layers(s, [layer]).to_matrix(s).x if kind.registered else self.to_array(s, layer)[0].withColumnRenamed(layer, "values")
                held[s] = None if rows is None else batches.dense_batches(present, rows)
        return MultimodalDataset(steps, held)


def pointer(space: str, grp: Column, present: Column) -> Column:
    """A pointer where ``present``, else null."""
    return F.when(present, F.struct(F.lit(space).alias("feature_space"), grp.alias("grp"))).alias(space)


POINTER_TYPE = T.StructType([T.StructField("feature_space", T.StringType()), T.StructField("grp", T.StringType())])
