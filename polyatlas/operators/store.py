"""Atlas storage: immutable Parquet parts, a log of commits, and published versions.

A table is a list of part folders. Each commit writes new parts first, then a
log entry with all tables' lists under the next number; the entry is created
only if its number is free, so of two writers one retries on the other's state.
Folders that any entry names are never overwritten.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping, Sequence
from datetime import UTC, datetime

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from polyatlas.functions.identity import layout_uid
from polyatlas.operators import matrix, schema
from polyatlas.operators.query import AtlasVersion

LAYOUT = "layout_uid string, local_index bigint, feature_uid {uid}, global_index bigint"


class Files:
    """Small files on any Hadoop file system."""

    def __init__(self, spark: SparkSession, root: str):
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._io, self._charset = jvm.org.apache.commons.io.IOUtils, "UTF-8"
        self._files, self._paths = jvm.java.nio.file.Files, jvm.java.nio.file.Paths
        self._none = spark.sparkContext._gateway.new_array(jvm.java.lang.String, 0)
        self.root = root.rstrip("/")

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._path(f"{self.root}/{name}"))

    def numbers(self, folder: str) -> list[int]:
        path = self._path(f"{self.root}/{folder}")
        if not self.fs.exists(path):
            return []
        return sorted(int(s.getPath().getName().split(".")[0]) for s in self.fs.listStatus(path) if s.getPath().getName()[0].isdigit() and s.getPath().getName().endswith(".json"))

    def read(self, name: str) -> dict:
        stream = self.fs.open(self._path(f"{self.root}/{name}"))
        try:
            return json.loads(self._io.toString(stream, self._charset))
        finally:
            stream.close()

    def create(self, name: str, content: dict) -> bool:
        """Write a whole file under its name; False if the name is taken. Of several writers of one name one succeeds.

        On a local file system a link to the written file takes the name, on one
        with atomic renames that refuse a taken name a rename, elsewhere a
        create without overwrite, which object stores settle when it closes.
        """
        target = self._path(f"{self.root}/{name}")
        self.fs.mkdirs(target.getParent())
        scheme = self.fs.getUri().getScheme()
        if scheme not in ("file", "hdfs", "viewfs"):
            return self._write(target, content)
        temporary = self._path(f"{self.root}/.tmp-{uuid.uuid4().hex}")
        self._write(temporary, content)
        try:
            if scheme == "file":
                local = lambda p: self._paths.get(p.toUri().getPath(), self._none)
                self._files.createLink(local(target), local(temporary))
                return True
            return not self.fs.exists(target) and self.fs.rename(temporary, target)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception.getClass().getName()):
                return False
            raise
        finally:
            self.fs.delete(temporary, False)

    def _write(self, path, content: dict) -> bool:
        try:
            stream = self.fs.create(path, False)
            stream.write(bytearray(json.dumps(content).encode()))
            stream.close()
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception.getClass().getName()):
                return False
            raise
        return True


class Atlas:
    """The working state of an atlas: ingest, maintenance and publication. Queries need a version."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.files = spark, path.rstrip("/"), Files(spark, path)

    @classmethod
    def create(cls, spark: SparkSession, path: str, spaces: Sequence[str], obs: str = "", uid: str = "string", features: Mapping[str, str] | None = None) -> Atlas:
        """A new atlas with typed empty tables; ``obs`` are further cell columns as DDL, ``features`` further registry columns of a space."""
        atlas = cls(spark, path)
        if atlas.files.numbers("log"):
            raise FileExistsError(f"there is an atlas at {path}")
        if not spaces:
            raise TypeError("an atlas needs at least one feature space")
        for s in spaces:
            schema.get_space(s)
        pointers = ", ".join(f"{s} struct<feature_space:string,grp:string>" for s in spaces)
        tables = {"cells": f"uid {uid}, dataset_uid string, {pointers}" + (f", {obs}" if obs else ""), "datasets": "uid string, grp string, feature_space string, n_cells bigint, layout_uid string, created_at string"}
        for s in spaces:
            if schema.get_space(s).registered:
                more = (features or {}).get(s)
                tables |= {f"{s}_registry": f"uid {uid}, global_index bigint" + (f", {more}" if more else ""), f"{s}_layouts": LAYOUT.format(uid=uid)}
        schema.check_cell_schema(T._parse_datatype_string(tables["cells"]))
        atlas.files.create("log/0.json", {"spaces": list(spaces), "uid": uid, "schemas": tables, "tables": {}})
        return atlas

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Atlas:
        atlas = cls(spark, path)
        if not atlas.files.numbers("log"):
            raise FileNotFoundError(f"no atlas at {path}")
        return atlas

    # tables

    def _state(self) -> dict:
        return self.files.read(f"log/{self.files.numbers('log')[-1]}.json")

    def _load(self, state: Mapping, name: str) -> DataFrame:
        ddl = T._parse_datatype_string(state["schemas"][name])
        parts = state["tables"].get(name, [])
        return self.spark.read.schema(ddl).parquet(*(f"{self.path}/{p}" for p in parts)) if parts else self.spark.createDataFrame([], ddl)

    def table(self, name: str) -> DataFrame:
        return self._load(self._state(), name)

    def _write(self, name: str, df: DataFrame) -> str:
        part = f"data/{name}/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{part}")
        return part

    def _commit(self, change: Callable[[dict], dict]) -> None:
        while True:
            number = self.files.numbers("log")[-1]
            if self.files.create(f"log/{number + 1}.json", change(self.files.read(f"log/{number}.json"))):
                return

    def _append(self, frames: Mapping[str, DataFrame], schemas: Mapping[str, str] | None = None) -> None:
        """All tables of one ingest appear together."""
        parts = {n: self._write(n, df) for n, df in frames.items()}

        def change(state: dict) -> dict:
            for n, part in parts.items():
                state["tables"].setdefault(n, []).append(part)
            state["schemas"] |= {n: d for n, d in (schemas or {}).items() if n not in state["schemas"]}
            return state

        self._commit(change)

    def _replace(self, frames: Mapping[str, DataFrame]) -> None:
        before = self._state()["tables"]
        parts = {n: self._write(n, df) for n, df in frames.items()}

        def change(state: dict) -> dict:
            for n, part in parts.items():
                newer = [p for p in state["tables"].get(n, []) if p not in before.get(n, [])]
                state["tables"][n] = [part, *newer]
            return state

        self._commit(change)

    # ingest

    def register_features(self, space: str, features: DataFrame | Sequence) -> int:
        """Add the features (uid, metadata) not registered yet and return how many; rows there are never change.

        Metadata that the registry lacks raises, missing columns become null. Of
        rows of one uid the least by content counts; null uids are left out.
        """
        name = f"{space}_registry"
        registry = self.table(name)
        if not isinstance(features, DataFrame):
            features = self.spark.createDataFrame([(u,) for u in features], f"uid {registry.schema['uid'].dataType.simpleString()}")
        free = [f for f in registry.schema if f.name not in ("uid", "global_index")]
        if extra := [c for c in features.columns if c not in registry.columns]:
            raise ValueError(f"feature columns {extra} aren't in the registry of {space}")
        columns = [(F.col(f.name) if f.name in features.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in free]
        once = features.where("uid is not null").groupBy("uid").agg(F.min(F.struct(*columns)).alias("_m")).select("uid", "_m.*") if free else features.select("uid").where("uid is not null").distinct()
        fresh = once.join(registry.select("uid"), "uid", "left_anti").withColumn("global_index", F.lit(None).cast("long")).select(*registry.columns).persist()
        n = fresh.count()
        if n:
            self._append({name: fresh})
        fresh.unpersist()
        return n

    def add_batch(self, space: str, obs: DataFrame, features: DataFrame | None, values: DataFrame, dataset_uid: str, grp: str | None = None) -> int:
        """Ingest one group of cells and return their number.

        ``obs`` has uid and obs columns, ``features`` (local_index, feature_uid),
        ``values`` (uid, local_index, layers...) without zeros kept, an array a
        layer for dense spaces, or (chrom, start, length) for intervals. Obs
        columns that the atlas lacks raise, missing ones become null.
        """
        return self.add_multimodal_batch({space: (features, values)}, obs, dataset_uid, grp)

    def add_multimodal_batch(self, modalities: Mapping[str, tuple], obs: DataFrame, dataset_uid: str, grp: str | None = None) -> int:
        """Ingest several spaces of the same cells; all point to each sparse or interval space, be their rows empty, and to a dense one if they have an array."""
        state, grp = self._state(), grp or dataset_uid
        cells_schema = T._parse_datatype_string(state["schemas"]["cells"])
        if extra := [c for c in obs.columns if c not in cells_schema.fieldNames()]:
            raise ValueError(f"obs columns {extra} aren't in the atlas")
        n = obs.count()
        if obs.select("uid").distinct().count() != n:
            raise ValueError("obs has repeated uids")
        frames, schemas, cells, layout_of = {}, {}, obs, {}
        for space, (features, values) in modalities.items():
            kind = schema.get_space(space)
            layers = [c for c in values.columns if c not in ("uid", "local_index", "chrom", "start", "length")]
            if kind.kind != schema.INTERVAL:
                kind.check_layers(layers)
                if errors := schema.group_errors(kind, values):
                    raise ValueError("; ".join(errors))
            kept = values.where(" or ".join(f"{x} <> 0" for x in layers)) if kind.kind == schema.SPARSE else values
            kept = kept.withColumn("grp", F.lit(grp))
            if f"{space}_values" in state["schemas"]:  # later groups take the types of the first
                known = T._parse_datatype_string(state["schemas"][f"{space}_values"])
                if extra := [c for c in kept.columns if c not in known.fieldNames()]:
                    raise ValueError(f"{space}: columns {extra} aren't in the stored values")
                kept = schema.align_obs(kept, known)
            schemas[f"{space}_values"] = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema)
            frames[f"{space}_values"] = kept
            if kind.registered and features is not None:
                known = self._load(state, f"{space}_registry")
                rows = features.join(known.select(F.col("uid").alias("feature_uid"), "global_index"), "feature_uid", "left")
                checks = rows.join(known.select(F.col("uid").alias("feature_uid"), F.lit(True).alias("ok")), "feature_uid", "left").agg(F.count("*").alias("n"), F.count_distinct("feature_uid").alias("d"), F.count_if(F.col("ok").isNull()).alias("missing")).first()
                if checks["n"] != checks["d"]:
                    raise ValueError(f"{space}: repeated feature uids")
                if checks["missing"]:
                    raise ValueError(f"{space}: {checks['missing']} features aren't registered")
                uid = layout_uid(F.transform(F.array_sort(F.collect_list(F.struct("local_index", F.col("feature_uid").cast("string").alias("u")))), lambda x: x["u"]))
                layout_of[space] = features.agg(uid.alias("u")).first()["u"]
                if self._load(state, f"{space}_layouts").where(F.col("layout_uid") == layout_of[space]).isEmpty():
                    frames[f"{space}_layouts"] = rows.select(F.lit(layout_of[space]).alias("layout_uid"), F.col("local_index").cast("long"), "feature_uid", "global_index")
            points = F.struct(F.lit(space).alias("feature_space"), F.lit(grp).alias("grp"))
            if kind.kind == schema.DENSE:
                owners = values.select(F.col("uid")).distinct().withColumn("_has", F.lit(True))
                cells = cells.join(owners, "uid", "left").withColumn(space, F.when(F.col("_has"), points)).drop("_has")
            else:
                cells = cells.withColumn(space, points)
        cells = schema.align_obs(cells.withColumn("dataset_uid", F.lit(dataset_uid)), cells_schema)
        stamp = datetime.now(UTC).isoformat()
        rows = [(dataset_uid, grp, s, n, layout_of.get(s), stamp) for s in modalities]
        self._append({"cells": cells, "datasets": self.spark.createDataFrame(rows, state["schemas"]["datasets"]), **frames}, schemas)
        return n

    def write_feature_layout(self, space: str, features: DataFrame) -> str:
        """Register the layout of (local_index, feature_uid) unless it is there, and return its uid."""
        state = self._state()
        ordered = F.transform(F.array_sort(F.collect_list(F.struct("local_index", F.col("feature_uid").cast("string").alias("u")))), lambda x: x["u"])
        uid = features.agg(layout_uid(ordered).alias("u")).first()["u"]
        if self._load(state, f"{space}_layouts").where(F.col("layout_uid") == uid).isEmpty():
            known = self._load(state, f"{space}_registry").select(F.col("uid").alias("feature_uid"), "global_index")
            self._append({f"{space}_layouts": features.join(known, "feature_uid", "left").select(F.lit(uid).alias("layout_uid"), F.col("local_index").cast("long"), "feature_uid", "global_index")})
        return uid

    # maintenance

    def _spaces(self, state: Mapping) -> list[str]:
        return [s for s in state["spaces"] if f"{s}_registry" in state["schemas"]]

    def optimize(self) -> None:
        """Number new features, fill layouts with the numbers, and compact every table of several parts into one.

        Cells, values and fragments are rewritten by group, in order of their
        keys, in files as large as the session's partitions; what other writers
        add meanwhile stays beside it. Parts that versions name are kept.
        """
        state = self._state()
        for s in self._spaces(state):
            self._replace({f"{s}_registry": matrix.reindex(self._load(state, f"{s}_registry"))})
            now = self._state()
            self._replace({f"{s}_layouts": matrix.sync_layout(self._load(now, f"{s}_layouts"), self._load(now, f"{s}_registry"))})
        self._replace({"datasets": self._load(self._state(), "datasets").coalesce(1)})
        for name in [n for n, parts in state["tables"].items() if len(parts) > 1 and not n.endswith(("_registry", "_layouts")) and n != "datasets"]:
            whole = self._load(self._state(), name)
            keys = [c for c in ("grp", "dataset_uid", "uid") if c in whole.columns][:2]
            self._replace({name: whole.repartitionByRange(*keys).sortWithinPartitions(*keys)})

    def add_csc(self, space: str, groups: Sequence[str] | None = None) -> int:
        """Keep the values of groups, or of all, a second time in order of feature, and return how many there are.

        Only a sparse space can; values of cells that the cell table lacks or has
        twice, and repeated (cell, feature) pairs, raise. Queries for pinned
        features read this copy for its groups, and the plain table for others.
        """
        if schema.get_space(space).kind != schema.SPARSE:
            raise TypeError(f"{space} isn't sparse")
        state = self._state()
        values = self._load(state, f"{space}_values")
        groups = sorted(groups if groups is not None else [r[0] for r in values.select("grp").distinct().collect()])
        own = values.where(F.col("grp").isin(*groups))
        cells = self._load(state, "cells").where(F.col(f"{space}.grp").isin(*groups)).groupBy("uid").agg(F.count("*").alias("times"))
        if not cells.where("times > 1").isEmpty():
            raise ValueError(f"{space}: repeated cells")
        if not own.join(cells, "uid", "left_anti").isEmpty():
            raise ValueError(f"{space}: values of unknown cells")
        if not own.groupBy("uid", "local_index").agg(F.count("*").alias("times")).where("times > 1").isEmpty():
            raise ValueError(f"{space}: repeated values of a cell and feature")
        n = own.count()
        name = f"{space}_csc"
        part = self._write(name, own.repartitionByRange("local_index", "grp").sortWithinPartitions("local_index", "grp", "uid"))

        def change(now: dict) -> dict:
            now["schemas"][name] = state["schemas"][f"{space}_values"]
            now["tables"][name] = [part]
            now.setdefault("csc", {})[space] = groups
            return now

        self._commit(change)
        return n

    def add_coo_batch(self, space: str, path: str, obs: DataFrame, var: DataFrame, dataset_uid: str, n_cells: int | None = None, n_features: int | None = None, layer: str | None = None, grp: str | None = None, **reading) -> int:
        """Ingest a file of triplets: ``obs`` (row, uid, columns) and ``var`` (local_index, feature_uid) name its rows and columns.

        Their sizes must be ``n_cells`` and ``n_features`` where these are given,
        and every triplet must lie inside; cells without triplets have none. See
        ``sources.read_coo`` for the format.
        """
        from polyatlas.sources.files import read_coo

        layer = layer or schema.get_space(space).check_layers(())[0]
        for name, table, want, key in (("obs", obs, n_cells, "row"), ("var", var, n_features, "local_index")):
            found = table.agg(F.count("*").alias("n"), F.count_distinct(key).alias("d"), F.min(key).alias("a"), F.max(key).alias("b")).first()
            if want is not None and found["n"] != want:
                raise ValueError(f"{name} has {found['n']} rows, not {want}")
            if found["n"] and (found["d"] != found["n"] or found["a"] != 0 or found["b"] != found["n"] - 1):
                raise ValueError(f"{name}: {key} must number its rows from 0")
        triplets = read_coo(self.spark, path, **reading)
        outside = triplets.join(obs.select("row"), "row", "left_anti").isEmpty() and triplets.join(var.select("local_index"), "local_index", "left_anti").isEmpty()
        if not outside:
            raise ValueError("triplets outside the rows of obs or var")
        values = triplets.join(obs.select("row", "uid"), "row").select("uid", "local_index", F.col("value").alias(layer))
        return self.add_batch(space, obs.drop("row"), var.select("local_index", "feature_uid"), values, dataset_uid, grp)

    def add_from_matrix(self, space: str, source, dataset_uid: str, layer: str | None = None, grp: str | None = None) -> int:
        """Ingest an object with ``obs`` and ``var`` (pandas tables with the uids as index) and ``X`` (an array, or a sparse matrix with ``tocoo``), as annotated matrices are.

        What is in the driver's memory already is sent on as Arrow tables.
        """
        import numpy as np
        import pandas as pd

        kind = schema.get_space(space)
        layer = layer or kind.check_layers(())[0]
        obs = source.obs.rename_axis("uid").reset_index()
        var = pd.DataFrame({"local_index": np.arange(len(source.var), dtype=np.int64), "feature_uid": source.var.index})
        uids = obs["uid"].to_numpy()
        if kind.kind == schema.DENSE:
            rows = source.X.toarray() if hasattr(source.X, "toarray") else np.asarray(source.X)
            values = pd.DataFrame({"uid": uids, layer: [r.tolist() for r in rows.astype(float)]})
        else:
            x = source.X.tocoo() if hasattr(source.X, "tocoo") else None
            row, col = (x.row, x.col) if x is not None else np.nonzero(np.asarray(source.X))
            values = pd.DataFrame({"uid": uids[row], "local_index": col.astype(np.int64), layer: x.data if x is not None else np.asarray(source.X)[row, col]})
        make = self.spark.createDataFrame
        return self.add_batch(space, make(obs), make(var), make(values), dataset_uid, grp)

    def validate(self) -> list[str]:
        """What is wrong: unnumbered features, unsound layouts, cells without dataset or repeated."""
        state, errors = self._state(), []
        cells, datasets = self._load(state, "cells"), self._load(state, "datasets")
        for s in self._spaces(state):
            registry = self._load(state, f"{s}_registry")
            r = registry.agg(F.count("*").alias("n"), F.count_distinct("uid").alias("d"), F.count_if(F.col("global_index").isNull()).alias("u")).first()
            if r["n"] != r["d"]:
                errors.append(f"{s}: repeated features")
            if r["u"]:
                errors.append(f"{s}: {r['u']} features without an index")
            layouts = self._load(state, f"{s}_layouts").withColumnRenamed("layout_uid", "grp")
            for e in matrix.layout_errors(layouts, registry).where("null_uids + null_globals + repeats + unresolved > 0").orderBy("grp").toLocalIterator():
                errors.append(f"{s}: layout {e['grp']} has {e['null_uids']} null uids, {e['null_globals']} unindexed, {e['repeats']} repeated, {e['unresolved']} unknown features")
        lost = cells.join(datasets.select(F.col("uid").alias("dataset_uid")).distinct(), "dataset_uid", "left_anti").count()
        if lost:
            errors.append(f"{lost} cells without a dataset")
        counts = cells.agg(F.count("*").alias("n"), F.count_distinct("uid").alias("d")).first()
        if counts["n"] != counts["d"]:
            errors.append("repeated cell uids")
        return errors

    # versions

    def snapshot(self) -> int:
        """Publish the state under the next version number, from 0; a state with errors raises."""
        if errors := self.validate():
            raise ValueError("; ".join(errors))
        state = self._state()
        record = state | {"total_cells": self._load(state, "cells").count(), "created_at": datetime.now(UTC).isoformat()}
        while True:
            version = (self.files.numbers("versions") or [-1])[-1] + 1
            if self.files.create(f"versions/{version}.json", record | {"version": version}):
                return version

    def list_versions(self) -> DataFrame:
        """(version, total_cells, created_at) in order."""
        rows = [(v, r["total_cells"], r["created_at"]) for v in self.files.numbers("versions") for r in [self.files.read(f"versions/{v}.json")]]
        return self.spark.createDataFrame(rows, "version bigint, total_cells bigint, created_at string").orderBy("version")

    def query(self):
        raise RuntimeError("queries need a version: use checkout()")

    def checkout(self, version: int) -> AtlasVersion:
        """Every table as it was when the version was published."""
        if version not in self.files.numbers("versions"):
            raise ValueError(f"no version {version}")
        state = self.files.read(f"versions/{version}.json")
        datasets = self._load(state, "datasets")
        registries, layouts, values, kept = {}, {}, {}, {}
        for s in state["spaces"]:
            if f"{s}_registry" in state["schemas"]:
                registries[s] = self._load(state, f"{s}_registry")
                own = datasets.where(F.col("feature_space") == s).select("grp", "layout_uid").distinct()
                layouts[s] = self._load(state, f"{s}_layouts").join(F.broadcast(own), "layout_uid").select("grp", "local_index", "feature_uid", "global_index")
            if f"{s}_values" in state["schemas"]:
                part = self._load(state, f"{s}_values")
                values[s] = part.withColumnRenamed("uid", "cell") if schema.get_space(s).kind == schema.INTERVAL else part
            if s in state.get("csc", {}):
                kept[s] = (self._load(state, f"{s}_csc"), tuple(state["csc"][s]))
        return AtlasVersion(self._load(state, "cells"), registries, layouts, values, datasets, version, kept)

    def checkout_latest(self) -> AtlasVersion:
        versions = self.files.numbers("versions")
        if not versions:
            raise ValueError("nothing is published")
        return self.checkout(versions[-1])
