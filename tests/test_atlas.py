"""Ingest, versions and queries on small atlases with known content."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from polyatlas.operators import batches, matrix, schema
from polyatlas.operators.store import Atlas

SPACE = "gene_expression"


def _batch(spark, prefix, n, genes, seed=42):
    rng = random.Random(seed)
    obs = spark.createDataFrame([(f"{prefix}{i:02d}", f"tissue_{i % 3}") for i in range(n)], "uid string, tissue string")
    features = spark.createDataFrame([(i, f"g{i}") for i in range(genes)], "local_index int, feature_uid string")
    cells = [(f"{prefix}{i:02d}", j, float(rng.randint(1, 99))) for i in range(n) for j in range(genes) if rng.random() < 0.3]
    return obs, features, spark.createDataFrame(cells, "uid string, local_index int, counts float"), cells


@pytest.fixture(scope="module")
def two_groups(spark, tmp_path_factory):
    atlas = Atlas.create(spark, str(tmp_path_factory.mktemp("atlas") / "a"), [SPACE], "tissue string")
    assert atlas.register_features(SPACE, [f"g{i}" for i in range(10)]) == 10
    assert atlas.register_features(SPACE, ["g1", "g2"]) == 0
    first, second = _batch(spark, "a", 20, 10), _batch(spark, "b", 15, 7)
    assert atlas.add_batch(SPACE, *first[:3], "d1") == 20
    with pytest.raises(ValueError, match="without an index"):
        atlas.snapshot()
    atlas.optimize()
    assert atlas.validate() == [] and atlas.snapshot() == 0
    assert atlas.add_batch(SPACE, *second[:3], "d2") == 15
    atlas.optimize()
    assert atlas.snapshot() == 1
    return atlas, first[3], second[3]


def test_versions(two_groups):
    atlas, _, _ = two_groups
    assert [r["version"] for r in atlas.list_versions().collect()] == [0, 1]
    assert atlas.checkout(0).query().count() == 20
    assert atlas.checkout_latest().query().count() == 35
    with pytest.raises(RuntimeError):
        atlas.query()
    with pytest.raises(ValueError):
        atlas.checkout(9)
    with pytest.raises(FileExistsError):
        Atlas.create(atlas.spark, atlas.path, [SPACE])


def test_ids_stay_on_reindex(two_groups):
    atlas, _, _ = two_groups
    before = {r["uid"]: r["global_index"] for r in atlas.table(f"{SPACE}_registry").collect()}
    atlas.optimize()
    assert {r["uid"]: r["global_index"] for r in atlas.table(f"{SPACE}_registry").collect()} == before
    assert sorted(before.values()) == list(range(10))


def test_matrix_round_trip(two_groups):
    atlas, first, second = two_groups
    version = atlas.checkout_latest()
    names = {r["global_index"]: r["uid"] for r in version.registries[SPACE].collect()}
    want = {(u, f"g{j}"): v for u, j, v in first + second}
    assert {(r["uid"], names[r["global_index"]]): r["counts"] for r in version.query().to_matrix().x.collect()} == want
    both = version.query().feature_join("intersection").to_matrix()
    assert both.var.count() == 7
    assert {(r["uid"], names[r["global_index"]]): r["counts"] for r in both.x.collect()} == {k: v for k, v in want.items() if int(k[1][1:]) < 7}
    pinned = version.query().features(["g9", "g1", "g9"], SPACE).to_matrix()
    assert {names[r["global_index"]] for r in pinned.x.collect()} <= {"g1", "g9"} and pinned.var.count() == 2
    csc = matrix.csc_order(version.values[SPACE])
    assert sorted(map(tuple, csc.select("uid", "local_index", "counts").collect())) == sorted(first + second)


def test_query_rules(two_groups):
    query = two_groups[0].checkout_latest().query()
    for broken in (lambda: query.select("uid"), lambda: query.limit(1).balanced_limit(1, "tissue"), lambda: query.feature_spaces("x"), lambda: query.features(["g1"], "x"), lambda: query.features(["nope"], SPACE).to_matrix(), lambda: query.feature_join("left").to_matrix(), lambda: query.features(["g1"], SPACE).feature_join("intersection").to_matrix(), lambda: query.layers(SPACE, ["nope"]).to_matrix()):
        with pytest.raises(ValueError):
            broken()
    with pytest.raises(TypeError):
        query.to_fragments(SPACE)
    assert query.where("tissue = 'tissue_0'").where("tissue = 'tissue_1'").count() == 12
    assert query.balanced_limit(10, "tissue").count() == 9
    assert query.balanced_limit(2, "tissue").count() == 0
    assert query.where("tissue = 'none'").to_matrix().x is None
    assert [r["count"] for r in query.count("tissue").collect()] == [12, 12, 11]
    assert [len(b) for b in query.to_batches(10)] == [10, 10, 10, 5]
    result = query.to_multimodal()
    assert SPACE in result and result.present.where(SPACE).count() == 35


def test_batch_plan(two_groups):
    version = two_groups[0].checkout_latest()
    steps, rows = version.query().to_cell_dataset(SPACE, batch_size=10, seed=42)
    assert steps.select("batch").distinct().count() == 4 and steps.select("uid").distinct().count() == 35
    cells = steps.select("uid", "grp")
    assert batches.plan_length(cells, 10) == 4 and batches.plan_length(cells, 10, drop_last=True) == 3
    assert batches.batch_plan(cells, 10, drop_last=True).select("batch").distinct().count() == 3
    order = lambda **k: [r["uid"] for r in batches.batch_plan(cells, 10, **k).orderBy("ordinal").collect()]
    assert order(seed=1) == order(seed=1) != order(seed=1, epoch=1) == order(seed=2)
    assert sum(len(r["indices"]) for r in rows.collect()) == version.values[SPACE].count()
    assert all(len(r["offsets"]) == len(r["uids"]) + 1 and r["offsets"][-1] == len(r["values"]) for r in rows.collect())
    workers = batches.batch_plan(cells, 10, workers=2)
    assert {r["grp"]: r["worker"] for r in workers.select("grp", "worker").distinct().collect()} == {"d1": 0, "d2": 1}


def test_ingest_guards(spark, tmp_path):
    atlas = Atlas.create(spark, str(tmp_path / "a"), [SPACE, "image_tiles"], "tissue string")
    obs, features, values, _ = _batch(spark, "a", 4, 3)
    with pytest.raises(ValueError, match="aren't registered"):
        atlas.add_batch(SPACE, obs, features, values, "d")
    atlas.register_features(SPACE, ["g0", "g1", "g2"])
    with pytest.raises(ValueError, match="repeated feature"):
        atlas.add_batch(SPACE, obs, features.withColumn("feature_uid", F.lit("g0")), values, "d")
    with pytest.raises(ValueError, match="aren't in the atlas"):
        atlas.add_batch(SPACE, obs.withColumn("more", F.lit(1)), features, values, "d")
    with pytest.raises(ValueError, match="no layers"):
        atlas.add_batch(SPACE, obs, features, values.withColumnRenamed("counts", "odd"), "d")
    tiles = spark.createDataFrame([("a00", [1.0, 2.0]), ("a01", [3.0, 4.0])], "uid string, data array<float>")
    atlas.add_multimodal_batch({SPACE: (features, values), "image_tiles": (None, tiles)}, obs, "d")
    atlas.optimize()
    version = atlas.checkout(atlas.snapshot())
    result = version.query().to_multimodal()
    assert result.present.where("image_tiles").count() == 2 and result["image_tiles"].count() == 2 and result.obs.count() == 4
    with pytest.warns(UserWarning, match="left out"):
        assert list(version.query().to_mudata()) == [SPACE]


def test_schema_rules(spark):
    with pytest.raises(ValueError):
        schema.register_space(schema.FeatureSpace(SPACE, schema.SPARSE))
    with pytest.raises(KeyError):
        schema.get_space("nope")
    df = spark.createDataFrame([("a", ["x"], ["y", "z"], "bad", None), ("b", ["x"], ["y"], "good", "id")], "uid string, p array<string>, q array<string>, kind string, name string")
    rows = schema.row_errors(df, [("p", "q")], {"kind": ["good"]}, [("name",)]).collect()
    assert [(r["uid"], len(r["errors"])) for r in rows] == [("a", 3)]
