"""Rank-sum and Welch tests, FDR and normalisation against direct computation."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from polyatlas.functions import stats
from polyatlas.operators import dex


@pytest.fixture(scope="module")
def groups(spark):
    rng = random.Random(5)
    data = {(f"{g}{i}", f"f{j}"): float(rng.randint(1, 9)) for g, n in (("a", 30), ("b", 25), ("c", 20)) for i in range(n) for j in range(5) if rng.random() < 0.5}
    cells = [(f"{g}{i}", g) for g, n in (("a", 30), ("b", 25), ("c", 20)) for i in range(n)]
    return data, cells, spark.createDataFrame([(*k, v) for k, v in data.items()], "uid string, feature string, value double"), spark.createDataFrame(cells, "uid string, grp string")


def _columns(data, cells, group, feature):
    return [data.get((u, feature), 0.0) for u, g in cells if g == group]


def test_tails():
    z = np.array([-3, -0.5, 0, 1.2, 5])
    assert np.allclose(stats.normal_sf_array(z), [0.5 * math.erfc(x / math.sqrt(2)) for x in z], rtol=1e-12)
    t = np.array([0.0, 0.3, 1.0, 4.0, 30.0])
    assert np.allclose(stats.t_two_sided_array(t, np.ones(5)), 1 - 2 * np.arctan(t) / math.pi, atol=1e-9)
    assert np.allclose(stats.t_two_sided_array(t, np.full(5, 2.0)), 1 - t / np.sqrt(2 + t * t), atol=1e-9)


def test_rank_sums_equal_pair_counts(groups):
    data, cells, values, frame = groups
    from pyspark.sql import functions as F

    got = {(r["target"], r["feature"]): r["u"] for r in dex.rank_sums(values.select("uid", "feature", F.col("value").alias("x")), frame, "a").collect()}
    for target in "bc":
        for j in range(5):
            x, y = _columns(data, cells, target, f"f{j}"), _columns(data, cells, "a", f"f{j}")
            assert got[target, f"f{j}"] == sum((p > q) + 0.5 * (p == q) for p in x for q in y)


def test_welch(groups):
    data, cells, values, frame = groups
    from pyspark.sql import functions as F

    got = {(r["target"], r["feature"]): r for r in dex.welch(values.select("uid", "feature", F.col("value").alias("x")), frame, "a").collect()}
    for target in "bc":
        for j in range(5):
            x, y = (np.array(_columns(data, cells, g, f"f{j}")) for g in (target, "a"))
            a, b = x.var(ddof=1) / len(x), y.var(ddof=1) / len(y)
            r = got[target, f"f{j}"]
            assert r["statistic"] == pytest.approx((x.mean() - y.mean()) / math.sqrt(a + b), rel=1e-9)
            assert r["df"] == pytest.approx((a + b) ** 2 / (a * a / (len(x) - 1) + b * b / (len(y) - 1)), rel=1e-9)


def test_dex(groups):
    _, _, values, frame = groups
    with pytest.warns(UserWarning, match="left out"):
        out = dex.dex(values, frame, ["b", "c", "none"], "a")
    assert tuple(out.columns) == dex.COLUMNS
    rows = out.collect()
    assert len(rows) == 10 and {(r["target"], r["target_n"], r["ref_n"]) for r in rows} == {("b", 25, 30), ("c", 20, 30)}
    assert all(0 <= r["p_value"] <= r["fdr"] <= 1 for r in rows)
    assert dex.dex(values, frame, ["b"], "a", test="ttest").count() == 5
    with pytest.raises(ValueError):
        dex.dex(values, frame, ["b"], "nobody")


def test_normalise(groups):
    _, _, values, _ = groups
    sums: dict = {}
    for r in dex.normalise(values, 1e4).collect():
        sums[r["uid"]] = sums.get(r["uid"], 0) + math.expm1(r["x"])
    assert all(s == pytest.approx(1e4, rel=1e-4) for s in sums.values())


def test_no_difference(spark):
    cells = spark.createDataFrame([(f"{g}{i}", g) for g in "ab" for i in range(6)], "uid string, grp string")
    same = spark.createDataFrame([(f"{g}{i}", "f", 2.0) for g in "ab" for i in range(6)], "uid string, feature string, value double")
    r = dex.dex(same, cells, ["b"], "a").first()
    assert r["statistic"] == 18 and r["p_value"] == 1
    r = dex.dex(same, cells, ["b"], "a", test="ttest").first()
    assert r["statistic"] == 0 and r["p_value"] == 1
