"""The operators over the star-schema tables: orders are cells, parts are features, nations are groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyatlas.functions import identity, labels
from polyatlas.operators import batches, dex, intervals, matrix, schema, search, vocabulary
from polyatlas.operators.query import AtlasVersion, pointer
from polyatlas.streaming import stream_counts, stream_fragments

SALES, PROFILE = "sales", "profile"
for _space in (schema.FeatureSpace(SALES, schema.SPARSE, True, ("quantity",), ("quantity", "price")), schema.FeatureSpace(PROFILE, schema.DENSE, True, ("raw",), ("raw",))):
    if _space.name not in schema.registered_spaces():
        schema.register_space(_space)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
DAY = 86400


def _register(sql: str | None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _local(part, grp):
    """Local index of a part in a nation: another one in each nation, in another order than the part keys."""
    return part.bitwiseXOR(677 + 37 * grp.cast("long"))


def driver_atlas(spark: SparkSession, sf_dir: str, pointers: bool = True) -> AtlasVersion:
    """Orders with a sparse part matrix by nation, and a dense profile of those whose key is a vector's; without ``pointers`` the cells alone."""
    orders, customer, nation, line, part, emb = (_read(spark, sf_dir, t) for t in ("orders", "customer", "nation", "lineitem", "part", "embeddings"))
    who = customer.join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_mktsegment", "n_nationkey", "n_name")
    owned = orders.join(who, F.col("o_custkey") == F.col("c_custkey"))
    obs = [F.col("o_orderkey").alias("uid"), F.col("n_name").alias("dataset_uid"), "o_orderpriority", "o_orderstatus", "o_totalprice", "c_mktsegment"]
    if not pointers:
        return AtlasVersion(owned.select(*obs))
    sold = line.select(F.col("l_orderkey").alias("_o")).distinct()
    marked = owned.join(sold, F.col("o_orderkey") == F.col("_o"), "left").join(emb.select("vec_id", "label"), F.col("o_orderkey") == F.col("vec_id"), "left")
    cells = marked.select(
        *obs,
        pointer(SALES, F.col("n_nationkey"), F.col("_o").isNotNull()), pointer(PROFILE, F.col("label") % 2, F.col("vec_id").isNotNull()),
    )
    rows = line.join(owned.select("o_orderkey", F.col("n_nationkey").alias("grp")), F.col("l_orderkey") == F.col("o_orderkey"))
    registry = part.select(F.col("p_partkey").alias("uid"), F.col("p_partkey").alias("global_index"), "p_brand", "p_type", "p_size")
    layout = rows.select("grp", _local(F.col("l_partkey"), F.col("grp")).alias("local_index"), F.col("l_partkey").alias("feature_uid"), F.col("l_partkey").alias("global_index")).distinct()
    values = rows.select(F.col("l_orderkey").alias("uid"), "grp", _local(F.col("l_partkey"), F.col("grp")).alias("local_index"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"))
    # one group has all 64 dimensions, turned by seven places, the other the first 32, backwards
    turned, backwards = F.concat(F.slice("embedding", 8, 57), F.slice("embedding", 1, 7)), F.reverse(F.slice("embedding", 1, 32))
    profile = emb.select(F.col("vec_id").alias("uid"), (F.col("label") % 2).alias("grp"), F.when(F.col("label") % 2 == 0, turned).otherwise(backwards).alias("raw"))
    dims = spark.range(64).select(F.col("id").alias("local_index"), F.concat(F.lit("d"), F.col("id")).alias("feature_uid"), F.col("id").alias("global_index"))
    both = dims.withColumn("grp", F.explode(F.array(F.lit(0), F.lit(1)))).where("grp = 0 or global_index < 32")
    dense_layout = both.select("grp", F.when(F.col("grp") == 0, (F.col("global_index") + 57) % 64).otherwise(31 - F.col("global_index")).alias("local_index"), "feature_uid", "global_index")
    dense_registry = dims.select(F.col("feature_uid").alias("uid"), "global_index")
    datasets = nation.select(F.col("n_name").alias("uid"), F.col("n_nationkey").alias("grp"), F.lit(SALES).alias("feature_space"), F.col("n_name").alias("layout_uid"))
    return AtlasVersion(cells, {SALES: registry, PROFILE: dense_registry}, {SALES: layout, PROFILE: dense_layout}, {SALES: values, PROFILE: profile}, datasets, 0)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pinned features of the finished orders as a sparse matrix."""
    return driver_atlas(spark, sf_dir).query().where("o_orderstatus = 'F'").features(list(range(1, 21)), SALES).to_matrix(SALES).x


_CELLS = """
cells AS (SELECT o_orderkey AS uid, n_name, n_nationkey AS grp, o_orderpriority, o_orderstatus, o_totalprice, c_mktsegment,
  o_orderkey IN (SELECT l_orderkey FROM lineitem) AS has_sales, o_orderkey IN (SELECT vec_id FROM embeddings) AS has_profile
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""
_LAYOUT = """
layout AS (SELECT DISTINCT grp, l_partkey AS feature FROM lineitem JOIN cells ON l_orderkey = uid)"""

# --- scans, projections, counts, limits


@_register(f"WITH {_CELLS} SELECT uid, o_totalprice FROM cells WHERE o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_totalprice BETWEEN 1000 AND 200000")
def scan_where(spark, sf_dir):
    q = driver_atlas(spark, sf_dir, pointers=False).query().where("o_orderstatus = 'F' and o_orderpriority in ('1-URGENT', '2-HIGH') and o_totalprice between 1000 and 200000")
    return q.select(["o_totalprice"]).to_frame()


@_register(f"WITH {_CELLS} SELECT uid, c_mktsegment, o_orderstatus FROM cells")
def project_select(spark, sf_dir):
    return driver_atlas(spark, sf_dir, pointers=False).query().select(["c_mktsegment", "o_orderstatus", "c_mktsegment"]).to_frame()


@_register(f"WITH {_CELLS} SELECT uid, n_name AS dataset_uid, o_orderpriority, o_orderstatus, o_totalprice, c_mktsegment FROM cells WHERE o_orderstatus = 'P'")
def obs_projection(spark, sf_dir):
    return driver_atlas(spark, sf_dir, pointers=False).query().where("o_orderstatus = 'O'").where("o_orderstatus = 'P'").to_frame()


@_register(f"WITH {_CELLS} SELECT count(*) AS n FROM cells WHERE c_mktsegment IS NOT NULL")
def count_all(spark, sf_dir):
    return driver_atlas(spark, sf_dir, pointers=False).query().where("c_mktsegment is not null").cells().agg(F.count("*").alias("n"))


@_register(f"""WITH {_CELLS} SELECT c_mktsegment, o_orderstatus, count(*) AS "count" FROM cells GROUP BY ALL""")
def count_group(spark, sf_dir):
    return driver_atlas(spark, sf_dir, pointers=False).query().count(["c_mktsegment", "o_orderstatus"])


@_register(f"WITH {_CELLS} SELECT uid, o_totalprice FROM cells WHERE o_orderstatus = 'O' ORDER BY uid LIMIT 100")
def limit_uid(spark, sf_dir):
    return driver_atlas(spark, sf_dir, pointers=False).query().where("o_orderstatus = 'O'").limit(100).select(["o_totalprice"]).to_frame()


@_register(f"""WITH {_CELLS}, r AS (SELECT uid, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY uid) AS nth FROM cells)
SELECT uid, c_mktsegment FROM r WHERE nth <= 103 // (SELECT count(DISTINCT c_mktsegment) FROM cells)""")
def balanced_limit(spark, sf_dir):
    return driver_atlas(spark, sf_dir, pointers=False).query().balanced_limit(103, "c_mktsegment").select(["c_mktsegment"]).to_frame()


@_register(f"WITH {_CELLS} SELECT uid, has_sales AS sales, has_profile AS profile FROM cells")
def presence_mask(spark, sf_dir):
    atlas = driver_atlas(spark, sf_dir)
    return atlas.query().cells().select("uid", *(F.col(s).isNotNull().alias(s) for s in (SALES, PROFILE)))


@_register(f"WITH {_CELLS} SELECT uid, o_orderstatus AS status, CAST(NULL AS VARCHAR) AS note FROM cells")
def align_obs(spark, sf_dir):
    from pyspark.sql import types as T

    want = T.StructType([T.StructField("uid", T.LongType(), False), T.StructField("status", T.StringType(), False), T.StructField("note", T.StringType())])
    return schema.align_obs(driver_atlas(spark, sf_dir, pointers=False).cells, want, {"o_orderstatus": "status"})


# --- ragged matrices


@_register(f"""WITH {_CELLS} SELECT uid, l_partkey AS global_index, sum(l_quantity) AS quantity FROM lineitem JOIN cells ON l_orderkey = uid
WHERE o_orderstatus = 'P' GROUP BY ALL""")
def sparse_union(spark, sf_dir):
    return driver_atlas(spark, sf_dir).query().where("o_orderstatus = 'P'").to_matrix(SALES).x


@_register(f"""WITH {_CELLS}, {_LAYOUT}, c AS (SELECT * FROM cells WHERE grp < 3 AND has_sales),
f AS (SELECT feature FROM layout WHERE grp IN (SELECT grp FROM c) GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT grp) FROM c))
SELECT uid, l_partkey AS global_index, sum(l_quantity) AS quantity FROM lineitem JOIN c ON l_orderkey = uid WHERE l_partkey IN (SELECT feature FROM f) GROUP BY ALL""")
def sparse_intersection(spark, sf_dir):
    return driver_atlas(spark, sf_dir).query().where(F.col(f"{SALES}.grp").cast("int") < 3).feature_join("intersection").to_matrix(SALES).x


@_register(f"""WITH {_CELLS} SELECT uid, l_partkey AS global_index, sum(l_quantity) AS quantity, round(sum(l_extendedprice), 2) AS price
FROM lineitem JOIN cells ON l_orderkey = uid WHERE l_partkey BETWEEN 1 AND 50 GROUP BY ALL""")
def features_pinned(spark, sf_dir):
    x = driver_atlas(spark, sf_dir).query().features([*range(50, 0, -1), 7], SALES).layers(SALES, ["quantity", "price"]).to_matrix(SALES).x
    return x.withColumn("price", F.round("price", 2))


@_register(f"""WITH {_CELLS}, {_LAYOUT} SELECT feature AS global_index, count(DISTINCT grp) AS n_groups FROM layout GROUP BY 1""")
def feature_space_groups(spark, sf_dir):
    return driver_atlas(spark, sf_dir).layouts[SALES].groupBy("global_index").agg(F.count_distinct("grp").alias("n_groups"))


@_register(f"""WITH {_CELLS} SELECT grp, xor(l_partkey, 677 + 37 * grp) AS local_index, count(*) AS n, sum(l_quantity) AS total FROM lineitem JOIN cells ON l_orderkey = uid
WHERE xor(l_partkey, 677 + 37 * grp) <= 1000 GROUP BY ALL""")
def csc_feature_scan(spark, sf_dir):
    by_feature = matrix.csc_order(driver_atlas(spark, sf_dir).values[SALES]).where("local_index <= 1000")
    return by_feature.groupBy("grp", "local_index").agg(F.count("*").alias("n"), F.sum("quantity").alias("total"))


@_register("""WITH e AS (SELECT vec_id AS uid, unnest(embedding) AS v, unnest(range(64)) AS i, label % 2 AS g FROM embeddings WHERE vec_id IN (SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey))
SELECT uid, i AS at, CASE WHEN g = 1 AND i >= 32 THEN CAST(0 AS FLOAT) ELSE v END AS v FROM e""")
def dense_union(spark, sf_dir):
    x = driver_atlas(spark, sf_dir).query().to_matrix(PROFILE).x
    return x.select("uid", F.posexplode("values").alias("at", "v")).withColumn("at", F.col("at").cast("long"))


@_register("""WITH e AS (SELECT vec_id AS uid, unnest(embedding) AS v, unnest(range(64)) AS i FROM embeddings WHERE vec_id IN (SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey))
SELECT uid, i AS at, v FROM e WHERE i < 32""")
def dense_intersection(spark, sf_dir):
    x = driver_atlas(spark, sf_dir).query().feature_join("intersection").to_matrix(PROFILE).x
    return x.select("uid", F.posexplode("values").alias("at", "v")).withColumn("at", F.col("at").cast("long"))


@_register("SELECT l_orderkey AS uid, count(*) AS nnz FROM lineitem GROUP BY 1")
def nnz_per_cell(spark, sf_dir):
    line = _read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("uid"), "l_quantity")
    return matrix.values_per_cell(line, "l_quantity")


@_register("""WITH c AS (SELECT l_orderkey AS uid, count(*) AS nnz FROM lineitem GROUP BY 1)
SELECT uid, nnz, CAST(sum(nnz) OVER (ORDER BY uid) - nnz AS BIGINT) AS begin, CAST(sum(nnz) OVER (ORDER BY uid) AS BIGINT) AS "end" FROM c""")
def offsets_prefix_sum(spark, sf_dir):
    return matrix.offsets(nnz_per_cell(spark, sf_dir), "uid", "nnz")


@_register("""SELECT l_orderkey AS uid, l_partkey AS local_index, sum(CASE WHEN l_linenumber = 1 THEN l_quantity ELSE 0 END) AS first,
sum(CASE WHEN l_linenumber > 2 THEN l_quantity ELSE 0 END) AS later FROM lineitem WHERE l_linenumber <> 2 GROUP BY ALL""")
def union_layers(spark, sf_dir):
    line = _read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("uid"), F.col("l_partkey").alias("local_index"), F.col("l_quantity").alias("value"), "l_linenumber")
    return matrix.union_layers({"first": line.where("l_linenumber = 1"), "later": line.where("l_linenumber > 2")})


# --- registries and layouts


@_register("SELECT l_orderkey AS uid, l_partkey AS feature, p_brand, p_size FROM lineitem LEFT JOIN part ON l_partkey = p_partkey WHERE l_linenumber = 1")
def join_feature_metadata(spark, sf_dir):
    line = _read(spark, sf_dir, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("uid"), F.col("l_partkey").alias("feature"))
    return driver_atlas(spark, sf_dir).join_feature_metadata(line, SALES, ["p_brand", "p_size"])


@_register(f"""WITH {_CELLS}, {_LAYOUT} SELECT feature AS global_feature_uid, layout.grp, n_name AS uid, 'sales' AS feature_space
FROM layout JOIN nation ON grp = n_nationkey WHERE feature IN (3, 5, 8, 1999999)""")
def find_datasets_with_features(spark, sf_dir):
    return driver_atlas(spark, sf_dir).find_datasets_with_features([3, 5, 8, 1999999], SALES)


@_register(f"""WITH {_CELLS}, {_LAYOUT} SELECT grp, xor(feature, 677 + 37 * grp) AS local_index, feature AS feature_uid, CASE WHEN feature % 2 = 0 THEN feature ELSE -1 END AS global_index FROM layout""")
def layout_build(spark, sf_dir):
    return _half_layout(spark, sf_dir).fillna(-1, ["global_index"])


def _half_layout(spark, sf_dir):
    atlas = driver_atlas(spark, sf_dir)
    half = atlas.registries[SALES].withColumn("global_index", F.when(F.col("uid") % 2 == 0, F.col("uid")))
    return matrix.build_layout(atlas.layouts[SALES], half)


@_register(f"""WITH {_CELLS}, {_LAYOUT} SELECT grp, count(*) AS n, CAST(0 AS BIGINT) AS null_uids, count(*) FILTER (feature % 2 = 1) AS null_globals, CAST(0 AS BIGINT) AS repeats,
count(*) FILTER (feature > 1000) AS unresolved FROM layout GROUP BY 1""")
def layout_validate(spark, sf_dir):
    return matrix.layout_errors(_half_layout(spark, sf_dir), driver_atlas(spark, sf_dir).registries[SALES].where("uid <= 1000"))


@_register("""SELECT p_partkey AS uid, CASE WHEN p_size <= 10 THEN 2 * p_partkey ELSE (SELECT max(2 * p_partkey) FROM part WHERE p_size <= 10) + row_number() OVER (PARTITION BY p_size <= 10 ORDER BY p_partkey) END AS global_index FROM part""")
def reindex(spark, sf_dir):
    part = _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("uid"), F.when(F.col("p_size") <= 10, 2 * F.col("p_partkey")).alias("global_index"))
    return matrix.reindex(part)


@_register(f"""WITH {_CELLS}, {_LAYOUT} SELECT grp, xor(feature, 677 + 37 * grp) AS local_index, feature AS feature_uid, feature AS global_index FROM layout""")
def sync_layout(spark, sf_dir):
    return matrix.sync_layout(_half_layout(spark, sf_dir), driver_atlas(spark, sf_dir).registries[SALES])


@_register("""SELECT p_partkey AS uid, substr(sha1(unhex('b3e7a9f16c2d4a8b9f013d5e7a2b8c4f') || encode(p_brand || '|' || p_type)), 1, 12) || '5' || substr(sha1(unhex('b3e7a9f16c2d4a8b9f013d5e7a2b8c4f') || encode(p_brand || '|' || p_type)), 14, 3) AS stable_uid FROM part""")
def stable_uid(spark, sf_dir):
    return _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("uid"), identity.stable_uid(F.col("p_brand"), F.col("p_type")).alias("stable_uid"))


@_register("""SELECT p_brand, substr(sha256(string_agg(CAST(p_partkey AS VARCHAR) || chr(0), '' ORDER BY p_partkey)), 1, 16) AS layout_uid FROM part GROUP BY 1""")
def layout_uid(spark, sf_dir):
    keys = F.transform(F.array_sort(F.collect_list("p_partkey")), lambda x: x.cast("string"))
    return _read(spark, sf_dir, "part").groupBy("p_brand").agg(identity.layout_uid(keys).alias("layout_uid"))


# --- statistics: brands as features, market segments as groups


def _brand_values(spark, sf_dir):
    line, part = _read(spark, sf_dir, "lineitem"), _read(spark, sf_dir, "part")
    rows = line.join(F.broadcast(part.select("p_partkey", "p_brand")), F.col("l_partkey") == F.col("p_partkey"))
    return rows.groupBy(F.col("l_orderkey").alias("uid"), F.col("p_brand").alias("feature")).agg(F.sum("l_quantity").alias("value"))


def _segments(spark, sf_dir):
    orders, customer = _read(spark, sf_dir, "orders"), _read(spark, sf_dir, "customer")
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("uid"), F.col("c_mktsegment").alias("grp"))


def _segment_names(spark, sf_dir):
    return "AUTOMOBILE", ["BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


_STATS = """
v AS (SELECT l_orderkey AS uid, p_brand AS feature, sum(l_quantity) AS value FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
x AS (SELECT uid, feature, CAST(ln(1 + value * 10000.0 / sum(value) OVER (PARTITION BY uid)) AS FLOAT) AS x FROM v),
cells AS (SELECT o_orderkey AS uid, c_mktsegment AS grp FROM orders JOIN customer ON o_custkey = c_custkey),
sizes AS (SELECT grp, count(*) AS n FROM cells GROUP BY 1)"""


@_register(f"WITH {_STATS} SELECT uid, feature, round(CAST(x AS DOUBLE), 4) AS x FROM x")
def normalise(spark, sf_dir):
    return dex.normalise(_brand_values(spark, sf_dir)).select("uid", "feature", F.round(F.col("x").cast("double"), 4).alias("x"))


@_register(f"WITH {_STATS} SELECT grp, feature, round(sum(exp(CAST(x AS DOUBLE)) - 1) / any_value(n), 3) AS mean FROM x JOIN cells USING (uid) JOIN sizes USING (grp) GROUP BY ALL")
def pseudobulk_arith(spark, sf_dir):
    means = dex.pseudobulk(dex.normalise(_brand_values(spark, sf_dir)), _segments(spark, sf_dir), geometric=False)
    return means.withColumn("mean", F.round("mean", 3))


@_register(f"WITH {_STATS} SELECT grp, feature, round(exp(sum(CAST(x AS DOUBLE)) / any_value(n)) - 1, 6) AS mean FROM x JOIN cells USING (uid) JOIN sizes USING (grp) GROUP BY ALL")
def pseudobulk_geo(spark, sf_dir):
    means = dex.pseudobulk(dex.normalise(_brand_values(spark, sf_dir)), _segments(spark, sf_dir))
    return means.withColumn("mean", F.round("mean", 6))


@_register(f"""WITH {_STATS}, m AS (SELECT grp, feature, exp(sum(CAST(x AS DOUBLE)) / any_value(n)) - 1 AS mean FROM x JOIN cells USING (uid) JOIN sizes USING (grp) GROUP BY ALL)
SELECT t.grp AS target, t.feature, round(log2((t.mean + 1e-9) / (r.mean + 1e-9)), 6) AS fold_change, round((t.mean - r.mean) / (r.mean + 1e-9), 6) AS percent_change
FROM m t JOIN m r ON t.feature = r.feature AND r.grp = 'AUTOMOBILE' WHERE t.grp <> 'AUTOMOBILE'""")
def dex_foldchange(spark, sf_dir):
    means = dex.pseudobulk(dex.normalise(_brand_values(spark, sf_dir)), _segments(spark, sf_dir))
    out = dex.fold_changes(means, _segment_names(spark, sf_dir)[0])
    return out.select("target", "feature", F.round("fold_change", 6).alias("fold_change"), F.round("percent_change", 6).alias("percent_change"))


@_register(f"""WITH {_STATS.replace("CAST(ln(1 + value * 10000.0 / sum(value) OVER (PARTITION BY uid)) AS FLOAT)", "CAST(value AS FLOAT)")},
own AS (SELECT grp, feature, x, count(*) AS c FROM x JOIN cells USING (uid) GROUP BY ALL),
grid AS (SELECT s.grp AS target, s.n AS n_a, r.n AS n_b FROM sizes s, sizes r WHERE r.grp = 'AUTOMOBILE' AND s.grp <> 'AUTOMOBILE'),
pairs AS (SELECT target, feature, x, c AS a, 0 AS b FROM own JOIN grid ON grp = target UNION ALL SELECT target, feature, x, 0, c FROM own, grid WHERE grp = 'AUTOMOBILE'),
by_value AS (SELECT target, feature, x, sum(a) AS a, sum(b) AS b FROM pairs GROUP BY ALL),
filled AS (SELECT * FROM by_value UNION ALL SELECT target, feature, 0, any_value(n_a) - sum(a), any_value(n_b) - sum(b) FROM by_value JOIN grid USING (target) GROUP BY target, feature),
ranked AS (SELECT target, feature, a, a + b AS c, sum(a + b) OVER (PARTITION BY target, feature ORDER BY x) - (a + b) + (a + b + 1) / 2 AS rank FROM filled)
SELECT target, feature, CAST(sum(a * rank) - any_value(n_a) * (any_value(n_a) + 1) / 2 AS DOUBLE) AS u, CAST(sum(CAST(c AS DOUBLE) ** 3 - c) AS DOUBLE) AS tie, any_value(n_a) AS n_a, any_value(n_b) AS n_b
FROM ranked JOIN grid USING (target) GROUP BY target, feature""")
def mwu_u(spark, sf_dir):
    raw = _brand_values(spark, sf_dir).select("uid", "feature", F.col("value").cast("float").alias("x"))
    return dex.rank_sums(raw, _segments(spark, sf_dir), _segment_names(spark, sf_dir)[0])


@_register(f"""WITH {_STATS}, g AS (SELECT grp, feature, n, sum(CAST(v.value AS DOUBLE)) AS s1, sum(CAST(v.value AS DOUBLE) ** 2) AS s2 FROM v JOIN cells USING (uid) JOIN sizes USING (grp) GROUP BY ALL),
m AS (SELECT grp, feature, n, s1 / n AS mean, (s2 - s1 * s1 / n) / (n - 1) / n AS se2 FROM g)
SELECT t.grp AS target, t.feature, round((t.mean - r.mean) / sqrt(t.se2 + r.se2), 6) AS statistic, round((t.se2 + r.se2) ** 2 / (t.se2 ** 2 / (t.n - 1) + r.se2 ** 2 / (r.n - 1)), 4) AS df, t.n AS n_a, r.n AS n_b
FROM m t JOIN m r ON t.feature = r.feature AND r.grp = 'AUTOMOBILE' WHERE t.grp <> 'AUTOMOBILE'""")
def welch_t(spark, sf_dir):
    raw = _brand_values(spark, sf_dir).select("uid", "feature", F.col("value").alias("x"))
    out = dex.welch(raw, _segments(spark, sf_dir), _segment_names(spark, sf_dir)[0])
    return out.withColumn("statistic", F.round("statistic", 6)).withColumn("df", F.round("df", 4))


@_register("""WITH p AS (SELECT p_brand AS target, p_partkey AS feature, (p_partkey * 7919 % 10007) / 10007.0 AS p_value FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY p_value, feature) AS rank, count(*) OVER (PARTITION BY target) AS n FROM p)
SELECT target, feature, round(p_value, 9) AS p_value, round(least(1.0, min(p_value * n / rank) OVER (PARTITION BY target ORDER BY rank DESC)), 9) AS fdr FROM r""")
def bh_fdr(spark, sf_dir):
    p = _read(spark, sf_dir, "part").select(F.col("p_brand").alias("target"), F.col("p_partkey").alias("feature"), ((F.col("p_partkey") * 7919 % 10007) / 10007.0).alias("p_value"))
    return dex.benjamini_hochberg(p).withColumn("fdr", F.round("fdr", 9)).withColumn("p_value", F.round("p_value", 9))


# p of a normal deviate and of Student's t by series of positive terms
_NORMAL = """CASE WHEN y >= 6 THEN 0 WHEN y <= 0 THEN NULL ELSE 1 - list_sum(list_transform(range(0, 150), lambda i: exp((2 * i + 1) * ln(y) - lgamma(i + 1.5) - y * y))) END"""
_STUDENT = """CASE WHEN y <= 0 THEN 1 ELSE 1 - exp(0.5 * ln(y) + b * ln(1 - y) - lgamma(0.5) - lgamma(b) + lgamma(b + 0.5)) / 0.5
  * (1 + list_sum(list_transform(range(0, 400), lambda i: exp(lgamma(1.5) - lgamma(b + 0.5) + lgamma(b + 1.5 + i) - lgamma(i + 2.5) + (i + 1) * ln(y))))) END"""
_FDR = """f AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY p, feature) AS k, count(*) OVER (PARTITION BY target) AS m FROM p),
q AS (SELECT *, least(1.0, greatest(0.0, min(p * m / k) OVER (PARTITION BY target ORDER BY k DESC))) AS fdr FROM f)
SELECT feature, target, round(target_mean, 6) AS target_mean, round(ref_mean, 6) AS ref_mean, n_a AS target_n, n_b AS ref_n, round(log2((target_mean + 1e-9) / (ref_mean + 1e-9)), 6) AS fold_change,
round((target_mean - ref_mean) / (ref_mean + 1e-9), 6) AS percent_change, round(p, 8) AS p_value, round(statistic, 6) AS statistic, round(fdr, 7) AS fdr FROM q"""
_COMPARED = f"""{_STATS}, own AS (SELECT grp, feature, x FROM x JOIN cells USING (uid)),
means AS (SELECT grp, feature, exp(sum(CAST(x AS DOUBLE)) / any_value(n)) - 1 AS mean FROM own JOIN sizes USING (grp) GROUP BY ALL),
grid AS (SELECT feature, s.grp AS target, s.n AS n_a, r.n AS n_b FROM (SELECT DISTINCT feature FROM own), sizes s, sizes r WHERE s.grp <> 'AUTOMOBILE' AND r.grp = 'AUTOMOBILE'),
change AS (SELECT g.*, coalesce(t.mean, 0) AS target_mean, coalesce(r.mean, 0) AS ref_mean FROM grid g LEFT JOIN means t ON t.grp = target AND t.feature = g.feature LEFT JOIN means r ON r.grp = 'AUTOMOBILE' AND r.feature = g.feature)"""


def _dex_rounded(df: DataFrame) -> DataFrame:
    digits = {"target_mean": 6, "ref_mean": 6, "fold_change": 6, "percent_change": 6, "p_value": 8, "statistic": 6, "fdr": 7}
    return df.withColumns({c: F.round(c, n) for c, n in digits.items()})


@_register(f"""WITH {_COMPARED},
vals AS (SELECT DISTINCT feature, x FROM own), a AS (SELECT grp, feature, x, count(*) AS c FROM own GROUP BY ALL),
full_ AS (SELECT g.target, g.feature, v.x, coalesce(a.c, 0) AS a, coalesce(b.c, 0) AS b FROM grid g JOIN vals v USING (feature) LEFT JOIN a ON a.grp = g.target AND a.feature = g.feature AND a.x = v.x
  LEFT JOIN a b ON b.grp = 'AUTOMOBILE' AND b.feature = g.feature AND b.x = v.x),
zero AS (SELECT * FROM full_ UNION ALL SELECT target, feature, -1, any_value(n_a) - sum(a), any_value(n_b) - sum(b) FROM full_ JOIN grid USING (target, feature) GROUP BY target, feature),
ranked AS (SELECT *, sum(a + b) OVER (PARTITION BY target, feature ORDER BY x) - (a + b) + (a + b + 1) / 2 AS rank FROM zero),
u AS (SELECT target, feature, sum(a * rank) - any_value(n_a) * (any_value(n_a) + 1) / 2 AS u, sum(CAST(a + b AS DOUBLE) ** 3 - (a + b)) AS tie, any_value(n_a) AS n_a, any_value(n_b) AS n_b FROM ranked JOIN grid USING (target, feature) GROUP BY target, feature),
z AS (SELECT *, n_a * n_b / 12.0 * ((n_a + n_b + 1) - tie / ((n_a + n_b) * (n_a + n_b - 1.0))) AS variance, greatest(u, n_a * n_b - u) - n_a * n_b / 2.0 - 0.5 AS above FROM u),
y AS (SELECT *, CASE WHEN variance > 0 THEN above / sqrt(variance) / sqrt(2.0) ELSE 0 END AS y FROM z),
p AS (SELECT c.*, u AS statistic, CASE WHEN y.variance > 0 THEN least(1.0, coalesce({_NORMAL}, 1.0)) ELSE 1.0 END AS p FROM y JOIN change c USING (target, feature)), {_FDR}""")
def dex_mwu(spark, sf_dir):
    control, targets = _segment_names(spark, sf_dir)
    return _dex_rounded(dex.dex(_brand_values(spark, sf_dir), _segments(spark, sf_dir), targets, control))


@_register(f"""WITH {_COMPARED}, m AS (SELECT grp, feature, n, sum(CAST(x AS DOUBLE)) / any_value(n) AS mean, sum(CAST(x AS DOUBLE) ** 2) AS s2 FROM own JOIN sizes USING (grp) GROUP BY ALL),
e AS (SELECT grp, feature, mean, greatest(0, (s2 - n * mean * mean) / (n - 1) / n) AS se2, n FROM m),
t AS (SELECT g.*, coalesce(a.mean, 0) - coalesce(b.mean, 0) AS gap, coalesce(a.se2, 0) AS va, coalesce(b.se2, 0) AS vb FROM change g LEFT JOIN e a ON a.grp = g.target AND a.feature = g.feature LEFT JOIN e b ON b.grp = 'AUTOMOBILE' AND b.feature = g.feature),
s AS (SELECT *, CASE WHEN va + vb > 0 THEN gap / sqrt(va + vb) ELSE 0 END AS statistic, CASE WHEN va + vb > 0 THEN (va + vb) ** 2 / (va ** 2 / (n_a - 1) + vb ** 2 / (n_b - 1)) ELSE n_a + n_b - 2 END AS df FROM t),
y AS (SELECT *, statistic ** 2 / (df + statistic ** 2) AS y, df / 2 AS b FROM s), p AS (SELECT *, greatest(0.0, {_STUDENT}) AS p FROM y), {_FDR}""")
def dex_ttest(spark, sf_dir):
    control, targets = _segment_names(spark, sf_dir)
    return _dex_rounded(dex.dex(_brand_values(spark, sf_dir), _segments(spark, sf_dir), targets, control, test="ttest"))


# --- intervals: events as fragments

_FRAGMENTS = """
f AS (SELECT user_id AS cell, event_type AS chrom, CAST(floor(epoch(ts)) AS BIGINT) AS start, CAST(1 + floor(value) AS BIGINT) AS length FROM events)"""


def _fragments(spark, sf_dir):
    return stream_fragments(_read(spark, sf_dir, "events")).drop("ts")


def _ranges(spark, sf_dir):
    days = _fragments(spark, sf_dir).select("chrom", F.floor(F.col("start") / DAY).alias("d")).distinct()
    return days.select("chrom", (F.col("d") * DAY).alias("start"), (F.col("d") * DAY + DAY // 2 + 60).alias("end"), F.lit(None).cast("string").alias("name"))


_RANGES = f"""
r AS (SELECT DISTINCT chrom, start // {DAY} * {DAY} AS start, start // {DAY} * {DAY} + {DAY // 2 + 60} AS "end" FROM f),
peaks AS (SELECT row_number() OVER (ORDER BY chrom, start) - 1 AS range_id, chrom, start, "end", chrom || ':' || start || '-' || "end" AS name FROM r)"""


@_register(f"""WITH {_FRAGMENTS} SELECT * FROM f WHERE chrom = 'click' AND start < 1704499200 AND start + length > 1704326400""")
def region_query(spark, sf_dir):
    return intervals.query_region(_fragments(spark, sf_dir), "click", 1704326400, 1704499200)


@_register(f"""WITH {_FRAGMENTS}, {_RANGES} SELECT * FROM peaks""")
def peak_set(spark, sf_dir):
    return intervals.peak_set(_ranges(spark, sf_dir))


@_register(f"""WITH {_FRAGMENTS}, {_RANGES} SELECT cell, range_id, CAST(count(*) AS INTEGER) AS n FROM f JOIN peaks p ON f.chrom = p.chrom AND f.start < p."end" AND f.start + f.length > p.start GROUP BY ALL""")
def peak_matrix(spark, sf_dir):
    return intervals.count_fragments(_fragments(spark, sf_dir), intervals.peak_set(_ranges(spark, sf_dir)))


@_register(f"""WITH {_FRAGMENTS}, n AS (SELECT *, (row_number() OVER (PARTITION BY chrom ORDER BY start, length, cell) - 1) // 128 AS block FROM f)
SELECT chrom, block, max(start + length) AS end_max FROM n GROUP BY ALL""")
def end_max(spark, sf_dir):
    return intervals.end_max(_fragments(spark, sf_dir))


@_register("""WITH n AS (SELECT DISTINCT 'chr' || p_size AS chrom FROM part UNION SELECT unnest(['chrX', 'chrM', 'chrY', 'KI270728.1', 'GL000194.1']))
SELECT chrom, CAST(row_number() OVER (ORDER BY CASE WHEN regexp_matches(chrom, '^chr\\d+$') THEN 0 WHEN chrom IN ('chrX', 'chrY', 'chrM') THEN 1 ELSE 2 END,
CASE WHEN regexp_matches(chrom, '^chr\\d+$') THEN CAST(substr(chrom, 4) AS INTEGER) WHEN chrom = 'chrX' THEN 0 WHEN chrom = 'chrY' THEN 1 WHEN chrom = 'chrM' THEN 2 END, chrom) - 1 AS INTEGER) AS rank FROM n""")
def chrom_order(spark, sf_dir):
    names = _read(spark, sf_dir, "part").select(F.concat(F.lit("chr"), F.col("p_size")).alias("chrom")).distinct()
    named = names.limit(1).select(F.explode(F.array(*map(F.lit, ("chrX", "chrM", "chrY", "KI270728.1", "GL000194.1")))).alias("chrom"))
    return intervals.chromosome_order(names.union(named))


@_register(f"""WITH {_FRAGMENTS} SELECT cell, count(*) AS n FROM f GROUP BY 1""")
def fragments_per_cell(spark, sf_dir):
    return intervals.fragments_per(_fragments(spark, sf_dir), "cell")


@_register(f"""WITH {_FRAGMENTS}, c AS (SELECT chrom, count(*) AS n FROM f GROUP BY 1)
SELECT chrom, n, CAST(sum(n) OVER (ORDER BY chrom) - n AS BIGINT) AS begin, CAST(sum(n) OVER (ORDER BY chrom) AS BIGINT) AS "end" FROM c""")
def chrom_offsets(spark, sf_dir):
    return matrix.offsets(intervals.fragments_per(_fragments(spark, sf_dir), "chrom"), "chrom", "n")


@_register(f"""WITH {_FRAGMENTS} SELECT cell, (start - 1704326400) // 3600 AS tile, count(*) AS n FROM f WHERE chrom = 'view' AND start >= 1704326400 AND start < 1704412800 GROUP BY ALL""")
def tile_matrix(spark, sf_dir):
    return intervals.tile_matrix(_fragments(spark, sf_dir), "view", 1704326400, 1704412800, 3600)


@_register("SELECT event_type AS chrom, CAST(date_trunc('day', ts) AS TIMESTAMP) AS begin, count(*) AS n FROM events GROUP BY ALL")
def daily_counts(spark, sf_dir):
    return stream_counts(stream_fragments(_read(spark, sf_dir, "events")))


# --- vocabularies

_INPUTS = "inputs AS (SELECT p_partkey AS ordinal, CASE WHEN p_partkey % 3 = 0 THEN upper(p_type) WHEN p_partkey % 3 = 1 THEN p_type ELSE p_type || ' x' END AS value FROM part)"


def _inputs(spark, sf_dir):
    key, kind = F.col("p_partkey"), F.col("p_type")
    return _read(spark, sf_dir, "part").select(key.alias("ordinal"), F.when(key % 3 == 0, F.upper(kind)).when(key % 3 == 1, kind).otherwise(F.concat(kind, F.lit(" x"))).alias("value"))


@_register(f"""WITH {_INPUTS}, a AS (SELECT lower(p_type) AS alias, p_brand AS id, bool_or(p_size = 1 AND p_partkey % 5 = 0) AS canonical FROM part GROUP BY ALL),
b AS (SELECT alias, list_sort(list(id)) AS ids, count(*) FILTER (canonical) AS nc, min(id) FILTER (canonical) AS fc FROM a GROUP BY 1)
SELECT ordinal, value, coalesce(fc, ids[1]) AS resolved, CASE WHEN ids IS NULL THEN 0.0 WHEN nc = 1 THEN 1.0 WHEN len(ids) = 1 THEN 0.9 ELSE 0.7 END::DOUBLE AS confidence,
coalesce(array_to_string(list_filter(ids, lambda x: x <> coalesce(fc, ids[1])), '; '), '') AS alternatives FROM inputs LEFT JOIN b ON lower(value) = alias""")
def resolve_alias(spark, sf_dir):
    aliases = _read(spark, sf_dir, "part").select(F.lower("p_type").alias("alias"), F.col("p_brand").alias("id"), ((F.col("p_size") == 1) & (F.col("p_partkey") % 5 == 0)).alias("is_canonical"))
    return vocabulary.resolve_aliases(_inputs(spark, sf_dir), aliases).withColumn("alternatives", F.array_join("alternatives", "; "))


@_register("""WITH i AS (SELECT p_partkey AS ordinal, CASE WHEN p_size > 10 THEN 'ENSG' ELSE 'ENSX' END || p_partkey || CASE WHEN p_partkey % 2 = 0 THEN '.' || p_size ELSE '' END AS value FROM part),
f AS (SELECT 'ENSG' || p_partkey AS id, p_brand AS symbol FROM part)
SELECT ordinal, value, id AS resolved, symbol, CASE WHEN id IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS confidence FROM i LEFT JOIN f ON split_part(value, '.', 1) = id""")
def resolve_gene_ids(spark, sf_dir):
    part = _read(spark, sf_dir, "part")
    gene = F.concat(F.lit("ENSG"), F.col("p_partkey"))
    asked = F.concat(F.when(F.col("p_size") > 10, "ENSG").otherwise("ENSX"), F.col("p_partkey"))
    inputs = part.select(F.col("p_partkey").alias("ordinal"), F.when(F.col("p_partkey") % 2 == 0, F.concat(asked, F.lit("."), F.col("p_size"))).otherwise(asked).alias("value"))
    old = part.select(gene.alias("ensembl_gene_id"), F.lit("old").alias("symbol"), F.lit(None).cast("string").alias("assembly"))
    new = part.select(gene.alias("ensembl_gene_id"), F.col("p_brand").alias("symbol"), F.lit("v2").alias("assembly"))
    return vocabulary.resolve_gene_ids(inputs, old.union(new))


@_register("""WITH o AS (SELECT * FROM (VALUES ('Supplier#', 'any'), ('Supplier#00000001', 'few'), ('Supplier#0000000', 'some')) t(prefix, name))
SELECT DISTINCT s_name AS value, coalesce((SELECT name FROM o WHERE starts_with(s_name, prefix) ORDER BY length(prefix) DESC LIMIT 1), 'unknown') AS organism FROM supplier""")
def longest_prefix(spark, sf_dir):
    organisms = spark.createDataFrame([("Supplier#", "any"), ("Supplier#00000001", "few"), ("Supplier#0000000", "some")], "prefix string, name string")
    return vocabulary.detect_organism(_read(spark, sf_dir, "supplier").select(F.col("s_name").alias("value")), organisms)


@_register(f"""WITH {_INPUTS}, t AS (SELECT p_brand AS term_id, min(p_type) AS name, string_agg(p_type, ' | ' ORDER BY p_partkey) AS synonyms FROM part GROUP BY 1),
k AS (SELECT lower(trim(name)) AS key, 0 AS level, term_id, name FROM t UNION ALL SELECT lower(trim(unnest(string_split(synonyms, ' | ')))), 1, term_id, name FROM t),
b AS (SELECT key, min((level, term_id, name)) AS m FROM k GROUP BY 1)
SELECT ordinal, value, m[2] AS term_id, m[3] AS resolved, CASE m[1] WHEN 0 THEN 1.0 WHEN 1 THEN 0.9 ELSE 0.0 END::DOUBLE AS confidence FROM inputs LEFT JOIN b ON lower(trim(value)) = key""")
def resolve_terms(spark, sf_dir):
    part = _read(spark, sf_dir, "part")
    terms = part.groupBy(F.col("p_brand").alias("term_id")).agg(F.min("p_type").alias("name"), F.array_join(F.collect_list("p_type"), " | ").alias("synonyms"), F.lit(False).alias("is_obsolete"))
    return vocabulary.resolve_terms(_inputs(spark, sf_dir), terms)


_TREE = """tree AS (SELECT 'P:' || p_partkey AS child, 'P:' || p_partkey // 2 AS parent FROM part WHERE p_partkey > 1)"""


def _tree(spark, sf_dir):
    terms = _read(spark, sf_dir, "part").where("p_partkey > 1").select(F.concat(F.lit("P:"), F.col("p_partkey")).alias("term_id"), F.array(F.concat(F.lit("P:"), F.floor(F.col("p_partkey") / 2)), F.lit("Q:1")).alias("parent_ids"))
    return vocabulary.edges(terms)


def _starts(spark, *keys):
    return spark.createDataFrame([(f"P:{k}",) for k in keys], "start string")


@_register(f"""WITH RECURSIVE {_TREE}, w AS (SELECT unnest(['P:150', 'P:77', 'P:3']) AS start, CAST(NULL AS VARCHAR) AS node, 0 AS depth UNION ALL
SELECT start, parent, depth + 1 FROM w JOIN tree ON child = coalesce(node, start) WHERE depth < 30) SELECT start, node, CAST(min(depth) AS INTEGER) AS depth FROM w WHERE depth > 0 GROUP BY ALL""")
def onto_ancestors(spark, sf_dir):
    return vocabulary.walk(_tree(spark, sf_dir), _starts(spark, 150, 77, 3))


@_register(f"""WITH RECURSIVE {_TREE}, w AS (SELECT unnest(['P:5', 'P:77']) AS start, CAST(NULL AS VARCHAR) AS node, 0 AS depth UNION ALL
SELECT start, child, depth + 1 FROM w JOIN tree ON parent = coalesce(node, start) WHERE depth < 4) SELECT start, node, CAST(min(depth) AS INTEGER) AS depth FROM w WHERE depth > 0 GROUP BY ALL""")
def onto_descendants(spark, sf_dir):
    return vocabulary.walk(_tree(spark, sf_dir), _starts(spark, 5, 77), max_depth=4, down=True)


@_register(f"""WITH {_TREE} SELECT DISTINCT a.child AS start, b.child AS node FROM tree a JOIN tree b ON a.parent = b.parent WHERE a.child IN ('P:5', 'P:77', 'P:150') AND a.child <> b.child""")
def onto_siblings(spark, sf_dir):
    return vocabulary.siblings(_tree(spark, sf_dir), _starts(spark, 5, 77, 150))


@_register("""WITH c AS (SELECT p_partkey AS uid, p_brand || CASE p_partkey % 5 WHEN 0 THEN ' + ' WHEN 1 THEN '&' WHEN 2 THEN ' ; ' WHEN 3 THEN '|' ELSE ', ' END || p_type || '+' AS v FROM part)
SELECT uid, array_to_string(list_filter(list_transform(regexp_split_to_array(trim(v), '\\s*[+&;|]\\s*|\\s*,\\s+'), lambda x: trim(x)), lambda x: x <> ''), '/') AS members FROM c""")
def combo_parse(spark, sf_dir):
    key = F.col("p_partkey") % 5
    sep = F.when(key == 0, " + ").when(key == 1, "&").when(key == 2, " ; ").when(key == 3, "|").otherwise(", ")
    part = _read(spark, sf_dir, "part")
    return part.select(F.col("p_partkey").alias("uid"), F.array_join(labels.split_combination(F.concat("p_brand", sep, "p_type", F.lit("+"))), "/").alias("members"))


_METHODS = ("CRISPR-KO", "crispr interference screen", "dCas9-VP64", "CRISPR", "siRNA pool", "sh RNA", "ASO", "ORF library", "none", "crispri")


@_register("""WITH m AS (SELECT p_partkey AS uid, (['CRISPR-KO', 'crispr interference screen', 'dCas9-VP64', 'CRISPR', 'siRNA pool', 'sh RNA', 'ASO', 'ORF library', 'none', 'crispri'])[p_partkey % 10 + 1] AS v FROM part)
SELECT uid, CASE WHEN regexp_matches(v, '(?i)crispr[\\s_-]?ko|crispr.*knockout|cas9.*ko') THEN 'CRISPRko' WHEN regexp_matches(v, '(?i)crispr[\\s_-]?i|crispr.*interference|dcas9.*krab') THEN 'CRISPRi'
WHEN regexp_matches(v, '(?i)crispr[\\s_-]?a|crispr.*activation|dcas9.*vp64|dcas9.*p65') THEN 'CRISPRa' WHEN regexp_matches(v, '(?i)\\bsi[\\s_-]?rna\\b|small.interfering.rna') THEN 'siRNA'
WHEN regexp_matches(v, '(?i)\\bsh[\\s_-]?rna\\b|short.hairpin.rna') THEN 'shRNA' WHEN regexp_matches(v, '(?i)\\baso\\b|antisense.oligo') THEN 'ASO'
WHEN regexp_matches(v, '(?i)overexpression|over[\\s_-]?express|oe\\b|orf\\b|gain.of.function') THEN 'overexpression' WHEN regexp_matches(v, '(?i)\\bcrispr\\b') THEN 'CRISPRko' END AS method FROM m""")
def method_classify(spark, sf_dir):
    text = F.element_at(F.array(*map(F.lit, _METHODS)), (F.col("p_partkey") % 10 + 1).cast("int"))
    return _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("uid"), labels.perturbation_method(text).alias("method"))


_LABELS = (" DMSO", "Ctrl", "TP53", "nt", "lacZ", "Empty Vector", "saline ", "etoh", "imatinib", "scrambled")


@_register("""WITH l AS (SELECT p_partkey AS uid, lower(trim(([' DMSO', 'Ctrl', 'TP53', 'nt', 'lacZ', 'Empty Vector', 'saline ', 'etoh', 'imatinib', 'scrambled'])[p_partkey % 10 + 1])) AS v FROM part)
SELECT uid, v NOT IN ('tp53', 'imatinib') AS is_control, CASE v WHEN 'dmso' THEN 'DMSO' WHEN 'ctrl' THEN 'control' WHEN 'nt' THEN 'nontargeting' WHEN 'lacz' THEN 'lacz' WHEN 'empty vector' THEN 'empty_vector'
WHEN 'saline' THEN 'saline' WHEN 'etoh' THEN 'ethanol' WHEN 'scrambled' THEN 'scramble' END AS kind FROM l""")
def control_detect(spark, sf_dir):
    text = F.element_at(F.array(*map(F.lit, _LABELS)), (F.col("p_partkey") % 10 + 1).cast("int"))
    return _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("uid"), labels.is_control_label(text).alias("is_control"), labels.negative_control_type(text).alias("kind"))


@_register("""WITH c AS (SELECT p_partkey AS uid, p_brand || CASE p_partkey % 4 WHEN 0 THEN ' hydrochloride salt' WHEN 1 THEN ' (free base)' WHEN 2 THEN ' Sodium' ELSE '' END AS v FROM part)
SELECT uid, trim(regexp_replace(regexp_replace(trim(v), '(?i)\\s*\\([^)]*(?:salt|form|hydrate|anhydrous|free\\s+base)[^)]*\\)\\s*$', ''), '(?i)\\s*\\b(hydrochloride|sodium|salt)\\b.*$', '')) AS name FROM c""")
def clean_compound(spark, sf_dir):
    key = F.col("p_partkey") % 4
    text = F.concat("p_brand", F.when(key == 0, " hydrochloride salt").when(key == 1, " (free base)").when(key == 2, " Sodium").otherwise(""))
    return _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("uid"), labels.clean_compound_name(text).alias("name"))


@_register("""WITH s AS (SELECT n_name AS name, n_nationkey AS k FROM nation)
SELECT CASE k % 4 WHEN 0 THEN 'u:' WHEN 1 THEN '' WHEN 2 THEN 'g:' ELSE 'r:' END || name AS name, CASE WHEN k < 20 THEN name END AS sequence_name, CASE WHEN k < 5 THEN 'chromosome' WHEN k < 20 THEN 'scaffold' ELSE 'other' END AS role FROM s""")
def sequence_lookup(spark, sf_dir):
    nation = _read(spark, sf_dir, "nation")
    k, name = F.col("n_nationkey"), F.col("n_name")
    role = labels.sequence_role(F.when(k < 5, "assembled-molecule").otherwise("unplaced-scaffold"), F.lit("Chromosome"))
    other = lambda prefix: F.concat(F.lit(prefix), name)
    table = nation.where(k < 20).select(name.alias("sequence_name"), role.alias("sequence_role"), other("u:").alias("ucsc_name"), other("g:").alias("genbank_accession"), other("r:").alias("refseq_accession"))
    asked = F.when(k % 4 == 0, other("u:")).when(k % 4 == 1, name).when(k % 4 == 2, other("g:")).otherwise(other("r:"))
    return vocabulary.lookup_sequences(nation.select(asked.alias("name")), table)


@_register("""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'pmid' WHEN page_id % 3 = 1 THEN 'doi' WHEN contains(url, '/10.') THEN 'doi' ELSE 'title' END AS kind FROM pages""")
def publication_type(spark, sf_dir):
    pages = _read(spark, sf_dir, "pages")
    key = F.col("page_id")
    text = F.when(key % 3 == 0, F.concat(F.lit(" "), key.cast("string"))).when(key % 3 == 1, F.concat(F.lit("10."), key.cast("string"))).otherwise(F.col("url"))
    return pages.select("page_id", labels.publication_id_type(text).alias("kind"))


# --- search


def _knn(spark, sf_dir, metric):
    emb = _read(spark, sf_dir, "embeddings")
    queries = emb.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))
    return search.nearest_each(emb, "embedding", "vec_id", queries, 10, metric).select("query", "rank", "vec_id", F.round("distance", 5).alias("distance"))


def _knn_sql(expression: str) -> str:
    return f"""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), p AS (SELECT a.vec_id AS query, b.vec_id, {expression} AS d FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
r AS (SELECT query, CAST(row_number() OVER (PARTITION BY query ORDER BY d, vec_id) AS INTEGER) AS rank, vec_id, round(d, 5) AS distance FROM p) SELECT * FROM r WHERE rank <= 10"""


@_register(_knn_sql("list_distance(b.e, a.e)"))
def knn_l2(spark, sf_dir):
    return _knn(spark, sf_dir, "l2")


@_register(_knn_sql("1 - list_cosine_similarity(b.e, a.e)"))
def knn_cosine(spark, sf_dir):
    return _knn(spark, sf_dir, "cosine")


@_register(_knn_sql("-list_inner_product(b.e, a.e)"))
def knn_dot(spark, sf_dir):
    return _knn(spark, sf_dir, "dot")


_BM25 = """q AS (SELECT unnest(['the', 'ouwhea', 'rights']) AS word),
d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT count(*) AS docs, avg(len(ws)) AS mean FROM d),
t AS (SELECT doc_id, n, word, count(*) AS tf FROM (SELECT doc_id, len(ws) AS n, unnest(ws) AS word FROM d) WHERE word IN (SELECT word FROM q) GROUP BY ALL),
r AS (SELECT word, count(*) AS df FROM t GROUP BY 1),
hits AS (SELECT doc_id AS doc, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))), 5) AS score FROM t JOIN r USING (word), s GROUP BY doc_id)"""


@_register(f"WITH {_BM25} SELECT * FROM hits")
def bm25(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text")
    asked = spark.createDataFrame([(0, "The ouwhea RIGHTS")], "query int, text string")
    return search.bm25(asked, docs).select("doc", F.round("score", 5).alias("score"))


@_register(f"""WITH {_BM25}, e AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), m AS (SELECT avg(x) AS x, i FROM (SELECT unnest(e) AS x, unnest(range(len(e))) AS i FROM e) GROUP BY i),
c AS (SELECT list(x ORDER BY i) AS c FROM m), v AS (SELECT vec_id AS key, row_number() OVER (ORDER BY round(list_distance(e, c), 6), vec_id) AS r FROM e, c QUALIFY r <= 100),
best AS (SELECT doc AS key, row_number() OVER (ORDER BY score DESC, doc) AS r FROM hits QUALIFY r <= 100)
SELECT key, round(sum(1.0 / (60 + r)), 9) AS score FROM (SELECT * FROM v UNION ALL SELECT * FROM best) GROUP BY 1""")
def hybrid_fusion(spark, sf_dir):
    """The hundred vectors nearest to the mean of all, and the hundred best documents for a text, fused by rank."""
    emb = _read(spark, sf_dir, "embeddings")
    mean = emb.select(F.posexplode("embedding").alias("i", "x")).groupBy("i").agg(F.avg(F.col("x").cast("double")).alias("x")).orderBy("i").collect()  # a row for each dimension
    near = emb.withColumn("distance", F.round(search.distance(F.col("embedding"), F.lit([r["x"] for r in mean])), 6)).orderBy("distance", "vec_id").limit(100)
    best = bm25(spark, sf_dir).orderBy(F.desc("score"), "doc").limit(100)
    return search.fuse(near.select(F.col("vec_id").alias("key"), "distance"), best.select(F.col("doc").alias("key"), "score")).select("key", F.round("score", 9).alias("score"))


# --- batches


@_register(f"""WITH {_CELLS}, p AS (SELECT uid, grp, md5(uid || ':' || '45') AS k FROM cells), o AS (SELECT uid, grp, row_number() OVER (ORDER BY k, uid) - 1 AS ordinal FROM p)
SELECT uid, CAST(grp AS VARCHAR) AS grp, 0 AS worker, ordinal, ordinal // 256 AS worker_batch, ordinal // 256 AS batch FROM o""")
def batch_plan(spark, sf_dir):
    cells = driver_atlas(spark, sf_dir, pointers=False).cells.select("uid", F.col("dataset_uid").alias("grp"))
    plan = batches.batch_plan(cells, 256, seed=42, epoch=3)
    nation = _read(spark, sf_dir, "nation").select("n_name", F.col("n_nationkey").cast("string").alias("g"))
    return plan.join(F.broadcast(nation), F.col("grp") == F.col("n_name")).select("uid", F.col("g").alias("grp"), "worker", "ordinal", "worker_batch", "batch")


@_register(f"""WITH RECURSIVE {_CELLS}, g AS (SELECT n_name, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, lpad(n_name, 20, '0')) AS k FROM cells GROUP BY 1),
w AS (SELECT CAST(0 AS BIGINT) AS k, [0, 0, 0, 0]::BIGINT[] AS loads, CAST(NULL AS VARCHAR) AS grp, CAST(0 AS BIGINT) AS worker UNION ALL
  SELECT g.k, list_transform(loads, lambda x, i: CASE WHEN i = list_position(loads, list_min(loads)) THEN x + g.n ELSE x END), g.n_name, list_position(loads, list_min(loads)) - 1 FROM w JOIN g ON g.k = w.k + 1),
o AS (SELECT uid, w.grp AS grp, CAST(worker AS INTEGER) AS worker, row_number() OVER (PARTITION BY worker ORDER BY md5(uid || ':' || '42'), uid) - 1 AS ordinal, count(*) OVER (PARTITION BY worker) AS n FROM cells JOIN w ON n_name = w.grp),
b AS (SELECT uid, grp, worker, ordinal, ordinal // 256 AS worker_batch FROM o WHERE (ordinal // 256 + 1) * 256 <= n),
r AS (SELECT worker, worker_batch, row_number() OVER (ORDER BY worker_batch, worker) - 1 AS batch FROM (SELECT DISTINCT worker, worker_batch FROM b))
SELECT uid, b.grp, worker, ordinal, worker_batch, batch FROM b JOIN r USING (worker, worker_batch)""")
def batch_plan_workers(spark, sf_dir):
    cells = driver_atlas(spark, sf_dir, pointers=False).cells.select("uid", F.col("dataset_uid").alias("grp"))
    return batches.batch_plan(cells, 256, seed=42, drop_last=True, workers=4)


@_register(f"""WITH {_CELLS}, c AS (SELECT uid, row_number() OVER (ORDER BY md5(uid || ':' || '0'), uid) - 1 AS ordinal FROM cells WHERE has_sales AND o_orderstatus = 'P')
SELECT ordinal // 64 AS batch, count(DISTINCT uid) AS n_cells, count(DISTINCT (uid, l_partkey)) AS n_values, sum(l_quantity) AS total FROM c JOIN lineitem ON uid = l_orderkey GROUP BY 1""")
def cell_dataset(spark, sf_dir):
    _, rows = driver_atlas(spark, sf_dir).query().where("o_orderstatus = 'P'").to_cell_dataset(SALES, batch_size=64)
    total = F.aggregate("values", F.lit(0.0), lambda a, x: a + x)
    return rows.select("batch", F.size("uids").cast("long").alias("n_cells"), F.size("values").cast("long").alias("n_values"), total.alias("total"))


# --- further terminals, resolvers and records


@_register(f"""WITH {_CELLS}, {_LAYOUT}, c AS (SELECT uid, grp, c_mktsegment FROM cells WHERE grp < 3 AND has_sales),
f AS (SELECT feature FROM layout WHERE grp < 3 AND grp IN (SELECT grp FROM c) GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT grp) FROM c)),
v AS (SELECT uid, l_partkey AS feature, sum(l_quantity) AS value FROM lineitem JOIN c ON l_orderkey = uid WHERE l_partkey IN (SELECT feature FROM f) GROUP BY ALL),
x AS (SELECT uid, feature, CAST(ln(1 + value * 10000.0 / sum(value) OVER (PARTITION BY uid)) AS FLOAT) AS x FROM v),
sizes AS (SELECT c_mktsegment AS grp, count(*) AS n FROM c GROUP BY 1),
m AS (SELECT c_mktsegment AS grp, feature, exp(sum(CAST(x AS DOUBLE)) / any_value(n)) - 1 AS mean FROM x JOIN c USING (uid) JOIN sizes ON c_mktsegment = sizes.grp GROUP BY ALL),
grid AS (SELECT feature, s.grp AS target, s.n AS target_n FROM (SELECT DISTINCT feature FROM x), sizes s WHERE s.grp <> 'AUTOMOBILE')
SELECT target, g.feature, target_n, round(coalesce(t.mean, 0), 6) AS target_mean, round(coalesce(r.mean, 0), 6) AS ref_mean
FROM grid g LEFT JOIN m t ON t.grp = target AND t.feature = g.feature LEFT JOIN m r ON r.grp = 'AUTOMOBILE' AND r.feature = g.feature""")
def dex_atlas(spark, sf_dir):
    """Market segments compared on the parts that every nation among the first three sold."""
    chosen = driver_atlas(spark, sf_dir).query().where(F.col(f"{SALES}.grp").cast("int") < 3)
    out = chosen.dex(SALES, "c_mktsegment", _segment_names(spark, sf_dir)[1], "AUTOMOBILE")
    return out.select("target", "feature", "target_n", F.round("target_mean", 6).alias("target_mean"), F.round("ref_mean", 6).alias("ref_mean"))


@_register(f"""WITH {_CELLS}, e AS (SELECT vec_id AS uid, unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS feature, CASE label % 3 WHEN 0 THEN 'control' WHEN 1 THEN 'a' ELSE 'b' END AS grp FROM embeddings),
c AS (SELECT grp, feature, round(x, 1) AS x, count(*) AS c FROM e GROUP BY ALL), n AS (SELECT grp, count(DISTINCT uid) AS n FROM e GROUP BY 1),
p AS (SELECT t.target, feature, x, sum(CASE WHEN c.grp = t.target THEN c ELSE 0 END) AS a, sum(CASE WHEN c.grp = 'control' THEN c ELSE 0 END) AS b FROM (SELECT grp AS target FROM n WHERE grp <> 'control') t JOIN c ON c.grp IN (t.target, 'control') GROUP BY ALL),
r AS (SELECT *, sum(a + b) OVER (PARTITION BY target, feature ORDER BY x) - (a + b) + (a + b + 1) / 2 AS rank FROM p)
SELECT target, feature, CAST(sum(a * rank) - any_value(ta.n) * (any_value(ta.n) + 1) / 2 AS DOUBLE) AS u, CAST(sum(CAST(a + b AS DOUBLE) ** 3 - (a + b)) AS DOUBLE) AS tie, any_value(ta.n) AS n_a, any_value(tb.n) AS n_b
FROM r JOIN n ta ON ta.grp = target JOIN n tb ON tb.grp = 'control' GROUP BY target, feature""")
def mwu_dense(spark, sf_dir):
    emb = _read(spark, sf_dir, "embeddings")
    grp = F.when(F.col("label") % 3 == 0, "control").when(F.col("label") % 3 == 1, "a").otherwise("b")
    rounded = F.transform("embedding", lambda x: F.round(x.cast("double"), 1))
    out = dex.rank_sums_dense(emb.select(F.col("vec_id").alias("uid"), rounded.alias("values")), emb.select(F.col("vec_id").alias("uid"), grp.alias("grp")), "control")
    return out.withColumn("feature", F.col("feature").cast("long"))


@_register(f"""WITH {_CELLS} SELECT uid, l_partkey AS global_index, sum(l_quantity) AS quantity FROM lineitem JOIN cells ON l_orderkey = uid WHERE l_partkey IN (3, 7, 11, 40) GROUP BY ALL""")
def csc_pinned(spark, sf_dir):
    """Pinned parts read from values kept in order of feature for some nations, and from the plain ones for the others."""
    from dataclasses import replace

    atlas = driver_atlas(spark, sf_dir)
    values = atlas.values[SALES]
    kept = matrix.csc_order(values.where("grp < 12"))
    both = replace(atlas, by_feature={SALES: (kept, tuple(range(12)))})
    return both.query().features([3, 7, 11, 40], SALES).to_matrix(SALES).x


@_register(f"""WITH {_FRAGMENTS}, {_RANGES}, all_ AS (SELECT chrom, start, "end" FROM r UNION ALL SELECT 'nowhere', 0, 10),
p AS (SELECT row_number() OVER (ORDER BY chrom, start) - 1 AS range_id, chrom, start, "end", chrom || ':' || start || '-' || "end" AS name FROM all_),
h AS (SELECT range_id, count(DISTINCT cell) AS n FROM f JOIN p ON f.chrom = p.chrom AND f.start < p."end" AND f.start + f.length > p.start GROUP BY 1)
SELECT p.*, coalesce(n, 0) AS n_cells FROM p LEFT JOIN h USING (range_id)""")
def peak_var(spark, sf_dir):
    nowhere = spark.createDataFrame([("nowhere", 0, 10, None)], "chrom string, start long, end long, name string")
    return intervals.count_matrix(_fragments(spark, sf_dir), _ranges(spark, sf_dir).union(nowhere))[1]


@_register(f"""WITH {_FRAGMENTS}, c AS (SELECT DISTINCT cell FROM f WHERE cell % 3 = 0), n AS (SELECT cell, count(f.chrom) AS n FROM c LEFT JOIN f USING (cell) GROUP BY 1)
SELECT cell, n, CAST(sum(n) OVER (ORDER BY cell) - n AS BIGINT) AS begin, CAST(sum(n) OVER (ORDER BY cell) AS BIGINT) AS "end" FROM n""")
def fragment_offsets(spark, sf_dir):
    fragments = _fragments(spark, sf_dir)
    return intervals.joint_fragments(fragments, fragments.where("cell % 3 = 0").select("cell"))[1]


@_register(f"""WITH {_FRAGMENTS}, n AS (SELECT DISTINCT chrom FROM f), g AS (SELECT chrom, CAST(row_number() OVER (ORDER BY chrom) - 1 AS INTEGER) AS global_chrom FROM n)
SELECT cell, global_chrom, count(*) AS n FROM f JOIN g USING (chrom) GROUP BY ALL""")
def joint_chromosomes(spark, sf_dir):
    fragments = _fragments(spark, sf_dir)
    return intervals.joint_fragments(fragments, fragments.select("cell"))[0].groupBy("cell", "global_chrom").agg(F.count("*").alias("n"))


@_register(f"""WITH {_CELLS}, n AS (SELECT grp, CAST(row_number() OVER (ORDER BY CAST(grp AS VARCHAR)) - 1 AS INTEGER) AS group_id FROM cells WHERE has_sales GROUP BY grp),
k AS (SELECT uid, has_sales AS sales, has_profile AS profile, CASE WHEN has_sales THEN group_id ELSE (SELECT count(*) FROM n) END AS grp FROM cells LEFT JOIN n USING (grp)),
o AS (SELECT *, row_number() OVER (ORDER BY md5(uid || ':' || '5'), uid) - 1 AS ordinal FROM k)
SELECT uid, CAST(grp AS BIGINT) AS grp, ordinal, ordinal // 128 AS batch, sales, profile FROM o""")
def multimodal_plan(spark, sf_dir):
    data = driver_atlas(spark, sf_dir).query().to_multimodal_dataset([SALES, PROFILE], {SALES: "quantity", PROFILE: "raw"}, batch_size=128, seed=5)
    return data.plan.select("uid", F.col("grp").cast("long").alias("grp"), "ordinal", "batch", SALES, PROFILE)


@_register("""SELECT p_partkey AS ordinal, p_type AS value, resolved, confidence, alternatives, protein_name FROM part
LEFT JOIN (SELECT p_type, min(p_brand) AS resolved, CASE WHEN count(DISTINCT p_brand) = 1 THEN 0.9 ELSE 0.7 END::DOUBLE AS confidence, array_to_string(list_sort(list(DISTINCT p_brand))[2:], '; ') AS alternatives FROM part GROUP BY 1) USING (p_type)
LEFT JOIN (SELECT p_brand AS resolved, 'P ' || p_brand AS protein_name FROM part GROUP BY 1) USING (resolved)""")
def resolve_proteins(spark, sf_dir):
    part = _read(spark, sf_dir, "part")
    aliases = part.select(F.lower("p_type").alias("alias"), F.col("p_brand").alias("id"), F.lit(False).alias("is_canonical"))
    none = F.lit(None).cast("string")
    proteins = part.select(F.col("p_brand").alias("uniprot_id"), F.concat(F.lit("P "), F.col("p_brand")).alias("protein_name"), none.alias("gene_name"), none.alias("sequence"), F.lit(None).cast("long").alias("sequence_length"))
    out = vocabulary.resolve_proteins(part.select(F.col("p_partkey").alias("ordinal"), F.col("p_type").alias("value")), aliases, proteins)
    return vocabulary.report_frame(out).select("ordinal", "value", "resolved", "confidence", "alternatives", "protein_name")


@_register("""WITH i AS (SELECT p_partkey AS ordinal, CASE WHEN p_partkey % 3 = 0 THEN ' ' || p_partkey ELSE 'x' || p_partkey END AS value FROM part)
SELECT ordinal, value, CASE WHEN p_partkey IS NULL THEN NULL WHEN p_partkey % 2 = 0 THEN p_type ELSE CAST(p_partkey AS VARCHAR) END AS resolved, p_partkey AS cid, CASE WHEN p_partkey IS NULL THEN 0.0 ELSE 0.95 END::DOUBLE AS confidence
FROM i LEFT JOIN part ON TRY_CAST(trim(value) AS BIGINT) = p_partkey""")
def resolve_molecules(spark, sf_dir):
    part, key = _read(spark, sf_dir, "part"), F.col("p_partkey")
    compounds = part.select(key.alias("cid"), F.when(key % 2 == 0, F.col("p_type")).alias("name"), F.lit(None).cast("string").alias("canonical_smiles"))
    synonyms = spark.createDataFrame([], "synonym string, synonym_original string, cid long, is_title boolean")
    asked = part.select(key.alias("ordinal"), F.when(key % 3 == 0, F.concat(F.lit(" "), key)).otherwise(F.concat(F.lit("x"), key)).alias("value"))
    return vocabulary.resolve_molecules(asked, compounds, synonyms, "cid").select("ordinal", "value", "resolved", "cid", "confidence")


@_register("""SELECT 'G' || p_partkey AS accession, p_type AS title, lower(p_brand) AS brand, CASE WHEN p_size > 25 THEN '' END AS big, CAST(1 + p_size % 2 AS INTEGER) AS n_series FROM part""")
def soft_records(spark, sf_dir):
    from polyatlas.sources import records

    p = _read(spark, sf_dir, "part")
    line = lambda name, value: F.concat(F.lit(f"!Sample_{name} = "), value, F.lit("\n"))
    text = F.concat(
        F.lit("^SAMPLE = x\n"), line("geo_accession", F.concat(F.lit("G"), F.col("p_partkey"))), line("title", F.col("p_type")), line("characteristics_ch1", F.concat(F.lit("Brand: "), F.lower("p_brand"))),
        F.when(F.col("p_size") > 25, line("characteristics_ch1", F.lit("Big"))).otherwise(""), line("series_id", F.lit("E1")), F.when(F.col("p_size") % 2 == 1, line("series_id", F.lit("E2"))).otherwise(""),
    )
    got = records.geo_samples(p.select(text.alias("text")))
    value = lambda k: F.try_element_at("characteristics", F.lit(k))
    return got.select("accession", "title", value("brand").alias("brand"), value("big").alias("big"), F.size("series_ids").alias("n_series"))


@_register("""SELECT p_partkey AS pmid, p_type AS title, '10.1/' || p_partkey AS doi, CAST(1950 + p_size AS INTEGER) AS year, 'Methods > ' || p_brand AS section FROM part""")
def xml_records(spark, sf_dir):
    from polyatlas.sources import records

    p = _read(spark, sf_dir, "part")
    text = lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts))
    key, title = F.col("p_partkey").cast("string"), F.regexp_replace(F.regexp_replace("p_type", "&", "&amp;"), "<", "&lt;")
    xml = text(
        "<s><PubmedArticle><MedlineCitation><PMID>", key, "</PMID><Article><Journal><JournalIssue><PubDate><MedlineDate>", (1950 + F.col("p_size")).cast("string"), " Spring</MedlineDate></PubDate></JournalIssue></Journal><ArticleTitle>", title,
        "</ArticleTitle></Article></MedlineCitation><PubmedData><ArticleIdList><ArticleId IdType='doi'>10.1/", key, "</ArticleId></ArticleIdList></PubmedData></PubmedArticle></s>",
    )
    body = text("<a><body><sec><title>Methods</title><sec><title>", F.col("p_brand"), "</title><p>x</p></sec></sec></body></a>")
    found = records.publications(p.select(xml.alias("xml"))).select("pmid", "title", "doi", F.year("publication_date").alias("year"))
    sections = p.select(F.col("p_partkey").alias("pmid"), F.get(records.full_text(body), F.lit(0))["section_title"].alias("section"))
    return found.join(sections, "pmid")
