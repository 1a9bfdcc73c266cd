"""URL judgement, nearest neighbours, components and the pipeline."""

from __future__ import annotations

import os

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from polyatlas.llm import ann, components, langid, queries, store, urlgraph


def _judge(url, rules=urlgraph.RULES):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = rest[:cut].translate({i: i + 32 for i in range(65, 91)}), rest[cut:]
    path = tail[: min([tail.index(c) for c in "?#" if c in tail], default=len(tail))]
    fits = [r for _, r in rules if (host == r.split("/", 1)[0] or host.endswith("." + r.split("/", 1)[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return host, path, max(fits, key=lambda r: (len(r), r.index("/")), default=None)


ODD_URLS = [None, "", "no scheme", "http://", "HTTP://A.ORG", "http://A.org/", "x://example.org/es/1?q", "x://a.example.org/en/1#f", "x://notorg/en", "x://b.com/fr/", "x://b.com/fr", "x://b.com/de/x://c", "x://h?x/y", "http://u@v.org:80/p"]


def test_rules_against_brute_force(spark, sf_dir):
    urls = [r["url"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()] + ODD_URLS
    df = spark.createDataFrame([(i, u, None, 1) for i, u in enumerate(urls)] + [(0, urls[0], "<a>", 2)], "page_id int, url string, html string, rule int")
    out = urlgraph.judge_pages(df).collect()
    assert len(out) == len(urls) + 1
    kinds = {r: v for v, r in urlgraph.RULES}
    for r in out:
        assert (r["host"], r["path"], r["rule"]) == _judge(urls[r["page_id"]])
        assert r["verdict"] == kinds.get(r["rule"], r["verdict"]) and r["verdict"] in ("allow", "block")
    assert urlgraph.judge_pages(df.where("false")).count() == 0


def _pagerank(edges, seeds, damping, steps):
    out, ranks = {}, dict(seeds)
    for s, _, w in edges:
        out[s] = out.get(s, 0) + w
    for _ in range(steps):
        new: dict = {}
        for s, d, w in edges:
            new[d] = new.get(d, 0) + damping * ranks.get(s, 0) * w / out[s]
        going = sum(v for k, v in ranks.items() if k in out)
        for k, v in seeds.items():
            new[k] = new.get(k, 0) + v * (1 - damping * going)
        ranks = new
    return ranks


def test_trust_propagation(spark):
    html = lambda *hosts: " ".join(f'<a href="https://{h}/x">' for h in hosts)
    pages = [(0, "http://good.org/", html("friend.net", "x.net")), (1, "http://friend.net/a", html("second.net")), (2, "http://liker.net/", html("bad.com")), (3, "http://bad.com/de/", html("x.net")), (4, "http://second.net/", ""), (5, "http://alone.net/", None)]
    df = spark.createDataFrame(pages, "page_id int, url string, html string")
    got = {r["page_id"]: r for r in urlgraph.judge_pages(df).collect()}
    assert {k: r["verdict"] for k, r in got.items()} == {0: "allow", 1: "allow", 2: "block", 3: "block", 4: "allow", 5: "allow"}
    edges = [("good.org", "friend.net", 1), ("good.org", "x.net", 1), ("friend.net", "second.net", 1), ("liker.net", "bad.com", 1), ("bad.com", "x.net", 1)]
    trust = _pagerank(edges, {"good.org": 1.0}, urlgraph.DAMPING, 200)
    distrust = _pagerank([(d, s, w) for s, d, w in edges], {"bad.com": 1.0}, urlgraph.DAMPING, 200)
    for r in got.values():
        assert r["trust"] == pytest.approx(trust.get(r["host"], 0)) and r["distrust"] == pytest.approx(distrust.get(r["host"], 0))


def test_trust_reaches_far_and_settles(spark):
    """A chain longer than any fixed number of steps, and a cycle."""
    edges = [(f"h{i:02}", f"h{i + 1:02}", 1) for i in range(14)] + [("a", "b", 2), ("b", "a", 1), ("b", "c", 1)]
    for seeds in ({"h00": 1.0}, {"a": 0.75, "c": 0.25}):
        got = urlgraph.personalised_pagerank(spark.createDataFrame(edges, "src string, dst string, weight long"), spark.createDataFrame([*seeds.items()], "host string, seed double"), tolerance=1e-4).collect()
        want = _pagerank(edges, seeds, urlgraph.DAMPING, 400)
        assert {r["host"] for r in got} == {h for h, v in want.items() if v > 0}
        assert {r["host"]: r["rank"] for r in got} == pytest.approx({h: v for h, v in want.items() if v > 0}, rel=1e-3)


def _exact(x, ids, query, k=10):
    v = x[ids == query][0]
    d = np.sqrt(((x - v) ** 2).sum(axis=1))
    d[ids == query] = np.inf
    order = np.lexsort((ids, d))[:k]
    return [(int(ids[i]), d[i]) for i in order if np.isfinite(d[i])]


def test_neighbours_recall(spark, sf_dir):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 24)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    vectors = ann.usable(df)
    out = ann.search(ann.build_index(vectors, shard_vectors=1000), vectors.where("vec_id % 100 = 0")).toPandas()
    ids, hit = np.arange(3000), 0
    for query, rows in out.groupby("query_id"):
        rows = rows.sort_values("rank")
        want = _exact(x.astype(float), ids, query)
        hit += len({v for v, _ in want} & set(rows["vec_id"]))
        assert rows["rank"].tolist() == list(range(1, 11)) and (np.diff(rows["score"]) >= 0).all()
        for v, s in zip(rows["vec_id"], rows["score"], strict=True):
            assert s == pytest.approx(np.linalg.norm(x[v].astype(float) - x[query].astype(float)), rel=1e-12)
    assert hit >= 0.9 * 10 * out["query_id"].nunique()


def test_blocks_of_queries_are_not_broadcast(spark, monkeypatch):
    """A block goes to every shard, so all copies of the queries are as many times as large as Spark expects of them."""
    plans, write = [], ann.materialize
    monkeypatch.setattr(ann, "materialize", lambda df, name: (plans.append(df._jdf.queryExecution().executedPlan().toString()), write(df, name))[1])
    vectors = ann.usable(spark.createDataFrame([(i, [float(i % 7), 1.0 + i]) for i in range(300)], "vec_id long, embedding array<double>"))
    out = ann.search(ann.build_index(vectors, shard_vectors=100), vectors.where("vec_id % 100 = 0"))
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert not any("BroadcastHashJoin" in p for p in plans) and out.count() == 30


def test_neighbours_far_from_the_origin(spark):
    """Recall under a common offset, and of a query id that is repeated."""
    rng = np.random.default_rng(6)
    x = 1e5 + rng.normal(size=(2000, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    vectors = ann.usable(spark.createDataFrame(rows + rows[:300:100] * 4, "vec_id long, embedding array<double>"))
    out = ann.search(ann.build_index(vectors, shard_vectors=700), vectors.where("vec_id % 100 = 0")).toPandas()
    hit = 0
    for query, own in out.groupby("query_id"):
        assert sorted(own["rank"]) == list(range(1, 11)) and own["vec_id"].nunique() == 10
        hit += len({v for v, _ in _exact(x, np.arange(2000), query)} & set(own["vec_id"]))
    assert hit >= 0.9 * 200 and out["query_id"].nunique() == 20


def test_neighbours_ids_with_several_vectors(spark):
    rows = [(0, [1.0, 0.0]), (0, [9.0, 0.0]), (1, [1.5, 0.0]), (2, [8.0, 0.0]), (2, [1.25, 0.0]), (3, [1e200, 0.0]), (4, [1.2e200, 5.0])]
    vectors = ann.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = ann.search(ann.build_index(vectors), vectors.where("vec_id in (0, 3)")).orderBy("query_id", "rank").collect()
    assert [(r["vec_id"], r["score"]) for r in got if r["query_id"] == 0] == [(2, 0.25), (1, 0.5), (3, 1e200), (4, 1.2e200)]
    assert [(r["vec_id"], r["score"]) for r in got if r["query_id"] == 3] == [(4, pytest.approx(2e199)), (0, 1e200), (1, 1e200), (2, 1e200)]


def test_neighbours_odd_rows(spark):
    rows = [(i, [1.0, 2.0]) for i in range(0, 1500, 5)] + [(1, None), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [None, 1.0]), (6, [3.0, 4.0]), (7, [1.0]), (8, []), (9, [float("inf"), 0.0]), (100, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit(1))
    vectors = ann.usable(df)
    out = ann.search(ann.build_index(vectors), vectors.where("vec_id % 100 = 0")).collect()
    assert {r["query_id"] for r in out} == set(range(0, 1500, 100))
    for query in range(0, 1500, 100):
        got = [r["vec_id"] for r in sorted((r for r in out if r["query_id"] == query), key=lambda r: r["rank"])]
        assert got == [i for i in range(0, 60, 5) if i != query][:10]
    few = ann.usable(spark.createDataFrame([(0, [1.0, 0.0]), (5, [0.0, 1.0]), (9, [3.0, 1.0])], "vec_id long, embedding array<double>"))
    assert [r["vec_id"] for r in ann.search(ann.build_index(few), few.where("vec_id = 0")).orderBy("rank").collect()] == [5, 9]
    empty = few.where("false")
    assert ann.search(ann.build_index(empty), empty).count() == 0


def test_components(spark):
    rng = np.random.default_rng(2)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5000 + i) for i in range(1, 50)] + [(3, 3)]
    root = {x: x for p in pairs for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    df = spark.createDataFrame([*pairs, (None, 1)], "a long, b long")
    got = {r["node"]: r["root"] for r in components.connected_components(df, "a", "b").collect()}
    loops = {x for a, b in pairs for x in (a, b)} - {x for a, b in pairs if a != b for x in (a, b)}
    assert got == {x: find(x) for x in root if x not in loops}
    assert components.connected_components(df.where("false"), "a", "b").count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_equal_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    result = con.execute(queries.ORACLES[name])
    columns = [d[0] for d in result.description]
    got = queries.QUERIES[name](spark, sf_dir).select(*columns).collect()
    assert sorted(map(tuple, got)) == sorted(result.fetchall())


def test_pipeline(spark, sf_dir, documents, odd, none):
    docs, seen = documents, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir).persist()
        seen[name] = docs
        if name != "best_fit_packing":
            assert docs.columns == documents.columns
    ids = lambda df: {r[0] for r in df.select("doc_id").distinct().collect()}
    judged = langid.identify(documents, langid.fit(documents), "doc_id")
    assert ids(seen["language_id"]) == ids(judged.where(f"lang_pred <> 'und' and noise < {langid.REJECT}"))
    assert ids(seen["line_dedup"]) == ids(seen["language_id"])
    from test_text_operators import components as brute
    from test_text_operators import cut_windows, fingerprint, similar

    texts = {r["doc_id"]: r["text"] for r in seen["line_dedup"].collect()}
    groups = brute({d: fingerprint(t) for d, t in texts.items()}, similar(texts))
    assert ids(seen["near_dedup"]) == set(groups.values())
    rows = seen["near_dedup"].orderBy("doc_id").collect()
    want = {r["doc_id"]: (kept if gone else r["text"]) for r, (_, gone, kept) in zip(rows, cut_windows([r["text"] for r in rows]), strict=True)}
    assert {r["doc_id"]: r["text"] for r in seen["substring_dedup"].collect()} == want
    assert ids(seen["best_fit_packing"]) == ids(seen["near_dedup"])
    # the stages' own column names in other case, null, empty, letterless and repeated rows, one id for two texts
    odd_docs, left = odd.withColumnsRenamed({"fp": "ROW", "row_key": "score"}), {}
    for name, stage in corpus_pipeline.STAGES:
        odd_docs = stage(spark, odd_docs, sf_dir)
        left[name] = sorted((r["doc_id"] or -1) for r in odd_docs.collect())
    assert left["language_id"] == [-1, 1, 2, 2, 2, 7, 8] == left["line_dedup"]
    assert left["near_dedup"] == [-1, 1, 2, 7] == left["substring_dedup"] and set(left["best_fit_packing"]) == {-1, 1, 2, 7}
    empty = none.select(*documents.columns)
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, sf_dir)
        assert empty.count() == 0


def test_written_tables_take_small_batches(spark):
    """Batches to Python are of bounded bytes, however long the rows, and the setting of the session is as before."""
    texts = spark.range(0, 3000, 1, 1).select(F.repeat(F.lit("x"), 10000).alias("text"))
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    sizes = texts.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"]) for b in batches), "n long")
    got = store.materialize(sizes, "sizes").agg(F.max("n"), F.sum("n")).first()
    assert got[0] <= 2 * store.BATCH_BYTES and got[1] >= 3000 * 10000
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before


def test_pipeline_deletes_intermediate_tables(spark, documents):
    folder = store.shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    with store.last_written(spark):
        kept = store.materialize(corpus_pipeline.near_dedup(spark, documents, ""), "result")
    made = set(os.listdir(folder)) - before
    assert len(made) == 1 and made.pop().startswith("result-")
    assert 0 < kept.count() < documents.count()


def test_language_stage_rejects_noise_and_keeps_prose(spark, sf_dir, documents):
    """What the network decides: made-up strings go, short, loud and mixed texts of the labelled languages stay."""
    rng = np.random.default_rng(9)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz0123456789"))
    noise = [(10**6 + i, "".join(rng.choice(letters, int(n))), None) for i, n in enumerate(rng.integers(60, 900, 40))]
    texts = [(r["doc_id"], r["text"], r["lang"]) for r in documents.collect()]
    mixed = [(2 * 10**6 + i, texts[i][1][:150] + " " + texts[-i - 1][1][:150], None) for i in range(40)]
    loud = [(3 * 10**6 + i, texts[i][1][:200].upper(), None) for i in range(40)]
    df = spark.createDataFrame(texts + noise + mixed + loud, "doc_id long, text string, lang string")
    kept = {r["doc_id"] for r in corpus_pipeline.language_id(spark, df, "").collect()}
    assert len(kept & {d for d, _, _ in noise}) <= 1
    assert len(kept & {d for d, _, _ in texts + mixed + loud}) >= 0.99 * len(texts + mixed + loud)


def test_language_stage_keeps_unlabelled_texts(spark):
    rows = [(1, "words of some language", None), (2, "é", None), (3, "12 !!", None), (4, "", None), (5, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = corpus_pipeline.language_id(spark, docs, "")
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {1, 2}
