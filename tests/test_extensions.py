"""Feature metadata, copies by feature, comparisons on an atlas, file ingest, record parsing, writers that compete."""

from __future__ import annotations

import random
from concurrent.futures import ThreadPoolExecutor
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from polyatlas.operators import batches, dex, intervals, matrix, order, schema, search, vocabulary
from polyatlas.operators.store import Atlas, Files
from polyatlas.sources import records, reference

GENES, IMAGES = "gene_expression", "image_features"


def _group(spark, prefix, cells, genes, seed):
    """Cells of one group whose local order of genes is shuffled: (obs, features, values, {(uid, gene): count})."""
    rng = random.Random(seed)
    local = rng.sample(genes, len(genes))
    obs = spark.createDataFrame([(f"{prefix}{i:02d}", ["drug", "other", "control"][i % 3]) for i in range(cells)], "uid string, treatment string")
    features = spark.createDataFrame([(i, g) for i, g in enumerate(local)], "local_index int, feature_uid string")
    held = {(f"{prefix}{i:02d}", g): float(rng.randint(1, 9)) for i in range(cells) for g in genes if rng.random() < 0.5}
    values = spark.createDataFrame([(u, local.index(g), v) for (u, g), v in held.items()], "uid string, local_index int, counts double")
    return obs, features, values, held


@pytest.fixture(scope="module")
def atlas(spark, tmp_path_factory):
    made = Atlas.create(spark, str(tmp_path_factory.mktemp("x") / "a"), [GENES, IMAGES], "treatment string", features={GENES: "symbol string, length int"})
    rows = [(f"g{i}", f"S{i}", 100 * i) for i in range(12)]
    assert made.register_features(GENES, spark.createDataFrame(rows + [("g0", "S0x", 5), (None, "n", 1)], "uid string, symbol string, length int")) == 12
    assert made.register_features(GENES, ["g3", "g12"]) == 1
    with pytest.raises(ValueError, match="aren't in the registry"):
        made.register_features(GENES, spark.createDataFrame([("g1", 1)], "uid string, colour int"))
    first, second = _group(spark, "a", 18, [f"g{i}" for i in range(10)], 1), _group(spark, "b", 15, [f"g{i}" for i in range(2, 12)], 2)
    made.add_batch(GENES, *first[:3], "d1")
    made.add_batch(GENES, *second[:3], "d2")
    made.optimize()
    return made, first[3] | second[3]


def test_feature_metadata_reaches_a_version(atlas):
    made, held = atlas
    version = made.checkout(made.snapshot())
    var = {r["uid"]: (r["symbol"], r["length"]) for r in version.query().to_matrix(GENES).var.collect()}
    assert var["g5"] == ("S5", 500) and var["g0"] == ("S0", 0)
    joined = version.join_feature_metadata(made.spark.createDataFrame([("g4",), ("zz",)], "feature string"), GENES, ["symbol"])
    assert {(r["feature"], r["symbol"]) for r in joined.collect()} == {("g4", "S4"), ("zz", None)}
    assert "symbol string" in version.schemas()[f"{GENES}_registry"] and len(made.table("cells").inputFiles()) >= 1
    assert len(made._state()["tables"]["cells"]) == 1 == len(made._state()["tables"][f"{GENES}_values"])


def test_values_by_feature(atlas, spark, tmp_path):
    made, held = atlas
    plain = made.checkout(made.snapshot())
    wanted = lambda v: {(r["uid"], r["global_index"]): r["counts"] for r in v.query().features(["g5", "g2", "g11"], GENES).to_matrix(GENES).x.collect()}
    before = wanted(plain)
    names = {r["uid"]: r["global_index"] for r in plain.registries[GENES].collect()}
    assert before == {(u, names[g]): v for (u, g), v in held.items() if g in ("g5", "g2", "g11")}
    assert made.add_csc(GENES, ["d1"]) == sum(u.startswith("a") for u, _ in held)
    kept = made.checkout(made.snapshot())
    assert kept.by_feature[GENES][1] == ("d1",) and wanted(kept) == before
    assert made.add_csc(GENES) == len(held) and wanted(made.checkout(made.snapshot())) == before
    with pytest.raises(TypeError):
        made.add_csc(IMAGES)
    bad = Atlas.create(spark, str(tmp_path / "b"), [GENES])
    bad.register_features(GENES, ["g0"])
    obs = spark.createDataFrame([("c",)], "uid string")
    bad.add_batch(GENES, obs, spark.createDataFrame([(0, "g0")], "local_index int, feature_uid string"), spark.createDataFrame([("c", 0, 1.0), ("c", 0, 2.0)], "uid string, local_index int, counts double"), "d")
    with pytest.raises(ValueError, match="repeated values"):
        bad.add_csc(GENES)


def _mwu(a, b):
    u = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    both = list(a) + list(b)
    return u, sum(both.count(v) ** 3 - both.count(v) for v in set(both))


def test_comparison_on_an_atlas(atlas):
    """Only genes that both groups measured take part, whatever their local order."""
    made, held = atlas
    version = made.checkout(made.snapshot())
    names = {r["global_index"]: r["uid"] for r in version.registries[GENES].collect()}
    out = version.query().dex(GENES, "treatment", None, "control").collect()
    common = [f"g{i}" for i in range(2, 10)]
    assert {(r["target"], names[r["feature"]]) for r in out} == {(t, g) for t in ("drug", "other") for g in common}
    cells = {r["uid"]: r["treatment"] for r in version.cells.collect()}
    total = {u: sum(held.get((u, g), 0) for g in common) for u in cells}
    x = {(u, g): np.float32(np.log1p(held.get((u, g), 0) * 1e4 / total[u])) if total[u] else 0.0 for u in cells for g in common}
    for r in out:
        a, b = ([x[u, names[r["feature"]]] for u, t in cells.items() if t == k] for k in (r["target"], "control"))
        assert r["statistic"] == _mwu(a, b)[0] and (r["target_n"], r["ref_n"]) == (len(a), len(b))
    assert {r["target"] for r in version.query().dex(GENES, "treatment", ["drug"], "control", test="ttest").collect()} == {"drug"}
    one = version.query().where("dataset_uid = 'd1'").dex(GENES, "treatment", ["drug"], "control")
    assert one.count() == 10
    with pytest.raises(ValueError):
        version.query().dex(GENES, "treatment", ["drug"], "nobody")


def test_searches_and_row_numbers(atlas):
    made, _ = atlas
    query = made.checkout(made.snapshot()).query()
    ids = query.to_row_ids().orderBy("row_id").collect()
    assert [r["uid"] for r in ids] == sorted(r["uid"] for r in ids) and [r["row_id"] for r in ids] == list(range(33))
    assert query.search("drug", text_column=["treatment", "dataset_uid"], k=5).count() == 5
    assert query.search("d2", text_column=["treatment", "dataset_uid"], k=50, query_type="fts").count() == 15
    for bad in ({"text": "x", "text_column": "treatment", "query_type": "vector"}, {"vector": [1.0], "vector_column": "v", "query_type": "hybrid"}):
        with pytest.raises(ValueError):
            query.search(**bad)
    order_ = [r["local_index"] for r in query.atlas.feature_layout(GENES, "d2").collect()]
    assert order_ == list(range(10))


def test_rank_sums_against_pairs(spark):
    rng = random.Random(4)
    cells = [(i, "abc"[i % 3]) for i in range(40)]
    x = {(i, f): float(rng.choice([0, 0, 1, 2, 2, 5])) for i, _ in cells for f in range(6)}
    values = spark.createDataFrame([(i, f, v) for (i, f), v in x.items() if v], "uid int, feature int, x float")
    grouped = spark.createDataFrame(cells, "uid int, grp string")
    want = {(t, f): (*_mwu([x[i, f] for i, g in cells if g == t], [x[i, f] for i, g in cells if g == "c"]), sum(g == t for _, g in cells), sum(g == "c" for _, g in cells)) for t in "ab" for f in range(6)}
    got = {(r["target"], r["feature"]): (r["u"], r["tie"], r["n_a"], r["n_b"]) for r in dex.rank_sums(values, grouped, "c").collect()}
    assert got == want
    dense = spark.createDataFrame([(i, [x[i, f] - 1 for f in range(6)]) for i, _ in cells], "uid int, values array<double>")
    got = {(r["target"], r["feature"]): (r["u"], r["tie"], r["n_a"], r["n_b"]) for r in dex.rank_sums_dense(dense, grouped, "c").collect()}
    assert got == want
    for bad in (dense.where("false"), dense.union(spark.createDataFrame([(99, [1.0])], "uid int, values array<double>"))):
        with pytest.raises(ValueError):
            dex.rank_sums_dense(bad, grouped, "c")


def test_ingest_from_files_and_objects(spark, tmp_path):
    made = Atlas.create(spark, str(tmp_path / "a"), [GENES, IMAGES])
    made.register_features(GENES, ["x", "y", "z"])
    made.register_features(IMAGES, ["p", "q"])
    (tmp_path / "m.tsv").write_text("1\t1\t5\n3\t1\t2\n2\t3\t7\n")
    obs = spark.createDataFrame([(0, "c0"), (1, "c1"), (2, "c2")], "row long, uid string")
    var = spark.createDataFrame([(0, "z"), (1, "x"), (2, "y")], "local_index long, feature_uid string")
    with pytest.raises(ValueError, match="not 9"):
        made.add_coo_batch(GENES, str(tmp_path / "m.tsv"), obs, var, "d", n_cells=9)
    with pytest.raises(ValueError, match="outside"):
        made.add_coo_batch(GENES, str(tmp_path / "m.tsv"), obs.where("row < 2"), var, "d")
    assert made.add_coo_batch(GENES, str(tmp_path / "m.tsv"), obs, var, "d", 3, 3) == 3
    index = pd.Index(["i0", "i1"])
    image = SimpleNamespace(obs=pd.DataFrame(index=index), var=pd.DataFrame(index=["q", "p"]), X=np.array([[1.0, 2.0], [3.0, 4.0]]))
    assert made.add_from_matrix(IMAGES, image, "e") == 2
    counts = SimpleNamespace(obs=pd.DataFrame(index=["s0", "s1"]), var=pd.DataFrame(index=["y", "x"]), X=np.array([[0, 3], [4, 0]]))
    assert made.add_from_matrix(GENES, counts, "f") == 2
    made.optimize()
    version = made.checkout(made.snapshot())
    names = {r["global_index"]: r["uid"] for r in version.registries[GENES].collect()}
    got = {(r["uid"], names[r["global_index"]]): r["counts"] for r in version.query().to_matrix(GENES).x.collect()}
    assert got == {("c0", "z"): 5, ("c0", "y"): 2, ("c2", "x"): 7, ("s0", "x"): 3, ("s1", "y"): 4}
    dense = {r["uid"]: r["values"] for r in version.query().to_matrix(IMAGES).x.collect()}
    assert dense == {"i0": [2.0, 1.0], "i1": [4.0, 3.0]}
    data = version.query().to_multimodal_dataset([GENES, IMAGES], {IMAGES: "raw"}, batch_size=4)
    assert data.n_cells() == 7 and data.plan.where(f"not {GENES}").select("grp").distinct().count() == 1
    assert {r["uid"]: r["values"] for r in data.dense(IMAGES, 2).collect()} == dense
    assert {r["uid"]: r["values"] for r in data.dense(GENES, 3).collect()}["c0"] == [0.0, 2.0, 5.0]
    result = version.query().to_multimodal()
    assert set(result.to_mudata()) == {GENES, IMAGES}


def test_one_writer_gets_a_name(spark, tmp_path):
    files = Files(spark, str(tmp_path))
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda i: files.create("log/1.json", {"by": i}), range(24)))
    assert sum(won) == 1 and files.read("log/1.json") == {"by": won.index(True)}
    assert [p.name for p in tmp_path.iterdir() if p.name.startswith(".tmp")] == []


def test_group_checks(spark):
    space = schema.FeatureSpace("some", schema.DENSE, True, ("raw",), ("raw", "log"), dtypes={"raw": "integer"})
    rows = spark.createDataFrame([("a", [1.0, 2.0], [[1]]), ("b", [1.0], [[2]])], "uid string, raw array<double>, odd array<array<int>>")
    errors = schema.group_errors(space, rows)
    assert len(errors) == 4 and any("2 lengths" in e for e in errors) and any("2 dimensions" in e for e in errors)
    assert schema.group_errors(space, spark.createDataFrame([("a", [1])], "uid string, raw array<int>")) == []
    assert schema.group_errors(schema.get_space(GENES), spark.createDataFrame([("a", 0, "x")], "uid string, local_index int, tpm string")) == [f"{GENES}: no layer counts", f"{GENES}: layer tpm holds string, not numbers"]
    obs = spark.createDataFrame([(["SM", "GP"], ["1", None])], "types array<string>, uids array<string>")
    made = schema.auto_fields(obs, {"words": lambda df: schema.search_string(df["types"], df["uids"], {"SM": "SM", "GP": "GP"})})
    assert made.first()["words"] == "SM:1"
    mixed = schema.integral_as_int(spark.createDataFrame([(1.0, 1.5), (2.0, 2.0)], "a double, b double"), ["a", "b"])
    assert [f.dataType.simpleString() for f in mixed.schema] == ["int", "double"]


def test_a_space_can_bring_its_own_plan(spark):
    from polyatlas.operators.query import AtlasVersion, pointer

    if "doubled" not in schema.registered_spaces():
        schema.register_space(schema.FeatureSpace("doubled", schema.SPARSE, True, ("v",), ("v",), reconstruct=lambda values, cells, layout, features, layers: matrix.reconstruct_sparse(values, cells, layout, features, layers).withColumn("v", 2 * F.col("v"))))
    cells = spark.range(2).select(F.col("id").alias("uid"), pointer("doubled", F.lit("g"), F.lit(True)))
    layout = spark.createDataFrame([("g", 0, "f", 7)], "grp string, local_index int, feature_uid string, global_index long")
    values = spark.createDataFrame([(0, "g", 0, 1.5)], "uid long, grp string, local_index int, v double")
    version = AtlasVersion(cells, {"doubled": layout.select(F.col("feature_uid").alias("uid"), "global_index")}, {"doubled": layout}, {"doubled": values})
    assert [tuple(r) for r in version.query().to_matrix("doubled").x.collect()] == [(0, 7, 3.0)]


def test_running_sums(spark):
    rng = random.Random(1)
    rows = [(f"ENSG{i:05d}", rng.randint(0, 9)) for i in range(500)]
    df = spark.createDataFrame(rng.sample(rows, len(rows)), "k string, n int").repartition(7)
    want, total = {}, 0
    for k, n in rows:
        want[k] = (total, total := total + n)
    assert {r["k"]: (r["begin"], r["end"]) for r in matrix.offsets(df, "k", "n").collect()} == want
    assert {r["k"]: r["at"] for r in order.places(df, ["k"], "at").collect()} == {k: i for i, (k, _) in enumerate(rows)}
    assert order.places(df.where("false"), ["k"], "at").count() == 0
    cells = df.select(F.col("k").alias("uid"), F.substring("k", -1, 1).alias("grp"))
    plan = batches.batch_plan(cells, 40, shuffle=False, workers=3).toPandas().sort_values(["worker", "ordinal"])
    for _, own in plan.groupby("worker"):
        assert own["ordinal"].tolist() == list(range(len(own))) and list(zip(own["grp"], own["uid"], strict=True)) == sorted(zip(own["grp"], own["uid"], strict=True))
    turns = plan[["worker_batch", "worker", "batch"]].drop_duplicates().sort_values(["worker_batch", "worker"])
    assert turns["batch"].tolist() == list(range(len(turns))) and batches.plan_length(cells, 40, workers=3) == len(turns)


def test_count_matrix_keeps_empty_rows_and_columns(spark, tmp_path):
    f = spark.createDataFrame([("a", "chr1", 10, 5), ("b", "chr2", 0, 9), ("a", "chr2", 4, 4)], "cell string, chrom string, start long, length long")
    r = spark.createDataFrame([("chr1", 0, 12, None), ("chr1", 100, 120, None), ("chr9", 1, 2, "far")], "chrom string, start long, end long, name string")
    obs, var, x = intervals.count_matrix(f, r, spark.createDataFrame([("a",), ("c",)], "cell string"))
    assert {tuple(row) for row in obs.collect()} == {("a", 2), ("c", 0)}
    assert [(v["name"], v["n_cells"]) for v in var.orderBy("range_id").collect()] == [("chr1:0-12", 1), ("chr1:100-120", 0), ("far", 0)]
    assert [tuple(row) for row in x.collect()] == [("a", 0, 1)] and intervals.n_ranges(r) == 3
    own, cells, names = intervals.joint_fragments(f, spark.createDataFrame([("a",), ("c",), ("b",)], "cell string"))
    assert {(n["chrom"], n["global_chrom"]) for n in names.collect()} == {("chr1", 0), ("chr2", 1)} and own.count() == 3
    assert [(c["cell"], c["begin"], c["end"]) for c in cells.orderBy("cell").collect()] == [("a", 0, 2), ("b", 2, 3), ("c", 3, 3)]
    stored = intervals.GenomeSorted.write(f, str(tmp_path / "g"))
    assert stored.chrom_names == ["chr1", "chr2"] and stored.n_fragments == 3 and stored.query_region("chr2", 5, 6).count() == 2 and stored.query_region("no", 0, 9).count() == 0


def test_more_resolvers(spark):
    inputs = spark.createDataFrame([(0, "P53"), (1, "alpha"), (2, "none")], "ordinal int, value string")
    aliases = spark.createDataFrame([("p53", "P04637", True), ("alpha", "Q2", False), ("alpha", "Q1", False)], "alias string, id string, is_canonical boolean")
    proteins = spark.createDataFrame([("P04637", "Tumor antigen", "TP53", "MEEP", 4)], "uniprot_id string, protein_name string, gene_name string, sequence string, sequence_length long")
    got = vocabulary.resolve_proteins(inputs, aliases, proteins)
    assert {r["ordinal"]: (r["resolved"], r["confidence"], r["gene_name"]) for r in got.collect()} == {0: ("P04637", 1.0, "TP53"), 1: ("Q1", 0.7, None), 2: (None, 0.0, None)}
    assert vocabulary.report(got).first().asDict() == {"total": 3, "resolved": 2, "unresolved": 1, "ambiguous": 1}
    assert [r["value"] for r in vocabulary.ambiguous_values(got).collect()] == ["alpha"]
    assert {r["alternatives"] for r in vocabulary.report_frame(got).collect()} == {"", "Q2"}
    compounds = spark.createDataFrame([(5, "Imatinib", "CCO"), (6, None, "CC"), (4, "Other", "CCO")], "cid long, name string, canonical_smiles string")
    synonyms = spark.createDataFrame([("imatinib", "Imatinib", 5, True)], "synonym string, synonym_original string, cid long, is_title boolean")
    asked = spark.createDataFrame([(0, " 5"), (1, "6"), (2, "CCO "), (3, "x")], "ordinal int, value string")
    by = lambda kind: {r["ordinal"]: (r["resolved"], r["cid"], r["confidence"]) for r in vocabulary.resolve_molecules(asked, compounds, synonyms, kind).collect()}
    assert by("cid") == {0: ("Imatinib", 5, 0.95), 1: ("6", 6, 0.95), 2: (None, None, 0.0), 3: (None, None, 0.0)}
    assert by("smiles") == {0: (None, None, 0.0), 1: (None, None, 0.0), 2: ("Other", 4, 0.95), 3: (None, None, 0.0)}
    named = vocabulary.resolve_molecules(spark.createDataFrame([(0, "IMATINIB")], "ordinal int, value string"), compounds, synonyms).first()
    assert (named["cid"], named["canonical_smiles"], named["confidence"]) == (5, "CCO", 1.0)
    terms = spark.createDataFrame([("CL:1", "neuron", None, False), ("UBERON:1", "neuron", None, False)], "term_id string, name string, synonyms string, is_obsolete boolean")
    asked = spark.createDataFrame([(0, "Neuron")], "ordinal int, value string")
    assert vocabulary.resolve_cell_types(asked, terms).first()["term_id"] == "CL:1" and vocabulary.resolve_tissues(asked, terms).first()["term_id"] == "UBERON:1"
    assert vocabulary.term_ids(asked, terms, "disease").first()["term_id"] is None
    assert vocabulary.entity_prefixes("sex") == ("PATO",)


def test_walks_have_no_depth_of_their_own(spark):
    links = spark.range(25).select(F.concat(F.lit("A:"), F.col("id")).alias("child"), F.concat(F.lit("A:"), F.col("id") + 1).alias("parent"))
    got = vocabulary.walk(links.coalesce(1), spark.createDataFrame([("A:0",)], "start string"))
    assert got.count() == 25 and got.agg(F.max("depth")).first()[0] == 25 and vocabulary.walk.__defaults__[0] is None


def test_cache_of_guides(spark, tmp_path):
    path = str(tmp_path / "guides")
    cache = spark.createDataFrame([("ACGT", "G1")], "guide_sequence string, gene string")
    cache.write.parquet(path)
    whole = vocabulary.append_to_cache(spark.read.parquet(path), spark.createDataFrame([("acgt", "G9"), ("ttt", "G2"), ("TTT", "G2")], "guide_sequence string, gene string"), path)
    assert {tuple(r) for r in whole.collect()} == {("ACGT", "G1"), ("TTT", "G2")}
    found = vocabulary.resolve_cached(spark.createDataFrame([(0, "tTt"), (1, "A")], "ordinal int, value string"), whole)
    assert {r["ordinal"]: (r["found"], r["gene"]) for r in found.collect()} == {0: (True, "G2"), 1: (False, None)}


def test_reference_tables(spark, tmp_path):
    reference.set_reference_path(str(tmp_path / "ref"))
    with pytest.raises(RuntimeError):
        reference.reference(spark)
    tables = reference.Reference(spark, str(tmp_path / "ref"))
    tables.write("organisms", [{"common_name": "human", "scientific_name": "homo_sapiens", "ncbi_taxonomy_id": 9606}])
    assert reference.reference(spark).table("organisms").first()["ensembl_prefix"] is None
    whole = tables.write_chunks("compounds", iter([[], [{"pubchem_cid": 1, "name": "a"}], [{"pubchem_cid": 2, "name": "b"}]]))
    assert whole.count() == 2
    for broken, error in ((lambda: tables.write_chunks("proteins", iter([[]])), ValueError), (lambda: tables.table("nothing"), KeyError), (lambda: tables.table("proteins"), FileNotFoundError)):
        with pytest.raises(error):
            broken()


ARTICLE = """<PubmedArticleSet><PubmedArticle><MedlineCitation><PMID>12</PMID><Article><Journal><JournalIssue><PubDate><Year>2020</Year><Month>Mar</Month></PubDate></JournalIssue><Title>A Journal</Title></Journal>
<ArticleTitle>On <i>cells</i></ArticleTitle><Abstract><AbstractText Label="AIM">To know.</AbstractText><AbstractText>More.</AbstractText></Abstract><AuthorList><Author><LastName>Doe</LastName><ForeName>Jo</ForeName></Author><Author><CollectiveName>Group</CollectiveName></Author></AuthorList></Article></MedlineCitation>
<PubmedData><ArticleIdList><ArticleId IdType="doi">10.1/x</ArticleId><ArticleId IdType="pmc">PMC3</ArticleId></ArticleIdList></PubmedData></PubmedArticle></PubmedArticleSet>"""
BODY = "<article><body><sec><title>Methods</title><p>One <b>two</b>.</p><p>Three.</p><sec><title>Cells</title><p>Inner.</p></sec><sec><p>No title.</p></sec></sec></body></article>"
BIO = '<BioSampleSet><BioSample accession="S1"><Description><Title>T</Title><Organism taxonomy_name="Homo sapiens" taxonomy_id="9606"/></Description><Attributes><Attribute attribute_name="a" harmonized_name="h"> x </Attribute><Attribute attribute_name="b">y</Attribute></Attributes></BioSample></BioSampleSet>'


def test_records(spark):
    xml = spark.createDataFrame([(0, ARTICLE), (1, "no xml <"), (2, None), (3, '<!DOCTYPE a [<!ENTITY x "y">]><a>&x;</a>')], "i int, xml string")
    got = records.publications(xml).collect()
    assert len(got) == 1 and got[0]["pmid"] == 12 and got[0]["title"] == "On cells" and got[0]["authors"] == ["Jo Doe", "Group"]
    assert (got[0]["doi"], got[0]["pmc_id"], got[0]["journal"], str(got[0]["publication_date"])) == ("10.1/x", "PMC3", "A Journal", "2020-03-01")
    texts = spark.createDataFrame([(0, BODY), (1, ARTICLE), (2, None)], "i int, xml string").select("i", records.full_text("xml").alias("s"))
    parts = {r["i"]: None if r["s"] is None else [(s["section_title"], s["section_text"]) for s in r["s"]] for r in texts.collect()}
    assert parts == {0: [("Methods", "One two.\n\nThree."), ("Methods > Cells", "Inner."), ("Methods", "No title.")], 1: [("AIM", "To know."), ("Abstract", "More.")], 2: None}
    sample = records.biosamples(spark.createDataFrame([(BIO,), (None,)], "xml string")).collect()
    assert len(sample) == 1 and sample[0]["attributes"] == {"h": "x", "b": "y"} and sample[0]["taxonomy_id"] == "9606"
    soft = "^SAMPLE = G1\n!Sample_geo_accession = G1\n!Sample_title = a = b\n!Sample_characteristics_ch1 = Cell Type: T cell: CD4\n!Sample_characteristics_ch1 = treated\n!Sample_series_id = E1\r\n!Sample_series_id = E2\n#x"
    row = records.geo_samples(spark.createDataFrame([(soft,)], "text string")).first()
    assert (row["accession"], row["title"], row["series_ids"]) == ("G1", "a = b", ["E1", "E2"]) and row["characteristics"] == {"cell type": "T cell: CD4", "treated": ""}


def test_nearest_for_each_query(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 5))
    x[7] = x[3]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [1.0])], "key long, v array<double>")
    asked = df.where("key % 50 = 0 or key in (3, 900)").select(F.col("key").alias("query"), F.col("v").alias("vector"))
    got = search.nearest_each(df, "v", "key", asked, 4, chunk=64, block=3).collect()
    for q in (0, 3, 50, 100, 150, 200, 250):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        want = [i for i in np.lexsort((np.arange(300), d)) if i != q][:4]
        assert [r["key"] for r in sorted((r for r in got if r["query"] == q), key=lambda r: r["rank"])] == want
    assert {r["query"] for r in got} == {0, 3, 50, 100, 150, 200, 250}
