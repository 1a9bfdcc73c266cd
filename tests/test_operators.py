"""Identities, label classifiers, file formats, intervals, vocabularies, search and streams."""

from __future__ import annotations

import hashlib
import random
import uuid

import pytest
from pyspark.sql import functions as F

from polyatlas.functions import identity, labels
from polyatlas.operators import intervals, search, vocabulary
from polyatlas.sources import read_assembly_report, read_bed_fragments, read_coo
from polyatlas.streaming import stream_counts, stream_fragments


def _values(spark, expression, items, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(items)], f"i int, v {kind}")
    return [r["o"] for r in df.select("i", expression(F.col("v")).alias("o")).orderBy("i").collect()]


def test_identities(spark):
    assert identity.make_stable_uid("2244") == uuid.uuid5(identity.NAMESPACE, "2244").hex[:16] != identity.make_stable_uid("2245")
    row = spark.createDataFrame([("g", "human", "p")], "a string, b string, c string").select(identity.stable_uid(F.col("a"), F.col("b")).alias("s"), identity.resolution_uid(F.col("c"), F.lit(None)).alias("u"), identity.layout_uid(F.array("a", "b")).alias("l"), identity.dataset_perturbation_uid("a", "b").alias("d")).first()
    assert row["s"] == identity.make_stable_uid("g", "human") and row["u"] == identity.make_stable_uid("unresolved", "p")
    assert row["l"] == identity.compute_layout_uid(["g", "human"]) != identity.compute_layout_uid(["human", "g"])
    assert row["d"] == hashlib.blake2b(b"g_human", digest_size=8).hexdigest()
    assert len(identity.make_uid()) == 16


def test_labels(spark):
    assert _values(spark, labels.split_combination, ["TP53+BRCA1", "TP53 & BRCA1 & KRAS", "dexamethasone, imatinib", "single_gene", " ;"]) == [["TP53", "BRCA1"], ["TP53", "BRCA1", "KRAS"], ["dexamethasone", "imatinib"], ["single_gene"], []]
    assert _values(spark, labels.clean_compound_name, ["imatinib mesylate", "x (free base)", "sodium X", "aspirin"]) == ["imatinib", "x", "", "aspirin"]
    assert _values(spark, labels.negative_control_type, ["NT", "DMSO", "TP53", "LacZ"]) == ["nontargeting", "DMSO", None, "lacz"]
    assert _values(spark, labels.is_placeholder_symbol, ["AC134879.3", "1700049J03Rik", "TP53"]) == [True, True, False]
    assert _values(spark, labels.is_ensembl_gene_id, ["ENSG00000141510.12", "ENSMUSG1", "TP53"]) == [True, True, False]
    assert _values(spark, labels.publication_id_type, ["PMID:1", "12", "10.1/x", "doi:1", "A title"]) == ["pmid", "pmid", "doi", "doi", "title"]
    fields = _values(spark, labels.soft_fields, ["^S = x\n!a = 1\n!b=two \nno"])[0]
    assert [(f["key"], f["value"]) for f in fields] == [("a", "1"), ("b", "two")]


def test_files(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("2\t1\t5\n1\t2\t7\n")
    assert sorted(map(tuple, read_coo(spark, str(tmp_path / "m.tsv")).collect())) == [(0, 1, 5), (1, 0, 7)]
    (tmp_path / "f.bed").write_text("chr1\t10\t60\tAA\nchr2\t0\t5\tBB\n")
    assert sorted(map(tuple, read_bed_fragments(spark, str(tmp_path / "f.bed")).collect())) == [("chr1", 10, 50, "AA"), ("chr2", 0, 5, "BB")]
    (tmp_path / "long.bed").write_text("chr1\t10\t70000\tAA\n")
    with pytest.raises(Exception, match="out of range"):
        read_bed_fragments(spark, str(tmp_path / "long.bed")).collect()
    (tmp_path / "r.txt").write_text("# c\n1\tassembled-molecule\t1\tChromosome\tCM1\t=\tna\tPrimary Assembly\t100\tchr1\nshort\n")
    row = read_assembly_report(spark, str(tmp_path / "r.txt")).collect()
    assert len(row) == 1 and row[0]["sequence_role"] == "chromosome" and row[0]["refseq_accession"] is None and row[0]["is_primary_assembly"]


def test_overlap_join_is_exact(spark):
    rng = random.Random(2)
    frags = [(f"c{i % 7}", rng.choice(["chr1", "chr2"]), rng.randint(0, 5000), rng.randint(1, 900)) for i in range(300)]
    ranges = [(i, rng.choice(["chr1", "chr2", "chr3"]), s := rng.randint(0, 5000), s + rng.randint(1, 2500)) for i in range(40)]
    f = spark.createDataFrame(frags, "cell string, chrom string, start long, length long")
    r = spark.createDataFrame(ranges, "range_id long, chrom string, start long, end long")
    want: dict = {}
    for cell, c, s, n in frags:
        for i, rc, a, b in ranges:
            if c == rc and s < b and s + n > a:
                want[cell, i] = want.get((cell, i), 0) + 1
    for width in (64, 1000, 1 << 14):
        assert {(x["cell"], x["range_id"]): x["n"] for x in intervals.count_fragments(f, r, width).collect()} == want
    nested = spark.createDataFrame([(0, "chr1", 0, 1000), (1, "chr1", 10, 20)], "range_id long, chrom string, start long, end long")
    assert [tuple(x) for x in intervals.count_fragments(spark.createDataFrame([("c", "chr1", 500, 10)], "cell string, chrom string, start long, length long"), nested).collect()] == [("c", 0, 1)]


def test_annotation(spark):
    coords = spark.createDataFrame([(0, "chr1", 150, 152), (1, "chr1", 110, 112), (2, "chr1", 300, 302), (3, "chr2", 5, 7)], "id int, chrom string, start long, end long")
    genes = spark.createDataFrame([("G", "chr1", 100, 400, "+")], "gene string, chrom string, start long, end long, strand string")
    features = spark.createDataFrame([("cds", "T", "chr1", 140, 160, "+"), ("exon", "T", "chr1", 100, 160, "+"), ("transcript", "T", "chr1", 100, 400, "+")], "feature_type string, transcript string, chrom string, start long, end long, strand string")
    got = {r["id"]: (r["gene"], r["target_context"], r["confidence"]) for r in intervals.annotate_coordinates(coords, genes, features).collect()}
    assert got == {0: ("G", "exon", 1.0), 1: ("G", "5_UTR", 1.0), 2: ("G", "intron", 1.0), 3: (None, "intergenic", 0.0)}


def test_resolution(spark):
    inputs = spark.createDataFrame([(0, "TP53"), (1, "tp53"), (2, "dup"), (3, "none"), (4, "ENSG1.2")], "ordinal int, value string")
    aliases = spark.createDataFrame([("tp53", "ENSG1", True), ("dup", "ENSG3", False), ("dup", "ENSG2", False)], "alias string, id string, is_canonical boolean")
    features = spark.createDataFrame([("ENSG1", "TP53", "v1")], "ensembl_gene_id string, symbol string, assembly string")
    got = {r["ordinal"]: (r["resolved"], r["confidence"]) for r in vocabulary.resolve_genes(inputs, aliases, features).collect()}
    assert got == {0: ("ENSG1", 1.0), 1: ("ENSG1", 1.0), 2: ("ENSG2", 0.7), 3: (None, 0.0), 4: ("ENSG1", 1.0)}
    compounds = spark.createDataFrame([("imatinib", "Imatinib", 5, True), ("gleevec", "Gleevec", 5, False)], "synonym string, synonym_original string, cid long, is_title boolean")
    asked = spark.createDataFrame([(0, "Imatinib mesylate"), (1, "gleevec"), (2, " dmso "), (3, "x")], "ordinal int, value string")
    got = {r["ordinal"]: (r["resolved"], r["confidence"]) for r in vocabulary.resolve_compounds(asked, compounds).collect()}
    assert got == {0: ("Imatinib", 1.0), 1: ("Gleevec", 0.9), 2: ("DMSO", 1.0), 3: (None, 0.0)}
    lines = spark.createDataFrame([("L1", "HeLa"), ("L2", "K-562")], "id string, name string")
    synonyms = spark.createDataFrame([("L2", "K562"), ("L2", "leukemia line")], "id string, synonym string")
    asked = spark.createDataFrame([(0, "hela"), (1, "k562"), (2, "my leukemia cells"), (3, "zzz")], "ordinal int, value string")
    got = {r["ordinal"]: (r["term_id"], r["confidence"]) for r in vocabulary.resolve_cell_lines(asked, lines, synonyms).collect()}
    assert got == {0: ("L1", 1.0), 1: ("L2", 0.9), 2: ("L2", 0.7), 3: (None, 0.0)}
    with pytest.raises(ValueError):
        vocabulary.entity_prefixes("nothing")
    sexes = vocabulary.resolve_sex(spark.createDataFrame([(0, " Male"), (1, "x")], "ordinal int, value string")).orderBy("ordinal").collect()
    assert [r["term_id"] for r in sexes] == ["PATO:0000384", None]


def test_walk_survives_cycles(spark):
    links = spark.createDataFrame([("A:1", "A:2"), ("A:2", "A:3"), ("A:3", "A:1"), ("A:1", "A:3")], "child string, parent string")
    got = {(r["node"], r["depth"]) for r in vocabulary.walk(links, spark.createDataFrame([("A:1",)], "start string")).collect()}
    assert got == {("A:2", 1), ("A:3", 1)}


def test_search(spark):
    docs = spark.createDataFrame([(0, "red fox"), (1, "red red dog"), (2, None)], "doc int, text string")
    hits = search.bm25(spark.createDataFrame([(7, "Fox!")], "query int, text string"), docs).collect()
    assert [(h["query"], h["doc"]) for h in hits] == [(7, 0)]
    v = spark.createDataFrame([(0, [0.0, 1.0]), (1, [1.0, 0.0]), (2, [0.0, 2.0])], "key int, v array<float>")
    assert [r["key"] for r in search.nearest(v, "v", [0.0, 1.0], 2, "key").collect()] == [0, 2]
    assert [r["key"] for r in search.nearest(v, "v", [0.0, 1.0], 1, "key", "dot").collect()] == [2]
    with pytest.raises(ValueError):
        search.distance(F.col("v"), F.col("v"), "l1")


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, i % 3, "click" if i % 2 else "view", float(i % 5), 1_700_000_000 + 7000 * i) for i in range(60)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, s long").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    query = stream_counts(stream_fragments(stream)).writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    assert sorted(map(tuple, spark.table("counts").collect())) == sorted(map(tuple, stream_counts(stream_fragments(events)).collect()))
