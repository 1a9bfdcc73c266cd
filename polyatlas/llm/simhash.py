"""SimHash near-duplicate detection by a segment-popcount embedding."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .components import connected_components
from .store import materialize

MAX_DISTANCE = 3
SHINGLE_WORDS = 3
#: Near copies are texts of this Jaccard similarity of five-word shingles, or of fingerprints within MAX_DISTANCE bits.
SIMILARITY = 0.8
#: Blocks of four 2-bit segments each.
BLOCKS = 8
BANDS, BAND_ROWS = 20, 5
#: Long words of the bitmap of a shingle set, and rows of a band's bucket that one task holds against the whole bucket.
BITMAP_LONGS, BUCKET_ROWS = 8, 512
_BYTES = 1 << 20


def _bit_sums(hashes: np.ndarray, block: int = 1 << 16) -> np.ndarray:
    total = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), block):
        bits = np.unpackbits(hashes[i : i + block].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int32)
    return total


def fingerprint(text: str | None, width: int = SHINGLE_WORDS) -> int:
    """The 64-bit SimHash of one text: bit set if set in over half of the shingles' XXH64 (seed 42)."""
    return _fingerprint((text or "").encode().translate(tv.LOWER_ASCII.tobytes()).split(), width)


def _fingerprint(words: list[bytes], width: int) -> int:
    if not words:
        return 0
    line = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return digest(line, 42)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    view = memoryview(line)
    n = len(words) - width + 1
    hashes = np.fromiter((digest(view[s:e], 42) for s, e in zip(starts[:n].tolist(), ends[width - 1 :].tolist(), strict=True)), dtype="<u8", count=n)
    return int(np.packbits(2 * _bit_sums(hashes) > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = SHINGLE_WORDS, digests: bool = False, key: str = "doc_id") -> DataFrame:
    """(``key``, fp long) of every row; null or wordless texts get zero.

    With ``digests`` also w0 and w1, the halves of a 128-bit digest of the words,
    equal for texts that differ in case of A-Z or in white space only.
    """
    names = ["fp", "w0", "w1"] if digests else ["fp"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tv.buffers(batch.column(1))
            made = np.zeros((len(names), batch.num_rows), dtype=np.uint64)
            for a, b in tv.slices(offsets, _BYTES):
                part = tv.LOWER_ASCII[data[offsets[a] : offsets[b]]].tobytes()
                for r in range(a, b):
                    words = part[offsets[r] - offsets[a] : offsets[r + 1] - offsets[a]].split()
                    made[0, r] = _fingerprint(words, width)
                    if digests:
                        digest = xxhash.xxh3_128_intdigest(b" ".join(words))
                        made[1:, r] = digest & (2**64 - 1), digest >> 64
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x.view(np.int64)) for x in made)], [key, *names])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, F.col("text").cast("string").alias("text")).mapInArrow(run, ", ".join([f"{key} {kind}", *(f"{c} long" for c in names)]))


def _cells(fp: Column) -> Column:
    """The keys of the cells of a fingerprint in every sub-grid: its counts in FREE of BLOCKS blocks left open, the others exact."""
    ones = 0x5555555555555555
    odd, even = fp.bitwiseAND(ones), F.shiftrightunsigned(fp, 1).bitwiseAND(ones)
    counts = odd.bitwiseXOR(even).bitwiseOR(F.shiftleft(odd.bitwiseAND(even), 1))  # their sums by segment, without a carry
    keys = []
    for open_ in combinations(range(BLOCKS), MAX_DISTANCE):
        mask = sum(0xFF << (8 * i) for i in range(BLOCKS) if i not in open_)
        keys.append(F.xxhash64(F.lit(len(keys)), counts.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long"))))
    return F.array(*keys)


def near_pairs(fps: DataFrame, fp: str = "fp", max_distance: int = MAX_DISTANCE) -> DataFrame:
    """(a, b), a < b: all pairs of the distinct values of ``fp`` that differ in ``max_distance`` (3 at most) bits or fewer.

    Each fingerprint is mapped to 32 bit counts of 2-bit segments; the Manhattan
    distance of two such vectors never exceeds the Hamming distance of the
    fingerprints. The 32 axes form eight blocks. Within Manhattan distance 3 at
    most three blocks differ, so two such vectors share a cell in one of the 56
    sub-grids that leave three blocks open: an equi-join on (sub-grid, cell)
    with twenty exact axes, which random fingerprints share once in some six
    million pairs over all sub-grids. The Hamming distance is then tested
    exactly. Every pair is found whatever the data; nothing is capped. Spark
    rates the 56 rows of a fingerprint as one, so the joins here are told to
    merge: a broadcast would bring all of them to the driver.
    """
    if not 0 <= max_distance <= MAX_DISTANCE:
        raise ValueError(f"max_distance must be 0 to {MAX_DISTANCE}")
    base = fps.select(F.col(fp).alias("fp")).where("fp is not null").distinct()
    placed = base.select("fp", F.explode(_cells(F.col("fp"))).alias("cell"))
    hit = placed.alias("x").hint("merge").join(placed.alias("y"), F.col("x.cell") == F.col("y.cell")).select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
    return hit.where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_distance)).distinct()


def _named(pairs: DataFrame, nodes: DataFrame, node: str) -> DataFrame:
    """(u, v): ``pairs`` (a, b) of fingerprints as the ``node`` of each in ``nodes`` (fp, node)."""
    for end, name in (("a", "u"), ("b", "v")):
        pairs = pairs.join(nodes.select(F.col("fp").alias(end), F.col(node).alias(name)).hint("merge"), end)
    return pairs.select("u", "v")


def _shingles(words: np.ndarray, width: int) -> np.ndarray:
    """The distinct hashes of the runs of ``width`` words; a shorter text is one run, a wordless one none."""
    if not len(words):
        return np.zeros(0, dtype=np.uint64)
    return np.unique(tv.windows(words, min(width, len(words))))


def _each_text(batches: Iterator[pa.RecordBatch], width: int):
    """(key, shingles) of each row of batches of (key, text)."""
    for batch in batches:
        data, offsets = tv.buffers(batch.column(1))
        keys = batch.column(0).to_pylist()
        for a, b in tv.slices(offsets, _BYTES):
            d, o = tv.LOWER_ASCII[data[offsets[a] : offsets[b]]], offsets[a : b + 1] - offsets[a]
            start, end, first = tv.words(d, o)
            words = tv.span_hashes(d, start, end)
            for r in range(b - a):
                yield keys[a + r], _shingles(words[first[r] : first[r + 1]], width)


def _bitmap(x: np.ndarray) -> np.ndarray:
    """A bit set for each of the hashes, in BITMAP_LONGS long words."""
    bits = np.zeros(64 * BITMAP_LONGS, dtype=np.uint8)
    bits[tv.mix(x) % np.uint64(len(bits))] = 1
    return np.packbits(bits, bitorder="little").view("<i8")


def _only_in(a: str, b: str) -> Column:
    """Bits of bitmap ``a`` that ``b`` lacks: the set of ``a`` has at least so many members that are not in that of ``b``."""
    return sum((F.bit_count(F.col(f"{a}.bits")[i].bitwiseAND(F.bitwise_not(F.col(f"{b}.bits")[i]))) for i in range(BITMAP_LONGS)), F.lit(0))


def similar_pairs(texts: DataFrame, similarity: float = 0.8, width: int = 5, known: DataFrame | None = None) -> DataFrame:
    """(u, v) that join all rows of ``texts`` (node, text; nodes unique) whose sets of ``width``-word shingles have this Jaccard similarity or more.

    Fingerprints within three bits miss most pairs of similarity 0.8, so here
    candidates share one of BANDS bands of BAND_ROWS minima of hashed shingles
    (all but one in 2,000 pairs of similarity 0.8 do). Each is held against the
    least and the greatest node of its band's bucket first. What these links and
    the ``known`` ones (u, v) leave in different components is then held pair by
    pair, so every pair of a bucket is measured or already in one component;
    linked rows stay in their bucket, as a third row can be similar to them and
    not to the end. A pair is left out of the exact measure only where the sizes
    or bitmaps of the sets prove it below ``similarity``. The cost of the second
    pass is the rows outside a bucket's largest component times its rows.
    Wordless texts pair with nothing here.
    """
    multipliers = np.random.default_rng(17).integers(1, 2**63, BANDS * BAND_ROWS, dtype=np.uint64) | np.uint64(1)

    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, keys = [], []
        for node, x in _each_text(batches, width):
            if len(x):
                least = (x[None, :] * multipliers[:, None]).min(axis=1).tolist() if len(x) < 4096 else [int((x * m).min()) for m in multipliers]
                nodes.append(node)
                keys.append([hash((i, *least[i * BAND_ROWS : (i + 1) * BAND_ROWS])) for i in range(BANDS)])
            if len(nodes) == 2048:
                yield pa.RecordBatch.from_arrays([pa.array(nodes, type=pa.int64()), pa.array(keys, type=pa.list_(pa.int64()))], ["node", "keys"])
                nodes, keys = [], []
        yield pa.RecordBatch.from_arrays([pa.array(nodes, type=pa.int64()), pa.array(keys, type=pa.list_(pa.int64()))], ["node", "keys"])

    rows = materialize(texts.select("node", "text").mapInArrow(bands, "node long, keys array<long>"), "bands").select("node", F.explode("keys").alias("key"))
    shared = rows.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least <> most").select("key", F.explode(F.array("least", "most")).alias("v"))
    pairs = materialize(rows.join(shared, "key").where("node <> v").select(F.greatest("node", "v").alias("u"), F.least("node", "v").alias("v")).distinct(), "candidates")
    named = materialize(pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct(), "named")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for node, x in _each_text(batches, width):
            yield pa.RecordBatch.from_arrays([pa.array([node], type=pa.int64()), *(pa.array([v], type=pa.list_(pa.int64())) for v in (x.view(np.int64), _bitmap(x)))], ["node", "x", "bits"])

    kept = texts.select("node", "text").join(named.hint("merge"), "node", "left_semi")
    kept = materialize(kept.mapInArrow(sets, "node long, x array<long>, bits array<long>"), "sets")

    def measured(pairs: DataFrame) -> DataFrame:
        both = pairs.join(kept.select(F.col("node").alias("u"), F.col("x").alias("a")), "u").join(kept.select(F.col("node").alias("v"), F.col("x").alias("b")), "v")
        inter = F.size(F.array_intersect("a", "b"))
        return both.where(inter >= similarity * (F.size("a") + F.size("b") - inter)).select("u", "v")

    links = materialize(measured(pairs), "links")
    roots = connected_components(links if known is None else links.union(known.select("u", "v")), "u", "v")
    # buckets that still hold several components, with the largest of them and the ends, which have been held against all
    placed = rows.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    parts = placed.groupBy("key", "root").agg(F.count("*").alias("n"), F.min("node").alias("least"), F.max("node").alias("most"))
    open_ = parts.groupBy("key").agg(F.sum("n").alias("n"), F.count("*").alias("parts"), F.max_by("root", F.struct("n", "root")).alias("main"), F.min("least").alias("least"), F.max("most").alias("most")).where("n > 3 and parts > 1")
    salts = F.ceil(F.col("n") / BUCKET_ROWS).cast("int")
    inner = placed.join(open_.select("key", "main", "least", "most", salts.alias("salts")), "key").where("node <> least and node <> most")
    inner = materialize(inner.join(kept.select("node", F.size("x").alias("size"), "bits"), "node").select("key", "node", "root", "main", "size", "bits", "salts"), "inner")
    a = inner.where("root <> main").withColumn("salt", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int")).alias("a")
    b = inner.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).alias("b")
    once = (F.col("a.root") != F.col("b.root")) & ((F.col("b.root") == F.col("b.main")) | (F.col("a.node") > F.col("b.node")))
    # the most that two sets can share, by either bitmap
    inter = F.least(F.col("a.size") - _only_in("a", "b"), F.col("b.size") - _only_in("b", "a"))
    able = inter >= similarity * (F.col("a.size") + F.col("b.size") - inter)
    same = (F.col("a.key") == F.col("b.key")) & (F.col("a.salt") == F.col("b.salt"))
    rest = a.hint("merge").join(b, same & once & able).select(F.greatest("a.node", "b.node").alias("u"), F.least("a.node", "b.node").alias("v")).distinct()
    return links.union(measured(materialize(rest, "rest")))


def near_duplicates(docs: DataFrame, width: int = SHINGLE_WORDS, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``.

    Words are runs outside white space after lower-casing A-Z; shingles of
    ``width`` words count with repeats, a shorter text is one shingle, a null or
    wordless one has fingerprint zero and links like any other. component_id is
    the smallest doc_id reachable over links of at most ``max_distance``
    differing bits. Links are made between distinct fingerprints only, so a
    large group of copies costs one node. doc_id is of any ordered type. Extra
    columns are ignored, repeated rows each return; rows of null doc_id return
    but never name a component, and rows that share a doc_id are linked by their
    fingerprints alone.
    """
    fps = materialize(fingerprints(docs, width), "fp")
    classes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    # a node orders by the least doc_id of its class, so a component's root names it
    nodes = classes.select("fp", F.struct(F.col("least").isNull().alias("unnamed"), "least", "fp").alias("node"))
    pairs = near_pairs(classes, "fp", max_distance)
    pairs = _named(pairs, nodes, "node")
    roots = connected_components(pairs, "u", "v").select(F.col("node.fp").alias("fp"), F.struct(F.col("root.least").alias("least")).alias("named"))
    by_fp = classes.join(roots, "fp", "left").select("fp", F.when(F.col("named").isNull(), F.col("least")).otherwise(F.col("named.least")).alias("component_id"))
    return fps.hint("merge").join(by_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def near_deduplicate(docs: DataFrame, similarity: float = SIMILARITY, width: int = SHINGLE_WORDS, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """The rows of ``docs`` without near copies: of each group one stays, as it is.

    Texts link if their fingerprints differ in ``max_distance`` bits or fewer
    (see ``near_duplicates``), or if their sets of five-word shingles have this
    Jaccard ``similarity`` or more (see ``similar_pairs``); a group is what links
    reach. The row of least doc_id stays, null last, ties by the hash of all
    columns, so of equal rows one stays. A row is known by a number of its own,
    given once and written, not by its doc_id: ids may repeat, be null or of any
    type. Null and wordless texts are copies of one another. Each distinct text
    is one node, whatever its copies; columns of any name are kept.
    """
    taken = set(docs.columns)
    own = next(c for c in (f"row_{i}" for i in range(len(taken) + 1)) if c not in taken)
    numbered = materialize(docs.withColumn(own, F.monotonically_increasing_id()), "numbered")
    rank = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", F.xxhash64(*docs.columns).alias("tie"), F.col(own).alias("row"))
    rows = numbered.select(F.col(own).alias("row"), F.col("text").cast("string").alias("text"))
    fps = materialize(fingerprints(rows, width, True, "row"), "fp")
    texts = materialize(fps.groupBy("fp", "w0", "w1").agg(F.min("row").alias("u")), "texts")
    classes = materialize(texts.groupBy("fp").agg(F.min("u").alias("v")), "classes")
    pairs = near_pairs(classes, "fp", max_distance)
    pairs = _named(pairs, classes, "v")
    known = materialize(pairs.union(texts.hint("merge").join(classes, "fp").where("u <> v").select("u", "v")), "near")
    first = rows.join(texts.select(F.col("u").alias("row")).hint("merge"), "row", "left_semi").withColumnRenamed("row", "node")
    roots = connected_components(known.union(similar_pairs(first, similarity, known=known)), "u", "v")
    named = texts.join(roots, F.col("u") == F.col("node"), "left").select("fp", "w0", "w1", F.coalesce("root", "u").alias("root"))
    member = fps.hint("merge").join(named, ["fp", "w0", "w1"]).select("row", "root")
    stay = member.join(numbered.select(rank.alias("rank")), F.col("row") == F.col("rank.row")).groupBy("root").agg(F.min("rank").alias("rank")).select(F.col("rank.row").alias(own))
    return numbered.join(materialize(stay, "stay").hint("merge"), own, "left_semi").select(*docs.columns)
