"""Exact removal of long repeated word sequences with difference-cover anchors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.errors import PySparkTypeError
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from . import textvec as tv
from .store import materialize, release, row_key, unused

WINDOW = 35
#: A perfect difference set: every residue mod PERIOD is a difference of two members.
PERIOD, COVER = 21, (0, 1, 4, 14, 16)
FILTER_BITS = 27
#: Bits of a word's place in its text, and of the hash that tells texts of one key apart.
_PLACE, _TELL = 28, 24
_BYTES = 4 << 20


def _parts(batches: Iterator[pa.RecordBatch]):
    """(batch, rows from, to, bytes, offsets, word starts, ends, first words) in pieces of about 4 MB."""
    for batch in batches:
        data, offsets = tv.buffers(batch.column(1))
        for a, b in tv.slices(offsets, _BYTES):
            d, o = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            yield batch, a, b, d, o, *tv.words(d, o)


def _anchors(hashes: np.ndarray, first: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, hash) of the anchor windows: those that start at a cover position of their text."""
    width = window - PERIOD + 1
    h = tv.windows(hashes, width)
    place = np.arange(len(h))
    row = tv.fragment_rows(first)[: len(h)]
    cover = np.zeros(PERIOD, dtype=bool)
    cover[list(COVER)] = True
    keep = cover[(place - first[row]) % PERIOD] & (place + width <= first[row + 1]) & (first[row + 1] - first[row] >= window)
    return place[keep], h[keep]


def _candidates(hashes: np.ndarray, first: np.ndarray, bitmap: np.ndarray, bits: int, window: int) -> np.ndarray:
    """Starts of the windows that hold an anchor whose hash is marked in the filter."""
    place, h = _anchors(hashes, first, window)
    slot = h >> np.uint64(64 - bits)
    hit = place[(bitmap[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) == 1]
    if not len(hit):
        return hit
    row = np.searchsorted(first, hit, side="right") - 1
    low = np.maximum(hit - (PERIOD - 1), first[row])
    high = np.minimum(hit, first[row + 1] - window)
    step = np.zeros(len(hashes) + 1, dtype=np.int32)
    np.add.at(step, low, 1)
    np.add.at(step, high + 1, -1)
    return np.flatnonzero(np.cumsum(step[:-1]) > 0)


def _filter(docs: DataFrame, bits: int, window: int) -> np.ndarray:
    """A bitmap of 2**bits bits that marks, at least, every anchor hash found twice or more in ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, _, d, _, s, e, first in _parts(batches):
            _, h = _anchors(tv.span_hashes(d, s, e), first, window)
            u, n = np.unique(h, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(n > 1)], ["h", "more"])

    found = docs.mapInArrow(run, "h long, more boolean").groupBy("h")
    twice = found.agg(F.count("*").alias("n"), F.max("more").alias("more")).where("n > 1 or more")
    twice = twice.select(F.shiftrightunsigned("h", 70 - bits).alias("word"), "h")
    bit = f"shiftleft(1L, cast(shiftrightunsigned(h, {64 - bits}) & 63 as int))"
    marks = twice.groupBy("word").agg(F.bit_or(F.expr(bit)).alias("m"))
    out = np.zeros(1 << (bits - 6), dtype=np.uint64)
    got = marks.toArrow()  # at most 2**(bits - 6) rows
    out[got["word"].to_numpy()] = got["m"].to_numpy().view(np.uint64)
    return out


def _once(base: DataFrame, bitmap: Broadcast, window: int, filter_bits: int) -> DataFrame:
    """(key, once): of the rows of ``base`` (key, text, tell) that have any, tell and start of each marked window found once."""

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, a, _, d, _, s, e, first in _parts(batches):
            words = tv.span_hashes(d, s, e)
            at = _candidates(words, first, bitmap.value, filter_bits, window)
            h = tv.windows(words, window)[at]
            tag = tv.windows(tv.span_hashes(d, s, e, 1), window)[at] if len(at) else h
            u, index, n = np.unique(h, return_index=True, return_counts=True)
            row = np.searchsorted(first, at[index], side="right") - 1
            if len(first) > 1 and np.diff(first).max() >= 1 << _PLACE:
                raise ValueError(f"a text of {1 << _PLACE} words or more")
            place = batch.column(2).to_numpy()[a + row] << _PLACE | (at[index] - first[row])
            many = np.minimum(n, 2).astype(np.int64) << (_PLACE + _TELL)
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array((tag[index] >> np.uint64(49)).astype(np.int16)), pa.array(many | place), pa.array(batch.column(0).to_numpy()[a + row])], ["h", "tag", "v", "key"])

    counted = base.mapInArrow(single, "h long, tag short, v long, key long").groupBy("h", "tag")
    once = counted.agg(F.try_sum("v").alias("v"), F.min("key").alias("key")).where(F.shiftright("v", _PLACE + _TELL) == 1)
    return once.select("key", F.col("v").bitwiseAND((1 << (_PLACE + _TELL)) - 1).alias("at")).groupBy("key").agg(F.collect_list("at").alias("once"))


def _cut(docs: DataFrame, keep: list[Column], window: int, filter_bits: int, as_is: bool) -> DataFrame:
    """(keep_0, ..., n_words, n_removed, kept) for every row of ``docs``; the texts go through one shuffle, with all that ``keep`` needs. as_is: a text that loses nothing is ``kept`` unchanged, a null one null."""
    if window <= PERIOD:
        raise ValueError(f"window must be over {PERIOD} words")
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    # a short key shuffles cheaply; rows of one doc_id are told apart by 24 bits of their text's hash
    short = F.col("doc_id").cast("long") if isinstance(docs.schema["doc_id"].dataType, T.IntegralType) else F.lit(None).cast("long")
    key, tell = F.coalesce(short, F.xxhash64(text)), F.pmod(F.xxhash64(text), F.lit(1 << _TELL))
    base = docs.select(key.alias("key"), text.alias("text"), tell.alias("tell"))
    bitmap = spark.sparkContext.broadcast(_filter(base, filter_bits, window))
    named, once_at = unused(docs.columns, "key", "once")
    once = _once(base, bitmap, window, filter_bits).withColumnsRenamed({"key": named, "once": once_at})
    if as_is:
        # before the texts are shuffled, the shuffles of anchors and windows go; in op10 that freed nothing as measured
        once = materialize(once, "once")
        release(spark)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, a, b, d, _, s, e, first in _parts(batches):
            words = tv.span_hashes(d, s, e)
            at = _candidates(words, first, bitmap.value, filter_bits, window)
            lists = batch.column(2).slice(a, b - a)
            rows = np.repeat(np.arange(b - a), lists.value_lengths().fill_null(0).to_numpy())
            places = lists.flatten().to_numpy()
            mine = places >> _PLACE == batch.column(0).to_numpy()[a + rows]
            at = np.setdiff1d(at, (first[rows] + (places & ((1 << _PLACE) - 1)))[mine])
            step = np.zeros(len(s) + 1, dtype=np.int32)
            np.add.at(step, at, 1)
            np.add.at(step, at + window, -1)
            keep = np.cumsum(step[:-1]) == 0
            raw, kept = d.tobytes(), []
            for r in range(b - a):
                own = slice(first[r], first[r + 1])
                k = keep[own]
                if k.all() and (as_is or len(k)):
                    kept.append(None if as_is else b" ".join(raw[s[own][0] : e[own][-1]].split()))
                else:
                    kept.append(b" ".join([raw[x:y] for x, y in zip(s[own][k].tolist(), e[own][k].tolist(), strict=True)]))
            n = np.diff(first)
            left = np.add.reduceat(np.append(keep, 0), first[:-1])[: b - a] * (n > 0) if len(s) else np.zeros(b - a, dtype=np.int64)
            text = batch.column(1).slice(a, b - a)
            kept = pa.array(kept, type=pa.binary()).cast(text.type)
            yield pa.RecordBatch.from_arrays([*(x.slice(a, b - a) for x in batch.columns[3:]), pa.array(n.astype(np.int64)), pa.array((n - left).astype(np.int64)), pc.coalesce(kept, text) if as_is else kept], [*names, "n_words", "n_removed", "kept"])

    names = [f"keep_{i}" for i in range(len(keep))]
    # only columns of docs are shuffled; what is made of them comes after
    full = docs.withColumn(named, key).join(once.hint("merge"), named, "left")
    full = full.select(tell.alias("tell"), text.alias("text"), F.col(once_at).alias("once"), *(c.alias(n) for c, n in zip(keep, names, strict=True)))
    return full.mapInArrow(cut, T.StructType([*(T.StructField(n, full.schema[n].dataType) for n in names), *T._parse_datatype_string("n_words long, n_removed long, kept string").fields]))


def repeated_windows_removed(docs: DataFrame, window: int = WINDOW, filter_bits: int = FILTER_BITS) -> DataFrame:
    """(row_key, doc_id, n_words, n_removed, kept): every row of ``docs`` without its repeated windows.

    A word goes if it lies in a run of ``window`` words of its text that also
    starts anywhere else in ``docs``, the same text included. Anchors (windows of
    window - 20 words) are hashed at cover positions modulo 21 only; two equal
    windows share an anchor at one offset, since each residue is a difference of
    two cover positions. Anchor hashes seen twice are marked in a bitmap of
    fixed size; a window around a marked anchor is extended to its whole length
    and its 79-bit hash counted over all documents. So the bitmap only saves
    work: false marks cost a count, never a wrong removal. Counts are summed in
    each task before the shuffle, and only windows found once come back to
    their texts, so no group of copies meets in one task.

    Null and wordless texts give no words and an empty ``kept``; texts shorter
    than a window stay; repeated rows are two places of one text; extra columns
    are ignored. ``kept`` has the words left, joined by one space.
    """
    cut = _cut(docs.select("doc_id", "text"), [row_key(), F.col("doc_id")], window, filter_bits, False)
    return cut.withColumnsRenamed({"keep_0": "row_key", "keep_1": "doc_id"})


def _carried(kind: T.DataType) -> bool:
    """Whether Arrow has this type."""
    try:
        to_arrow_type(kind)
    except PySparkTypeError:
        return False
    return True


def substring_dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with ``text`` cut as by ``repeated_windows_removed``; texts that lose nothing stay as they are, other columns too.

    The other columns travel with the texts, so those are shuffled once. Where
    Arrow has no type for one (some intervals), the cut texts are written and
    joined to the rows again, which shuffles all texts a second time.
    """
    others = [c for c in docs.columns if c != "text"]
    if all(_carried(docs.schema[c].dataType) for c in others):
        cut = _cut(docs, [F.col(c) for c in others], window, FILTER_BITS, True)
        return cut.select(*(F.col("kept" if c == "text" else f"keep_{others.index(c)}").alias(c) for c in docs.columns))
    row, key, left = unused(docs.columns, "row", "key", "left")
    cut = repeated_windows_removed(docs, window).where("n_removed > 0").select(F.col("row_key").alias(key), F.col("kept").alias(left))
    cut = materialize(cut.dropDuplicates([key]), "cut")
    out = docs.withColumn(row, row_key()).join(cut.hint("merge"), F.col(row) == F.col(key), "left")
    return out.select(*(F.coalesce(left, "text").alias("text") if c == "text" else F.col(c) for c in docs.columns))
