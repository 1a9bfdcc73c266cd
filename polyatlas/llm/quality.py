"""Quality rules: text statistics and a hashed n-gram log-likelihood ratio."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv

BUCKET_BITS = 16
GRAM = 4
TRUSTED_SAMPLE = 20_000
PRIOR = 0.1
#: Mean log-likelihood ratio a gram, in nats, from which a text is kept.
THRESHOLD = -0.3
_BYTES = 4 << 20
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _grams(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, row) of every run of four bytes inside a text."""
    if len(data) < GRAM:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    x = data.astype(np.uint32)
    code = x[:-3] | x[1:-2] << np.uint32(8) | x[2:-1] << np.uint32(16) | x[3:] << np.uint32(24)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inside = row[:-3] == row[3:]
    code = (code * np.uint32(0x9E3779B1)) ^ (code >> np.uint32(15))
    return ((code[inside] * np.uint32(0x85EBCA77)) >> np.uint32(32 - bits)).astype(np.int64), row[:-3][inside]


def fit(docs: DataFrame, labels: DataFrame, sample: int = TRUSTED_SAMPLE, bits: int = BUCKET_BITS) -> np.ndarray:
    """Log ratio, for each bucket, of the trusted to the raw multinomial.

    The raw one is add-one smoothed, the trusted one by a tenth of its own mass
    spread like the raw one, so an unseen bucket costs the same at every size.

    Trusted texts are at most ``sample`` documents that ``labels`` gives quality 1
    (those of least hashed id); the raw multinomial counts all documents. Counts
    leave each task as one vector of fixed length. No trusted text gives zeros.
    """
    good = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    ids = np.array(sorted(r[0] for r in good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()), dtype=np.int64)
    trusted = docs.sparkSession.sparkContext.broadcast(ids)
    size = 1 << bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, own = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64)
        for batch in batches:
            data, offsets = tv.buffers(batch.column(1))
            member = np.isin(batch.column(0).fill_null(-1).to_numpy(), trusted.value) & batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            for a, b in tv.slices(offsets, _BYTES):
                bucket, row = _grams(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], bits)
                raw += np.bincount(bucket, minlength=size)
                own += np.bincount(bucket[member[a:b][row]], minlength=size)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(own[at])], ["bucket", "raw", "own"])

    counts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "bucket long, raw long, own long")
    got = counts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("own").alias("own")).toArrow()
    raw, own = np.zeros(size), np.zeros(size)
    raw[got["bucket"].to_numpy()], own[got["bucket"].to_numpy()] = got["raw"].to_numpy(), got["own"].to_numpy()
    if not own.sum():
        return np.zeros(size)
    raw = (raw + 1) / (raw.sum() + size)
    return np.log((own / own.sum() + PRIOR * raw) / (1 + PRIOR) / raw)


def statistics(d: np.ndarray, o: np.ndarray) -> dict[str, np.ndarray]:
    """The base counts of each text of a buffer."""
    n = len(o) - 1
    s, e, first = tv.words(d, o)
    row, h = tv.fragment_rows(first), tv.span_hashes(d, s, e)
    byte_row = np.repeat(np.arange(n), np.diff(o))
    point = ((d & 0xC0) != 0x80) & ~tv.WHITESPACE[d]
    # lines: \n-split pieces that hold a word; hashed with the blanks around and inside them
    cut = np.flatnonzero(d == 10)
    begin = np.unique(np.concatenate((o[:-1][np.diff(o) > 0], cut + 1)))
    begin = begin[begin < len(d)]
    stop = np.append(begin[1:], len(d))
    stop = np.where((stop > begin) & (d[stop - 1] == 10), stop - 1, stop) if len(begin) else stop
    solid = np.searchsorted(s, stop) > np.searchsorted(s, begin)
    begin, stop = begin[solid], stop[solid]
    line = tv.span_hashes(_VISIBLE[d], begin, stop, gaps=True)
    line_row = np.searchsorted(o, begin, side="right") - 1
    order = np.lexsort((line, line_row))
    same = (line[order][1:] == line[order][:-1]) & (line_row[order][1:] == line_row[order][:-1])
    # words in runs of three found twice or more in the text
    w = tv.windows(h, 3)
    place = np.flatnonzero(row[: len(w)] == row[2 : 2 + len(w)])
    order3 = np.lexsort((w[place], row[place]))
    ws, rs = w[place][order3], row[place][order3]
    twin = (ws[1:] == ws[:-1]) & (rs[1:] == rs[:-1])
    again = np.zeros(len(ws), dtype=bool)
    again[1:] |= twin
    again[:-1] |= twin
    hit = place[order3][again]
    covered = np.zeros(len(s) + 2, dtype=bool)
    for k in range(3):
        covered[hit + k] = True
    return {
        "n_words": np.diff(first), "word_chars": np.bincount(byte_row[point], minlength=n), "n_symbols": np.bincount(byte_row[_SYMBOL[d]], minlength=n),
        "n_dup_lines": np.bincount(line_row[order][1:][same], minlength=n), "n_repeat_words": np.bincount(row[covered[: len(s)]], minlength=n),
    }


#: White space bytes map to bytes that UTF-8 never uses, so that they count in a line's hash.
_VISIBLE = np.arange(256, dtype=np.uint8)
_VISIBLE[np.flatnonzero(tv.WHITESPACE)] = np.arange(0xF8, 0xFE)


def judge(docs: DataFrame, ratios: np.ndarray, threshold: float = THRESHOLD, bits: int = BUCKET_BITS) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score) for every row.

    score is the mean log ratio of the text's four-byte grams; a text that
    passes the base rules is kept if it is ``threshold`` or more. Texts of fewer
    than four bytes score 0. A null text counts as empty; repeated rows each
    return; extra columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(ratios)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tv.buffers(batch.column(1))
            for a, b in tv.slices(offsets, _BYTES):
                d, o = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                stats = statistics(d, o)
                bucket, row = _grams(d, o, bits)
                total = np.bincount(row, shared.value[bucket], minlength=b - a)
                score = total / np.maximum(1, np.bincount(row, minlength=b - a))
                failed = (stats["n_words"] < 50) | (100 * stats["n_repeat_words"] > 50 * stats["n_words"])
                kept = ~failed & (score >= threshold)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *(pa.array(stats[k].astype(np.int64)) for k in names), pa.array(failed), pa.array(kept), pa.array(score)], ["doc_id", *names, "base_failed", "kept", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{k} long" for k in names) + ", base_failed boolean, kept boolean, score double")
