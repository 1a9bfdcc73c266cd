"""Language identification with a byte convolutional network."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textvec as tv

WINDOW = 256
#: Bytes of one text judged at a time, a whole number of windows.
STRETCH = 4 << 20
WIDTHS = (2, 3, 4)
FILTERS = 12
SAMPLE_PER_LANGUAGE = 800
#: The commonest languages only are learned, which bounds the sample.
LANGUAGES = 256
WINDOWS_PER_TEXT = 3
UNDETERMINED = "und"
#: Made windows of no language, as a share of the sampled ones, for the class that rejects.
NOISE_SHARE = 0.25
#: A text is of no language from this probability of the noise class.
REJECT = 0.99


@dataclass
class ByteConvNet:
    """Filters of several byte widths, max pooling over the window, ReLU, softmax.

    A filter over one-hot bytes is a table for each offset, so ``tables`` holds
    for offset k a row of filter weights for each byte value; a filter narrower
    than k + 1 has zeros there.
    """

    languages: list[str]  # the last output is the noise class, which has no name
    tables: np.ndarray  # (4, 256, filters)
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray
    _pairs: tuple | None = field(default=None, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"_pairs": None}

    def _pair_tables(self) -> tuple[np.ndarray, np.ndarray]:
        if self._pairs is None:
            t, wide = self.tables, self.bias.size * (len(WIDTHS) - 1) // len(WIDTHS)
            first = (t[0][:, None, :] + t[1][None, :, :]).reshape(65536, -1).astype(np.float32)
            second = np.ascontiguousarray((t[2][:, None, -wide:] + t[3][None, :, -wide:]).reshape(65536, -1), dtype=np.float32)
            self._pairs = first, second
        return self._pairs

    def pooled(self, grid: np.ndarray, step: int = 128) -> tuple[np.ndarray, np.ndarray | None]:
        """The pooled filter outputs of each row of a (windows, bytes) grid."""
        first, second = self._pair_tables()
        out = np.empty((len(grid), self.bias.size), dtype=np.float32)
        for i in range(0, len(grid), step):
            x = grid[i : i + step].astype(np.int32)
            pair = (x[:, :-1] << 8) | x[:, 1:]
            a = first[pair[:, :-2]]
            a[:, :, -second.shape[1] :] += second[pair[:, 2:]]
            out[i : i + step] = a.max(axis=1)
        return out + self.bias.astype(np.float32)

    def _sums(self, data: np.ndarray) -> np.ndarray:
        """The summed probabilities of the windows of one long text, a stretch of them at a time."""
        total = np.zeros(len(self.languages) + 1)
        for i in range(0, len(data), STRETCH):
            part = data[i : i + STRETCH]
            grid = np.zeros((-(-len(part) // WINDOW), WINDOW), dtype=np.uint8)
            grid.reshape(-1)[: len(part)] = part
            weight = np.full(len(grid), float(WINDOW))
            weight[-1] = len(part) - (len(grid) - 1) * WINDOW
            total += weight @ self.probabilities(grid)
        return total

    def probabilities(self, grid: np.ndarray) -> np.ndarray:
        z = np.maximum(self.pooled(grid), 0) @ self.out + self.out_bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language index, its probability among the languages, probability of noise) of each text: window probabilities weighted by the bytes each window holds."""
        lengths = np.diff(offsets)
        if len(lengths) == 1 and lengths[0] > STRETCH:
            p = self._sums(data)[None, :] / lengths[0]
            known, noise = p[:, :-1], p[:, -1]
            return known.argmax(axis=1), known.max(axis=1) / np.maximum(known.sum(axis=1), 1e-300), noise
        count = np.maximum(1, -(-lengths // WINDOW))
        at = np.concatenate(([0], np.cumsum(count)))
        flat = np.zeros(at[-1] * WINDOW, dtype=np.uint8)
        for r, (o, n) in enumerate(zip(offsets[:-1].tolist(), lengths.tolist(), strict=True)):
            flat[at[r] * WINDOW : at[r] * WINDOW + n] = data[o : o + n]
        p = self.probabilities(flat.reshape(-1, WINDOW))
        weight = np.full(at[-1], float(WINDOW))
        weight[at[1:] - 1] = np.maximum(1, lengths - (count - 1) * WINDOW)
        p = np.add.reduceat(p * weight[:, None], at[:-1], axis=0) / np.add.reduceat(weight, at[:-1])[:, None]
        known, noise = p[:, :-1], p[:, -1]
        return known.argmax(axis=1), known.max(axis=1) / np.maximum(known.sum(axis=1), 1e-300), noise


def train(grid: np.ndarray, labels: np.ndarray, languages: list[str], epochs: int = 12, seed: int = 7, rate: float = 0.02) -> ByteConvNet:
    """Adam on cross-entropy; the gradient of a pooled filter reaches only the place that won the pool."""
    rng = np.random.default_rng(seed)
    n_filters, n_out = FILTERS * len(WIDTHS), len(languages) + 1
    width = np.repeat(WIDTHS, FILTERS)
    use = np.arange(4)[:, None] < width[None, :]
    params = {"tables": rng.normal(0, 0.3, (4, 256, n_filters)) * use[:, None, :], "bias": np.zeros(n_filters), "out": rng.normal(0, 0.3, (n_filters, n_out)), "out_bias": np.zeros(n_out)}
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in params.items()}
    step = 0
    cols = np.arange(n_filters)
    for _ in range(epochs):
        order = rng.permutation(len(grid))
        for i in range(0, len(order), 64):
            rows = order[i : i + 64]
            x, y = grid[rows].astype(np.int64), labels[rows]
            length = x.shape[1] - 3
            z = sum(params["tables"][k][x[:, k : k + length]] for k in range(4))
            where = z.argmax(axis=1)
            pool = np.take_along_axis(z, where[:, None, :], axis=1)[:, 0] + params["bias"]
            hidden = np.maximum(pool, 0)
            logits = hidden @ params["out"] + params["out_bias"]
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(rows)), y] -= 1
            p /= len(rows)
            back = (p @ params["out"].T) * (pool > 0)
            grads = {"out": hidden.T @ p, "out_bias": p.sum(axis=0), "bias": back.sum(axis=0), "tables": np.zeros_like(params["tables"])}
            for k in range(4):
                byte = np.take_along_axis(x, where + k, axis=1)
                np.add.at(grads["tables"][k], (byte, np.broadcast_to(cols, byte.shape)), back * use[k])
            step += 1
            for k, g in grads.items():
                m, v = moments[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                params[k] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return ByteConvNet(languages, **params)


def fit(labelled: DataFrame, sample_per_language: int = SAMPLE_PER_LANGUAGE) -> ByteConvNet | None:
    """Train on a bounded sample of ``labelled`` (text, lang): about ``sample_per_language`` texts of each of the LANGUAGES commonest languages.

    The distinct texts are those of least hash, and of each a few windows at
    places set by the hash; only these short windows come to the driver, those
    of twice the sample at most. Made windows of no language (see ``_noise``)
    train one further output. No usable row gives None.
    """
    usable = labelled.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("text is not null and lang is not null and text <> ''")
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()}
    if not counts:
        return None
    share = F.element_at(F.create_map(*(F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, min(1.0, sample_per_language / n)))), F.col("lang"))
    h = F.xxhash64("text")
    picked = usable.where(F.pmod(h, F.lit(1 << 20)) < share * (1 << 20))
    places = [F.substring("text", (1 + F.pmod(F.xxhash64("text", F.lit(k)), F.greatest(F.length("text") - WINDOW // 2, F.lit(1)))).cast("int"), F.lit(WINDOW)) for k in range(WINDOWS_PER_TEXT)]
    once = picked.select("lang", h.alias("h"), F.array(*places).alias("parts")).dropDuplicates(["lang", "h"]).orderBy("h", "lang").limit(2 * sample_per_language * len(counts))
    rows = sorted((r["lang"], p) for r in once.collect() for p in r["parts"])
    languages = sorted(counts)
    rng = np.random.default_rng(3)
    noise = _noise(rng, max(1, int(NOISE_SHARE * len(rows))))
    grid = np.zeros((len(rows) + len(noise), WINDOW), dtype=np.uint8)
    for i, raw in enumerate([*(part.encode() for _, part in rows), *noise]):
        raw = raw[: WINDOW if rng.random() < 0.7 else int(rng.integers(8, 64))]
        grid[i, : len(raw)] = np.frombuffer(raw, dtype=np.uint8)
    return train(grid, np.array([*(languages.index(lang) for lang, _ in rows), *[len(languages)] * len(noise)], dtype=np.int64), languages)


def _noise(rng: np.random.Generator, n: int) -> list[bytes]:
    """Windows of no language: letters, digits and marks drawn at random, in one of a few alphabets, in words of any length, and raw code points."""
    lower, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    alphabets = [lower, lower + lower.upper() + digits, lower + lower.upper() + digits + "+/", "0123456789abcdef", digits + ".,-:;", "!#$%&()*+,-./:;<=>?@[]^_{|}~" + lower, None]
    out = []
    for i in range(n):
        alphabet = alphabets[i % len(alphabets)]
        chars = [chr(int(c)) for c in rng.choice(np.concatenate((np.arange(0xA1, 0x250), np.arange(0x370, 0x590), np.arange(0x4E00, 0x5200))), 80)] if alphabet is None else [alphabet[k] for k in rng.integers(0, len(alphabet), WINDOW)]
        gap = int(rng.choice([4, 8, 40, WINDOW]))
        out.append("".join(c + " " * bool(rng.integers(0, gap) == 0) for c in chars).encode()[:WINDOW])
    return out


def identify(docs: DataFrame, model: ByteConvNet | None, *keep: str) -> DataFrame:
    """``docs`` columns named in ``keep`` plus lang_pred, score and noise, for every row.

    The whole text is read in windows of 256 bytes. lang_pred is the likeliest
    language, score its probability among the languages, and noise that of the
    class of texts in no language. A null text, one without any letter, or no
    model gives ``und``, score 0 and noise 0. Other columns are ignored, those
    named like the results left out. Texts of any length go in pieces of 4 MB.
    """
    letter = F.coalesce(F.col("text").cast("string").rlike(r"\p{L}"), F.lit(False))
    base = docs.select(*keep, letter.alias("__letter"), *([] if "text" in keep else [F.col("text").cast("string")]))
    if model is None:
        return base.select(*keep, F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("noise"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    n, at = len(keep), keep.index("text") if "text" in keep else len(keep) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(shared.value.languages, type=pa.string())
        for batch in batches:
            data, offsets = tv.buffers(batch.column(at))
            for a, b in tv.slices(offsets, 4 << 20):
                which, score, noise = shared.value.predict(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                clear = batch.column(n).slice(a, b - a).to_numpy(zero_copy_only=False)
                lang = pa.compute.if_else(pa.array(clear), names.take(pa.array(which)), UNDETERMINED)
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in range(n)), lang, *(pa.array(np.where(clear, np.clip(x, 0, 1), 0.0).astype(np.float64)) for x in (score, noise))], [*keep, "lang_pred", "score", "noise"])

    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("noise", T.DoubleType())])
    return base.mapInArrow(run, schema)
