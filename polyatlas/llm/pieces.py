"""SentencePiece encoding and decoding by a streaming Viterbi search."""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Encoded segments that a worker remembers, in each of two generations.
REMEMBERED = 300_000
#: Longer segments are streamed, and not remembered.
LONG = 64
_SEGMENT = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")


class PieceModel:
    """Pieces, scores and byte fallback of a SentencePiece BPE model file."""

    def __init__(self, proto: bytes):
        sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        self.score: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.byte_id = [0] * 256
        self.raw: list[bytes] = []
        for i in range(sp.vocab_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.raw.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.raw.append(b"")
            else:
                self.ids[piece], self.score[piece] = i, sp.get_score(i)
                self.raw.append(piece.replace(SPACE, " ").encode())
        self.longest = max(map(len, self.ids))
        self.pieces = {i: piece for piece, i in self.ids.items()}
        #: Characters to nodes; 0 to the id of the piece that ends there, if its own text is encoded to it.
        self.trie: dict = {}
        #: The two pieces whose merge is the last on the way to a piece.
        self.split: dict[str, tuple[str, str]] = {}
        for piece, i in self.ids.items():
            node = self.trie
            for ch in piece:
                node = node.setdefault(ch, {})
            if len(piece) == 1:
                node[0] = i
            elif len(last := self.merged(piece, 2)) == 2 and last[0] + last[1] in self.score:
                node[0], self.split[piece] = i, (last[0], last[1])
        #: Pairs of characters inside a piece.
        self.inner = {piece[i : i + 2] for piece in self.ids for i in range(len(piece) - 1)}
        self._pairs: dict[int, bool] = {}
        self._young: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}

    def merged(self, text: str, stop: int = 1) -> list[str]:
        """The pieces of a short text by merging the best-scored neighbours, the leftmost first, down to ``stop`` pieces."""
        parts = list(text)
        score = self.score
        while len(parts) > stop:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, left: int, right: int) -> bool:
        """Whether the two pieces stay as they are side by side.

        Goes back in time from the whole pieces: undoes the later of the two
        last merges, and sees whether the parts that then met at the boundary
        would have merged before it. Of equal merges the left one comes first.
        """
        score, split = self.score, self.split
        u, v = self.pieces[left], self.pieces[right]
        across, known = score.get(u + v), None
        while known is None:
            if across is not None:
                known = False
            elif u in split and (v not in split or score[u] < score[v]):
                limit, u = score[u], split[u][1]
                across = score.get(u + v)
                across = across if across is not None and across > limit else None
            elif v in split:
                limit, v = score[v], split[v][0]
                across = score.get(u + v)
                across = across if across is not None and across >= limit else None
            else:
                known = True
        if len(self._pairs) > 2_000_000:
            self._pairs.clear()
        self._pairs[left << 16 | right] = known
        return known

    def stream(self, chunks: Iterable[str]) -> Iterator[int]:
        """Ids of a text that comes in chunks.

        Each boundary keeps the one last piece that can end there: a piece of
        the vocabulary, compatible with the survivor at its own start, found by
        walking a trie from that start. Only a window of one maximum piece
        length ahead is needed to start from a boundary. Now and then the
        backpointer paths of all boundaries ahead are followed to where they
        lead through one boundary; the ids up to it are given out, and it and
        the text before are forgotten. A character outside the vocabulary
        becomes its bytes.
        """
        trie, pairs, longest = self.trie, self._pairs, self.longest
        back: dict[int, tuple[int, int]] = {0: (-1, -1)}
        source, window = iter(chunks), ""
        base = start = 0
        while True:
            while source is not None and len(window) - (start - base) < longest:
                more = next(source, None)
                if more is None:
                    source = None
                else:
                    window += more
            if start - base >= len(window):
                break
            if start in back:
                left, node, end = back[start][1], trie, start
                for ch in window[start - base : start - base + longest]:
                    node = node.get(ch)
                    if node is None:
                        break
                    end += 1
                    if end not in back and 0 in node:
                        own = node[0]
                        if left < 0:
                            back[end] = (start, own)
                        else:
                            fits = pairs.get(left << 16 | own)
                            if fits or (fits is None and self.compatible(left, own)):
                                back[end] = (start, own)
                if end == start and start + 1 not in back:
                    back[start + 1] = (start, -1 - ord(window[start - base]))
            start += 1
            if start - base >= 4 * longest:
                paths = {b for b in back if b >= start}
                while len(paths) > 1:
                    top = max(paths)
                    paths.discard(top)
                    paths.add(max(back[top][0], base))
                at = paths.pop()
                if at > base:
                    yield from self._ids(back, at, base)
                    back = {b: v for b, v in back.items() if b >= at}
                    window, base = window[at - base :], at
        yield from self._ids(back, start, base)

    def _ids(self, back: dict[int, tuple[int, int]], end: int, done: int) -> list[int]:
        out: list[int] = []
        while end > done:
            start, own = back[end]
            if own >= 0:
                out.append(own)
            else:
                out.extend(self.byte_id[b] for b in reversed(chr(-1 - own).encode()))
            end = start
        return out[::-1]

    def segment(self, segment: str) -> bytes:
        """int32 ids of a segment; cut first where no piece could reach across, and remembered if it is short."""
        got = self._young.get(segment)
        if got is None:
            got = self._old.get(segment)
            if got is None:
                a, parts, inner = 0, [], self.inner
                for i in range(1, len(segment)):
                    if segment[i - 1 : i + 1] not in inner:
                        parts.append(segment[a:i])
                        a = i
                got = b"".join(map(self.segment, [*parts, segment[a:]])) if parts else array("i", self.stream((segment,))).tobytes()
                if len(segment) > LONG:
                    return got
            if len(self._young) >= REMEMBERED:
                self._old, self._young = self._young, {}
            self._young[segment] = got
        return got

    def encode(self, text: str) -> bytes:
        """int32 ids of a text. No piece reaches past the start of a word or over a line break, so segments between them are encoded alone."""
        if not text:
            return b""
        return b"".join(map(self.segment, _SEGMENT.findall(SPACE + text.replace(" ", SPACE))))

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD."""
        raw = self.raw
        text = b"".join([raw[i] for i in ids]).decode("utf-8", errors="replace")
        return text[1:] if text.startswith(" ") else text


_MODELS: dict[str, PieceModel] = {}


def piece_model(proto: bytes) -> PieceModel:
    """The model of the bytes of a model file, kept by each process."""
    key = hashlib.sha256(proto).hexdigest()
    if key not in _MODELS:
        _MODELS[key] = PieceModel(proto)
    return _MODELS[key]


def model_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """(doc_id, ids array<int>, n_chars long, round_trip boolean) for every row.

    Whole texts are encoded; round_trip tells whether decoding gives the text
    back, which holds for all texts without U+2581, the space mark itself. A
    null text has null ids and round_trip, an empty one no ids. Repeated rows
    each return; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model_bytes(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(shared.value)
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                texts = part.column(1).to_pylist()
                coded = [None if t is None else model.encode(t) for t in texts]
                sizes = np.array([0 if c is None else len(c) // 4 for c in coded])
                flat = np.frombuffer(b"".join(c for c in coded if c), dtype=np.int32)
                offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
                mask = pa.array([c is None for c in coded])
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat), mask=mask)
                same = [None if t is None else model.decode(flat[x:y].tolist()) == t for t, x, y in zip(texts, offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), ids, pa.array([None if t is None else len(t) for t in texts], type=pa.int64()), pa.array(same, type=pa.bool_())], ["doc_id", "ids", "n_chars", "round_trip"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, ids array<int>, n_chars long, round_trip boolean")


def decode(coded: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """(doc_id, text) of (doc_id, ids); null ids give null, ids out of range are skipped."""
    shared = coded.sparkSession.sparkContext.broadcast(model_bytes(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(shared.value)
        n = len(model.raw)
        for batch in batches:
            texts = [None if ids is None else model.decode(i for i in ids if i is not None and 0 <= i < n) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, type=pa.string())], ["doc_id", "text"])

    kind = coded.schema["doc_id"].dataType.simpleString()
    return coded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")
