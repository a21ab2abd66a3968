"""SentencePiece encoding and decoding by shortest paths through a weighted transducer.

The model file is compiled into one transducer over code points, in the
tropical semiring:

- normaliser: a dummy prefix, and in every state the arc that reads U+2581 also
  reads a space;
- pieces: a chain of arcs per piece (shared beginnings share states) into a
  final state that carries the piece's id and weight and goes back to the start;
- byte fallback: from the start, an arc per code point that no piece covers,
  into a final state with its byte ids.

An input is composed with it lazily and the shortest path is found best first:
the lightest open arc is taken, of equally light ones the one that reaches
furthest. For a unigram model an arc weighs minus its piece's score. For a BPE
model the encoding is the one path all of whose neighbouring pieces are stable
(merging their joint text by the model's scores gives the two pieces back): arcs
between other neighbours weigh infinity and all others nothing, and each prefix
of the input then has exactly one path of finite weight, so one state per
position suffices. Stability of a pair is worked out once and kept. With no
weights to compare the queue is a stack: an arc that is taken reaches as far as
any open one, so all that leave its end reach further. Of these only the longest
is open at first, and a refused one gives way to the next shorter.

No piece has U+2581 behind another character, so the input is cut before each
run of it (and around line feeds, which no piece holds) and the composition is
done per part; parts repeat, and a bounded cache keeps the ids of those met twice.
A position is left by arcs no longer than the longest piece, so time is linear in
the text. All state is per task and bounded. The vocabulary's path is a parameter.

Defined results: a null or empty text has no ids and decodes to the empty text.
Texts of any length are taken whole. Decoding gives the normalised text: U+2581
itself comes back as a space, as it does in the model's own library; all other
texts come back unchanged. Rows that share a doc_id are encoded each. An empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MODEL = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers") + "/piece_bpe_32k.model"
SPACE = "▁"
_UNIGRAM, _BPE = 1, 2
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6
_CUT = "\x00"  # between parts; texts that hold it are cut by the general pattern
_ARCS, _ID, _WEIGHT = 0, 1, 2  # of a state; the id is -1 where no piece ends
_SLICE_BYTES = 8 << 20
_PARTS, _PAIRS, _LONG, _MET = 1 << 17, 1 << 17, 64, 1 << 22


class Reader:
    """What decoding needs of a model: the bytes of each piece."""

    def __init__(self, pieces: list[bytes], dummy_prefix: bool):
        self.pieces, self.dummy_prefix = pa.array(pieces, pa.binary()), dummy_prefix

    def texts(self, ids: pa.ListArray) -> list[str]:
        joined = pc.binary_join(pa.ListArray.from_arrays(ids.offsets, self.pieces.take(ids.values)), b"")
        return [self._text(raw) for raw in joined.to_pylist()]

    def _text(self, raw: bytes) -> str:
        text = raw.decode("utf-8", "replace")
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text


class Transducer:
    """The compiled model. Pickles as its tables; caches start empty in each task."""

    def __init__(self, kind: int, pieces: list[tuple[str, float, int]], dummy_prefix: bool):
        self.kind, self.pieces, self.dummy_prefix = kind, pieces, dummy_prefix
        self.ids = {p: i for i, (p, _, t) in enumerate(pieces) if t == _NORMAL}
        self.scores = {p: s for p, s, t in pieces if t == _NORMAL}
        self.bytes = {int(p[3:5], 16): i for i, (p, _, t) in enumerate(pieces) if t == _BYTE}
        self.unknown = next((i for i, p in enumerate(pieces) if p[2] == _UNKNOWN), 0)
        self.penalty = 10 - min(self.scores.values(), default=0.0)
        self.other = len(pieces)  # stands for any character that no piece covers
        self.raw = [i.to_bytes(4, "little") for i in range(len(pieces))]
        start: list = [{}, -1, 0.0]
        for piece, i in self.ids.items():
            state = start
            for c in piece:
                if (arc := state[_ARCS].get(c)) is None:
                    arc = state[_ARCS][c] = [{}, -1, 0.0]
                    if c == SPACE:
                        state[_ARCS][" "] = arc
                state = arc
            state[_ID:] = i, -self.scores[piece]
        self.start: dict[str, list] = start[_ARCS]
        #: By id, that of `other` last: characters, and the longest other piece that it begins with (-1: none).
        self.lengths, self.shorter = [0] * self.other + [1], [-1] * (self.other + 1)
        for piece, i in self.ids.items():
            self.lengths[i] = len(piece)
            self.shorter[i] = next((found for k in range(len(piece) - 1, 0, -1) if (found := self.ids.get(piece[:k], -1)) >= 0), -1)
        holds_feed = any("\n" in p for p in self.ids)
        cut_ok = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self.plain = cut_ok and not holds_feed
        self.parts = re.compile((f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+" if holds_feed else f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n") if cut_ok else r"(?s).+")
        self.reader = Reader([bytes([int(p[3:5], 16)]) if t == _BYTE else b"" if t == _CONTROL else p.replace(SPACE, " ").encode() for p, _, t in pieces], dummy_prefix)
        self._part: dict[str, bytes] = {"": b""}
        self._before: dict[str, bytes] = {}
        self._met = bytearray(_MET)
        self._stable: dict[int, bool] = {}  # by left id * (number of pieces + 1) + right id
        self._halves: dict[str, tuple[str, str] | None] = {}  # of pieces and single characters

    def __reduce__(self):
        return Transducer, (self.kind, self.pieces, self.dummy_prefix)

    @classmethod
    def load(cls, path: str) -> Transducer:
        from sentencepiece import sentencepiece_model_pb2 as model_pb2

        model = model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        rules, kind = model.normalizer_spec, model.trainer_spec.model_type
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.escape_whitespaces:
            raise ValueError("only the identity normaliser with escaped white space is compiled")
        if kind not in (_UNIGRAM, _BPE) or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only unigram and BPE models with white space as a prefix are compiled")
        return cls(kind, [(p.piece, p.score, p.type) for p in model.pieces], rules.add_dummy_prefix)

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, np.int32)
        parts = self._split(" " + text if self.dummy_prefix else text)
        ids = list(map(self._part.get, parts))
        if None in ids:
            ids = [self._ids(part) if found is None else found for part, found in zip(parts, ids)]
        return np.frombuffer(b"".join(ids), np.int32)

    def _split(self, text: str) -> list[str]:
        if not self.plain or _CUT in text or SPACE in text:
            return self.parts.findall(text.replace(" ", SPACE))
        text = text.replace(" ", _CUT + SPACE)
        while SPACE + _CUT + SPACE in text:
            text = text.replace(SPACE + _CUT + SPACE, SPACE * 2)
        return text.replace("\n", f"{_CUT}\n{_CUT}").split(_CUT)

    def _ids(self, part: str) -> bytes:
        """Of a part that is not among the newer half of the kept ones."""
        ids = self._before.get(part)
        if ids is None:
            ids = self._part.get(part)  # kept since its text was looked up
            if ids is not None:
                return ids
            ids = b"".join(self.shortest(part))
            if len(part) > _LONG:
                return ids
            if not self._met[at := hash(part) % _MET]:  # most parts occur once: they would push the others out
                self._met[at] = 1
                return ids
        if len(self._part) >= _PARTS:  # the older half goes, frequent parts have moved to the newer one
            self._before, self._part, self._met = self._part, {"": b""}, bytearray(_MET)
        self._part[part] = ids
        return ids

    def decode(self, ids: list[int]) -> str:
        return self.reader.texts(_list_array([np.array(ids, np.int32)]))[0]

    def _fallback(self, point: str) -> bytes:
        ids = [self.bytes[b] for b in point.encode()] if self.bytes else [self.unknown]
        return b"".join(i.to_bytes(4, "little") for i in ids)

    def shortest(self, text: str) -> list[bytes]:
        """The ids along the shortest path that reads `text`, best first over (weight so far, furthest end)."""
        if not text:
            return []
        return self._stable_path(text) if self.kind == _BPE else self._lightest_path(text)

    def _lightest_path(self, text: str) -> list[bytes]:
        n, push = len(text), heapq.heappush
        came: dict[int, tuple[int, int]] = {}  # of settled positions: where their arc starts, and its id
        heap = [(0.0, 0, 0, -1)]
        while n not in came:
            cost, end, begin, piece = heapq.heappop(heap)
            end = -end
            if end in came:
                continue
            came[end] = begin, piece
            # the arcs that leave this position: the states that the text leads through
            if end < n and text[end] not in self.ids:
                push(heap, (cost + self.penalty, -end - 1, end, self.other))
            arcs, at = self.start, end
            while at < n and (state := arcs.get(text[at])) is not None:
                arcs, piece, weight = state
                at += 1
                if piece >= 0 and at not in came:
                    push(heap, (cost + weight, -at, end, piece))
        path, at = [], n
        while at:
            begin, piece = came[at]
            path.append(self.raw[piece] if piece < self.other else self._fallback(text[begin:at]))
            at = begin
        return path[::-1]

    def _stable_path(self, text: str) -> list[bytes]:
        n, stable, first, shorter, lengths, other, width = len(text), self._stable, self.start, self.shorter, self.lengths, self.other, self.other + 1
        settled, begins = [-1] * (n + 1), [0] * (n + 1)  # of settled positions: their arc's id, and where it starts
        stack: list[tuple[int, int]] = []  # open arcs: begin, id
        begin = 0
        while True:
            # the longest arc that leaves this position: the states that the text leads through
            piece, at, state = -1, begin, first.get(text[begin])
            alone = state is None or state[1] < 0  # no piece covers the character
            while state is not None:
                arcs, found, _ = state
                if found >= 0:
                    piece = found
                at += 1
                state = arcs.get(text[at]) if at < n else None
            if alone:
                if piece >= 0:
                    stack.append((begin, other))
                else:
                    piece = other
            while True:
                if piece < 0:
                    begin, piece = stack.pop()
                end = begin + lengths[piece]
                if settled[end] < 0:
                    if not begin:
                        break
                    known = stable.get(pair := settled[begin] * width + piece)
                    if known or known is None and self._is_stable(pair, text[begins[begin] : begin], text[begin:end]):
                        break
                piece = shorter[piece]
            settled[end], begins[end] = piece, begin
            if end == n:
                break
            if (piece := shorter[piece]) >= 0:
                stack.append((begin, piece))
            begin = end
        path, at = [], n
        while at:
            begin, piece = begins[at], settled[at]
            path.append(self.raw[piece] if piece < other else self._fallback(text[begin:at]))
            at = begin
        return path[::-1]

    def _is_stable(self, pair: int, left: str, right: str) -> bool:
        if len(self._stable) >= _PAIRS:
            self._stable.clear()
        # runs of white space share one score, so only carrying the merges out tells
        found = self._stable[pair] = self._merged(left + right) == [left, right] if SPACE * 2 in left + right else self._holds(left, right)
        return found

    def _holds(self, left: str, right: str) -> bool:
        """No merge across the border comes before the merges that made its two sides.

        Undo these merges from the last to the first; at each step the pieces that then touch at the border must not
        form a piece that would have been merged earlier than what has been undone.
        """
        scores, least, or_equal = self.scores, -math.inf, False
        while True:
            joint = scores.get(left + right)
            if joint is not None and (joint > least or or_equal and joint == least):
                return False
            made_left, made_right = self._made(left), self._made(right)
            if made_left is None or made_right is None:  # a piece that merging never makes
                return False
            if len(left) > 1 and (len(right) == 1 or scores[left] < scores[right]):
                least, or_equal, left = scores[left], False, made_left[1]
            elif len(right) > 1:
                least, or_equal, right = scores[right], True, made_right[0]
            else:
                return True

    def _made(self, piece: str) -> tuple[str, str] | None:
        """The two pieces that the last merge of `piece` joins; itself twice if it is a character."""
        found = self._halves.get(piece, False)
        if found is False:
            parts = self._merged(piece, 2)
            found = self._halves[piece] = (piece, piece) if len(piece) == 1 else tuple(parts) if len(parts) == 2 and self._merged(piece) == [piece] else None
        return found

    def _merged(self, text: str, stop: int = 1) -> list[str]:
        """Merge the best-scored neighbours, leftmost first, until none is a piece or `stop` parts are left. For short texts."""
        parts, scores, none = list(text), self.scores, -math.inf
        while len(parts) > stop:
            joint = [scores.get(a + b, none) for a, b in zip(parts, parts[1:])]
            best = max(joint)
            if best == none:
                break
            at = joint.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts


def _list_array(lists: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, lists)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*lists, np.empty(0, np.int32)])))


def _slices(batches: Iterator[pa.RecordBatch], sized: int, rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches cut to `rows`, and to _SLICE_BYTES (or one row) of their column `sized`."""
    for batch in batches:
        column = batch.column(sized)
        width = pc.binary_length(column) if pa.types.is_string(column.type) else pc.list_value_length(column)
        upto, start = np.cumsum(pc.fill_null(width, 0).to_numpy(zero_copy_only=False).astype(np.int64)), 0
        while start < batch.num_rows:
            stop = min(start + rows, max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + _SLICE_BYTES, "right"))))
            yield batch.slice(start, stop - start)
            start = stop


_ENCODED = "doc_id long, text string, ids array<int>, ids_sha256 string"


def _encoded(t: Transducer, batch: pa.RecordBatch) -> pa.RecordBatch:
    """A batch (doc_id, text) with its ids and their digest."""
    ids = [t.encode(text) for text in batch.column(1).to_pylist()]
    digests = pa.array([hashlib.sha256(i.astype("<i4", copy=False)).hexdigest() for i in ids], pa.string())
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _list_array(ids), digests], names=["doc_id", "text", "ids", "ids_sha256"])


def encode(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, text, ids array<int>, ids_sha256: of the ids as little-endian 32-bit integers)"""
    compiled = docs.sparkSession.sparkContext.broadcast(Transducer.load(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = compiled.value
        for batch in _slices(batches, 1):
            yield _encoded(t, batch)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _ENCODED)


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """encoded (any columns, ids array<int>) with the text `decoded`; null ids decode to the empty text."""
    reader = encoded.sparkSession.sparkContext.broadcast(Transducer.load(model).reader)
    at = encoded.columns.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, at):
            column = batch.column(at)
            ends = np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))))
            texts = reader.value.texts(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), column.flatten()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])

    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField("decoded", T.StringType())]))


def encode_decode(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """encode's columns with the text `decoded` from the ids, both in one worker per task."""
    compiled = docs.sparkSession.sparkContext.broadcast(Transducer.load(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = compiled.value
        for batch in _slices(batches, 1):
            encoded = _encoded(t, batch)
            yield pa.RecordBatch.from_arrays([*encoded.columns, pa.array(t.reader.texts(encoded.column(2)), pa.string())], names=[*encoded.schema.names, "decoded"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"{_ENCODED}, decoded string")


def digests(decoded: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, round_trip) of what encode and decode gave."""
    normal = F.translate(F.coalesce("text", F.lit("")), SPACE, " ")
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"), (F.col("decoded") == normal).alias("round_trip"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(encode_decode(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))
