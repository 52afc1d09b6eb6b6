"""SentencePiece encoding and decoding by a Viterbi pass over a trie of marked words.

A normalised text is cut into marked words (the space marks before a word belong to it);
no piece crosses such a cut. The distinct words of a slice of documents are sorted, which
walks their trie depth first: the forward states of the prefix a word shares with the
one before it are reused, and only the rest of the word is computed.

The state of a prefix is its best last piece with its forward score. In a unigram model
the best sum of scores wins. In a BPE model a transition between two pieces counts only
if merging their joined text gives just these two; pairwise validity makes the whole
segmentation the one that merging would give, exactly one last piece qualifies for each prefix,
and the pass reproduces byte for byte what merging by rank produces.

The vocabulary is read on the driver and broadcast (its size does not depend on the data).
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from factloom.llm.workers import kept

MARK = "▁"
WORDS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: Bytes of text handled at once, and words and piece pairs remembered by a worker.
SLICE, KEPT_WORDS, KEPT_PAIRS = 1_000_000, 600_000, 1_000_000
#: Bytes and words of a lean worker, which shares an executor's memory with what earlier stages have left.
LEAN_SLICE, LEAN_WORDS = 250_000, 60_000
#: What a unigram model charges for an unknown character below its lowest score.
UNKNOWN_PENALTY = 10.0
# --- fixed values: kinds of model ---
UNIGRAM, BPE = 1, 2


def model_bytes(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def model_type(model: bytes) -> int:
    """The model's kind as its trainer noted it: field 3 of the message in field 2 (absent: unigram)."""
    def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
        at = 0

        def number() -> int:
            nonlocal at
            value = shift = 0
            while True:
                byte, at = data[at], at + 1
                value |= (byte & 127) << shift
                shift += 7
                if byte < 128:
                    return value

        while at < len(data):
            tag = number()
            if tag & 7 == 0:
                yield tag >> 3, number()
                continue
            size = {1: 8, 5: 4}.get(tag & 7) or number()
            yield tag >> 3, data[at:at + size]
            at += size

    kinds = [v for n, spec in fields(model) if n == 2 for m, v in fields(spec) if m == 3]
    return kinds[-1] if kinds else UNIGRAM


@dataclass
class Vocabulary:
    """Pieces, scores and special ids of a model, and the forward pass over marked words."""

    scores: dict[str, float]
    ids: dict[str, int]
    unknown: int
    byte_ids: list[int]
    raw: list[bytes]
    merges: bool
    pairs: dict[int, bool] = field(default_factory=dict)
    words: dict[str, bytes] = field(default_factory=dict)
    again: set[str] = field(default_factory=set)
    room: int | None = None

    def __post_init__(self) -> None:
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("pieces that hold a space mark after other characters are not supported")
        self.lowest = min(self.scores.values(), default=0.0) - UNKNOWN_PENALTY
        self.text = {i: p for p, i in self.ids.items()}
        self._index([p for p in self.ids if len(p) < 2 or not self.merges or self.merge(p) == [p]])  # merging reaches no others

    def _index(self, pieces: list[str]) -> None:
        """Trie of the pieces: per node its children, the node of its longest proper suffix, and the pieces that end there.

        Pieces are (characters, id), the longest first.
        """
        self.children: list[dict[str, int]] = [{}]
        own = [-1]
        for piece in pieces:
            node = 0
            for c in piece:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    own.append(-1)
                node = self.children[node][c]
            own[node] = self.ids[piece]
        self.suffix = [0] * len(own)
        self.ends: list[tuple[tuple[int, int], ...]] = [()] * len(own)
        level, depth = [0], 0
        while level:
            below = []
            for node in level:
                if node:
                    self.ends[node] = (((depth, own[node]),) if own[node] >= 0 else ()) + self.ends[self.suffix[node]]
                for c, child in self.children[node].items():
                    self.suffix[child] = self._step(self.suffix[node], c) if node else 0
                    below.append(child)
            level, depth = below, depth + 1

    def _step(self, node: int, c: str) -> int:
        """Node of the longest suffix of a node's text and one more character."""
        while node and c not in self.children[node]:
            node = self.suffix[node]
        return self.children[node].get(c, 0)

    @classmethod
    def of(cls, model: bytes) -> Vocabulary:
        source = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = source.get_piece_size()
        normal = [i for i in range(size) if not (source.is_byte(i) or source.is_control(i) or source.is_unknown(i) or source.is_unused(i))]
        byte_ids, raw = [-1] * 256, []
        for i in range(size):
            piece = source.id_to_piece(i)
            if source.is_byte(i):
                byte_ids[int(piece[3:5], 16)] = i
                raw.append(bytes([int(piece[3:5], 16)]))
            else:
                raw.append(b"" if source.is_control(i) else " ⁇ ".encode() if source.is_unknown(i) else piece.encode())
        ids = {source.id_to_piece(i): i for i in normal}
        scores = {p: source.get_score(i) for p, i in ids.items()}
        kind = model_type(model)
        if kind not in (UNIGRAM, BPE):
            raise ValueError(f"model type {kind} is neither unigram nor BPE")
        return cls(scores, ids, source.unk_id(), byte_ids if min(byte_ids) >= 0 else [], raw, kind == BPE)

    def merge(self, text: str) -> list[str]:
        """Join the adjacent pair of best score, the leftmost of equals, until none is a piece."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                return parts
            parts[at:at + 2] = [parts[at] + parts[at + 1]]

    def _follows(self, before: int, piece: int) -> bool:
        if len(self.pairs) >= KEPT_PAIRS:
            self.pairs.clear()
        a, b = self.text[before], self.text[piece]
        known = self.pairs[before * len(self.raw) + piece] = self.merge(a + b) == [a, b]
        return known

    def _merged(self, word: str, shared: int, nodes: list[int], last: list[int], starts: list[int]) -> None:
        """Append the states of a word's prefixes beyond ``shared``: the one last piece that merging leaves (-1: unknown) and its start."""
        children, suffix, ends, pairs, size = self.children, self.suffix, self.ends, self.pairs, len(self.raw)
        node = nodes[shared]
        for end in range(shared, len(word)):
            c = word[end]
            while node and c not in children[node]:
                node = suffix[node]
            node = children[node].get(c, 0)
            nodes.append(node)
            for length, piece in ends[node]:
                start = end + 1 - length
                before = last[start]
                if before < 0 or (pairs[key] if (key := before * size + piece) in pairs else self._follows(before, piece)):
                    starts.append(start)
                    last.append(piece)
                    break
            else:
                starts.append(end)
                last.append(-1)

    def _scored(self, word: str, shared: int, nodes: list[int], last: list[int], starts: list[int], totals: list[float]) -> None:
        """The same for a unigram model: the last piece of the best sum of scores, the longest of equals."""
        del totals[shared + 1:]
        for end in range(shared, len(word)):
            node = self._step(nodes[-1], word[end])
            nodes.append(node)
            found = [(end + 1 - length, piece, totals[end + 1 - length] + self.scores[self.text[piece]]) for length, piece in self.ends[node]]
            if not found or found[-1][0] < end:
                found.insert(0, (end, -1, totals[end] + self.lowest))
            start, piece, total = max(found, key=lambda f: f[2])
            totals.append(total)
            starts.append(start)
            last.append(piece)

    def learn(self, words: set[str]) -> None:
        """Encode words not yet known, depth first over their trie."""
        new = words - self.words.keys()
        self.again |= words - new
        room = KEPT_WORDS if self.room is None else self.room
        if len(self.words) + len(new) > room:  # words that never came again make room
            held = self.again if len(self.again) <= room // 2 else words - new
            self.words = {w: self.words[w] for w in held}
            self.again = set()
        new = sorted(new)
        nodes, last, starts, totals, before = [0], [-1], [0], [0.0], ""
        for word in new:
            shared = 0
            for a, b in zip(before, word):
                if a != b:
                    break
                shared += 1
            for states in (nodes, last, starts):
                del states[shared + 1:]
            if self.merges:
                self._merged(word, shared, nodes, last, starts)
            else:
                self._scored(word, shared, nodes, last, starts, totals)
            before, ids, end = word, [], len(word)
            while end:
                if last[end] >= 0:
                    ids.append(last[end])
                else:
                    ids += [self.byte_ids[b] for b in reversed(word[starts[end]:end].encode())] if self.byte_ids else [self.unknown]
                end = starts[end]
            self.words[word] = array("i", reversed(ids)).tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Piece ids of normalised texts."""
        split = [WORDS.findall(t) for t in texts]
        self.learn(set(chain.from_iterable(split)))
        return [np.frombuffer(b"".join(map(self.words.__getitem__, w)), np.int32) for w in split]

    def decode(self, ids: np.ndarray, lead: bool) -> str:
        """Text of piece ids; ``lead``: the first space was added when encoding."""
        text = b"".join(map(self.raw.__getitem__, ids.tolist())).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if lead and text[:1] == " " else text


def _slices(batch: pa.RecordBatch, size: int) -> Iterator[pa.RecordBatch]:
    """Rows of a batch, so many at once that their texts have about ``size`` bytes."""
    sizes = pc.fill_null(pc.binary_length(batch.column("_text")), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes, dtype=np.int64) // size
    cuts = np.r_[0, np.flatnonzero(np.diff(part)) + 1, len(sizes)]
    for a, b in zip(cuts[:-1], cuts[1:]):
        yield batch.slice(a, b - a)


class _Worker:
    """What a Python worker keeps between batches: the normaliser and the vocabulary."""

    def __init__(self, model: bytes) -> None:
        self.normalizer = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.vocabulary = Vocabulary.of(model)
        self.lead = self.normalizer.normalize("a").startswith(MARK)

    @classmethod
    def get(cls, model: bytes, room: int | None = None) -> _Worker:
        worker = kept(("pieces", model), lambda: cls(model))
        worker.vocabulary.room = room
        return worker


def encode(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), lean: bool = False) -> DataFrame:
    """Add ``ids`` (array<int>), ``n_ids`` and ``round_trip`` to the kept columns.

    ``round_trip`` tells whether decoding the ids gives the normalised text back. A null
    text has null ids, n_ids 0 and round_trip null; an empty text has no ids. Characters
    outside the vocabulary become bytes, or the unknown piece in a model without bytes.
    Rows are independent of each other: repeated rows repeat their result, an empty table gives no rows.
    ``lean`` has workers remember fewer words: the same result in less memory and more time.
    """
    model = docs.sparkSession.sparkContext.broadcast(model_bytes(path))
    given = docs.select(*keep, F.col(text).cast("string").alias("_text"))
    schema = StructType([docs.schema[c] for c in keep]).add("ids", ArrayType(IntegerType())).add("n_ids", "long").add("round_trip", "boolean")
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = _Worker.get(model.value, LEAN_WORDS if lean else None)
        vocabulary, lead = worker.vocabulary, worker.lead
        for part in chain.from_iterable(_slices(batch, LEAN_SLICE if lean else SLICE) for batch in batches):
            texts = part.column("_text").to_pylist()
            normal = [worker.normalizer.normalize(t) if t else "" for t in texts]
            ids = vocabulary.encode(normal)
            back = [vocabulary.decode(i, lead) == n.replace(MARK, " ")[1 if lead and n else 0:] for i, n in zip(ids, normal)]
            null = [t is None for t in texts]
            yield pa.RecordBatch.from_arrays([
                *part.columns[:-1], pa.array([None if x else i for x, i in zip(null, ids)], pa.list_(pa.int32())),
                pa.array([len(i) for i in ids], pa.int64()), pa.array([None if x else r for x, r in zip(null, back)], pa.bool_())], names)

    return given.mapInArrow(run, schema)


def decode(rows: DataFrame, path: str, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Add ``text``, what the ids stand for, to the kept columns; null ids give null, no ids the empty text.

    Bytes that form no character become U+FFFD; control pieces stand for nothing. Ids outside
    the vocabulary are an error.
    """
    model = rows.sparkSession.sparkContext.broadcast(model_bytes(path))
    schema = StructType([rows.schema[c] for c in keep]).add("text", "string")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        worker = _Worker.get(model.value)
        for frame in frames:
            texts = [None if i is None else worker.vocabulary.decode(np.asarray(i, np.int32), worker.lead) for i in frame["_ids"]]
            yield frame.drop(columns="_ids").assign(text=texts)

    return rows.select(*keep, F.col(ids).alias("_ids")).mapInPandas(run, schema)
