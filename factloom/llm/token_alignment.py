"""Alignment of the tokens that two tokenizers give the same text.

Tokenizer A is a byte-level BPE vocabulary file, tokenizer B a SentencePiece model. Every token stands for bytes, so
the running sums of token sizes are byte offsets. Two dictionaries map each offset where a token ends to the
token's place in its list; the intersection of their keys, sorted, cuts both lists into the smallest groups that cover
the same bytes. Tokens of a group that end on the cut itself are linked.

A splits texts before it merges, and no token of it goes on from a character that isn't white space into a space; nor does one of B in
the models checked for that when they are read. Both lists thus have a cut at each such place. A text is aligned word by word (a
word with the white space before it), and each distinct word of a block of documents once. A model B that fails the check has its texts aligned whole.

How often two ids are linked is counted over all documents. Documents are handled in blocks of bounded text size. A block
reports its distinct pairs once, with their number, so a pair that every document holds crosses the network once a block;
its totals return to the block by one more exchange, where the documents keep only positions in the block's list.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import accumulate, count

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.session import reread

#: Bytes of text of a block (one longer text is a block of its own), of a call of a tokenizer, and pairs of a row.
BLOCK, CALL, PAIRS = 16 << 20, 1 << 20, 1 << 16
#: How byte-level vocabularies split texts before merging (a fixed value of the format).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SCHEMA = "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, places binary, times binary, start long, codes array<long>, counts array<long>"
ARROW = pa.schema([
    *((name, pa.int64()) for name in ("block", "doc_id", "n_a", "n_b", "n_groups", "n_links")),
    ("groups", pa.string()), ("places", pa.binary()), ("times", pa.binary()), ("start", pa.int64()), ("codes", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))])


def _alphabet() -> dict[str, int]:
    """Byte of each character of a byte-level vocabulary: printable Latin-1 stands for itself, the rest follows from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(2)
def byte_tokenizer(model: str) -> tuple[tiktoken.Encoding, list[bytes]]:
    """The tokenizer of a vocabulary file's content, and the bytes of each id.

    Merges have to be numbered in their order, as in files that training wrote; then merging by the smallest id of the joined
    bytes is merging by rank. Special tokens are left out: their strings in a text are plain text.
    """
    held, letters = json.loads(model)["model"], _alphabet()
    made = [held["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in held["merges"]]
    if made != sorted(made):
        raise ValueError("the vocabulary numbers its merges out of order")
    special = {t["content"] for t in json.loads(model).get("added_tokens", [])}
    ranks = {bytes(letters[c] for c in token): i for token, i in held["vocab"].items() if token not in special}
    table = [b""] * (max(ranks.values()) + 1)
    for raw, i in ranks.items():
        table[i] = raw
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), table


@lru_cache(2)
def piece_tokenizer(model: bytes) -> tuple[sentencepiece.SentencePieceProcessor, list[bytes]]:
    """The tokenizer of a model's content, and the bytes of each id."""
    pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
    raw = lambda i, piece: bytes([int(piece[3:5], 16)]) if pieces.is_byte(i) else piece.replace("▁", " ").encode()
    return pieces, [raw(i, pieces.id_to_piece(i)) for i in range(pieces.get_piece_size())]


def cuts(ends_a: list[int], ends_b: list[int]) -> list[tuple[int, int]]:
    """Numbers of tokens of either list before each offset where tokens of both end, in order."""
    place_a, place_b = dict(zip(ends_a, count(1))), dict(zip(ends_b, count(1)))
    return [(place_a[end], place_b[end]) for end in sorted(place_a.keys() & place_b.keys())]


def groups_and_links(a: list[int], b: list[int], ends_a: list[int], ends_b: list[int]) -> tuple[list[str], list[tuple[int, int]]]:
    """Groups as ``a1,a2|b1``, and the pairs (A id, B id) of all tokens that end together.

    In a group every A token that ends on the cut is linked with every such B token: one pair, unless there are tokens without bytes.
    """
    groups, linked, i, j = [], [], 0, 0
    for to_i, to_j in cuts(ends_a, ends_b):
        if to_i - i == 1 == to_j - j:
            groups.append(f"{a[i]}|{b[j]}")
            linked.append((a[i], b[j]))
            i, j = to_i, to_j
            continue
        groups.append(",".join(map(str, a[i:to_i])) + "|" + ",".join(map(str, b[j:to_j])))
        end, k = ends_a[to_i - 1], to_i - 1
        while k >= i and ends_a[k] == end:
            m = to_j - 1
            while m >= j and ends_b[m] == end:
                linked.append((a[k], b[m]))
                m -= 1
            k -= 1
        i, j = to_i, to_j
    return groups, linked


def crosses(table: list[bytes]) -> bool:
    """Whether a token goes on from a character that isn't white space into a space."""
    return any(re.search(r"\S ", raw.decode(errors="replace")) for raw in table)


@dataclass
class Block:
    """Aligned words and linked pairs of the documents of one block."""

    a: tiktoken.Encoding
    b: sentencepiece.SentencePieceProcessor
    raw_a: list[bytes]
    raw_b: list[bytes]
    #: distinct words by number, and per word: group text, sizes (tokens of A, tokens of B, groups, linked pairs), and its pairs' numbers, end to end
    words: dict[str, int] = field(default_factory=dict)
    groups: list[str] = field(default_factory=list)
    sizes: array = field(default_factory=lambda: array("q"))
    places: array = field(default_factory=lambda: array("i"))
    #: code of a pair -> its number in the block, and how often each was met
    pairs: dict[int, int] = field(default_factory=dict)
    counts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def __post_init__(self) -> None:
        self.bytes_a, self.bytes_b = (list(map(len, raw)) for raw in (self.raw_a, self.raw_b))
        self.cut = re.compile("(?s).+" if crosses(self.raw_b) else r" (?:[^ ]+|(?<=\s) +| \Z)*")

    def _align(self, words: list[str]) -> None:
        bytes_a, bytes_b, raw_b, pairs, many = self.bytes_a, self.bytes_b, self.raw_b, self.pairs, len(self.raw_b)
        for word, of_b in zip(words, self.b.encode([w[1:] for w in words], num_threads=1)):
            self.words[word] = len(self.groups)
            # tokens of A are cut from the bytes themselves; only B may give back others
            if b"".join([raw_b[i] for i in of_b]) != word.encode():
                self.groups.append("")
                self.sizes.extend((-1, 0, 0, 0))
                continue
            of_a = self.a.encode_ordinary(word)
            groups, linked = groups_and_links(of_a, of_b, list(accumulate([bytes_a[i] for i in of_a])), list(accumulate([bytes_b[i] for i in of_b])))
            self.groups.append(";".join(groups))
            self.sizes.extend((len(of_a), len(of_b), len(groups), len(linked)))
            self.places.extend([pairs.setdefault(x * many + y, len(pairs)) for x, y in linked])

    def rows(self, texts: list[str]) -> list[tuple]:
        """(n_a, n_b, n_groups, n_links, groups, places, times) of each text."""
        cut = [self.cut.findall(" " + text) if text else [] for text in texts]
        if new := list(dict.fromkeys(w for words in cut for w in words if w not in self.words)):
            self._align(new)
        sizes, places = np.array(self.sizes, np.int64).reshape(-1, 4), np.array(self.places, np.int32)
        starts, met = np.cumsum(sizes[:, 3]) - sizes[:, 3], np.zeros(len(self.pairs), np.int64)
        met[:len(self.counts)] = self.counts
        out, none = [], (0, 0, 0, 0, "", b"", b"")
        for words in cut:
            found = list(map(self.words.__getitem__, words))
            own = sizes[found]
            if not found or own[:, 0].min() < 0:
                out.append(none)
                continue
            n_a, n_b, n_groups, n_links = own.sum(axis=0).tolist()
            before = np.cumsum(own[:, 3]) - own[:, 3]
            held, times = np.unique(places[np.repeat(starts[found] - before, own[:, 3]) + np.arange(n_links)], return_counts=True)
            met[held] += times
            out.append((n_a, n_b, n_groups, n_links, ";".join(map(self.groups.__getitem__, found)), held.tobytes(), times.astype(np.int32).tobytes()))
        self.counts = met
        return out


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str], int]]:
    """(ids, texts, characters), ``CALL`` characters or one text at a time."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            text = text.as_py() or ""
            if texts and size + len(text) > CALL:
                yield ids, texts, size
                ids, texts, size = [], [], 0
            ids.append(doc_id)
            texts.append(text)
            size += len(text)
    if texts:
        yield ids, texts, size


def encoded(docs: DataFrame, a_model: str, b_model: bytes) -> DataFrame:
    """Per document its token counts, groups, and links as places in its block's list of pairs; per block that list, in rows of their own.

    A pair's code is the A id times the size of vocabulary B plus the B id.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (a, raw_a), (b, raw_b) = byte_tokenizer(a_model), piece_tokenizer(b_model)
        fresh = lambda: Block(a, b, raw_a, raw_b)
        number, held, state = TaskContext.get().partitionId() << 32, 0, fresh()

        def pairs() -> Iterator[pa.RecordBatch]:
            codes, counts = np.fromiter(state.pairs, np.int64), state.counts
            for i in range(0, len(codes), PAIRS):
                part = slice(i, i + PAIRS)
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip([[number], *[[None]] * 8, [i], [codes[part]], [counts[part]]], ARROW)], schema=ARROW)

        for ids, texts, size in _slices(batches):
            if held and held + size > BLOCK:
                yield from pairs()
                number, held, state = number + 1, 0, fresh()
            held += size
            columns = [[number] * len(ids), ids, *zip(*state.rows(texts)), *[[None] * len(ids)] * 3]
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(columns, ARROW)], schema=ARROW)
        if held:
            yield from pairs()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def align(docs: DataFrame, a_path: str, b_path: str, groups: bool = True) -> DataFrame:
    """Aligned tokens of every row of ``docs`` (doc_id, text; other columns are ignored).

    Returns doc_id, n_a, n_b (tokens), n_groups, n_links, n_best (links whose pair is, over all documents, the most
    frequent or one of the most frequent of its B id), count_sum (links over all documents of every link's pair, summed), groups_sha256,
    and with ``groups`` the groups themselves as text. A null or empty text and a text that a tokenizer does not give back
    byte for byte have no tokens: zeros and empty strings. Rows that repeat an id, and rows without one, are
    documents of their own. No rows in, no rows out.
    """
    with open(a_path, encoding="utf-8") as a, open(b_path, "rb") as b:
        a_model, b_model = a.read(), b.read()
    size_b = len(piece_tokenizer(b_model)[1])
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).when(F.col("n_a") == 0, "")
    made = encoded(docs, a_model, b_model).withColumn("groups_sha256", digest)
    made = reread(made if groups else made.drop("groups"), "alignment")
    shown = ["groups"] if groups else []

    own = made.filter(F.col("codes").isNotNull()).select("block", "start", F.posexplode(F.arrays_zip("codes", "counts")).alias("at", "p")).select(
        F.col("block").alias("of"), (F.col("start") + F.col("at")).alias("place"), F.col("p.codes").alias("code"), F.col("p.counts").alias("n"))
    total = own.groupBy("code").agg(F.sum("n").alias("n"))
    most = F.max("n").over(Window.partitionBy(F.col("code") % size_b))
    #: A pair's count, negative unless it is the highest of its B id.
    total = total.select("code", F.when(F.col("n") == most, F.col("n")).otherwise(-F.col("n")).alias("mark"))
    marks = own.select("of", "place", "code").join(total, "code")

    def finish(_, rows: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
        mark = pairs.sort_values("place")["mark"].to_numpy()
        best, sums = [], []
        for places, times in zip(rows["places"], rows["times"]):
            here, times = mark[np.frombuffer(places, np.int32)], np.frombuffer(times, np.int32).astype(np.int64)
            best.append(int(times[here > 0].sum()))
            sums.append(int((np.abs(here) * times).sum()))
        return rows[["doc_id", "n_a", "n_b", "n_groups", "n_links"]].assign(n_best=best, count_sum=sums, **{c: rows[c] for c in ("groups_sha256", *shown)})

    rows = made.filter(F.col("codes").isNull()).drop("start", "codes", "counts")
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string" + ", groups string" * groups
    return rows.groupBy("block").cogroup(marks.groupBy("of")).applyInPandas(finish, schema)
