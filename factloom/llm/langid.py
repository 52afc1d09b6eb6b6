"""Language of a text by a bidirectional gated recurrent network over its bytes.

A text's UTF-8 bytes are cut into windows that run side by side. One network reads a window
forward, one backward; at every byte both states give a probability for each language, and
the mean over all bytes of the whole text is the document's. The network is trained in numpy by
backpropagation through time on windows of a bounded sample of documents (so many per
language, chosen by hash). Gates are piecewise linear sigmoids and states softsigns, which keeps a
step to a few array operations over thousands of windows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of a window, state size, windows run side by side.
STEPS, HIDDEN, SIDE = 64, 8, 4096
#: Documents per language and windows per document that training sees; gradient steps and windows of each.
SAMPLE, WINDOWS, ROUNDS, BATCH = 300, 4, 240, 192
#: More distinct languages than this is an error, since one row of each is broadcast.
MOST_LANGUAGES = 10_000
UNKNOWN = "und"


def has_letter(text: str) -> bool:
    """Whether a text holds a character of a Unicode letter category (L), as ``\\p{L}`` has it in training."""
    return any(map(str.isalpha, text))


@dataclass
class Cell:
    """One direction: input rows per byte, recurrent weights; gates in the order update, reset, new."""

    table: np.ndarray  # 3h x 256
    state: np.ndarray  # 3h x h

    def step(self, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        """Next state, and what the way back needs; ``x`` holds one byte per window."""
        n = len(self.state) // 3
        given, own = self.table.take(x, axis=1), self.state @ h
        gates = given[:2 * n] + own[:2 * n]
        gates *= 0.25
        gates += 0.5
        np.clip(gates, 0, 1, out=gates)
        z, r = gates[:n], gates[n:]
        new = r * own[2 * n:]
        new += given[2 * n:]
        size = np.abs(new) + 1
        new /= size
        return new + z * (h - new), gates, new, own, size

    def back(self, x: np.ndarray, h: np.ndarray, kept: tuple[np.ndarray, ...], grad: np.ndarray, table: np.ndarray, state: np.ndarray) -> np.ndarray:
        """Add this step's gradients to ``table`` and ``state``; returns that of the state before."""
        _, gates, new, own, size = kept
        n = len(h)
        z, r = gates[:n], gates[n:]
        d_new = grad * (1 - z) / size**2
        inner = ((gates > 0) & (gates < 1)) * np.float32(0.25)
        d_gates = np.concatenate([grad * (h - new), d_new * own[2 * n:]]) * inner
        d_given = np.concatenate([d_gates, d_new])
        d_own = np.concatenate([d_gates, d_new * r])
        state += d_own @ h.T
        for row, values in zip(table, d_given):
            row += np.bincount(x, values, 256)
        return grad * z + self.state.T @ d_own


@dataclass
class Network:
    languages: list[str]
    ahead: Cell
    behind: Cell
    out: np.ndarray  # languages x (2h + 1)

    def parts(self) -> list[np.ndarray]:
        return [self.ahead.table, self.ahead.state, self.behind.table, self.behind.state, self.out]

    @classmethod
    def new(cls, languages: list[str], hidden: int, rng: np.random.Generator) -> Network:
        make = lambda *shape: (rng.standard_normal(shape) * 0.3).astype(np.float32)
        cells = [Cell(make(3 * hidden, 256), make(3 * hidden, hidden)) for _ in range(2)]
        return cls(languages, *cells, make(len(languages), 2 * hidden + 1))

    def states(self, bytes_: np.ndarray) -> tuple[list, list]:
        """What every step of both directions keeps; ``bytes_`` is steps x windows."""
        zero = np.zeros((self.ahead.state.shape[1], bytes_.shape[1]), np.float32)
        runs = []
        for cell, order in ((self.ahead, range(len(bytes_))), (self.behind, range(len(bytes_) - 1, -1, -1))):
            kept, h = [None] * len(bytes_), zero
            for t in order:
                kept[t] = (*cell.step(bytes_[t], h), h)
                h = kept[t][0]
            runs.append(kept)
        return runs[0], runs[1]

    def position(self, ahead: np.ndarray, behind: np.ndarray) -> np.ndarray:
        """Probabilities, languages x windows, at one position."""
        n = len(ahead)
        logits = self.out[:, :n] @ ahead + self.out[:, n:2 * n] @ behind + self.out[:, 2 * n:]
        logits -= logits.max(axis=0)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=0)
        return logits

    def pooled(self, bytes_: np.ndarray, valid: np.ndarray) -> np.ndarray:
        """Sums of probabilities over the first ``valid`` positions of each window: languages x windows."""
        zero = np.zeros((self.ahead.state.shape[1], bytes_.shape[1]), np.float32)
        seen, h = [], zero
        for x in bytes_:
            h = self.ahead.step(x, h)[0]
            seen.append(h)
        total, h = np.zeros((len(self.languages), bytes_.shape[1]), np.float32), zero
        for t in range(len(bytes_) - 1, -1, -1):
            h = self.behind.step(bytes_[t], h)[0] * (t < valid)  # a window's padding leaves no trace
            total += self.position(seen[t], h) * (t < valid)
        return total

    def gradients(self, bytes_: np.ndarray, target: np.ndarray) -> tuple[list[np.ndarray], float]:
        """Gradients of the mean cross entropy over all positions, by backpropagation through time, and its value."""
        ahead, behind = self.states(bytes_)
        steps, windows = bytes_.shape
        n, loss = self.ahead.state.shape[1], 0.0
        grads = [np.zeros_like(p) for p in self.parts()]
        into = [[], []]
        for t in range(steps):
            p = self.position(ahead[t][0], behind[t][0])
            loss -= float(np.log(p[target, np.arange(windows)] + 1e-9).sum())
            p[target, np.arange(windows)] -= 1
            p /= steps * windows
            grads[4][:, :n] += p @ ahead[t][0].T
            grads[4][:, n:2 * n] += p @ behind[t][0].T
            grads[4][:, 2 * n] += p.sum(axis=1)
            into[0].append(self.out[:, :n].T @ p)
            into[1].append(self.out[:, n:2 * n].T @ p)
        for cell, kept, given, order, (table, state) in (
            (self.ahead, ahead, into[0], range(steps - 1, -1, -1), grads[:2]), (self.behind, behind, into[1], range(steps), grads[2:4])):
            grad = np.zeros((n, windows), np.float32)
            for t in order:
                grad = cell.back(bytes_[t], kept[t][5], kept[t][:5], grad + given[t], table, state)
        return grads, loss / (steps * windows)


def train(windows: np.ndarray, target: np.ndarray, languages: list[str], rounds: int = ROUNDS, hidden: int = HIDDEN, seed: int = 8) -> Network:
    """Fit a network on byte windows (windows x steps) by Adam; every language weighs the same."""
    rng = np.random.default_rng(seed)
    network = Network.new(languages, hidden, rng)
    first, second = [np.zeros_like(p) for p in network.parts()], [np.zeros_like(p) for p in network.parts()]
    members = [np.flatnonzero(target == k) for k in range(len(languages))]
    for step in range(1, rounds + 1):
        drawn = rng.integers(0, len(languages), BATCH)
        chosen = np.array([rng.choice(members[k]) for k in drawn])
        grads, _ = network.gradients(np.ascontiguousarray(windows[chosen].T), drawn)
        rate = 0.03 * min(1.0, 2 * (1 - step / (rounds + 1)))
        for p, g, m, v in zip(network.parts(), grads, first, second):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= (rate * m / (1 - 0.9**step) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return network


def held_out(doc_id: Column) -> Column:
    """Documents that are never learnt from: CRC-32 of the id as text divisible by 5; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def _cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A few windows of each document, at places its key picks."""
    for frame in frames:
        rows = []
        for key, lang, text in zip(frame["key"], frame["lang"], frame["text"]):
            raw, rng = text.encode(), np.random.default_rng(abs(int(key)))
            for _ in range(WINDOWS if len(raw) > STEPS else 1):
                at = int(rng.integers(0, max(1, len(raw) - STEPS + 1)))
                rows.append((lang, (raw[at:] if len(raw) < STEPS else raw[at:at + STEPS]).ljust(STEPS, b" ")))
        yield pd.DataFrame(rows, columns=["lang", "window"])


def fit(docs: DataFrame, sample: int = SAMPLE) -> Network | None:
    """Train on at most ``sample`` documents of each language that aren't held out; None if there is none."""
    key = F.xxhash64("doc_id", F.lit(8))
    usable = F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & ~held_out(F.col("doc_id"))
    ranked = docs.filter(usable).select(F.col("lang").cast("string").alias("lang"), key.alias("key"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("key"))
    cuts = ranked.withColumn("place", place).filter(F.col("place") <= sample).groupBy("lang").agg(F.max("key").alias("upto")).limit(MOST_LANGUAGES + 1).toPandas()
    if len(cuts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not len(cuts):
        return None
    limits = docs.sparkSession.createDataFrame([(str(a), int(b)) for a, b in cuts.itertuples(index=False)], "of string, upto long")
    chosen = (
        docs.filter(usable).select(F.col("lang").cast("string").alias("lang"), key.alias("key"), F.col("text").cast("string").alias("text"))
        .join(F.broadcast(limits), (F.col("lang") == F.col("of")) & (F.col("key") <= F.col("upto"))).select("lang", "key", "text")
    )
    rows = chosen.mapInPandas(_cut, "lang string, window binary").toPandas().sort_values(["lang", "window"])
    languages = sorted(cuts["lang"])
    windows = np.frombuffer(b"".join(map(bytes, rows["window"])), np.uint8).reshape(-1, STEPS)
    return train(windows, np.array([languages.index(x) for x in rows["lang"]]), languages)


def label(network: Network, texts: list[str]) -> np.ndarray:
    """Mean language probabilities of whole texts, documents x languages; zero rows for empty texts."""
    raw = [t.encode() for t in texts]
    sizes = np.array([-(-len(r) // STEPS) for r in raw])
    flat = np.frombuffer(b"".join(r.ljust(int(n) * STEPS, b" ") for r, n in zip(raw, sizes)), np.uint8).reshape(-1, STEPS)
    owner = np.repeat(np.arange(len(raw)), sizes)
    starts = np.cumsum(sizes) - sizes
    valid = np.minimum(np.array([len(r) for r in raw])[owner] - (np.arange(len(owner)) - starts[owner]) * STEPS, STEPS)
    sums = np.zeros((len(raw), len(network.languages)))
    for a in range(0, len(flat), SIDE):
        part = network.pooled(np.ascontiguousarray(flat[a:a + SIDE].T), valid[a:a + SIDE])
        for k, row in enumerate(part):
            sums[:, k] += np.bincount(owner[a:a + SIDE], row, len(raw))
    return sums / np.maximum(np.array([len(r) for r in raw]), 1)[:, None]


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row of ``docs`` (doc_id, text, lang; other columns are ignored).

    ``lang`` is read for training only. A text that is null or has no letter gets ``und`` and score 0, as does
    every text if there is nothing to learn from. Equal probabilities go to the first language by
    code point. Rows are judged one by one; an empty table gives no rows.
    """
    network = fit(docs, sample)
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        net = shared.value
        for frame in frames:
            texts = [t if net is not None and isinstance(t, str) and has_letter(t) else "" for t in frame["text"]]
            pred, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            at, held = 0, 0
            for end in range(1, len(texts) + 1):
                held += len(texts[end - 1])
                if held < 2_000_000 and end < len(texts):
                    continue
                if net is not None:
                    for i, p in zip(range(at, end), label(net, texts[at:end])):
                        if texts[i]:
                            pred[i], score[i] = net.languages[int(p.argmax())], min(float(p.max()), 1.0)
                at, held = end, 0
            yield frame.drop(columns="text").assign(lang_pred=pred, score=score)

    kept = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return kept.mapInPandas(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
