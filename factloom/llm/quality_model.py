"""Text quality from weak labels.

Overlapping heuristic labellers vote good, bad or abstain on every document.
Expectation maximisation over the counts of vote patterns (all documents, aggregated
before the shuffle; at most 3 ** labellers rows) estimates how often each labeller is right
on good texts and on each kind of bad ones, and the share of good ones. The posterior of a pattern is its
weak label. A linear scorer over hashed byte trigrams, word shapes and repetition is then
trained on a bounded sample with these labels and scores every whole text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.workers import lean

GOOD, ABSTAIN, BAD = 1, 0, -1
#: Documents the scorer is trained on (those of smallest id hash), slots of the hashed weights, epochs.
SAMPLE, SLOTS, EPOCHS = 4000, 1 << 15, 6
#: Weight of the prior on the labellers' votes, in documents.
PRIOR = 50.0
#: Texts at or above this probability are kept.
THRESHOLD = 0.5
SYMBOLS, WORD = re.compile(r"[*&%$#|<>{}=~^\\]"), re.compile(r"\w+")
#: Frequent function words.
COMMON = frozenset(
    "the of and to a in is it that for on with as was are be this by or at der die das und ist zu den von mit im dem des ein eine nicht auf für "
    "le la les de et un une des du en que qui pour pas sur au par el los del y por con para es no lo se al".split()
)
LABELLERS = ("symbols", "capitals", "stutter", "bars", "variety", "sentences", "function_words", "shouts")


def _vote(value: float, good: float, bad: float) -> int:
    """Good up to ``good``, bad from ``bad`` on, no opinion between."""
    return GOOD if value <= good else BAD if value >= bad else ABSTAIN


def _like_words(words: list[str]) -> float:
    """Share of the words that hold letters and neither digits nor symbols, in any script."""
    return sum(any(map(str.isalpha, w)) and not any(map(str.isdigit, w)) and not SYMBOLS.search(w) for w in words) / len(words)


def votes(text: str) -> list[int]:
    """One vote per labeller; all abstain on a text without words."""
    words = text.split()
    if not words:
        return [ABSTAIN] * len(LABELLERS)
    n, length = len(words), max(len(text), 1)
    letters = sum(map(str.isalpha, text)) or 1
    repeats = sum(a == b for a, b in zip(words, words[1:])) / n
    triples = list(zip(words, words[1:], words[2:]))
    fresh = len(set(triples)) / len(triples) if len(triples) >= 20 else None
    ends = sum(w[-1] in ".!?:…" for w in words) / n
    known = sum(w.strip(".,;:!?").lower() in COMMON for w in words) / n
    return [
        _vote(len(SYMBOLS.findall(text)) / length, 0.005, 0.02),
        _vote(sum(map(str.isupper, text)) / letters, 0.15, 0.5),
        _vote(repeats, 0.05, 0.3) if n >= 6 else ABSTAIN,
        _vote((text.count("|") + text.count("\t")) / n, 0.05, 0.3),
        ABSTAIN if fresh is None else _vote(1 - fresh, 0.2, 0.5),
        ABSTAIN if n < 10 else GOOD if 0.01 <= ends <= 0.3 else BAD if ends > 0.6 else ABSTAIN,
        # words that aren't known may be those of a language that isn't: only what holds few words at all is bad
        ABSTAIN if n < 15 else GOOD if known >= 0.1 else BAD if known < 0.01 and _like_words(words) <= 0.6 else ABSTAIN,
        _vote(sum(w[-2:] == "!!" for w in words) / n, 0.05, 0.3) if n >= 3 else ABSTAIN,
    ]


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed slots and their values: shares of byte trigrams, of shape trigrams, and of stuttered words."""
    raw = np.frombuffer(text.encode(), np.uint8).astype(np.uint32)
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0)
    shape = _SHAPES[raw]
    slots, weights = [], []
    for codes, salt in ((raw, 1), (shape, 2)):
        if len(codes) >= 3:
            grams = (codes[:-2] << 16) | (codes[1:-1] << 8) | codes[2:]
            hashed = (grams * np.uint32(2654435761) + np.uint32(salt * 40503)) >> np.uint32(32 - SLOTS.bit_length() + 1)
            slots.append(hashed)
            weights.append(np.full(len(hashed), 1.0 / len(hashed)))
    words = text.split()
    slots.append(np.arange(2, dtype=np.uint32))  # two slots of their own, shared with few trigrams
    weights.append(np.array([sum(a == b for a, b in zip(words, words[1:])) / max(len(words), 1), 1.0 / (1 + len(words))]))
    total = np.bincount(np.concatenate(slots), np.concatenate(weights), SLOTS)
    found = np.flatnonzero(total)
    return found, np.sqrt(total[found])


_SHAPES = np.array([0 if 97 <= b <= 122 else 1 if 65 <= b <= 90 else 2 if 48 <= b <= 57 else 3 if b == 32 else 4 if b >= 128 else b for b in range(256)], np.uint32)


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of ``good`` per pattern, chance of each vote per class and labeller, and the classes' shares.

    Bad texts come in kinds, so beside the good class there is one bad class per labeller, which that labeller is
    expected to see. Priors worth ``PRIOR`` documents say that bad votes on good texts are rare and that
    a labeller mostly votes bad on its kind; the counts decide the rest. Abstaining is no evidence.
    """
    classes = 1 + patterns.shape[1]
    hot = np.stack([patterns == v for v in (BAD, GOOD)], axis=-1).astype(float)  # pattern, labeller, vote
    prior = np.tile(PRIOR * np.array([0.1, 0.9]), (classes, patterns.shape[1], 1))
    prior[0] = PRIOR * np.array([0.01, 0.99])
    prior[np.arange(1, classes), np.arange(classes - 1)] = PRIOR * np.array([0.95, 0.05])
    bad = (patterns == BAD).astype(float)
    belief = np.concatenate([np.where(bad.any(axis=1), 0.05, 0.95)[None], np.where(bad.any(axis=1)[:, None], 0.95 * bad / np.maximum(bad.sum(axis=1, keepdims=True), 1), 0.05 / (classes - 1)).T])
    for _ in range(rounds):
        weight = belief * counts
        chance = np.einsum("cp,plv->clv", weight, hot) + prior
        chance /= chance.sum(axis=-1, keepdims=True)
        share = (weight.sum(axis=1) + 1) / (counts.sum() + classes)
        log = np.einsum("clv,plv->cp", np.log(chance), hot) + np.log(share)[:, None]
        new = np.exp(log - log.max(axis=0, initial=-np.inf))
        new /= new.sum(axis=0)
        if np.abs(new - belief).max(initial=0) < 1e-6:
            break
        belief = new
    return belief[0], chance, share


def train(slots: list[np.ndarray], values: list[np.ndarray], targets: np.ndarray, epochs: int = EPOCHS, seed: int = 3) -> np.ndarray:
    """Weights and bias (last) of a logistic scorer on soft labels, by adaptive gradient steps."""
    weights, power = np.zeros(SLOTS + 1), np.full(SLOTS + 1, 1e-6)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(targets)):
            at = np.r_[slots[i], SLOTS]
            x = np.r_[values[i], 1.0]
            p = 1 / (1 + np.exp(-np.clip(x @ weights[at], -30, 30)))
            gradient = (p - targets[i]) * x
            power[at] += gradient**2
            weights[at] -= 0.2 * gradient / np.sqrt(power[at])
    return weights


@lean
def _voted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of vote patterns of a batch."""
    for frame in frames:
        table = np.array([votes(t) if isinstance(t, str) else [ABSTAIN] * len(LABELLERS) for t in frame["text"]], np.int64).reshape(-1, len(LABELLERS))
        code = (table + 1) @ (3 ** np.arange(len(LABELLERS)))
        found, counts = np.unique(code, return_counts=True)
        yield pd.DataFrame({"pattern": found, "n": counts})


def _unpack(code: np.ndarray) -> np.ndarray:
    return code[:, None] // 3 ** np.arange(len(LABELLERS)) % 3 - 1


def fit(docs: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, pd.DataFrame]:
    """Weights of the scorer, and the labellers' estimated accuracy on good and bad texts.

    The scorer learns from the ``sample`` rows that come first by a hash of their id, then of their text; rows that
    repeat both count once, so the same table gives the same weights.
    """
    texts = docs.select(F.col("text").cast("string").alias("text"))
    counted = texts.mapInPandas(_voted, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).toPandas()
    patterns, counts = _unpack(counted["pattern"].to_numpy(np.int64)), counted["n"].to_numpy(float)
    good, chance, share = estimate(patterns, counts)
    label = dict(zip(counted["pattern"], good))

    @lean
    def described(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            code = (np.array([votes(t) for t in frame["text"]], np.int64).reshape(-1, len(LABELLERS)) + 1) @ (3 ** np.arange(len(LABELLERS)))
            found = [features(t) for t in frame["text"]]
            yield pd.DataFrame({
                "slots": [s.astype("<i4").tobytes() for s, _ in found], "values": [v.astype("<f4").tobytes() for _, v in found],
                "target": [label.get(c, 0.5) for c in code]})

    text = F.col("text").cast("string")
    key = F.struct(F.xxhash64("doc_id", F.lit(3)).alias("a"), F.xxhash64(text).alias("b"))
    worded = docs.filter(F.col("text").rlike(r"\S")).select(key.alias("_key"), text.alias("text"))
    last = worded.select("_key").orderBy("_key").limit(sample).agg(F.max("_key")).first()[0]
    rows = []
    if last is not None:
        end = F.struct(F.lit(last["a"]).alias("a"), F.lit(last["b"]).alias("b"))
        picked = worded.filter(F.col("_key") <= end).dropDuplicates(["_key"]).select("text")
        rows = sorted(picked.mapInPandas(described, "slots binary, values binary, target double").collect())
    weights = train(
        [np.frombuffer(r["slots"], "<i4").astype(np.int64) for r in rows], [np.frombuffer(r["values"], "<f4").astype(float) for r in rows],
        np.array([r["target"] for r in rows]))
    bad = np.einsum("c,clv->lv", share[1:] / share[1:].sum(), chance[1:])
    return weights, pd.DataFrame({
        "labeller": LABELLERS, "right_if_good": chance[0, :, 1], "right_if_bad": bad[:, 0], "share_good": share[0]})


def score(text: Column, weights: np.ndarray) -> Column:
    """Probability that a text is good; NaN or null for a text that is null or has no words."""
    small = weights.astype(np.float32)

    @F.pandas_udf("double")
    def judged(texts: pd.Series) -> pd.Series:
        found = np.full(len(texts), np.nan)
        for i, t in enumerate(texts):
            if isinstance(t, str) and t.strip():
                slots, values = features(t)
                found[i] = 1 / (1 + np.exp(-np.clip(float(values @ small[slots]) + float(small[SLOTS]), -30, 30)))
        return pd.Series(found)

    return judged(text.cast("string"))


def classify(docs: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score (0 to 1) and keep of every row of ``docs`` (doc_id, text; other columns are ignored).

    Texts that are null, empty or blank score 0 and aren't kept. Rows are judged one by one, so
    repeated rows get the same score. An empty table gives no rows.
    """
    weights, _ = fit(docs, sample)
    scored = docs.select("doc_id", F.coalesce(F.nanvl(score(F.col("text"), weights), F.lit(0.0)), F.lit(0.0)).alias("score"))
    return scored.withColumn("keep", F.col("score") >= threshold)


def good_documents(docs: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that the classifier rejects; all columns stay as they are."""
    weights, _ = fit(docs, sample)
    return docs.filter(F.nanvl(score(F.col("text"), weights), F.lit(0.0)) >= threshold)
