"""Exact top-k inner products by columnar branch and bound.

Components are turned into integers, ``floor(64 * x)``. A block of candidates lies in memory
dimension by dimension, the dimensions of most mass first. For each query the scores
grow by one group of dimensions at a time; a candidate's score plus the product of both
remaining norms bounds what it can still reach. Candidates whose bound is below the
k-th best score known so far are compacted away before the next group, and when none is
left the block is done. Bounds are rounded up, so no candidate that could tie is lost.

Queries are cut into blocks, and every block of queries meets every block of candidates
in one task; a block's best k per query go to a per-query ranking that Spark prunes before
the shuffle. Neither side is broadcast and nothing is collected.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.vector_dedup import finite
from factloom.session import checkpoint

SCALE = 64
#: Candidates and queries of a block, and dimensions added between two bounds.
CANDIDATES, QUERIES, GROUP = 8192, 256, 16
#: Integers up to here are exact in double arithmetic.
EXACT = 2**53


def whole_numbers(vectors: DataFrame) -> DataFrame:
    """(vec_id, value array<double>, length) of the rows that take part, components as floor(64 * x)."""
    value = F.transform("embedding", lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double")).cast("double"))
    fit = F.col("vec_id").isNotNull() & finite(F.col("embedding"))
    return vectors.filter(fit).select(F.col("vec_id").cast("long").alias("vec_id"), value.alias("value"), F.size("embedding").alias("length"))


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to smaller ids."""
    if len(score) > 4 * k:
        kth = np.partition(score, len(score) - k)[len(score) - k]
        keep = np.flatnonzero(score >= kth)
        return keep[np.lexsort((ids[keep], -score[keep]))[:k]]
    return np.lexsort((ids, -score))[:k]


def search_block(queries: np.ndarray, query_ids: np.ndarray, block: np.ndarray, ids: np.ndarray, k: int):
    """Yield (query position, candidate positions, scores) of each query's best k in a block of candidates."""
    mass = (block**2).sum(axis=0)
    order = np.argsort(-mass, kind="stable")
    columns = np.ascontiguousarray(block[:, order].T)
    turned = queries[:, order]
    cuts = [*range(0, len(order), GROUP), len(order)]
    left = lambda m: np.stack([np.sqrt((m[c:] ** 2).sum(axis=0)) for c in cuts[1:]])
    rest, own = left(columns), left(np.ascontiguousarray(turned.T))
    largest = np.lexsort((ids, -(columns**2).sum(axis=0)))[:4 * k]  # a first floor under the k-th score
    floor_scores = turned @ columns[:, largest]
    for q in range(len(queries)):
        other = floor_scores[q][ids[largest] != query_ids[q]]
        least = np.partition(other, len(other) - k)[len(other) - k] if len(other) >= k else -np.inf
        alive = np.flatnonzero(ids != query_ids[q])
        score = np.zeros(len(alive))
        for g, (a, b) in enumerate(zip(cuts, cuts[1:])):
            part = columns[a:b] if len(alive) == len(ids) else columns[a:b, alive]
            score = score + turned[q, a:b] @ part
            bound = score + own[g, q] * rest[g, alive] * (1 + 1e-12) + 0.5
            if len(score) > k:
                low = score - own[g, q] * rest[g, alive]
                least = max(least, np.partition(low, len(low) - k)[len(low) - k])
            keep = bound >= least
            if not keep.all():
                alive, score = alive[keep], score[keep]
            if not len(alive):
                break
        best = _best(score, ids[alive], k)
        yield q, alive[best], score[best]


def _plain_block(queries: np.ndarray, query_ids: np.ndarray, block: np.ndarray, ids: np.ndarray, k: int):
    """The same by Python's integers, for components too large for exact double arithmetic."""
    rows, asked = [[int(x) for x in v] for v in block], [[int(x) for x in v] for v in queries]
    for q, vector in enumerate(asked):
        scores = sorted((-sum(x * y for x, y in zip(vector, r)), int(i), n) for n, (r, i) in enumerate(zip(rows, ids)) if i != query_ids[q])[:k]
        yield q, np.array([n for _, _, n in scores], dtype=int), [max(-(2**63), min(2**63 - 1, -s)) for s, _, _ in scores]


def _search(k: int):
    def run(pair: pd.DataFrame) -> pd.DataFrame:
        asked, stock = pair[pair["asked"]], pair[~pair["asked"]]
        empty = pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        if not len(asked) or not len(stock):
            return empty
        queries, block = np.stack(asked["value"].to_list()), np.stack(stock["value"].to_list())
        if not queries.shape[1]:  # empty vectors: every product is 0
            queries, block = np.zeros((len(queries), 1)), np.zeros((len(block), 1))
        query_ids, ids = asked["vec_id"].to_numpy(), stock["vec_id"].to_numpy()
        largest = float(np.abs(queries).max(initial=0)) * float(np.abs(block).max(initial=0)) * max(queries.shape[1], 1)
        found = []
        for q, at, scores in (search_block if largest < EXACT else _plain_block)(queries, query_ids, block, ids, k):
            found.append(pd.DataFrame({"query_id": query_ids[q], "vec_id": ids[at], "score": np.asarray(scores, dtype=np.int64)}))
        return pd.concat([empty, *found])

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """The k highest integer inner products of each query with all other rows.

    ``vectors`` and ``queries`` hold vec_id and embedding; other columns are ignored. Returns
    query_id, rank (from 1), vec_id, score; ties go to the smaller vec_id. Rows whose
    vec_id is null, or whose vector is null or holds null or non-finite components, take no part; vectors of another
    length than the query's aren't its candidates. A zero or empty vector scores 0. Rows
    that repeat a candidate's vec_id each count; of queries that repeat one, the smallest
    vector is asked; a query never meets rows of its own id. Scores beyond a long are held at its limits. Empty tables give no rows.
    """
    single = whole_numbers(queries).groupBy("vec_id").agg(F.min(F.struct("value", "length")).alias("_q")).select("vec_id", "_q.*")
    stock, asked = checkpoint(whole_numbers(vectors)), checkpoint(single)
    n_stock, n_asked = stock.count(), asked.count()
    blocks, groups = max(1, -(-n_stock // CANDIDATES)), max(1, -(-n_asked // QUERIES))
    own = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    place = F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int")
    columns = ["length", "vec_id", "value"]
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    candidates = stock.select(*columns, own.alias("block"), F.lit(False).alias("asked")).select("*", every(groups).alias("group"))
    wanted = asked.select(*columns, place.alias("group"), F.lit(True).alias("asked")).select("*", every(blocks).alias("block"))
    found = (
        candidates.unionByName(wanted).groupBy("length", "group", "block")
        .applyInPandas(_search(k), "query_id long, vec_id long, score long")
    )
    ranking = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(ranking)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: The same over the table ``embeddings`` with k = 20 and the rows whose id is divisible by 20 as queries.
SQL = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM whole q JOIN whole c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20"""
