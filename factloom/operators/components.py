"""Connected components of a pair table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.session import checkpoint


def _relabel(edges: DataFrame) -> DataFrame:
    """Attach to each edge (u, v) the smallest id among u and its neighbours.

    The minimum is combined map-side, and joins back as one row per node.
    """
    smallest = edges.groupBy("u").agg(F.min("v").alias("_m")).select("u", F.least("u", "_m").alias("m"))
    return edges.join(smallest, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _relabel(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    marked = _relabel(down)
    return (
        marked.select(F.col("v").alias("u"), F.col("m").alias("v"))
        .unionByName(marked.select("u", F.col("m").alias("v")))
        .filter("u <> v").distinct()
    )


def connected_components(pairs: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``pairs``; the component is its smallest node.

    Each round is checkpointed. Rounds end when no edge changes; running out of
    rounds is an error, never a partial answer.
    """
    nodes = pairs.select(F.explode(F.array(F.col(a), F.col(b))).alias("node")).distinct()
    edges = checkpoint(pairs.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v").distinct())
    before = None
    for _ in range(max_rounds):
        edges = checkpoint(_small_star(_large_star(edges)))
        now = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")).first()
        if now == before:
            labels = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
            return nodes.join(labels, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
        before = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
