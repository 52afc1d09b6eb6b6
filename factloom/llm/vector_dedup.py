"""Near-duplicate vectors by PCA-ordered, tiled comparison.

Vectors of one label whose cosine reaches the threshold are linked. Unit vectors that
are linked lie within ``sqrt(2 - 2 * threshold)`` of each other, and so does each of their
coordinates; cells of that width over the leading principal coordinates leave only
neighbouring cells to compare. A tile is a cell with its neighbours on one side, cut
into chunks when it is large. Inside, products are summed over blocks of coordinates in
the order of their variance; a pair is dropped as soon as its sum plus the product of
both remaining norms can't reach the threshold, and a strip is abandoned when no pair
is left. What survives is decided by the plain cosine of the vectors as given.

The rotation is fitted on a bounded sample; it steers the pruning alone, never the result.
Equal vectors are compared once. No bucket, neighbour or pair is capped.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.grouping import spanning
from factloom.operators.components import connected_components
from factloom.session import checkpoint

#: Vectors the rotation is fitted on, members of a tile side, left rows and coordinates taken at once.
SAMPLE, TILE, STRIP, BLOCK = 4096, 1024, 256, 8
#: Principal coordinates that form cells.
AXES = 3
SLACK = 1e-9


def _units(vectors: pd.Series, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors as a padded matrix, and the same scaled to length one."""
    plain = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        plain[i, :len(v)] = v
    scaled = plain / np.abs(plain).max(axis=1, keepdims=True)  # so squares neither overflow nor vanish
    return scaled, scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def finite(vector: Column) -> Column:
    """True for an array without null, NaN or infinite components; false for null."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(fine, F.lit(False))


def usable() -> Column:
    """Rows that can link: id and label given, vector not null, not zero, all components finite numbers."""
    some = F.coalesce(F.exists("embedding", lambda x: x != 0), F.lit(False))
    return F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite(F.col("embedding")) & some


def classes_of(vectors: DataFrame) -> DataFrame:
    """Distinct (label, vector): key (h, g), smallest vec_id ``first``, number of rows ``copies``."""
    return vectors.groupBy("h", "g").agg(
        F.min("vec_id").alias("first"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("embedding").alias("embedding"))


def rotation(classes: DataFrame, width: int, sample: int = SAMPLE) -> np.ndarray:
    """Principal axes of at most ``sample`` unit vectors, chosen by hash, as columns of falling variance."""
    chosen = classes.select("h", "embedding").orderBy("h").limit(sample).toPandas()
    _, unit = _units(chosen["embedding"], width)
    _, axes = np.linalg.eigh(unit.T @ unit)
    return np.ascontiguousarray(axes[:, ::-1])


def _cells(axes: np.ndarray, width: int, step: float):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            _, unit = _units(frame["embedding"], width)
            cell = np.floor(unit @ axes[:, :AXES] / step).astype(np.int32)
            yield frame.assign(cell=list(np.pad(cell, ((0, 0), (0, AXES - cell.shape[1])))))

    return run


def _pairs(left: np.ndarray, right: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions of pairs whose bound never fell below the threshold; both sides are rotated unit vectors."""
    rest_l = np.sqrt(np.maximum(1 - np.cumsum(left**2, axis=1), 0))
    rest_r = np.sqrt(np.maximum(1 - np.cumsum(right**2, axis=1), 0))
    least, end = threshold - SLACK, min(BLOCK, left.shape[1])
    total = left[:, :end] @ right[:, :end].T
    i, j = np.nonzero(total + np.outer(rest_l[:, end - 1], rest_r[:, end - 1]) >= least)
    total = total[i, j]
    while end < left.shape[1] and len(i):
        start, end = end, min(end + BLOCK, left.shape[1])
        total = total + np.einsum("nd,nd->n", left[i, start:end], right[j, start:end])
        alive = total + rest_l[i, end - 1] * rest_r[j, end - 1] >= least
        i, j, total = i[alive], j[alive], total[alive]
    return i, j


def _compare(axes: np.ndarray, width: int, threshold: float):
    def run(tile: pd.DataFrame) -> pd.DataFrame:
        plain, unit = _units(tile["embedding"], width)
        norm, turned = np.linalg.norm(plain, axis=1), unit @ axes
        left, right = np.flatnonzero(tile["left"]), np.flatnonzero(tile["right"])
        guest, copies = tile["guest"].to_numpy(), tile["copies"].to_numpy()
        links, together = np.zeros(len(tile), np.int64), []
        for start in range(0, len(left), STRIP):
            part = left[start:start + STRIP]
            i, j = _pairs(turned[part], turned[right], threshold)
            i, j = part[i], right[j]
            i, j = i[i != j], j[i != j]
            sure = np.einsum("nd,nd->n", plain[i], plain[j]) / (norm[i] * norm[j]) >= threshold
            i, j = i[sure], j[sure]
            np.add.at(links, i, copies[j])
            np.add.at(links, j[guest[j]], copies[i[guest[j]]])
            ends = np.flatnonzero(np.r_[i[1:] != i[:-1], True]) + 1 if len(i) else []
            together += [np.r_[i[b - 1], j[a:b]] for a, b in zip(np.r_[0, ends[:-1]].astype(int), ends)] if len(i) else []
        member, root = spanning(len(tile), together)
        head = np.arange(len(tile))
        head[member] = root
        found, first = np.flatnonzero(links), tile["first"].to_numpy()
        return pd.DataFrame({"h": tile["h"].to_numpy()[found], "g": tile["g"].to_numpy()[found], "links": links[found], "a": first[head[found]], "b": first[found]})

    return run


def _tiles(cells: DataFrame) -> DataFrame:
    """A row per class and tile side: ``left`` rows meet ``right`` rows; guests come from a neighbouring cell."""
    ahead = [d for d in product((-1, 0, 1), repeat=AXES) if d > (0,) * AXES]
    shifted = [F.array(*[F.element_at("cell", a + 1) - d[a] for a in range(AXES)]) for d in ahead]
    hosts = F.array(F.struct(F.col("cell").alias("host"), F.lit(False).alias("guest")), *[F.struct(c.alias("host"), F.lit(True).alias("guest")) for c in shifted])
    placed = cells.select("*", F.inline(hosts)).drop("cell")
    key = ["label", "length", "host"]
    sizes = placed.groupBy(*key).agg(F.count("*").alias("n"), F.count_if(~F.col("guest")).alias("own")).filter("own > 0")
    member, home = F.ceil(F.col("n") / TILE).cast("int"), F.ceil(F.col("own") / TILE).cast("int")
    sides = placed.join(sizes, key).withColumn("members", member).withColumn("homes", home)
    i, j = F.pmod("h", F.col("homes")), F.pmod("g", F.col("members"))
    as_right = F.transform(F.sequence(F.lit(0), F.col("homes") - 1), lambda k: F.struct(k.cast("int").alias("i"), j.cast("int").alias("j"), (~F.col("guest") & (k == i)).alias("left"), F.lit(True).alias("right")))
    as_left = F.transform(F.filter(F.sequence(F.lit(0), F.col("members") - 1), lambda k: ~F.col("guest") & (k != j)), lambda k: F.struct(i.cast("int").alias("i"), k.cast("int").alias("j"), F.lit(True).alias("left"), F.lit(False).alias("right")))
    return sides.select(*key, "guest", "h", "g", "first", "copies", "embedding", F.inline(F.concat(as_right, as_left)))


def near_duplicate_vectors(vectors: DataFrame, threshold: float = 0.98, sample: int = SAMPLE) -> DataFrame:
    """Links and link component of every row of ``vectors`` (vec_id, embedding, label; other columns are ignored).

    Returns vec_id, n_links (other rows linked directly), component_id (smallest vec_id
    reachable, itself included) and kept (vec_id = component_id). Vectors that are null,
    empty, zero or hold null or non-finite components, and rows without label or vec_id, have no
    links. Vectors of different lengths never link. Rows that repeat a vec_id count as
    rows for links and as one for components. An empty table gives no rows.
    """
    given = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label")
    keyed = given.filter(usable()).select("*", F.xxhash64("label", "embedding").alias("h"), F.xxhash64(F.lit(1), "embedding", "label").alias("g"))
    classes = checkpoint(classes_of(keyed).withColumn("length", F.size("embedding")))
    ids = checkpoint(keyed.select("vec_id", "h", "g"))
    width = classes.agg(F.max("length")).first()[0] or 1
    axes = rotation(classes, width, sample)
    step = float(np.sqrt(2 - 2 * threshold)) * (1 + SLACK) + SLACK
    columns = ", ".join(f"{n} {t}" for n, t in classes.dtypes)
    cells = checkpoint(classes.mapInPandas(_cells(axes, width, step), f"{columns}, cell array<int>"))
    found = checkpoint(
        _tiles(cells).groupBy("label", "length", "host", "i", "j")
        .applyInPandas(_compare(axes, width, threshold), "h long, g long, links long, a long, b long"))
    components = connected_components(found.select("a", "b").filter("a <> b").distinct())
    links = found.groupBy("h", "g").agg(F.sum("links").alias("links"))
    done = (
        classes.join(links, ["h", "g"], "left").join(components, F.col("first") == F.col("node"), "left")
        .select("h", "g", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "first").alias("component_id"))
    )
    linked = ids.join(done, ["h", "g"]).select("vec_id", "n_links", "component_id")
    alone = given.filter(~usable()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


#: The same links and components over the table ``embeddings``, by all pairs of a label.
SQL = """
WITH RECURSIVE fine AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings
  WHERE label IS NOT NULL AND vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
linked AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM fine a JOIN fine b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_dot_product(a.v, b.v) / (a.n * b.n) >= 0.98),
reach AS (
  SELECT vec_id, vec_id AS seen FROM embeddings
  UNION SELECT r.vec_id, l.b FROM reach r JOIN linked l ON r.seen = l.a),
least AS (SELECT vec_id, min(seen) AS component_id FROM reach GROUP BY vec_id)
SELECT e.vec_id, coalesce(k.n, 0)::BIGINT AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN least c USING (vec_id) LEFT JOIN (SELECT a, count(*) AS n FROM linked GROUP BY a) k ON k.a = e.vec_id"""
