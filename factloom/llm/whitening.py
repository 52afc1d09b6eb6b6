"""Principal components and whitening of integer-scaled embeddings by a block Jacobi-Davidson method.

The covariance matrix is never formed. Vectors are written once as packed blocks; a product of the covariance with a
few vectors is one pass over them, ``C' (C W) / n`` with rows C centred from exact integers, added up by Spark cell by
cell, so the driver receives as many numbers as W has. On top of that:

* Rayleigh-Ritz in the search space gives Ritz pairs and their residuals;
* the correction equation of each unfinished pair, ``(I - QQ')(A - tI)(I - QQ') z = -r`` with Q the locked and current Ritz
  vectors, is solved roughly by MINRES, all pairs in step, so an inner iteration is one pass for all of them;
* the corrections extend the search space; pairs whose residual is at the level of double precision are locked and leave it.

Nothing on the driver is larger than the dimension times the size of the search space.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.session import reread

SCALE, SHIFT = 1024, 100_000
#: Vectors of a packed block, inner iterations, blocks of corrections in the search space, and rounds before giving up.
ROWS, INNER, SPACE, ROUNDS = 4096, 5, 8, 200
#: A residual below this part of the largest eigenvalue is at the level of double precision.
PRECISION = 2.0 ** -43
OUT = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


@dataclass
class Fit:
    """Exact moments of the fit list, and its components: columns of ``vectors`` by falling ``values``."""

    n: int
    sums: list[int]
    trace: float
    values: np.ndarray
    vectors: np.ndarray
    passes: int


def scaled(rows: DataFrame, column: str = "embedding") -> DataFrame:
    """(vec_id, x): entries as floor(1024 c) + 100000 of the rows that take part.

    Null and empty vectors, vectors with null or non-finite entries or entries beyond 2**40, and vectors of another length than the
    most frequent one (the longest of equally frequent ones) are left out.
    """
    entry = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < 2.0**40)
    vectors = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("v"))
    valid = vectors.filter(F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", entry))
    usual = valid.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).first()
    kept = valid.filter(F.size("v") == (usual["d"] if usual else 0))
    return kept.select("vec_id", F.transform("v", lambda c: F.floor(c * SCALE).cast("long") + SHIFT).alias("x"))


def packed(vectors: DataFrame) -> DataFrame:
    """Blocks (ids, x) of up to ``ROWS`` vectors, x as little-endian longs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                part = batch.slice(i, ROWS)
                x = part.column("x").flatten().to_numpy(zero_copy_only=False).astype("<i8")
                yield pa.RecordBatch.from_arrays([pa.array([part.column("vec_id").to_pylist()], pa.list_(pa.int64())), pa.array([x.tobytes()], pa.binary())], ["ids", "x"])

    return vectors.mapInArrow(run, "ids array<long>, x binary")


def _block(x: bytes, dimensions: int) -> np.ndarray:
    return np.frombuffer(x, "<i8").reshape(-1, dimensions)


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exact: longs where they suffice, Python integers beyond."""
    if n * int(np.abs(x).max(initial=1)) + max(map(abs, sums)) < 2**62:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def _added(blocks: DataFrame, part: Callable[[bytes], np.ndarray], kind: str) -> np.ndarray:
    """The sum of ``part`` over all blocks, flat. Tasks add their blocks, then Spark adds cell by cell."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for x in batch.column(0):
                own = part(x.as_py()).ravel()
                total = own if total is None else total + own
        if total is not None:
            values = pa.array(total, pa.float64()) if kind == "double" else pa.array([Decimal(int(v)) for v in total], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int64()), values], ["cell", "value"])

    cells = blocks.select("x").mapInArrow(run, f"cell long, value {kind}").groupBy("cell").agg(F.sum("value").cast(kind).alias("value")).toPandas()
    out = np.zeros(len(cells), float if kind == "double" else object)
    out[cells["cell"].to_numpy()] = cells["value"].to_numpy()
    return out


def moments(blocks: DataFrame, dimensions: int) -> tuple[int, list[int], float]:
    """Number of vectors, sums per dimension, and trace of the covariance, from exact integer sums."""
    def part(x: bytes) -> np.ndarray:
        rows = _block(x, dimensions).astype(object)
        return np.concatenate([[len(rows)], rows.sum(axis=0), (rows * rows).sum(axis=0)])

    cells = [int(v) for v in _added(blocks, part, "decimal(38,0)")]
    n, sums, squares = cells[0], cells[1:dimensions + 1], cells[dimensions + 1:]
    return n, sums, float(Fraction(sum(n * q - s * s for s, q in zip(sums, squares)), n * n))


def covariance_product(blocks: DataFrame, dimensions: int, n: int, sums: list[int]) -> Callable[[np.ndarray], np.ndarray]:
    """The matrix-free product of the covariance with the columns of a matrix: one pass over the blocks."""
    def product(w: np.ndarray) -> np.ndarray:
        def part(x: bytes) -> np.ndarray:
            c = (_centred(_block(x, dimensions), n, sums) / n).astype(float)
            return c.T @ (c @ w)

        return _added(blocks, part, "double").reshape(w.shape) / n

    return product


def _orthonormal(new: np.ndarray, *against: np.ndarray) -> np.ndarray:
    """Orthonormal columns that span what ``new`` adds to the spans of ``against``; directions lost to rounding are dropped."""
    new = new / np.maximum(np.linalg.norm(new, axis=0), np.finfo(float).tiny)
    for _ in range(2):
        for q in against:
            new = new - q @ (q.T @ new)
        u, s, _ = np.linalg.svd(new, full_matrices=False)
        new = u[:, s > 1e-10]
    return new


def minres(apply: Callable[[np.ndarray], np.ndarray], right: np.ndarray, steps: int) -> np.ndarray:
    """``steps`` MINRES iterations on each column of ``right``, in step; ``apply`` maps all columns at once, each by its own symmetric operator.

    A column whose Krylov space is exhausted stays as it is.
    """
    x, beta = np.zeros_like(right), np.linalg.norm(right, axis=0)
    small = np.finfo(float).eps * np.maximum(beta, np.finfo(float).tiny)
    live = beta > 0
    v_old, v = np.zeros_like(right), right / np.where(live, beta, 1)
    d_old, d = np.zeros_like(right), np.zeros_like(right)
    c_old, s_old, c, s = np.ones_like(beta), np.zeros_like(beta), np.ones_like(beta), np.zeros_like(beta)
    eta, b = beta.copy(), np.zeros_like(beta)
    for _ in range(steps):
        w = apply(v) - v_old * b
        a = (v * w).sum(axis=0)
        w = w - v * a
        b_new = np.linalg.norm(w, axis=0)
        rho3, gap = s_old * b, c_old * b
        rho2, rho1 = c * gap + s * a, c * a - s * gap
        top = np.hypot(rho1, b_new)
        live = live & (top > small)
        safe = np.where(live, top, 1)
        c_old, s_old, c, s = c, s, rho1 / safe, b_new / safe
        step = np.where(live, (v - d_old * rho3 - d * rho2) / safe, 0)
        x = x + step * (c * eta)
        d_old, d, eta = d, step, np.where(live, -s * eta, 0)
        live = live & (b_new > small)
        v_old, v, b = v, np.where(live, w / np.where(live, b_new, 1), 0), np.where(live, b_new, 0)
        if not live.any():
            break
    return x


def largest_pairs(product: Callable[[np.ndarray], np.ndarray], dimensions: int, wanted: int, floor: float = 0.0) -> tuple[np.ndarray, np.ndarray, int]:
    """The ``wanted`` largest eigenpairs of the symmetric operator ``product``, by falling value, and the number of products.

    Pairs at or below ``floor`` are noise and end the search. Running out of rounds is an error, never a rough answer.
    """
    passes = 0

    def image_of(w: np.ndarray) -> np.ndarray:
        nonlocal passes
        passes += 1
        return product(w)

    none = np.zeros((dimensions, 0))
    locked, values = none, np.zeros(0)
    basis = _orthonormal(np.random.default_rng(1).standard_normal((dimensions, min(dimensions, wanted + 2))))
    image = image_of(basis)
    for _ in range(ROUNDS):
        inner = basis.T @ image
        theta, s = np.linalg.eigh((inner + inner.T) / 2)
        theta, s = theta[::-1], s[:, ::-1]
        basis, image = basis @ s, image @ s
        active = min(wanted - len(values), len(theta))
        residual = image[:, :active] - basis[:, :active] * theta[:active]
        residual -= locked @ (locked.T @ residual)
        size = np.linalg.norm(residual, axis=0)
        scale = max([*values[:1], theta[0]])
        done = size <= PRECISION * scale
        ready = active if done.all() else int(np.argmin(done))
        if ready:
            locked, values = np.c_[locked, basis[:, :ready]], np.r_[values, theta[:ready]]
            basis, image = basis[:, ready:], image[:, ready:]
        if len(values) == wanted or basis.shape[1] == 0 or theta[0] <= floor:
            break
        active -= ready
        if basis.shape[1] > SPACE * wanted:
            basis, image = basis[:, :2 * wanted], image[:, :2 * wanted]
        if len(values) + basis.shape[1] == dimensions:  # the search space is the whole space: what is left is rounding
            image = image_of(basis)
            continue
        outside = lambda w, q=np.c_[locked, basis[:, :active]]: w - q @ (q.T @ w)
        shift = theta[ready:ready + active]
        steps = minres(lambda w: outside(image_of(outside(w)) - outside(w) * shift), -outside(residual[:, ready:]), INNER)
        new = _orthonormal(steps, locked, basis)
        if not new.shape[1]:
            new = _orthonormal(np.random.default_rng(passes).standard_normal((dimensions, 1)), locked, basis)
        new = new[:, :dimensions - len(values) - basis.shape[1]]
        basis, image = np.c_[basis, new], np.c_[image, image_of(new)]
    else:
        raise RuntimeError(f"eigenpairs did not settle in {ROUNDS} rounds")
    order = np.argsort(-values, kind="stable")
    order = order[values[order] > floor]
    return values[order], locked[:, order], passes


def fit(blocks: DataFrame, dimensions: int, components: int = 8) -> Fit:
    """Components of the covariance (divisor n) of all packed vectors; directions without variance are no components."""
    n, sums, trace = moments(blocks, dimensions)
    if trace == 0:
        return Fit(n, sums, trace, np.zeros(0), np.zeros((dimensions, 0)), 0)
    floor = dimensions * np.finfo(float).eps * trace
    values, vectors, passes = largest_pairs(covariance_product(blocks, dimensions, n, sums), dimensions, min(components, dimensions), floor)
    return Fit(n, sums, trace, values, vectors, passes)


def whiten(rows: DataFrame, components: int = 8) -> DataFrame:
    """Whitened coordinates of ``rows`` (vec_id, embedding; other columns are ignored): one row per vector and component.

    Returns vec_id, component (from 1), n, deviation (decimal: sum over dimensions of (n x - S)^2, exact), whitened, explained and
    identity_error; ``scaled`` tells which rows take part. Fewer components come out where there are fewer dimensions, or where the
    covariance has no variance left (so none from equal vectors or a single one). Rows that repeat an id, and rows without one, are vectors of their
    own. No rows in, no rows out.
    """
    spark = rows.sparkSession
    vectors = scaled(rows)
    blocks = reread(packed(vectors), "vectors", compression="zstd")
    first = blocks.select(F.octet_length("x").alias("bytes"), F.size("ids").alias("rows")).first()
    if first is None:
        return spark.createDataFrame([], OUT)
    dimensions = first["bytes"] // 8 // first["rows"]
    found = fit(blocks, dimensions, components)
    if not len(found.values):
        return spark.createDataFrame([], OUT)
    n, sums, axes = found.n, found.sums, found.vectors / np.sqrt(found.values)
    kept = axes.shape[1]

    def white(x: bytes) -> tuple[np.ndarray, np.ndarray]:
        exact = _centred(_block(x, dimensions), n, sums)
        return exact, (exact / n).astype(float) @ axes

    def second(x: bytes) -> np.ndarray:
        w = white(x)[1]
        return np.r_[(w.T @ w).ravel(), w.sum(axis=0)]

    cells = _added(blocks, second, "double") / n
    means = cells[kept * kept:]
    error = float(np.abs(cells[:kept * kept].reshape(kept, kept) - np.outer(means, means) - np.eye(kept)).max())
    explained = found.values / found.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, x in zip(batch.column("ids"), batch.column("x")):
                exact, w = white(x.as_py())
                bound = math.isqrt(2**62 // dimensions)
                square = exact if exact.dtype != object and np.abs(exact).max() < bound else exact.astype(object)
                deviation = [Decimal(int(v)) for v in (square * square).sum(axis=1)]
                m = len(exact)
                yield pa.RecordBatch.from_arrays([
                    ids.values.take(pa.array(np.repeat(np.arange(m), kept))), pa.array(np.tile(np.arange(1, kept + 1), m), pa.int32()), pa.array(np.full(m * kept, n), pa.int64()),
                    pa.array(deviation, pa.decimal128(38, 0)).take(pa.array(np.repeat(np.arange(m), kept))), pa.array(w.ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * kept, error)),
                ], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return blocks.mapInArrow(run, OUT)
