import math

import numpy as np
import pytest

from factloom.llm import topk, vector_dedup


def rows(seed=0, n=240, d=10):
    rng, out = np.random.default_rng(seed), []
    for i in range(n):
        v = rng.standard_normal(d)
        if i % 4 == 1:
            v = np.array(out[-1][1], float) + rng.standard_normal(d) * 0.08
        if i % 10 == 3:
            v = np.array(out[3][1] if len(out) > 3 else v, float)
        out.append((i, [float(np.float32(x)) for x in v], int(i // 80)))
    bad = [(1000, None, 1), (1001, [0.0] * d, 1), (1002, [math.nan] + [1.0] * (d - 1), 1), (1003, [None] + [1.0] * (d - 1), 1),
           (1004, [math.inf] * d, 1), (1005, out[5][1], None), (1006, [], 1), (1007, out[5][1][:5], 0), (1008, [1e30] * d, 2), (1009, [2e30] * d, 2), (1010, [1e-30] * d, 2)]
    return out + bad


SCHEMA = "vec_id long, embedding array<float>, label int"


def links(data, threshold=0.98):
    fine = [(i, np.array(v, float), k, len(v)) for i, v, k in data if i is not None and v and k is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    found = {}
    for i, a, k, n in fine:
        for j, b, m, o in fine:
            if i != j and k == m and n == o:
                a1, b1 = a / np.abs(a).max(), b / np.abs(b).max()
                if a1 @ b1 / (np.linalg.norm(a1) * np.linalg.norm(b1)) >= threshold:
                    found.setdefault(i, set()).add(j)
    return found


@pytest.mark.parametrize("tile", [8, 1024])
def test_vector_links(spark, monkeypatch, tile):
    monkeypatch.setattr(vector_dedup, "TILE", tile)
    data = rows()
    frame = spark.createDataFrame(data, SCHEMA).selectExpr("*", "1 as h", "'x' as first", "2 as copies")
    got = {r.vec_id: r for r in vector_dedup.near_duplicate_vectors(frame).collect()}
    found = links(data)
    label = {i: i for i, *_ in data}
    for _ in range(40):
        for i, near in found.items():
            label[i] = min(label[i], *(label[j] for j in near))
    assert {i: r.n_links for i, r in got.items()} == {i: len(found.get(i, ())) for i, *_ in data}
    assert {i: r.component_id for i, r in got.items()} == label
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values()) and sum(map(len, found.values())) > 100


def test_equal_to_sql(spark, duck):
    data = [r for r in rows(1, 120) if r[0] < 1000]
    frame = spark.createDataFrame(data, SCHEMA)
    want = duck(vector_dedup.SQL, embeddings=frame.toPandas()).sort_values("vec_id")
    got = vector_dedup.near_duplicate_vectors(frame).toPandas().sort_values("vec_id")
    assert got.values.tolist() == want[list(got.columns)].values.tolist()


def best(data, k):
    fine = [(i, [math.floor(64 * float(x)) for x in v]) for i, v, _ in data if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in fine:
        if i % 20 == 0:
            scored = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(q, c)))), j) for j, c in fine if j != i and len(c) == len(q))
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("sizes", [(8192, 256), (32, 3)])
def test_top_k(spark, monkeypatch, sizes):
    monkeypatch.setattr(topk, "CANDIDATES", sizes[0])
    monkeypatch.setattr(topk, "QUERIES", sizes[1])
    monkeypatch.setattr(topk, "GROUP", 3)
    data = rows()
    frame = spark.createDataFrame(data, SCHEMA).selectExpr("*", "1 as score", "2 as value")
    got = topk.top_k(frame, frame.filter("vec_id % 20 = 0"), 7).collect()
    assert sorted(tuple(r) for r in got) == best(data, 7)


def test_top_k_with_ties_and_few_rows(spark):
    frame = spark.createDataFrame([(20 * i, [1.0, 0.0], 0) for i in range(5)], SCHEMA)
    got = sorted(tuple(r) for r in topk.top_k(frame, frame, 3).collect())
    assert got == [(20 * i, n + 1, j, 4096) for i in range(5) for n, j in enumerate([20 * j for j in range(5) if j != i][:3])]
    assert topk.top_k(frame.limit(1), frame.limit(1), 3).count() == 0


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert vector_dedup.near_duplicate_vectors(none).count() == 0
    assert topk.top_k(none, none).count() == 0


def test_repeated_rows(spark):
    frame = spark.createDataFrame([(7, [1.0, 2.0], 0), (7, [1.0, 2.0], 0), (9, [1.0, 2.01], 0), (None, [1.0, 2.0], 0)], SCHEMA)
    got = sorted((r.vec_id or -1, r.n_links, r.component_id) for r in vector_dedup.near_duplicate_vectors(frame).collect())
    assert got == [(-1, 0, None), (7, 2, 7), (7, 2, 7), (9, 2, 7)]
