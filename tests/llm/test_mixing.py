import pandas as pd

from factloom.llm import mixing


def corpus(n=400):
    texts = [None if i % 41 == 0 else "w " * (1 + (i * 7919) % 97) for i in range(n)]
    sources = [None if i % 29 == 0 else "big" if i % 3 == 0 else f"s{i % 7}" for i in range(n)]
    return pd.DataFrame({"doc_id": range(n), "text": texts, "source": sources})


def test_equal_to_sql(spark, duck):
    frame = corpus()
    docs = spark.createDataFrame(frame.astype(object).where(frame.notna(), None), "doc_id long, text string, source string").repartition(7)
    got = mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken").toPandas().sort_values("doc_id").reset_index(drop=True)
    want = duck(mixing.SQL, documents=frame).sort_values("doc_id").reset_index(drop=True)
    pd.testing.assert_frame_equal(got, want[list(got.columns)], check_dtype=False)
    assert (got.taken <= 2 * got["size"]).all()
    per = got.merge(frame, on="doc_id").groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), most=("size", "max"))
    assert ((per.taken - per.target).abs() <= per.most / 2 + 1).all()
    assert abs(sum(got.merge(frame, on="doc_id").fillna({"source": "-"}).groupby("source").target.first()) - 1.5 * got["size"].sum()) < 1e-6


def test_targets_stop_at_twice_the_source(spark):
    rows = [("a", 10), ("b", 1000), ("c", 1000), (None, 1000)]
    sizes = spark.createDataFrame([(s, n, float(n)) for s, n in rows], "source string, source_size long, merit_size double")
    got = {r.source: r.target for r in mixing.targets(sizes).collect()}
    # a (weight 5) stops at 20; 4495 is left for b, c and null with weights 2, 1, 5; null stops at 2000, then b at 1663.3
    left = 1.5 * 3010 - 20 - 2000
    assert got["a"] == 20 and got[None] == 2000 and abs(got["b"] - left * 2 / 3) < 1e-9 and abs(got["c"] - left / 3) < 1e-9


def test_merit_makes_unequal_chances(spark):
    docs = spark.createDataFrame([(i, "w " * 10, "s", 3.0 if i % 2 else 1.0) for i in range(2000)], "doc_id long, text string, source string, merit double")
    from pyspark.sql import functions as F
    rows = mixing.mix(docs, share=0.5, merit=F.col("merit")).join(docs.select("doc_id", "merit"), "doc_id").groupBy("merit").agg(F.sum("taken").alias("t")).collect()
    taken = {r.merit: r.t for r in rows}
    assert abs(sum(taken.values()) - 10_000) <= 10 and 2.2 < taken[3.0] / taken[1.0] < 4.0


def test_odd_rows(odd_docs, no_docs):
    rows = mixing.mix(odd_docs).collect()
    assert len(rows) == odd_docs.count() and all(r.taken <= 2 * r.size for r in rows)
    assert all(r.size == 0 and r.taken == 0 for r in rows if r.doc_id in (0, 1, 2))
    mixed = mixing.mixed_documents(odd_docs)
    assert mixed.columns == odd_docs.columns
    assert mixed.count() == sum(r.copies for r in rows)
    assert mixing.mix(no_docs).count() == 0 and mixing.mixed_documents(no_docs).count() == 0


def test_reruns_agree(odd_docs):
    first = sorted(map(str, mixing.mix(odd_docs).collect()))
    assert first == sorted(map(str, mixing.mix(odd_docs.repartition(5)).collect()))
