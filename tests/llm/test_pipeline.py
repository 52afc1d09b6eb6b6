"""The pipeline against a plain version of each stage, worked on its own input."""

import sentencepiece

import corpus_pipeline
from factloom.llm import mixing, pii, quality_model
from factloom.session import reread
from test_pii import base_spans
from test_shingles import plain_components, plain_sets

import numpy as np

SF = "/root/testdata/sf0.001"


def plain_score(text, weights):
    slots, values = quality_model.features(text)
    return 1 / (1 + np.exp(-(float(values @ weights[slots].astype(np.float32)) + float(weights[-1]))))


def test_stages_on_small_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, theirs = docs.columns, sentencepiece.SentencePieceProcessor(model_file=corpus_pipeline.MODEL)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "personal_data", "mix", "encode"]
    for name, stage in corpus_pipeline.STAGES:
        before = sorted(map(tuple, docs.collect()))
        result = reread(stage(spark, docs, SF), name)
        after = sorted(map(tuple, result.select(*columns).collect())) if name != "encode" else []
        assert name == "encode" or result.columns == columns
        if name == "quality":
            weights, _ = quality_model.fit(docs)
            assert after == [r for r in before if r[1] and r[1].strip() and plain_score(r[1], weights) >= quality_model.THRESHOLD]
        elif name == "near_duplicates":
            found = plain_components(plain_sets([r[1] for r in before]))
            assert after == [r for i, (r, c) in enumerate(zip(before, found)) if i == c] and len(after) < len(before)
        elif name == "personal_data":
            model, thresholds = pii.fit(spark)
            spans = {r.doc_id: r.spans for r in pii.report(docs, model=model, thresholds=thresholds).collect()}
            for old, new in zip(before, after):
                text, want = old[1], [s.split(":") for s in spans[old[0]].split(",") if s]
                assert set(base_spans(text)) <= set(spans[old[0]].split(",")) | {""}
                end = len(text) + 1
                for kind, a, b in sorted(want, key=lambda s: -int(s[1])):
                    if int(b) <= end:
                        text, end = f"{text[:int(a)]}[{kind.upper()}]{text[int(b):]}", int(a)
                assert new == (old[0], text, *old[2:4], len(text))
        elif name == "mix":
            copies = {r.doc_id: r.copies for r in mixing.mix(docs).collect()}
            assert after == sorted(r for r in before for _ in range(copies[r[0]]))
        else:
            got = sorted((r.doc_id, list(r.ids)) for r in result.collect())
            assert got == sorted((r[0], theirs.encode(r[1])) for r in before)
            assert result.filter("not round_trip").count() == 0
        docs = result


def test_run_gives_the_last_stage(spark):
    rows = corpus_pipeline.run(spark, SF)
    assert rows.columns == ["doc_id", "lang", "source", "ids", "n_ids", "round_trip"] and rows.count() > 0


def test_empty_table(spark, tmp_path):
    spark.read.parquet(f"{SF}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_odd_rows_and_clashing_columns(spark, odd_docs):
    """Every stage takes odd rows beside columns named like its own, and hands on all columns but for the last."""
    extra = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    docs = odd_docs.unionByName(extra, allowMissingColumns=True)
    for name, stage in corpus_pipeline.STAGES:
        result = reread(stage(spark, docs, SF), name)
        if name == "encode":
            assert {"doc_id", "ids"} <= set(result.columns) and result.count() == docs.count()
        else:
            assert result.columns == docs.columns
            texts = [r.text for r in result.select("text").collect()]
            assert texts and (name == "mix" or len(texts) <= docs.count())
        docs = result
