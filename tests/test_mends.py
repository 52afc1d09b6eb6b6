"""Cases that earlier rounds got wrong."""

import hashlib
import json
import os
import random
import re
import subprocess
import sys
from collections import Counter
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import functions as F

from factloom import config as C
from factloom.functions import keys, predicates
from factloom.functions import similarity as S
from factloom.functions import text as T
from factloom.operators import common, dedup, extraction, merging, profiles, quality, reports, simjoin, textprep
from factloom.plans import sources
from factloom.plans.tables import Tables
from factloom.sources import documents as D
from factloom.sources import sinks
from factloom.streaming import ingest

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
FACT = ("fact_id string, document_id long, evidence_id string, fact_type string, subject_text string, predicate string, object_text string, value_num double, "
        "value_text string, unit string, currency string, time_expr string, qualifier_json string, confidence_score double, review_status string, created_at timestamp, "
        "subject_entity_id string, object_entity_id string")


def facts(spark, rows):
    base = {"document_id": 1, "fact_type": "COOPERATION", "subject_text": "s", "predicate": "p", "review_status": "自动通过", "confidence_score": 0.9}
    names = [f.split()[0] for f in FACT.split(", ")]
    return spark.createDataFrame([tuple({**base, **r}.get(n) for n in names) for r in rows], FACT)


def test_facts_that_differ_at_character_31_are_kept(spark):
    rows = facts(spark, [{"fact_id": "a", "object_text": "x" * 30 + "1"}, {"fact_id": "b", "object_text": "x" * 30 + "2"},
                         {"fact_id": "c", "fact_type": "OTHER", "predicate": "y" * 20 + "1"}, {"fact_id": "d", "fact_type": "OTHER", "predicate": "y" * 20 + "2"}])
    assert rows.withColumns(keys.fact_key_columns()).select("k_disc").distinct().count() == 4
    assert dedup.within_document(rows).count() == 0


def test_clean_qualifiers_looks_at_the_top_level_only(spark):
    given = ['{"product":"x","detail":{"product":"inner"}}', '{"growth_description":{"a":{"b":1}},"k":1}', '{"product":1,"product_type":[2]}', "{bad", '{"k":1}', '["product"]', None]
    rows = spark.createDataFrame([(i, g) for i, g in enumerate(given)], "i int, qualifier_json string")
    got = {r.i: r.qualifier_json for r in quality.clean_qualifiers(rows).collect()}
    assert json.loads(got[0]) == {"product_type": "x", "detail": {"product": "inner"}}
    assert json.loads(got[1]) == {"k": 1} and json.loads(got[2]) == {"product_type": [2]}
    assert [got[i] for i in (3, 4, 5, 6)] == given[3:]


def test_upsert_keeps_content_hashes_unique(spark):
    schema = "document_id string, url string, content_hash string, " + ", ".join(f"{c} string" for c in D.DOCUMENT_COLUMNS if c not in ("url", "content_hash"))
    columns = [f.split()[0] for f in schema.split(", ")]
    make = lambda rows, extra="": spark.createDataFrame([tuple(r.get(c) for c in columns) for r in rows], schema)
    stored = make([{"document_id": "D1", "url": "http://a", "content_hash": "H1"}, {"document_id": "D2", "content_hash": "H2"},
                   {"document_id": "D3", "url": "http://c", "content_hash": "H3"}]).withColumn("status", F.lit("done"))
    incoming = make([{"url": "http://a", "content_hash": "H2"}, {"url": "http://new", "content_hash": "H3"}, {"url": "http://c", "content_hash": "H9"}]) \
        .drop("document_id").withColumn("n", F.monotonically_increasing_id())
    snapshot, urls = D.upsert(stored, incoming, "n")
    rows = snapshot.collect()
    hashes = [r.content_hash for r in rows]
    assert len(hashes) == len(set(hashes)) and {r.document_id for r in rows} >= {"D1", "D2", "D3"}
    pairs = {(r.document_id, r.url) for r in urls.collect()}
    assert ("D2", "http://a") in pairs and ("D3", "http://new") in pairs and ("D3", "http://c") in pairs


def test_a_url_submitted_twice_is_reported_twice(spark):
    class Given:
        pages = spark.createDataFrame([(1, "https://a", "one"), (2, "https://a", "two"), (3, "http://b", "three"), (4, "http://b", "four")], "page_id long, url string, html string")

    got = sorted(tuple(r) for r in sources.s7_pages(Given).collect())
    assert got == [("http://b", "inserted", "待处理")] * 2 + [("https://a", "updated", "待处理")] * 2


def test_title_keeps_a_reference_without_its_semicolon(spark):
    class Given:
        pages = spark.createDataFrame([(1, "u", "<h1>R&amp;D &#38; more and&amp</h1>"), (2, "u", "<!-- a &amp b --><h1>x & y&lt</h1>")], "page_id long, url string, html string")

    assert [r.title for r in sources.s5(Given).orderBy("page_id").collect()] == ["R&D & more and&amp", "x & y&lt"]


def test_long_names_are_compared(spark):
    long = "Aktiengesellschaft der Vereinigten Farbenwerke " * 3
    names = spark.createDataFrame([("1", long + "Nord", "企业"), ("2", long + "Nord.", "企业"), ("3", "Other", "企业")], "entity_id string, canonical_name string, entity_type string")
    assert [(r.primary_id, r.secondary_id) for r in merging.merge_suggestions(names, limit=None).collect()] == [("1", "2")]
    ratio = names.select(S.matcher_ratio(F.col("canonical_name"), F.lit(long)).alias("r")).collect()
    assert ratio[0].r > 0.95


def test_benchmarks_and_timelines_are_not_cut_by_repeats(spark):
    rows = [{"fact_id": f"f{i:03}", "fact_type": "SALES_VOLUME", "value_num": 1.0, "time_expr": "2024年", "subject_entity_id": "E"} for i in range(120)]
    rows.append({"fact_id": "g", "fact_type": "CAPACITY", "value_num": 2.0, "time_expr": "2001年", "subject_entity_id": "E"})
    given = facts(spark, rows)
    assert profiles.profile_benchmarks(given).count() == 2
    assert reports.timelines(given, limit=2).count() == 2


def test_failed_documents_stay_in_a_cut_list(spark):
    listed = spark.createDataFrame([(i, "已完成", i + 10) for i in range(5)] + [(9, "失败", 1)], "document_id int, status string, crawl_time int")
    assert [r.document_id for r in reports.document_order(listed, limit=2).collect()] == [9, 4]


def test_workers_find_the_package_from_another_folder(tmp_path):
    code = (
        "import sys; sys.path.insert(0, sys.argv[1])\n"
        "import __spark_entry__ as e\n"
        "from pyspark.sql import SparkSession\n"
        "spark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', '2').getOrCreate()\n"
        "print('ROWS', e.queries()['T7_chunks'](spark, '/root/testdata/sf0.001').count())\n")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code, REPO], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS" in done.stdout, done.stderr[-2000:]


def test_export_can_be_compressed(spark, tmp_path):
    rows = facts(spark, [{"fact_id": "a", "object_text": 'x "y"\n, z'}, {"fact_id": "b"}])
    sinks.write_csv(rows, str(tmp_path / "out"), "gzip")
    assert list((tmp_path / "out").glob("*.csv.gz")) and not list((tmp_path / "out").glob("*.csv"))
    back = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(str(tmp_path / "out"))
    assert sorted((r[0], r.object_text) for r in back.collect()) == [("a", 'x "y"\n, z'), ("b", None)]


def test_an_article_of_many_answers_is_cleaned_once(spark):
    long, short = "<p>" + "正文" * 60 + "</p>", "<p>短</p>"
    given = [("a", long), ("b", short), ("c", long), ("d", None), ("e", " "), ("f", short), ("g", "<p> </p>")]
    answers = spark.createDataFrame([(r, 1, "[]", text) for r, text in given], ingest.ANSWERS)
    passed, stopped = ingest.gate_articles(answers)
    assert sorted(r.request_id for r in passed.collect()) == ["a", "c", "d"]
    assert {r.request_id: r.reason for r in stopped.collect()} == {"b": C.DOC_TOO_SHORT, "e": C.DOC_EMPTY, "f": C.DOC_TOO_SHORT, "g": C.DOC_EMPTY_CLEAN}
    for df in (passed, stopped):  # no answer's own row is cleaned
        assert "regexp_replace" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_facts_are_written_once_and_a_repeated_answer_counts_once(spark, tmp_path):
    body = lambda *subjects: json.dumps({"CAPACITY": [{"subject": s, "predicate": "产能为", "value_num": 1, "confidence": 0.5, "evidence_text": e} for s, e in subjects]}, ensure_ascii=False)
    first, second = body(("甲", "x"), ("甲 ", "y"), ("乙", "")), body(("丙", "z"))
    out = str(tmp_path)
    for batch, given in enumerate(([("a", 1, first, None), ("a", 1, first, None)], [("a", 1, first, None), ("b", 2, second, None)])):
        ingest.process_batch(spark.createDataFrame(given, ingest.ANSWERS), batch, out)
    for _ in range(2):  # as read from the batches, and from the compaction
        live = ingest.current_facts(spark, out).filter(F.col("review_status") != C.DUPLICATE)
        assert sorted((r.request_id, r.subject_text) for r in live.select("request_id", "subject_text").collect()) == [("a", "甲"), ("b", "丙")]
        ingest.compact_index(spark, out)
    # no fact is stored twice for its marks, and what was parsed goes when the next batch is published
    assert spark.read.parquet(f"{out}/facts").count() == 10 and not (tmp_path / "staged").exists()
    assert [p.name for p in (tmp_path / "parsed").iterdir() if p.is_dir()] == ["batch_id=1"]


def test_documents_are_cleaned_once(spark):
    docs = spark.createDataFrame([(1, "<p>" + "正文" * 60 + "</p>"), (2, "短"), (3, None), (4, "")], "document_id long, raw_text string")
    chunks = textprep.whole_text_chunks(textprep.clean_documents(docs))
    assert [(r.document_id, r.chunk_text, r.char_count) for r in chunks.collect()] == [(1, "正文" * 60, 120)]
    assert chunks._jdf.queryExecution().optimizedPlan().toString().count("(?i)</p>") == 1
    assert {r.document_id: r.stop_status for r in textprep.clean_documents(docs).collect()} == {1: None, 2: C.DOC_TOO_SHORT, 3: C.DOC_EMPTY, 4: C.DOC_EMPTY}


def test_sizes_and_paragraphs_read_a_text_once(spark):
    texts = ["", None, "abc def\u00a0gh\n\n ij", "佐敦 涂料\u3000abcde㐀", "é" * 11, "a\u2028b" * 7 + "𠀀", "一\n \n二\n\n\n\n三 ab"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    han = lambda t: sum("\u4e00" <= c <= "\u9fff" or "\u3400" <= c <= "\u4dbf" for c in t)
    want = {i: None if t is None else han(t) + sum(not c.isspace() and not han(c) for c in t) // 5 for i, t in enumerate(texts)}
    assert {r.i: r.n for r in rows.select("i", T.effective_chars(F.col("text")).alias("n")).collect()} == want
    parts = rows.select("i", T.paragraphs(F.col("text")).alias("p"))
    assert [(p.body, p.char_start, p.char_end) for p in parts.filter("i = 6").first().p] == [("一", 0, 1), ("二", 4, 5), ("三 ab", 9, 13)]
    plan = parts._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == 1 and plan.count("split(") == 1


def test_evidence_answers_are_read_once(spark):
    body = json.dumps({"has_fact": True, "candidates": [{"evidence_text": "x", "fact_type": "CAPACITY"}, {"evidence_text": "", "fact_type": "CAPACITY"}]})
    given = [("a", body), ("b", f"<think>no</think>{body}"), ("c", '{"has_fact": false, "candidates": [{"evidence_text": "y", "fact_type": "CAPACITY"}]}'), ("d", None), ("e", "none")]
    rows = spark.createDataFrame([(r, ord(r), "C", text) for r, text in given], "request_id string, document_id long, chunk_id string, content string")
    none = spark.createDataFrame([], "document_id long, fact_type string, evidence_text string")
    found = extraction.ingest_evidence(extraction.parse_answers(rows), none)
    assert sorted((r.document_id, r.evidence_text, r.priority) for r in found.collect()) == [(97, "x", "medium"), (98, "x", "medium")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson(") == 1 and plan.count("from_json(") == 1 and plan.count("<think(?:ing)?>") == 1


def test_evidence_records_are_judged_once(spark):
    given = [("p", "s"), ("", "s"), ("p", " 　"), ("p", None), ("p", "某产量 "), ("p", " 市场规模"), (None, None)]
    rows = spark.createDataFrame([(i, p, s, "CAPACITY") for i, (p, s) in enumerate(given)] + [(7, "p", "s", "OTHER"), (8, "p", "s", None)],
                                 "i int, predicate string, subject_text string, fact_type string")
    good, bad = extraction.validate_evidence_records(rows)
    assert [r.i for r in good.collect()] == [0] and good.columns == rows.columns
    assert {r.i: r.reject_reason for r in bad.collect()} == {
        1: "no predicate", 2: "no subject", 3: "no subject", 4: "metric as subject", 5: "statistic as subject", 6: "no predicate", 7: "unknown type", 8: "unknown type"}
    for df in (good, bad):  # the filter reads the reason
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("RLIKE(") == 1 and plan.count("trim(") == 1


def compiled(df):
    """Whether the JVM compiles all generated methods of ``df``: those of over 8000 bytes stay interpreted."""
    text = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "codegen")
    return max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", text))) <= 8000


def test_rewriting_and_linting_are_compiled(spark):
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # adaptive plans show no code before they run
    try:
        rows = Tables(spark, "/root/testdata/sf0.001").t_fact
        assert compiled(predicates.normalize_predicates(rows).select("fact_id", "predicate", "time_expr", "qualifier_json"))
        assert compiled(quality.lint_before_after(rows).select("fact_id", "outcome"))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert "filter(" not in quality.lint(rows)._jdf.queryExecution().optimizedPlan().toString()  # no lambda beside the patterns


def test_large_groups_are_numbered_like_small_ones(spark, monkeypatch):
    rows = spark.createDataFrame([(g, f"f{i}") for g, n in ((1, 40), (2, 3), (None, 12), (3, 1)) for i in range(n)], "g int, id string")
    want = {(g, i): n for g in (1, 2, None, 3) for n, i in enumerate(sorted(
        (r.id for r in rows.collect() if r.g == g), key=lambda i: (hashlib.md5(i.encode()).hexdigest()[:3], i)), 1)}
    for limit in (100, 10, 0):
        monkeypatch.setattr(common, "LARGE", limit)
        numbered = common.number_in_group(rows, ["g"], "id")
        assert numbered.columns == ["g", "id", "rn"] and {(r.g, r.id): r.rn for r in numbered.collect()} == want


def test_completion_requests_move_facts_once(spark):
    rows = [{"fact_id": f"f{i}", "document_id": i % 2, "fact_type": "CAPACITY"} for i in range(7)]
    given = facts(spark, rows).withColumns({"evidence_text": F.lit("e"), "location_text": F.lit("here")})
    articles = spark.createDataFrame([(0, "a"), (1, "b")], "document_id long, article_text string")
    sent = extraction.completion_requests(given, articles, per_request=2)
    assert sorted((r.document_id, r.part, r.n_facts) for r in sent.collect()) == [(0, 0, 2), (0, 1, 2), (1, 0, 2), (1, 1, 1)]
    plan = sent._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange hashpartitioning(") <= 2


def _optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_review_answers_are_parsed_once(spark):
    from factloom.operators import review

    answers = spark.createDataFrame([("r", '[{"id":"a","verdict":"PASS","score":0.5}]'), ("s", '{"fact_id":"","id":""}')], "request_id string, json string")
    rows = review.verdicts(answers)
    plan = _optimized(rows)
    assert plan.count("from_json(StructField") + plan.count("JsonToStructsEvaluator(Map(), StructType") + plan.count("from_json(StructType") <= 1
    assert not [line for line in plan.splitlines() if "Filter" in line and ("from_json" in line or "JsonToStructs" in line)]
    assert [(r.fact_id, r.verdict, r.score) for r in rows.collect()] == [("a", "PASS", 0.5)]


def test_clean_qualifiers_parses_once(spark):
    rows = spark.createDataFrame([(1, '{"product":"x","product_type":"y","n":1.50}'), (2, '{"change_percentage_points":3}')], "i int, qualifier_json string")
    cleaned = quality.clean_qualifiers(rows)
    assert "jsonObjectKeys" not in _optimized(cleaned) and "json_object_keys" not in _optimized(cleaned)
    got = {r.i: json.loads(r.qualifier_json) for r in cleaned.filter(F.length("qualifier_json") > 0).collect()}
    assert got == {1: {"product_type": "y", "n": 1.5}, 2: {"change_pct": 3}}


def test_ratios_of_many_pairs_are_difflib_s():
    rng = random.Random(5)
    text = lambda letters, n: "".join(rng.choice(letters) for _ in range(rng.randint(0, n)))
    pairs = [(text(s, n), text(s, n)) for s, n in (("ab", 9), ("ab#01", 30), ("中é𝒳a", 25), ("ab", 260)) for _ in range(300)] + [("", "a"), ("x" * 199, "x" * 199)]
    a, b = (pd.Series(side) for side in zip(*[p for p in pairs if any(p)]))
    assert S.ratios(a, b).tolist() == [SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)]
    shared = [2 * (Counter(x) & Counter(y)).total() / (len(x) + len(y)) for x, y in zip(a, b)]
    assert S.shared_share.func(a, b).tolist() == shared


def test_similar_names_meet_once_without_a_shuffle_of_pairs(spark):
    names = [f"Supplier#{i:09d}" for i in range(0, 90, 3)] + ["甲乙丙丁集团", "甲乙丙丁集团有限公司", "甲乙丙"]
    pairs = simjoin.ratio_pairs(spark.createDataFrame([(n, n) for n in names], "id string, name string"), 0.82)
    got = sorted((r.a, r.b) for r in pairs.collect())
    share = lambda x, y: 2 * (Counter(x) & Counter(y)).total() / (len(x) + len(y))
    assert got == sorted((min(x, y), max(x, y)) for i, x in enumerate(names) for y in names[i + 1:] if share(x, y) >= 0.82)
    assert "Aggregate" not in pairs._jdf.queryExecution().optimizedPlan().toString()
    found = merging.merge_suggestions(spark.createDataFrame([(n, n, "企业") for n in names], "entity_id string, canonical_name string, entity_type string"), limit=None, expand=False)
    rows = [(r.primary_name, r.secondary_name) for r in found.collect()]
    assert len(rows) == len({frozenset(r) for r in rows}) and ("甲乙丙", "甲乙丙丁集团") in rows


def test_export_finds_titles_whatever_document_the_evidence_is_of(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("b", 1, None), ("c", 2, "x"), ("d", 9, "y"), ("e", None, None), ("f", 2, "gone"), ("g", None, "y"), ("h", 2, "z")], "fact_id string, document_id long, evidence_id string")
    documents = spark.createDataFrame([(1, "T1", "S1"), (2, "T2", None)], "document_id long, title string, source_name string")
    evidence = spark.createDataFrame([("x", 1, "ex"), ("y", 9, "ey"), ("z", None, "ez"), ("w", 1, "ew")], "evidence_id string, document_id long, evidence_text string")
    given = rows.join(documents.withColumnsRenamed({"title": "document_title", "source_name": "document_source"}), "document_id", "left") \
        .join(evidence.select("evidence_id", "evidence_text"), "evidence_id", "left")
    columns = ["fact_id", "document_id", "evidence_id", "document_title", "document_source", "evidence_text"]
    got = sinks.with_origin(rows, documents, evidence).select(*columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, given.select(*columns).collect()))
    assert [r.document_title for r in got.orderBy("fact_id").collect()] == ["T1", "T1", "T2", None, None, "T2", None, "T2"]
