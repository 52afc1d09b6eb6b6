"""Review requests, verdicts and decisions."""

from pyspark.sql import functions as F

from factloom import config as C
from factloom.operators import review as R
from factloom.plans.registry import query


def _numbered(by: str, size: int) -> str:
    return f"""WITH n AS (SELECT {by}, fact_id, predicate, qualifier_json, (row_number() OVER (PARTITION BY {by}
  ORDER BY substr(md5(fact_id), 1, 3), fact_id) - 1) // {size} AS batch FROM t_fact WHERE review_status = '待处理')
SELECT {by}, batch, count(*) AS n_facts, string_agg(fact_id, ',' ORDER BY fact_id) AS fact_ids, min(fact_id) AS first_id,
  arg_min(predicate, fact_id) AS first_predicate, arg_min(qualifier_json, fact_id) AS first_qualifiers FROM n GROUP BY ALL"""


def _sent(requests):
    """The requests with what their bodies say of the first fact."""
    told = lambda key, name: F.get_json_object("body", f"$.fact_records[0].{key}").alias(name)
    return requests.select("*", told("id", "first_id"), told("predicate", "first_predicate"), told("qualifiers", "first_qualifiers")).drop("body")


def _pending(t):
    return t.t_fact.filter(F.col("review_status") == C.PENDING)


@query("R1_document_batches", _numbered("document_id", 10))
def r1(t):
    return _sent(R.document_batches(_pending(t)))


@query("R2_evidence_batches", _numbered("evidence_id", 200))
def r2(t):
    return _sent(R.evidence_batches(_pending(t), t.t_evidence))


_VERDICT = "CASE review_status WHEN '已拒绝' THEN '拒绝' WHEN '不确定' THEN '不确定' ELSE '通过' END"
_RULES = C.ReviewRules(
    force_human_types=("PRICE_CHANGE",), force_human_qualifiers=("is_forecast",),
    require_qualifier_any={"CAPACITY": ("product_type", "project_name")})


def _status_sql(verdict: str, score: str, strict: bool) -> str:
    gates = """WHEN fact_type = 'PRICE_CHANGE' THEN '待人工审核'
    WHEN fact_type = 'CAPACITY' AND NOT json_valid(qualifier_json) THEN '待人工审核'""" if strict else ""
    return f"""CASE WHEN {verdict} = '拒绝' THEN '已拒绝' WHEN {verdict} = '不确定' THEN '待人工审核' {gates}
    WHEN fact_type = 'MARKET_SHARE' AND value_num IS NULL AND coalesce(value_text, '') = '' THEN '待人工审核'
    WHEN {verdict} = '通过' AND {score} >= 65e-2 THEN '自动通过' ELSE '待人工审核' END"""


@query("R3_verdict_status", f"SELECT fact_id, {_status_sql(_VERDICT, 'confidence_score', True)} AS new_status FROM t_fact")
def r3(t):
    verdict = (F.when(F.col("review_status") == C.REJECTED, "reject").when(F.col("review_status") == C.UNCERTAIN, "UNCERTAIN")
               .otherwise("Pass"))
    return t.t_fact.select("fact_id", R.verdict_status(
        R.canonical_verdict(verdict), F.col("confidence_score"), _RULES).alias("new_status"))


def _review_answers(t):
    """Answers in all accepted shapes, one per fact; some miss the fact."""
    verdict = (F.when(F.col("review_status") == C.REJECTED, "REJECT").when(F.col("review_status") == C.UNCERTAIN, "uncertain")
               .otherwise("通过"))
    item = F.to_json(F.struct(
        F.when(F.col("unit") != "亿", F.col("fact_id")).alias("fact_id"), F.col("fact_id").alias("id"),
        verdict.alias("verdict"), F.col("confidence_score").alias("score"), F.lit("checked").alias("review_note")))
    other = F.to_json(F.struct("fact_id", F.lit("REJECT").alias("verdict"), F.lit(0.1).alias("score")))
    text = (F.when(F.col("object_text").isNull(), "[]").when(F.col("fact_type") == "CAPACITY", item)
            .when(F.col("fact_type") == "EXPANSION", F.concat(F.lit("[["), item, F.lit("]]")))
            .otherwise(F.concat(F.lit("["), other, F.lit(","), item, F.lit("]"))))
    return t.t_fact.select(F.col("fact_id").alias("request_id"), text.alias("json"))


def _outcomes(t):
    asked = t.t_fact.withColumn("request_id", F.col("fact_id"))
    failed = t.t_fact.filter(F.col("location_text") == "全国船舶市场").select(
        F.col("fact_id").alias("request_id"), F.lit("timeout").alias("error"))
    return R.outcomes(asked, R.verdicts(_review_answers(t)), failed)


_OUTCOME_SQL = f"""
o AS (SELECT *, location_text = '全国船舶市场' AS failed, CASE WHEN location_text = '全国船舶市场' OR object_text IS NULL
    THEN '不确定' ELSE {_VERDICT} END AS verdict,
  CASE WHEN location_text = '全国船舶市场' OR object_text IS NULL THEN 0e0 ELSE confidence_score END AS score FROM t_fact),
r AS (SELECT fact_id, verdict, score, {_status_sql('verdict', 'score', False)} AS new_status,
  CASE WHEN failed THEN '审核调用异常: timeout，进入人工审核池' WHEN object_text IS NULL THEN '' ELSE 'checked' END AS note FROM o)"""


@query("R4_review_outcomes", f"WITH {_OUTCOME_SQL} SELECT fact_id, verdict, score, new_status, note FROM r")
def r4(t):
    return _outcomes(t)


@query("R5_apply_review", f"""WITH {_OUTCOME_SQL}
SELECT f.fact_id, coalesce(new_status, review_status) AS review_status,
  CASE WHEN r.fact_id IS NULL THEN review_note ELSE note END AS review_note,
  coalesce(score, confidence_score) AS confidence_score
FROM t_fact f LEFT JOIN (SELECT * FROM r WHERE verdict <> '不确定') r USING (fact_id)""")
def r5(t):
    updated, _ = R.apply_outcomes(t.t_fact, _outcomes(t).filter(F.col("verdict") != C.VERDICT_UNSURE))
    return updated.select("fact_id", "review_status", "review_note", "confidence_score")


@query("R5_audit", f"""WITH {_OUTCOME_SQL}
SELECT fact_id AS target_id, '待处理' AS old_status, new_status, '系统审核' AS reviewer, verdict AS review_action FROM r""")
def r5_audit(t):
    _, audit = R.apply_outcomes(t.t_fact, _outcomes(t))
    return audit.select("target_id", "old_status", "new_status", "reviewer", "review_action")


_RE = f"(confidence_score >= 65e-2 AND {_status_sql(chr(39) + '通过' + chr(39), 'confidence_score', False)} = '自动通过')"


@query("R6_re_evaluate", f"""
SELECT count(*) AS evaluated, count(*) FILTER (WHERE {_RE}) AS promoted, count(*) FILTER (WHERE NOT {_RE}) AS kept
FROM t_fact WHERE review_status = '待人工审核'""")
def r6(t):
    return R.re_evaluate(t.t_fact).agg(
        F.count("*").alias("evaluated"), F.count_if("promoted").alias("promoted"),
        F.count_if(~F.col("promoted")).alias("kept"))


@query("R6_promoted_facts", f"""
SELECT fact_id, CASE WHEN review_status = '待人工审核' AND {_RE} THEN '自动通过' ELSE review_status END AS review_status FROM t_fact""")
def r6_facts(t):
    updated, _ = R.apply_re_evaluation(t.t_fact, R.re_evaluate(t.t_fact))
    return updated.select("fact_id", "review_status")


def _decisions(t):
    waiting = t.t_fact.filter(F.col("review_status") == C.NEEDS_HUMAN)
    return waiting.select("fact_id", F.when(F.col("value_num").isNull(), C.HUMAN_REJECTED)
                          .when(F.col("object_text").isNull(), "later").otherwise(C.HUMAN_PASS).alias("action"),
                          F.lit("seen").alias("note"))


_DECIDED = """d AS (SELECT fact_id, CASE WHEN value_num IS NULL THEN '人工拒绝' WHEN object_text IS NOT NULL THEN '人工通过' END AS a
  FROM t_fact WHERE review_status = '待人工审核')"""


@query("R7_human_decisions", f"""WITH {_DECIDED}
SELECT f.fact_id, coalesce(a, review_status) AS review_status, CASE WHEN a IS NULL THEN review_note ELSE 'seen' END AS review_note
FROM t_fact f LEFT JOIN d USING (fact_id)""")
def r7(t):
    updated, _ = R.apply_decisions(t.t_fact, _decisions(t))
    return updated.select("fact_id", "review_status", "review_note")


@query("R7_audit", f"""WITH {_DECIDED}
SELECT fact_id AS target_id, '待人工审核' AS old_status, a AS new_status FROM d WHERE a IS NOT NULL""")
def r7_audit(t):
    _, audit = R.apply_decisions(t.t_fact, _decisions(t))
    return audit.select("target_id", "old_status", "new_status")


def _edits(t):
    chosen = t.t_fact.filter(F.col("review_status") == C.UNCERTAIN)
    action = F.when(F.col("value_num").isNull(), "save_and_reject").when(
        F.col("object_text").isNull(), "save_and_pass").otherwise("save_only")
    changes = F.map_from_arrays(
        F.array(F.lit("unit"), F.lit("value_num"), F.lit("location_text"), F.lit("created_at")),
        F.array(F.upper("fact_type"), F.lit("7.5"), F.lit("  "), F.lit("x")))
    return chosen.select("fact_id", action.alias("action"), F.explode(changes).alias("field", "value"))


@query("R8_human_edits", """
SELECT fact_id, CASE WHEN review_status = '不确定' THEN fact_type ELSE unit END AS unit,
  CASE WHEN review_status = '不确定' THEN 75e-1 ELSE value_num END AS value_num,
  CASE WHEN review_status = '不确定' THEN NULL ELSE location_text END AS location_text, object_text,
  CASE WHEN review_status <> '不确定' THEN review_status WHEN value_num IS NULL THEN '人工拒绝'
    WHEN object_text IS NULL THEN '人工通过' ELSE '待人工审核' END AS review_status FROM t_fact""")
def r8(t):
    updated, _ = R.apply_edits(t.t_fact, _edits(t))
    return updated.select("fact_id", "unit", "value_num", "location_text", "object_text", "review_status")


@query("R9_delete_facts", """
SELECT 'kept' AS part, fact_id FROM t_fact WHERE review_status <> '已拒绝'
UNION ALL SELECT 'DELETED', fact_id FROM t_fact WHERE review_status = '已拒绝'""")
def r9(t):
    kept, audit = R.delete_facts(t.t_fact, t.t_fact.filter(F.col("review_status") == C.REJECTED))
    return kept.select(F.lit("kept").alias("part"), "fact_id").unionByName(
        audit.select(F.col("new_status").alias("part"), F.col("target_id").alias("fact_id")))


@query("R10_run_statistics", """
SELECT document_id, count(DISTINCT evidence_id) AS evidences, count(*) AS facts,
  count(*) FILTER (WHERE review_status IN ('自动通过', '人工通过')) AS passed,
  count(*) FILTER (WHERE review_status IN ('已拒绝', '人工拒绝')) AS rejected,
  count(*) FILTER (WHERE review_status IN ('待人工审核', '不确定', '待处理')) AS uncertain,
  count(*) FILTER (WHERE review_status = '重复') AS duplicates FROM t_fact GROUP BY 1""")
def r10(t):
    return R.run_statistics(t.t_fact)
