"""Review requests, verdict mapping, and application of verdicts and decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom import config as C
from factloom.functions import keys as K
from factloom.functions.text import once
from factloom.operators.common import label, number_in_group, top_per_key

# --- fixed values: fields a reviewer may edit -----------------------------
EDITABLE = (
    "subject_text", "predicate", "object_text", "value_num", "value_text", "unit", "currency",
    "time_expr", "location_text", "qualifier_json", "review_note")
RE_EVALUATE_FROM = 0.65
RE_EVALUATED_NOTE = "[批量重评估] 符合当前自动通过标准"


def _record() -> Column:
    return F.struct(
        F.col("fact_id").alias("id"), "fact_type", F.col("subject_text").alias("subject"), "predicate",
        F.col("object_text").alias("object"), "value_num", "value_text", "unit", "currency", "time_expr",
        F.col("location_text").alias("location"), F.col("qualifier_json").alias("qualifiers"))


def _bodies(grouped: DataFrame, keys: list[str], *shared: str) -> DataFrame:
    """Gather at most a batch of records per group into one JSON body."""
    rows = grouped.groupBy(*keys).agg(
        F.count("*").alias("n_facts"),
        F.sort_array(F.collect_list(F.struct(F.col("fact_id").alias("k"), _record().alias("r")))).alias("_rows"),
        *[F.first(s).alias(s) for s in shared])
    body = F.struct(*[F.col(s) for s in shared], F.transform("_rows", lambda x: x["r"]).alias("fact_records"))
    return rows.select(*keys, "n_facts", F.array_join(F.transform("_rows", lambda x: x["k"]), ",").alias("fact_ids"),
                       F.to_json(body).alias("body"))


def document_batches(facts: DataFrame, size: int = 10) -> DataFrame:
    """Review requests of at most ``size`` facts of one document."""
    batched = number_in_group(facts, ["document_id"], "fact_id").withColumn(
        "batch", F.floor((F.col("rn") - 1) / size).cast("bigint"))
    return _bodies(batched, ["document_id", "batch"])


def evidence_batches(facts: DataFrame, evidence: DataFrame, size: int = 200) -> DataFrame:
    """Review requests that share one evidence text; an evidence with more than
    ``size`` facts is sent in several parts."""
    batched = number_in_group(facts, ["evidence_id"], "fact_id").withColumn(
        "batch", F.floor((F.col("rn") - 1) / size).cast("bigint"))
    texts = evidence.select("evidence_id", "evidence_text")
    return _bodies(batched.join(texts, "evidence_id"), ["evidence_id", "batch"], "evidence_text")


def canonical_verdict(verdict: Column) -> Column:
    """Upper-case verdict in the reviewed vocabulary; absent means unsure."""
    return label(F.upper(F.coalesce(verdict, F.lit(C.VERDICT_UNSURE))), C.VERDICT_SYNONYMS)


def verdict_status(verdict: Column, score: Column, rules: C.ReviewRules = C.ReviewRules()) -> Column:
    """Review state from verdict and score; gates are tried in order."""
    quals = K.qualifiers(F.col("qualifier_json"))
    kind = F.col("fact_type")
    out = F.when(verdict == C.VERDICT_REJECT, C.REJECTED).when(verdict == C.VERDICT_UNSURE, C.NEEDS_HUMAN)
    if rules.force_human_types:
        out = out.when(kind.isin(*rules.force_human_types), C.NEEDS_HUMAN)
    for key in rules.force_human_qualifiers:
        out = out.when(F.map_contains_key(quals, F.lit(key)), C.NEEDS_HUMAN)
    for fact_type, wanted in rules.require_qualifier_any.items():
        present = [F.coalesce(F.try_element_at(quals, F.lit(k)), F.lit("")) != "" for k in wanted]
        if present:
            out = out.when((kind == fact_type) & ~F.greatest(*present, *present), C.NEEDS_HUMAN)
    unquantified = F.col("value_num").isNull() & (F.coalesce("value_text", F.lit("")) == "")
    return (
        out.when((kind == "MARKET_SHARE") & unquantified, C.NEEDS_HUMAN)
        .when((verdict == C.VERDICT_PASS) & (score >= rules.auto_pass_confidence), C.AUTO_PASS)
        .otherwise(C.NEEDS_HUMAN)
    )


def verdicts(answers: DataFrame) -> DataFrame:
    """Verdict rows of review answers (request_id, json).

    Accepts one object, a list, or lists one level deep; the last verdict on a fact wins.
    """
    as_list = F.when(F.col("json").startswith("{"), F.array("json")).otherwise(F.from_json("json", "array<string>"))
    top = answers.select("request_id", F.posexplode_outer(as_list).alias("p1", "item"))
    nested = F.when(F.col("item").startswith("["), F.from_json("item", "array<string>")).otherwise(F.array("item"))
    flat = top.select("request_id", "p1", F.posexplode_outer(nested).alias("p2", "item")).filter(F.col("item").startswith("{"))
    parsed = F.from_json("item", "fact_id string, id string, verdict string, score double, review_note string")
    # a generated column: the filter below would otherwise be pushed under it and parse each item again
    rows = flat.withColumn("v", once(parsed)).select(
        "request_id", "p1", "p2",
        F.coalesce(F.nullif("v.fact_id", F.lit("")), F.nullif("v.id", F.lit(""))).alias("fact_id"),
        "v.verdict", "v.score", "v.review_note").filter(F.col("fact_id").isNotNull())
    return top_per_key(rows, ["fact_id"], [F.desc("request_id"), F.desc("p1"), F.desc("p2")]).drop("p1", "p2")


def outcomes(asked: DataFrame, verdict_rows: DataFrame, failed: DataFrame,
             rules: C.ReviewRules = C.ReviewRules()) -> DataFrame:
    """One outcome per asked fact (facts with request_id).

    Facts the answer misses are unsure with score 0; facts of failed calls go to a human.
    """
    v = verdict_rows.select("fact_id", "verdict", "score", F.col("review_note").alias("_note"))
    f = failed.select("request_id", F.col("error").alias("_error"))
    joined = asked.join(v, "fact_id", "left").join(f, "request_id", "left")
    verdict = canonical_verdict(F.when(F.col("_error").isNull(), F.col("verdict")))
    score = F.when(F.col("_error").isNull(), F.coalesce("score", F.lit(0.0))).otherwise(0.0)
    staged = joined.withColumns({"_verdict": verdict, "_score": score})
    status = F.when(F.col("_error").isNotNull(), C.NEEDS_HUMAN).otherwise(
        verdict_status(F.col("_verdict"), F.col("_score"), rules))
    note = F.when(F.col("_error").isNotNull(), F.concat(F.lit("审核调用异常: "), "_error", F.lit("，进入人工审核池"))) \
        .otherwise(F.coalesce("_note", F.lit("")))
    return staged.select("fact_id", F.col("_verdict").alias("verdict"), F.col("_score").alias("score"),
                         status.alias("new_status"), note.alias("note"))


def apply_outcomes(facts: DataFrame, outcome: DataFrame, reviewer: str = "系统审核",
                   as_of: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(fact snapshot, audit rows). The score replaces the confidence."""
    o = outcome.select("fact_id", "new_status", F.col("note").alias("_note"), "score", "verdict", F.lit(True).alias("_hit"))
    updated = facts.join(o, "fact_id", "left").withColumns({
        "review_status": F.coalesce("new_status", "review_status"),
        "review_note": F.when(F.col("_hit"), F.col("_note")).otherwise(F.col("review_note")),
        "confidence_score": F.coalesce("score", "confidence_score")}).select(*facts.columns)
    audit = audit_rows(outcome, F.lit(C.PENDING), reviewer, F.col("verdict"), as_of)
    return updated, audit


def audit_rows(changes: DataFrame, old: Column, reviewer: str, action: Column, as_of: Column | None = None) -> DataFrame:
    """Append-only review log rows for changes (fact_id, new_status, note)."""
    stamp = as_of if as_of is not None else F.lit(None).cast("timestamp")
    return changes.select(
        F.sha2(F.concat_ws("|", F.lit(reviewer), "fact_id", "new_status", stamp.cast("string")), 256).alias("log_id"),
        F.lit("fact_atom").alias("target_type"), F.col("fact_id").alias("target_id"), old.alias("old_status"),
        "new_status", F.lit(reviewer).alias("reviewer"), action.alias("review_action"),
        F.col("note").alias("review_note"), stamp.alias("created_at"))


def re_evaluate(facts: DataFrame, rules: C.ReviewRules = C.ReviewRules()) -> DataFrame:
    """Facts waiting for a human with the state today's rules would give them."""
    waiting = facts.filter(F.col("review_status") == C.NEEDS_HUMAN)
    score = F.coalesce("confidence_score", F.lit(0.0))
    again = verdict_status(F.lit(C.VERDICT_PASS), score, rules)
    promoted = (score >= RE_EVALUATE_FROM) & (again == C.AUTO_PASS)
    return waiting.withColumn("promoted", promoted)


def apply_re_evaluation(facts: DataFrame, judged: DataFrame) -> tuple[DataFrame, DataFrame]:
    changes = judged.filter("promoted").select(
        "fact_id", F.lit(C.AUTO_PASS).alias("new_status"), F.lit(RE_EVALUATED_NOTE).alias("note"))
    updated = facts.join(changes, "fact_id", "left").withColumns({
        "review_status": F.coalesce("new_status", "review_status"),
        "review_note": F.coalesce("note", "review_note")}).select(*facts.columns)
    return updated, audit_rows(changes, F.lit(C.NEEDS_HUMAN), "批量重评估", F.lit(C.VERDICT_PASS))


def apply_decisions(facts: DataFrame, decisions: DataFrame, reviewer: str = "人工") -> tuple[DataFrame, DataFrame]:
    """Human pass/reject decisions (fact_id, action, note): (snapshot, audit with old state).

    Actions are the resulting states; any other action is ignored.
    """
    d = decisions.filter(F.col("action").isin(C.HUMAN_PASS, C.HUMAN_REJECTED)).select(
        "fact_id", F.col("action").alias("new_status"), F.col("note").alias("_note"))
    joined = facts.join(d, "fact_id", "left")
    hit = F.col("new_status").isNotNull()
    updated = joined.withColumns({
        "review_status": F.coalesce("new_status", "review_status"),
        "review_note": F.when(hit, F.col("_note")).otherwise(F.col("review_note")),
    }).select(*facts.columns)
    audit = audit_rows(joined.filter(hit).withColumn("note", F.col("_note")), F.col("review_status"), reviewer,
                       F.col("new_status"))
    return updated, audit


EDIT_ACTIONS = {"save_and_pass": C.HUMAN_PASS, "save_and_reject": C.HUMAN_REJECTED, "save_only": C.NEEDS_HUMAN}


def apply_edits(facts: DataFrame, edits: DataFrame, reviewer: str = "人工") -> tuple[DataFrame, DataFrame]:
    """Field edits (fact_id, field, value, action), one row per field: (snapshot, audit).

    A blank value clears the field; the action of the edit sets the state.
    """
    known = edits.filter(F.col("field").isin(*EDITABLE))
    cleared = F.when(K.strip(F.col("value")) != "", F.col("value"))
    # each field is pivoted by a conditional max: one map-side combine, no lists
    wide = known.groupBy("fact_id").agg(
        F.max("action").alias("_action"),
        *[F.max(F.when(F.col("field") == f, cleared)).alias(f"_v_{f}") for f in EDITABLE],
        *[F.coalesce(F.bool_or(F.col("field") == f), F.lit(False)).alias(f"_e_{f}") for f in EDITABLE])
    joined = facts.join(wide, "fact_id", "left")
    edited = F.col("_action").isNotNull()
    status = F.when(edited, label(F.col("_action"), EDIT_ACTIONS, F.lit(C.NEEDS_HUMAN))).otherwise(F.col("review_status"))

    def value(name: str) -> Column:
        kind = facts.schema[name].dataType
        return F.when(F.col(f"_e_{name}"), F.col(f"_v_{name}").try_cast(kind)).otherwise(F.col(name)).alias(name)

    updated = joined.select(*[
        status.alias(c) if c == "review_status" else value(c) if c in EDITABLE else F.col(c) for c in facts.columns])
    changes = joined.filter(edited).withColumns({
        "new_status": status, "note": F.coalesce("_v_review_note", F.lit(""))})
    return updated, audit_rows(changes, F.col("review_status"), reviewer, F.lit("人工编辑"))


def delete_facts(facts: DataFrame, deletions: DataFrame, reviewer: str = "人工") -> tuple[DataFrame, DataFrame]:
    """(facts kept, audit rows of the deleted ones)."""
    ids = deletions.select("fact_id").distinct()
    gone = facts.join(ids, "fact_id", "left_semi").withColumns({"new_status": F.lit("DELETED"), "note": F.lit("")})
    return facts.join(ids, "fact_id", "left_anti"), audit_rows(gone, F.lit("DELETED"), reviewer, F.lit("delete"))


def run_statistics(facts: DataFrame) -> DataFrame:
    """Per document: evidences, facts, passed, rejected, uncertain, duplicates."""
    state = F.col("review_status")
    return facts.groupBy("document_id").agg(
        F.countDistinct("evidence_id").alias("evidences"), F.count("*").alias("facts"),
        F.count_if(state.isin(*C.APPROVED)).alias("passed"),
        F.count_if(state.isin(C.REJECTED, C.HUMAN_REJECTED)).alias("rejected"),
        F.count_if(state.isin(C.NEEDS_HUMAN, C.UNCERTAIN, C.PENDING)).alias("uncertain"),
        F.count_if(state == C.DUPLICATE).alias("duplicates"))
