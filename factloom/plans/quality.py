"""Data quality and clean-up."""

from pyspark.sql import functions as F

from factloom import config as C
from factloom.functions.text import once
from factloom.operators import quality as Q
from factloom.plans.registry import query
from factloom.plans.snippets import APPROVED, cost


@query("K1_confidence_stats", """
SELECT round(avg(confidence_score), 3) AS average, round(min(confidence_score), 3) AS minimum, round(max(confidence_score), 3) AS maximum,
  count(*) FILTER (WHERE confidence_score < 5e-1) AS low_count, count(*) FILTER (WHERE confidence_score >= 9e-1) AS high_count FROM t_fact""")
def k1(t):
    return Q.confidence_stats(t.t_fact)


@query("K1_confidence_buckets", """
SELECT CASE WHEN confidence_score < 3e-1 THEN '0-0.3' WHEN confidence_score < 5e-1 THEN '0.3-0.5' WHEN confidence_score < 7e-1 THEN '0.5-0.7'
  WHEN confidence_score < 9e-1 THEN '0.7-0.9' ELSE '0.9-1.0' END AS bucket, count(*) AS n FROM t_fact GROUP BY 1""")
def k1_buckets(t):
    return Q.confidence_buckets(t.t_fact)


@query("K2_quality_issues", """
SELECT count(*) FILTER (WHERE coalesce(subject_text, '') = '') AS empty_subject, count(*) FILTER (WHERE coalesce(predicate, '') = '') AS empty_predicate,
  count(*) FILTER (WHERE coalesce(object_text, '') = '' AND value_num IS NULL) AS no_value,
  count(*) FILTER (WHERE time_expr > '2000-06-01') AS future_time,
  count(*) FILTER (WHERE confidence_score IS NULL OR confidence_score < 0 OR confidence_score > 1) AS bad_confidence,
  count(*) - count(DISTINCT document_id || '|' || fact_type || '|' || predicate || '|' || subject_text) AS duplicates,
  count(*) FILTER (WHERE NOT json_valid(qualifier_json)) AS bad_json FROM t_fact""")
def k2(t):
    return Q.quality_issues(t.t_fact, "2000-06-01")


@query("K3_link_stats", """
SELECT count(*) AS total, count(subject_entity_id) AS subject_linked, round(count(subject_entity_id) * 1e2 / count(*), 1) AS subject_rate,
  count(object_entity_id) AS object_linked, round(count(object_entity_id) * 1e2 / count(*), 1) AS object_rate FROM t_fact""")
def k3(t):
    return Q.link_stats(t.t_fact)


@query("K4_duplicate_groups", """
SELECT fact_type, subject_text, predicate, object_text, count(*) AS n FROM t_fact WHERE review_status <> '已拒绝' GROUP BY 1, 2, 3, 4 HAVING count(*) > 1""")
def k4_groups(t):
    return Q.duplicate_groups(t.t_fact)


@query("K4_fill_rates", """
SELECT round(count(subject_entity_id) * 1e2 / count(*), 1) AS subject_linked, round(count(object_entity_id) * 1e2 / count(*), 1) AS object_linked,
  round(count(location_entity_id) * 1e2 / count(*), 1) AS location_linked,
  round(count(*) FILTER (WHERE coalesce(time_expr, '') = '') * 1e2 / count(*), 1) AS time_empty,
  round(count(*) FILTER (WHERE coalesce(location_text, '') = '') * 1e2 / count(*), 1) AS location_empty,
  round(count(*) FILTER (WHERE coalesce(currency, '') = '') * 1e2 / count(*), 1) AS currency_empty, count(*) AS total FROM t_fact""")
def k4_rates(t):
    return Q.fill_rates(t.t_fact)


@query("K4_unit_histogram", "SELECT unit, count(*) AS n FROM t_fact WHERE unit <> '' GROUP BY 1")
def k4_units(t):
    return Q.unit_histogram(t.t_fact)


@query("K4_value_samples", "SELECT DISTINCT time_expr AS value FROM t_fact WHERE time_expr <> '' ORDER BY 1 LIMIT 20")
def k4_samples(t):
    return Q.value_samples(t.t_fact, "time_expr")


_K5 = """u AS (SELECT count(*) AS total, count(*) FILTER (WHERE entity_type = 'UNKNOWN') AS unknown FROM t_entity),
k5 AS (SELECT *, round(unknown * 1e2 / total, 1) AS unknown_pct,
  CASE WHEN unknown > total * 2e-1 THEN 'high' WHEN unknown > total * 1e-1 THEN 'medium' ELSE 'low' END AS severity FROM u)"""


@query("K5_entity_types", f"WITH {_K5} SELECT * FROM k5")
def k5(t):
    return Q.check_entity_types(t.t_entity)


@query("K5_type_distribution", "SELECT entity_type, count(*) AS n FROM t_entity GROUP BY 1")
def k5_dist(t):
    return Q.count_by(t.t_entity, "entity_type")


# the stored unknown entities carry no facts, so brands are looked at as unknown
@query("K5_unknown_with_facts", """
SELECT entity_id, canonical_name, count(DISTINCT fact_id) AS fact_count FROM t_entity JOIN t_fact ON subject_entity_id = entity_id OR object_entity_id = entity_id
WHERE entity_type = '品牌' GROUP BY 1, 2 ORDER BY fact_count DESC, entity_id LIMIT 15""")
def k5_unknown(t):
    entities = t.t_entity.withColumn("entity_type", F.when(F.col("entity_type") == "品牌", "UNKNOWN").otherwise("企业"))
    return Q.unknown_with_facts(t.t_fact, entities)


_K6 = f"""k6 AS (SELECT count(*) AS total, 0 AS missing_subject, 0 AS missing_predicate,
    count(*) FILTER (WHERE time_expr IS NULL AND {APPROVED}) AS missing_time, count(*) FILTER (WHERE evidence_text IS NULL AND {APPROVED}) AS missing_evidence
  FROM t_fact f LEFT JOIN t_evidence e USING (evidence_id))"""


@query("K6_fact_quality", f"WITH {_K6} SELECT *, CASE WHEN missing_time > 5 OR missing_evidence > 0 THEN 'high' ELSE 'low' END AS severity FROM k6")
def k6(t):
    return Q.check_facts(t.t_fact, t.t_evidence)


_K7 = f"""k7 AS (SELECT (SELECT count(*) FROM t_fact WHERE {APPROVED}) AS approved,
  (SELECT count(*) FROM t_fact WHERE {APPROVED} AND subject_entity_id IS NULL) AS no_subject_link,
  (SELECT count(*) FROM t_fact WHERE {APPROVED} AND object_entity_id IS NULL AND object_text <> '') AS no_object_link,
  (SELECT count(*) FROM t_entity WHERE entity_id NOT IN (SELECT subject_entity_id FROM t_fact WHERE subject_entity_id IS NOT NULL
     UNION SELECT object_entity_id FROM t_fact WHERE object_entity_id IS NOT NULL)) AS orphans,
  (SELECT count(*) FROM t_entity WHERE entity_id NOT IN (SELECT entity_id FROM t_alias)) AS no_alias, (SELECT count(*) FROM t_entity) AS total_entities)"""


@query("K7_entity_links", f"WITH {_K7} SELECT *, CASE WHEN no_subject_link > 10 THEN 'high' WHEN no_subject_link + no_object_link > 0 OR orphans > total_entities * 3e-1 THEN 'medium' ELSE 'low' END AS severity FROM k7")
def k7(t):
    return Q.check_links(t.t_fact, t.t_entity, t.t_alias)


_K8 = """k8 AS (SELECT (SELECT count(*) FROM t_relation) AS relations, (SELECT count(*) FROM t_suggestion) AS suggestions,
  (SELECT count(*) FROM t_suggestion WHERE status = '待处理') AS pending_suggestions, (SELECT count(*) FROM t_merge_task WHERE status = '待处理') AS pending_merges)"""
_K6_SEVERITY = "CASE WHEN missing_time > 5 OR missing_evidence > 0 THEN 'high' ELSE 'low' END"
_K7_SEVERITY = """CASE WHEN no_subject_link > 10 THEN 'high' WHEN no_subject_link + no_object_link > 0 OR orphans > total_entities * 3e-1 THEN 'medium' ELSE 'low' END"""
_K8_SEVERITY = "CASE WHEN relations = 0 THEN 'high' WHEN pending_suggestions + pending_merges > 0 THEN 'medium' ELSE 'low' END"


@query("K8_relations", f"WITH {_K8} SELECT *, {_K8_SEVERITY} AS severity FROM k8")
def k8(t):
    return Q.check_relations(t.t_relation, t.t_suggestion, t.t_merge_task)


@query("K8_relation_types", "SELECT relation_type, count(*) AS n FROM t_relation GROUP BY 1")
def k8_types(t):
    return Q.count_by(t.t_relation, "relation_type")


@query("K9_same_name_types", """
WITH e AS (SELECT canonical_name, entity_type FROM t_entity UNION ALL SELECT canonical_name, '项目' FROM t_entity WHERE entity_type = '品牌')
SELECT canonical_name, string_agg(DISTINCT entity_type, ',' ORDER BY entity_type) AS types, count(*) AS n FROM e GROUP BY 1 HAVING count(*) > 1""")
def k9_types(t):
    again = t.t_entity.filter("entity_type = '品牌'").withColumn("entity_type", F.lit("项目"))
    return Q.same_name_types(t.t_entity.unionByName(again))


_PAIRS = """SELECT a.entity_id AS a_id, b.entity_id AS b_id, a.canonical_name AS name_a, b.canonical_name AS name_b FROM t_entity a JOIN t_entity b
  ON a.entity_id < b.entity_id AND (contains(lower(a.canonical_name), lower(b.canonical_name)) OR contains(lower(b.canonical_name), lower(a.canonical_name)))"""


@query("K9_contained_names", _PAIRS)
def k9(t):
    return Q.contained_names(t.t_entity, limit=None)


@query("K10_overall", f"""
WITH {_K5}, {_K6}, {_K7}, {_K8}, pairs AS ({_PAIRS}),
again AS (SELECT canonical_name FROM t_entity GROUP BY 1 HAVING count(*) > 1),
a AS (SELECT 'types' AS name, severity FROM k5 UNION ALL SELECT 'facts', {_K6_SEVERITY} FROM k6 UNION ALL SELECT 'links', {_K7_SEVERITY} FROM k7
  UNION ALL SELECT 'relations', {_K8_SEVERITY} FROM k8
  UNION ALL SELECT 'duplicates', CASE WHEN (SELECT count(*) FROM again) > 0 OR (SELECT count(*) FROM pairs) > 5 THEN 'medium' ELSE 'low' END),
n AS (SELECT * FROM (VALUES ('all', ['types', 'facts', 'links', 'relations', 'duplicates']), ('types', ['types']), ('names', ['relations', 'duplicates'])) v(scope, names))
SELECT scope, CASE WHEN bool_or(severity = 'high') THEN '需要关注' WHEN bool_or(severity = 'medium') THEN '基本正常' ELSE '健康' END AS overall
FROM n JOIN a ON list_contains(names, name) GROUP BY scope""")
def k10(t):
    types, duplicates = Q.check_entity_types(t.t_entity), Q.check_duplicates(t.t_entity)
    relations = Q.check_relations(t.t_relation, t.t_suggestion, t.t_merge_task)
    scoped = lambda scope, checks: Q.overall(checks).select(F.lit(scope).alias("scope"), "overall")
    return scoped("all", [
        types, Q.check_facts(t.t_fact, t.t_evidence), Q.check_links(t.t_fact, t.t_entity, t.t_alias), relations, duplicates,
    ]).unionByName(scoped("types", [types])).unionByName(scoped("names", [relations, duplicates]))


@query("K11_facts_per_evidence", "SELECT n AS fact_count, count(*) AS evidence_count FROM (SELECT count(*) AS n FROM t_fact GROUP BY evidence_id) GROUP BY 1")
def k11(t):
    return Q.facts_per_evidence(t.t_fact)


@query("K11_batching_saving", """
WITH x AS (SELECT count(*) AS a, count(DISTINCT evidence_id) AS b FROM t_fact)
SELECT a AS single_calls, b AS batched_calls, a - b AS saved, round((a - b) * 1e2 / a, 0) AS saved_pct FROM x""")
def k11_saving(t):
    return Q.batching_saving(t.t_fact)


@query("K12_stage_efficiency", f"""
SELECT task_type, count(*) AS calls, CAST(sum(input_tokens) AS BIGINT) AS total_in, CAST(sum(output_tokens) AS BIGINT) AS total_out,
  CAST(floor(avg(input_tokens)) AS BIGINT) AS avg_in, CAST(floor(avg(output_tokens)) AS BIGINT) AS avg_out,
  {cost('sum(input_tokens)', 'sum(output_tokens)')} AS cost FROM t_task WHERE status = '成功' GROUP BY 1""")
def k12(t):
    return Q.stage_efficiency(t.t_task)


@query("K12_tokens_per_fact", """
WITH x AS (SELECT CAST(sum(input_tokens + output_tokens) AS BIGINT) AS tokens, (SELECT count(*) FROM t_fact) AS facts FROM t_task WHERE status = '成功')
SELECT *, round(tokens / facts, 0) AS tokens_per_fact FROM x""")
def k12_tokens(t):
    return Q.tokens_per_fact(t.t_task, t.t_fact)


@query("K12_stage_details", "SELECT task_id, input_tokens, output_tokens FROM t_task WHERE status = '成功' AND task_type = '证据发现'")
def k12_details(t):
    return Q.stage_details(t.t_task, "证据发现").drop("started_at")


@query("K13_object_links", f"""
SELECT count(object_entity_id) AS linked, count(*) FILTER (WHERE object_entity_id IS NULL AND object_text <> '') AS text_only,
  count(*) FILTER (WHERE coalesce(object_text, '') = '') AS no_object FROM t_fact WHERE {APPROVED}""")
def k13(t):
    return Q.object_link_breakdown(t.t_fact)


@query("K13_unlinked_texts", f"""
SELECT object_text, count(*) AS n FROM t_fact WHERE {APPROVED} AND object_entity_id IS NULL AND object_text <> '' GROUP BY 1 ORDER BY n DESC, object_text LIMIT 20""")
def k13_texts(t):
    return Q.unlinked_texts(t.t_fact)


@query("K13_keyword_links", f"""
SELECT subject_text, count(*) AS n, count(subject_entity_id) AS linked FROM t_fact WHERE {APPROVED} AND contains(subject_text, '00001') GROUP BY 1""")
def k13_keyword(t):
    return Q.keyword_links(t.t_fact, "00001")


_HIT = "(contains(lower(subject_text), 'brand#1') OR contains(lower(object_text), 'brand#1') OR contains(lower(subject_text), '00007'))"


def _slice(t):
    return Q.keyword_slice(t.t_fact, ("BRAND#1", "00007"))


@query("K14_keyword_status", f"SELECT review_status, count(*) AS n, round(avg(confidence_score), 6) AS avg_score FROM t_fact WHERE {_HIT} GROUP BY 1")
def k14(t):
    return _slice(t)["status"].withColumn("avg_score", F.round("avg_score", 6))


@query("K14_keyword_types", f"SELECT fact_type, count(*) AS n FROM t_fact WHERE {_HIT} AND review_status = '自动通过' GROUP BY 1")
def k14_types(t):
    return _slice(t)["types"]


@query("K14_keyword_rejections", f"SELECT fact_id, review_note FROM t_fact WHERE {_HIT} AND review_status IN ('已拒绝', '人工拒绝')")
def k14_rejected(t):
    return _slice(t)["rejected"].select("fact_id", "review_note")


@query("K14_keyword_documents", "SELECT doc_id FROM documents WHERE contains(lower(text), 'ention') OR contains(lower(source), 'ention')")
def k14_docs(t):
    docs = t.documents.select("doc_id", F.col("text").alias("raw_text"), F.col("source").alias("title"))
    return Q.keyword_documents(docs, "ENTION").select("doc_id")


@query("K14_known_names", f"""
WITH x AS (SELECT DISTINCT subject_text AS text FROM t_fact WHERE {APPROVED} AND subject_entity_id IS NULL),
n AS (SELECT canonical_name AS name FROM t_entity UNION SELECT alias_name FROM t_alias)
SELECT text, name FROM x JOIN n ON contains(lower(text), lower(name)) OR contains(lower(name), lower(text))""")
def k14_names(t):
    return Q.known_name_matches(t.t_fact, t.t_entity, t.t_alias)


_LINT = """CASE WHEN fact_type = 'CAPACITY' THEN CASE WHEN value_num IS NOT NULL AND value_text IS NULL THEN 'still bad' ELSE 'fixed' END
  WHEN fact_type = 'COMPETITIVE_RANKING' OR (value_num IS NOT NULL AND value_text IS NULL) THEN 'still bad' ELSE 'already good' END"""


@query("K15_lint", f"SELECT fact_id, {_LINT} AS outcome FROM t_fact")
def k15(t):
    facts = t.t_fact.withColumn("predicate", F.when(F.col("fact_type") == "CAPACITY", "2024年产能达到").otherwise(F.col("predicate")))
    return Q.lint_before_after(facts).select("fact_id", "outcome")


# nested members carry the same keys and must stay as they are
@query("K16_clean_qualifiers", """
SELECT fact_id, predicate AS change_pct, CASE WHEN object_text IS NULL THEN unit ELSE object_text END AS product_type,
  'a "' || unit || '", {' AS inner_product, fact_type AS inner_growth, 4 AS n_keys FROM t_fact""")
def k16(t):
    inner = F.struct(F.concat(F.lit('a "'), "unit", F.lit('", {')).alias("product"), F.array(F.struct(F.col("fact_type").alias("growth_description"))).alias("list"))
    same = F.to_json(F.struct(
        F.col("unit").alias("product"), F.struct(inner.alias("deep")).alias("growth_description"), inner.alias("detail"),
        F.col("predicate").alias("change_percentage_points"), F.col("object_text").alias("product_type"),
        F.lit(3).alias("change_amount_unit"), F.array(F.lit("product"), F.lit("}")).alias("tags")))
    out = Q.clean_qualifiers(t.t_fact.withColumn("qualifier_json", same))
    told = F.from_json("qualifier_json", "change_pct string, product_type string, detail struct<product: string, list: array<struct<growth_description: string>>>")
    # what is told of the result is read in one pass instead of one for each value
    return out.withColumn("_told", once(told)).select(
        "fact_id", "_told.change_pct", "_told.product_type", F.col("_told.detail.product").alias("inner_product"),
        F.col("_told.detail.list")[0]["growth_description"].alias("inner_growth"), F.size(F.json_object_keys("qualifier_json")).alias("n_keys"))


@query("K17_currency", """
SELECT fact_id, CASE unit WHEN '亿' THEN '亿元' ELSE unit END AS unit, CASE unit WHEN '亿元' THEN 'CNY' WHEN '亿美元' THEN 'USD' END AS currency FROM t_fact""")
def k17(t):
    return Q.fix_units(Q.fill_currency(t.t_fact)).select("fact_id", "unit", "currency")


_OLD = {v: k for k, v in C.VOCABULARY[("fact_atom", "review_status")].items()}


def _old_facts(t):
    return t.t_fact.withColumn("review_status", F.when(
        F.col("value_num").isNotNull(), F.create_map(*[F.lit(x) for kv in _OLD.items() for x in kv])[F.col("review_status")]).otherwise(
        F.col("review_status")))


@query("QV1_migrate", "SELECT fact_id, review_status FROM t_fact")
def qv1(t):
    return Q.migrate_vocabulary(_old_facts(t), "fact_atom").select("fact_id", "review_status")


@query("QV1_counts", f"""
SELECT 'review_status' AS column_name, CASE review_status {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in _OLD.items())} END AS old_value, count(*) AS n
FROM t_fact WHERE value_num IS NOT NULL GROUP BY 2""")
def qv1_counts(t):
    return Q.vocabulary_counts(_old_facts(t), "fact_atom")
