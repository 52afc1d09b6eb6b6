"""Fact queries and reports."""

from pyspark.sql import functions as F

from factloom import config as C
from factloom.operators import reports as R
from factloom.plans.registry import query
from factloom.plans.snippets import APPROVED, cost, qual

_ROLES = f"""ap AS (SELECT * FROM t_fact WHERE {APPROVED}),
ru AS (SELECT subject_entity_id AS entity_id, * FROM ap WHERE subject_entity_id IS NOT NULL
  UNION ALL SELECT object_entity_id, * FROM ap WHERE object_entity_id IS NOT NULL AND object_entity_id IS DISTINCT FROM subject_entity_id)"""


@query("Q1_query_facts", """
SELECT f.fact_id, f.subject_text, d.title AS document_title, e.evidence_text FROM t_fact f
LEFT JOIN t_doc d USING (document_id) LEFT JOIN t_evidence e USING (evidence_id)
WHERE lower(subject_text) LIKE '%supplier_0000%1%' AND f.fact_type = 'CAPACITY' AND time_expr >= '1996' AND time_expr <= '2001年'
ORDER BY f.created_at DESC, f.fact_id LIMIT 100 OFFSET 20""")
def q1(t):
    out = R.query_facts(t.t_fact, t.t_doc, t.t_evidence, subject="SUPPLIER_0000%1", fact_type="CAPACITY", time_from="1996",
                        time_to="2001年", limit=100, offset=20)
    return out.select("fact_id", "subject_text", "document_title", "evidence_text")


@query("Q1_all_facts", """
SELECT f.fact_id, d.title AS document_title, d.url AS document_url, d.source_type AS document_source_type, e.evidence_text FROM t_fact f
LEFT JOIN t_doc d USING (document_id) LEFT JOIN t_evidence e USING (evidence_id) WHERE review_status = '自动通过'""")
def q1_all(t):
    out = R.query_facts(t.t_fact, t.t_doc, t.t_evidence, review_status=C.AUTO_PASS, limit=None)
    return out.select("fact_id", "document_title", "document_url", "document_source_type", "evidence_text")


@query("Q2_fact_details", """
SELECT f.fact_id, d.title AS document_title, d.source_name AS document_source, e.evidence_text, c.chunk_text FROM t_fact f
LEFT JOIN t_doc d USING (document_id) LEFT JOIN t_evidence e USING (evidence_id) LEFT JOIN t_chunk c ON c.chunk_id = e.chunk_id""")
def q2(t):
    return R.fact_details(t.t_fact, t.t_doc, t.t_evidence, t.t_chunk).select(
        "fact_id", "document_title", "document_source", "evidence_text", "chunk_text")


_DOCS = f"""ch AS (SELECT document_id, count(*) AS n FROM t_chunk GROUP BY 1), ev AS (SELECT document_id, count(*) AS n FROM t_evidence GROUP BY 1),
fc AS (SELECT document_id, count(*) AS n FROM t_fact GROUP BY 1),
tk AS (SELECT document_id, sum(input_tokens) AS i, sum(output_tokens) AS o, count(*) AS total_tasks,
  count(*) FILTER (WHERE status = '成功') AS ok_tasks, count(*) FILTER (WHERE status = '失败') AS fail_tasks,
  count(*) FILTER (WHERE status = '运行中') AS run_tasks FROM t_task GROUP BY 1),
dl AS (SELECT d.document_id, d.status, d.crawl_time, coalesce(ch.n, 0) AS chunk_count, coalesce(ev.n, 0) AS evidence_count, coalesce(fc.n, 0) AS fact_count,
  coalesce(CAST(i AS BIGINT), 0) AS input_tokens, coalesce(CAST(o AS BIGINT), 0) AS output_tokens, coalesce(total_tasks, 0) AS total_tasks,
  coalesce(ok_tasks, 0) AS ok_tasks, coalesce(fail_tasks, 0) AS fail_tasks, coalesce(run_tasks, 0) AS run_tasks,
  {cost('coalesce(CAST(i AS BIGINT), 0)', 'coalesce(CAST(o AS BIGINT), 0)')} AS cost
  FROM t_doc d LEFT JOIN ch USING (document_id) LEFT JOIN ev USING (document_id) LEFT JOIN fc USING (document_id) LEFT JOIN tk USING (document_id))"""


def _listed(t):
    return R.document_list(t.t_doc, t.t_chunk, t.t_evidence, t.t_fact, t.t_task)


@query("Q3_document_list", f"WITH {_DOCS} SELECT * EXCLUDE (crawl_time) FROM dl")
def q3(t):
    return _listed(t).select(
        "document_id", "status", "chunk_count", "evidence_count", "fact_count", "input_tokens", "output_tokens", "total_tasks",
        "ok_tasks", "fail_tasks", "run_tasks", "cost")


@query("Q3_failed_task_errors", "SELECT document_id, task_id, task_type, coalesce(error_message, '') AS error FROM t_task WHERE status = '失败'")
def q3_errors(t):
    return R.failed_task_errors(t.t_task)


@query("Q3_review_distribution", "SELECT document_id, review_status, count(*) AS n FROM t_fact GROUP BY 1, 2")
def q3_reviews(t):
    return R.count_by(t.t_fact, "document_id", "review_status")


@query("Q4_document_order", f"""WITH {_DOCS}
SELECT document_id, CASE WHEN status = '失败' THEN 0 WHEN status = '处理中' THEN 1 ELSE 2 END AS rank FROM
  dl""")
def q4(t):
    return R.document_order(_listed(t)).select("document_id", "rank")


@query("Q4_document_summary", f"""WITH {_DOCS}
SELECT count(*) AS total, count(*) FILTER (WHERE status = '已完成') AS processed, count(*) FILTER (WHERE status = '失败') AS failed,
  count(*) FILTER (WHERE status = '处理中') AS processing, CAST(sum(fact_count) AS BIGINT) AS total_facts,
  CAST(sum(evidence_count) AS BIGINT) AS total_evidences, round(sum(cost), 4) AS total_cost, CAST(sum(fail_tasks) AS BIGINT) AS tasks_failed FROM dl""")
def q4_summary(t):
    return R.document_summary(_listed(t))


@query("Q5_chunk_counts", """
SELECT c.chunk_id, count(e.evidence_id) AS evidence_count FROM t_chunk c LEFT JOIN t_evidence e ON e.chunk_id = c.chunk_id GROUP BY 1""")
def q5_chunks(t):
    return R.chunk_counts(t.t_chunk, t.t_evidence).select("chunk_id", "evidence_count")


@query("Q5_evidence_counts", """
SELECT e.evidence_id, c.chunk_index, count(f.fact_id) AS fact_count FROM t_evidence e LEFT JOIN t_chunk c ON c.chunk_id = e.chunk_id
LEFT JOIN t_fact f ON f.evidence_id = e.evidence_id GROUP BY 1, 2""")
def q5_evidence(t):
    return R.evidence_counts(t.t_evidence, t.t_chunk, t.t_fact).select("evidence_id", "chunk_index", "fact_count")


@query("Q5_task_log", "SELECT document_id, task_id, task_type, status, input_tokens FROM t_task")
def q5_tasks(t):
    return t.t_task.orderBy("document_id", "started_at").select("document_id", "task_id", "task_type", "status", "input_tokens")


@query("Q6_approved_stats", f"""
SELECT fact_type, count(*) AS total, count(*) FILTER (WHERE review_status = '自动通过') AS auto_pass,
  count(*) FILTER (WHERE review_status = '人工通过') AS human_pass FROM t_fact WHERE {APPROVED} GROUP BY 1""")
def q6(t):
    return R.approved_stats(t.t_fact)


@query("Q7_document_stats", f"WITH {_DOCS} SELECT document_id, chunk_count, evidence_count, fact_count, input_tokens, output_tokens FROM dl")
def q7(t):
    return _listed(t).select("document_id", "chunk_count", "evidence_count", "fact_count", "input_tokens", "output_tokens")


@query("Q8_task_cost", """
SELECT task_id, round(floor(input_tokens * 25e-2) / 1e6 * 2e-1 + (input_tokens - floor(input_tokens * 25e-2)) / 1e6 * 2e0
  + output_tokens / 1e6 * 3e0, 4) AS cost FROM t_task""")
def q8(t):
    return t.t_task.select("task_id", R.cost(F.col("input_tokens"), F.col("output_tokens"), 0.25).alias("cost"))


_COSTS = f"""dc AS (SELECT document_id, task_type, coalesce(model_name, 'deepseek-chat') AS model_name, count(*) AS calls,
  CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
  {cost('sum(input_tokens)', 'sum(output_tokens)')} AS cost FROM t_task GROUP BY 1, 2, 3)"""


@query("Q9_document_costs", f"WITH {_COSTS} SELECT * FROM dc")
def q9(t):
    return R.document_costs(t.t_task)


@query("Q9_cost_totals", f"WITH {_COSTS} SELECT document_id, round(sum(cost), 4) AS total_cost FROM dc GROUP BY 1")
def q9_totals(t):
    return R.document_cost_totals(t.t_task)


_TYPE_COST = f"""tc AS (SELECT task_type, count(*) AS calls, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
  {cost('sum(input_tokens)', 'sum(output_tokens)')} AS cost FROM t_task GROUP BY 1)"""


@query("Q10_global_stats", f"""WITH {_TYPE_COST}
SELECT (SELECT count(*) FROM t_doc) AS document_count, (SELECT count(*) FROM t_fact) AS fact_count, round(sum(cost), 4) AS total_cost,
  round(round(sum(cost), 4) / (SELECT count(*) FROM t_doc), 4) AS cost_per_document FROM tc""")
def q10(t):
    return R.global_stats(t.t_doc, t.t_fact, t.t_task)


@query("Q10_token_usage", f"WITH {_TYPE_COST} SELECT *, 2e0 AS input_price, 3e0 AS output_price FROM tc")
def q10_tokens(t):
    return R.task_type_costs(t.t_task)


@query("Q10_distributions", """
SELECT 'type' AS kind, fact_type AS name, count(*) AS n FROM t_fact GROUP BY 2 UNION ALL SELECT 'status', review_status, count(*) FROM t_fact GROUP BY 2""")
def q10_dist(t):
    rows = t.t_fact.select(F.explode(F.array(
        F.struct(F.lit("type").alias("kind"), F.col("fact_type").alias("name")),
        F.struct(F.lit("status").alias("kind"), F.col("review_status").alias("name")))).alias("x")).select("x.*")
    return R.count_by(rows, "kind", "name")


@query("Q10_facts_per_document", "SELECT d.document_id, count(f.fact_id) AS fact_count FROM t_doc d LEFT JOIN t_fact f USING (document_id) GROUP BY 1")
def q10_docs(t):
    return _listed(t).select("document_id", "fact_count")


_GRAPH = f"""p AS (SELECT *, coalesce(subject_entity_id, 'text::' || subject_text) AS s,
  coalesce(object_entity_id, 'text::' || object_text) AS o FROM t_fact WHERE {APPROVED}),
ed AS (SELECT fact_id AS edge_id, s AS source, o AS target, fact_type, predicate FROM p WHERE o IS NOT NULL
  UNION ALL SELECT 'rel::' || relation_id, from_entity_id, to_entity_id, 'ENTITY_RELATION',
    CASE relation_type WHEN 'SUBSIDIARY' THEN '子公司' ELSE '合作方' END FROM t_relation),
no AS (SELECT id AS node_id, sum(c) AS fact_count FROM (SELECT s AS id, 1 AS c FROM p UNION ALL SELECT o, 0 FROM p WHERE o IS NOT NULL
  UNION ALL SELECT from_entity_id, 0 FROM t_relation UNION ALL SELECT to_entity_id, 0 FROM t_relation) GROUP BY 1)"""


def _graph(t):
    return R.graph(t.t_fact, t.t_entity, t.t_relation)


@query("Q11_graph_edges", f"WITH {_GRAPH} SELECT * FROM ed")
def q11_edges(t):
    return _graph(t)["edges"].drop("confidence_score")


@query("Q11_graph_nodes", f"""WITH {_GRAPH}
SELECT node_id, coalesce(canonical_name, substr(node_id, 7)) AS name, coalesce(entity_type, 'UNKNOWN') AS entity_type,
  CAST(fact_count AS BIGINT) AS fact_count, starts_with(node_id, 'text::') AS is_text_node FROM no LEFT JOIN t_entity ON entity_id = node_id""")
def q11_nodes(t):
    return _graph(t)["nodes"]


@query("Q11_graph_stats", f"""WITH {_GRAPH}
SELECT a AS total_passed_facts, (SELECT count(*) FROM no) AS entity_count, b AS relational_facts, a - b AS metric_facts,
  a - (SELECT count(*) FROM p WHERE o IS NOT NULL) AS metric_facts_corrected
FROM (SELECT (SELECT count(*) FROM t_fact WHERE {APPROVED}) AS a, (SELECT count(*) FROM ed) AS b)""")
def q11_stats(t):
    return _graph(t)["stats"]


@query("Q12_entity_list", f"""WITH {_ROLES}
SELECT entity_id, canonical_name AS name, entity_type, count(*) AS fact_count FROM t_entity JOIN ru USING (entity_id)
WHERE lower(canonical_name) LIKE '%r%' GROUP BY ALL ORDER BY fact_count DESC, entity_id LIMIT 200""")
def q12(t):
    return R.entity_list(t.t_fact, t.t_entity, search="R")


@query("Q13_entity_details", f"""WITH {_ROLES},
s AS (SELECT entity_id, count(*) AS n, count(DISTINCT document_id) AS d, min(time_expr) AS a, max(time_expr) AS b FROM ru GROUP BY 1)
SELECT entity_id, canonical_name, coalesce(n, 0) AS total_fact_count, coalesce(d, 0) AS source_doc_count, a AS time_earliest, b AS time_latest
FROM t_entity LEFT JOIN s USING (entity_id)""")
def q13(t):
    return R.entity_details(t.t_fact, t.t_entity).select(
        "entity_id", "canonical_name", "total_fact_count", "source_doc_count", "time_earliest", "time_latest")


@query("Q13_entity_types", f"WITH {_ROLES} SELECT entity_id, fact_type, count(*) AS n FROM ru GROUP BY 1, 2")
def q13_types(t):
    return R.entity_type_stats(t.t_fact)


@query("Q13_top_documents", f"""WITH {_ROLES}, c AS (SELECT entity_id, document_id, count(*) AS fact_count FROM ru GROUP BY 1, 2)
SELECT entity_id, document_id, title, fact_count FROM c JOIN t_doc USING (document_id)
QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY fact_count DESC, document_id) <= 10""")
def q13_docs(t):
    return R.entity_top_documents(t.t_fact, t.t_doc).select("entity_id", "document_id", "title", "fact_count")




# relations of suppliers are moved to every third supplier, so that the others have none
_MOVED = "CASE WHEN {0} LIKE 'S%' THEN 'S' || CAST(CAST(substr({0}, 2) AS INT) - CAST(substr({0}, 2) AS INT) % 3 AS STRING) ELSE {0} END"
_FROM, _TO = _MOVED.format("from_entity_id"), _MOVED.format("to_entity_id")
_DERIVED = f"""used AS (SELECT {_FROM} AS e FROM t_relation UNION SELECT {_TO} FROM t_relation),
l AS (SELECT * FROM t_fact WHERE {APPROVED} AND subject_entity_id <> object_entity_id),
r AS (SELECT subject_entity_id AS entity_id, object_entity_id AS target_id, 'from' AS direction, fact_type, fact_id, predicate, qualifier_json FROM l
  UNION ALL SELECT object_entity_id, subject_entity_id, 'to', fact_type, fact_id, predicate, qualifier_json FROM l),
k AS (SELECT r.*, canonical_name AS target_name FROM r JOIN t_entity e ON e.entity_id = target_id
  WHERE r.entity_id NOT IN (SELECT e FROM used) AND entity_type = '企业')"""
_GROUP = "entity_id, direction, fact_type, target_id"


def _moved_relations(t):
    return t.t_relation.withColumns({"from_entity_id": F.expr(_FROM), "to_entity_id": F.expr(_TO)})


@query("Q14_derived_relations", f"""
WITH {_DERIVED},
b AS (SELECT {_GROUP}, any_value(target_name) AS target_name, count(*) AS fact_count, bool_or(predicate = '战略合作') AS coop FROM k GROUP BY {_GROUP}),
n AS (SELECT {_GROUP}, {qual('project_name')} AS v, min(fact_id) AS f FROM k WHERE {qual('project_name')} <> '' GROUP BY ALL),
m AS (SELECT {_GROUP}, string_agg(v, '、' ORDER BY f) AS notes FROM n GROUP BY {_GROUP})
SELECT {_GROUP}, target_name, fact_count,
  CASE WHEN coop THEN '战略合作' || coalesce('（' || notes || '）', '') ELSE CASE fact_type WHEN 'COOPERATION' THEN '合作'
    WHEN 'INVESTMENT' THEN '投资' WHEN 'EXPANSION' THEN '扩建' ELSE fact_type END END AS relation_type
FROM b LEFT JOIN m USING ({_GROUP})""")
def q14(t):
    return R.derived_relations(t.t_fact, t.t_entity, _moved_relations(t)).drop("target_type")


@query("Q14_derived_relation_facts", f"WITH {_DERIVED} SELECT {_GROUP}, fact_id FROM k")
def q14_facts(t):
    return R.derived_relation_facts(t.t_fact, t.t_entity, _moved_relations(t))


@query("Q15_timelines", f"""WITH {_ROLES},
n AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY coalesce(time_expr, '') = '', time_expr DESC, fact_id) AS pos FROM ru),
k AS (SELECT *, CASE WHEN fact_type IN ('FINANCIAL_METRIC', 'SALES_VOLUME') THEN coalesce(nullif({qual('metric_name')}, ''), predicate)
    WHEN fact_type = 'COMPETITIVE_RANKING' THEN coalesce(nullif(value_text, ''), CAST(nullif(value_num, 0) AS VARCHAR), '')
    WHEN fact_type IN ('INVESTMENT', 'EXPANSION', 'COOPERATION') THEN coalesce(object_text, '') ELSE predicate END AS k1,
  CASE WHEN fact_type = 'COMPETITIVE_RANKING' THEN '' ELSE coalesce(value_text, '') END AS k2, coalesce(time_expr, '') AS k3 FROM n)
SELECT entity_id, min(pos) OVER w AS pos, fact_type, fact_id, subject_text, predicate, object_text, value_num, time_expr, confidence_score FROM k
WINDOW w AS (PARTITION BY entity_id, fact_type, subject_text, k1, k2, k3)
QUALIFY row_number() OVER (PARTITION BY entity_id, fact_type, subject_text, k1, k2, k3 ORDER BY confidence_score DESC, pos) = 1""")
def q15(t):
    return R.timelines(t.t_fact)


@query("Q15_timeline_types", f"WITH {_ROLES} SELECT DISTINCT entity_id, fact_type FROM ru")
def q15_types(t):
    return R.entity_type_stats(t.t_fact).select("entity_id", "fact_type")


@query("Q16_overview", f"""
SELECT count(DISTINCT subject_entity_id) AS entity_count, count(subject_entity_id) AS linked_fact_count, count(*) AS total_passed FROM t_fact WHERE {APPROVED}""")
def q16(t):
    return R.entity_overview(t.t_fact)


@query("Q16_overview_types", f"""
SELECT entity_type, count(*) AS n FROM t_entity WHERE entity_id IN (SELECT subject_entity_id FROM t_fact WHERE {APPROVED}) GROUP BY 1""")
def q16_types(t):
    return R.overview_types(t.t_fact, t.t_entity)


@query("Q17_hierarchy", f"""
WITH c AS (SELECT subject_entity_id AS entity_id, count(*) AS n FROM t_fact WHERE {APPROVED} GROUP BY 1),
i AS (SELECT e.entity_id, canonical_name, coalesce(n, 0) AS n FROM t_entity e LEFT JOIN c ON c.entity_id = e.entity_id)
SELECT from_entity_id AS root_id, a.canonical_name AS root_name, a.n AS root_fact_count, to_entity_id AS child_id, b.canonical_name AS child_name,
  relation_type, b.n AS child_fact_count FROM t_relation JOIN i a ON a.entity_id = from_entity_id JOIN i b ON b.entity_id = to_entity_id
WHERE from_entity_id NOT IN (SELECT to_entity_id FROM t_relation)""")
def q17(t):
    return R.hierarchy(t.t_relation, t.t_entity, t.t_fact)


@query("Q18_approved_page", f"SELECT fact_id FROM t_fact WHERE {APPROVED} ORDER BY created_at DESC, fact_id LIMIT 30 OFFSET 60")
def q18(t):
    return R.approved_page(t.t_fact, 3).select("fact_id")


@query("Q19_review_queue", "SELECT fact_id FROM t_fact WHERE review_status = '待人工审核' ORDER BY created_at DESC, fact_id LIMIT 21 OFFSET 20")
def q19(t):
    return R.review_queue(t.t_fact, 2).select("fact_id")


@query("Q20_summaries", f"""
SELECT fact_id, concat_ws(' ', predicate, '→ ' || object_text, coalesce(value_text, CAST(value_num AS VARCHAR) || ' ' || unit)) AS summary,
  coalesce(CASE fact_type WHEN 'EXPANSION' THEN {qual('project_name')} WHEN 'INVESTMENT' THEN {qual('project_name')}
    WHEN 'FINANCIAL_METRIC' THEN {qual('metric_name')} END, '') AS context_tag FROM t_fact""")
def q20(t):
    return R.fact_summaries(t.t_fact).select("fact_id", "summary", "context_tag")


@query("Q21_knowledge_base", f"""
WITH f AS (SELECT * FROM t_fact WHERE {APPROVED}), n AS (SELECT entity_id, canonical_name AS s FROM t_entity UNION SELECT entity_id, alias_name FROM t_alias),
x AS (SELECT entity_id, count(*) AS c FROM n JOIN f ON subject_text = s AND subject_entity_id IS NULL GROUP BY 1),
l AS (SELECT subject_entity_id AS entity_id, count(*) AS c FROM f GROUP BY 1)
SELECT e.entity_id, canonical_name, entity_type, coalesce(l.c, 0) AS linked_fact_count, coalesce(x.c, 0) AS text_fact_count
FROM t_entity e LEFT JOIN l ON l.entity_id = e.entity_id LEFT JOIN x ON x.entity_id = e.entity_id""")
def q21(t):
    return R.knowledge_base(t.t_fact, t.t_entity, t.t_alias)


@query("Q22_entity_cards", f"""
SELECT entity_id, canonical_name, entity_type, (SELECT count(*) FROM t_fact WHERE subject_entity_id = e.entity_id AND {APPROVED}) AS fact_count
FROM t_entity e WHERE entity_id IN (SELECT primary_id FROM t_merge_task)""")
def q22(t):
    return R.entity_cards(t.t_fact, t.t_entity, t.t_merge_task.select(F.col("primary_id").alias("entity_id")))


@query("Q23_search_entities", f"""WITH {_ROLES}
SELECT entity_id, canonical_name, entity_type, (SELECT count(*) FROM ru WHERE ru.entity_id = e.entity_id) AS fact_count FROM t_entity e
WHERE contains(canonical_name, '01') OR entity_id IN (SELECT entity_id FROM t_alias WHERE contains(alias_name, '01'))
ORDER BY fact_count DESC, entity_id LIMIT 20""")
def q23(t):
    return R.search_entities("01", t.t_fact, t.t_entity, t.t_alias)


@query("Q24_facts_of_entity", f"""
SELECT fact_id, predicate, time_expr FROM t_fact WHERE {APPROVED} AND (subject_entity_id = 'S6' OR object_entity_id = 'S6')
ORDER BY time_expr DESC NULLS LAST, created_at DESC, fact_id LIMIT 30""")
def q24(t):
    return R.facts_of_entity(t.t_fact, "S6").select("fact_id", "predicate", "time_expr")


@query("Q24_keyword_facts", f"""
SELECT fact_id, predicate, time_expr FROM t_fact WHERE {APPROVED} AND (contains(lower(subject_text), 'brand#1') OR contains(lower(object_text), 'brand#1')
  OR contains(lower(predicate), 'brand#1')) ORDER BY time_expr DESC NULLS LAST, created_at DESC, fact_id LIMIT 30""")
def q24_keyword(t):
    return R.keyword_facts(t.t_fact, "BRAND#1").select("fact_id", "predicate", "time_expr")


@query("Q25_relations_of_entity", """
SELECT relation_id, a.canonical_name AS from_name, b.canonical_name AS to_name FROM t_relation JOIN t_entity a ON a.entity_id = from_entity_id
JOIN t_entity b ON b.entity_id = to_entity_id WHERE from_entity_id = 'N3' OR to_entity_id = 'N3'""")
def q25(t):
    from factloom.operators.relations import relations_of
    return relations_of(t.t_relation, t.t_entity, t.t_entity.filter("entity_id = 'N3'")).select("relation_id", "from_name", "to_name")


@query("Q25_top_entities", f"""WITH {_ROLES}, c AS (SELECT entity_id, count(*) AS n FROM ru GROUP BY 1)
SELECT entity_id, canonical_name, entity_type, coalesce(n, 0) AS fact_count FROM t_entity LEFT JOIN c USING (entity_id)
ORDER BY fact_count DESC, entity_id LIMIT 10""")
def q25_top(t):
    return R.kb_top_entities(t.t_fact, t.t_entity)


_BOARD = "CASE status WHEN '失败' THEN 0 WHEN '处理中' THEN 1 ELSE 6 END"


@query("Q26_processing_board", f"""
SELECT document_id, status, coalesce(error_message, '') AS error_message, (SELECT count(*) FROM t_fact f WHERE f.document_id = d.document_id) AS facts_count
FROM t_doc d WHERE status IN ('失败', '处理中', '已完成') ORDER BY {_BOARD}, crawl_time DESC, document_id LIMIT 20""")
def q26(t):
    return R.processing_board(t.t_doc, t.t_fact).select("document_id", "status", "error_message", "facts_count")


@query("Q26_board_summary", """
SELECT count(*) AS total, count(*) FILTER (WHERE status = '已完成') AS done, count(*) FILTER (WHERE status = '失败') AS failed,
  count(*) FILTER (WHERE status = '处理中') AS running FROM t_doc WHERE status IN ('失败', '处理中', '已完成')""")
def q26_summary(t):
    return R.board_summary(R.processing_board(t.t_doc, t.t_fact, limit=None))


@query("Q27_reset_finished", "SELECT document_id, CASE WHEN status IN ('已完成', '失败', '内容为空') THEN '待处理' ELSE status END AS status FROM t_doc")
def q27(t):
    return R.reset_finished(t.t_doc).select("document_id", "status")


@query("Q28_pending", "SELECT document_id FROM t_doc WHERE status = '待处理'")
def q28(t):
    return R.select_pending(t.t_doc).select("document_id")


@query("Q28_reprocess_failed", """
SELECT document_id FROM t_doc d WHERE status = '已完成' AND (NOT EXISTS (SELECT 1 FROM t_fact f WHERE f.document_id = d.document_id)
  OR EXISTS (SELECT 1 FROM t_task k WHERE k.document_id = d.document_id AND k.status = '解析失败'))""")
def q28_failed(t):
    return R.select_failed(t.t_doc, t.t_fact, t.t_task).select("document_id")
