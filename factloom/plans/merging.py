"""Merging, renaming and clustering of entities."""

from pyspark.sql import functions as F

from factloom.operators import merging as M
from factloom.operators.components import connected_components
from factloom.plans.registry import query
from factloom.plans.snippets import APPROVED, place


def _aliases(t):
    return t.t_alias.select(F.col("alias_id").alias("entity_id"), F.col("alias_name").alias("canonical_name"), F.lit("UNKNOWN").alias("entity_type"))


@query("M1_merge_suggestions")
def m1(t):
    names = t.t_entity.select("entity_id", "canonical_name", "entity_type").unionByName(_aliases(t))
    return M.merge_suggestions(names, limit=None, expand=False).select("primary_name", "secondary_name", "score", "reason")


def _candidates(t):
    s = t.supplier
    name = lambda k: F.concat(F.lit("S"), k.cast("string"))
    near = s.select("s_suppkey", "s_acctbal", F.explode(F.array(F.lit(1), F.lit(2))).alias("d"))
    other = s.select((F.col("s_suppkey")).alias("k2"), F.col("s_name").alias("secondary_name"))
    return near.join(other, F.col("k2") == F.col("s_suppkey") + F.col("d")).select(
        name(F.col("s_suppkey")).alias("primary_id"), name(F.col("k2")).alias("secondary_id"), "secondary_name",
        ((F.col("s_suppkey") % 30 + 70).cast("double") / 100).alias("score"), F.lit("r").alias("reason"), "s_acctbal")


@query("M2_generate_tasks", """
WITH c AS (SELECT 'S' || CAST(a.s_suppkey AS VARCHAR) AS p, 'S' || CAST(b.s_suppkey AS VARCHAR) AS s, b.s_name AS sn,
    CAST(a.s_suppkey % 30 + 70 AS DOUBLE) / 100 AS score, a.s_acctbal AS bal
  FROM supplier a JOIN supplier b ON b.s_suppkey IN (a.s_suppkey + 1, a.s_suppkey + 2)),
f AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM t_merge_task t WHERE least(t.primary_id, t.secondary_id) = least(p, s)
  AND greatest(t.primary_id, t.secondary_id) = greatest(p, s))),
asked AS (SELECT * FROM f WHERE score < 98e-2)
SELECT p AS primary_id, s AS secondary_id, score AS rule_score, '合并' AS model_verdict, 'rule-only' AS model FROM f WHERE score >= 98e-2
UNION ALL SELECT CASE WHEN bal > 5000 THEN s ELSE p END, CASE WHEN bal > 5000 THEN p ELSE s END, score, '合并', 'm'
FROM asked WHERE bal > 1000""")
def m2(t):
    cand = _candidates(t)
    verdicts = cand.filter("s_acctbal > 1000").select(
        "primary_id", "secondary_id", F.lit("合并").alias("verdict"), F.lit(0.9).alias("confidence"), F.lit("x").alias("reason"),
        F.lit("m").alias("model"), F.when(F.col("s_acctbal") > 5000, F.col("secondary_name")).alias("primary_name"))
    new, _ = M.generate_tasks(cand, t.t_merge_task, verdicts)
    return new.select("primary_id", "secondary_id", "rule_score", "model_verdict", "model")


@query("M3_pair_requests", f"""
WITH f AS (SELECT subject_entity_id AS e, fact_id, concat_ws(' ', fact_type, predicate, object_text,
    coalesce(CAST(value_num AS VARCHAR) || unit, value_text), time_expr) AS line FROM t_fact
  WHERE {APPROVED} AND subject_entity_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY subject_entity_id ORDER BY fact_id) <= 3),
l AS (SELECT e, list(line ORDER BY fact_id) AS facts FROM f GROUP BY e),
i AS (SELECT entity_id, {{'name': canonical_name, 'type': entity_type, 'facts': coalesce(facts, [])}} AS info
  FROM t_entity LEFT JOIN l ON e = entity_id)
SELECT primary_id, secondary_id, CAST(to_json({{'primary': p.info, 'secondary': s.info}}) AS VARCHAR) AS body
FROM t_merge_task JOIN i p ON p.entity_id = primary_id JOIN i s ON s.entity_id = secondary_id""")
def m3(t):
    return M.pair_requests(t.t_merge_task, t.t_entity, t.t_fact, samples=3)


@query("M4_task_list", """
SELECT task_id, a.canonical_name AS primary_name, b.canonical_name AS secondary_name, model_verdict, rule_score
FROM t_merge_task JOIN t_entity a ON a.entity_id = primary_id JOIN t_entity b ON b.entity_id = secondary_id WHERE status = '待处理'""")
def m4(t):
    return M.list_tasks(t.t_merge_task, t.t_entity).select("task_id", "primary_name", "secondary_name", "model_verdict", "rule_score")


@query("M5_task_counts", """
SELECT s AS status, (SELECT count(*) FROM t_merge_task WHERE status = s) AS n
FROM (VALUES ('待处理'), ('已批准'), ('已拒绝'), ('已执行')) v(s) UNION ALL SELECT 'total', count(*) FROM t_merge_task""")
def m5(t):
    return M.task_counts(t.t_merge_task)


@query("M6_decide_tasks", """
WITH d AS (SELECT *, CASE WHEN rule_score >= 9e-1 THEN 'swap' WHEN rule_score >= 8e-1 THEN 'approve' ELSE 'reject' END AS a,
  status = '已执行' AS fixed FROM t_merge_task)
SELECT task_id, CASE WHEN a = 'swap' AND NOT fixed THEN secondary_id ELSE primary_id END AS primary_id,
  CASE WHEN a = 'swap' AND NOT fixed THEN primary_id ELSE secondary_id END AS secondary_id,
  CASE WHEN fixed OR a <> 'reject' THEN '已执行' ELSE '已拒绝' END AS status FROM d""")
def m6(t):
    action = F.when(F.col("rule_score") >= 0.9, "swap").when(F.col("rule_score") >= 0.8, "approve").otherwise("reject")
    tasks, _, _ = M.decide_tasks(t.t_merge_task, t.t_merge_task.select("task_id", action.alias("action")))
    return tasks.select("task_id", "primary_id", "secondary_id", "status")


_MOVES = """RECURSIVE par AS (SELECT secondary_id AS node, primary_id AS up FROM t_merge_task WHERE status = '已批准'
    QUALIFY row_number() OVER (PARTITION BY secondary_id ORDER BY rule_score DESC, task_id) = 1),
walk AS (SELECT node, up FROM par UNION ALL SELECT w.node, p.up FROM walk w JOIN par p ON p.node = w.up),
mv AS (SELECT node AS old_id, up AS new_id FROM walk WHERE up NOT IN (SELECT node FROM par))"""


def _moves(t):
    pairs = t.t_merge_task.filter("status = '已批准'").select(
        "primary_id", "secondary_id", F.col("rule_score").alias("score"), "task_id")
    return M.resolve_merges(pairs)


def _merged(t):
    return M.execute_merges(_moves(t), t.t_fact, t.t_entity, t.t_alias, t.t_relation, t.t_merge_task, t.t_suggestion)


@query("M7_merge_map", f"WITH {_MOVES} SELECT old_id, new_id FROM mv")
def m7_map(t):
    return _moves(t)


@query("M7_merged_facts", f"""WITH {_MOVES}
SELECT fact_id, coalesce(a.new_id, subject_entity_id) AS subject_entity_id, object_entity_id
FROM t_fact LEFT JOIN mv a ON a.old_id = subject_entity_id""")
def m7_facts(t):
    return _merged(t)["facts"].select("fact_id", "subject_entity_id", "object_entity_id")


@query("M7_merged_aliases", f"""WITH {_MOVES},
u AS (SELECT new_id AS entity_id, canonical_name AS alias_name, 0 AS r FROM t_entity JOIN mv ON old_id = entity_id
  UNION ALL SELECT coalesce(new_id, entity_id), alias_name, 1 FROM t_alias LEFT JOIN mv ON old_id = entity_id)
SELECT entity_id, alias_name FROM u QUALIFY row_number() OVER (PARTITION BY alias_name ORDER BY r, entity_id) = 1""")
def m7_aliases(t):
    return _merged(t)["aliases"].select("entity_id", "alias_name")


@query("M7_merged_relations", f"""WITH {_MOVES}
SELECT DISTINCT coalesce(new_id, from_entity_id) AS from_entity_id, to_entity_id, relation_type
FROM t_relation LEFT JOIN mv ON old_id = from_entity_id
WHERE to_entity_id NOT IN (SELECT old_id FROM mv) AND coalesce(new_id, from_entity_id) <> to_entity_id""")
def m7_relations(t):
    return _merged(t)["relations"].select("from_entity_id", "to_entity_id", "relation_type")


@query("M7_merged_tasks", f"""WITH {_MOVES}
SELECT task_id, coalesce(new_id, primary_id) AS primary_id, secondary_id FROM t_merge_task LEFT JOIN mv ON old_id = primary_id
WHERE secondary_id NOT IN (SELECT old_id FROM mv) AND coalesce(new_id, primary_id) <> secondary_id""")
def m7_tasks(t):
    return _merged(t)["tasks"].select("task_id", "primary_id", "secondary_id")


@query("M8_batch_rename", """
SELECT fact_id, regexp_replace(subject_text, '(（青岛）)?有限公司$', '') AS subject_text,
  'S' || CAST(CAST(regexp_extract(subject_text, '#(\\d+)', 1) AS BIGINT) AS VARCHAR) AS subject_entity_id FROM t_fact""")
def m8(t):
    tails = F.array(F.lit(""), F.lit("有限公司"), F.lit("（青岛）有限公司"))
    mapping = t.supplier.select(
        F.explode(F.transform(tails, lambda x: F.concat("s_name", x))).alias("text"), F.col("s_name").alias("canonical_name"),
        F.lit("企业").alias("entity_type"), F.lit(None).cast("string").alias("entity_id"))
    return M.batch_rename(mapping, t.t_fact, t.t_entity, t.t_alias)["facts"].select("fact_id", "subject_text", "subject_entity_id")


@query("M9_name_clusters")
def m9(t):
    named = t.t_entity.select("entity_id", "canonical_name", "entity_type").unionByName(_aliases(t))
    return M.cluster_names(M.cluster_items(t.t_fact, named)).select("pivot", "text", "sim_to_pivot", "is_pivot", "max_fact_count", "place_warning")


@query("M9_cluster_items", f"""
WITH f AS (SELECT * FROM t_fact WHERE {APPROVED}), c AS (SELECT subject_entity_id AS e, count(*) AS n FROM f GROUP BY 1),
s AS (SELECT subject_text AS text, count(*) AS n FROM f GROUP BY 1)
SELECT canonical_name AS text, coalesce(n, 0) AS fact_count, 'entity' AS source FROM t_entity LEFT JOIN c ON e = entity_id
UNION ALL SELECT text, n, 'subject_text' FROM s WHERE text NOT IN (SELECT canonical_name FROM t_entity)""")
def m9_items(t):
    return M.cluster_items(t.t_fact, t.t_entity).select("text", "fact_count", "source")


@query("M10_components", """
WITH RECURSIVE e AS (SELECT primary_id AS a, secondary_id AS b FROM t_merge_task WHERE status <> '已拒绝'
  UNION SELECT secondary_id, primary_id FROM t_merge_task WHERE status <> '已拒绝'),
r AS (SELECT a AS node, a AS seen FROM e UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.seen)
SELECT node, min(seen) AS component FROM r GROUP BY node""")
def m10(t):
    return connected_components(t.t_merge_task.filter("status <> '已拒绝'"), "primary_id", "secondary_id")


_KW = "#00000001"


@query("M11_merge_search", f"""
WITH f AS (SELECT * FROM t_fact WHERE {APPROVED}), c AS (SELECT subject_entity_id AS entity_id, count(*) AS n FROM f GROUP BY 1),
a AS (SELECT 0 AS pos, canonical_name AS text, coalesce(n, 0) AS fact_count, entity_id FROM t_entity LEFT JOIN c USING (entity_id)
  WHERE contains(canonical_name, '{_KW}') ),
b AS (SELECT 1, canonical_name, coalesce(n, 0) AS fc, entity_id FROM t_entity LEFT JOIN c USING (entity_id)
  WHERE entity_id IN (SELECT entity_id FROM t_alias WHERE contains(alias_name, '{_KW}')) ),
s AS (SELECT 2, subject_text, count(*) AS n, NULL FROM f WHERE subject_entity_id IS NULL AND contains(subject_text, '{_KW}') GROUP BY 2),
u AS (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM s)
SELECT pos, text, fact_count, entity_id FROM u QUALIFY row_number() OVER (PARTITION BY text ORDER BY pos, fact_count DESC, entity_id) = 1""")
def m11(t):
    return M.search_for_merge(_KW, t.t_fact, t.t_entity, t.t_alias).select("pos", "text", "fact_count", "entity_id")


_NAMED = """n AS (SELECT t.*, a.canonical_name AS pn, b.canonical_name AS sn FROM t_merge_task t
  JOIN t_entity a ON a.entity_id = primary_id JOIN t_entity b ON b.entity_id = secondary_id)"""


@query("M12_place_conflicts", f"""WITH {_NAMED}
SELECT task_id, CASE WHEN status = '待处理' AND {place('pn')} <> {place('sn')} THEN '已拒绝' ELSE status END AS status FROM n""")
def m12(t):
    return M.reject_place_conflicts(t.t_merge_task, t.t_entity).select("task_id", "status")


@query("M13_task_direction", f"""WITH {_NAMED},
g AS (SELECT *, status = '待处理' AND length(replace(pn, ' ', '')) > length(replace(sn, ' ', ''))
  AND regexp_matches(pn, '[（(]') AS turn FROM n)
SELECT task_id, CASE WHEN turn THEN secondary_id ELSE primary_id END AS primary_id,
  CASE WHEN turn THEN primary_id ELSE secondary_id END AS secondary_id FROM g""")
def m13(t):
    return M.fix_direction(t.t_merge_task, t.t_entity).select("task_id", "primary_id", "secondary_id")
