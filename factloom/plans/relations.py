"""Relations, suggestions, background texts and profiles."""

from pyspark.sql import functions as F

from factloom.operators import profiles as P
from factloom.operators import relations as R
from factloom.plans.registry import query
from factloom.plans.snippets import APPROVED, contain_score, norm_name

_OBJ = "fact_type IN ('COOPERATION', 'INVESTMENT', 'EXPANSION')"
_A1 = f"""a1 AS (SELECT subject_entity_id AS entity_id, trim(object_text) AS target_name,
  coalesce(object_entity_id, (SELECT min(entity_id) FROM t_entity e WHERE e.canonical_name = trim(object_text))) AS target_entity_id,
  CASE WHEN fact_type = 'INVESTMENT' THEN '投资' ELSE '合作方' END AS rel_hint,
  predicate || '：' || object_text AS evidence, fact_id AS evidence_fact_id
  FROM t_fact WHERE {APPROVED} AND {_OBJ} AND subject_entity_id IS NOT NULL AND length(trim(object_text)) >= 4
  QUALIFY row_number() OVER (PARTITION BY subject_entity_id, trim(object_text) ORDER BY fact_id) = 1)"""


@query("A1_fact_candidates", f"WITH {_A1} SELECT * FROM a1")
def a1(t):
    return R.fact_candidates(t.t_fact, t.t_entity).drop("source", "fact_type", "score")


_A2 = f"""own AS (SELECT DISTINCT entity_id AS x, {norm_name('n')} AS nx FROM (SELECT entity_id, canonical_name AS n FROM t_entity
    UNION ALL SELECT entity_id, alias_name FROM t_alias) WHERE length({norm_name('n')}) >= 4),
oth AS (SELECT entity_id AS y, coalesce(nullif({norm_name('canonical_name')}, ''), canonical_name) AS ny, canonical_name AS cy FROM t_entity),
sc AS (SELECT x, y, any_value(cy) AS cy, max({contain_score('nx', 'ny')}) AS s FROM own JOIN oth ON x <> y
  AND (contains(nx, ny) OR contains(ny, nx)) GROUP BY x, y),
a2 AS (SELECT x AS entity_id, cy AS target_name, y AS target_entity_id, round(s, 3) AS score FROM sc WHERE s >= 72e-2)"""


@query("A2_similar_candidates", f"WITH {_A2} SELECT * FROM a2")
def a2(t):
    return R.similar_candidates(t.t_entity, t.t_alias).select("entity_id", "target_name", "target_entity_id", "score")


def _inputs(t):
    cand = R.fact_candidates(t.t_fact, t.t_entity).unionByName(
        R.similar_candidates(t.t_entity, t.t_alias), allowMissingColumns=True)
    pending = t.t_suggestion.filter("status = '待处理'")
    verdicts = t.t_suggestion.filter("search_evidence is not null").select(
        "entity_id", "target_name", F.when(F.col("suggestion_type") == "合并", "跳过").otherwise(F.col("suggestion_type")).alias("suggestion_type"),
        "confidence", F.lit("r").alias("reason"), "relation_type")
    background = t.t_suggestion.filter("suggestion_type = '别名'").select(
        "entity_id", "target_name", F.lit("known").alias("search_evidence"))
    return cand, pending, verdicts, background


@query("A3_suggestions", f"""WITH {_A1}, {_A2},
c0 AS (SELECT entity_id, target_name, target_entity_id, 'fact' AS source, NULL AS score, rel_hint FROM a1 UNION ALL
  SELECT entity_id, target_name, target_entity_id, 'name', score, '子公司' FROM a2),
c AS (SELECT * FROM c0 QUALIFY row_number() OVER (PARTITION BY entity_id, target_name ORDER BY source, score DESC, target_entity_id) = 1),
j AS (SELECT c.*, v.suggestion_type AS vt, v.confidence AS vc, v.relation_type AS vr, b.suggestion_id IS NOT NULL AS bg FROM c
  LEFT JOIN (SELECT * FROM t_suggestion WHERE search_evidence IS NOT NULL) v USING (entity_id, target_name)
  LEFT JOIN (SELECT * FROM t_suggestion WHERE suggestion_type = '别名') b USING (entity_id, target_name)
  WHERE NOT EXISTS (SELECT 1 FROM t_suggestion p WHERE p.status = '待处理' AND p.entity_id = c.entity_id AND p.target_name = c.target_name)
    AND NOT (c.source = 'name' AND EXISTS (SELECT 1 FROM a1 WHERE a1.entity_id = c.entity_id AND a1.target_name = c.target_name))),
o AS (SELECT *, coalesce(CASE WHEN vt = '合并' THEN '跳过' ELSE vt END, '关系') AS st,
  coalesce(nullif(vc, 0), CASE WHEN source = 'fact' THEN 6e-1 ELSE score END) AS conf FROM j)
SELECT entity_id, target_name, st AS suggestion_type, coalesce(vr, CASE WHEN st = '关系' THEN rel_hint END) AS relation_type,
  round(conf, 6) AS confidence, bg AND conf >= 75e-2 AS auto_confirmable FROM o WHERE st <> '跳过'""")
def a3(t):
    return R.assemble_suggestions(*_inputs(t)).select(
        "entity_id", "target_name", "suggestion_type", "relation_type", F.round("confidence", 6).alias("confidence"), "auto_confirmable")


_OK = "status = '已确认'"


def _made(t):
    return R.materialise(t.t_suggestion.filter(_OK), t.t_relation, t.t_alias, t.t_merge_task)


@query("A4_materialised", f"""
WITH s AS (SELECT * FROM t_suggestion WHERE {_OK})
SELECT 'relation' AS kind, suggestion_id FROM s WHERE suggestion_type = '关系' AND target_entity_id IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM t_relation r WHERE r.from_entity_id = s.entity_id AND r.to_entity_id = s.target_entity_id AND r.relation_type = 'PARTNER')
UNION ALL SELECT 'alias', min(suggestion_id) FROM s WHERE suggestion_type = '别名' GROUP BY target_name
UNION ALL SELECT 'task', suggestion_id FROM s WHERE suggestion_type = '合并' AND target_entity_id IS NOT NULL
UNION ALL SELECT 'reject', suggestion_id FROM s WHERE suggestion_type <> '别名' AND target_entity_id IS NULL""")
def a4(t):
    made = _made(t)
    row = lambda kind, df, c: df.select(F.lit(kind).alias("kind"), F.col(c).alias("suggestion_id"))
    return row("relation", made["relations"], "relation_id").unionByName(row("alias", made["aliases"], "alias_id")).unionByName(
        row("task", made["tasks"], "task_id")).unionByName(row("reject", made["rejects"], "suggestion_id"))


@query("A5_suggestion_list", """
SELECT suggestion_id, canonical_name AS entity_name, confidence FROM t_suggestion JOIN t_entity USING (entity_id)
WHERE status = '待处理' ORDER BY confidence DESC, created_at DESC, suggestion_id LIMIT 100""")
def a5(t):
    return R.list_suggestions(t.t_suggestion, t.t_entity).select("suggestion_id", "entity_name", "confidence")


@query("A5_suggestion_decisions", """
SELECT suggestion_id, CASE WHEN status <> '待处理' THEN status WHEN confidence > 0.5 THEN '已确认' ELSE '已拒绝' END AS status FROM t_suggestion""")
def a5_decide(t):
    d = t.t_suggestion.filter("status = '待处理'").select(
        "suggestion_id", F.when(F.col("confidence") > 0.5, "confirm").otherwise("reject").alias("action"))
    return R.decide_suggestions(t.t_suggestion, d).select("suggestion_id", "status")


@query("A6_analysis_requests", f"""WITH {_A1}, {_A2},
c AS (SELECT entity_id, count(*) AS n_candidates FROM (SELECT entity_id FROM a1 UNION ALL SELECT entity_id FROM a2) GROUP BY 1),
f AS (SELECT subject_entity_id AS entity_id, least(count(*), 5) AS n FROM t_fact WHERE {APPROVED} GROUP BY 1)
SELECT entity_id, n_candidates, coalesce(n, 0) AS n_facts, canonical_name AS entity, n_candidates AS n_sent FROM c JOIN t_entity USING (entity_id) LEFT JOIN f USING (entity_id)""")
def a6(t):
    cand, _, _, background = _inputs(t)
    return R.analysis_requests(t.t_entity, t.t_fact, cand, background, lines=5).select(
        "entity_id", "n_candidates", "n_facts", F.get_json_object("body", "$.entity").alias("entity"),
        F.json_array_length(F.get_json_object("body", "$.candidates")).cast("long").alias("n_sent"))


@query("A7_analysis_answers", """
SELECT entity_id, target_name, CASE WHEN status = '已拒绝' THEN '关系' ELSE suggestion_type END AS suggestion_type,
  CASE WHEN status = '已拒绝' THEN 6e-1 ELSE confidence END AS confidence FROM t_suggestion""")
def a7(t):
    item = F.struct(F.col("target_name").alias("target"), "suggestion_type", "confidence")
    bare = F.struct(F.col("target_name").alias("target"))
    early = F.struct(F.col("target_name").alias("target"), F.lit("跳过").alias("suggestion_type"))
    text = F.when(F.col("status") == "已拒绝", F.to_json(F.struct(F.array(bare).alias("suggestions")))).otherwise(
        F.concat(F.lit("["), F.to_json(early), F.lit(","), F.to_json(item), F.lit("]")))
    return R.ingest_analysis(t.t_suggestion.select("entity_id", text.alias("json"))).select(
        "entity_id", "target_name", "suggestion_type", "confidence")


@query("A8_top_entities", f"""
SELECT entity_id, canonical_name, count(*) AS fact_count FROM t_entity JOIN t_fact ON subject_entity_id = entity_id
WHERE {APPROVED} GROUP BY ALL ORDER BY fact_count DESC, entity_id LIMIT 50""")
def a8(t):
    return R.top_entities(t.t_fact, t.t_entity, n=50)


@query("A9_relation_candidates", f"""
WITH r AS (SELECT from_entity_id AS a, to_entity_id AS b FROM t_relation UNION SELECT to_entity_id, from_entity_id FROM t_relation),
f AS (SELECT subject_entity_id AS a, object_entity_id AS b, * FROM t_fact WHERE {APPROVED} AND {_OBJ}
  AND subject_entity_id <> object_entity_id AND NOT EXISTS (SELECT 1 FROM r WHERE r.a = subject_entity_id AND r.b = object_entity_id)),
p AS (SELECT a, b, predicate, min(fact_id) AS k FROM f GROUP BY a, b, predicate QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY min(fact_id)) <= 3),
q AS (SELECT a, b, string_agg(predicate, ',' ORDER BY k) AS sample_predicates FROM p GROUP BY a, b)
SELECT a AS from_id, b AS to_id, CASE WHEN bool_or(fact_type = 'INVESTMENT') THEN 'SHAREHOLDER'
  WHEN bool_or(fact_type = 'COOPERATION') THEN 'PARTNER' ELSE 'SUBSIDIARY' END AS suggested_type, count(*) AS evidence_count,
  any_value(sample_predicates) AS sample_predicates FROM f JOIN q USING (a, b) GROUP BY a, b""")
def a9(t):
    return R.relation_candidates(t.t_fact, t.t_entity, t.t_relation, samples=3).drop("from_name", "to_name")


@query("A10_proposals", """
WITH p AS (SELECT entity_id AS f, coalesce(target_entity_id, 'none') AS t, confidence FROM t_suggestion WHERE suggestion_type <> '别名')
SELECT f AS from_id, t AS to_id, confidence FROM p WHERE t IN (SELECT entity_id FROM t_entity) AND NOT EXISTS (
  SELECT 1 FROM t_relation r WHERE (r.from_entity_id = f AND r.to_entity_id = t) OR (r.from_entity_id = t AND r.to_entity_id = f))""")
def a10(t):
    proposals = t.t_suggestion.select(
        F.col("entity_id").alias("from_id"), F.coalesce("target_entity_id", F.lit("none")).alias("to_id"), "confidence",
        F.when(F.col("suggestion_type") == "别名", "ALIAS").otherwise("JV").alias("relation_type"))
    return R.filter_proposals(proposals, t.t_entity, t.t_relation).select("from_id", "to_id", "confidence")


@query("A10_proposal_entities", """
WITH a AS (SELECT entity_id, string_agg(alias_name, '、' ORDER BY alias_name) AS a FROM t_alias GROUP BY 1)
SELECT entity_id, '- [' || entity_id || '] ' || canonical_name || ' [' || entity_type || ']' || coalesce('  别名: ' || a, '') AS line
FROM t_entity LEFT JOIN a USING (entity_id)""")
def a10_lines(t):
    return R.proposal_entities(t.t_entity, t.t_alias)


@query("A11_relation_changes", """
WITH k AS (SELECT from_entity_id, to_entity_id, relation_type FROM t_relation WHERE source <> '手动')
SELECT * FROM k UNION SELECT entity_id, target_entity_id, 'PARTNER' FROM t_suggestion
WHERE target_entity_id IS NOT NULL AND suggestion_type <> '别名'""")
def a11(t):
    adds = t.t_suggestion.filter("target_entity_id is not null").select(
        F.col("suggestion_id").alias("relation_id"), F.col("entity_id").alias("from_entity_id"),
        F.col("target_entity_id").alias("to_entity_id"),
        F.when(F.col("suggestion_type") == "别名", "ALIAS").otherwise("PARTNER").alias("relation_type"),
        F.lit("{}").alias("detail_json"), F.lit("手动").alias("source"))
    out, _ = R.apply_relation_changes(t.t_relation, adds, t.t_relation.filter("source = '手动'"))
    return out.select("from_entity_id", "to_entity_id", "relation_type")


@query("A12_relations_of", """
SELECT relation_id, a.canonical_name AS from_name, b.canonical_name AS to_name, relation_type FROM t_relation
JOIN t_entity a ON a.entity_id = from_entity_id JOIN t_entity b ON b.entity_id = to_entity_id
WHERE a.entity_type = '品牌' OR b.entity_type = '品牌'""")
def a12(t):
    return R.relations_of(t.t_relation, t.t_entity, t.t_entity.filter("entity_type = '品牌'")).select(
        "relation_id", "from_name", "to_name", "relation_type")


_CACHE = """c AS (SELECT cache_id, entity_name, search_source, summary_text, created_at,
    array_to_string(list_sort(list_transform(string_split(query, '||'), lambda p: lower(trim(p)))), '||') AS query FROM t_cache
  QUALIFY row_number() OVER (PARTITION BY array_to_string(list_sort(list_transform(string_split(query, '||'),
    lambda p: lower(trim(p)))), '||') ORDER BY created_at DESC, cache_id DESC) = 1)"""


def _cache(t):
    old = t.t_cache.filter("search_source = '综合'")
    return R.upsert_cache(old, t.t_cache.filter("search_source <> '综合'"))


@query("A13_cache", f"WITH {_CACHE} SELECT query, cache_id, summary_text FROM c")
def a13(t):
    return _cache(t).select("query", "cache_id", "summary_text")


@query("A13_cache_lookup", f"""WITH {_CACHE}
SELECT e.entity_id, c.summary_text FROM (SELECT s_suppkey AS entity_id, 'entity ' || s_suppkey AS k FROM supplier) e LEFT JOIN c ON c.query = e.k""")
def a13_lookup(t):
    asked = t.supplier.select(F.col("s_suppkey").alias("entity_id"), F.concat(F.lit("ENTITY "), F.col("s_suppkey").cast("string")).alias("query"))
    return R.cache_lookup(asked, _cache(t)).select("entity_id", "summary_text")


@query("A13_cache_stats", f"WITH {_CACHE} SELECT count(*) AS total, max(created_at) AS latest FROM c")
def a13_stats(t):
    return R.cache_stats(_cache(t))


@query("A13_latest", f"WITH {_CACHE} SELECT cache_id, query FROM c ORDER BY created_at DESC, cache_id LIMIT 20")
def a13_latest(t):
    return R.latest_cache(_cache(t)).select("cache_id", "query")


@query("A14_known_entities", """
WITH a AS (SELECT entity_id, string_agg(alias_name, ', ' ORDER BY alias_name) AS a FROM t_alias GROUP BY 1),
r AS (SELECT t_relation.*, f.canonical_name AS fn, t.canonical_name AS tn, CASE WHEN json_extract_string(detail_json, '$.share_pct') IS NOT NULL
    THEN ' (' || json_extract_string(detail_json, '$.share_pct') || '%)' ELSE '' END AS pct FROM t_relation
  JOIN t_entity f ON f.entity_id = from_entity_id JOIN t_entity t ON t.entity_id = to_entity_id)
SELECT entity_id, 0 AS part, '- ' || canonical_name || ' [' || entity_type || ']' || coalesce(' (别名: ' || a || ')', '') AS line
FROM t_entity LEFT JOIN a USING (entity_id)
UNION ALL SELECT from_entity_id, 1, '  → ' || relation_type || ': ' || tn || pct FROM r
UNION ALL SELECT to_entity_id, 2, '  ← ' || relation_type || ' of ' || fn || pct FROM r""")
def a14(t):
    return R.known_entity_lines(t.t_entity, t.t_alias, t.t_relation).select("entity_id", "part", "line")


@query("A15_background", """
WITH x AS (SELECT doc_id, source, lang FROM documents)
SELECT doc_id, CASE WHEN lang = 'en' THEN 'none' WHEN lang = 'de' THEN 'llm_knowledge' ELSE CASE WHEN lang = 'fr' THEN 'combined' ELSE 'duckduckgo' END END AS search_source,
  CASE WHEN lang = 'en' THEN '' WHEN lang = 'de' THEN '[AI知识库] about ' || source WHEN lang = 'fr' THEN '[网络搜索] short | type: ' || source || chr(10) || '[AI知识库] about ' || source
    ELSE '[网络搜索] short | type: ' || source END AS summary_text FROM x""")
def a15(t):
    box = F.struct(F.array(F.struct(F.lit("type").alias("label"), F.col("source").alias("value"))).alias("content"))
    search = F.when(F.col("lang").isin("fr", "es"), F.to_json(F.struct(F.lit("short").alias("Abstract"), box.alias("Infobox"))))
    model = F.when(F.col("lang").isin("de", "fr"), F.concat(F.lit(" about "), "source"))
    rows = t.documents.select("doc_id", F.element_at(F.split("text", " "), 1).alias("entity_name"),
                              search.alias("search_json"), model.alias("model_text"))
    return R.background_summary(rows).select("doc_id", "search_source", "summary_text")


@query("P1_profile_relations", """
SELECT from_entity_id AS entity_id, e.canonical_name AS target_name, relation_type, 'outgoing' AS direction, detail_json
FROM t_relation JOIN t_entity e ON e.entity_id = to_entity_id
UNION ALL SELECT to_entity_id, e.canonical_name, relation_type, 'incoming', detail_json
FROM t_relation JOIN t_entity e ON e.entity_id = from_entity_id""")
def p1(t):
    return P.profile_relations(t.t_relation, t.t_entity).select("entity_id", "target_name", "relation_type", "direction", "detail_json")


_P2 = f"""l AS (SELECT * FROM t_fact WHERE {APPROVED} AND subject_entity_id IS NOT NULL AND value_num IS NOT NULL),
p2 AS (SELECT subject_entity_id AS entity_id, fact_type, predicate AS metric, value_num AS value, time_expr AS time, fact_id FROM l
  QUALIFY row_number() OVER (PARTITION BY subject_entity_id, fact_type, predicate, time_expr ORDER BY fact_id) = 1)"""


@query("P2_benchmarks", f"WITH {_P2} SELECT * FROM p2")
def p2(t):
    return P.profile_benchmarks(t.t_fact).select("entity_id", "fact_type", "metric", "value", "time", "fact_id")


_P3 = f"""rk AS (SELECT * FROM t_fact WHERE fact_type = 'COMPETITIVE_RANKING' AND subject_entity_id IS NOT NULL),
d AS (SELECT subject_entity_id AS entity_id, object_text AS name, 0 AS how FROM rk WHERE {APPROVED} AND object_text <> '' GROUP BY 1, 2),
m AS (SELECT DISTINCT a.subject_entity_id AS entity_id, b.subject_entity_id AS cid, b.subject_text AS name FROM rk a JOIN rk b USING (document_id)
  WHERE a.subject_entity_id <> b.subject_entity_id AND b.{APPROVED}),
w AS (SELECT entity_id, name, 1 AS how FROM m),
p3 AS (SELECT entity_id, name, min(how) AS how FROM (SELECT * FROM d UNION ALL SELECT * FROM w) GROUP BY 1, 2)"""


@query("P3_competitors", f"WITH {_P3} SELECT * FROM p3")
def p3(t):
    return P.profile_competitors(t.t_fact).select("entity_id", "name", "how")


def _profiles(t, min_facts=1):
    cache = t.t_entity.select(
        F.col("entity_id").alias("cache_id"), F.col("canonical_name").alias("entity_name"), F.col("canonical_name").alias("query"),
        F.concat(F.lit("s "), "canonical_name").alias("summary_text"), F.lit(0).alias("created_at")).filter("cache_id like 'S%'")
    return P.build_profiles(t.t_fact, t.t_entity, t.t_alias, t.t_relation, cache, min_facts)


def _profile_sql(min_facts: int) -> str:
    return f"""{_P2}, {_P3},
n AS (SELECT subject_entity_id AS entity_id, count(*) AS fact_count FROM t_fact WHERE {APPROVED} AND subject_entity_id IS NOT NULL
  GROUP BY 1 HAVING count(*) >= {min_facts}),
pr AS (SELECT entity_id, fact_count, (SELECT count(*) FROM t_alias a WHERE a.entity_id = n.entity_id) AS n_aliases,
  (SELECT count(*) FROM t_relation r WHERE r.from_entity_id = n.entity_id OR r.to_entity_id = n.entity_id) AS n_relations,
  (SELECT count(*) FROM p2 WHERE p2.entity_id = n.entity_id) AS n_benchmarks,
  (SELECT count(*) FROM p3 WHERE p3.entity_id = n.entity_id) AS n_competitors, 's ' || canonical_name AS summary_text
  FROM n JOIN t_entity USING (entity_id))"""


@query("P4_profiles", f"WITH {_profile_sql(1)} SELECT *, '聚合' AS profile_source FROM pr")
def p4(t):
    return _profiles(t).drop("canonical_name", "entity_type")


@query("P5_enriched_profiles", f"""WITH {_profile_sql(1)}
SELECT entity_id, CASE WHEN s_acctbal > 5000 THEN 'a much longer summary' ELSE summary_text END AS summary_text,
  CASE WHEN s_acctbal > 0 THEN '聚合+搜索' ELSE '聚合' END AS profile_source
FROM pr JOIN supplier ON entity_id = 'S' || CAST(s_suppkey AS VARCHAR)""")
def p5(t):
    return P.enrich_profiles(_profiles(t), P.profile_competitors(t.t_fact), t.t_alias, t.t_entity, _background(t))["profiles"].select(
        "entity_id", "summary_text", "profile_source")


def _background(t):
    key = F.concat(F.lit("S"), F.col("s_suppkey").cast("string"))
    return t.supplier.filter("s_acctbal > 0").select(
        key.alias("entity_id"), F.array(F.concat("s_name", F.lit("有限公司")), F.col("s_name"), F.lit("共用"), F.lit(" ")).alias("aliases"),
        F.array(F.lit("Brand#1"), F.lit("外部对手")).alias("competitors"),
        F.when(F.col("s_acctbal") > 5000, "a much longer summary").otherwise("x").alias("summary"))


@query("P5_new_aliases", """
WITH g AS (SELECT 'S' || CAST(s_suppkey AS VARCHAR) AS entity_id, s_name || '有限公司' AS alias_name FROM supplier WHERE s_acctbal > 0)
SELECT entity_id, alias_name FROM g WHERE alias_name NOT IN (SELECT alias_name FROM t_alias)
UNION ALL SELECT min(entity_id), '共用' FROM g""")
def p5_aliases(t):
    return P.enrich_profiles(_profiles(t), P.profile_competitors(t.t_fact), t.t_alias, t.t_entity, _background(t))["aliases"].select(
        "entity_id", "alias_name")


@query("P6_unprofiled", f"""
SELECT entity_id FROM t_entity WHERE entity_id NOT IN (SELECT subject_entity_id FROM t_fact WHERE {APPROVED} AND subject_entity_id IS NOT NULL)""")
def p6(t):
    return P.unprofiled(t.t_entity, _profiles(t)).select("entity_id")
