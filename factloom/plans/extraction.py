"""Extraction requests and answers."""

from pyspark.sql import functions as F

from factloom import config as C
from factloom.functions.predicates import normalize_predicates
from factloom.operators import extraction as X
from factloom.plans.registry import query

_NONE = "CAST(NULL AS VARCHAR)"


def _docs(t):
    return t.t_doc.withColumn("publish_time", F.lit(None).cast("string"))


def _with_evidence(t):
    return t.t_fact.join(t.t_evidence.select("evidence_id", "evidence_text"), "evidence_id")


# ---- answers as a model would write them, one per fact --------------------

def _answers(t):
    """Answer texts in all accepted shapes: typed objects, positional lists, fenced,
    with thinking, with chatter, cut off, and unreadable."""
    record = F.struct(
        F.col("subject_text").alias("subject"), "predicate", F.col("object_text").alias("object"), "value_num",
        "value_text", "unit", "currency", "time_expr", F.col("location_text").alias("location"),
        F.from_json("qualifier_json", "map<string,string>").alias("qualifiers"),
        F.col("confidence_score").alias("confidence"), "evidence_text")
    typed = F.to_json(F.create_map("fact_type", F.array(record)), {"ignoreNullFields": "false"})
    quoted = lambda c: F.substring(F.to_json(F.array(c)), F.lit(2), F.length(F.to_json(F.array(c))) - 2)
    listed = F.concat(F.lit("[["), F.concat_ws(",", *[
        F.coalesce(quoted(F.col(c)), F.lit("null")) for c in
        ("fact_type", "subject_text", "predicate", "object_text", "value_num", "value_text", "unit", "currency",
         "time_expr", "location_text")],
        F.lit('{"k":1}'), F.concat(F.lit('{"score":'), F.col("confidence_score").cast("string"), F.lit("}")),
        quoted(F.col("evidence_text"))), F.lit("]]"))
    body = F.when(F.col("fact_type").isin("CAPACITY", "INVESTMENT", "EXPANSION"), listed).otherwise(typed)
    state = F.col("review_status")
    text = (F.when(state == C.AUTO_PASS, body)
            .when(state == C.HUMAN_PASS, F.concat(F.lit("<think>{not this}</think>\n"), body))
            .when(state == C.NEEDS_HUMAN, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
            .when(state == C.PENDING, F.concat(F.lit("Result: "), body, F.lit(" done")))
            .when(state == C.REJECTED, F.substring(body, F.lit(1), F.length(body) - 1))
            .otherwise(F.lit("no facts here")))
    return _with_evidence(t).select(
        F.col("fact_id").alias("request_id"), "document_id", text.alias("content"))


def _records(t):
    return X.shape_records(X.parse_answers(_answers(t)))


@query("E1_evidence_requests", """
SELECT document_id, sha256('evidence|' || chunk_id) AS request_id, CAST(to_json({'document_title': title,
  'document_source': source_name, 'document_publish_time': '', 'chunk_text': chunk_text}) AS VARCHAR) AS body
FROM t_chunk JOIN t_doc USING (document_id)""")
def e1(t):
    return X.evidence_requests(t.t_chunk, _docs(t))


@query("E2_evidence_ingest", """
WITH f AS (SELECT document_id, fact_type, fact_id, value_num, '证据 ' || evidence_id AS evidence_text,
  'C' || document_id AS chunk_id FROM t_fact WHERE object_text IS NOT NULL)
SELECT sha256(document_id || '|' || fact_type || '|' || evidence_text) AS evidence_id, document_id, chunk_id, fact_type,
  evidence_text, CASE WHEN value_num IS NULL THEN 'medium' ELSE 'high' END AS priority
FROM f WHERE fact_type <> 'CAPACITY'
QUALIFY row_number() OVER (PARTITION BY document_id, fact_type, evidence_text ORDER BY fact_id) = 1""")
def e2(t):
    found = F.struct(F.concat(F.lit("证据 "), "evidence_id").alias("evidence_text"), "fact_type",
                     F.when(F.col("value_num").isNotNull(), "high").alias("priority"))
    noise = lambda text, kind: F.struct(F.lit(text).alias("evidence_text"), F.lit(kind).alias("fact_type"),
                                        F.lit(None).cast("string").alias("priority"))
    body = F.to_json(F.struct(
        F.col("object_text").isNotNull().alias("has_fact"),
        F.array(noise("", "CAPACITY"), noise("x", "OTHER"), found, found).alias("candidates")))
    answers = t.t_fact.select(
        F.col("fact_id").alias("request_id"), "document_id",
        F.concat(F.lit("C"), F.col("document_id").cast("string")).alias("chunk_id"), body.alias("content"))
    stored = t.t_fact.filter("fact_type = 'CAPACITY'").select(
        "document_id", "fact_type", F.concat(F.lit("证据 "), "evidence_id").alias("evidence_text")).distinct()
    return X.ingest_evidence(X.parse_answers(answers), stored)


@query("E3_fact_requests", """
SELECT document_id, sha256('fact|' || evidence_id) AS request_id, CAST(to_json({'document_title': title,
  'document_source': source_name, 'document_publish_time': '', 'fact_type': fact_type, 'evidence_text': evidence_text})
  AS VARCHAR) AS body,
  CASE WHEN fact_type = 'CAPACITY' THEN 'base' ELSE 'base' || chr(10) || chr(10) || 'rules of ' || fact_type END AS prompt
FROM t_evidence JOIN t_doc USING (document_id)""")
def e3(t):
    rules = t.spark.createDataFrame(
        [(k, f"rules of {k}") for k in C.FACT_TYPES if k != "CAPACITY"], "fact_type string, rule_text string")
    return X.fact_requests(t.t_evidence, _docs(t), rules, "base")


_V1_CASE = """CASE WHEN predicate = '' THEN 'no predicate' WHEN subject = '' THEN 'no subject'
  WHEN subject LIKE '%产量' THEN 'metric as subject' WHEN subject = '市场规模' THEN 'statistic as subject'
  WHEN fact_type = 'OTHER' THEN 'unknown type' END"""


@query("E4_evidence_validation", f"""
WITH r AS (SELECT fact_id, CASE WHEN unit = '亿' THEN '' ELSE predicate END AS predicate,
  CASE WHEN location_text = '全国船舶市场' THEN '' WHEN review_status = '已拒绝' THEN subject_text || '产量'
    WHEN review_status = '不确定' THEN '市场规模' ELSE subject_text END AS subject,
  CASE WHEN fact_type = 'EXPANSION' THEN 'OTHER' ELSE fact_type END AS fact_type FROM t_fact)
SELECT fact_id, {_V1_CASE} AS reject_reason FROM r""")
def e4(t):
    spoiled = t.t_fact.withColumns({
        "predicate": F.when(F.col("unit") == "亿", "").otherwise(F.col("predicate")),
        "subject_text": F.when(F.col("location_text") == "全国船舶市场", "  ")
        .when(F.col("review_status") == C.REJECTED, F.concat("subject_text", F.lit("产量")))
        .when(F.col("review_status") == C.UNCERTAIN, "市场规模").otherwise(F.col("subject_text")),
        "fact_type": F.when(F.col("fact_type") == "EXPANSION", "OTHER").otherwise(F.col("fact_type"))})
    return X.judged_evidence_records(spoiled).select("fact_id", "reject_reason")


@query("E5_full_text_requests", """
SELECT doc_id AS document_id, sha256('full|' || doc_id) AS request_id, md5(CAST(to_json({'document_title': '文章 ' || doc_id,
  'document_source': source, 'document_publish_time': '', 'article_text': text}) AS VARCHAR)) AS body_md5 FROM documents""")
def e5(t):
    docs = t.documents.select(
        F.col("doc_id").alias("document_id"), F.concat(F.lit("文章 "), F.col("doc_id").cast("string")).alias("title"),
        F.col("source").alias("source_name"), F.lit(None).cast("string").alias("publish_time"),
        F.col("text").alias("clean_text"))
    return X.full_text_requests(docs).select("document_id", "request_id", F.md5("body").alias("body_md5"))


@query("E6_answer_json", "SELECT fact_id AS request_id, review_status <> '不确定' AS readable FROM t_fact")
def e6(t):
    return X.parse_answers(_answers(t)).select("request_id", F.col("json").isNotNull().alias("readable"))


# in a list that is not JSON as a whole, the first inner object is taken for the answer
_SHAPED = """SELECT fact_id AS request_id, fact_type, subject_text, predicate, object_text, value_num, unit, time_expr,
  location_text, confidence_score, '证据 ' || evidence_id AS evidence_text FROM t_fact WHERE review_status <> '不确定'
  AND NOT (fact_type IN ('CAPACITY', 'INVESTMENT', 'EXPANSION') AND review_status IN ('已拒绝', '待处理'))"""


@query("E7_record_shaping", _SHAPED)
def e7(t):
    return _records(t).select("request_id", "fact_type", "subject_text", "predicate", "object_text", "value_num", "unit",
                              "time_expr", "location_text", "confidence_score", "evidence_text")


@query("E8_record_validation", f"WITH s AS ({_SHAPED}) SELECT fact_type, count(*) AS n, round(sum(confidence_score), 4) AS conf FROM s GROUP BY 1")
def e8(t):
    good, _ = X.validate_records(_records(t))
    return good.groupBy("fact_type").agg(F.count("*").alias("n"), F.round(F.sum("confidence_score"), 4).alias("conf"))


def _root_sql() -> str:
    arms = " ".join(
        f"WHEN '{k}' THEN " + " OR ".join(f"contains(predicate, '{r}')" for r in roots)
        for k, roots in C.PREDICATE_ROOTS.items())
    return f"CASE fact_type {arms} END"


def _extra_sql() -> str:
    keys = ("metric_name", "project_name", "yoy")
    arms = " ".join(
        f"WHEN '{k}' THEN '{','.join(x for x in keys if x not in allowed)}'" for k, allowed in C.QUALIFIER_KEYS.items())
    return f"CASE WHEN json_valid(qualifier_json) THEN CASE fact_type {arms} END ELSE '' END"


@query("E9_vocabulary_monitor", f"SELECT fact_id, {_root_sql()} AS known_predicate, {_extra_sql()} AS extra_qualifiers FROM t_fact")
def e9(t):
    return X.monitor_vocabulary(t.t_fact).select("fact_id", "known_predicate", "extra_qualifiers")


@query("E10_predicate_rewrite", """
SELECT fact_id, CASE fact_type WHEN 'EXPANSION' THEN '已建成' WHEN 'COMPETITIVE_RANKING' THEN '位居第一'
    WHEN 'CAPACITY' THEN '产能' WHEN 'COOPERATION' THEN predicate ELSE '综合销售额为' END AS predicate,
  coalesce(time_expr, CASE WHEN fact_type NOT IN ('EXPANSION', 'COMPETITIVE_RANKING', 'COOPERATION') THEN '2020年' END) AS time_expr,
  CASE fact_type WHEN 'EXPANSION' THEN '一期工程' WHEN 'COMPETITIVE_RANKING' THEN '中国船舶涂料产销量'
    WHEN 'CAPACITY' THEN '船舶涂料' END AS moved,
  fact_id || '", "phase": {' AS deep, unit AS listed FROM t_fact""")
def e10(t):
    kind = F.col("fact_type")
    source = (F.when(kind == "EXPANSION", "一期工程已建成").when(kind == "COMPETITIVE_RANKING", "位居中国船舶涂料产销量第一")
              .when(kind == "CAPACITY", F.lit("2020年全国船舶涂料产能")).when(kind == "COOPERATION", F.col("predicate"))
              .otherwise(F.lit("2020年综合销售额")))
    # nested, listed and escaped values that hold the words of the rules
    nested = F.to_json(F.struct(
        F.struct(F.concat("fact_id", F.lit('", "phase": {')).alias("phase")).alias("detail"), F.array(F.lit("phase"), F.col("unit")).alias("duration"), F.lit("").alias("yoy")))
    out = normalize_predicates(t.t_fact.withColumns({"predicate": source, "qualifier_json": nested}))
    key = (F.when(kind == "EXPANSION", "phase").when(kind == "COMPETITIVE_RANKING", "ranking_scope")
           .when(kind == "CAPACITY", "product_type").otherwise(""))
    return out.select("fact_id", "predicate", "time_expr", F.try_element_at(
        F.from_json("qualifier_json", "map<string,string>"), key).alias("moved"),
        F.get_json_object("qualifier_json", "$.detail.phase").alias("deep"), F.get_json_object("qualifier_json", "$.duration[1]").alias("listed"))


@query("E11_completion_requests", """
WITH n AS (SELECT document_id, fact_type, fact_id, subject_text, (row_number() OVER (PARTITION BY document_id
  ORDER BY substr(md5(fact_id), 1, 3), fact_id) - 1) // 50 AS part FROM t_fact)
SELECT document_id, part, count(*) AS n_facts, count(DISTINCT fact_type) AS n_types,
  any_value(CASE WHEN part = 0 THEN title END) AS article_text, string_agg(DISTINCT fact_type, ',' ORDER BY fact_type) AS types,
  max(CASE WHEN fact_type = 'CAPACITY' THEN f1 END) AS first_capacity
FROM (SELECT n.*, title, first_value(subject_text) OVER (PARTITION BY n.document_id, part, n.fact_type ORDER BY n.fact_id) AS f1
  FROM n JOIN t_doc USING (document_id)) GROUP BY ALL""")
def e11(t):
    articles = t.t_doc.select("document_id", F.col("title").alias("article_text"))
    sent = X.completion_requests(_with_evidence(t), articles, per_request=50)
    listed = F.get_json_object("body", "$.all_extracted_facts_by_type")
    return sent.select("document_id", "part", "n_facts", "n_types", F.get_json_object("body", "$.article_text").alias("article_text"),
                       F.array_join(F.array_sort(F.json_object_keys(listed)), ",").alias("types"),
                       F.get_json_object("body", "$.all_extracted_facts_by_type.CAPACITY[0].subject").alias("first_capacity"))


@query("E12_completion_merge", """
WITH s1 AS (SELECT document_id, fact_type, fact_id, '证据 ' || evidence_id AS evidence_text FROM t_fact
  WHERE review_status IN ('自动通过', '人工通过')),
sup AS (SELECT document_id, fact_type, 'x' || fact_id AS fact_id,
    CASE WHEN value_num IS NULL THEN '证据 ' || evidence_id ELSE '补 ' || time_expr END AS evidence_text,
    CASE WHEN fact_type = 'PRICE_CHANGE' THEN 'list' ELSE 'object' END AS form
  FROM t_fact WHERE review_status = '待处理' AND time_expr IS NOT NULL),
asked AS (SELECT * FROM sup WHERE (document_id, fact_type) IN (SELECT (document_id, fact_type) FROM s1)),
rep AS (SELECT DISTINCT document_id, fact_type FROM asked WHERE form = 'list'),
add1 AS (SELECT * FROM asked WHERE form = 'object'
  QUALIFY row_number() OVER (PARTITION BY document_id, fact_type, evidence_text ORDER BY fact_id) = 1)
SELECT document_id, fact_type, fact_id, evidence_text FROM s1 ANTI JOIN rep USING (document_id, fact_type)
UNION ALL SELECT document_id, fact_type, fact_id, evidence_text FROM asked WHERE form = 'list'
UNION ALL SELECT document_id, fact_type, fact_id, evidence_text FROM add1
  ANTI JOIN s1 USING (document_id, fact_type, evidence_text)""")
def e12(t):
    cols = ["document_id", "fact_type", "fact_id", "evidence_text"]
    facts = _with_evidence(t)
    stage1 = facts.filter(F.col("review_status").isin(*C.APPROVED)).select(*cols)
    more = facts.filter((F.col("review_status") == C.PENDING) & F.col("time_expr").isNotNull()).select(
        "document_id", "fact_type", F.concat(F.lit("x"), "fact_id").alias("fact_id"),
        F.when(F.col("value_num").isNull(), F.col("evidence_text")).otherwise(
            F.concat(F.lit("补 "), "time_expr")).alias("evidence_text"),
        F.when(F.col("fact_type") == "PRICE_CHANGE", "list").otherwise("object").alias("form"),
        F.concat(F.lit("x"), "fact_id").alias("ord"))
    return X.merge_completion(stage1, more)


@query("E13_record_dedup", """
WITH k AS (SELECT *, lower(trim(subject_text)) AS s, nullif(value_num, 0) AS v, lower(coalesce(time_expr, '')) AS w,
  lower(coalesce(nullif(CASE fact_type WHEN 'INVESTMENT' THEN object_text
    WHEN 'COOPERATION' THEN object_text
    WHEN 'FINANCIAL_METRIC' THEN CASE WHEN json_valid(qualifier_json) THEN json_extract_string(qualifier_json, '$.metric_name') END
    WHEN 'SALES_VOLUME' THEN CASE WHEN json_valid(qualifier_json) THEN json_extract_string(qualifier_json, '$.metric_name') END
    WHEN 'EXPANSION' THEN CASE WHEN json_valid(qualifier_json) THEN json_extract_string(qualifier_json, '$.project_name') END
    END, ''), predicate)) AS d FROM t_fact)
SELECT fact_id FROM k QUALIFY row_number() OVER (PARTITION BY document_id, fact_type, s, d, v, w
  ORDER BY confidence_score DESC, fact_id) = 1""")
def e13(t):
    return X.dedup_records(t.t_fact.withColumn("ord", F.col("fact_id"))).select("fact_id")


@query("E14_fact_assembly", """
WITH u AS (SELECT *, '证据 ' || evidence_id AS txt FROM t_fact WHERE object_text IS NOT NULL)
SELECT fact_id AS request_id, CASE WHEN fact_type = 'CAPACITY' THEN evidence_id
  ELSE sha256(document_id || '|' || fact_type || '|' || txt) END AS evidence_id, 'v2.0' AS extraction_version,
  '待处理' AS review_status FROM u""")
def e14(t):
    records = _with_evidence(t).drop("evidence_id").withColumns({
        "request_id": F.col("fact_id"), "ord": F.lit(0),
        "evidence_text": F.when(F.col("object_text").isNotNull(), F.col("evidence_text")).otherwise("")})
    stored = t.t_evidence.filter("fact_type = 'CAPACITY'")
    facts, _ = X.assemble_facts(records, stored, F.lit("m"))
    return facts.select("request_id", "evidence_id", "extraction_version", "review_status")


@query("E15_call_log", """
WITH n AS (SELECT document_id, count(*) AS n_valid FROM t_fact WHERE review_status <> '不确定' GROUP BY 1)
SELECT CAST(d.document_id AS VARCHAR) AS task_id,
  CASE WHEN d.status = '处理中' THEN '运行中' WHEN d.status = '失败' THEN '失败' WHEN n.n_valid IS NULL THEN '解析失败' ELSE '成功' END AS status,
  CASE WHEN d.status = '处理中' THEN 0 ELSE 10 END AS input_tokens
FROM t_doc d LEFT JOIN n USING (document_id)""")
def e15(t):
    requests = t.t_doc.select(F.col("document_id").cast("string").alias("request_id"), "document_id")
    responses = t.t_doc.filter("status <> '处理中'").select(
        F.col("document_id").cast("string").alias("request_id"),
        F.when(F.col("status") == "失败", "timeout").alias("error"),
        F.lit(10).alias("input_tokens"), F.lit(2).alias("output_tokens"), F.lit("m").alias("model"))
    valid = t.t_fact.filter(F.col("review_status") != C.UNCERTAIN).groupBy("document_id").agg(
        F.count("*").alias("n_valid")).select(F.col("document_id").cast("string").alias("request_id"), "n_valid")
    return X.call_log(requests, responses, valid, "全文抽取").select("task_id", "status", "input_tokens")
