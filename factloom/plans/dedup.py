"""Fact keys and de-duplication."""

from pyspark.sql import functions as F

from factloom.functions import keys as K
from factloom.operators import dedup
from factloom.plans.registry import query
from factloom.plans.snippets import ACTIVE, BEST, FACT_KEY, KEYS, discriminator, strip, subject_key
from factloom.session import reread


@query("D1_subject_key", f"""
SELECT DISTINCT subject_text, {subject_key('subject_text')} AS subject_key FROM t_fact""")
def d1(t):
    return t.t_fact.select("subject_text").distinct().withColumn("subject_key", K.subject_key(F.col("subject_text")))


@query("D2_discriminator", f"SELECT fact_id, {discriminator()} AS discriminator FROM t_fact")
def d2(t):
    return t.t_fact.select("fact_id", K.discriminator(
        F.col("fact_type"), K.qualifiers(F.col("qualifier_json")), F.col("predicate"), F.col("object_text")
    ).alias("discriminator"))


@query("D3_fingerprint", f"SELECT fact_id, {FACT_KEY} FROM t_fact")
def d3(t):
    return dedup.with_fact_key(t.t_fact).select("fact_id", *K.KEY_COLUMNS)


@query("D4_within_document", f"""
WITH k AS (SELECT *, {FACT_KEY} FROM t_fact WHERE {ACTIVE}),
r AS (SELECT fact_id, first_value(fact_id) OVER w AS canonical_id, row_number() OVER w AS rn FROM k
  WINDOW w AS (PARTITION BY document_id, {KEYS} ORDER BY {BEST}))
SELECT fact_id, canonical_id, '重复: 与 ' || canonical_id || ' 重复（同文档）' AS review_note FROM r WHERE rn > 1""")
def d4(t):
    return dedup.within_document(t.t_fact)


_NEW = "document_id IN (SELECT document_id FROM t_doc WHERE status = '待处理')"


def _with_origin(t, rows):
    """Rows with ``is_new``: facts of pending documents are new, the others are the stock."""
    pending = t.t_doc.filter("status = '待处理'").select("document_id", F.lit(True).alias("_p"))
    return rows.join(pending, "document_id", "left").withColumn("is_new", F.coalesce("_p", F.lit(False))).drop("_p")


@query("D5_cross_document", f"""
WITH k AS (SELECT *, {FACT_KEY}, {_NEW} AS is_new FROM t_fact WHERE {ACTIVE}),
best AS (SELECT {KEYS}, fact_id AS old_id, confidence_score AS old_conf FROM k WHERE NOT is_new
  QUALIFY row_number() OVER (PARTITION BY {KEYS} ORDER BY {BEST}) = 1),
met AS (SELECT n.fact_id, n.confidence_score, n.created_at, b.old_id,
    coalesce(n.confidence_score, 0) > coalesce(b.old_conf, 0) AS wins
  FROM k n JOIN best b ON n.k_type = b.k_type AND n.k_subject = b.k_subject AND n.k_disc = b.k_disc
    AND n.k_value IS NOT DISTINCT FROM b.k_value AND n.k_time = b.k_time WHERE n.is_new),
beat AS (SELECT old_id, fact_id FROM met WHERE wins
  QUALIFY row_number() OVER (PARTITION BY old_id ORDER BY {BEST}) = 1)
SELECT fact_id, old_id AS canonical_id, '重复: 与 ' || old_id || ' 重复（跨文档）' AS review_note FROM met WHERE NOT wins
UNION ALL
SELECT old_id, fact_id, '重复: 与 ' || fact_id || ' 重复（跨文档，分数更低）' FROM beat""")
def d5(t):
    # narrowed before the join and written, as both sides read them
    live = reread(_with_origin(t, dedup.live_facts(t.t_fact)), "live")
    return dedup.cross_marks(live.filter("is_new"), live.filter("NOT is_new"))


def _cross_type_sql(place: str) -> str:
    return f"""
WITH k AS (SELECT *, {subject_key('subject_text')} AS k_subject,
    lower({strip("coalesce(location_text, '')")}) AS k_place FROM t_fact WHERE {ACTIVE}),
e AS (SELECT document_id, k_subject{place}, fact_id AS canonical_id FROM k WHERE fact_type = 'EXPANSION'
  QUALIFY row_number() OVER (PARTITION BY document_id, k_subject{place} ORDER BY created_at DESC, fact_id DESC) = 1)
SELECT i.fact_id, e.canonical_id, '重复: 无金额INVESTMENT，与EXPANSION ' || e.canonical_id || ' 重叠' AS review_note
FROM k i JOIN e USING (document_id, k_subject{place}) WHERE i.fact_type = 'INVESTMENT' AND i.value_num IS NULL"""


@query("D6_cross_type", _cross_type_sql(", k_place"))
def d6(t):
    return dedup.cross_type(t.t_fact)


@query("D7_active_facts", f"""
SELECT review_status, count(*) AS n FROM t_fact WHERE {ACTIVE} GROUP BY review_status""")
def d7(t):
    return t.t_fact.filter(dedup.is_active()).groupBy("review_status").agg(F.count("*").alias("n"))


@query("D8_global_fingerprint", f"""
WITH k AS (SELECT *, {FACT_KEY} FROM t_fact WHERE {ACTIVE}),
r AS (SELECT fact_id, first_value(fact_id) OVER w AS canonical_id, row_number() OVER w AS rn FROM k
  WINDOW w AS (PARTITION BY {KEYS} ORDER BY {BEST}))
SELECT fact_id, canonical_id, '重复: 与 ' || canonical_id || ' 重复' AS review_note FROM r WHERE rn > 1""")
def d8(t):
    return dedup.global_fingerprint(t.t_fact)


@query("D8_type_status_distribution", f"""
WITH k AS (SELECT *, {FACT_KEY} FROM t_fact WHERE {ACTIVE}),
r AS (SELECT fact_id, row_number() OVER (PARTITION BY {KEYS} ORDER BY {BEST}) AS rn FROM k),
m AS (SELECT fact_id FROM r WHERE rn > 1)
SELECT fact_type, CASE WHEN m.fact_id IS NOT NULL THEN '重复' ELSE review_status END AS review_status,
  count(*) AS n, round(avg(confidence_score), 6) AS avg_confidence
FROM t_fact f LEFT JOIN m ON m.fact_id = f.fact_id GROUP BY 1, 2""")
def d8_distribution(t):
    """Flagship: de-duplicate all facts, then report types by review state."""
    settled = dedup.apply_marks(t.t_fact, dedup.global_fingerprint(t.t_fact))
    return settled.groupBy("fact_type", "review_status").agg(
        F.count("*").alias("n"), F.round(F.avg("confidence_score"), 6).alias("avg_confidence"))


@query("D9_global_cross_type", _cross_type_sql(""))
def d9(t):
    return dedup.global_cross_type(t.t_fact)


@query("D10_exact_groups", """
SELECT document_id, fact_type, subject_text, predicate, object_text, count(*) AS n FROM t_fact
GROUP BY ALL HAVING count(*) > 1""")
def d10(t):
    return dedup.exact_groups(t.t_fact)


@query("D10_exact_duplicates", f"""
SELECT fact_id, first_value(fact_id) OVER w AS canonical_id FROM t_fact
WINDOW w AS (PARTITION BY document_id, fact_type, subject_text, predicate, object_text ORDER BY {BEST})
QUALIFY row_number() OVER w > 1""")
def d10_marks(t):
    return dedup.exact_duplicates(t.t_fact)


@query("D11_three_layers", f"""
WITH k0 AS (SELECT *, {FACT_KEY}, {_NEW} AS is_new,
    lower({strip("coalesce(location_text, '')")}) AS k_place FROM t_fact WHERE {ACTIVE}),
l1 AS (SELECT fact_id FROM k0 WHERE is_new
  QUALIFY row_number() OVER (PARTITION BY document_id, {KEYS} ORDER BY {BEST}) > 1),
k1 AS (SELECT * FROM k0 WHERE fact_id NOT IN (SELECT fact_id FROM l1)),
best AS (SELECT {KEYS}, fact_id AS old_id, confidence_score AS old_conf FROM k1 WHERE NOT is_new
  QUALIFY row_number() OVER (PARTITION BY {KEYS} ORDER BY {BEST}) = 1),
met AS (SELECT n.fact_id, b.old_id, coalesce(n.confidence_score, 0) > coalesce(b.old_conf, 0) AS wins
  FROM k1 n JOIN best b ON n.k_type = b.k_type AND n.k_subject = b.k_subject AND n.k_disc = b.k_disc
    AND n.k_value IS NOT DISTINCT FROM b.k_value AND n.k_time = b.k_time WHERE n.is_new),
l2 AS (SELECT fact_id FROM met WHERE NOT wins UNION SELECT old_id FROM met WHERE wins),
k2 AS (SELECT * FROM k1 WHERE is_new AND fact_id NOT IN (SELECT fact_id FROM l2)),
l3 AS (SELECT fact_id FROM k2 i WHERE fact_type = 'INVESTMENT' AND value_num IS NULL AND EXISTS (
  SELECT 1 FROM k2 e WHERE e.fact_type = 'EXPANSION' AND e.document_id = i.document_id
    AND e.k_subject = i.k_subject AND e.k_place = i.k_place))
SELECT 'within_doc' AS layer, count(*) AS n FROM l1 UNION ALL SELECT 'cross_doc', count(*) FROM l2
UNION ALL SELECT 'cross_type', count(*) FROM l3""")
def d11(t):
    marks, _ = dedup.three_layers(_with_origin(t, t.t_fact), F.col("is_new"))
    layers = t.spark.createDataFrame([("within_doc",), ("cross_doc",), ("cross_type",)], "layer string")
    return layers.join(marks.groupBy("layer").agg(F.count("*").alias("n")), "layer", "left") \
        .select("layer", F.coalesce("n", F.lit(0)).alias("n"))
