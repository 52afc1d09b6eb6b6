"""Incremental ingest."""

from pyspark.sql import functions as F

from factloom import config as C
from factloom.plans.extraction import _answers
from factloom.plans.linking import _PLACE_ROWS, _linked_sql
from factloom.plans.registry import query
from factloom.plans.snippets import FACT_KEY, KEYS, subject_key
from factloom.plans.sources import scratch
from factloom.streaming import ingest

_READ = """r AS (SELECT * REPLACE (CASE WHEN fact_type IN ('CAPACITY', 'INVESTMENT', 'EXPANSION') THEN '{}' ELSE qualifier_json END AS qualifier_json)
  FROM t_fact WHERE review_status <> '不确定' AND document_id % 11 <> 0
  AND NOT (fact_type IN ('CAPACITY', 'INVESTMENT', 'EXPANSION') AND review_status IN ('已拒绝', '待处理')))"""


def _ingested(t):
    """Folder of a stream that took in the answers of several files in several micro-batches and linked their names."""
    folder = scratch(t.spark)
    # one document in eleven comes with an article too short to count
    article = F.when(F.col("document_id") % 11 == 0, "<p>短</p>").otherwise(F.concat(F.lit("<p>"), F.repeat(F.lit("正文"), 60), F.lit("</p>")))
    _answers(t).withColumn("article", article).repartition(4, "document_id").write.parquet(f"{folder}/in")
    ingest.start_ingest(t.spark, f"{folder}/in", f"{folder}/out", files_per_batch=2).awaitTermination()
    ingest.compact_index(t.spark, f"{folder}/out")
    ingest.link_stream(t.spark, f"{folder}/out", t.t_entity, t.t_alias)
    return f"{folder}/out"


@query("ST1_incremental_ingest", f"""
WITH {_READ},
k AS (SELECT *, {subject_key('subject_text')} AS s, lower(trim(coalesce(location_text, ''))) AS p FROM (SELECT *, {FACT_KEY} FROM r)
  QUALIFY row_number() OVER (PARTITION BY {KEYS} ORDER BY confidence_score DESC, sha256(fact_id || '|0')) = 1),
live AS (SELECT * FROM k WHERE NOT (fact_type = 'INVESTMENT' AND value_num IS NULL AND EXISTS (
  SELECT 1 FROM k e WHERE e.fact_type = 'EXPANSION' AND e.document_id = k.document_id AND e.s = k.s AND e.p = k.p)))
SELECT k_type AS fact_type, count(*) AS kept, round(sum(confidence_score), 4) AS confidence, count(*) AS linked FROM live GROUP BY 1""")
def st1(t):
    kept = ingest.current_facts(t.spark, _ingested(t)).filter(F.col("review_status") != C.DUPLICATE)
    return kept.groupBy("fact_type").agg(
        F.count("*").alias("kept"), F.round(F.sum("confidence_score"), 4).alias("confidence"), F.count("subject_entity_id").alias("linked"))


@query("ST1_stream_links", f"""
WITH {_READ},
o AS (SELECT DISTINCT text FROM (SELECT trim(subject_text) AS text FROM r UNION ALL SELECT trim(object_text) FROM r) WHERE text <> ''),
fresh AS (SELECT * FROM o WHERE text NOT IN (SELECT canonical_name FROM t_entity) AND text NOT IN (SELECT alias_name FROM t_alias)),
holder AS (SELECT canonical_name AS name, entity_id, false AS is_new FROM t_entity UNION ALL SELECT text, sha256('entity|' || text), true FROM fresh),
held AS (SELECT text, name, entity_id, is_new FROM fresh JOIN holder ON contains(lower(name), lower(text)) AND name <> text
  AND (length(name) > length(text) OR NOT is_new OR name < text) AND length(text) >= 2),
tops AS (SELECT * FROM fresh WHERE text NOT IN (SELECT text FROM held)),
e AS (SELECT entity_id, canonical_name FROM t_entity UNION ALL SELECT sha256('entity|' || text), text FROM tops
  UNION ALL SELECT sha256('entity|' || name), name FROM (VALUES {_PLACE_ROWS}) v(name, kind, pos)),
a AS (SELECT entity_id, alias_name FROM t_alias UNION ALL SELECT entity_id, text FROM held WHERE NOT is_new OR name IN (SELECT text FROM tops)
  QUALIFY row_number() OVER (PARTITION BY text ORDER BY is_new, length(name), name, entity_id) = 1),
{_linked_sql('o', 'e', 'a', 'lk')}
SELECT 'name' AS kind, text, entity_id FROM lk
UNION ALL SELECT DISTINCT 'place', location_text, CASE WHEN location_text = '全国船舶市场' THEN sha256('entity|全国') ELSE location_entity_id END FROM r""")
def st1_links(t):
    return ingest.stream_table(t.spark, _ingested(t), "links")
