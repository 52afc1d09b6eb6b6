"""Domain tables derived from the driver's Parquet tables.

Each table is one portable SQL statement, run by Spark to feed the queries and
prefixed as a CTE to the SQL that checks them. ``{name}`` refers to a driver
table or to another domain table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from factloom.session import ship

DOMAIN: dict[str, str] = {}

DOMAIN["t_fact"] = """
SELECT
  concat_ws('-', CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING), CAST(l_partkey AS STRING),
            CAST(l_suppkey AS STRING), CAST(CAST(l_quantity AS INT) AS STRING)) AS fact_id,
  l_orderkey - l_orderkey % 20 AS document_id,
  concat_ws('-', CAST(l_orderkey - l_orderkey % 20 AS STRING), CAST(l_linenumber AS STRING), CAST(l_partkey % 9 AS STRING)) AS evidence_id,
  CASE l_partkey % 9 WHEN 0 THEN 'FINANCIAL_METRIC' WHEN 1 THEN 'SALES_VOLUME' WHEN 2 THEN 'CAPACITY'
    WHEN 3 THEN 'INVESTMENT' WHEN 4 THEN 'EXPANSION' WHEN 5 THEN 'MARKET_SHARE'
    WHEN 6 THEN 'COMPETITIVE_RANKING' WHEN 7 THEN 'COOPERATION' ELSE 'PRICE_CHANGE' END AS fact_type,
  CASE l_linenumber % 3 WHEN 0 THEN s_name WHEN 1 THEN s_name || '有限公司'
    ELSE s_name || '（青岛）有限公司' END AS subject_text,
  CASE WHEN l_partkey % 6 = 5 THEN '战略合作' WHEN l_partkey % 2 = 0 THEN '销售额为' ELSE '产能为' END AS predicate,
  CASE WHEN l_linenumber % 4 = 0 THEN NULL ELSE p_brand END AS object_text,
  CASE WHEN l_suppkey % 5 = 0 THEN NULL ELSE l_quantity END AS value_num,
  CASE WHEN l_suppkey % 5 = 0 AND l_linenumber > 3 THEN '约一半' ELSE NULL END AS value_text,
  CASE l_suppkey % 4 WHEN 0 THEN '亿' WHEN 1 THEN '亿元' WHEN 2 THEN '亿美元' ELSE '万吨' END AS unit,
  CAST(NULL AS STRING) AS currency,
  CASE WHEN l_tax = 0 THEN NULL ELSE CAST(year(l_shipdate) AS STRING) || '年' END AS time_expr,
  CASE WHEN l_linenumber = 7 THEN '全国船舶市场' ELSE n_name END AS location_text,
  CASE WHEN l_linenumber = 6 AND l_returnflag = 'R' THEN '{{bad'
    ELSE '{{"metric_name":"' || p_type || '","project_name":"' || p_name || '","yoy":""}}' END AS qualifier_json,
  l_discount * 10 AS confidence_score,
  CASE l_returnflag || l_linestatus WHEN 'AF' THEN '自动通过' WHEN 'AO' THEN '人工通过'
    WHEN 'NF' THEN '待人工审核' WHEN 'NO' THEN '待处理' WHEN 'RF' THEN '已拒绝' ELSE '不确定' END AS review_status,
  CASE WHEN l_returnflag = 'R' THEN '主体不符' ELSE NULL END AS review_note,
  CASE WHEN l_linenumber % 3 = 0 THEN 'S' || CAST(l_suppkey AS STRING) ELSE NULL END AS subject_entity_id,
  CASE WHEN l_linenumber % 4 <> 0 AND l_suppkey % 2 = 0 THEN 'B' || p_brand ELSE NULL END AS object_entity_id,
  CASE WHEN l_linenumber <> 7 THEN 'N' || CAST(n_nationkey AS STRING) ELSE NULL END AS location_entity_id,
  l_shipdate AS created_at
FROM {lineitem}
JOIN {supplier} ON s_suppkey = l_suppkey
JOIN {part} ON p_partkey = l_partkey
JOIN {nation} ON n_nationkey = s_nationkey
"""

DOMAIN["t_doc"] = """
SELECT o_orderkey AS document_id,
  CASE o_orderpriority WHEN '1-URGENT' THEN '网址' WHEN '5-LOW' THEN '粘贴' ELSE '文件' END AS source_type,
  o_orderpriority AS source_name,
  '文章 ' || CAST(o_orderkey AS STRING) AS title,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 'http://example.org/' || CAST(o_orderkey AS STRING) ELSE NULL END AS url,
  CASE o_orderstatus WHEN 'F' THEN '已完成' WHEN 'O' THEN '待处理'
    ELSE CASE WHEN o_totalprice < 150000 THEN '失败' WHEN o_totalprice < 300000 THEN '处理中' ELSE '内容为空' END END AS status,
  CASE WHEN o_orderstatus = 'P' AND o_totalprice < 150000 THEN 'timeout' ELSE NULL END AS error_message,
  o_orderdate AS crawl_time
FROM {orders}
"""

DOMAIN["t_chunk"] = """
SELECT 'C' || CAST(o_orderkey AS STRING) AS chunk_id, o_orderkey AS document_id, 0 AS chunk_index,
  o_orderpriority || ' ' || o_orderstatus AS chunk_text,
  length(o_orderpriority || ' ' || o_orderstatus) AS char_count
FROM {orders}
"""

DOMAIN["t_evidence"] = """
SELECT evidence_id, min(document_id) AS document_id, 'C' || CAST(min(document_id) AS STRING) AS chunk_id,
  min(fact_type) AS fact_type, '证据 ' || evidence_id AS evidence_text, 'medium' AS priority
FROM {t_fact} GROUP BY evidence_id
"""

DOMAIN["t_entity"] = """
SELECT 'S' || CAST(s_suppkey AS STRING) AS entity_id, s_name AS canonical_name, s_name AS normalized_name,
  '企业' AS entity_type FROM {supplier}
UNION ALL
SELECT 'V' || CAST(s_suppkey AS STRING),
  s_name || CASE s_nationkey % 3 WHEN 0 THEN '（青岛）' WHEN 1 THEN '（上海）' ELSE '（香港）' END || '有限公司',
  s_name, CASE WHEN s_nationkey % 5 = 0 THEN 'UNKNOWN' ELSE '企业' END FROM {supplier} WHERE s_acctbal > 5000
UNION ALL
SELECT DISTINCT 'B' || p_brand, p_brand, p_brand,
  CASE WHEN length(p_brand) = 7 THEN '企业' ELSE '品牌' END FROM {part}
UNION ALL
SELECT 'N' || CAST(n_nationkey AS STRING), n_name, n_name, '国家' FROM {nation}
"""

DOMAIN["t_alias"] = """
SELECT 'A' || CAST(s_suppkey AS STRING) AS alias_id, 'S' || CAST(s_suppkey AS STRING) AS entity_id,
  s_name || '有限公司' AS alias_name FROM {supplier} WHERE s_suppkey % 2 = 0
UNION ALL
SELECT 'AV' || CAST(s_suppkey AS STRING), 'V' || CAST(s_suppkey AS STRING), s_name || '集团'
FROM {supplier} WHERE s_acctbal > 5000
"""

DOMAIN["t_relation"] = """
SELECT 'RN' || CAST(s_suppkey AS STRING) AS relation_id, 'N' || CAST(s_nationkey AS STRING) AS from_entity_id,
  'S' || CAST(s_suppkey AS STRING) AS to_entity_id, 'SUBSIDIARY' AS relation_type,
  '{{"share_pct":' || CAST(s_suppkey % 100 AS STRING) || '}}' AS detail_json, '手动' AS source
FROM {supplier}
UNION ALL
SELECT DISTINCT 'RB' || CAST(l_suppkey AS STRING) || p_brand, 'S' || CAST(l_suppkey AS STRING), 'B' || p_brand,
  'PARTNER', '{{}}', '自动提取'
FROM {lineitem} JOIN {part} ON p_partkey = l_partkey
WHERE l_partkey % 9 = 7 AND l_discount = 0.1
"""

DOMAIN["t_task"] = """
SELECT 'T' || CAST(event_id AS STRING) AS task_id, user_id AS document_id,
  CASE event_type WHEN 'click' THEN '全文抽取' WHEN 'purchase' THEN '上下文补全' WHEN 'signup' THEN '证据发现'
    ELSE '审核' END AS task_type,
  CASE WHEN event_type = 'error' THEN '失败' WHEN event_type = 'signup' AND value < 10 THEN '解析失败'
    WHEN value > 150 THEN '运行中' ELSE '成功' END AS status,
  CAST(floor(value * 10) AS BIGINT) AS input_tokens, CAST(floor(value) AS BIGINT) AS output_tokens,
  CASE WHEN user_id % 3 = 0 THEN NULL ELSE 'model-' || CAST(user_id % 3 AS STRING) END AS model_name,
  ts AS started_at, CASE WHEN event_type = 'error' THEN 'timeout ' || props ELSE NULL END AS error_message
FROM {events}
"""

DOMAIN["t_merge_task"] = """
SELECT 'M' || CAST(a.s_suppkey AS STRING) AS task_id, 'S' || CAST(a.s_suppkey AS STRING) AS primary_id,
  'S' || CAST(b.s_suppkey AS STRING) AS secondary_id, CAST(70 + a.s_suppkey % 30 AS DOUBLE) / 100 AS rule_score,
  CASE a.s_suppkey % 3 WHEN 0 THEN '合并' WHEN 1 THEN '保留' ELSE NULL END AS model_verdict,
  CASE WHEN a.s_acctbal > 6000 THEN '待处理' WHEN a.s_acctbal > 3000 THEN '已批准'
    WHEN a.s_acctbal > 0 THEN '已拒绝' ELSE '已执行' END AS status
FROM {supplier} a JOIN {supplier} b ON b.s_suppkey = a.s_suppkey + 1
UNION ALL
SELECT 'MV' || CAST(s_suppkey AS STRING), 'V' || CAST(s_suppkey AS STRING), 'S' || CAST(s_suppkey AS STRING),
  CAST(80 + s_suppkey % 20 AS DOUBLE) / 100, '不确定', '待处理' FROM {supplier} WHERE s_acctbal > 5000
UNION ALL
SELECT 'MW' || CAST(a.s_suppkey AS STRING), 'V' || CAST(a.s_suppkey AS STRING), 'V' || CAST(b.s_suppkey AS STRING),
  CAST(75 AS DOUBLE) / 100, NULL, '待处理'
FROM {supplier} a JOIN {supplier} b ON b.s_suppkey = a.s_suppkey + 1
WHERE a.s_acctbal > 5000 AND b.s_acctbal > 5000
"""

DOMAIN["t_suggestion"] = """
SELECT 'G' || CAST(l_suppkey AS STRING) || '-' || p_brand AS suggestion_id, 'S' || CAST(l_suppkey AS STRING) AS entity_id,
  p_brand AS target_name, CASE WHEN length(p_brand) = 7 THEN 'B' || p_brand ELSE NULL END AS target_entity_id,
  CASE max(l_partkey) % 3 WHEN 0 THEN '关系' WHEN 1 THEN '别名' ELSE '合并' END AS suggestion_type,
  CASE max(l_partkey) % 3 WHEN 0 THEN 'PARTNER' ELSE NULL END AS relation_type,
  max(l_discount) * 10 AS confidence, 'evidence ' || p_brand AS evidence,
  CASE WHEN max(l_tax) > 0.05 THEN 'background' ELSE NULL END AS search_evidence,
  CASE max(l_linenumber) % 3 WHEN 0 THEN '待处理' WHEN 1 THEN '已确认' ELSE '已拒绝' END AS status,
  max(l_shipdate) AS created_at
FROM {lineitem} JOIN {part} ON p_partkey = l_partkey
WHERE l_partkey % 9 = 3 OR l_partkey % 9 = 4
GROUP BY l_suppkey, p_brand
"""

DOMAIN["t_review_log"] = """
SELECT 'R' || fact_id AS log_id, fact_id AS target_id, '待处理' AS old_status, review_status AS new_status,
  '系统审核' AS reviewer FROM {t_fact} WHERE review_status <> '待处理'
"""

DOMAIN["t_cache"] = """
SELECT 'K' || CAST(event_id AS STRING) AS cache_id,
  CASE WHEN event_type = 'view'
    THEN ' Entity ' || CAST(user_id AS STRING) || '||Peer ' || CAST(CAST(floor(value) AS BIGINT) % 10 AS STRING) || ' '
    ELSE ' Entity ' || CAST(user_id AS STRING) END AS query,
  'Entity ' || CAST(user_id AS STRING) AS entity_name,
  CASE event_type WHEN 'click' THEN '搜索引擎' WHEN 'view' THEN '综合' ELSE 'LLM知识' END AS search_source,
  CASE WHEN value < 5 THEN '' ELSE 'summary ' || CAST(event_id AS STRING) END AS summary_text, ts AS created_at
FROM {events}
"""

DRIVER_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)
# tables whose rows get CPU-heavy work right after the scan
TEXT_TABLES = ("lineitem", "documents", "pages")
#: Set by sessions that read tables of one row group and want all cores at work; unset, tables are read as they are stored.
INPUT_PARTITIONS = "spark.factloom.inputPartitions"
_REF = re.compile(r"\{(\w+)\}")


class Tables:
    """Lazy access to driver and domain tables as DataFrames: ``t.t_fact``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        ship(spark)
        self.spark = spark
        self._dir = sf_dir.rstrip("/")
        self._cache: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._cache:
            if name in DRIVER_TABLES:
                table = self.spark.read.parquet(f"{self._dir}/{name}.parquet")
                n = self.spark.conf.get(INPUT_PARTITIONS, None)
                self._cache[name] = table.repartition(int(n)) if n and name in TEXT_TABLES else table
            elif name in DOMAIN:
                self._cache[name] = self.sql(DOMAIN[name])
            else:
                raise AttributeError(name)
        return self._cache[name]

    def sql(self, text: str) -> DataFrame:
        """Run SQL whose ``{name}`` placeholders are tables of this object."""
        refs = sorted({r for r in _REF.findall(text.replace("{{", "").replace("}}", ""))})
        return self.spark.sql(text, **{r: getattr(self, r) for r in refs})


def _plain(text: str) -> str:
    refs = {r: r for r in _REF.findall(text.replace("{{", "").replace("}}", ""))}
    return text.format(**refs)


def _needs(text: str) -> list[str]:
    return [n for n in DOMAIN if re.search(rf"\b{n}\b", text)]


def with_tables(sql: str) -> str:
    """Prefix check SQL with the CTEs of every domain table it mentions."""
    wanted: list[str] = []

    def visit(name: str) -> None:
        body = _plain(DOMAIN[name])
        for dep in _needs(body):
            if dep != name:
                visit(dep)
        if name not in wanted:
            wanted.append(name)

    for name in _needs(sql):
        visit(name)
    ctes = [f"{n} AS ({_plain(DOMAIN[n])})" for n in wanted]
    body = sql.strip()
    head = re.match(r"(?i)WITH\s+(RECURSIVE\s+)?", body)
    if head:
        ctes.append(body[head.end():])
        return ("WITH RECURSIVE " if head.group(1) else "WITH ") + ",\n".join(ctes)
    return (("WITH " + ",\n".join(ctes) + "\n") if ctes else "") + body
