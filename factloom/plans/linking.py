"""Entity keys, linking and discovery."""

from pyspark.sql import functions as F

from factloom import config as C
from factloom.functions import keys as K
from factloom.operators import linking as L
from factloom.plans.registry import query
from factloom.plans.snippets import APPROVED, contain_score, norm_name, place

_TEXTS = """x AS (SELECT DISTINCT trim(v) AS text FROM (SELECT subject_text AS v FROM t_fact UNION ALL SELECT object_text FROM t_fact)
  WHERE trim(v) <> '')"""


def _texts(t):
    return L.distinct_texts(t.t_fact, "subject_text", "object_text")


@query("L1_normalized_name", f"WITH {_TEXTS} SELECT text, {norm_name('text')} AS name_key FROM x")
def l1(t):
    return _texts(t).withColumn("name_key", K.normalized_name(F.col("text")))


_PAIRS = """p AS (SELECT task_id, a.canonical_name AS a, b.canonical_name AS b FROM t_merge_task
  JOIN t_entity a ON a.entity_id = primary_id JOIN t_entity b ON b.entity_id = secondary_id)"""


def _pairs(t):
    name = lambda side, out: t.t_entity.select(F.col("entity_id").alias(side), F.col("canonical_name").alias(out))
    return t.t_merge_task.join(name("primary_id", "a"), "primary_id").join(name("secondary_id", "b"), "secondary_id") \
        .select("task_id", "a", "b")


@query("L2_contain_score", f"WITH {_PAIRS} SELECT task_id, round({contain_score('a', 'b')}, 9) AS score FROM p")
def l2(t):
    return _pairs(t).select("task_id", F.round(K.contain_score(F.col("a"), F.col("b")), 9).alias("score"))


@query("L5_places", f"""
SELECT entity_id, {place('canonical_name')} AS place,
  regexp_matches(canonical_name, '^(?:{'|'.join(C.REGION_WORDS)})|(?:{'|'.join(C.REGION_WORDS)})$') AS regional FROM t_entity""")
def l5(t):
    return t.t_entity.select("entity_id", K.bracketed_place(F.col("canonical_name")).alias("place"),
                             K.has_region_word(F.col("canonical_name")).alias("regional"))


_TYPED = """x AS (SELECT fact_id, fact_type, coalesce(CASE fact_type WHEN 'CAPACITY' THEN subject_text || '产能'
  WHEN 'EXPANSION' THEN object_text || '项目' WHEN 'INVESTMENT' THEN location_text || '生产基地'
  WHEN 'MARKET_SHARE' THEN location_text || '市场' WHEN 'PRICE_CHANGE' THEN location_text || '省'
  WHEN 'SALES_VOLUME' THEN '外资' || object_text || '品牌' WHEN 'COMPETITIVE_RANKING' THEN subject_text || '造船业'
  WHEN 'COOPERATION' THEN object_text ELSE subject_text END, '') AS text FROM t_fact)"""


@query("L6_entity_type", f"""WITH {_TYPED}
SELECT fact_id, CASE fact_type WHEN 'CAPACITY' THEN 'UNKNOWN' WHEN 'EXPANSION' THEN CASE WHEN text = '' THEN 'UNKNOWN' ELSE 'PROJECT' END
  WHEN 'INVESTMENT' THEN 'PROJECT' WHEN 'MARKET_SHARE' THEN 'MARKET' WHEN 'PRICE_CHANGE' THEN 'REGION'
  WHEN 'SALES_VOLUME' THEN CASE WHEN text = '' THEN 'UNKNOWN' ELSE 'GROUP' END
  WHEN 'COMPETITIVE_RANKING' THEN CASE WHEN contains(text, '公司') THEN 'COMPANY' ELSE 'INDUSTRY' END
  WHEN 'COOPERATION' THEN CASE WHEN text = '' THEN 'UNKNOWN' ELSE 'PROJECT' END
  ELSE CASE WHEN contains(text, '公司') THEN 'COMPANY' ELSE 'UNKNOWN' END END AS entity_type FROM x""")
def l6(t):
    kind = F.col("fact_type")
    tail = lambda c, s: F.concat(c, F.lit(s))
    text = (F.when(kind == "CAPACITY", tail("subject_text", "产能")).when(kind == "EXPANSION", tail("object_text", "项目"))
            .when(kind == "INVESTMENT", tail("location_text", "生产基地")).when(kind == "MARKET_SHARE", tail("location_text", "市场"))
            .when(kind == "PRICE_CHANGE", tail("location_text", "省"))
            .when(kind == "SALES_VOLUME", F.concat(F.lit("外资"), "object_text", F.lit("品牌")))
            .when(kind == "COMPETITIVE_RANKING", tail("subject_text", "造船业"))
            .when(kind == "COOPERATION", F.col("object_text")).otherwise(F.col("subject_text")))
    return t.t_fact.select("fact_id", K.entity_type(F.coalesce(text, F.lit("")), kind).alias("entity_type"))


def _linked_sql(texts: str, entities: str, aliases: str, out: str) -> str:
    """The linking cascade as SQL over CTEs with the given names."""
    norm = norm_name("text")
    return f"""
{out}_n AS (SELECT text, CASE WHEN {norm} <> text AND {norm} <> '' THEN {norm} END AS norm FROM {texts}),
{out}_c AS (
  SELECT text, 1 AS rule, 0 AS size, e.entity_id, e.canonical_name FROM {out}_n JOIN {entities} e ON e.canonical_name = text
  UNION ALL SELECT text, 2, 0, e.entity_id, e.canonical_name FROM {out}_n JOIN {aliases} a ON a.alias_name = text JOIN {entities} e USING (entity_id)
  UNION ALL SELECT text, 3, 0, e.entity_id, e.canonical_name FROM {out}_n JOIN {entities} e ON e.canonical_name = norm
  UNION ALL SELECT text, 4, 0, e.entity_id, e.canonical_name FROM {out}_n JOIN {aliases} a ON a.alias_name = norm JOIN {entities} e USING (entity_id)
  UNION ALL SELECT text, 5, length(e.canonical_name), e.entity_id, e.canonical_name FROM {out}_n JOIN {entities} e
    ON contains(lower(e.canonical_name), lower(text)) AND e.canonical_name <> text AND length(text) >= 2
  UNION ALL SELECT text, 6, length(e.canonical_name), e.entity_id, e.canonical_name FROM {out}_n JOIN {entities} e
    ON contains(lower(e.canonical_name), lower(norm)) AND e.canonical_name <> norm AND length(norm) >= 2
  UNION ALL SELECT text, 7, -length(e.canonical_name), e.entity_id, e.canonical_name FROM {out}_n JOIN {entities} e
    ON contains(lower(text), lower(e.canonical_name)) AND e.canonical_name <> text AND length(e.canonical_name) >= 2),
{out} AS (SELECT * FROM {out}_c QUALIFY row_number() OVER (PARTITION BY text ORDER BY rule, size, canonical_name, entity_id) = 1)"""


# texts are also lengthened and shortened, so that every rule gets used
_FORMS = "w AS (SELECT text FROM x UNION SELECT '新' || text FROM x UNION SELECT substr(text, 1, length(text) - 1) FROM x WHERE length(text) > 4)"


def _forms(texts):
    shorter = F.when(F.length("text") > 4, F.substring(F.col("text"), F.lit(1), F.length("text") - 1))
    every = F.array_compact(F.array("text", F.concat(F.lit("新"), "text"), shorter))
    return texts.select(F.explode(every).alias("text")).distinct()


@query("L7_link_names", f"""WITH {_TEXTS}, {_FORMS}, {_linked_sql('w', 't_entity', 't_alias', 'lk')}
SELECT w.text, entity_id, coalesce(canonical_name, w.text) AS canonical_name, entity_id IS NOT NULL AS matched, rule
FROM w LEFT JOIN lk USING (text)""")
def l7(t):
    return L.link_names(_forms(_texts(t)), t.t_entity, t.t_alias)


# some subjects are lengthened or shortened, so that there are new names and contained ones
_VARIED = """vf AS (SELECT * REPLACE (CASE fact_type WHEN 'CAPACITY' THEN '新' || subject_text WHEN 'EXPANSION' THEN substr(subject_text, 1, 17)
  ELSE subject_text END AS subject_text) FROM t_fact)"""
_DISCOVERED = f"""{_VARIED}, fe AS (SELECT * FROM t_entity), fa AS (SELECT * FROM t_alias),
o AS (SELECT text, arg_min(fact_type, fact_id) AS fact_type FROM (
    SELECT fact_id, fact_type, trim(subject_text) AS text FROM vf UNION ALL SELECT fact_id, fact_type, trim(object_text) FROM vf)
  WHERE text <> '' GROUP BY text),
fresh AS (SELECT * FROM o WHERE text NOT IN (SELECT canonical_name FROM fe) AND text NOT IN (SELECT alias_name FROM fa)),
holder AS (SELECT canonical_name AS name, entity_id, false AS is_new FROM fe
  UNION ALL SELECT text, sha256('entity|' || text), true FROM fresh),
held AS (SELECT text, name, entity_id, is_new FROM fresh JOIN holder ON contains(lower(name), lower(text)) AND name <> text
  AND (length(name) > length(text) OR NOT is_new OR name < text) AND length(text) >= 2),
tops AS (SELECT * FROM fresh WHERE text NOT IN (SELECT text FROM held)),
owner AS (SELECT text, entity_id FROM held WHERE NOT is_new OR name IN (SELECT text FROM tops)
  QUALIFY row_number() OVER (PARTITION BY text ORDER BY is_new, length(name), name, entity_id) = 1)"""


def _varied(t):
    text, kind = F.col("subject_text"), F.col("fact_type")
    return t.t_fact.withColumn("subject_text", F.when(kind == "CAPACITY", F.concat(F.lit("新"), text)).when(
        kind == "EXPANSION", F.substring(text, 1, 17)).otherwise(text))


@query("L8_discover", f"""WITH {_DISCOVERED}
SELECT 'entity' AS kind, text AS name, sha256('entity|' || text) AS entity_id FROM tops
UNION ALL SELECT 'alias', text, entity_id FROM owner""")
def l8(t):
    entities, aliases = L.discover(_varied(t), t.t_entity, t.t_alias)
    return entities.select(F.lit("entity").alias("kind"), F.col("canonical_name").alias("name"), "entity_id").unionByName(
        aliases.select(F.lit("alias").alias("kind"), F.col("alias_name").alias("name"), "entity_id"))


_PLACE_ROWS = ", ".join(f"('{k}', '{v}', {i})" for i, (k, v) in enumerate(C.PLACE_TYPES.items()))


@query("L9_places", f"""
SELECT name AS canonical_name, kind AS entity_type, sha256('entity|' || name) AS entity_id
FROM (VALUES {_PLACE_ROWS}) v(name, kind, pos) WHERE name NOT IN (SELECT canonical_name FROM t_entity)""")
def l9(t):
    return L.missing_places(t.t_entity).select("canonical_name", "entity_type", "entity_id")


@query("L10_link_places", f"""
WITH x AS (SELECT DISTINCT location_text AS text FROM t_fact),
e AS (SELECT entity_id, canonical_name, 0 AS pos FROM t_entity
  UNION ALL SELECT sha256('entity|' || name), name, pos + 1 FROM (VALUES {_PLACE_ROWS}) v(name, kind, pos))
SELECT text, entity_id FROM x JOIN e ON text = canonical_name OR (pos > 0 AND contains(text, canonical_name))
QUALIFY row_number() OVER (PARTITION BY text ORDER BY text <> canonical_name, pos, entity_id) = 1""")
def l10(t):
    columns = ["entity_id", "canonical_name"]
    known = t.t_entity.select(*columns).unionByName(L.missing_places(t.t_entity).select(*columns))
    return L.link_places(L.distinct_texts(t.t_fact, "location_text"), known)


@query("L11_link_facts", f"""WITH {_DISCOVERED},
e AS (SELECT entity_id, canonical_name FROM fe UNION ALL SELECT sha256('entity|' || text), text FROM tops
  UNION ALL SELECT sha256('entity|' || name), name FROM (VALUES {_PLACE_ROWS}) v(name, kind, pos)),
a AS (SELECT entity_id, alias_name FROM fa UNION ALL SELECT entity_id, text FROM owner),
x AS (SELECT text FROM o), {_linked_sql('x', 'e', 'a', 'lk')},
pl AS (SELECT sha256('entity|全国') AS id)
SELECT f.fact_id, coalesce(s.entity_id, f.subject_entity_id) AS subject_entity_id,
  coalesce(ob.entity_id, f.object_entity_id) AS object_entity_id,
  CASE WHEN location_text = '全国船舶市场' THEN pl.id ELSE location_entity_id END AS location_entity_id
FROM vf f LEFT JOIN lk s ON s.text = f.subject_text LEFT JOIN lk ob ON ob.text = f.object_text, pl
WHERE f.subject_entity_id IS NULL OR f.object_entity_id IS NULL OR f.location_entity_id IS NULL
UNION ALL SELECT fact_id, subject_entity_id, object_entity_id, location_entity_id FROM vf
WHERE subject_entity_id IS NOT NULL AND object_entity_id IS NOT NULL AND location_entity_id IS NOT NULL""")
def l11(t):
    out = L.link_facts(_varied(t), t.t_entity, t.t_alias)
    return out["facts"].select("fact_id", "subject_entity_id", "object_entity_id", "location_entity_id")


_KEY = "replace(replace(replace(lower(trim({0})), ' ', ''), '（', '('), '）', ')')"
_BACKFILL = f"""k AS (SELECT key, max_by(entity_id, (CASE WHEN al THEN 1 ELSE 0 END, entity_id)) AS entity_id FROM (
    SELECT {_KEY.format('canonical_name')} AS key, entity_id, false AS al FROM t_entity
    UNION ALL SELECT {_KEY.format('normalized_name')}, entity_id, false FROM t_entity
    UNION ALL SELECT {_KEY.format('alias_name')}, entity_id, true FROM t_alias) GROUP BY key),
m AS (SELECT fact_id, 'subject' AS role, subject_text AS text FROM t_fact WHERE {APPROVED} AND subject_entity_id IS NULL
  UNION ALL SELECT fact_id, 'object', object_text FROM t_fact WHERE {APPROVED} AND object_entity_id IS NULL AND object_text <> '')"""


@query("L12_backfill_links", f"""WITH {_BACKFILL}
SELECT fact_id, role, entity_id FROM m JOIN k ON k.key = {_KEY.format('text')}""")
def l12(t):
    return L.backfill_links(t.t_fact, t.t_entity, t.t_alias)[0]


@query("L12_unmatched_texts", f"""WITH {_BACKFILL}
SELECT role, text, count(*) AS n FROM m WHERE {_KEY.format('text')} NOT IN (SELECT key FROM k) GROUP BY ALL""")
def l12_unmatched(t):
    return L.backfill_links(t.t_fact, t.t_entity, t.t_alias)[1]


@query("L13_disambiguate", f"""
WITH x AS (SELECT DISTINCT subject_text AS text FROM t_fact),
p AS (SELECT text, text AS canonical_name FROM x UNION SELECT text, {norm_name('text')} FROM x),
h AS (SELECT text, e.* FROM p JOIN t_entity e USING (canonical_name)),
cnt AS (SELECT text, count(*) AS n FROM h GROUP BY text),
g AS (SELECT *, {place('canonical_name')} AS place, {place('text')} AS own FROM h JOIN cnt USING (text))
SELECT text, entity_id, canonical_name, entity_type, place,
  CASE WHEN place IS NOT DISTINCT FROM own THEN CASE WHEN place IS NOT NULL THEN 85e-2 ELSE 75e-2 END ELSE 5e-1 END AS confidence,
  CASE WHEN place IS NOT NULL THEN '括号含地理修饰词''' || place || '''' || CASE WHEN n > 1
      THEN '；另有' || (n - 1) || '个同名实体，需结合上下文判断' ELSE '' END
    WHEN n > 1 THEN '存在' || n || '个同名实体，需结合上下文判断' ELSE '' END AS note, 'require_manual' AS fallback FROM g
UNION ALL SELECT text, NULL, NULL, NULL, NULL, NULL, NULL, 'create_new' FROM x WHERE text NOT IN (SELECT text FROM h)""")
def l13(t):
    names = L.distinct_texts(t.t_fact, "subject_text")
    out = L.disambiguate(names, t.t_entity, t.t_fact, t.t_doc)
    return out.select("text", "entity_id", "canonical_name", "entity_type", "place", "confidence", "note", "fallback")


_ADDS = """ad AS (SELECT DISTINCT 'S' || CAST(s_suppkey AS VARCHAR) AS entity_id, s_name || v AS alias_name FROM supplier,
  (VALUES ('有限公司'), ('股份'), (' ')) t(v))"""


@query("L14_add_aliases", """
WITH ad AS (SELECT 'S' || CAST(s_suppkey AS VARCHAR) AS entity_id, s_name || '有限公司' AS alias_name FROM supplier
  UNION ALL SELECT 'X' || CAST(s_suppkey AS VARCHAR), s_name || '股份' FROM supplier
  UNION ALL SELECT 'N' || CAST(s_nationkey AS VARCHAR), '共用' FROM supplier)
SELECT alias_name, entity_id, CASE WHEN entity_id LIKE 'X%' THEN 'unknown entity'
  WHEN alias_name IN (SELECT alias_name FROM t_alias) THEN 'alias in use' END AS reason FROM ad WHERE alias_name <> '共用'
UNION ALL SELECT '共用', min(entity_id), NULL FROM ad WHERE alias_name = '共用'""")
def l14(t):
    key = F.col("s_suppkey").cast("string")
    row = lambda prefix, k, name: t.supplier.select(F.concat(F.lit(prefix), k).alias("entity_id"), name.alias("alias_name"))
    given = row("S", key, F.concat("s_name", F.lit("有限公司"))).unionByName(
        row("X", key, F.concat("s_name", F.lit("股份")))).unionByName(
        row("N", F.col("s_nationkey").cast("string"), F.lit(" 共用 ")))
    accepted, conflicts = L.add_aliases(t.t_alias, t.t_entity, given)
    cols = ["alias_name", "entity_id"]
    return accepted.select(*cols, F.lit(None).cast("string").alias("reason")).unionByName(conflicts.select(*cols, "reason"))


@query("L14_add_entities", """
SELECT canonical_name, min(entity_id) AS entity_id FROM (SELECT 'Y' || CAST(c_nationkey AS VARCHAR) AS entity_id,
  'NATION_' || CAST(c_nationkey AS VARCHAR) || CASE WHEN c_nationkey > 9 THEN 'x' ELSE '' END AS canonical_name FROM customer)
WHERE canonical_name NOT IN (SELECT canonical_name FROM t_entity WHERE entity_type = '国家') GROUP BY 1""")
def l14_entities(t):
    key = F.col("c_nationkey").cast("string")
    given = t.customer.select(
        F.concat(F.lit("Y"), key).alias("entity_id"), F.lit("国家").alias("entity_type"),
        F.concat(F.lit("NATION_"), key, F.when(F.col("c_nationkey") > 9, "x").otherwise("")).alias("canonical_name"))
    return L.add_entities(t.t_entity, given).select("canonical_name", "entity_id")


@query("L15_rename_entities", """
WITH c AS (SELECT entity_id, '新 ' || canonical_name AS nn FROM t_entity WHERE entity_type = '品牌')
SELECT f.fact_id, subject_text, coalesce(nn, object_text) AS object_text FROM t_fact f LEFT JOIN c ON c.entity_id = f.object_entity_id""")
def l15(t):
    changes = t.t_entity.filter("entity_type = '品牌'").select(
        "entity_id", F.concat(F.lit(" 新 "), "canonical_name").alias("new_name"), F.lit("").alias("new_type"))
    _, facts = L.rename_entities(t.t_entity, t.t_fact, changes)
    return facts.select("fact_id", "subject_text", "object_text")


@query("L15_renamed_entities", """
SELECT entity_id, CASE WHEN entity_type = '品牌' THEN '新 ' || canonical_name ELSE canonical_name END AS canonical_name,
  CASE WHEN entity_type = '品牌' THEN lower('新' || canonical_name) ELSE normalized_name END AS normalized_name,
  CASE WHEN entity_type = '国家' THEN '地区' ELSE entity_type END AS entity_type FROM t_entity""")
def l15_entities(t):
    changes = t.t_entity.filter("entity_type IN ('品牌', '国家')").select(
        "entity_id", F.when(F.col("entity_type") == "品牌", F.concat(F.lit("新 "), "canonical_name")).alias("new_name"),
        F.when(F.col("entity_type") == "国家", "地区").alias("new_type"))
    return L.rename_entities(t.t_entity, t.t_fact, changes)[0]


@query("L16_delete_aliases", "SELECT alias_id, alias_name FROM t_alias WHERE NOT (entity_id LIKE 'V%')")
def l16(t):
    gone = t.t_alias.filter("entity_id LIKE 'V%'").unionByName(
        t.t_alias.filter("entity_id LIKE 'S%'").withColumn("entity_id", F.lit("other")))
    return L.delete_aliases(t.t_alias, gone).select("alias_id", "alias_name")
