"""Predicate rewriting: moves years, places, scopes, products and project names
that were written into a predicate to the fields they belong to."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import keys as K
from factloom.functions.keys import strip
from factloom.functions.text import once

_U = "(?Ud)"
# --- fixed values: patterns, in the order they are applied ----------------
HAN = r"[\x{4e00}-\x{9fff}]"
YEAR = r"^(\d{4}年(?:\d{1,2}月)?)"
AT_PLACE = rf"^(在(?:中国|全球|全国|国内|{HAN}{{2,8}}(?:省|市|区|县|基地|工厂|园区)))"
AT_PLACE_VERB = rf"^在({HAN}{{2,8}})(建厂|建设|投产|设厂|投资|扩产)"
SCOPE = r"^(全球|全国|中国|国内|中国市场)"
BROAD_SCOPE = r"^(全厂|集团全球|全球|国内外|全国)(?=(?:产能|销售|营收|收入|产量|销量))"
FACILITY = (
    rf"^({HAN}{{2,10}}(?:工厂|基地|厂区|园区|公司|分公司|生产基地|新工厂|旧工厂|总部))"
    r"(?=(?:产能|产量|销售|生产效率|一次合格率|年产|设计产能|规划|预计|已形成|为集团|年产值))")
PHASE = r"^((?:一|二|三|四|两|1|2|3|4)期(?:工程)?)(?=(?:年产|产能|已?建成|计划开工|计划投产|投产|完工|项目))"
RANKING = (
    rf"^(位居|排名|位列|名列|跻身|荣获|入选|是)({HAN}+(?:涂料|市场|行业|领域){HAN}*?)的?"
    rf"(第[一二三四五六七八九十\d]+[位名]?|{HAN}*领导者|{HAN}*前列|{HAN}*冠军)$")
PRODUCT = (
    rf"^({HAN}{{2,12}}(?:涂料|涂层|油漆|树脂|颜料|材料|产品))"
    r"(?=产销量|产销|销售量|销量|产量|消费量|出货量|销售额|销售收入|营业收入|营收|收入)")
PRODUCT_CAPACITY = (
    rf"^({HAN}{{2,15}}(?:涂料|涂层|油漆|树脂|颜料|材料|产品))(产能(?:为|达到|增加|增加至|扩大至)?)$")
CONSECUTIVE = r"^(连续\d+年)"
STRAY_BEFORE_YEAR = rf"^{HAN}\d{{4}}年"
PROJECT = (
    r"^(?:投建|计划投资建设|投资建设|拟建|计划建设|实施|扩建|签约落地)?"
    r"([\x{4e00}-\x{9fff}\w（）\(\)]{5,60}(?:项目|工程|工厂|研发中心|基地|园区)(?:[（\(][^）\)]*[）\)])?)"
    r"(计划建设|建设|签约|开工|投产|通过验收|达产|试生产|建成)?$")
NEEDS_VERB = (
    r"^.+(?:产能|收入|销售额|营收|利润|产值|市场规模|市场份额|募集资金净额|营业收入|销售量|产量|消费量)$")
CAPACITY_VERB = "产能为"
PLACE_SYNONYMS = {"全国": "中国", "国内": "中国", "中国": "中国", "全球": "全球"}
SCOPE_SYNONYMS = {"全国": "中国", "国内": "中国", "中国市场": "中国"}

TARGETS = ("report_scope", "phase", "ranking_scope", "product_type", "duration", "project_name")


@dataclass(frozen=True)
class _Prefix:
    """Cut a leading match off the predicate and keep it in ``field`` if that is empty."""
    pattern: str
    field: str
    synonyms: tuple = ()
    overwrite: bool = False


def _synonym(col: Column, pairs: tuple) -> Column:
    for old, new in pairs:
        col = F.when(col == old, new).otherwise(col)
    return col


def _fill(df: DataFrame, field: str, value: Column, hit: Column, overwrite: bool = False) -> Column:
    free = F.lit(True) if overwrite else (F.col(field).isNull() | (F.col(field) == ""))
    return F.when(hit & free, value).otherwise(F.col(field))


def _group(pattern: str, n: int) -> Column:
    return F.regexp_extract("_p", _U + pattern, n)


def _cut_prefix(df: DataFrame, rule: _Prefix) -> DataFrame:
    df = df.withColumn("_m", _group(rule.pattern, 1))
    rest = F.substring(F.col("_p"), F.length("_m") + 1, F.length("_p"))
    hit = (F.col("_m") != "") & (F.length("_p") > F.length("_m"))
    value = F.regexp_replace("_m", "^在", "") if rule.pattern.startswith("^(在") else F.col("_m")
    return df.withColumns({
        rule.field: _fill(df, rule.field, _synonym(value, rule.synonyms), hit, rule.overwrite),
        "_p": F.when(hit, rest).otherwise(F.col("_p")),
    })


def normalize_predicates(facts: DataFrame, location: str = "location_text") -> DataFrame:
    """Rewrite ``predicate`` and fill ``time_expr``, ``location`` and ``qualifier_json``.

    Values already present are kept; only ``duration`` is always overwritten. Qualifiers are
    edited as a map of top-level keys, so nested values stay as they are, and the text is
    untouched where no rule fires; where one does, unreadable text gives way to the new keys.
    """
    df = facts.withColumns({"_map": K.qualifiers(F.col("qualifier_json")), "_p": F.col("predicate")})
    df = df.withColumns({f"_q_{t}": F.try_element_at("_map", F.lit(t)) for t in TARGETS})
    df = df.withColumns({f"_old_{t}": F.col(f"_q_{t}") for t in TARGETS})

    df = _cut_prefix(df, _Prefix(YEAR, "time_expr"))
    df = _cut_prefix(df, _Prefix(AT_PLACE, location, tuple(PLACE_SYNONYMS.items())))
    # a place without an administrative suffix is recognised by the verb that follows
    df = df.withColumns({"_m": _group(AT_PLACE_VERB, 1), "_verb": _group(AT_PLACE_VERB, 2)})
    bare_place = (F.col("_m") != "") & (F.col("_p") == F.col("predicate"))
    df = df.withColumns({
        location: _fill(df, location, F.col("_m"), bare_place),
        "_p": F.when(bare_place, F.col("_verb")).otherwise(F.col("_p"))})
    df = _cut_prefix(df, _Prefix(SCOPE, location, tuple(SCOPE_SYNONYMS.items())))
    df = _cut_prefix(df, _Prefix(BROAD_SCOPE, "_q_report_scope"))
    df = _cut_prefix(df, _Prefix(FACILITY, "_q_report_scope"))
    df = _cut_prefix(df, _Prefix(PHASE, "_q_phase"))

    # a generated column starts a function of its own: a longer one is not compiled by the JVM
    df = df.withColumn("_p", once(F.col("_p")))
    df = df.withColumns({"_m": _group(RANKING, 2), "_verb": F.concat(_group(RANKING, 1), _group(RANKING, 3))})
    ranked = F.col("_m") != ""
    df = df.withColumns({
        "_q_ranking_scope": _fill(df, "_q_ranking_scope", F.col("_m"), ranked),
        "_p": F.when(ranked, F.col("_verb")).otherwise(F.col("_p"))})
    df = _cut_prefix(df, _Prefix(PRODUCT, "_q_product_type"))
    df = df.withColumns({"_m": _group(PRODUCT_CAPACITY, 1), "_verb": _group(PRODUCT_CAPACITY, 2)})
    made = F.col("_m") != ""
    df = df.withColumns({
        "_q_product_type": _fill(df, "_q_product_type", F.col("_m"), made),
        "_p": F.when(made, F.col("_verb")).otherwise(F.col("_p"))})
    df = _cut_prefix(df, _Prefix(CONSECUTIVE, "_q_duration", overwrite=True))

    stray = F.col("_p").rlike(_U + STRAY_BEFORE_YEAR)
    df = df.withColumn("_stray", stray).withColumn(
        "_p", F.when(F.col("_stray"), F.substring(F.col("_p"), F.lit(2), F.length("_p"))).otherwise(F.col("_p")))
    df = df.withColumn("_m", F.when(F.col("_stray"), _group(YEAR, 1)).otherwise(""))
    dated = (F.col("_m") != "") & (F.length("_p") > F.length("_m"))
    df = df.withColumns({
        "time_expr": _fill(df, "time_expr", F.col("_m"), dated),
        "_p": F.when(dated, F.substring(F.col("_p"), F.length("_m") + 1, F.length("_p"))).otherwise(F.col("_p"))})

    df = df.withColumn("_p", once(F.col("_p")))
    df = df.withColumns({
        "_m": _group(PROJECT, 1),
        "_verb": F.coalesce(F.nullif(_group(PROJECT, 2), F.lit("")), F.lit("建设"))})
    df = df.withColumn("_before", F.regexp_replace(
        F.substring(F.col("_p"), F.lit(1), F.greatest(F.expr("instr(_p, _m)") - 1, F.lit(0))),
        r"(?U)\s+\z", ""))
    named = F.col("_m") != ""
    lead = F.when(F.contains("_before", "_verb"), F.col("_before")).otherwise(F.concat("_before", "_verb"))
    planned = F.col("predicate").contains("计划") & ~F.col("_verb").contains("计划")
    alone = F.when(planned, F.concat(F.lit("计划"), "_verb")).otherwise(F.col("_verb"))
    df = df.withColumns({
        "_q_project_name": _fill(df, "_q_project_name", F.col("_m"), named),
        "_p": F.when(named, F.when(F.col("_before") != "", lead).otherwise(alone)).otherwise(F.col("_p"))})

    df = df.withColumn("_p", F.when(F.col("_p").rlike(_U + NEEDS_VERB), F.concat("_p", F.lit("为"))).otherwise(F.col("_p")))
    tail = F.substring(F.col("_p"), F.lit(1), F.greatest(F.length("_p") - len(CAPACITY_VERB), F.lit(0)))
    df = df.withColumn("_m", F.when(
        F.col("_p").endswith(CAPACITY_VERB), strip(F.regexp_replace(tail, r"项目\z", ""))).otherwise(""))
    split = F.col("_m") != ""
    df = df.withColumns({
        "_q_product_type": _fill(df, "_q_product_type", F.col("_m"), split),
        "_p": F.when(split, F.lit(CAPACITY_VERB)).otherwise(F.col("_p"))})

    df = df.withColumns({f"_set_{t}": ~F.col(f"_q_{t}").eqNullSafe(F.col(f"_old_{t}")) for t in TARGETS})
    fired = F.array_except(F.array(*[F.when(F.col(f"_set_{t}"), F.lit(t)) for t in TARGETS]), F.array(F.lit(None).cast("string")))
    added = F.array_compact(F.array(*[F.when(F.col(f"_set_{t}"), F.struct(F.lit(t).alias("key"), F.col(f"_q_{t}").cast("variant").alias("value"))) for t in TARGETS]))
    kept = F.map_filter(K.members(F.col("qualifier_json")), lambda k, _: ~F.array_contains("_fired", k))
    df = df.withColumn("_fired", fired)
    edited = F.when(F.size("_fired") > 0, F.to_json(F.map_concat(kept, F.map_from_entries(added)))).otherwise(F.col("qualifier_json"))
    return df.withColumns({"predicate": F.col("_p"), "qualifier_json": edited}).select(*facts.columns)


def matches_root(fact_type: Column, predicate: Column, roots: dict) -> Column:
    """Whether the predicate contains a known root of its type (monitoring only)."""
    table = F.create_map(*[x for k, v in roots.items() for x in (F.lit(k), F.array(*[F.lit(r) for r in v]))])
    return F.exists(F.coalesce(table[fact_type], F.array().cast("array<string>")), lambda r: predicate.contains(r))


def extra_qualifiers(fact_type: Column, quals: Column, allowed: dict) -> Column:
    """Qualifier keys not expected for the type, sorted (monitoring only)."""
    table = F.create_map(*[x for k, v in allowed.items() for x in (F.lit(k), F.array(*[F.lit(r) for r in v]))])
    return F.sort_array(F.array_except(F.map_keys(quals), F.coalesce(table[fact_type], F.map_keys(quals))))
