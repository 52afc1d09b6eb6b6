"""Data-quality reports and clean-up jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom import config as C
from factloom.functions import keys as K
from factloom.functions.predicates import normalize_predicates
from factloom.functions.text import once
from factloom.operators.common import approved, contained_in, fold_ascii, label, role_union
from factloom.operators.reports import cost, count_by, like

# --- fixed values: clean-up rules -----------------------------------------
QUALIFIER_RENAMES = {"change_percentage_points": "change_pct", "product": "product_type"}
QUALIFIER_REMOVALS = ("change_amount_unit", "growth_description", "proportion_of_business")
UNIT_CURRENCY = {
    "亿元": "CNY", "万元": "CNY", "元": "CNY", "元/吨": "CNY", "亿日元": "JPY", "亿美元": "USD", "亿港元": "HKD", "亿欧元": "EUR"}
UNIT_FIXES = {"亿": "亿元"}
VALUELESS_TYPES = ("YES_NO", "QUALITY_ASSESSMENT")
PLACE_TYPES = ("REGION", "COUNTRY")
PRONOUNS = ("该公司", "其", "本公司", "公司")
MONEY_WORDS = ("元", "美元", "港元", "日元")
RANKING_CONTEXT = ("ranking_name", "ranking_scope", "segment")
# --- fixed values: patterns a rewritten predicate must not show -----------
BAD_PREDICATES = (
    (r"^\d{4}年", "包含年份前缀"),
    (r"^在[\x{4e00}-\x{9fff}]+", "包含'在X'地域前缀"),
    (r"^(全球|全国|中国|国内|中国市场)", "包含地域前缀"),
    (r"^[\x{4e00}-\x{9fff}]{2,}(?:工厂|基地|园区|厂区)(?=(?:产能|产量|销售|生产效率|合格率|年产|预计|规划|已形成|年产值))", "包含设施名"),
    (r"^(?:一|二|三|两)\s*期", "包含阶段前缀"),
    (r"项目$", "以'项目'结尾"),
    (r"连续\d+年", "包含'连续X年'"),
    (r"[\x{4e00}-\x{9fff}]+涂料(?:销售|产|消费)", "包含产品类型前缀"),
)


def _blank(name: str) -> Column:
    return F.col(name).isNull() | (F.col(name) == "")


def _rate(hit: Column) -> Column:
    """Share of rows in percent, one decimal, 0 for an empty table."""
    return F.coalesce(F.round(F.count_if(hit) * 100.0 / F.nullif(F.count("*"), F.lit(0)), 1), F.lit(0.0))


def confidence_stats(facts: DataFrame) -> DataFrame:
    c = F.col("confidence_score")
    zero = lambda x: F.round(F.coalesce(x, F.lit(0.0)), 3)
    return facts.agg(
        zero(F.avg(c)).alias("average"), zero(F.min(c)).alias("minimum"), zero(F.max(c)).alias("maximum"),
        F.count_if(c < 0.5).alias("low_count"), F.count_if(c >= 0.9).alias("high_count"))


def confidence_buckets(facts: DataFrame) -> DataFrame:
    c = F.col("confidence_score")
    bucket = F.when(c < 0.3, "0-0.3").when(c < 0.5, "0.3-0.5").when(c < 0.7, "0.5-0.7").when(c < 0.9, "0.7-0.9").otherwise("0.9-1.0")
    return count_by(facts.select(bucket.alias("bucket")), "bucket")


def bad_json(name: str = "qualifier_json") -> Column:
    text = F.col(name)
    return text.isNotNull() & (text != "") & F.try_parse_json(text).isNull()


def quality_issues(facts: DataFrame, as_of: str) -> DataFrame:
    """Issue counters. Time labels are compared as text with ``as_of`` (yyyy-mm-dd);
    a key with a missing part counts as a duplicate, as the joined text is NULL."""
    key = F.concat(F.col("document_id").cast("string"), F.lit("|"), "fact_type", F.lit("|"), "predicate", F.lit("|"), "subject_text")
    c = F.col("confidence_score")
    return facts.agg(
        F.count_if(_blank("subject_text")).alias("empty_subject"), F.count_if(_blank("predicate")).alias("empty_predicate"),
        F.count_if(_blank("object_text") & F.col("value_num").isNull() & ~F.col("fact_type").isin(*VALUELESS_TYPES)).alias("no_value"),
        F.count_if(~_blank("time_expr") & (F.col("time_expr") > as_of)).alias("future_time"),
        F.count_if(c.isNull() | (c < 0) | (c > 1)).alias("bad_confidence"),
        (F.count("*") - F.countDistinct(key)).alias("duplicates"), F.count_if(bad_json()).alias("bad_json"))


def link_stats(facts: DataFrame) -> DataFrame:
    s, o = F.col("subject_entity_id").isNotNull(), F.col("object_entity_id").isNotNull()
    return facts.agg(F.count("*").alias("total"), F.count_if(s).alias("subject_linked"), _rate(s).alias("subject_rate"),
                     F.count_if(o).alias("object_linked"), _rate(o).alias("object_rate"))


def duplicate_groups(facts: DataFrame) -> DataFrame:
    keys = ["fact_type", "subject_text", "predicate", "object_text"]
    return count_by(facts.filter(F.col("review_status") != C.REJECTED), *keys).filter("n > 1")


def fill_rates(facts: DataFrame) -> DataFrame:
    """Link rates of the three roles and empty rates of three fields, in percent."""
    links = {f"{r}_linked": F.col(f"{r}_entity_id").isNotNull() for r in ("subject", "object", "location")}
    empties = {f"{n}_empty": _blank(c) for n, c in (("time", "time_expr"), ("location", "location_text"), ("currency", "currency"))}
    return facts.agg(*[_rate(v).alias(k) for k, v in {**links, **empties}.items()], F.count("*").alias("total"))


def unit_histogram(facts: DataFrame) -> DataFrame:
    return count_by(facts.filter(~_blank("unit")), "unit")


def value_samples(facts: DataFrame, column: str, n: int = 20) -> DataFrame:
    """Some distinct values of a column (the smallest, so the sample is stable)."""
    return facts.filter(~_blank(column)).select(F.col(column).alias("value")).distinct().orderBy("value").limit(n)


def _severity(high: Column, medium: Column) -> Column:
    return F.when(high, "high").when(medium, "medium").otherwise("low")


def check_entity_types(entities: DataFrame) -> DataFrame:
    unknown = F.count_if(F.col("entity_type") == "UNKNOWN")
    out = entities.agg(F.count("*").alias("total"), unknown.alias("unknown"))
    return out.select("total", "unknown", F.coalesce(F.round(F.col("unknown") * 100.0 / F.nullif("total", F.lit(0)), 1), F.lit(0.0)).alias("unknown_pct"),
                      _severity(F.col("unknown") > F.col("total") * 0.2, F.col("unknown") > F.col("total") * 0.1).alias("severity"))


def unknown_with_facts(facts: DataFrame, entities: DataFrame, n: int = 15) -> DataFrame:
    counts = count_by(role_union(facts), "entity_id", name="fact_count")
    return entities.filter("entity_type = 'UNKNOWN'").join(counts, "entity_id").select("entity_id", "canonical_name", "fact_count") \
        .orderBy(F.desc("fact_count"), "entity_id").limit(n)


def check_facts(facts: DataFrame, evidence: DataFrame) -> DataFrame:
    texts = evidence.select("evidence_id", "evidence_text")
    live = F.col("review_status").isin(*C.APPROVED)
    out = facts.join(texts, "evidence_id", "left").agg(
        F.count("*").alias("total"), F.count_if(_blank("subject_text")).alias("missing_subject"),
        F.count_if(_blank("predicate")).alias("missing_predicate"), F.count_if(_blank("time_expr") & live).alias("missing_time"),
        F.count_if(_blank("evidence_text") & live).alias("missing_evidence"))
    bad = (F.col("missing_subject") > 0) | (F.col("missing_predicate") > 0) | (F.col("missing_time") > 5) | (F.col("missing_evidence") > 0)
    return out.withColumn("severity", F.when(bad, "high").otherwise("low"))


def check_links(facts: DataFrame, entities: DataFrame, aliases: DataFrame) -> DataFrame:
    live = approved(facts)
    used = role_union(facts).select("entity_id").distinct()
    orphans = entities.join(used, "entity_id", "left_anti").agg(F.count("*"))
    bare = entities.join(aliases.select("entity_id"), "entity_id", "left_anti").agg(F.count("*"))
    out = live.agg(
        F.count("*").alias("approved"), F.count_if(F.col("subject_entity_id").isNull()).alias("no_subject_link"),
        F.count_if(F.col("object_entity_id").isNull() & ~_blank("object_text")).alias("no_object_link")).withColumns({
            "orphans": orphans.scalar(), "no_alias": bare.scalar(), "total_entities": entities.agg(F.count("*")).scalar()})
    some = (F.col("no_subject_link") > 0) | (F.col("no_object_link") > 0) | (F.col("orphans") > F.col("total_entities") * 0.3)
    return out.withColumn("severity", _severity(F.col("no_subject_link") > 10, some))


def check_relations(relations: DataFrame, suggestions: DataFrame, tasks: DataFrame) -> DataFrame:
    pending = lambda df: df.filter(F.col("status") == C.PENDING).agg(F.count("*")).scalar()
    out = relations.agg(F.count("*").alias("relations")).withColumns({
        "suggestions": suggestions.agg(F.count("*")).scalar(), "pending_suggestions": pending(suggestions), "pending_merges": pending(tasks)})
    return out.withColumn("severity", _severity(
        F.col("relations") == 0, (F.col("pending_suggestions") > 0) | (F.col("pending_merges") > 0)))


def same_name_types(entities: DataFrame) -> DataFrame:
    """Names stored under several types; (name, type) is unique, so lists stay short."""
    return entities.groupBy("canonical_name").agg(
        F.array_join(F.array_sort(F.collect_set("entity_type")), ",").alias("types"), F.count("*").alias("n")).filter("n > 1")


def contained_names(entities: DataFrame, limit: int | None = None) -> DataFrame:
    """Entity pairs, places aside, whose names contain one another."""
    rows = entities.filter(~F.col("entity_type").isin(*PLACE_TYPES) & (F.length("canonical_name") >= 2)).select(
        "entity_id", "canonical_name", fold_ascii(F.col("canonical_name")).alias("f"))
    names = rows.select("f").distinct()
    met = contained_in(names, names.select(F.col("f").alias("g")), "f", "g")
    side = lambda i, n, k: rows.select(F.col("entity_id").alias(i), F.col("canonical_name").alias(n), F.col("f").alias(k))
    pairs = met.join(side("x", "nx", "f"), "f").join(side("y", "ny", "g"), "g").filter("x <> y")
    first = F.col("x") < F.col("y")
    out = pairs.select(F.least("x", "y").alias("a_id"), F.greatest("x", "y").alias("b_id"),
                       F.when(first, F.col("nx")).otherwise(F.col("ny")).alias("name_a"),
                       F.when(first, F.col("ny")).otherwise(F.col("nx")).alias("name_b")).distinct()
    return out.orderBy("a_id", "b_id").limit(limit) if limit is not None else out


def check_duplicates(entities: DataFrame) -> DataFrame:
    out = same_name_types(entities).agg(F.count("*").alias("same_name")).withColumn(
        "contained", contained_names(entities).agg(F.count("*")).scalar())
    return out.withColumn("severity", F.when((F.col("same_name") > 0) | (F.col("contained") > 5), "medium").otherwise("low"))


def overall(severities: list[DataFrame]) -> DataFrame:
    """One verdict over the severities of all checks."""
    stacked = severities[0].select("severity")
    for df in severities[1:]:
        stacked = stacked.unionByName(df.select("severity"))
    return stacked.agg(F.when(F.bool_or(F.col("severity") == "high"), "需要关注").when(
        F.bool_or(F.col("severity") == "medium"), "基本正常").otherwise("健康").alias("overall"))


def facts_per_evidence(facts: DataFrame) -> DataFrame:
    return count_by(count_by(facts, "evidence_id", name="fact_count"), "fact_count", name="evidence_count")


def batching_saving(facts: DataFrame) -> DataFrame:
    out = count_by(facts, "evidence_id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("single_calls"), F.count("*").alias("batched_calls"))
    saved = F.col("single_calls") - F.col("batched_calls")
    return out.withColumns({"saved": saved, "saved_pct": F.round(saved * 100.0 / F.nullif("single_calls", F.lit(0)), 0)})


def stage_efficiency(tasks: DataFrame) -> DataFrame:
    """Successful calls per stage with token sums, truncated averages and cost."""
    done = tasks.filter(F.col("status") == C.TASK_OK)
    return done.groupBy("task_type").agg(
        F.count("*").alias("calls"), F.sum("input_tokens").alias("total_in"), F.sum("output_tokens").alias("total_out"),
        F.floor(F.avg("input_tokens")).alias("avg_in"), F.floor(F.avg("output_tokens")).alias("avg_out")).withColumn(
        "cost", cost(F.col("total_in"), F.col("total_out")))


def tokens_per_fact(tasks: DataFrame, facts: DataFrame) -> DataFrame:
    total = tasks.filter(F.col("status") == C.TASK_OK).agg(F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("tokens"))
    return total.withColumn("facts", facts.agg(F.count("*")).scalar()).withColumn(
        "tokens_per_fact", F.round(F.col("tokens") / F.nullif("facts", F.lit(0)), 0))


def stage_details(tasks: DataFrame, task_type: str) -> DataFrame:
    return tasks.filter((F.col("status") == C.TASK_OK) & (F.col("task_type") == task_type)).select(
        "task_id", "started_at", "input_tokens", "output_tokens").orderBy("started_at", "task_id")


def object_link_breakdown(facts: DataFrame) -> DataFrame:
    linked = F.col("object_entity_id").isNotNull()
    return approved(facts).agg(
        F.count_if(linked).alias("linked"), F.count_if(~linked & ~_blank("object_text")).alias("text_only"),
        F.count_if(_blank("object_text")).alias("no_object"))


def unlinked_texts(facts: DataFrame, role: str = "object", n: int = 20) -> DataFrame:
    text = f"{role}_text"
    loose = approved(facts).filter(F.col(f"{role}_entity_id").isNull() & ~_blank(text))
    return count_by(loose, text).orderBy(F.desc("n"), text).limit(n)


def keyword_links(facts: DataFrame, keyword: str) -> DataFrame:
    return approved(facts).filter(like("subject_text", keyword)).groupBy("subject_text").agg(
        F.count("*").alias("n"), F.count("subject_entity_id").alias("linked"))


def mentions(keywords: tuple[str, ...]) -> Column:
    hit = F.lit(False)
    for word in keywords:
        hit = hit | F.coalesce(like("subject_text", word), F.lit(False)) | F.coalesce(like("object_text", word), F.lit(False))
    return hit


def keyword_slice(facts: DataFrame, keywords: tuple[str, ...]) -> dict[str, DataFrame]:
    """Facts mentioning a keyword: by state with mean confidence, by type, rejections, duplicates."""
    found = facts.filter(mentions(keywords))
    return {
        "facts": found,
        "status": found.groupBy("review_status").agg(F.count("*").alias("n"), F.avg("confidence_score").alias("avg_score")),
        "types": count_by(found.filter(F.col("review_status") == C.AUTO_PASS), "fact_type"),
        "rejected": found.filter(F.col("review_status").isin(C.REJECTED, C.HUMAN_REJECTED)),
        "duplicates": found.filter(F.col("review_status") == C.DUPLICATE),
    }


def keyword_documents(docs: DataFrame, keyword: str) -> DataFrame:
    return docs.filter(F.coalesce(like("raw_text", keyword), F.lit(False)) | F.coalesce(like("title", keyword), F.lit(False)))


def known_name_matches(facts: DataFrame, entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """Unlinked approved subjects with the known names that contain them or lie inside."""
    texts = approved(facts).filter(F.col("subject_entity_id").isNull() & ~_blank("subject_text")).select(
        F.col("subject_text").alias("text"), fold_ascii(F.col("subject_text")).alias("tf")).distinct()
    names = entities.select(F.col("canonical_name").alias("name")).unionByName(
        aliases.select(F.col("alias_name").alias("name"))).distinct().withColumn("nf", fold_ascii(F.col("name")))
    both = contained_in(texts, names, "tf", "nf", 1).select("text", "name").unionByName(
        contained_in(names, texts, "nf", "tf", 1).select("text", "name"))
    return both.distinct()


def lint(facts: DataFrame) -> DataFrame:
    """Add ``issues``: what a reviewer would object to, as a list of labels."""
    pred = F.coalesce("predicate", F.lit(""))
    q = K.qualifiers(F.col("qualifier_json"))
    context = F.lit(False)
    for key in RANKING_CONTEXT:
        context = context | (F.coalesce(F.try_element_at(q, F.lit(key)), F.lit("")) != "")
    has_number = F.col("value_num").isNotNull()
    money = F.coalesce(F.col("unit").rlike("|".join(MONEY_WORDS)), F.lit(False))
    checks = [(pred.rlike("(?U)" + pattern), name) for pattern, name in BAD_PREDICATES] + [
        (_blank("subject_text"), "缺少 subject"), (pred == "", "缺少 predicate"),
        (F.col("subject_text").isin(*PRONOUNS), "subject 是代词"),
        ((F.col("fact_type") == "FINANCIAL_METRIC") & has_number & _blank("currency") & money, "缺少 currency"),
        ((F.col("fact_type") == "COMPETITIVE_RANKING") & ~context, "缺少上下文限定词"),
        (has_number & _blank("value_text"), "缺少 value_text")]
    # array_compact takes a lambda, and what stands in one row with a lambda is interpreted
    return facts.withColumn("issues", F.array_except(F.array(*[F.when(c, name) for c, name in checks]), F.array(F.lit(None).cast("string"))))


def lint_before_after(facts: DataFrame) -> DataFrame:
    """Per fact: outcome of predicate rewriting as fixed, still bad, or already good."""
    before = lint(facts).withColumnRenamed("issues", "issues_before")
    after = lint(normalize_predicates(before)).withColumnRenamed("issues", "issues_after")
    bad, rest = F.size("issues_before") > 0, F.size("issues_after") > 0
    return after.withColumn("outcome", F.when(bad & ~rest, "fixed").when(bad, "still bad").otherwise("already good"))


def clean_qualifiers(facts: DataFrame) -> DataFrame:
    """Rename two top-level qualifier keys (an existing target wins) and drop three.

    Values keep their JSON types and nested objects are not looked into. Text that
    isn't an object, or has none of the keys, is left as it is.
    """
    removed = F.array(*[F.lit(k) for k in QUALIFIER_REMOVALS])
    keys = F.map_keys("_members")

    def target(key: Column) -> Column:
        new = key
        for old, name in QUALIFIER_RENAMES.items():
            new = F.when(key == old, F.lit(name)).otherwise(new)
        return new

    entries = F.filter(F.map_entries("_members"), lambda e: ~F.array_contains(removed, e["key"]) & (
        ~e["key"].isin(*QUALIFIER_RENAMES) | ~F.array_contains(keys, target(e["key"]))))
    renamed = F.map_from_entries(F.transform(entries, lambda e: F.struct(target(e["key"]).alias("key"), e["value"].alias("value"))))
    touched = F.arrays_overlap(keys, F.array(*[F.lit(k) for k in (*QUALIFIER_RENAMES, *QUALIFIER_REMOVALS)]))
    # generated columns: the text is parsed once a row, and what is built on the result doesn't repeat it
    parsed = facts.withColumn("qualifier_json", once(F.col("qualifier_json"))).withColumn("_members", once(K.members(F.col("qualifier_json"))))
    return parsed.withColumn("qualifier_json", once(F.when(touched, F.to_json(renamed)).otherwise(F.col("qualifier_json")))).select(*facts.columns)


def fill_currency(facts: DataFrame) -> DataFrame:
    """Currency from the unit where none is given."""
    known = label(F.col("unit"), UNIT_CURRENCY, F.lit(None).cast("string"))
    return facts.withColumn("currency", F.when(_blank("currency"), F.coalesce(known, "currency")).otherwise(F.col("currency")))


def fix_units(facts: DataFrame) -> DataFrame:
    return facts.withColumn("unit", label(F.col("unit"), UNIT_FIXES))


def migrate_vocabulary(df: DataFrame, table: str) -> DataFrame:
    """Replace old codes of every mapped column of a table."""
    mapped = {column: values for (name, column), values in C.VOCABULARY.items() if name == table and column in df.columns}
    return df.withColumns({column: label(F.col(column), values) for column, values in mapped.items()})


def vocabulary_counts(df: DataFrame, table: str) -> DataFrame:
    """How many rows each old code would change: (column_name, old_value, n)."""
    mapped = {column: values for (name, column), values in C.VOCABULARY.items() if name == table and column in df.columns}
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.when(F.col(c).isin(*v), F.col(c)).alias("old_value")) for c, v in mapped.items()])
    rows = df.select(F.explode(cells).alias("x")).select("x.*").filter(F.col("old_value").isNotNull())
    return count_by(rows, "column_name", "old_value")
