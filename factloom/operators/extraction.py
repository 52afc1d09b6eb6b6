"""Requests to the external extraction model and ingestion of its answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom import config as C
from factloom.functions import keys as K
from factloom.functions.jsontext import with_answer_json
from factloom.functions.predicates import extra_qualifiers, matches_root
from factloom.functions.text import once
from factloom.operators.common import number_in_group, top_per_key

# --- fixed values: positions of a list-form record ------------------------
RECORD_FIELDS = (
    "fact_type", "subject", "predicate", "object", "value_num", "value_text", "unit",
    "currency", "time_expr", "location", "qualifiers", "confidence", "evidence_text")
SUBJECT_METRIC_SUFFIXES = (
    "完工量", "订单量", "交付量", "产量", "销售量", "消费量", "出货量", "保有量", "增长量", "需求量")
SUBJECT_METRIC_NAMES = ("市场规模", "行业规模", "市场容量")


def _request(df: DataFrame, key: Column, extra: dict[str, Column] | None = None, **fields: Column) -> DataFrame:
    """Request id and JSON body per row; absent values become empty strings."""
    body = F.struct(*[F.coalesce(v, F.lit("")).alias(k) for k, v in fields.items()])
    return df.select("document_id", F.sha2(key, 256).alias("request_id"), F.to_json(body).alias("body"),
                     *[v.alias(k) for k, v in (extra or {}).items()])


def _document_fields() -> dict[str, Column]:
    return {"document_title": F.col("title"), "document_source": F.col("source_name"),
            "document_publish_time": F.col("publish_time")}


def evidence_requests(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """One request per chunk, with its document's metadata."""
    joined = chunks.join(docs.select("document_id", "title", "source_name", "publish_time"), "document_id")
    return _request(joined, F.concat_ws("|", F.lit("evidence"), "chunk_id"),
                    **_document_fields(), chunk_text=F.col("chunk_text"))


def fact_requests(evidence: DataFrame, docs: DataFrame, rules: DataFrame, base_prompt: str) -> DataFrame:
    """One request per evidence; ``rules`` (fact_type, rule_text) extends the prompt by type."""
    joined = (evidence.join(docs.select("document_id", "title", "source_name", "publish_time"), "document_id")
              .join(rules, "fact_type", "left"))
    return _request(
        joined, F.concat_ws("|", F.lit("fact"), "evidence_id"),
        {"prompt": F.concat_ws("\n\n", F.lit(base_prompt), F.nullif("rule_text", F.lit("")))},
        **_document_fields(), fact_type=F.col("fact_type"), evidence_text=F.col("evidence_text"))


def full_text_prompt(base: str, rules: DataFrame) -> DataFrame:
    """The one-row prompt: base text, then the rule texts sorted by type.

    ``rules`` holds one row per fact type. The known entities follow as the lines of
    ``relations.known_entity_lines``: they stay a table, as they grow with the data.
    """
    texts = F.transform(F.sort_array(F.collect_list(F.struct("fact_type", "rule_text"))), lambda r: r["rule_text"])
    ruled = rules.agg(F.array_join(texts, "\n\n").alias("rules"))
    return ruled.select(F.concat_ws(
        "\n\n", F.lit(base),
        F.when(F.col("rules") != "", F.concat(F.lit("## Fact-type specific rules\n\n"), "rules"))).alias("prompt"))


def full_text_requests(docs: DataFrame, text: str = "clean_text") -> DataFrame:
    """One whole-article request per document; the shared prompt is sent once, beside them."""
    return _request(docs, F.concat_ws("|", F.lit("full"), "document_id"),
                    **_document_fields(), article_text=F.col(text))


def completion_requests(facts: DataFrame, articles: DataFrame, per_request: int = 200) -> DataFrame:
    """Second-pass requests: the article with its facts by type.

    A document with more than ``per_request`` facts gets several requests, so no
    document is gathered whole in one task. The first carries the article, the others name it.
    """
    numbered = number_in_group(facts, ["document_id"], "fact_id").withColumn(
        "part", F.floor((F.col("rn") - 1) / per_request).cast("int"))
    record = F.struct(
        F.col("subject_text").alias("subject"), "predicate", F.col("object_text").alias("object"), "value_num",
        "value_text", "unit", "currency", "time_expr", F.col("location_text").alias("location"), "evidence_text")
    typed = numbered.groupBy("document_id", "part", "fact_type").agg(
        F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct(F.col("fact_id").alias("k"), record.alias("r")))).alias("rows"))
    parts = typed.groupBy("document_id", "part").agg(
        F.sum("n").alias("n_facts"), F.count("*").alias("n_types"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct(
            "fact_type", F.transform("rows", lambda x: x["r"]))))).alias("by_type"))
    return parts.join(articles, "document_id").select(
        "document_id", "part", "n_facts", "n_types",
        F.to_json(F.struct(F.col("document_id").alias("article"), F.when(F.col("part") == 0, F.col("article_text")).alias("article_text"), F.col("by_type").alias("all_extracted_facts_by_type"))).alias("body"))


def parse_answers(responses: DataFrame) -> DataFrame:
    """Add ``json`` (NULL when nothing readable was found) to (request_id, content, ...)."""
    return with_answer_json(responses)


def unparsed(answers: DataFrame) -> DataFrame:
    return answers.filter(F.col("json").isNull()).withColumn("reason", F.lit("no JSON found"))


def _typed_items(answers: DataFrame) -> DataFrame:
    """Raw record texts of both answer forms with their order and forced type."""
    grouped = F.map_entries(F.from_json("json", "map<string,string>"))
    bare = F.array(F.struct(F.lit(None).cast("string").alias("key"), F.col("json").alias("value")))
    groups = F.when(F.col("json").startswith("{"), grouped).otherwise(bare)
    # generated columns, outer: no filter is derived from them or pushed below them, so each text is parsed once
    items = F.try_parse_json("g.value").try_cast("array<variant>")
    return (
        answers.select("request_id", "document_id", F.posexplode_outer(groups).alias("p1", "g"))
        .filter(F.col("g.value").startswith("["))
        .select("request_id", "document_id", "p1", "g.key", F.posexplode_outer(items).alias("p2", "item"))
    )


_NUMBER = r"^(?:TINYINT|SMALLINT|INT|BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"


def shape_records(answers: DataFrame) -> DataFrame:
    """Model records as columns: 13 fields from objects or positional lists.

    Both forms become one array of 13 values first. Lists shorter than 13 are
    dropped; the group name overrides an object's type.
    """
    named = F.array(*[F.try_variant_get("item", f"$.{name}", "variant") for name in RECORD_FIELDS])
    listed = F.col("item").try_cast("array<variant>")
    is_list = F.col("listed").isNotNull()
    fields = F.when(is_list, F.when(F.size("listed") >= len(RECORD_FIELDS), F.col("listed"))).when(
        F.schema_of_variant("item").startswith("OBJECT"), named)
    items = (
        _typed_items(answers)
        .withColumn("listed", F.explode_outer(F.array(listed)))
        .withColumn("f", F.explode_outer(F.array(fields))).filter("f is not null")
    )
    at = {name: F.col("f")[i] for i, name in enumerate(RECORD_FIELDS)}
    text = lambda name: at[name].try_cast("string")
    kind_of = F.schema_of_variant(at["confidence"])
    inner = [F.try_variant_get(at["confidence"], f"$.{k}", "variant") for k in ("score", "value", "confidence")]
    from_object = F.coalesce(*[F.when(F.schema_of_variant(x).rlike(_NUMBER), x.try_cast("double")) for x in inner])
    confidence = F.when(kind_of.rlike(_NUMBER), at["confidence"].try_cast("double")).when(kind_of.startswith("OBJECT"), from_object)
    own_type = F.when(is_list, text("fact_type")).otherwise(F.coalesce("key", text("fact_type")))
    return items.select(
        "request_id", "document_id",
        (F.col("p1").cast("bigint") * F.lit(2 ** 31) + F.col("p2")).alias("ord"),
        own_type.alias("fact_type"),
        F.nullif(K.strip(text("subject")), F.lit("")).alias("subject_text"),
        F.nullif(text("predicate"), F.lit("")).alias("predicate"),
        text("object").alias("object_text"),
        text("value_num").try_cast("double").alias("value_num"),
        *[text(f).alias(f) for f in ("value_text", "unit", "currency", "time_expr")],
        text("location").alias("location_text"),
        F.when(F.schema_of_variant(at["qualifiers"]).startswith("OBJECT"), F.to_json(at["qualifiers"])).otherwise(F.lit("{}")).alias("qualifier_json"),
        F.coalesce(confidence, F.lit(0.0)).alias("confidence_score"),
        F.coalesce(text("evidence_text"), F.lit("")).alias("evidence_text"))


def _judged(df: DataFrame, rules: list[tuple[Column, str]]) -> DataFrame:
    """Add ``reject_reason``: the first rule that holds, else NULL. Rules see the trimmed subject as ``_subject``.

    The reason is a generated column, so no filter on it states all rules again.
    """
    reason = F.coalesce(*[F.when(cond, F.lit(why)) for cond, why in rules])
    return df.withColumn("_subject", K.strip(F.col("subject_text"))).withColumn("reject_reason", once(reason)).drop("_subject")


def _reject(judged: DataFrame) -> tuple[DataFrame, DataFrame]:
    return (judged.filter(F.col("reject_reason").isNull()).drop("reject_reason"),
            judged.filter(F.col("reject_reason").isNotNull()))


def _common_rules() -> list[tuple[Column, str]]:
    return [
        (F.col("predicate").isNull() | (F.col("predicate") == ""), "no predicate"),
        (F.col("_subject").isNull() | (F.col("_subject") == ""), "no subject"),
        (F.col("fact_type").isNull() | ~F.col("fact_type").isin(*C.FACT_TYPES), "unknown type"),
    ]


def validate_records(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid records, rejected ones with the first reason) of whole-article answers."""
    return _reject(_judged(records, _common_rules()))


def judged_evidence_records(records: DataFrame) -> DataFrame:
    """Per-evidence answers with their ``reject_reason``, NULL where valid: metric words are no subjects either."""
    rules = _common_rules()
    subject = F.col("_subject")
    metric = subject.rlike("(?:" + "|".join(SUBJECT_METRIC_SUFFIXES) + r")\z")
    rules[2:2] = [(metric, "metric as subject"), (subject.isin(*SUBJECT_METRIC_NAMES), "statistic as subject")]
    return _judged(records, rules)


def validate_evidence_records(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid records, rejected ones with the first reason) of per-evidence answers."""
    return _reject(judged_evidence_records(records))


def monitor_vocabulary(facts: DataFrame) -> DataFrame:
    """Flags for predicates outside the known roots and unexpected qualifier keys."""
    quals = K.qualifiers(F.col("qualifier_json"))
    return facts.withColumns({
        "known_predicate": matches_root(F.col("fact_type"), F.col("predicate"), C.PREDICATE_ROOTS),
        "extra_qualifiers": F.array_join(extra_qualifiers(F.col("fact_type"), quals, C.QUALIFIER_KEYS), ","),
    })


def ingest_evidence(answers: DataFrame, existing: DataFrame) -> DataFrame:
    """New evidence spans of discovery answers (request_id, document_id, chunk_id, json)."""
    body = F.from_json("json", "has_fact boolean, candidates array<struct<evidence_text:string,fact_type:string,priority:string>>")
    rows = (
        answers.withColumn("_b", once(body)).filter(F.col("_b.has_fact"))
        .select("request_id", "document_id", "chunk_id", F.posexplode_outer("_b.candidates").alias("ord", "c"))
        .select("request_id", "document_id", "chunk_id", "ord", "c.evidence_text", "c.fact_type",
                F.coalesce("c.priority", F.lit("medium")).alias("priority"))
        .filter((F.col("evidence_text") != "") & F.col("fact_type").isin(*C.FACT_TYPES))
    )
    key = ["document_id", "fact_type", "evidence_text"]
    first = top_per_key(rows, key, [F.col("request_id"), F.col("ord")])
    taken = existing.select(*key)
    return first.join(taken, key, "left_anti").withColumn(
        "evidence_id", evidence_key()).select("evidence_id", "document_id", "chunk_id", *key[1:], "priority")


def evidence_key() -> Column:
    return F.sha2(F.concat_ws("|", "document_id", "fact_type", "evidence_text"), 256)


def merge_completion(stage1: DataFrame, supplements: DataFrame) -> DataFrame:
    """Second-pass merge per (document, type).

    ``supplements`` carries ``form``: 'object' items are added when their evidence
    is new, 'list' items replace the type's facts. Types unknown to the first pass
    are ignored.
    """
    group = ["document_id", "fact_type"]
    known = stage1.select(*group).distinct()
    asked = supplements.join(known, group, "left_semi")
    replaced = asked.filter("form = 'list'").select(*group).distinct()
    base = stage1.join(replaced, group, "left_anti")
    full = asked.filter("form = 'list'")
    text = [*group, "evidence_text"]
    added = top_per_key(asked.filter("form = 'object'"), text, [F.col("ord")])
    added = added.join(stage1.select(*text).distinct(), text, "left_anti")
    columns = stage1.columns
    return base.unionByName(full.select(*columns)).unionByName(added.select(*columns))


def record_key() -> dict[str, Column]:
    """What records of one document share that repeat each other."""
    disc = K.discriminator(F.col("fact_type"), K.qualifiers(F.col("qualifier_json")), F.col("predicate"), F.col("object_text"))
    text = lambda c: F.lower(K.strip(F.coalesce(F.col(c), F.lit(""))))
    return {"document_id": F.col("document_id"), "_t": text("fact_type"), "_s": text("subject_text"), "_d": disc, "_v": F.nullif("value_num", F.lit(0.0)), "_w": text("time_expr")}


def dedup_records(records: DataFrame, *then: Column) -> DataFrame:
    """Repeats inside one document's answer: the most confident wins, then the first, then what comes first by ``then``."""
    key = record_key()
    own = [n for n in key if n.startswith("_")]
    order = [F.desc(F.coalesce("confidence_score", F.lit(0.0))), F.col("ord"), *then]
    return top_per_key(records.withColumns({n: key[n] for n in own}), list(key), order).drop(*own)


def assemble_facts(records: DataFrame, existing_evidence: DataFrame, model: Column,
                   version: str = "v2.0") -> tuple[DataFrame, DataFrame]:
    """(facts, new evidence spans). Records without evidence are skipped; evidence is
    shared per (document, type, text), with ids already stored or derived from the key."""
    key = ["document_id", "fact_type", "evidence_text"]
    usable = records.filter(F.col("evidence_text") != "")
    stored = existing_evidence.select(*key, F.col("evidence_id").alias("_stored"))
    spans = usable.select(*key).distinct().join(stored, key, "left").withColumn(
        "evidence_id", F.coalesce("_stored", evidence_key()))
    fresh = spans.filter(F.col("_stored").isNull()).select("evidence_id", *key, F.lit("high").alias("priority"))
    facts = usable.join(spans.select(*key, "evidence_id"), key).withColumns({
        "fact_id": F.sha2(F.concat_ws("|", "evidence_id", "request_id", F.col("ord").cast("string")), 256),
        "extraction_model": model, "extraction_version": F.lit(version), "review_status": F.lit(C.PENDING)})
    return facts, fresh


def call_log(requests: DataFrame, responses: DataFrame, valid_counts: DataFrame, task_type: str) -> DataFrame:
    """One row per call: tokens, model and outcome.

    ``responses`` has error/input_tokens/output_tokens/model; ``valid_counts`` has
    (request_id, n_valid). A call without an answer is still running.
    """
    r = responses.select("request_id", "error", "input_tokens", "output_tokens", "model", F.lit(True).alias("_seen"))
    joined = requests.select("request_id", "document_id").join(r, "request_id", "left").join(
        valid_counts, "request_id", "left")
    n = F.coalesce("n_valid", F.lit(0))
    status = (F.when(F.col("_seen").isNull(), C.TASK_RUNNING).when(F.col("error").isNotNull(), C.TASK_FAILED)
              .when(n == 0, C.TASK_UNPARSED).otherwise(C.TASK_OK))
    return joined.select(
        F.col("request_id").alias("task_id"), "document_id", F.lit(task_type).alias("task_type"), status.alias("status"),
        F.coalesce("input_tokens", F.lit(0)).alias("input_tokens"),
        F.coalesce("output_tokens", F.lit(0)).alias("output_tokens"), F.col("model").alias("model_name"),
        F.col("error").alias("error_message"))
