"""Fact queries, document and entity reports, graph, timeline and cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom import config as C
from factloom.functions import keys as K
from factloom.operators.common import approved, fold_ascii, label, role_union, top_per_key

# Fixed values
RUNNING = ("处理中", "清洗中", "抽取中", "审核中", "链接中")
BOARD_ORDER = ("失败", *RUNNING, "已完成")
CLEARABLE = ("已完成", "失败", "内容为空", "清洗后为空")
PENDING_INPUTS = ("待处理", "imported", "failed", "extracting", "too_short")
COMPANY_TYPES = ("COMPANY", "GROUP", "企业", "集团")
DERIVED_LABELS = {"COOPERATION": "合作", "INVESTMENT": "投资", "EXPANSION": "扩建"}
DEFAULT_MODEL = "deepseek-chat"


def like(column: str, pattern: str) -> Column:
    """SQL LIKE ``%pattern%`` that ignores ASCII case; % and _ in the pattern are wildcards."""
    return fold_ascii(F.col(column)).like("%" + pattern.translate(str.maketrans(
        "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).replace("\\", "\\\\") + "%")


def count_by(df: DataFrame, *columns: str, name: str = "n") -> DataFrame:
    return df.groupBy(*columns).agg(F.count("*").alias(name))


def page(df: DataFrame, limit: int | None, offset: int = 0) -> DataFrame:
    out = df.offset(offset) if offset else df
    return out.limit(limit) if limit is not None else out


# ---- facts ------------------------------------------------------------------

def with_sources(facts: DataFrame, docs: DataFrame, evidence: DataFrame) -> DataFrame:
    d = docs.select("document_id", F.col("title").alias("document_title"), F.col("source_name").alias("document_source"),
                    F.col("url").alias("document_url"), F.col("source_type").alias("document_source_type"))
    return facts.join(d, "document_id", "left").join(evidence.select("evidence_id", "evidence_text"), "evidence_id", "left")


def query_facts(facts: DataFrame, docs: DataFrame, evidence: DataFrame, subject: str = "", fact_type: str = "",
                time_from: str = "", time_to: str = "", document_id=None, review_status: str = "",
                limit: int | None = 100, offset: int = 0) -> DataFrame:
    """Facts by optional conditions with document and evidence; a page holds the newest, all facts come unordered."""
    out = facts
    if subject:
        out = out.filter(like("subject_text", subject))
    for column, value in (("fact_type", fact_type), ("document_id", document_id), ("review_status", review_status)):
        if value:
            out = out.filter(F.col(column) == value)
    if time_from:
        out = out.filter(F.col("time_expr") >= time_from)
    if time_to:
        out = out.filter(F.col("time_expr") <= time_to)
    # cut first, then fetch documents and evidence for the page only
    paged = limit is not None or offset
    chosen = page(out.orderBy(F.desc("created_at"), "fact_id"), limit, offset) if paged else out
    return with_sources(chosen, docs, evidence)


def fact_details(facts: DataFrame, docs: DataFrame, evidence: DataFrame, chunks: DataFrame) -> DataFrame:
    e = evidence.select("evidence_id", "evidence_text", "chunk_id").join(chunks.select("chunk_id", "chunk_text"), "chunk_id", "left")
    d = docs.select("document_id", F.col("title").alias("document_title"), F.col("source_name").alias("document_source"))
    return facts.join(d, "document_id", "left").join(e, "evidence_id", "left")


def approved_stats(facts: DataFrame, fact_type: str = "", document_id=None, pass_type: str = "") -> DataFrame:
    """Per fact type: approved, automatically and by hand."""
    out = facts.filter(F.col("review_status") == pass_type) if pass_type else approved(facts)
    if fact_type:
        out = out.filter(F.col("fact_type") == fact_type)
    if document_id is not None:
        out = out.filter(F.col("document_id") == document_id)
    return out.groupBy("fact_type").agg(
        F.count("*").alias("total"), F.count_if(F.col("review_status") == C.AUTO_PASS).alias("auto_pass"),
        F.count_if(F.col("review_status") == C.HUMAN_PASS).alias("human_pass"))


def approved_page(facts: DataFrame, page_number: int = 1, size: int = 30) -> DataFrame:
    return page(approved(facts).orderBy(F.desc("created_at"), "fact_id"), size, (page_number - 1) * size)


def review_queue(facts: DataFrame, page_number: int = 1, size: int = 20) -> DataFrame:
    """One page of facts waiting for review, plus one row that tells whether more follow."""
    waiting = facts.filter(F.col("review_status") == C.NEEDS_HUMAN)
    return page(waiting.orderBy(F.desc("created_at"), "fact_id"), size + 1, (page_number - 1) * size)


def _quals(*names: str) -> Column:
    q = F.col("_q")
    return F.coalesce(*[F.nullif(F.try_element_at(q, F.lit(n)), F.lit("")) for n in names], F.lit(""))


def fact_summaries(facts: DataFrame, tag_chars: int | None = None) -> DataFrame:
    """Add ``summary`` and ``context_tag``, which ``tag_chars`` shortens."""
    df = facts.withColumn("_q", K.qualifiers(F.col("qualifier_json")))
    kind, pred = F.col("fact_type"), F.coalesce("predicate", F.lit(""))
    number, text = F.col("value_num"), F.nullif("value_text", F.lit(""))
    plain = F.concat(number.cast("string"), F.coalesce(F.concat(F.lit(" "), F.nullif("unit", F.lit(""))), F.lit("")),
                     F.coalesce(F.concat(F.lit("("), F.nullif("currency", F.lit("")), F.lit(")")), F.lit("")))
    whole = F.when(number == F.floor(number), F.floor(number).cast("string")).otherwise(number.cast("string"))
    value = F.when((kind == "COMPETITIVE_RANKING") & number.isNotNull() & pred.endswith("第"), whole).otherwise(F.coalesce(text, plain))
    parts = F.concat_ws(" ", F.nullif(pred, F.lit("")), F.concat(F.lit("→ "), F.nullif("object_text", F.lit(""))), value)
    cut = lambda c: c if tag_chars is None else F.substring(c, 1, tag_chars)
    dots = lambda c: c if tag_chars is None else F.concat(cut(c), F.when(F.length(c) > tag_chars, "…").otherwise(""))
    price = label(_quals("price_type"), C.QUALIFIER_VALUE_LABELS, F.lit(""))
    tag = (F.when(kind == "COMPETITIVE_RANKING", dots(_quals("ranking_name", "segment")))
           .when(kind == "CAPACITY", cut(_quals("product_type")))
           .when(kind == "COOPERATION", cut(label(_quals("cooperation_type"), C.QUALIFIER_VALUE_LABELS)))
           .when(kind == "EXPANSION", dots(_quals("project_name", "scope")))
           .when(kind == "FINANCIAL_METRIC", cut(_quals("metric_name", "segment")))
           .when(kind == "SALES_VOLUME", cut(_quals("product_type", "product_name")))
           .when(kind == "INVESTMENT", dots(_quals("project_name", "purpose")))
           .when(kind == "MARKET_SHARE", cut(_quals("market_scope", "segment")))
           .when(kind == "PRICE_CHANGE", cut(F.concat(_quals("product_name", "product_type"),
                                                      F.when(price != "", F.concat(F.lit("·"), price)).otherwise(""))))
           .otherwise(""))
    return df.withColumns({"summary": F.when(parts == "", "—").otherwise(parts), "context_tag": tag}).drop("_q")


# ---- cost -------------------------------------------------------------------

def cost(input_tokens: Column, output_tokens: Column, hit_ratio: float = 0.0, prices: C.Prices = C.Prices()) -> Column:
    cached = F.floor(input_tokens * F.lit(hit_ratio))
    return F.round(cached / 1e6 * prices.input_cached + (input_tokens - cached) / 1e6 * prices.input_uncached
                   + output_tokens / 1e6 * prices.output, 4)


def _token_sums() -> list[Column]:
    return [F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"),
            F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens")]


def document_costs(tasks: DataFrame) -> DataFrame:
    """Cost lines per (document, task type, model)."""
    return tasks.groupBy("document_id", "task_type", F.coalesce("model_name", F.lit(DEFAULT_MODEL)).alias("model_name")).agg(
        F.count("*").alias("calls"), *_token_sums()).withColumn("cost", cost(F.col("input_tokens"), F.col("output_tokens")))


def document_cost_totals(tasks: DataFrame) -> DataFrame:
    return document_costs(tasks).groupBy("document_id").agg(F.round(F.sum("cost"), 4).alias("total_cost"))


def task_type_costs(tasks: DataFrame, prices: C.Prices = C.Prices()) -> DataFrame:
    return tasks.groupBy("task_type").agg(F.count("*").alias("calls"), *_token_sums()).withColumns({
        "cost": cost(F.col("input_tokens"), F.col("output_tokens"), prices=prices),
        "input_price": F.lit(prices.input_uncached), "output_price": F.lit(prices.output)})


def global_stats(docs: DataFrame, facts: DataFrame, tasks: DataFrame) -> DataFrame:
    """One row: documents, facts, total cost, cost per document."""
    n_docs = docs.agg(F.count("*").alias("document_count"))
    n_facts = facts.agg(F.count("*").alias("fact_count"))
    total = task_type_costs(tasks).agg(F.round(F.coalesce(F.sum("cost"), F.lit(0.0)), 4).alias("total_cost"))
    return n_docs.withColumns({"fact_count": n_facts.scalar(), "total_cost": total.scalar()}).withColumn("cost_per_document", F.when(
        F.col("document_count") > 0, F.round(F.col("total_cost") / F.col("document_count"), 4)).otherwise(0.0))


# ---- documents --------------------------------------------------------------

def document_list(docs: DataFrame, chunks: DataFrame, evidence: DataFrame, facts: DataFrame, tasks: DataFrame) -> DataFrame:
    """Documents with counts per stage, tokens, cost and task outcomes.

    Children are counted before the join, so nothing fans out.
    """
    outcome = lambda s: F.count_if(F.col("status") == s)
    work = tasks.groupBy("document_id").agg(
        *_token_sums(), F.count("*").alias("total_tasks"), outcome(C.TASK_OK).alias("ok_tasks"),
        outcome(C.TASK_FAILED).alias("fail_tasks"), outcome(C.TASK_RUNNING).alias("run_tasks"))
    out = docs
    for child, name in ((chunks, "chunk_count"), (evidence, "evidence_count"), (facts, "fact_count")):
        out = out.join(count_by(child, "document_id", name=name), "document_id", "left")
    numbers = ("chunk_count", "evidence_count", "fact_count", "input_tokens", "output_tokens", "total_tasks", "ok_tasks",
               "fail_tasks", "run_tasks")
    joined = out.join(work, "document_id", "left")
    return joined.withColumns({n: F.coalesce(n, F.lit(0)) for n in numbers}).withColumn(
        "cost", cost(F.col("input_tokens"), F.col("output_tokens")))


def failed_task_errors(tasks: DataFrame) -> DataFrame:
    """Errors of failed tasks, one row each."""
    return tasks.filter(F.col("status") == C.TASK_FAILED).select(
        "document_id", "task_id", "task_type", F.coalesce("error_message", F.lit("")).alias("error"))


def document_order(listed: DataFrame, limit: int | None = None) -> DataFrame:
    """Failed first, then running, then the rest newest first; ``limit`` cuts this order, so failures stay."""
    rank = F.when(F.col("status") == C.DOC_FAILED, 0).when(F.col("status").isin(*RUNNING), 1).otherwise(2)
    ordered = listed.withColumn("rank", rank).orderBy(
        "rank", F.when(F.col("rank") < 2, F.col("crawl_time")), F.desc("crawl_time"), "document_id")
    return page(ordered, limit)


def document_summary(listed: DataFrame) -> DataFrame:
    state = F.col("status")
    return listed.agg(
        F.count("*").alias("total"), F.count_if(state == C.DOC_DONE).alias("processed"), F.count_if(state == C.DOC_FAILED).alias("failed"),
        F.count_if(state.isin(*RUNNING)).alias("processing"), F.sum("fact_count").alias("total_facts"),
        F.sum("evidence_count").alias("total_evidences"), F.round(F.sum("cost"), 4).alias("total_cost"),
        F.sum("fail_tasks").alias("tasks_failed"))


def chunk_counts(chunks: DataFrame, evidence: DataFrame) -> DataFrame:
    n = count_by(evidence, "chunk_id", name="evidence_count")
    return chunks.join(n, "chunk_id", "left").withColumn("evidence_count", F.coalesce("evidence_count", F.lit(0)))


def evidence_counts(evidence: DataFrame, chunks: DataFrame, facts: DataFrame) -> DataFrame:
    n = count_by(facts, "evidence_id", name="fact_count")
    return evidence.join(chunks.select("chunk_id", "chunk_index"), "chunk_id", "left").join(n, "evidence_id", "left").withColumn(
        "fact_count", F.coalesce("fact_count", F.lit(0)))


def processing_board(docs: DataFrame, facts: DataFrame, limit: int | None = 20) -> DataFrame:
    """Failed, running and finished documents by status, newest first, with fact counts."""
    order = F.create_map(*[F.lit(x) for i, s in enumerate(BOARD_ORDER) for x in (s, i)])
    chosen = page(docs.filter(F.col("status").isin(*BOARD_ORDER)).withColumn("rank", order[F.col("status")]).orderBy(
        "rank", F.desc("crawl_time"), "document_id"), limit)
    return chosen.join(count_by(facts, "document_id", name="facts_count"), "document_id", "left").withColumns({
        "facts_count": F.coalesce("facts_count", F.lit(0)), "error_message": F.coalesce("error_message", F.lit(""))})


def board_summary(board: DataFrame) -> DataFrame:
    state = F.col("status")
    return board.agg(F.count("*").alias("total"), F.count_if(state == C.DOC_DONE).alias("done"),
                     F.count_if(state == C.DOC_FAILED).alias("failed"), F.count_if(state.isin(*RUNNING)).alias("running"))


def reset_finished(docs: DataFrame) -> DataFrame:
    return docs.withColumn("status", F.when(F.col("status").isin(*CLEARABLE), C.PENDING).otherwise(F.col("status")))


def select_pending(docs: DataFrame) -> DataFrame:
    return docs.filter(F.col("status").isNull() | F.col("status").isin(*PENDING_INPUTS))


def select_failed(docs: DataFrame, facts: DataFrame, tasks: DataFrame) -> DataFrame:
    """Finished documents without facts or with an unparsed answer."""
    done = docs.filter(F.col("status") == C.DOC_DONE)
    empty = done.join(facts.select("document_id"), "document_id", "left_anti")
    unparsed = done.join(tasks.filter(F.col("status") == C.TASK_UNPARSED).select("document_id"), "document_id", "left_semi")
    return empty.unionByName(unparsed).dropDuplicates(["document_id"])


# ---- entities ---------------------------------------------------------------

def _entity_counts(facts: DataFrame) -> DataFrame:
    return count_by(role_union(approved(facts)), "entity_id", name="fact_count")


def entity_list(facts: DataFrame, entities: DataFrame, search: str = "", entity_type: str = "", limit: int | None = 200) -> DataFrame:
    chosen = entities
    if search:
        chosen = chosen.filter(like("canonical_name", search))
    if entity_type:
        chosen = chosen.filter(F.col("entity_type") == entity_type)
    out = chosen.join(_entity_counts(facts), "entity_id").select("entity_id", F.col("canonical_name").alias("name"), "entity_type", "fact_count")
    return page(out.orderBy(F.desc("fact_count"), "entity_id"), limit)


def entity_details(facts: DataFrame, entities: DataFrame) -> DataFrame:
    """Per entity: approved facts, documents, first and last time."""
    time = F.nullif("time_expr", F.lit(""))
    stats = role_union(approved(facts), "document_id", "time_expr").groupBy("entity_id").agg(
        F.count("*").alias("total_fact_count"), F.countDistinct("document_id").alias("source_doc_count"),
        F.min(time).alias("time_earliest"), F.max(time).alias("time_latest"))
    return entities.join(stats, "entity_id", "left").withColumns({
        "total_fact_count": F.coalesce("total_fact_count", F.lit(0)), "source_doc_count": F.coalesce("source_doc_count", F.lit(0))})


def entity_type_stats(facts: DataFrame) -> DataFrame:
    return count_by(role_union(approved(facts), "fact_type"), "entity_id", "fact_type")


def entity_top_documents(facts: DataFrame, docs: DataFrame, n: int = 10) -> DataFrame:
    per = count_by(role_union(approved(facts), "document_id"), "entity_id", "document_id", name="fact_count")
    known = per.join(docs.select("document_id", "title"), "document_id")
    return top_per_key(known, ["entity_id"], [F.desc("fact_count"), F.col("document_id")], n)


def _derived_rows(facts: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Linked approved facts seen from both ends, for entities without a confirmed relation."""
    related = relations.select(F.explode(F.array("from_entity_id", "to_entity_id")).alias("entity_id")).distinct()
    linked = approved(facts).filter("subject_entity_id <> object_entity_id")
    side = lambda own, other, direction: linked.select(
        F.col(own).alias("entity_id"), F.col(other).alias("target_id"), F.lit(direction).alias("direction"), "fact_type", "fact_id",
        "predicate", "qualifier_json")
    target = entities.filter(F.col("entity_type").isin(*COMPANY_TYPES) & ~F.col("canonical_name").rlike(C.PROJECT_LIKE_NAME)).select(
        F.col("entity_id").alias("target_id"), F.col("canonical_name").alias("target_name"), F.col("entity_type").alias("target_type"))
    return side("subject_entity_id", "object_entity_id", "from").unionByName(side("object_entity_id", "subject_entity_id", "to")) \
        .join(related, "entity_id", "left_anti").join(target, "target_id")


def derived_relations(facts: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Relations read off the facts of entities that have no confirmed relation.

    One row per (entity, direction, fact type, target) with a description made of its distinct
    non-numeric predicates and qualifier notes, in the order of their first facts. Facts are
    counted, not listed; ``derived_relation_facts`` has them as rows. All is one aggregate over
    (group, text), so a hot group is combined before the shuffle.
    """
    rows = _derived_rows(facts, entities, relations)
    group = ["entity_id", "direction", "fact_type", "target_id"]

    text = K.strip(F.coalesce("predicate", F.lit("")))
    notes = F.array(*[F.struct(F.lit(i).alias("pos"), K.strip(F.try_element_at("_q", F.lit(k))).alias("v")) for i, k in enumerate(C.RELATION_NOTE_KEYS)])
    told = F.filter(notes, lambda n: (n["v"] != "") & ~F.lower(n["v"]).isin("true", "false"))
    item = lambda kind, v, pos: F.struct(F.lit(kind).alias("kind"), v.alias("v"), pos.alias("pos"))
    spoken = F.when((text != "") & ~text.rlike("[为达约超]$"), F.array(item("p", text, F.lit(0))))
    items = F.concat(
        F.array(item("all", F.lit(""), F.lit(0))), F.coalesce(spoken, F.array().cast("array<struct<kind:string,v:string,pos:int>>")),
        F.transform(told, lambda n: item("n", label(n["v"], C.RELATION_VALUE_LABELS), n["pos"])))
    first = rows.withColumn("_q", K.qualifiers(F.col("qualifier_json"))).select(
        *group, "target_name", "target_type", "fact_id", F.inline(items)).groupBy(*group, "target_name", "target_type", "kind", "v").agg(
        F.count("*").alias("n"), F.min(F.struct("fact_id", "pos")).alias("k"))
    listed = lambda kind: F.array_join(F.transform(F.array_sort(F.collect_list(
        F.when(F.col("kind") == kind, F.struct("k", "v")))), lambda x: x["v"]), "、")
    full = first.groupBy(*group, "target_name", "target_type").agg(
        F.sum(F.when(F.col("kind") == "all", F.col("n"))).alias("fact_count"), listed("p").alias("_p"), listed("n").alias("_n"))
    described = F.when(F.col("_p") != "", F.concat("_p", F.when(F.col("_n") != "", F.concat(F.lit("（"), "_n", F.lit("）"))).otherwise(""))) \
        .otherwise(label(F.col("fact_type"), DERIVED_LABELS))
    return full.withColumn("relation_type", described).drop("_p", "_n")


def derived_relation_facts(facts: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """The facts behind ``derived_relations``, one row each: group columns and fact_id."""
    return _derived_rows(facts, entities, relations).select("entity_id", "direction", "fact_type", "target_id", "fact_id")


def _timeline_key() -> dict[str, Column]:
    text = lambda c: F.coalesce(c, F.lit(""))
    kind = F.col("fact_type")
    time = text("time_expr")
    for old, new in (("-至今", "至今"), ("年-", "年"), ("月-", "月")):
        time = F.replace(time, F.lit(old), F.lit(new))
    time = F.regexp_replace(time, r"(\d)0(\d日)", "$1$2")
    rank = F.coalesce(F.nullif("value_text", F.lit("")), F.nullif("value_num", F.lit(0.0)).cast("string"), F.lit(""))
    q = F.col("_q")
    pick = lambda *names: F.coalesce(*[F.nullif(F.try_element_at(q, F.lit(n)), F.lit("")) for n in names])
    measured = kind.isin("FINANCIAL_METRIC", "SALES_VOLUME")
    ranked = kind == "COMPETITIVE_RANKING"
    dealt = kind.isin("INVESTMENT", "EXPANSION", "COOPERATION")
    return {
        "_k1": F.when(measured, F.coalesce(pick("metric_name"), text("predicate"))).when(ranked, rank)
        .when(dealt, text("object_text")).otherwise(text("predicate")),
        "_k2": F.when(ranked, F.coalesce(pick("ranking_name", "segment"), F.lit(""))).otherwise(text("value_text")),
        "_k3": time, "_k0": text("subject_text"),
    }


def timelines(facts: DataFrame, limit: int | None = None) -> DataFrame:
    """Timeline of every linked entity: latest first, undated last, near-repeats merged.

    Of repeated facts the most confident shows, at the place of the first. ``limit`` keeps so many entries per entity.
    """
    columns = ["fact_type", "subject_text", "predicate", "object_text", "value_num", "value_text", "time_expr", "confidence_score", "qualifier_json"]
    rows = role_union(approved(facts), *columns)
    order = [F.coalesce("time_expr", F.lit("")) == "", F.desc("time_expr"), F.col("fact_id")]
    placed = rows.withColumn("pos", F.row_number().over(Window.partitionBy("entity_id").orderBy(*order)))
    keyed = placed.withColumn("_q", K.qualifiers(F.col("qualifier_json"))).withColumns(_timeline_key())
    best = F.struct(F.coalesce("confidence_score", F.lit(0.0)).alias("c"), (-F.col("pos")).alias("p"), *[
        F.col(c) for c in ("fact_id", "subject_text", "predicate", "object_text", "value_num", "time_expr")])
    merged = keyed.groupBy("entity_id", "fact_type", "_k0", "_k1", "_k2", "_k3").agg(F.min("pos").alias("pos"), F.max(best).alias("b"))
    if limit is not None:  # after merging, so that repeats push nothing out
        merged = top_per_key(merged, ["entity_id"], [F.col("pos")], limit)
    return merged.select("entity_id", "pos", "fact_type", "b.fact_id", "b.subject_text", "b.predicate", "b.object_text",
                         "b.value_num", "b.time_expr", F.col("b.c").alias("confidence_score"))


def entity_overview(facts: DataFrame) -> DataFrame:
    return approved(facts).agg(
        F.countDistinct("subject_entity_id").alias("entity_count"), F.count("subject_entity_id").alias("linked_fact_count"),
        F.count("*").alias("total_passed"))


def overview_types(facts: DataFrame, entities: DataFrame) -> DataFrame:
    linked = approved(facts).select(F.col("subject_entity_id").alias("entity_id")).distinct()
    return count_by(entities.join(linked, "entity_id", "left_semi"), "entity_type")


def hierarchy(relations: DataFrame, entities: DataFrame, facts: DataFrame) -> DataFrame:
    """Root entities (never a child) with their direct children and fact counts."""
    known = entities.select("entity_id")
    edges = relations.join(known.withColumnRenamed("entity_id", "from_entity_id"), "from_entity_id", "left_semi").join(
        known.withColumnRenamed("entity_id", "to_entity_id"), "to_entity_id", "left_semi")
    roots = edges.join(edges.select(F.col("to_entity_id").alias("from_entity_id")), "from_entity_id", "left_anti")
    counts = \
        approved(facts).groupBy(F.col("subject_entity_id").alias("entity_id")).agg(F.count("*").alias("c"))
    info = entities.join(counts, "entity_id", "left").select("entity_id", "canonical_name", F.coalesce("c", F.lit(0)).alias("c"))
    side = lambda p, k: info.select(F.col("entity_id").alias(k), F.col("canonical_name").alias(f"{p}_name"), F.col("c").alias(f"{p}_fact_count"))
    return roots.join(side("root", "from_entity_id"), "from_entity_id").join(side("child", "to_entity_id"), "to_entity_id").select(
        F.col("from_entity_id").alias("root_id"), "root_name", "root_fact_count", F.col("to_entity_id").alias("child_id"),
        "child_name", "relation_type", "child_fact_count")


def knowledge_base(facts: DataFrame, entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """Per entity: linked facts, and unlinked facts whose subject is one of its names."""
    live = approved(facts)
    linked = live.groupBy(F.col("subject_entity_id").alias("entity_id")).agg(F.count("*").alias("linked_fact_count"))
    names = entities.select("entity_id", F.col("canonical_name").alias("subject_text")).unionByName(
        aliases.select("entity_id", F.col("alias_name").alias("subject_text"))).distinct()
    loose = count_by(live.filter(F.col("subject_entity_id").isNull()), "subject_text")
    texts = names.join(loose, "subject_text").groupBy("entity_id").agg(F.sum("n").alias("text_fact_count"))
    return entities.join(linked, "entity_id", "left").join(texts, "entity_id", "left").select(
        "entity_id", "canonical_name", "entity_type", F.coalesce("linked_fact_count", F.lit(0)).alias("linked_fact_count"),
        F.coalesce("text_fact_count", F.lit(0)).alias("text_fact_count"))


def entity_cards(facts: DataFrame, entities: DataFrame, chosen: DataFrame) -> DataFrame:
    counts = approved(facts).groupBy(F.col("subject_entity_id").alias("entity_id")).agg(F.count("*").alias("fact_count"))
    return entities.join(chosen.select("entity_id"), "entity_id", "left_semi").join(counts, "entity_id", "left").select(
        "entity_id", "canonical_name", "entity_type", F.coalesce("fact_count", F.lit(0)).alias("fact_count"))


def search_entities(keyword: str, facts: DataFrame, entities: DataFrame, aliases: DataFrame, entity_type: str = "",
                    limit: int | None = 20) -> DataFrame:
    by_alias = aliases.filter(like("alias_name", keyword)).select("entity_id")
    by_name = entities.filter(like("canonical_name", keyword)).select("entity_id")
    chosen = entities.join(by_alias.unionByName(by_name), "entity_id", "left_semi")
    if entity_type:
        chosen = chosen.filter(F.col("entity_type") == entity_type)
    out = chosen.join(_entity_counts(facts), "entity_id", "left").select(
        "entity_id", "canonical_name", "entity_type", F.coalesce("fact_count", F.lit(0)).alias("fact_count"))
    return page(out.orderBy(F.desc("fact_count"), "entity_id"), limit)


def facts_of_entity(facts: DataFrame, entity_id: str, fact_type: str = "", limit: int | None = 30) -> DataFrame:
    live = approved(facts).filter((F.col("subject_entity_id") == entity_id) | (F.col("object_entity_id") == entity_id))
    if fact_type:
        live = live.filter(F.col("fact_type") == fact_type)
    return page(live.orderBy(F.desc_nulls_last("time_expr"), F.desc("created_at"), "fact_id"), limit)


def keyword_facts(facts: DataFrame, keyword: str, limit: int | None = 30) -> DataFrame:
    hit = like("subject_text", keyword) | like("object_text", keyword) | like("predicate", keyword)
    return page(approved(facts).filter(hit).orderBy(F.desc_nulls_last("time_expr"), F.desc("created_at"), "fact_id"), limit)


def kb_top_entities(facts: DataFrame, entities: DataFrame, n: int = 10) -> DataFrame:
    out = entities.join(_entity_counts(facts), "entity_id", "left").select(
        "entity_id", "canonical_name", "entity_type", F.coalesce("fact_count", F.lit(0)).alias("fact_count"))
    return out.orderBy(F.desc("fact_count"), "entity_id").limit(n)


# ---- graph ------------------------------------------------------------------

def graph(facts: DataFrame, entities: DataFrame, relations: DataFrame, fact_type: str = "", document_id=None,
          limit: int | None = None) -> dict[str, DataFrame]:
    """Nodes, edges and figures of the knowledge graph over all approved facts, or the ``limit`` newest.

    Nodes are entities, or ``text::name`` for unlinked texts; edges are facts with an
    object and confirmed relations.
    """
    live = approved(facts)
    if fact_type:
        live = live.filter(F.col("fact_type") == fact_type)
    if document_id is not None:
        live = live.filter(F.col("document_id") == document_id)
    named = live.filter(F.col("subject_text").isNotNull())
    newest = named if limit is None else page(named.orderBy(F.desc("created_at"), "fact_id"), limit)
    node = lambda link, text: F.coalesce(link, F.when(F.col(text) != "", F.concat(F.lit("text::"), text)))
    placed = newest.withColumns({"source": node("subject_entity_id", "subject_text"), "target": node("object_entity_id", "object_text")}) \
        .filter(F.col("source").isNotNull())
    fact_edges = placed.filter(F.col("target").isNotNull()).select(
        F.col("fact_id").alias("edge_id"), "source", "target", "fact_type", "predicate", "confidence_score")
    name = lambda k, n: entities.select(F.col("entity_id").alias(k), F.col("canonical_name").alias(n))
    kb = relations.filter(F.col("from_entity_id").isNotNull() & F.col("to_entity_id").isNotNull())
    kb_edges = kb.select(
        F.concat(F.lit("rel::"), "relation_id").alias("edge_id"), F.col("from_entity_id").alias("source"), F.col("to_entity_id").alias("target"),
        F.lit("ENTITY_RELATION").alias("fact_type"), label(F.col("relation_type"), C.RELATION_LABELS).alias("predicate"),
        F.lit(1.0).alias("confidence_score"))
    edges = fact_edges.unionByName(kb_edges)
    seen = placed.select(F.col("source").alias("node_id"), F.col("subject_text").alias("text"), F.lit(1).alias("c")) \
        .unionByName(placed.filter(F.col("target").isNotNull()).select(F.col("target").alias("node_id"), F.col("object_text").alias("text"), F.lit(0).alias("c"))) \
        .unionByName(kb_edges.select(F.explode(F.array("source", "target")).alias("node_id"), F.lit(None).cast("string").alias("text"), F.lit(0).alias("c")))
    grouped = seen.groupBy("node_id").agg(F.sum("c").alias("fact_count"), F.min("text").alias("_text"))
    nodes = grouped.join(entities.select(F.col("entity_id").alias("node_id"), "canonical_name", "entity_type"), "node_id", "left").select(
        "node_id", F.coalesce("canonical_name", "_text", "node_id").alias("name"), F.coalesce("entity_type", F.lit("UNKNOWN")).alias("entity_type"),
        "fact_count", F.col("node_id").startswith("text::").alias("is_text_node"))
    stats = edges.agg(
        F.count("*").alias("relational_facts"), F.count_if(F.col("fact_type") != "ENTITY_RELATION").alias("_f")).withColumns({
            "total_passed_facts": live.agg(F.count("*")).scalar(), "entity_count": nodes.agg(F.count("*")).scalar()}).select(
        "total_passed_facts", "entity_count", "relational_facts",
        (F.col("total_passed_facts") - F.col("relational_facts")).alias("metric_facts"),
        # the figure above also subtracts confirmed relations; this one does not
        (F.col("total_passed_facts") - F.col("_f")).alias("metric_facts_corrected"))
    return {"nodes": nodes, "edges": edges, "stats": stats}
