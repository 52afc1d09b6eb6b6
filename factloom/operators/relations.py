"""Relation candidates, suggestions, background texts and relation maintenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom import config as C
from factloom.functions import keys as K
from factloom.operators.common import approved, contained_in, keep_first, top_per_key
from factloom.operators.merging import sample_facts

SIMILAR_SCORE = 0.72
AUTO_CONFIRM = 0.75


def fact_candidates(facts: DataFrame, entities: DataFrame) -> DataFrame:
    """Targets named as object of an entity's approved cooperation, investment or
    expansion facts, one per (entity, target); the first fact by id speaks."""
    target = K.strip(F.col("object_text"))
    rows = approved(facts).filter(F.col("fact_type").isin(*C.OBJECT_FACT_TYPES) & F.col("subject_entity_id").isNotNull()) \
        .withColumn("target_name", target).filter(F.length("target_name") >= C.MIN_NAME_LEN)
    first = top_per_key(rows, ["subject_entity_id", "target_name"], [F.col("fact_id")])
    by_name = entities.groupBy(F.col("canonical_name").alias("target_name")).agg(F.min("entity_id").alias("_named"))
    joint = F.try_element_at(K.qualifiers(F.col("qualifier_json")), F.lit("cooperation_type")).isin("joint_venture", "合资")
    hint = (F.when(F.col("fact_type") == "INVESTMENT", "投资")
            .when((F.col("fact_type") == "COOPERATION") & F.coalesce(joint, F.lit(False)), "合资").otherwise("合作方"))
    return first.join(by_name, "target_name", "left").select(
        F.col("subject_entity_id").alias("entity_id"), "target_name",
        F.coalesce("object_entity_id", "_named").alias("target_entity_id"), F.lit("fact_driven").alias("source"),
        "fact_type", hint.alias("rel_hint"), F.lit(None).cast("double").alias("score"),
        F.concat(F.coalesce(F.nullif("predicate", F.lit("")), "fact_type"), F.lit("："), "object_text").alias("evidence"),
        F.col("fact_id").alias("evidence_fact_id"))


def similar_candidates(entities: DataFrame, aliases: DataFrame, per_entity: int | None = None) -> DataFrame:
    """Other entities whose name contains, or is contained in, one of an entity's names.

    ``per_entity`` keeps so many of the best.
    """
    names = entities.select("entity_id", F.col("canonical_name").alias("n")).unionByName(
        aliases.select("entity_id", F.col("alias_name").alias("n")))
    own = names.select(F.col("entity_id").alias("x"), K.normalized_name(F.col("n")).alias("nx")).filter(
        F.length("nx") >= C.MIN_NAME_LEN).distinct()
    norm = K.normalized_name(F.col("canonical_name"))
    other = entities.select(F.col("entity_id").alias("y"), F.coalesce(F.nullif(norm, F.lit("")), "canonical_name").alias("ny"))
    # meet over distinct names, then bring the entities back
    a, b = own.select("nx").distinct(), other.select("ny").distinct()
    met = contained_in(a, b, "nx", "ny").unionByName(contained_in(b, a, "ny", "nx")).distinct().withColumn(
        "s", K.contain_score(F.col("nx"), F.col("ny"))).filter(F.col("s") >= SIMILAR_SCORE)
    scored = met.join(own, "nx").join(other, "ny").filter("x <> y").groupBy("x", "y").agg(F.max("s").alias("s"))
    info = lambda p: entities.select(F.col("entity_id").alias(p), F.col("canonical_name").alias(f"c{p}"))
    full = scored.join(info("x"), "x").join(info("y"), "y")
    nx, ny = K.normalized_name(F.col("cx")), K.normalized_name(F.col("cy"))
    related = (ny != "") & (ny.contains(nx) | nx.contains(ny))
    out = full.select(
        F.col("x").alias("entity_id"), F.col("cy").alias("target_name"), F.col("y").alias("target_entity_id"),
        F.lit("name_similar").alias("source"), F.when(related, "子公司").otherwise("merge").alias("rel_hint"),
        F.round("s", 3).alias("score"),
        F.concat(F.lit("名称相似度 "), F.format_string("%.0f", F.col("s") * 100), F.lit("%（包含关系）")).alias("evidence"))
    if per_entity is None:
        return out
    return top_per_key(out, ["entity_id"], [F.desc("score"), F.col("target_name"), F.col("target_entity_id")], per_entity)


def assemble_suggestions(candidates: DataFrame, pending: DataFrame, verdicts: DataFrame, background: DataFrame) -> DataFrame:
    """Suggestion rows from candidates, model verdicts and background texts.

    Targets with a pending suggestion are skipped, as are verdicts of 跳过. Without a
    verdict, facts weigh 0.6 and names their score. ``background`` is
    (entity_id, target_name, search_evidence), with a NULL target for the entity itself.
    """
    one = top_per_key(candidates, ["entity_id", "target_name"],
                      [F.col("source"), F.desc("score"), F.col("evidence_fact_id"), F.col("target_entity_id")])
    fresh = one.join(pending.select("entity_id", "target_name").distinct(), ["entity_id", "target_name"], "left_anti")
    v = verdicts.select("entity_id", "target_name", F.col("suggestion_type").alias("_type"), F.col("confidence").alias("_conf"),
                        F.col("reason").alias("model_reason"), F.col("relation_type").alias("_rel"))
    pair = background.filter(F.col("target_name").isNotNull()).select(
        "entity_id", "target_name", F.col("search_evidence").alias("_pair"))
    alone = background.filter(F.col("target_name").isNull()).select("entity_id", F.col("search_evidence").alias("_own"))
    joined = fresh.join(v, ["entity_id", "target_name"], "left").join(pair, ["entity_id", "target_name"], "left") \
        .join(alone, "entity_id", "left")
    blank = lambda c: F.nullif(c, F.lit(""))
    default = F.when((F.col("source") == "name_similar") & (F.col("rel_hint") == "merge"), "合并").otherwise("关系")
    kind = F.coalesce(blank("_type"), default)
    confidence = F.coalesce(F.nullif("_conf", F.lit(0.0)), F.when(F.col("source") == "fact_driven", 0.6).otherwise(
        F.coalesce("score", F.lit(0.5))))
    evidence = F.coalesce(blank("_pair"), blank("_own"))
    return joined.withColumns({"suggestion_type": kind, "confidence": confidence, "search_evidence": evidence}) \
        .filter("suggestion_type <> '跳过'").select(
        F.sha2(F.concat_ws("|", F.lit("suggestion"), "entity_id", "target_name"), 256).alias("suggestion_id"),
        "entity_id", "target_name", "target_entity_id", "suggestion_type",
        F.coalesce(blank("_rel"), F.when(F.col("suggestion_type") == "关系", F.col("rel_hint"))).alias("relation_type"),
        "evidence", "evidence_fact_id", "confidence", "model_reason", "search_evidence",
        (F.col("search_evidence").isNotNull() & (F.col("confidence") >= AUTO_CONFIRM)).alias("auto_confirmable"),
        F.lit(C.PENDING).alias("status"))


def materialise(suggestions: DataFrame, relations: DataFrame, aliases: DataFrame, tasks: DataFrame) -> dict[str, DataFrame]:
    """Turn confirmed suggestions into relations, aliases and merge tasks.

    Rows that need a target id and have none come back under ``rejects``.
    """
    need = F.col("suggestion_type").isin("关系", "合并")
    known = F.col("suggestion_type").isin("关系", "合并", "别名")
    bad = (need & F.col("target_entity_id").isNull()) | ~known
    rejects = suggestions.filter(bad).select("suggestion_id", F.when(~known, "未知 suggestion_type").otherwise("目标实体 ID 未知").alias("reason"))
    good = suggestions.filter(~bad)
    rel_key = ["from_entity_id", "to_entity_id", "relation_type"]
    new_relations = keep_first(good.filter("suggestion_type = '关系'").select(
        F.col("suggestion_id").alias("relation_id"), F.col("entity_id").alias("from_entity_id"),
        F.col("target_entity_id").alias("to_entity_id"), F.coalesce("relation_type", F.lit("合作方")).alias("relation_type")),
        relations, rel_key, [F.col("relation_id")])
    new_aliases = keep_first(good.filter("suggestion_type = '别名'").select(
        F.col("suggestion_id").alias("alias_id"), "entity_id", F.col("target_name").alias("alias_name")),
        aliases, ["alias_name"], [F.col("alias_id")])
    new_tasks = keep_first(good.filter("suggestion_type = '合并'").select(
        F.col("suggestion_id").alias("task_id"), F.col("entity_id").alias("primary_id"), F.col("target_entity_id").alias("secondary_id"),
        F.col("confidence").alias("rule_score"), F.lit("合并").alias("model_verdict"), F.lit(C.PENDING).alias("status")),
        tasks, ["primary_id", "secondary_id"], [F.col("task_id")])
    return {"relations": new_relations, "aliases": new_aliases, "tasks": new_tasks, "rejects": rejects}


def list_suggestions(suggestions: DataFrame, entities: DataFrame, status: str = C.PENDING, limit: int | None = 100) -> DataFrame:
    chosen = suggestions if status == "all" else suggestions.filter(F.col("status") == status)
    named = chosen.join(entities.select("entity_id", F.col("canonical_name").alias("entity_name"), "entity_type"), "entity_id")
    ordered = named.orderBy(F.desc("confidence"), F.desc("created_at"), "suggestion_id")
    return ordered.limit(limit) if limit is not None else ordered


def decide_suggestions(suggestions: DataFrame, decisions: DataFrame) -> DataFrame:
    """Apply (suggestion_id, action) with action confirm/reject."""
    return suggestions.join(decisions.select("suggestion_id", "action"), "suggestion_id", "left").withColumn(
        "status", F.when(F.col("action") == "confirm", C.SUGGESTION_CONFIRMED).when(
            F.col("action") == "reject", C.SUGGESTION_REJECTED).otherwise(F.col("status"))).select(*suggestions.columns)


def analysis_requests(entities: DataFrame, facts: DataFrame, candidates: DataFrame, background: DataFrame,
                      lines: int, per_entity: int | None = None, per_background: int | None = None) -> DataFrame:
    """One request per entity with candidates: up to ``lines`` sample fact lines, candidates, background.

    ``per_entity`` and ``per_background`` keep so many of the best candidates and first background texts.
    """
    order = [F.col("source"), F.desc("score"), F.col("target_name"), F.col("target_entity_id")]
    some = candidates.withColumn("k", F.row_number().over(Window.partitionBy("entity_id").orderBy(*order)))
    if per_entity is not None:
        some = some.filter(F.col("k") <= per_entity)
    item = F.struct("k", F.col("target_name").alias("target"), "source", "evidence", F.col("score").alias("similarity"))
    listed = some.groupBy("entity_id").agg(F.count("*").alias("n_candidates"), F.sort_array(F.collect_list(item)).alias("_c"))
    texts = background.filter(F.col("target_name").isNotNull())
    if per_background is not None:
        texts = top_per_key(texts, ["entity_id"], [F.col("target_name")], per_background)
    notes = texts.groupBy("entity_id").agg(F.sort_array(F.collect_list(F.struct("target_name", "search_evidence"))).alias("_b"))
    none = F.array().cast("array<string>")
    joined = listed.join(entities.select("entity_id", "canonical_name", "entity_type"), "entity_id") \
        .join(sample_facts(facts, lines, " | ", False), "entity_id", "left").join(notes, "entity_id", "left")
    body = F.struct(F.col("canonical_name").alias("entity"), F.col("entity_type").alias("type"),
                    F.coalesce("lines", none).alias("facts"), F.transform("_c", lambda c: c.dropFields("k")).alias("candidates"),
                    F.col("_b").alias("background"))
    return joined.select("entity_id", "n_candidates", F.size(F.coalesce("lines", none)).alias("n_facts"), F.to_json(body).alias("body"))


def ingest_analysis(answers: DataFrame) -> DataFrame:
    """Verdicts of analysis answers (entity_id, json): list or ``suggestions`` list, last wins."""
    item = "array<struct<target:string,suggestion_type:string,confidence:double,reason:string,relation_type:string>>"
    listed = F.when(F.col("json").startswith("["), F.from_json("json", item)).otherwise(
        F.from_json("json", f"suggestions {item}")["suggestions"])
    rows = answers.select("entity_id", F.posexplode_outer(listed).alias("pos", "s")).filter(F.coalesce("s.target", F.lit("")) != "")
    last = top_per_key(rows.select("entity_id", "pos", "s.*"), ["entity_id", "target"], [F.desc("pos")])
    return last.select(
        "entity_id", F.col("target").alias("target_name"), F.coalesce("suggestion_type", F.lit("关系")).alias("suggestion_type"),
        F.coalesce("confidence", F.lit(0.6)).alias("confidence"), F.coalesce("reason", F.lit("")).alias("reason"), "relation_type")


def top_entities(facts: DataFrame, entities: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` entities with most approved facts as subject."""
    counts = approved(facts).groupBy(F.col("subject_entity_id").alias("entity_id")).agg(F.count("*").alias("fact_count"))
    return entities.join(counts, "entity_id").select("entity_id", "canonical_name", "fact_count").orderBy(
        F.desc("fact_count"), "entity_id").limit(n)


def _related(relations: DataFrame) -> DataFrame:
    """Pairs with a relation, in both orders."""
    f = relations.select(F.col("from_entity_id").alias("a"), F.col("to_entity_id").alias("b"))
    return f.unionByName(f.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def relation_candidates(facts: DataFrame, entities: DataFrame, relations: DataFrame, samples: int) -> DataFrame:
    """Linked pairs of approved facts without a relation: type, evidence count, up to ``samples`` predicates."""
    rows = approved(facts).filter(F.col("fact_type").isin(*C.OBJECT_FACT_TYPES)).select(
        F.col("subject_entity_id").alias("a"), F.col("object_entity_id").alias("b"), "fact_type", "predicate", "fact_id").filter("a <> b")
    open_pairs = rows.join(_related(relations), ["a", "b"], "left_anti")
    counts = open_pairs.groupBy("a", "b").agg(
        F.count("*").alias("evidence_count"), F.bool_or(F.col("fact_type") == "INVESTMENT").alias("_i"),
        F.bool_or(F.col("fact_type") == "COOPERATION").alias("_c"))
    firsts = open_pairs.groupBy("a", "b", "predicate").agg(F.min("fact_id").alias("k"))
    samples = top_per_key(firsts, ["a", "b"], [F.col("k")], samples).groupBy("a", "b").agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("k", "predicate"))), lambda s: s["predicate"]), ",").alias("sample_predicates"))
    kind = F.when(F.col("_i"), "SHAREHOLDER").when(F.col("_c"), "PARTNER").otherwise("SUBSIDIARY")
    name = lambda k, n: entities.select(F.col("entity_id").alias(k), F.col("canonical_name").alias(n))
    return counts.join(samples, ["a", "b"]).join(name("a", "from_name"), "a").join(name("b", "to_name"), "b").select(
        F.col("a").alias("from_id"), "from_name", F.col("b").alias("to_id"), "to_name", kind.alias("suggested_type"),
        "evidence_count", "sample_predicates")


def filter_proposals(proposals: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Model proposals that name a valid new relation between two known entities."""
    ids = entities.select("entity_id")
    ok = proposals.filter(F.col("relation_type").isin(*C.RELATION_TYPES) & (F.col("from_id") != F.col("to_id")))
    ok = ok.join(ids.withColumnRenamed("entity_id", "from_id"), "from_id", "left_semi").join(
        ids.withColumnRenamed("entity_id", "to_id"), "to_id", "left_semi")
    taken = _related(relations).select(F.col("a").alias("from_id"), F.col("b").alias("to_id"))
    return ok.join(taken, ["from_id", "to_id"], "left_anti").withColumn("confidence", F.coalesce("confidence", F.lit(0.7)))


def proposal_entities(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """Entity lines of a proposal request: one line per entity with its aliases."""
    joined = aliases.groupBy("entity_id").agg(F.array_join(F.array_sort(F.collect_list("alias_name")), "、").alias("a"))
    return entities.join(joined, "entity_id", "left").select("entity_id", F.concat(
        F.lit("- ["), "entity_id", F.lit("] "), "canonical_name", F.lit(" ["), F.coalesce("entity_type", F.lit("未知")), F.lit("]"),
        F.coalesce(F.concat(F.lit("  别名: "), "a"), F.lit(""))).alias("line"))


def apply_relation_changes(relations: DataFrame, additions: DataFrame, removals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(snapshot, additions refused for their type). Existing and first rows win."""
    valid = F.col("relation_type").isin(*C.RELATION_TYPES)
    kept = relations.join(removals.select("relation_id"), "relation_id", "left_anti").select(*relations.columns)
    new = keep_first(additions.filter(valid), kept, ["from_entity_id", "to_entity_id", "relation_type"], [F.col("relation_id")])
    return kept.unionByName(new.select(*relations.columns)), additions.filter(~valid)


def relations_of(relations: DataFrame, entities: DataFrame, chosen: DataFrame) -> DataFrame:
    """Relations that touch the chosen entities, with both names."""
    ids = chosen.select("entity_id").distinct()
    hits = relations.join(ids.withColumnRenamed("entity_id", "from_entity_id"), "from_entity_id", "left_semi").select(*relations.columns) \
        .unionByName(relations.join(ids.withColumnRenamed("entity_id", "to_entity_id"), "to_entity_id", "left_semi").select(*relations.columns)) \
        .dropDuplicates(["relation_id"])
    name = lambda k, n: entities.select(F.col("entity_id").alias(k), F.col("canonical_name").alias(n))
    return hits.join(name("from_entity_id", "from_name"), "from_entity_id").join(name("to_entity_id", "to_name"), "to_entity_id")


# ---- background text cache -------------------------------------------------

def cache_key(query: Column) -> Column:
    """Normalised name, or the ordered pair ``a||b``."""
    parts = F.transform(F.split(query, r"\|\|"), lambda p: F.lower(K.strip(p)))
    return F.array_join(F.array_sort(parts), "||")


def upsert_cache(cache: DataFrame, arrivals: DataFrame) -> DataFrame:
    """Cache with one row per normalised query; the latest text wins."""
    both = cache.unionByName(arrivals).withColumn("query", cache_key(F.col("query")))
    return top_per_key(both, ["query"], [F.desc("created_at"), F.desc("cache_id")])


def cache_lookup(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Requests (query) with their cached text; a NULL text must be fetched."""
    keyed = requests.withColumn("key", cache_key(F.col("query")))
    return keyed.join(cache.select(F.col("query").alias("key"), "summary_text", "search_source"), "key", "left")


def cache_stats(cache: DataFrame) -> DataFrame:
    return cache.agg(F.count("*").alias("total"), F.max("created_at").alias("latest"))


def latest_cache(cache: DataFrame, n: int = 20) -> DataFrame:
    return cache.orderBy(F.desc("created_at"), "cache_id").limit(n)


def background_summary(answers: DataFrame) -> DataFrame:
    """Text per answer (entity_name, search_json, model_text): parts joined, labelled by source."""
    schema = ("Abstract string, AbstractURL string, Infobox struct<content:array<struct<label:string,value:string>>>, "
              "RelatedTopics array<struct<Text:string>>")
    d = F.col("_d")
    blank = lambda c: F.coalesce(c, F.lit(""))
    url = F.nullif(d["AbstractURL"], F.lit(""))
    abstract = K.strip(blank(d["Abstract"]))
    lead = F.when(abstract != "", F.concat(
        abstract, F.coalesce(F.concat(F.lit("（来源: "), url, F.lit("）")), F.lit(""))))
    empty = F.array().cast("array<string>")
    facts = F.transform(
        F.filter(d["Infobox"]["content"], lambda i: (blank(i["label"]) != "") & (blank(i["value"]) != "")),
        lambda i: F.concat(i["label"], F.lit(": "), i["value"]))
    topics = F.transform(
        F.filter(d["RelatedTopics"], lambda r: r["Text"].contains(F.col("entity_name"))), lambda r: r["Text"])
    parts = F.concat(F.array_compact(F.array(lead)), F.coalesce(facts, empty), F.coalesce(topics, empty))
    staged = answers.withColumn("_d", F.from_json("search_json", schema)).withColumn(
        "_web", F.array_join(parts, " | ")).withColumn("_ai", K.strip(blank(F.col("model_text"))))
    web, ai = F.col("_web") != "", F.col("_ai") != ""
    text = F.concat_ws("\n", F.when(web, F.concat(F.lit("[网络搜索] "), "_web")), F.when(ai, F.concat(F.lit("[AI知识库] "), "_ai")))
    source = F.when(web & ai, "combined").when(web, "duckduckgo").when(ai, "llm_knowledge").otherwise("none")
    return staged.select(*[c for c in answers.columns if c not in ("search_json", "model_text")],
                         text.alias("summary_text"), source.alias("search_source"))


def known_entity_lines(entities: DataFrame, aliases: DataFrame, relations: DataFrame) -> DataFrame:
    """Context lines per entity, in reading order: (entity_id, canonical_name, part, pos, line).

    Part 0 is the entity with its aliases, 1 outgoing and 2 incoming relations. Lines
    stay rows, so a hub entity is never gathered in one task; sort by
    (canonical_name, entity_id, part, pos) to read them.
    """
    joined = aliases.groupBy("entity_id").agg(F.array_join(F.array_sort(F.collect_list("alias_name")), ", ").alias("a"))
    heads = entities.join(joined, "entity_id", "left").select(
        "entity_id", "canonical_name", F.lit(0).alias("part"), F.lit("").alias("pos"),
        F.concat(F.lit("- "), "canonical_name", F.lit(" ["), "entity_type", F.lit("]"),
                 F.coalesce(F.concat(F.lit(" (别名: "), "a", F.lit(")")), F.lit(""))).alias("line"))
    share = F.get_json_object("detail_json", "$.share_pct")
    pct = F.coalesce(F.concat(F.lit(" ("), share, F.lit("%)")), F.lit(""))
    name = lambda k, n: entities.select(F.col("entity_id").alias(k), F.col("canonical_name").alias(n))
    full = relations.join(name("from_entity_id", "_f"), "from_entity_id").join(name("to_entity_id", "_t"), "to_entity_id")
    out = full.select(F.col("from_entity_id").alias("entity_id"), F.col("_f").alias("canonical_name"), F.lit(1).alias("part"),
                      F.col("relation_id").alias("pos"), F.concat(F.lit("  → "), "relation_type", F.lit(": "), "_t", pct).alias("line"))
    inc = full.select(F.col("to_entity_id").alias("entity_id"), F.col("_t").alias("canonical_name"), F.lit(2).alias("part"),
                      F.col("relation_id").alias("pos"), F.concat(F.lit("  ← "), "relation_type", F.lit(" of "), "_f", pct).alias("line"))
    return heads.unionByName(out).unionByName(inc)
