"""Entity profiles, built for all entities at once.

Profiles are kept as long tables (one row per relation, benchmark, competitor), so
an entity with a third of all rows never becomes one giant row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions import keys as K
from factloom.operators.common import approved, top_per_key


def profile_relations(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Relations seen from each entity, with direction and detail."""
    name = entities.select(F.col("entity_id").alias("target_id"), F.col("canonical_name").alias("target_name"))
    side = lambda own, other, direction: relations.select(
        F.col(own).alias("entity_id"), F.col(other).alias("target_id"), "relation_type", F.lit(direction).alias("direction"),
        F.coalesce(F.nullif("detail_json", F.lit("")), F.lit("{}")).alias("detail_json"))
    both = side("from_entity_id", "to_entity_id", "outgoing").unionByName(side("to_entity_id", "from_entity_id", "incoming"))
    return both.join(name, "target_id")


def profile_benchmarks(facts: DataFrame) -> DataFrame:
    """The numeric facts of each entity, one per (type, predicate, time)."""
    numeric = approved(facts).filter(F.col("subject_entity_id").isNotNull() & F.col("value_num").isNotNull())
    first = top_per_key(numeric, ["subject_entity_id", "fact_type", "predicate", "time_expr"], [F.col("fact_id")])
    return first.select(F.col("subject_entity_id").alias("entity_id"), "fact_type", F.col("predicate").alias("metric"),
                        F.col("value_num").alias("value"), "value_text", "unit", "currency", F.col("time_expr").alias("time"), "fact_id")


def profile_competitors(facts: DataFrame, co_ranked: int | None = None) -> DataFrame:
    """Ranking objects, then subjects ranked in the same documents, or the first ``co_ranked`` of these by name.

    Documents are joined over distinct (document, entity, name) rows, so a document
    with many ranking facts does not multiply them.
    """
    ranking = facts.filter(F.col("fact_type") == "COMPETITIVE_RANKING")
    direct = approved(ranking).filter(F.col("subject_entity_id").isNotNull() & (F.col("object_text") != "")).groupBy(
        F.col("subject_entity_id").alias("entity_id"), F.col("object_text").alias("name")).agg(
        F.min("object_entity_id").alias("competitor_id")).withColumn("how", F.lit(0))
    linked = ranking.filter(F.col("subject_entity_id").isNotNull())
    here = linked.select("document_id", F.col("subject_entity_id").alias("entity_id")).distinct()
    there = approved(linked).select("document_id", F.col("subject_entity_id").alias("competitor_id"), F.col("subject_text").alias("name")).distinct()
    met = here.join(there, "document_id").filter("entity_id <> competitor_id").select("entity_id", "competitor_id", "name").distinct()
    few = met if co_ranked is None else top_per_key(met, ["entity_id"], [F.col("name"), F.col("competitor_id")], co_ranked)
    return top_per_key(direct.unionByName(few.withColumn("how", F.lit(1))), ["entity_id", "name"], [F.col("how"), F.col("competitor_id")])


def build_profiles(facts: DataFrame, entities: DataFrame, aliases: DataFrame, relations: DataFrame, cache: DataFrame,
                   min_facts: int = 1) -> DataFrame:
    """Profile header per entity with enough approved facts: counts, summary, source."""
    counts = approved(facts).filter(F.col("subject_entity_id").isNotNull()).groupBy(
        F.col("subject_entity_id").alias("entity_id")).agg(F.count("*").alias("fact_count")).filter(F.col("fact_count") >= min_facts)
    tally = lambda df, name: df.groupBy("entity_id").agg(F.count("*").alias(name))
    texts = top_per_key(cache.filter(F.col("entity_name") == F.col("query")), ["entity_name"], [F.desc("created_at"), F.desc("cache_id")]) \
        .select(F.col("entity_name").alias("canonical_name"), F.col("summary_text").alias("_s"))
    out = entities.join(counts, "entity_id").join(texts, "canonical_name", "left")
    for df, name in ((aliases, "n_aliases"), (profile_relations(relations, entities), "n_relations"),
                     (profile_benchmarks(facts), "n_benchmarks"), (profile_competitors(facts), "n_competitors")):
        out = out.join(tally(df, name), "entity_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out.select("entity_id", "canonical_name", "entity_type", "fact_count", "n_aliases", "n_relations", "n_benchmarks",
                      "n_competitors", F.coalesce("_s", F.lit("")).alias("summary_text"), F.lit("聚合").alias("profile_source"))


def upsert_profiles(stored: DataFrame, built: DataFrame) -> DataFrame:
    """Snapshot in which rebuilt profiles replace stored ones."""
    kept = stored.join(built.select("entity_id"), "entity_id", "left_anti")
    return kept.unionByName(built, allowMissingColumns=True)


def enrich_profiles(profiles: DataFrame, competitors: DataFrame, aliases: DataFrame, entities: DataFrame,
                    background: DataFrame) -> dict[str, DataFrame]:
    """Merge parsed background (entity_id, aliases[], competitors[], summary).

    New aliases must be unused anywhere; the longer summary wins.
    """
    given = background.select("entity_id", F.explode("aliases").alias("alias_name")).withColumn("alias_name", K.strip(F.col("alias_name")))
    named = given.join(entities.select("entity_id", "canonical_name"), "entity_id").filter(
        (F.col("alias_name") != "") & (F.col("alias_name") != F.col("canonical_name")))
    fresh = top_per_key(named.join(aliases.select("alias_name"), "alias_name", "left_anti"), ["alias_name"], [F.col("entity_id")])
    new_aliases = fresh.select(F.sha2(F.concat_ws("|", F.lit("alias"), "alias_name"), 256).alias("alias_id"), "entity_id", "alias_name")
    rivals = background.select("entity_id", F.explode("competitors").alias("name")).withColumn("name", K.strip(F.col("name"))).filter("name <> ''")
    new_rivals = rivals.distinct().join(competitors.select("entity_id", "name"), ["entity_id", "name"], "left_anti").select(
        "entity_id", "name", F.lit(None).cast("string").alias("competitor_id"), F.lit(2).alias("how"))
    b = background.select("entity_id", F.coalesce("summary", F.lit("")).alias("_new"), F.lit(True).alias("_hit"))
    merged = profiles.join(b, "entity_id", "left").withColumns({
        "summary_text": F.when(F.length("_new") > F.length("summary_text"), F.col("_new")).otherwise(F.col("summary_text")),
        "profile_source": F.when(F.col("_hit"), "聚合+搜索").otherwise(F.col("profile_source"))}).select(*profiles.columns)
    return {"profiles": merged, "aliases": new_aliases, "competitors": new_rivals}


def unprofiled(entities: DataFrame, stored: DataFrame) -> DataFrame:
    """Entities whose profile has to be built before it can be read."""
    return entities.join(stored.select("entity_id"), "entity_id", "left_anti")
