"""Entity linking, discovery and maintenance.

Names are resolved once per distinct text and joined back, whatever number of
facts uses them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom import config as C
from factloom.functions import keys as K
from factloom.operators.common import approved, contained_in, fold_ascii, keep_first, role_union, scattered, top_per_key
from factloom.session import checkpoint

_NAME = ["canonical_name"]


def distinct_texts(facts: DataFrame, *columns: str) -> DataFrame:
    """Distinct non-blank texts of the given fact columns."""
    stacked = facts.select(F.explode(F.array(*[K.strip(F.col(c)) for c in columns])).alias("text"))
    return stacked.filter(F.col("text") != "").distinct()


def _normalized_probe(text: str = "text") -> Column:
    norm = K.normalized_name(F.col(text))
    return F.when((norm != F.col(text)) & (norm != ""), norm)


def link_names(texts: DataFrame, entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """Resolve distinct ``text`` values: (text, entity_id, canonical_name, matched, how).

    Rules in order: exact name, alias, normalised name, normalised alias, name
    containing the text (shortest), name containing the normalised text, name
    contained in the text (longest). Ties go to the smaller name, then id.
    """
    names = texts.withColumn("norm", _normalized_probe())
    targets = entities.select(F.col("canonical_name").alias("key"), "entity_id", "canonical_name", F.lit(0).alias("via_alias")) \
        .unionByName(aliases.join(entities.select("entity_id", "canonical_name"), "entity_id").select(
            F.col("alias_name").alias("key"), "entity_id", "canonical_name", F.lit(1).alias("via_alias")))
    probes = names.select("text", F.posexplode(F.array("text", "norm")).alias("form", "key")).filter("key is not null")
    order = [F.col("rank"), F.col("canonical_name"), F.col("entity_id")]
    exact = checkpoint(top_per_key(
        probes.join(targets, "key").withColumn("rank", F.col("form") * 2 + F.col("via_alias") + 1), ["text"], order))

    # both containment joins list this side more than once
    rest = checkpoint(names.join(exact.select("text"), "text", "left_anti"))
    known = entities.select("entity_id", "canonical_name", fold_ascii(F.col("canonical_name")).alias("folded"))
    forms = rest.select("text", F.posexplode(F.array("text", "norm")).alias("form", "key")).filter("key is not null") \
        .withColumn("key_folded", fold_ascii(F.col("key")))
    inside = (
        contained_in(forms, known, "key_folded", "folded").filter(F.col("canonical_name") != F.col("key"))
        .select("text", "entity_id", "canonical_name", (F.col("form") + 5).alias("rank"),
                F.length("canonical_name").alias("size"))
    )
    around = (
        contained_in(known, rest.withColumn("text_folded", fold_ascii(F.col("text"))), "folded", "text_folded")
        .filter(F.col("canonical_name") != F.col("text"))
        .select("text", "entity_id", "canonical_name", F.lit(7).alias("rank"), (-F.length("canonical_name")).alias("size"))
    )
    near = top_per_key(inside.unionByName(around), ["text"],
                       [F.col("rank"), F.col("size"), F.col("canonical_name"), F.col("entity_id")])
    hits = exact.select("text", "entity_id", "canonical_name", "rank").unionByName(
        near.select("text", "entity_id", "canonical_name", "rank"))
    return texts.join(hits, "text", "left").select(
        "text", "entity_id", F.coalesce("canonical_name", "text").alias("canonical_name"),
        F.col("entity_id").isNotNull().alias("matched"), F.col("rank").alias("rule"))


def discover(facts: DataFrame, entities: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new entities, new aliases) from subject and object texts nobody knows yet.

    All texts are judged at once: a text contained in a known or new name becomes an
    alias of the shortest such entity, the other texts become entities.
    """
    stacked = facts.select("fact_id", "fact_type", F.explode(F.array(
        K.strip(F.col("subject_text")), K.strip(F.col("object_text")))).alias("text"))
    found = stacked.filter((F.col("text") != "") & ~F.col("text").isin(*C.STOP_NAMES)).groupBy("text").agg(
        F.min_by("fact_type", "fact_id").alias("fact_type"))
    # one row per unknown name and one per containment: the facts are read once
    fresh = checkpoint(found.join(entities.select(F.col("canonical_name").alias("text")), "text", "left_anti")
                       .join(aliases.select(F.col("alias_name").alias("text")), "text", "left_anti")
                       .withColumn("text_folded", fold_ascii(F.col("text"))))

    stored = entities.select("entity_id", F.col("canonical_name").alias("name"))
    holders = stored.withColumn("is_new", F.lit(False)).unionByName(fresh.select(
        _new_entity_id(F.col("text")).alias("entity_id"), F.col("text").alias("name"), F.lit(True).alias("is_new"))) \
        .withColumn("name_folded", fold_ascii(F.col("name")))
    held = checkpoint(contained_in(fresh.select("text", "text_folded"), holders, "text_folded", "name_folded").filter(
        (F.col("name") != F.col("text"))
        # of two spellings that differ in case only, the smaller one holds the other
        & ((F.length("name") > F.length("text")) | ~F.col("is_new") | (F.col("name") < F.col("text")))))
    contained = held.select("text").distinct()
    tops = fresh.join(contained, "text", "left_anti")
    owner = top_per_key(
        held.join(contained.select(F.col("text").alias("name")), "name", "left_anti")
        .unionByName(held.filter(~F.col("is_new")).join(
            contained.select(F.col("text").alias("name")), "name", "left_semi")),
        ["text"], [F.col("is_new"), F.length("name"), F.col("name"), F.col("entity_id")])
    new_entities = tops.select(
        _new_entity_id(F.col("text")).alias("entity_id"), F.col("text").alias("canonical_name"),
        F.col("text").alias("normalized_name"), K.entity_type(F.col("text"), F.col("fact_type")).alias("entity_type"))
    new_aliases = owner.select(
        F.sha2(F.concat_ws("|", F.lit("alias"), "text"), 256).alias("alias_id"), "entity_id",
        F.col("text").alias("alias_name"))
    return new_entities, new_aliases


def _new_entity_id(name: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit("entity"), name), 256)


def missing_places(entities: DataFrame) -> DataFrame:
    """Standard place entities not stored yet."""
    places = entities.sparkSession.createDataFrame(list(C.PLACE_TYPES.items()), "canonical_name string, entity_type string")
    return places.join(entities.select(*_NAME), _NAME, "left_anti").select(
        _new_entity_id(F.col("canonical_name")).alias("entity_id"), "canonical_name",
        F.col("canonical_name").alias("normalized_name"), "entity_type")


def link_places(texts: DataFrame, entities: DataFrame) -> DataFrame:
    """Resolve place texts: exact name, else the first listed place word inside."""
    words = F.array(*[F.lit(w) for w in C.PLACE_TYPES])
    inside = F.filter(words, lambda w: F.col("text").contains(w))
    probes = texts.select("text", F.posexplode(F.concat(F.array("text"), inside)).alias("rank", "canonical_name"))
    hits = probes.join(entities.select("entity_id", "canonical_name"), "canonical_name")
    return top_per_key(hits, ["text"], [F.col("rank"), F.col("entity_id")]).select("text", "entity_id")


def link_facts(facts: DataFrame, entities: DataFrame, aliases: DataFrame) -> dict[str, DataFrame]:
    """Discover, link all three roles, and count.

    Returns facts, entities, aliases (snapshots), and stats. Facts with no missing
    link pass through.
    """
    open_facts = facts.filter(
        F.col("subject_entity_id").isNull() | F.col("object_entity_id").isNull() | F.col("location_entity_id").isNull())
    places = missing_places(entities)
    columns = ["entity_id", "canonical_name", "normalized_name", "entity_type"]
    with_places = entities.select(*columns).unionByName(places.select(*columns))
    # both tables feed several joins below; one row per new name
    created, added = (checkpoint(df) for df in discover(open_facts, with_places, aliases))
    all_entities = with_places.unionByName(created)
    all_aliases = aliases.select("alias_id", "entity_id", "alias_name").unionByName(added)
    names = link_names(checkpoint(distinct_texts(open_facts, "subject_text", "object_text")), all_entities, all_aliases) \
        .filter("matched").select("text", "entity_id")
    spots = link_places(distinct_texts(open_facts, "location_text"), all_entities)

    def attach(df: DataFrame, links: DataFrame, text: str, flag: str) -> DataFrame:
        side = links.select(F.col("text").alias("_t"), F.col("entity_id").alias(flag))
        return df.join(side, scattered(K.strip(F.col(text)), F.col("fact_id")) == F.col("_t"), "left").drop("_t")

    linked = attach(attach(attach(open_facts, names, "subject_text", "_s"), names, "object_text", "_o"),
                    spots, "location_text", "_l")
    roles = (("subject_text", "_s"), ("object_text", "_o"), ("location_text", "_l"))
    asked = [(F.coalesce(F.col(t), F.lit("")) != "", F.col(f).isNotNull()) for t, f in roles]
    stats = linked.agg(
        F.count("*").alias("processed"),
        sum((F.count_if(a & m) for a, m in asked), F.lit(0)).alias("matched"),
        sum((F.count_if(a & ~m) for a, m in asked), F.lit(0)).alias("unmatched"),
    ).withColumn("created", created.agg(F.count("*")).scalar())
    done = linked.withColumns({
        "subject_entity_id": F.coalesce("_s", "subject_entity_id"),
        "object_entity_id": F.coalesce("_o", "object_entity_id"),
        "location_entity_id": F.coalesce("_l", "location_entity_id")}).select(*facts.columns)
    closed = facts.filter(
        F.col("subject_entity_id").isNotNull() & F.col("object_entity_id").isNotNull() & F.col("location_entity_id").isNotNull())
    return {"facts": done.unionByName(closed), "entities": all_entities, "aliases": all_aliases, "stats": stats}


def backfill_key(col: Column) -> Column:
    return F.replace(F.translate(F.lower(K.strip(col)), "（）", "()"), F.lit(" "))


def backfill_links(facts: DataFrame, entities: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fill missing subject/object links of approved facts by folded name.

    Aliases win over names; of several entities the greatest id wins. Returns
    (links found: fact_id, role, entity_id; unmatched texts with counts).
    """
    named = entities.select("entity_id", F.explode(F.array("canonical_name", "normalized_name")).alias("n")) \
        .withColumn("rank", F.lit(1)).unionByName(
            aliases.select("entity_id", F.col("alias_name").alias("n"), F.lit(0).alias("rank")))
    keyed = named.withColumn("key", backfill_key(F.col("n"))).filter(F.col("key") != "")
    table = keyed.groupBy("key").agg(
        F.max(F.struct((-F.col("rank")).alias("p"), "entity_id"))["entity_id"].alias("entity_id"))
    live = approved(facts)
    role = lambda name, text, link: live.filter(F.col(link).isNull() & (F.col(text) != "")).select(
        "fact_id", F.lit(name).alias("role"), F.col(text).alias("text"))
    missing = role("subject", "subject_text", "subject_entity_id").unionByName(
        role("object", "object_text", "object_entity_id")).withColumn("key", backfill_key(F.col("text")))
    joined = missing.join(table, "key", "left")
    unmatched = joined.filter(F.col("entity_id").isNull()).groupBy("role", "text").agg(F.count("*").alias("n"))
    return joined.filter(F.col("entity_id").isNotNull()).select("fact_id", "role", "entity_id"), unmatched


def disambiguate(names: DataFrame, entities: DataFrame, facts: DataFrame, docs: DataFrame,
                 context: str | None = None) -> DataFrame:
    """Candidate entities of each distinct ``text``, with confidence and hints.

    Hints are the distinct qualifier values and titles of all facts of an entity.
    """
    probes = names.withColumn("norm", _normalized_probe()).select(
        "text", F.explode(F.array_distinct(F.array_compact(F.array("text", "norm")))).alias("canonical_name"))
    hits = probes.join(entities.select("entity_id", "canonical_name", "entity_type"), "canonical_name")
    wanted = hits.select("entity_id").distinct()
    seen = role_union(facts.filter(F.col("qualifier_json").isNotNull()), "document_id", "qualifier_json") \
        .join(wanted, "entity_id", "left_semi")
    titled = seen.join(docs.select("document_id", "title"), "document_id")
    values = F.filter(F.map_values(K.qualifiers(F.col("qualifier_json"))), lambda v: K.strip(v) != "")
    told = F.concat(F.transform(values, lambda v: F.struct(F.lit("q").alias("kind"), K.strip(v).alias("v"))),
                    F.array(F.struct(F.lit("t").alias("kind"), F.col("title").alias("v"))))
    distinct = titled.select("entity_id", F.inline(told)).distinct()  # before anything is gathered
    of = lambda kind: F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.col("v"))))
    hints = distinct.groupBy("entity_id").agg(of("q").alias("q"), of("t").alias("t"))
    counts = hits.groupBy("text").agg(F.count("*").alias("_n"))
    rows = hits.join(hints, "entity_id", "left").join(counts, "text")
    place, own = K.bracketed_place(F.col("canonical_name")), K.bracketed_place(F.col("text"))
    aware = F.lit(False) if not context else F.exists(
        F.coalesce("q", F.array().cast("array<string>")), lambda v: F.lit(context.lower()).contains(v))
    confidence = F.when(place.eqNullSafe(own), F.when(place.isNotNull(), 0.85).otherwise(0.75)).when(aware, 0.88).otherwise(0.5)
    note = F.concat_ws(
        "；", F.when(place.isNotNull(), F.concat(F.lit("括号含地理修饰词'"), place, F.lit("'"))),
        F.when(F.col("_n") > 1, F.when(
            place.isNotNull(), F.concat(F.lit("另有"), (F.col("_n") - 1).cast("string"), F.lit("个同名实体，需结合上下文判断")))
            .otherwise(F.concat(F.lit("存在"), F.col("_n").cast("string"), F.lit("个同名实体，需结合上下文判断")))))
    found = rows.select(
        "text", "entity_id", "canonical_name", "entity_type", place.alias("place"), confidence.alias("confidence"),
        F.array_join("q", ",").alias("qualifiers"), F.array_join("t", ",").alias("titles"),
        note.alias("note"), F.lit("match_best" if context else "require_manual").alias("fallback"))
    none = names.join(hits.select("text").distinct(), "text", "left_anti").withColumn("fallback", F.lit("create_new"))
    return found.unionByName(none, allowMissingColumns=True)


def add_entities(entities: DataFrame, additions: DataFrame) -> DataFrame:
    """New entity rows whose (name, type) is free."""
    key = ["canonical_name", "entity_type"]
    return keep_first(additions, entities, key, [F.col("entity_id")])


def add_aliases(aliases: DataFrame, entities: DataFrame, additions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted aliases, conflicts with reason). An alias name is unique everywhere."""
    given = additions.withColumn("alias_name", K.strip(F.col("alias_name")))
    owners = entities.select("entity_id", F.lit(True).alias("_known"))
    taken = aliases.select("alias_name", F.lit(True).alias("_taken")).distinct()
    judged = given.join(owners, "entity_id", "left").join(taken, "alias_name", "left").withColumn(
        "reason", F.when(F.col("alias_name") == "", "blank").when(F.col("_known").isNull(), "unknown entity")
        .when(F.col("_taken"), "alias in use")).drop("_known", "_taken")
    accepted = top_per_key(judged.filter(F.col("reason").isNull()), ["alias_name"], [F.col("entity_id")]).drop("reason")
    return accepted, judged.filter(F.col("reason").isNotNull())


def rename_entities(entities: DataFrame, facts: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Apply renames/retypes (entity_id, new_name, new_type); names flow into linked facts."""
    c = changes.select("entity_id", K.blank_to_null(F.col("new_name")).alias("_name"),
                       F.nullif("new_type", F.lit("")).alias("_type"))
    normal = F.lower(F.regexp_replace("_name", r"(?U)[（(）)\s]", ""))
    renamed = entities.join(c, "entity_id", "left").withColumns({
        "canonical_name": F.coalesce("_name", "canonical_name"),
        "normalized_name": F.coalesce(normal, "normalized_name"),
        "entity_type": F.coalesce("_type", "entity_type")}).select(*entities.columns)
    names = c.filter(F.col("_name").isNotNull())

    def carry(df: DataFrame, link: str, text: str) -> DataFrame:
        side = names.select(F.col("entity_id").alias("_id"), F.col("_name").alias("_new"))
        joined = df.join(side, scattered(F.col(link), F.col("fact_id")) == F.col("_id"), "left")
        return joined.withColumn(text, F.coalesce("_new", text)).select(*df.columns)

    return renamed, carry(carry(facts, "subject_entity_id", "subject_text"), "object_entity_id", "object_text")


def delete_aliases(aliases: DataFrame, deletions: DataFrame) -> DataFrame:
    """Aliases without the deleted (alias_id, entity_id) pairs."""
    return aliases.join(deletions.select("alias_id", "entity_id"), ["alias_id", "entity_id"], "left_anti")
