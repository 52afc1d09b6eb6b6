"""Fact de-duplication.

The best fact of a key is found by an aggregate with map-side combine, and only
keys with more than one fact are joined back. No window ever holds a whole key
group, so one key may own a third of all facts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom import config as C
from factloom.functions import keys as K
from factloom.operators.common import is_active, null_safe
from factloom.session import reread

_INF = float("inf")


def _rank_struct() -> Column:
    """Sorts the best fact first: confidence desc, created asc, id."""
    return F.struct(
        F.coalesce(-F.col("confidence_score"), F.lit(_INF)).alias("s"), "created_at", "fact_id")


def with_fact_key(facts: DataFrame) -> DataFrame:
    return facts.withColumns(K.fact_key_columns())


def live_facts(facts: DataFrame, **more: Column) -> DataFrame:
    """Active facts with the digest of their key and what ranks them: the few columns that the layers shuffle."""
    return facts.filter(is_active()).select(
        "fact_id", "document_id", "confidence_score", "created_at", K.fact_fingerprint().alias("k_all"), *[c.alias(n) for n, c in more.items()])


def _repeated_keys(keyed: DataFrame, keys: list[str]) -> DataFrame:
    """Keys held by several facts, with the id of the fact to keep."""
    return (
        keyed.groupBy(*keys)
        .agg(F.count("*").alias("_n"), F.min(_rank_struct()).alias("_best"))
        .filter("_n > 1")
        .select(*keys, F.col("_best.fact_id").alias("canonical_id"))
    )


def duplicates_by_key(keyed: DataFrame, keys: list[str]) -> DataFrame:
    """(fact_id, canonical_id) for every fact that repeats a better one."""
    best = _repeated_keys(keyed, keys)
    return (
        keyed.join(best, null_safe(keyed, best, keys))
        .filter(F.col("fact_id") != F.col("canonical_id"))
        .select("fact_id", "canonical_id")
    )


def _noted(marks: DataFrame, before: str, after: str) -> DataFrame:
    return marks.withColumn("review_note", F.concat(F.lit(before), "canonical_id", F.lit(after)))


def within_document(facts: DataFrame) -> DataFrame:
    """Marks for facts repeated inside one document."""
    marks = duplicates_by_key(live_facts(facts), ["document_id", "k_all"])
    return _noted(marks, "重复: 与 ", " 重复（同文档）")


def cross_document(new: DataFrame, existing: DataFrame) -> DataFrame:
    """Marks for facts that new documents share with existing ones.

    A new fact that is no better than the best existing one is marked; otherwise
    the existing one is marked, citing the best new fact that beats it.
    """
    return cross_marks(live_facts(new), live_facts(existing))


def cross_marks(fresh: DataFrame, existing: DataFrame) -> DataFrame:
    """``cross_document`` over rows of ``live_facts``."""
    # one small row per key; documents of the two sides are disjoint by contract
    stock = existing.groupBy("k_all").agg(F.min(_rank_struct()).alias("_old"))
    met = fresh.join(stock, "k_all").select(
        "fact_id", "confidence_score", "created_at", "_old",
        (F.coalesce("confidence_score", F.lit(0.0)) > F.coalesce(-F.col("_old.s"), F.lit(0.0))).alias("_wins"))
    lost = _noted(
        met.filter(~F.col("_wins")).select("fact_id", F.col("_old.fact_id").alias("canonical_id")),
        "重复: 与 ", " 重复（跨文档）")
    replaced = _noted(
        met.filter("_wins").groupBy(F.col("_old.fact_id").alias("old_id"))
        .agg(F.min(_rank_struct()).alias("_best"))
        .select(F.col("old_id").alias("fact_id"), F.col("_best.fact_id").alias("canonical_id")),
        "重复: 与 ", " 重复（跨文档，分数更低）")
    return lost.unionByName(replaced)


def _place(col: str) -> Column:
    return F.lower(K.strip(F.coalesce(F.col(col), F.lit(""))))


def cross_type(facts: DataFrame, use_location: bool = True) -> DataFrame:
    """Investments without an amount that restate an expansion of the same document."""
    keys = ["document_id", "k_subject"] + (["k_place"] if use_location else [])
    live = facts.filter(is_active()).select("fact_id", "document_id", "created_at", *[c.alias(n) for n, c in _kind_columns().items()])
    return kind_marks(live, keys)


def _kind_columns() -> dict[str, Column]:
    """What the cross-type layer compares; NULL for facts that it does not look at."""
    kind = F.when(F.col("fact_type") == "EXPANSION", "target").when(
        (F.col("fact_type") == "INVESTMENT") & F.col("value_num").isNull(), "bare")
    return {"kind": kind, "k_subject": F.when(kind.isNotNull(), K.subject_key(F.col("subject_text"))), "k_place": F.when(kind.isNotNull(), _place("location_text"))}


def kind_marks(live: DataFrame, keys: list[str]) -> DataFrame:
    """``cross_type`` over active facts with ``_kind_columns``."""
    bare = live.filter("kind = 'bare'")
    target = (
        live.filter("kind = 'target'").groupBy(*keys)
        .agg(F.max(F.struct("created_at", "fact_id")).alias("_last"))
        .select(*keys, F.col("_last.fact_id").alias("canonical_id"))
    )
    marks = bare.join(target, keys).select("fact_id", "canonical_id")
    return _noted(marks, "重复: 无金额INVESTMENT，与EXPANSION ", " 重叠")


def global_fingerprint(facts: DataFrame) -> DataFrame:
    """Marks for facts repeated anywhere."""
    # written: the best of a key is found first and then met by all facts, whose keys are costly
    live = reread(live_facts(facts).select("fact_id", "confidence_score", "created_at", "k_all"), "live")
    return _noted(duplicates_by_key(live, ["k_all"]), "重复: 与 ", " 重复")


def global_cross_type(facts: DataFrame) -> DataFrame:
    return cross_type(facts, use_location=False)


EXACT_KEYS = ["document_id", "fact_type", "subject_text", "predicate", "object_text"]


def exact_groups(facts: DataFrame) -> DataFrame:
    """Groups of facts equal on the literal key, with their size."""
    return facts.groupBy(*EXACT_KEYS).agg(F.count("*").alias("n")).filter("n > 1")


def exact_duplicates(facts: DataFrame) -> DataFrame:
    """Marks for facts equal on the literal key; the best confidence is kept."""
    return duplicates_by_key(facts, EXACT_KEYS)


def apply_marks(facts: DataFrame, marks: DataFrame) -> DataFrame:
    """Snapshot with marked facts set to duplicate and their note replaced."""
    m = marks.select("fact_id", F.col("review_note").alias("_note"))
    return (
        facts.join(m, "fact_id", "left")
        .withColumns({
            "review_status": F.when(F.col("_note").isNotNull(), C.DUPLICATE).otherwise(F.col("review_status")),
            "review_note": F.coalesce("_note", "review_note"),
        })
        .select(*facts.columns)
    )


def three_layers(facts: DataFrame, is_new: Column) -> tuple[DataFrame, DataFrame]:
    """Run within-document, cross-document and cross-type layers for the new
    documents; returns the marks of all layers and the updated snapshot.

    The narrow rows that all layers compare are written once; so the facts are derived and joined once, however many
    layers read them. What the first layer leaves of new documents is the best fact per document and key, so
    the second needs no facts again; the third looks at investments and expansions alone.
    """
    live = reread(live_facts(facts, is_new=is_new, **_kind_columns()), "live")
    new = live.filter("is_new")
    best = reread(new.groupBy("document_id", "k_all").agg(F.count("*").alias("n"), F.min(_rank_struct()).alias("b")), "best")
    # written apart: known to be small, it is sent to the facts and they stay where they are
    repeated = reread(best.filter("n > 1").select("document_id", "k_all", F.col("b.fact_id").alias("canonical_id")), "repeated")
    inner = _noted(new.join(repeated, ["document_id", "k_all"]).filter("fact_id <> canonical_id").select("fact_id", "canonical_id"),
                   "重复: 与 ", " 重复（同文档）")
    inner = reread(inner.withColumn("layer", F.lit("within_doc")), "marks")
    score = F.nullif(-F.col("b.s"), F.lit(-_INF))
    left = best.select("k_all", "b.fact_id", "b.created_at", score.alias("confidence_score"))
    across = reread(cross_marks(left, live.filter("NOT is_new")).withColumn("layer", F.lit("cross_doc")), "marks")
    marked = inner.select("fact_id").unionByName(across.select("fact_id"))
    settled = new.filter("kind IS NOT NULL").join(marked, "fact_id", "left_anti")
    kinds = reread(kind_marks(settled, ["document_id", "k_subject", "k_place"]).withColumn("layer", F.lit("cross_type")), "marks")
    marks = inner.unionByName(across).unionByName(kinds)
    # no fact is marked twice: a marked fact is inactive in the layers that follow
    return marks, apply_marks(facts, marks)
