"""Mixing sources to target word counts by Pareto order sampling.

Sources share a multiple of all words by weight; a source's target stops at
``max_copies`` times its words, and what is above goes to the others by weight until no
target is above. A document's expected copies are its source's rate times its merit;
their whole part is certain. The fractional part is its inclusion probability for one
more copy: documents are ranked by random odds divided by inclusion odds, and each
source takes from the top until its words are nearest to what its target still lacks.

The cut of a source is found from sums over 1,024 and again 1,024 rank cells, so only the
rows of one cell in a million are ever sorted, whatever share of the corpus a source
has. The plan (one row per source) then decides every document by itself.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.tables import chance, word_count
from factloom.session import checkpoint

#: A plan of at most so many sources (about 20 MB) is broadcast; a larger one is joined by shuffle.
BROADCAST_SOURCES = 100_000
CELLS = 1 << 10


def _attach(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Add the plan's columns; the plan has one row per source and null is a source like others."""
    plan = plan.withColumnRenamed("source", "_source")
    if plan.count() <= BROADCAST_SOURCES:
        plan = F.broadcast(plan)
    return rows.join(plan, rows["source"].eqNullSafe(plan["_source"])).drop("_source")


def targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, max_copies: int = 2) -> DataFrame:
    """(source, source_size, merit_size, target) from (source, source_size, merit_size).

    Sources in code point order, null last, weigh ``weights``, repeating. Ranks come from
    a range partitioning, so sources are never sorted in one task.
    """
    order = [F.col("source").isNull(), F.col("source")]
    ranged = checkpoint(sizes.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = ranged.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    place = F.col("_offset") + F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    ranked = checkpoint(
        ranged.join(offsets, "_part").withColumn("weight", weight)
        .withColumn("limit", F.col("source_size") * F.lit(float(max_copies))).drop("_part", "_offset"))
    total, free = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    goal = share * (total or 0)
    level = goal / free if free else 0.0
    while True:  # each round caps at least one more source, so it ends
        above = F.col("weight") * F.lit(level) > F.col("limit")
        capped, free = ranked.agg(F.sum(F.when(above, F.col("limit"))), F.sum(F.when(~above, F.col("weight")))).first()
        raised = (goal - (capped or 0.0)) / free if free else level
        if raised <= level:
            break
        level = raised
    return ranked.select("source", "source_size", "merit_size", F.least(F.col("weight") * F.lit(level), "limit").alias("target"))


def _expected(rows: DataFrame, max_copies: int) -> DataFrame:
    """Add the certain copies and the rank of the one more copy (null where none is possible)."""
    rate = F.coalesce(F.try_divide("target", "merit_size"), F.lit(0.0))
    expected = F.least(F.lit(float(max_copies)), rate * F.col("merit"))
    part = F.col("_expected") - F.col("certain")
    odds = F.try_divide(F.col("_chance") / (1 - F.col("_chance")), part / (1 - part))
    rank = F.when(part > 0, odds / (1 + odds))
    return (
        rows.withColumn("_expected", expected).withColumn("certain", F.floor("_expected").cast("long"))
        .withColumn("rank", rank).withColumn("cell", F.floor(F.col("rank") * CELLS * CELLS).cast("long")).drop("_expected")
    )


def _crossing(sums: DataFrame, by: str) -> DataFrame:
    """Per source the bin in which the running words pass what the source lacks, and the words before it."""
    upto = Window.partitionBy("source").orderBy(by)
    return (
        sums.withColumn("_upto", F.sum("words").over(upto) + F.col("before"))
        .filter((F.col("_upto") > F.col("lacks")) & (F.col("_upto") - F.col("words") <= F.col("lacks")) & (F.col("words") > 0))
        .select("source", "lacks", F.col(by).alias("_at"), (F.col("_upto") - F.col("words")).alias("before"))
    )


def sized(docs: DataFrame, merit: Column | None = None, seed: int = 6, keep: Sequence[str] = ()) -> DataFrame:
    """(doc_id, source, size, merit, _chance) of every row; size is the number of words, 0 for a null text."""
    size = word_count(F.col("text").cast("string"))
    value = F.lit(1.0) if merit is None else F.greatest(F.coalesce(merit.cast("double"), F.lit(0.0)), F.lit(0.0))
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), size.alias("size"), value.alias("merit"), *keep)
    return rows.withColumn("_chance", chance(F.col("doc_id"), F.col("size"), F.lit(seed)))


def plan_mix(rows: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, max_copies: int = 2) -> DataFrame:
    """One row per source: its words, target, and the rank cell and row at which its sample ends."""
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.col("size") * F.col("merit")).alias("merit_size"))
    goals = checkpoint(targets(sizes, weights, share, max_copies))
    ranked = _expected(_attach(rows, goals), max_copies)
    coarse = ranked.groupBy("source", F.floor(F.col("cell") / CELLS).alias("coarse")).agg(
        F.sum(F.when(F.col("cell").isNotNull(), F.col("size")).otherwise(0)).alias("words"),
        F.sum(F.col("certain") * F.col("size")).alias("sure"), F.first("target").alias("target"))
    lacking = coarse.withColumn("lacks", F.col("target") - F.sum("sure").over(Window.partitionBy("source"))).withColumn("before", F.lit(0))
    first = checkpoint(_crossing(lacking, "coarse"))
    inside = _attach(ranked, first.withColumnRenamed("_at", "_coarse")).filter(F.floor(F.col("cell") / CELLS) == F.col("_coarse"))
    fine = inside.groupBy("source", "cell").agg(F.sum("size").alias("words"), F.first("lacks").alias("lacks"), F.first("before").alias("before"))
    second = checkpoint(_crossing(fine, "cell"))
    last = _attach(ranked, second).filter(F.col("cell") == F.col("_at"))
    row = F.struct("rank", F.col("doc_id").alias("id"), "size")
    running = F.sum("size").over(Window.partitionBy("source").orderBy("rank", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1))
    chosen = (
        last.withColumn("_upto", F.coalesce(running, F.lit(0)) + F.col("before"))
        .filter(F.col("_upto") + F.col("size") / 2 <= F.col("lacks"))
        .groupBy("source").agg(F.max(row).alias("last_row"))
    )
    same = second["source"].eqNullSafe(chosen["source"])
    cuts = second.join(chosen, same, "left").select(second["source"].alias("_s"), F.col("_at").alias("last_cell"), "last_row")
    return checkpoint(goals.join(cuts, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s"))


def apply_plan(rows: DataFrame, plan: DataFrame, max_copies: int = 2) -> DataFrame:
    """Add source_size, target and copies to ``sized`` rows; other columns of ``rows`` stay."""
    ranked = _expected(_attach(rows, plan), max_copies)
    row = F.struct("rank", F.col("doc_id").alias("id"), "size")
    taken = F.col("last_cell").isNull() | (F.col("cell") < F.col("last_cell")) | (
        (F.col("cell") == F.col("last_cell")) & F.coalesce(row <= F.col("last_row"), F.lit(False)))
    more = F.when(F.col("cell").isNotNull() & taken, 1).otherwise(0)
    return ranked.withColumn("copies", F.col("certain") + more)


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, max_copies: int = 2, merit: Column | None = None, seed: int = 6) -> DataFrame:
    """Copies and words taken of every row of ``docs`` (doc_id, text, source; other columns only for ``merit``).

    Returns doc_id, source, size, source_size, target, copies, taken (copies times size).
    A null or blank text has size 0 and takes no words. A null source is a source, the
    last. A single document larger than twice what its source lacks is left out. Rows
    are decided one by one; rows equal in doc_id, source and size share their chance and
    are taken alike. An empty table gives no rows. The same rows give the same mix.
    """
    rows = checkpoint(sized(docs, merit, seed))
    done = apply_plan(rows, plan_mix(rows, weights, share, max_copies), max_copies)
    return done.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, max_copies: int = 2, seed: int = 6) -> DataFrame:
    """``docs`` itself with every row repeated as often as the mix takes it; all columns stay as they are."""
    plan = plan_mix(checkpoint(sized(docs, None, seed)), weights, share, max_copies)
    whole = F.struct(*docs.columns)
    rows = sized(docs.withColumn("_whole", whole), None, seed, keep=["_whole"])
    return apply_plan(rows, plan, max_copies).select("_whole", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select("_whole.*")


#: The same mix over the table ``documents``, with the sources' level found from sorted caps.
SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
sources AS (SELECT source, sum(size)::DOUBLE AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT *, 2.0 * source_size AS cap,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight
  FROM sources),
filled AS (
  SELECT *, (1.5 * sum(source_size) OVER () - coalesce(sum(cap) OVER earlier, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER earlier, 0)) AS level
  FROM ranked WINDOW earlier AS (ORDER BY cap / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
goals AS (
  SELECT source, source_size, least(weight * (SELECT max(level) FROM filled WHERE weight * level <= cap), cap) AS target FROM filled),
expected AS (
  SELECT s.*, g.source_size, g.target, CASE WHEN g.source_size > 0 THEN least(2.0, g.target / g.source_size) ELSE 0.0 END AS e,
    (('0x' || substr(md5(concat_ws('|', doc_id, size, 6)), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0::DOUBLE AS u
  FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source),
odds AS (SELECT *, floor(e) AS sure, CASE WHEN e > floor(e) THEN (u / (1 - u)) / ((e - floor(e)) / (1 - (e - floor(e)))) END AS q FROM expected),
running AS (
  SELECT *, target - sum(sure * size) OVER (PARTITION BY source) AS lacks,
    coalesce(sum(size) OVER (PARTITION BY source, q IS NULL ORDER BY q / (1 + q), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS upto
  FROM odds)
SELECT doc_id, size, source_size::BIGINT AS source_size, target,
  (size * (sure + CASE WHEN q IS NOT NULL AND upto + size / 2 <= lacks THEN 1 ELSE 0 END))::BIGINT AS taken
FROM running"""
