"""Building blocks shared by the jobs: null-safe joins, best-row selection,
split numbering, containment joins, snapshot upserts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom import config as C
from factloom.session import checkpoint


def approved(facts: DataFrame) -> DataFrame:
    return facts.filter(F.col("review_status").isin(*C.APPROVED))


def is_active(status: str = "review_status") -> Column:
    return ~F.col(status).isin(*C.INACTIVE)


def null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    """Equi-join condition that treats NULL keys as equal (still a hash/sort join)."""
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def scattered(key: Column, by: Column) -> Column:
    """A left join's key in which NULLs, which match nothing, are dealt over all partitions by a hash of ``by``."""
    return F.coalesce(key, F.concat(F.lit("\u0000"), F.xxhash64(by).cast("string")))


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1,
                rank: str | None = None) -> DataFrame:
    """First ``n`` rows per key. Spark prunes each map task to ``n`` rows per key
    before the shuffle, so a hot key ships only ``n`` rows per task."""
    name = rank or "_rank"
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    kept = ranked.filter(F.col(name) <= n)
    return kept if rank else kept.drop(name)


#: A group of more rows is numbered in slices.
LARGE = 100_000


def number_in_group(df: DataFrame, group: Sequence[str], id_col: str, name: str = "rn",
                    spread: int = 3) -> DataFrame:
    """Number rows 1..n within a group without ever sorting a whole group of over ``LARGE`` rows in one task.

    Rows are ordered by (first ``spread`` hex digits of md5(id), id). In a large group the digits cut
    slices that are numbered apart; slice offsets come from a running sum over at most 16**spread
    counts per group. All other rows cross the network once, and stay together by group.
    """
    sliced = df.withColumn("_slice", F.substring(F.md5(F.col(id_col).cast("string")), 1, spread))
    whole = lambda rows: rows.withColumn(
        name, F.row_number().over(Window.partitionBy(*group).orderBy("_slice", id_col)).cast("bigint")).drop("_slice")
    large = checkpoint(df.groupBy(*group).agg(F.count("*").alias("_n")).filter(F.col("_n") > LARGE).drop("_n"))
    if large.isEmpty():
        return whole(sliced)
    large = F.broadcast(large)  # one row per LARGE rows at most
    same = null_safe(sliced, large, group)
    return whole(sliced.join(large, same, "left_anti")).unionByName(_number_slices(sliced.join(large, same, "left_semi"), group, id_col, name))


def _number_slices(sliced: DataFrame, group: Sequence[str], id_col: str, name: str) -> DataFrame:
    counts = sliced.groupBy(*group, "_slice").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *group, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    within = Window.partitionBy(*group, "_slice").orderBy(id_col)
    numbered = sliced.withColumn("_k", F.row_number().over(within))
    cond = null_safe(numbered, offsets, [*group, "_slice"])
    return (
        numbered.join(offsets, cond)
        .select(*[numbered[c] for c in sliced.columns if c != "_slice"],
                (F.col("_offset") + F.col("_k")).cast("bigint").alias(name))
    )


def role_union(facts: DataFrame, *columns: str) -> DataFrame:
    """One row per distinct (entity, fact) over subject and object links.

    Replaces an OR-join. A fact links the same entity in both roles at most once,
    so duplicates are removed inside the row and no shuffle is needed.
    """
    ids = F.array_distinct(F.array_compact(F.array("subject_entity_id", "object_entity_id")))
    return facts.select(F.explode(ids).alias("entity_id"), "fact_id", *columns)


_GRAM_WIDTHS = (1, 2, 4, 8, 16, 32)


def contained_in(short: DataFrame, long: DataFrame, short_col: str, long_col: str, min_len: int = 2, hot: int = 50_000) -> DataFrame:
    """Join names to the texts that contain them (equality included).

    A text that contains a name holds all its grams, so each name is looked up by the one that fewest texts hold; what
    meets is then compared itself. The grams of a name have the greatest width not above its length, more than
    half of it but for very long names, and a text lists only the widths in use: at most six keys a character, whatever lengths occur.
    A gram of more than ``hot`` texts is dealt over as many parts. NULLs and names under ``min_len`` meet nothing; a repeated
    row meets as often as it occurs. Rows of ``long`` multiply by their grams: pass distinct names with few other columns.
    """
    size = lambda c: F.length(c)
    width = lambda c: F.element_at(F.filter(F.array(*map(F.lit, _GRAM_WIDTHS)), lambda w: w <= size(c)), -1)
    grams = lambda c, w: F.transform(F.sequence(F.lit(1), size(c) - w + 1), lambda p: F.xxhash64(F.substring(c, p, w)))
    names = short.filter(size(short_col) >= max(min_len, 1))
    wanted = names.select(F.col(short_col).alias("_name")).distinct()
    widths = wanted.agg(F.collect_set(width("_name"))).scalar()
    # outer: a plain explode would add a filter that lists the grams a second time
    held = long.filter(size(long_col) >= max(min_len, 1)).withColumn("_widths", widths).withColumn("_gram", F.explode_outer(F.array_distinct(
        F.flatten(F.transform(F.filter("_widths", lambda w: w <= size(long_col)), lambda w: grams(long_col, w)))))).drop("_widths")
    own = wanted.select("_name", F.explode_outer(F.array_distinct(grams("_name", width("_name")))).alias("_gram"))
    counts = held.select("_gram").join(own.select("_gram").distinct(), "_gram", "left_semi").groupBy("_gram").agg(F.count("*").alias("_texts"))
    rarest = own.join(counts, "_gram", "left").groupBy("_name").agg(
        F.min(F.struct(F.coalesce("_texts", F.lit(0)).alias("n"), F.col("_gram").alias("gram"))).alias("_r")).filter("_r.n > 0")
    # written, as it is read twice and the grams are listed for the counts
    rarest = checkpoint(rarest.select("_name", F.col("_r.gram").alias("_gram"), F.ceil(F.col("_r.n") / hot).cast("int").alias("_parts")))
    dealt = held.join(rarest.select("_gram", "_parts").distinct(), "_gram").withColumn(
        "_part", F.pmod(F.xxhash64(long_col), "_parts").cast("int")).drop("_parts")
    asked = rarest.withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    asking = names.join(asked, F.col(short_col) == F.col("_name")).drop("_name")
    return dealt.join(asking, ["_gram", "_part"]).filter(F.contains(long_col, short_col)).drop("_gram", "_part")


def fold_ascii(col: Column) -> Column:
    """Lower-case A-Z only: LIKE ignores ASCII case and nothing else."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def keep_first(new: DataFrame, existing: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Insert-or-ignore: rows of ``new`` whose unique key is free, first one per key."""
    taken = existing.select(*key).distinct()
    fresh = new.join(taken, null_safe(new, taken, key), "left_anti")
    return top_per_key(fresh, key, order)


def label(col: Column, mapping: dict, default: Column | None = None) -> Column:
    """Map a code through a small fixed dictionary inside the expression."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[col], default if default is not None else col)
