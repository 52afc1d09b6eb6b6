"""URL lists with a history, joined to captures as of their fetch date.

A list is a log of dated entries: a pattern is added with a verdict, changed, or dropped.
Each entry holds from its date until the pattern's next entry, so the log becomes
validity intervals. A capture has a key for every pattern that could match it: its host,
each parent domain, each path prefix. Keys meet intervals by equality, and of
the intervals only the one that holds at the fetch date remains; this is the as-of join. The most specific active entry
decides.

Everything is column expressions and one equi-join. A hot host is split by Spark's skew join; each capture is
folded map-side before the one other shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FOREVER = "9999-12-31"


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and final dot; empty if there is none."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*+:)?//(?:[^/?#@]*+@)?([^/?#:]*+)", 1)), r"\.$", "")


def path_of(url: Column) -> Column:
    """Path without query, fragment and final slash; empty for the root."""
    path = F.regexp_extract(url, r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*+:)?//[^/?#]*+([^?#]*+)", 1)
    return F.regexp_replace(path, "/+$", "")


def keys_of(host: Column, path: Column) -> Column:
    """Pattern keys of a capture: ``host:``, ``domain:`` for the host and its parents, ``prefix:`` for path prefixes."""
    labels, parts = F.split(host, r"\."), F.split(path, "/")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.lit("domain:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    prefixes = F.when(F.size(parts) > 1, F.transform(
        F.sequence(F.lit(2), F.size(parts)), lambda i: F.concat(F.lit("prefix:"), host, F.array_join(F.slice(parts, 1, i), "/"))))
    return F.when(host != "", F.concat(F.array(F.concat(F.lit("host:"), host)), domains, F.coalesce(prefixes, F.array().cast("array<string>"))))


def intervals(entries: DataFrame) -> DataFrame:
    """(key, verdict, valid_from, valid_to) from dated entries (kind, pattern, verdict, on_date).

    ``kind`` is host, domain or prefix; a null verdict drops the pattern. Of several entries for one
    pattern and date ``block`` wins over ``allow`` over a drop. Entries without kind, pattern or date are ignored. ``valid_to`` is exclusive.
    Case counts in a pattern's path, as it does in a capture's, and not in its host.
    """
    host = F.substring_index("pattern", "/", 1)
    key = F.concat(F.col("kind"), F.lit(":"), F.lower(host), F.substr("pattern", F.length(host) + 1))
    rank = F.when(F.col("verdict") == "block", 2).when(F.col("verdict") == "allow", 1).otherwise(0)
    daily = (
        entries.select(key.alias("key"), F.col("on_date").cast("date").alias("valid_from"), rank.alias("rank"))
        .filter("key is not null and valid_from is not null").groupBy("key", "valid_from").agg(F.max("rank").alias("rank"))
    )
    until = F.lead("valid_from", 1).over(Window.partitionBy("key").orderBy("valid_from"))
    return (
        daily.withColumn("valid_to", F.coalesce(until, F.lit(FOREVER).cast("date"))).filter("rank > 0")
        .select("key", F.when(F.col("rank") == 2, "block").otherwise("allow").alias("verdict"), "valid_from", "valid_to")
    )


def judge(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """Verdict on every capture (page_id, url, fetched_on) by the entries active on its fetch date.

    Returns page_id, fetched_on, host, n_active, decided_by (key of the deciding entry) and verdict: ``block``, ``allow``,
    or ``none`` if nothing matches. A path prefix decides before a host, a host before a domain, the longer before the
    shorter, ``block`` before ``allow``. Captures whose url is null or has no host, or whose date is null, get ``none``. Rows equal in
    page_id, url and date are reported once; no captures, no rows. Other columns are ignored.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    seen = captures.select("page_id", F.xxhash64("url").alias("_url"), F.col("fetched_on").cast("date").alias("fetched_on"), F.coalesce(host, F.lit("")).alias("host"), path.alias("_path"))
    keyed = seen.select("page_id", "_url", "fetched_on", "host", F.explode_outer(keys_of(F.col("host"), F.col("_path"))).alias("key"))
    active = intervals(entries)
    holds = (keyed["key"] == active["key"]) & (keyed["fetched_on"] >= active["valid_from"]) & (keyed["fetched_on"] < active["valid_to"])
    kind = F.substring_index(active["key"], ":", 1)
    order = F.when(kind == "prefix", 3).when(kind == "host", 2).otherwise(1)
    entry = F.when(active["key"].isNotNull(), F.struct(order.alias("o"), F.length(active["key"]).alias("n"), (active["verdict"] == "block").alias("b"), active["key"].alias("k")))
    return (
        keyed.join(active, holds, "left").select("page_id", "_url", "fetched_on", "host", entry.alias("entry"))
        .groupBy("page_id", "_url", "fetched_on", "host").agg(F.count("entry").alias("n_active"), F.max("entry").alias("entry"))
        .select("page_id", "fetched_on", "host", "n_active", F.col("entry.k").alias("decided_by"),
                F.when(F.col("entry").isNull(), "none").when(F.col("entry.b"), "block").otherwise("allow").alias("verdict"))
    )


def sample_captures(pages: DataFrame) -> DataFrame:
    """Pages with a fetch date derived from their id, for a table that records none."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("page_id"), F.lit(365)).cast("int"))
    return pages.select("page_id", "url", day.alias("fetched_on"))


def sample_entries(pages: DataFrame) -> DataFrame:
    """A dated list derived from the hosts of the pages: each host's digest picks its history."""
    pick = F.conv(F.substring(F.md5("host"), 1, 4), 16, 10).cast("int")
    hosts = pages.select(host_of(F.col("url")).alias("host")).filter("host <> ''").distinct().withColumn("p", pick)
    entry = lambda when, kind, pattern, verdict, day: F.when(when, F.struct(
        F.lit(kind).alias("kind"), pattern.alias("pattern"), F.lit(verdict).cast("string").alias("verdict"), F.date_add(F.lit("2024-01-01").cast("date"), F.lit(day)).alias("on_date")))
    host, english = F.col("host"), F.concat(F.col("host"), F.lit("/en"))
    parent = F.substring_index("host", ".", -3)
    listed = F.array_compact(F.array(
        entry(F.col("p") % 3 == 0, "host", host, "block", 40), entry(F.col("p") % 3 == 0, "host", host, None, 160),
        entry(F.col("p") % 6 == 0, "host", host, "block", 280), entry(F.col("p") % 4 == 1, "domain", parent, "block", 90),
        entry(F.col("p") % 8 == 1, "domain", parent, "allow", 200), entry(F.col("p") % 5 == 2, "prefix", english, "allow", 20),
        entry(F.col("p") % 5 == 2, "prefix", english, "block", 250)))
    return hosts.select(F.inline(listed))


#: The same captures, list and verdicts over the table ``pages``.
SQL = r"""
WITH seen AS (
  SELECT page_id, DATE '2024-01-01' + (page_id % 365)::INTEGER AS fetched_on,
    regexp_replace(lower(regexp_extract(url, '^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)', 1)), '\.$', '') AS host,
    regexp_replace(regexp_extract(url, '^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*([^?#]*)', 1), '/+$', '') AS path
  FROM pages),
hosts AS (SELECT host, ('0x' || substr(md5(host), 1, 4))::INTEGER AS p, list_aggregate(list_slice(string_split(host, '.'), -3, -1), 'string_agg', '.') AS parent
  FROM (SELECT DISTINCT host FROM seen WHERE host <> '')),
log AS (
  SELECT 'host:' || host AS key, 2 AS r, 40 AS d FROM hosts WHERE p % 3 = 0 UNION ALL SELECT 'host:' || host, 0, 160 FROM hosts WHERE p % 3 = 0
  UNION ALL SELECT 'host:' || host, 2, 280 FROM hosts WHERE p % 6 = 0 UNION ALL SELECT 'domain:' || parent, 2, 90 FROM hosts WHERE p % 4 = 1
  UNION ALL SELECT 'domain:' || parent, 1, 200 FROM hosts WHERE p % 8 = 1 UNION ALL SELECT 'prefix:' || host || '/en', 1, 20 FROM hosts WHERE p % 5 = 2
  UNION ALL SELECT 'prefix:' || host || '/en', 2, 250 FROM hosts WHERE p % 5 = 2),
daily AS (SELECT key, DATE '2024-01-01' + d AS valid_from, max(r) AS r FROM log GROUP BY 1, 2),
spans AS (SELECT key, r, valid_from, coalesce(lead(valid_from) OVER (PARTITION BY key ORDER BY valid_from), DATE '9999-12-31') AS valid_to FROM daily),
hits AS (
  SELECT s.page_id, i.key, i.r, CASE split_part(i.key, ':', 1) WHEN 'prefix' THEN 3 WHEN 'host' THEN 2 ELSE 1 END AS o
  FROM seen s JOIN spans i ON i.r > 0 AND s.fetched_on >= i.valid_from AND s.fetched_on < i.valid_to AND (
    i.key = 'host:' || s.host OR (i.key LIKE 'domain:%' AND ('.' || s.host) LIKE '%.' || substr(i.key, 8))
    OR (i.key LIKE 'prefix:%' AND (s.host || s.path || '/') LIKE substr(i.key, 8) || '/%'))),
best AS (
  SELECT page_id, count(*) AS n_active, arg_max(key, (o, length(key), r, key)) AS decided_by, arg_max(r, (o, length(key), r, key)) AS r FROM hits GROUP BY page_id)
SELECT s.page_id, s.fetched_on, s.host, coalesce(b.n_active, 0) AS n_active, b.decided_by, CASE b.r WHEN 2 THEN 'block' WHEN 1 THEN 'allow' ELSE 'none' END AS verdict
FROM seen s LEFT JOIN best b USING (page_id)"""
