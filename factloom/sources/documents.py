"""Document sources and the document snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom import config as C
from factloom.functions.keys import strip
from factloom.operators.common import top_per_key
from factloom.sources.html import extract_pages, with_title

EXTENSIONS = ("txt", "md")
DOCUMENT_COLUMNS = ("source_type", "source_name", "title", "author", "url", "publish_time", "raw_text")


def _file_name() -> Column:
    return F.element_at(F.split(F.url_decode(F.regexp_replace("_metadata.file_path", r"\+", "%2B")), "/"), -1)


def _supported() -> Column:
    return F.lower(F.col("source_name")).rlike(r"\.(?:" + "|".join(EXTENSIONS) + r")\z")


def _stem(col: str) -> Column:
    return F.regexp_replace(col, r"(?s)(.)\.[^.]*\z", "$1")


def _submission(df: DataFrame, kind: str) -> DataFrame:
    out = df.withColumn("source_type", F.lit(kind))
    for name in DOCUMENT_COLUMNS:
        if name not in out.columns:
            out = out.withColumn(name, F.lit(None).cast("string"))
    return out.select(*DOCUMENT_COLUMNS, F.sha2("raw_text", 256).alias("content_hash"))


def text_files(spark: SparkSession, path: str, title: str | None = None, author: str | None = None) -> DataFrame:
    """Text files as documents: one per file, titled by its stem."""
    files = (
        spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
        .select(F.col("value").alias("raw_text"), _file_name().alias("source_name"))
        .filter(_supported())
        .withColumn("title", F.lit(title) if title else _stem("source_name"))
        .withColumn("author", F.lit(author).cast("string"))
    )
    return _submission(files, "文件")


def folder(spark: SparkSession, path: str, pattern: str = "*.txt", author: str | None = None) -> tuple[DataFrame, DataFrame]:
    """A folder of files, strictly decoded: (documents, files set aside with a reason).

    One bad file never stops the batch.
    """
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
        .select("content", "_metadata.file_path", _file_name().alias("source_name"))
        .filter(_supported())
        .withColumn("raw_text", F.try_validate_utf8(F.col("content").cast("string")))
    )
    good = files.filter(F.col("raw_text").isNotNull()).withColumns({
        "title": _stem("source_name"), "author": F.lit(author).cast("string")})
    bad = files.filter(F.col("raw_text").isNull()).select("source_name", F.lit("not valid UTF-8").alias("reason"))
    return _submission(good, "文件"), bad


def pasted(submissions: DataFrame) -> DataFrame:
    """Pasted or uploaded texts; uploads are typed as paste as well."""
    return _submission(submissions.drop("source_name"), "粘贴")


def web_pages(pages: DataFrame) -> DataFrame:
    """Fetched pages (page_id, url, html) as documents."""
    titled = with_title(extract_pages(pages))
    return _submission(titled.withColumn("source_name", F.col("url")), "网址")


def url_list(spark: SparkSession, path: str) -> DataFrame:
    """URLs of a list file; blank lines and lines starting with # are skipped."""
    return (
        spark.read.text(path).select(strip(F.col("value")).alias("url"))
        .filter((F.col("url") != "") & ~F.col("url").startswith("#"))
    )


def upsert(existing: DataFrame, incoming: DataFrame, order: str) -> tuple[DataFrame, DataFrame]:
    """Merge submissions into the document snapshot.

    Known content matches first, so that a content hash stays unique; otherwise web documents
    match by URL. A match keeps its id, takes the new content and hash and is pending again. URLs
    that carry one content share a document, which keeps the URL it has. ``order`` ranks submissions, the latest wins.
    Returns (snapshot, document_id/url pairs of the submissions and of the documents they reach; ``asked`` tells those
    that a submission named).
    """
    keyed = incoming.withColumn("_key", F.coalesce("url", "content_hash"))
    latest = top_per_key(keyed, ["_key"], [F.desc(order), "content_hash"])
    by_url = existing.filter(F.col("url").isNotNull()).groupBy(F.col("url").alias("_u")).agg(F.min("document_id").alias("_url_id"))
    by_hash = existing.groupBy(F.col("content_hash").alias("_h")).agg(
        F.min_by(F.struct("document_id", "url"), "document_id").alias("_same"))
    new_id = F.sha2(F.concat_ws("|", F.lit("document"), "content_hash"), 256)
    routed = (
        latest.join(by_url, F.col("url") == F.col("_u"), "left")
        .join(by_hash, F.col("content_hash") == F.col("_h"), "left")
        .withColumn("document_id", F.coalesce("_same.document_id", "_url_id", new_id))
        .withColumn("_asked", F.col("url"))
        # a URL stored with other content stays where it is; the pair below records it
        .withColumn("url", F.when(F.col("_same").isNull(), F.col("url")).otherwise(
            F.coalesce("_same.url", F.when(F.col("_url_id").isNull(), F.col("url")))))
        .drop("_u", "_h", "_url_id", "_same", "_key")
    )
    chosen = top_per_key(routed, ["document_id"], [F.desc(order), "content_hash", "url"])
    kept = existing.join(chosen.select("document_id"), "document_id", "left_anti").withColumn("change", F.lit("kept"))
    known = existing.select("document_id", F.lit(True).alias("_known"))
    fresh = chosen.join(known, "document_id", "left").select(
        "document_id", *DOCUMENT_COLUMNS, "content_hash", F.lit(C.PENDING).alias("status"),
        F.when(F.col("_known"), "updated").otherwise("inserted").alias("change"))
    named = F.transform(F.array_distinct(F.array_compact(F.array("_asked", "url"))), lambda u: F.struct(u.alias("url"), u.eqNullSafe(F.col("_asked")).alias("asked")))
    urls = routed.select("document_id", F.inline(named)).groupBy("document_id", "url").agg(F.max("asked").alias("asked"))
    return kept.select(*fresh.columns).unionByName(fresh), urls


def apply_edits(docs: DataFrame, edits: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Overwrite metadata of edited documents; a NULL in an edit row clears the field."""
    e = edits.select(F.col("document_id").alias("_id"), *[F.col(f).alias(f"_{f}") for f in fields])
    joined = docs.join(e, docs["document_id"] == e["_id"], "left")
    return joined.select(*[
        F.when(F.col("_id").isNotNull(), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in fields else docs[c]
        for c in docs.columns])
