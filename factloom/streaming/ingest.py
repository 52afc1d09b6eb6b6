"""Incremental ingest of model answers with Structured Streaming.

Each micro-batch is one chain: the articles of its answers are cleaned and gated, the answers parsed, validated and normalised. All of
it is written under the batch id and published by one marker; a replayed batch overwrites its own folders, so every answer counts once.

A fact is written once, with digests of its keys, and never again: which facts repeat others is decided where they are read, from one
narrow row per key. These rows are compacted now and then, and a read adds the batches since. So neither a batch nor a read sends whole facts
across the network or writes them anew. After a run, ``link_stream`` discovers and links the distinct names of all published facts. Names,
links and duplicates depend on the set of facts alone, so how answers were cut into batches does not show.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from factloom import config as C
from factloom.functions import keys as K
from factloom.functions import text as T
from factloom.functions.predicates import normalize_predicates
from factloom.operators import dedup, extraction, linking
from factloom.operators.common import scattered
from factloom.session import checkpoint, reread

#: ``article`` is the document's text; where it is given, its answers count only if the cleaned text passes the gate.
ANSWERS = "request_id string, document_id bigint, content string, article string"
#: The fact to keep of a key; ``fact_id`` as bytes, which sort as its digits do.
BEST = "k_all binary, best struct<s: double, fact_id: binary, batch_id: bigint, row: bigint>"
LINKS, ENTITIES, ALIASES = "kind string, text string, entity_id string", "entity_id string, canonical_name string, normalized_name string, entity_type string", "alias_id string, entity_id string, alias_name string"
FACT_COLUMNS = (
    "fact_id", "request_id", "document_id", "evidence_text", "fact_type", "subject_text", "predicate", "object_text",
    "value_num", "value_text", "unit", "currency", "time_expr", "location_text", "qualifier_json", "confidence_score",
    "review_status", "review_note")
#: What is stored beside a fact: its place in its batch and in its answer, and digests of its keys.
STORED = (*FACT_COLUMNS, "row", "ord", "k_record", "k_all")


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def _published(spark: SparkSession, path: str) -> DataFrame:
    """Ids of the batches whose last write is done: (batch_id)."""
    if not _exists(spark, f"{path}/published"):
        return spark.createDataFrame([], "batch_id bigint")
    return spark.read.schema("n bigint, batch_id bigint").parquet(f"{path}/published").select("batch_id")


def _stored(spark: SparkSession, path: str, name: str, schema: str, done: DataFrame) -> DataFrame:
    """Rows of the batches in ``done``; empty before the first.

    Only a missing folder counts as empty; a table that can't be read is an error.
    """
    if not _exists(spark, f"{path}/{name}"):
        return spark.createDataFrame([], schema)
    table = spark.read.option("basePath", f"{path}/{name}").schema(schema).parquet(f"{path}/{name}")
    return table.join(done, "batch_id", "left_semi")


def _write(df: DataFrame, path: str, name: str, batch_id: int) -> None:
    df.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/{name}/batch_id={batch_id}")


def _latest(spark: SparkSession, path: str, name: str) -> int | None:
    """The last batch that a finished job over all batches so far took in."""
    if not _exists(spark, f"{path}/{name}_done"):
        return None
    return spark.read.schema("n bigint, batch_id bigint").parquet(f"{path}/{name}_done").agg(F.max("batch_id")).first()[0]


def _mark(spark: SparkSession, path: str, name: str, batch_id: int) -> None:
    _write(spark.range(1).select(F.col("id").alias("n")), path, name, batch_id)


def settle_answers(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, answers set aside) of one batch of parsed answers. Records without evidence are among them, as they may repeat others."""
    valid, _ = extraction.validate_records(extraction.shape_records(parsed))
    records = normalize_predicates(valid).withColumns({
        "fact_id": F.sha2(F.concat_ws("|", "request_id", F.col("ord").cast("string")), 256),
        "review_status": F.lit(C.PENDING), "review_note": F.lit(None).cast("string"), "row": F.monotonically_increasing_id(),
        "k_record": F.xxhash64(*extraction.record_key().values()), "k_all": K.fact_fingerprint()})
    return records.select(*STORED), extraction.unparsed(parsed)


def repeated_records(records: DataFrame) -> DataFrame:
    """Rows (row) that repeat a record of the same document's answers. Only records whose key's hash occurs again are compared."""
    again = reread(records.groupBy("k_record").agg(F.count("*").alias("n")).filter("n > 1").select("k_record"), "again")
    suspects = records.join(again, "k_record", "left_semi")
    return suspects.select("row").join(extraction.dedup_records(suspects, F.col("fact_id")).select("row"), "row", "left_anti")


def gate_articles(answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(answers whose article passes or isn't given, answers set aside with the gate's status as reason).

    Many answers share an article: each text is cleaned once, and answers meet the verdict by its digest.
    """
    texts = answers.select("article").filter(F.col("article").isNotNull()).distinct().withColumn("clean", T.once(T.clean(F.col("article"))))
    judged = texts.select(F.sha2("article", 256).alias("_article"), T.gate(F.col("article"), F.col("clean"), C.MIN_CLEAN_CHARS).alias("reason"))
    # written: known to be small, it is sent to the answers and they stay where they are
    stops = reread(judged.filter(F.col("reason").isNotNull()), "stops")
    marked = answers.withColumn("_article", scattered(F.sha2("article", 256), F.col("request_id"))).drop("article")
    return marked.join(stops, "_article", "left_anti").drop("_article"), marked.join(stops, "_article").drop("_article")


def process_batch(answers: DataFrame, batch_id: int, path: str) -> None:
    spark, gone = answers.sparkSession, ["request_id", "document_id", "reason"]
    passed, stopped = gate_articles(answers)
    cores = spark.sparkContext.defaultParallelism
    if answers.rdd.getNumPartitions() * 2 < cores:  # a few files hold all answers: deal them over the tasks before any is parsed
        passed = passed.repartition(cores, "request_id")
    _write(extraction.parse_answers(passed), path, "parsed", batch_id)  # parsed once, read twice
    records, rejected = settle_answers(spark.read.parquet(f"{path}/parsed/batch_id={batch_id}"))
    _write(records, path, "facts", batch_id)
    _write(rejected.select(*gone).unionByName(stopped.select(*gone)), path, "rejected", batch_id)
    _write(repeated_records(spark.read.parquet(f"{path}/facts/batch_id={batch_id}")), path, "repeated", batch_id)
    # the marker comes last: readers see all of a batch or nothing of it
    _mark(spark, path, "published", batch_id)
    _forget_parsed(spark, path, batch_id)


def _forget_parsed(spark: SparkSession, path: str, before: int) -> None:
    """Delete the parsed answers of earlier batches: their facts are published, and only the last batch may come again."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/parsed")
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for found in files.listStatus(folder):
        if int(found.getPath().getName().split("=")[1]) < before:
            files.delete(found.getPath(), True)


def start_ingest(spark: SparkSession, source: str, path: str, files_per_batch: int = 1000, checkpoint: str | None = None) -> StreamingQuery:
    """Ingest all answers waiting under ``source`` and stop; call again for later arrivals, and ``link_stream`` after each run."""
    stream = spark.readStream.schema(ANSWERS).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    return (
        stream.writeStream.option("checkpointLocation", checkpoint or f"{path}/_checkpoint").trigger(availableNow=True)
        .foreachBatch(lambda df, batch_id: process_batch(df, batch_id, path)).start()
    )


def _settled(spark: SparkSession, path: str) -> DataFrame:
    """Facts of all published batches with the batch's id, without records that repeat one of their own answers."""
    done = _published(spark, path)
    facts = spark.read.parquet(f"{path}/facts").join(done, "batch_id", "left_semi").filter(F.col("evidence_text") != "")
    return facts.join(_stored(spark, path, "repeated", "row bigint, batch_id bigint", done), ["batch_id", "row"], "left_anti")


def best_facts(spark: SparkSession, path: str) -> DataFrame:
    """(k_all, best): the fact to keep of each key, of the last compaction and the batches after it.

    Of equally confident facts the one with the smaller id stays, whichever came first.
    """
    rank = F.struct((-F.coalesce("confidence_score", F.lit(0.0))).alias("s"), F.unhex("fact_id").alias("fact_id"), F.col("batch_id").cast("bigint").alias("batch_id"), "row")
    upto, facts = _latest(spark, path, "compacted"), _settled(spark, path)
    rows = (facts if upto is None else facts.filter(F.col("batch_id") > upto)).select("k_all", rank.alias("best"))
    if upto is not None:
        rows = spark.read.schema(BEST).parquet(f"{path}/compacted/batch_id={upto}").unionByName(rows)
    return rows.groupBy("k_all").agg(F.min("best").alias("best"))


def link_stream(spark: SparkSession, path: str, entities: DataFrame, aliases: DataFrame) -> None:
    """Discover and link the names and places of all published facts: one row per distinct text, published by a marker.

    Duplicates take part, as which of several equally good facts is kept depends on their arrival. Running it again replaces nothing but the same result.
    """
    upto = _published(spark, path).agg(F.max("batch_id")).first()[0]
    if upto is None or _latest(spark, path, "links") == upto:
        return
    facts, columns = _settled(spark, path), [c.split()[0] for c in ENTITIES.split(", ")]
    known = entities.select(*columns).unionByName(linking.missing_places(entities).select(*columns))
    created, added = (checkpoint(df) for df in linking.discover(facts, known, aliases))
    everything = known.unionByName(created)
    names = linking.link_names(linking.distinct_texts(facts, "subject_text", "object_text"), everything, aliases.select("alias_id", "entity_id", "alias_name").unionByName(added)).filter("matched")
    places = linking.link_places(linking.distinct_texts(facts, "location_text"), everything)
    rows = lambda kind, df: df.select(F.lit(kind).alias("kind"), "text", "entity_id")
    _write(rows("name", names).unionByName(rows("place", places)), path, "links", upto)
    _write(created, path, "entities", upto)
    _write(added, path, "aliases", upto)
    _mark(spark, path, "links_done", upto)


def stream_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """``links``, ``entities`` or ``aliases`` as the last finished ``link_stream`` left them; empty before the first."""
    schema, upto = {"links": LINKS, "entities": ENTITIES, "aliases": ALIASES}[name], _latest(spark, path, "links")
    return spark.createDataFrame([], schema) if upto is None else spark.read.schema(schema).parquet(f"{path}/{name}/batch_id={upto}")


def current_facts(spark: SparkSession, path: str) -> DataFrame:
    """Facts as of now with the entities their texts link to: those that repeat a better one, and restated investments, are duplicates."""
    best = best_facts(spark, path).select("k_all", F.col("best.batch_id").alias("_batch"), F.col("best.row").alias("_row"), F.lower(F.hex("best.fact_id")).alias("_best"))
    met, own = _settled(spark, path).join(best, "k_all"), (F.col("_batch") == F.col("batch_id")) & (F.col("_row") == F.col("row"))
    note = F.concat(F.lit("重复: 与 "), "_best", F.when(F.col("_batch") > F.col("batch_id"), " 重复（跨文档，分数更低）").otherwise(" 重复"))
    facts = met.withColumns({
        "review_status": F.when(own, F.col("review_status")).otherwise(C.DUPLICATE),
        "review_note": F.when(own, F.col("review_note")).otherwise(note)}).select(*FACT_COLUMNS, "batch_id")
    # written, as few facts are marked
    facts = dedup.apply_marks(facts, reread(dedup.cross_type(facts.withColumn("created_at", F.lit(0))), "restated"))
    links = stream_table(spark, path, "links")
    for role, kind in (("subject", "name"), ("object", "name"), ("location", "place")):
        side = links.filter(F.col("kind") == kind).select(F.col("text").alias("_t"), F.col("entity_id").alias(f"{role}_entity_id"))
        facts = facts.join(side, scattered(K.strip(F.col(f"{role}_text")), F.col("fact_id")) == F.col("_t"), "left").drop("_t")
    return facts


def compact_index(spark: SparkSession, path: str) -> None:
    """Write the best fact per key of all published batches, for occasional maintenance; later reads start from it."""
    upto = _published(spark, path).agg(F.max("batch_id")).first()[0]
    if upto is None or _latest(spark, path, "compacted") == upto:
        return
    _write(best_facts(spark, path), path, "compacted", upto)
    _mark(spark, path, "compacted_done", upto)
