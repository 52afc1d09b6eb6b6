"""Registered queries of the corpus operators and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import langid, licenses, mixing, pieces, pii, quality_model, simhash, token_alignment, topk, url_filters, vector_dedup, warc, whitening
from factloom.llm.tables import table

#: The tokenizers that the queries use; operators take their paths as parameters.
PIECES, BYTES = "/opt/tokenizers/piece_bpe_32k.model", "/opt/tokenizers/byte_bpe_50k.json"


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filters.judge(url_filters.sample_captures(pages), url_filters.sample_entries(pages))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.classify(table(spark, sf_dir, "documents"))


def op4_pieces(spark: SparkSession, sf_dir: str, model: str = PIECES) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"), model)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, radius=2)
    return found.select("doc_id", "fingerprint", "component_id")


def op6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, max_copies=2)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op7_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_duplicate_vectors(table(spark, sf_dir, "embeddings"), threshold=0.98)


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.filter("vec_id % 20 = 0"), k=20)


def op11_alignment(spark: SparkSession, sf_dir: str, a: str = BYTES, b: str = PIECES) -> DataFrame:
    return token_alignment.align(table(spark, sf_dir, "documents"), a, b, groups=False)


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    white = whitening.whiten(table(spark, sf_dir, "embeddings"))
    return white.withColumn("deviation", F.col("deviation").cast("long"))


QUERIES = (op1_pii, op2_url_filters, op3_quality, op4_pieces, op5_simhash, op6_mix, op7_vectors, op8_langid, op9_licenses, op10_topk, op11_alignment, op12_warc, op13_whitening)


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {query.__name__: query for query in QUERIES}


def all_sql() -> dict[str, str]:
    return {"op2_url_filters": url_filters.SQL, "op6_mix": mixing.SQL, "op7_vectors": vector_dedup.SQL, "op9_licenses": licenses.SQL, "op10_topk": topk.SQL, "op12_warc": warc.SQL}
