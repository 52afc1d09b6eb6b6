"""Per-document text jobs: cleaning gate, chunk tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom import config as C
from factloom.functions import text as T


def clean_documents(docs: DataFrame, rules: C.CleanRules = C.CleanRules(),
                    min_chars: int = C.MIN_CLEAN_CHARS) -> DataFrame:
    """Add cleaned text, its length, and the status of documents that stop here."""
    return docs.withColumn("clean_text", T.once(T.clean(F.col("raw_text"), rules))).withColumns({
        "clean_chars": F.length("clean_text").cast("bigint"),
        "stop_status": T.gate(F.col("raw_text"), F.col("clean_text"), min_chars),
        "stop_reason": F.when(
            F.length("clean_text").between(1, min_chars - 1),
            F.concat(F.lit("清洗后仅 "), F.length("clean_text").cast("string"), F.lit(f" 字符，低于阈值 {min_chars}"))),
    })


def whole_text_chunks(cleaned: DataFrame) -> DataFrame:
    """One chunk per document that passed the gate."""
    return cleaned.filter(F.col("stop_status").isNull()).select(
        F.sha2(F.concat_ws("|", "document_id", F.lit(0)), 256).alias("chunk_id"), "document_id",
        F.lit(0).alias("chunk_index"), F.col("clean_text").alias("chunk_text"),
        F.col("clean_chars").alias("char_count"))


def split_chunks(docs: DataFrame, text: str = "clean_text", rules: C.ChunkRules = C.ChunkRules()) -> DataFrame:
    """Chunk table: short texts whole, long ones packed from paragraphs and sentences."""
    # the outer form keeps Spark from deriving a filter that would repeat all the text work
    return (
        T.with_chunks(docs.select("document_id", text), text, rules)
        .select("document_id", F.posexplode_outer("chunks").alias("chunk_index", "_c")).filter("_c is not null")
        .select("document_id", "chunk_index", "_c.chunk_text", "_c.char_start", "_c.char_end")
    )


def sentence_rows(docs: DataFrame, text: str = "clean_text") -> DataFrame:
    """Sentence table of each document."""
    return docs.select("document_id", F.posexplode(T.sentences(F.col(text))).alias("sentence_index", "sentence_text"))
