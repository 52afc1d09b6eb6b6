"""Small helpers of the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.session import ship

#: A word is a run of characters other than space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Words in a text as a long; 0 for a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def chance(*parts: Column) -> Column:
    """A repeatable number strictly between 0 and 1, from 48 bits of an MD5 digest of the parts.

    Null parts count as the empty text.
    """
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    number = F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double")
    return (number + 0.5) / F.lit(float(2**48))
