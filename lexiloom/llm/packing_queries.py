"""Queries of problem 6: training sequences of at most 4,096 tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import materialise, table
from . import packing


def _sequences(spark: SparkSession, folder: str) -> DataFrame:
    counted = materialise(packing.sizes(table(spark, folder, "documents"), "doc_id", "text"), "sizes")
    return packing.sequences(counted)


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that had to be divided."""
    return _sequences(spark, folder).where("piece = 1").select("doc_id")


def p6_sequences(spark: SparkSession, folder: str) -> DataFrame:
    return _sequences(spark, folder).select("sequence", "offset", "doc_id", "piece", "start_token", "n_tokens")


def p6_report(spark: SparkSession, folder: str) -> DataFrame:
    """Sequences, their tokens, the least number of sequences that could hold these, and the unused share."""
    filled = _sequences(spark, folder).groupBy("sequence").agg(F.sum("n_tokens").alias("fill"))
    total = filled.agg(F.count(F.lit(1)).alias("n_sequences"), F.coalesce(F.sum("fill"), F.lit(0)).alias("n_tokens"))
    return total.select("n_sequences", "n_tokens", F.ceil(F.col("n_tokens") / packing.CAPACITY).alias("n_least"), F.round(1 - F.try_divide("n_tokens", F.col("n_sequences") * packing.CAPACITY), 6).alias("unused"))


def queries() -> dict:
    return {f.__name__: f for f in (p6_found, p6_sequences, p6_report)}


def oracle_sql() -> dict[str, str]:
    """Words bound a text's tokens from below and bytes from above, and no text is near the limit."""
    return {"p6_found": "select doc_id from documents where len(regexp_extract_all(text, '\\S+')) > 4096"}
