"""Records of the question tables: one row per natural key, however often it was delivered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ("set_id", "question_id", "generation")


def records(df: DataFrame, key: tuple[str, ...] = KEY, **values: Column) -> DataFrame:
    """One row per key with the named values as last delivered (ingested_at, then rec_id). Null parts of a key equal each other."""
    named = F.struct(*(v.alias(k) for k, v in values.items()))
    rows = df.select(*key, F.struct("ingested_at", "rec_id").alias("__at"), named.alias("__own"))
    return rows.groupBy(*key).agg(F.max_by("__own", "__at").alias("__own")).select(*key, "__own.*")
