"""Comparing versions of a table, files and sets of names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def changes(old: DataFrame, new: DataFrame, key: str, values: list[str]) -> DataFrame:
    """key, bucket ('added', 'removed', 'changed') by one full outer join; unchanged rows are left out. Nulls equal each other."""
    o = old.select(F.col(key).alias("__o"), F.struct(*values).alias("__old"))
    n = new.select(F.col(key).alias("__n"), F.struct(*values).alias("__new"))
    both = o.join(n, F.col("__o") == F.col("__n"), "full_outer")
    bucket = F.when(F.col("__old").isNull(), "added").when(F.col("__new").isNull(), "removed").when(~F.col("__old").eqNullSafe(F.col("__new")), "changed")
    return both.select(F.coalesce("__n", "__o").alias(key), bucket.alias("bucket")).where("bucket is not null")


def summary(changed: DataFrame, key: str, *, examples: int = 50) -> DataFrame:
    """bucket, n, and the first keys of each bucket (a report, so their number is bounded)."""
    from pyspark.sql import Window as W

    ranked = changed.withColumn("__n", F.row_number().over(W.partitionBy("bucket").orderBy(key)))
    first = ranked.where(F.col("__n") <= examples).groupBy("bucket").agg(F.array_sort(F.collect_list(key)).alias("first_keys"))
    return changed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).join(first, "bucket")


def digest_mismatches(expected: DataFrame, actual: DataFrame, name: str = "name", digest: str = "sha256") -> DataFrame:
    """name, wanted, actual: files whose digest isn't the recorded one, missing on either side included."""
    e, a = expected.select(name, F.col(digest).alias("wanted")), actual.select(name, F.col(digest).alias("actual"))
    return e.join(a, name, "full_outer").where(~F.col("wanted").eqNullSafe(F.col("actual")))


def both_ways(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """key, side: what only one of two sets has ('left' or 'right')."""
    l, r = left.select(key).distinct(), right.select(key).distinct()  # noqa: E741
    return l.join(r, key, "left_anti").withColumn("side", F.lit("left")).unionByName(r.join(l, key, "left_anti").withColumn("side", F.lit("right")))


def in_both(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.select(key).distinct().join(right.select(key).distinct(), key, "left_semi")


def in_either(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.select(key).union(right.select(key)).distinct()
