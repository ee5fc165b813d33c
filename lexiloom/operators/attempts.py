"""Attempts: audit files with their key in the name, assembled parts, the latest accepted one, gaps and closure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text

# What the name of an audit file can be.
_Q = "(q(?:0[1-9]|1[0-9]|20))"
FILE_KINDS = {
    "part": f"^{_Q}\\.(gen[1-3])\\.(candidate|machine|request|review)\\.json\\z",
    "candidate_invalid": f"^{_Q}\\.(gen[1-3])\\.(candidate)\\.invalid([12])\\.txt\\z",
    "review_invalid": f"^{_Q}\\.(gen[1-3])\\.(review)\\.invalid([123])\\.txt\\z",
    "set_check": f"^set_check\\.(?:{_Q}\\.(gen[1-3])|final)\\.json\\z",
    "outcome": f"^slot\\.{_Q}\\.outcome\\.json\\z",
    "work": f"^{_Q}\\.(gen[1-3])\\.[a-z]+-(?:prompt|last)\\.txt\\z",
}


def classified(names: DataFrame, column: str = "name") -> DataFrame:
    """names with kind, question_id, generation, part and n_invalid out of the file's name; kind is null for unknown names."""
    c = F.col(column)
    kind = F.coalesce(*(F.when(c.rlike(p), k.removeprefix("candidate_").removeprefix("review_")) for k, p in FILE_KINDS.items()))
    grab = lambda pattern, i: F.nullif(F.regexp_extract(c, pattern, i), F.lit(""))
    return names.withColumns({
        "kind": kind,
        "question_id": F.coalesce(*(grab(FILE_KINDS[k], 1) for k in FILE_KINDS)),
        "generation": F.coalesce(*(grab(FILE_KINDS[k], 2) for k in ("part", "candidate_invalid", "review_invalid", "set_check", "work"))),
        "part": F.coalesce(*(grab(FILE_KINDS[k], 3) for k in ("part", "candidate_invalid", "review_invalid"))),
        "n_invalid": F.coalesce(grab(FILE_KINDS["candidate_invalid"], 4), grab(FILE_KINDS["review_invalid"], 4)).cast("int"),
    })


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """set_id, name, content and the name's parts of all audit files below <path>/<set_id>/review."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    parts = files.select(F.regexp_extract("path", "([^/]+)/review/[^/]+$", 1).alias("set_id"), F.regexp_extract("path", "([^/]+)$", 1).alias("name"), "content")
    return classified(parts)


def assembled(parts: DataFrame, key: list[str], kind: str, value: str, kinds: list[str]) -> DataFrame:
    """One row per key with a column per kind and complete: whether all are there."""
    wide = parts.groupBy(*key).agg(*(F.max(F.when(F.col(kind) == k, F.col(value))).alias(k) for k in kinds))
    there = F.lit(True)
    for k in kinds:
        there = there & F.col(k).isNotNull()
    return wide.withColumn("complete", there)


def latest(attempts: DataFrame, key: list[str], generation: str, accepted: Column) -> DataFrame:
    """The highest accepted generation per key (ties by rec_id): a window that keeps one row per partition before the shuffle."""
    n = F.row_number().over(W.partitionBy(*key).orderBy(text.ordinal(generation).desc_nulls_last(), F.col("rec_id")))
    return attempts.where(accepted).withColumn("__n", n).where("__n = 1").drop("__n")


def latest_with_override(attempts: DataFrame, key: list[str], generation: str, accepted: Column, passing: Column, target: Column) -> DataFrame:
    """The latest accepted attempt of every key; of target keys the latest passing one, accepted or not, comes first."""
    first = latest(attempts, key, generation, passing & target).withColumn("__p", F.lit(0))
    both = first.unionByName(latest(attempts, key, generation, accepted).withColumn("__p", F.lit(1)))
    n = F.row_number().over(W.partitionBy(*key).orderBy("__p"))
    return both.withColumn("__n", n).where("__n = 1").drop("__n", "__p")


def last_delivery(rows: DataFrame, key: list[str]) -> DataFrame:
    """One row per natural key: the last delivered."""
    n = F.row_number().over(W.partitionBy(*key).orderBy(F.col("ingested_at").desc_nulls_last(), F.col("rec_id").desc()))
    return rows.withColumn("__n", n).where("__n = 1").drop("__n")


def gaps(attempts: DataFrame, key: list[str], generation: str) -> DataFrame:
    """key, n, last: keys whose generations aren't 1 to the last one without a gap."""
    g = attempts.groupBy(*key).agg(F.countDistinct(text.ordinal(generation)).alias("n"), F.min(text.ordinal(generation)).alias("first"), F.max(text.ordinal(generation)).alias("last"))
    return g.where((F.col("first") != 1) | (F.col("last") != F.col("n"))).select(*key, "n", "last")


def terminal(attempts: DataFrame, key: list[str], generation: str, accepted: Column) -> DataFrame:
    """key, n_generations, sound: the last generation is accepted and every earlier one was used up."""
    one = attempts.groupBy(*key, text.ordinal(generation).alias("g")).agg(F.bool_or(accepted).alias("ok"))
    w = W.partitionBy(*key).orderBy("g")
    one = one.withColumn("is_last", F.lead("g").over(w).isNull())
    g = one.groupBy(*key).agg(F.count(F.lit(1)).alias("n_generations"), F.bool_or(F.col("is_last") & F.col("ok")).alias("ends"), F.bool_and(F.col("is_last") | ~F.col("ok")).alias("used_up"))
    return g.select(*key, "n_generations", (F.coalesce("ends", F.lit(False)) & F.coalesce("used_up", F.lit(False))).alias("sound"))


def invalid_sequences(names: DataFrame, key: list[str]) -> DataFrame:
    """key: attempts whose invalid files aren't numbered 1 to n, or that went on after the last allowed one."""
    bad = names.where("kind = 'invalid'").groupBy(*key, "part").agg(F.array_sort(F.collect_set("n_invalid")).alias("k"))
    most = F.when(F.col("part") == "candidate", 2).otherwise(3)
    gap = ~(F.col("k") == F.sequence(F.lit(1), F.size("k")))
    regular = names.where("kind = 'part'").select(*key, "part", F.lit(True).alias("went_on")).distinct()
    joined = bad.join(regular, [*key, "part"], "left")
    return joined.where(gap | ((F.size("k") >= most) & F.coalesce("went_on", F.lit(False)))).select(*key, "part", F.array_join(F.transform("k", lambda x: x.cast("string")), ",").alias("numbers"))


def next_in_queue(queued: DataFrame, used: DataFrame, key: list[str], ref: str, ordinal: str) -> DataFrame:
    """key, ref: of each queue the first entry in order that isn't used yet; an emptied queue has no row."""
    left = queued.join(used.select(*key, ref).distinct(), [*key, ref], "left_anti")
    return left.groupBy(*key).agg(F.min_by(ref, ordinal).alias(ref))


def unequal(left: DataFrame, right: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """key, column_name: where two documents of one key differ in a value they share (nulls equal each other)."""
    l = left.select(*key, *(F.col(c).alias(f"__l{i}") for i, c in enumerate(columns)))  # noqa: E741
    r = right.select(*key, *(F.col(c).alias(f"__r{i}") for i, c in enumerate(columns)))
    differs = [F.when(~F.col(f"__l{i}").eqNullSafe(F.col(f"__r{i}")), F.lit(c.split(".")[-1])) for i, c in enumerate(columns)]
    return l.join(r, key).select(*key, F.explode(F.array_compact(F.array(*differs))).alias("column_name"))
