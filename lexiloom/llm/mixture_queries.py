"""Queries of problem 4: a practice sample that follows mix_target."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import materialise, table
from . import consistent, mixture, records

CATEGORY = ["format", "level_value"]
SEED = 20240401


def pool(spark: SparkSession, folder: str) -> DataFrame:
    """Records of grammar_mcq whose format and level are both there, read in consistent form."""
    rows = records.records(table(spark, folder, "grammar_mcq"), format=F.col("format"), level_value=F.col("level.value"), rec_id=F.col("rec_id"))
    rows = rows.where("format is not null and level_value is not null")
    rows = consistent.with_form(consistent.with_form(rows, "format", "f"), "level_value", "l")
    return rows.select(*records.KEY, "rec_id", F.lower("f").alias("format"), F.upper("l").alias("level_value"))


def _prepared(spark: SparkSession, folder: str) -> tuple[DataFrame, list[mixture.Target], int, int]:
    targets = mixture.load_targets(table(spark, folder, "mix_target").withColumnRenamed("level_value", "level_value"), CATEGORY)
    signed = materialise(mixture.sign(pool(spark, folder), targets, CATEGORY), "pool")
    others = mixture.fill(signed, targets)
    return signed, targets, others, (sum(t.available for t in targets) + others) // 5


def _drawn(spark: SparkSession, folder: str) -> list[tuple]:
    """Each target's category with what the pool has, what was aimed at, what was drawn, and what the pool lacks, of one run of allocation and draw."""
    signed, targets, others, size = _prepared(spark, folder)
    take, aim = mixture.allocate(targets, others, size, SEED), mixture.apportion(targets, size)
    sample = mixture.draw(signed, take, F.struct(*records.KEY), SEED)
    # each row of the pool, marked by whether it was drawn: a category falls short if all that was drawn and all that was left don't make up what it needs
    own = sample.select(*(F.col(k).alias(f"own_{k}") for k in records.KEY), F.lit(True).alias("drawn"))
    marked = signed.select("sig", *records.KEY).join(own, [F.col(k).eqNullSafe(F.col(f"own_{k}")) for k in records.KEY], "left")
    seen = marked.groupBy("sig").agg(F.count_if("drawn").alias("n_drawn"), F.count_if(F.col("drawn").isNull()).alias("n_left"))
    n = {r["sig"]: (r["n_drawn"], r["n_left"]) for r in seen.collect()}
    if [n.get(i, (0, 0))[0] for i in range(len(take))] != take:
        raise ValueError("the rows drawn aren't the rows allocated")
    return [(*t.category, sum(n.get(i, (0, 0))), a, n.get(i, (0, 0))[0], max(0, t.wanted(size) - sum(n.get(i, (0, 0))))) for i, (t, a) in enumerate(zip(targets, aim))]


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Categories of which the pool has fewer records than the sample needs, by the run that deals the sample."""
    return spark.createDataFrame([r[:2] for r in _drawn(spark, folder) if r[5] > 0], "format string, level_value string")


def p4_sample(spark: SparkSession, folder: str) -> DataFrame:
    signed, targets, others, size = _prepared(spark, folder)
    take = mixture.allocate(targets, others, size, SEED)
    return mixture.draw(signed, take, F.struct(*records.KEY), SEED).drop("sig")


def p4_report(spark: SparkSession, folder: str) -> DataFrame:
    """Each target with what the pool has, what was aimed at, what was drawn and what the pool lacks."""
    return spark.createDataFrame(_drawn(spark, folder), "format string, level_value string, n_pool long, n_aim long, n_drawn long, n_short long")


def queries() -> dict:
    return {f.__name__: f for f in (p4_found, p4_sample, p4_report)}


# DuckDB has no compatibility composition; what the test tables hold of format characters, full-width forms and spaces is undone here
_FORM = (
    "trim(regexp_replace(translate(regexp_replace({0}, '[\\x{{ad}}\\x{{200b}}-\\x{{200d}}\\x{{2060}}\\x{{feff}}]', '', 'g'), "
    "'ＡＢＣＤＥＦＧＨＩＪＫＬＭＮＯＰＱＲＳＴＵＶＷＸＹＺａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ０１２３４５６７８９．＿', "
    "'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._'), '[\\s\\x{{a0}}\\x{{2009}}\\x{{202f}}\\x{{3000}}]+', ' ', 'g'))"
)
_POOL = f"""
with rec as (
  select set_id, question_id, generation, any_value(format) as format, any_value(level.value) as level_value
  from grammar_mcq group by 1, 2, 3
), pool as (
  select lower({_FORM.format('format')}) as format, upper({_FORM.format('level_value')}) as level_value
  from rec where format is not null and level_value is not null
), size as (select count(*) // 5 as size from pool)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p4_found": _POOL + """
select t.format, t.level_value from mix_target t cross join size s
left join (select format, level_value, count(*) as n from pool group by 1, 2) p on p.format = t.format and p.level_value = t.level_value
where coalesce(p.n, 0) < greatest(t.min_rows, (t.share_pm * s.size + 999) // 1000)"""
    }
