"""Queries of problem 5: choice texts and grammar references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import materialise, table
from . import consistent, form_sql, records, termfreq


def term_records(spark: SparkSession, folder: str) -> DataFrame:
    """field, key, terms: the terms of each record in consistent form, references in lower case. A table of the shared folder."""
    choices = records.records(table(spark, folder, "vocab_mcq_en2ja"), raw=F.transform("body.choices", lambda c: c["text"]))
    refs = records.records(table(spark, folder, "grammar_mcq"), raw=F.array("target.ref"))
    key = F.struct(*records.KEY).alias("key")
    rows = choices.select(F.lit("choice_text").alias("field"), key, "raw").unionByName(refs.select(F.lit("target_ref").alias("field"), key, "raw"))
    rows = materialise(rows, "raw-terms")
    changed = consistent.forms(rows.select(F.explode("raw").alias("text")))
    # only texts that may change need their form looked up; records without one keep their list as it is
    touched = F.exists("raw", consistent.may_change)
    one = rows.where(touched).select("field", "key", F.explode("raw").alias("text")).join(changed, "text", "left")
    redone = one.groupBy("field", "key").agg(F.collect_list(F.coalesce("form", "text")).alias("terms"))
    plain = rows.where(~F.coalesce(touched, F.lit(False))).select("field", "key", F.col("raw").alias("terms"))
    terms = plain.unionByName(redone)
    lower = F.when(F.col("field") == "target_ref", F.transform("terms", F.lower)).otherwise(F.col("terms"))
    return materialise(terms.withColumn("terms", lower), "terms")


def _marked(spark: SparkSession, folder: str) -> DataFrame:
    rows = term_records(spark, folder)
    totals = rows.groupBy("field").agg(F.count(F.lit(1)).alias("n_all"))
    return termfreq.marked(termfreq.frequencies(rows), totals)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return _marked(spark, folder).where("mark is not null").select("field", "term", "mark")


def p5_terms(spark: SparkSession, folder: str) -> DataFrame:
    """Every term with its occurrences, its records and its mark ('' where it is neither rare nor common)."""
    return _marked(spark, folder).select("field", "term", "n_occurrences", "n_records", F.coalesce("mark", F.lit("")).alias("mark"))


def queries() -> dict:
    return {f.__name__: f for f in (p5_found, p5_terms)}


def oracle_sql() -> dict[str, str]:
    last = "qualify row_number() over (partition by set_id, question_id, generation order by ingested_at desc, rec_id desc) = 1"
    counted = f"""
with v as (select rec_id, body.choices as cs from vocab_mcq_en2ja {last}), g as (select rec_id, target.ref as ref from grammar_mcq {last}),
t as (select 'choice_text' as field, rec_id, {form_sql.form('c.text')} as term from (select rec_id, unnest(cs) as c from v) where c.text is not null
  union all select 'target_ref', rec_id, lower({form_sql.form('ref')}) from g where ref is not null),
n as (select field, term, count(*) as n_occurrences, count(distinct rec_id) as n_records from t group by 1, 2),
a as (select 'choice_text' as field, count(*) as n_all from v union all select 'target_ref', count(*) from g),
m as (select n.*, case when 40 * n_records > n_all then 'common' when n_records <= 2 then 'rare' end as mark from n join a using (field))"""
    return {
        "p5_found": counted + " select field, term, mark from m where mark is not null",
        "p5_terms": counted + " select field, term, n_occurrences, n_records, coalesce(mark, '') as mark from m",
    }
