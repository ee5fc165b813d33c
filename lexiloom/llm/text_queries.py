"""Queries of problem 2: texts that read the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import table
from . import consistent, form_sql


def learner_texts(spark: SparkSession, folder: str) -> DataFrame:
    """src, rec_id, choice_no, text: glosses of choices, and Japanese examples (choice_no -1)."""
    choices = table(spark, folder, "vocab_mcq_en2ja").select("rec_id", F.posexplode("body.choices").alias("choice_no", "choice"))
    examples = table(spark, folder, "grammar_example_selfcheck")
    return choices.select(F.lit("vocab_mcq_en2ja").alias("src"), "rec_id", "choice_no", F.col("choice.gloss").alias("text")).unionByName(
        examples.select(F.lit("grammar_example_selfcheck").alias("src"), "rec_id", F.lit(-1).alias("choice_no"), F.col("body.example.ja").alias("text"))
    )


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return consistent.inconsistent(learner_texts(spark, folder), "text").select("src", "rec_id", "choice_no")


def p2_forms(spark: SparkSession, folder: str) -> DataFrame:
    """How often each consistent form occurs, and in how many spellings."""
    rows = consistent.with_form(learner_texts(spark, folder).where("text is not null"), "text", "form")
    by_spelling = rows.groupBy("src", "form", "text").agg(F.count(F.lit(1)).alias("n"))
    return by_spelling.groupBy("src", "form").agg(F.sum("n").alias("n_texts"), F.count(F.lit(1)).alias("n_spellings"))


def queries() -> dict:
    return {f.__name__: f for f in (p2_found, p2_forms)}


_TEXTS = """(select 'vocab_mcq_en2ja' as src, rec_id, i::int as choice_no, c.gloss as text from (select rec_id, unnest(body.choices) as c, unnest(range(len(body.choices))) as i from vocab_mcq_en2ja)
union all select 'grammar_example_selfcheck', rec_id, -1, body.example.ja from grammar_example_selfcheck)"""


def oracle_sql() -> dict[str, str]:
    form = form_sql.form("text")
    return {
        "p2_found": f"select src, rec_id, choice_no from {_TEXTS} where text <> {form}",
        "p2_forms": f"select src, {form} as form, count(*) as n_texts, count(distinct text) as n_spellings from {_TEXTS} where text is not null group by all",
    }
