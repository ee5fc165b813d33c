"""Vocabulary choice questions, as tables and inside received payloads, as related flat tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import table
from . import shred

FORMAT = "vocab_mcq_en2ja"


def adjacency(questions: DataFrame, payloads: DataFrame) -> DataFrame:
    """Nodes of both sources. A table row counts as a set of its one question, whose format is the table's."""
    question = F.struct("question_id", "format", "body", "provenance")
    row = F.to_json(F.struct("set_id", F.lit(FORMAT).alias("format"), F.array(question).alias("questions")), {"ignoreNullFields": "false"})
    return shred.nodes(shred.documents(questions, FORMAT, "rec_id", row).unionByName(shred.documents(payloads, "set_raw", "raw_id", F.col("payload"))))


def flat_tables(spark: SparkSession, folder: str) -> shred.Entities:
    return shred.entities(adjacency(table(spark, folder, FORMAT), table(spark, folder, "set_raw")))


def found(e: shred.Entities) -> DataFrame:
    """One row per choice that is an object with a non-null text, with its question, set and review."""
    question = e.questions.where(F.trim(F.col("format")) == FORMAT).select("doc", F.col("node").alias("up_question"), "set_id", "question_id")
    return (
        e.choices.where("has_text")
        .join(question, ["doc", "up_question"])
        .join(e.reviews.select("doc", "up_question", "review_ref"), ["doc", "up_question"], "left")
        .select("src", "rec_id", "set_id", "question_id", F.col("choice_no").cast("int").alias("choice_no"), F.coalesce("review_ref", F.lit("")).alias("review_ref"))
    )


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return found(flat_tables(spark, folder))


def p1_sets(spark: SparkSession, folder: str) -> DataFrame:
    """Sets with their number of questions."""
    e = flat_tables(spark, folder)
    n = e.questions.groupBy("doc", F.col("up_set").alias("node")).agg(F.count(F.lit(1)).alias("n_questions"))
    return e.sets.join(n, ["doc", "node"], "left").select("src", "rec_id", F.col("node").alias("set_node"), "set_id", "format", F.coalesce("n_questions", F.lit(0)).alias("n_questions"))


def p1_questions(spark: SparkSession, folder: str) -> DataFrame:
    e = flat_tables(spark, folder)
    return e.questions.select("src", "rec_id", F.col("node").alias("question_node"), F.col("up_set").alias("set_node"), "set_id", "question_id", "format")


def p1_choices(spark: SparkSession, folder: str) -> DataFrame:
    e = flat_tables(spark, folder)
    return e.choices.select("src", "rec_id", F.col("node").alias("choice_node"), F.col("up_question").alias("question_node"), F.col("choice_no").cast("int").alias("choice_no"), "text", "gloss", "is_correct")


def p1_reviews(spark: SparkSession, folder: str) -> DataFrame:
    e = flat_tables(spark, folder)
    return e.reviews.select("src", "rec_id", F.col("node").alias("review_node"), F.col("up_question").alias("question_node"), "review_ref")


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p1_sets, p1_questions, p1_choices, p1_reviews)}


def _held(x: str) -> str:
    """SQL of the value that a text holds if that is JSON, else of the text."""
    return f"case when json_type({x}) = 'VARCHAR' and json_valid({x} ->> '$') and json_type(({x} ->> '$')::json) in ('OBJECT', 'ARRAY', 'VARCHAR') then ({x} ->> '$')::json else {x} end"


def _there(member: str) -> str:
    return f"coalesce(json_type(v -> '{member}') <> 'NULL', false)"


def _scalar(member: str) -> str:
    return f"case when json_type(v -> '{member}') not in ('OBJECT', 'ARRAY', 'NULL') then v ->> '{member}' end as {member}"


#: Every value by recursion with its path; a value's number is its place among the document's values, members in order of their names.
_TREE = f"""
with recursive d as (select 'set_raw' as src, raw_id as rec_id, payload::json as v from set_raw where payload is not null and json_valid(payload)
union all select '{FORMAT}', rec_id, to_json(struct_pack(set_id := set_id, format := '{FORMAT}', questions := [struct_pack(question_id := question_id, format := format, body := body, provenance := provenance)])) from {FORMAT}),
n as (
select src, rec_id, '' as path, []::bigint[] as place, null::varchar as owner, null::varchar as label, 0::bigint as ord, false as in_list, {_held('v')} as v from d
union all
select src, rec_id, path || '/' || c.k, list_append(place, c.i), case when in_array then owner else path end, case when in_array then label else c.k end, c.i, in_array, {_held('c.v')} from (
  select src, rec_id, path, place, owner, label, json_type(v) = 'ARRAY' as in_array, unnest(case json_type(v)
    when 'OBJECT' then list_transform(list_sort(json_keys(v)), lambda k, i: struct_pack(k := k, i := i - 1, v := json_extract(v, '/' || replace(replace(k, '~', '~0'), '/', '~1'))))
    when 'ARRAY' then list_transform(range(json_array_length(v)::bigint), lambda i: struct_pack(k := i::varchar, i := i, v := json_extract(v, '/' || i))) end) as c from n)
),
o as materialized (select * exclude (v, place, kind) from (select *, json_type(v) as kind, (row_number() over (partition by src, rec_id order by place) - 1)::int as node, {_there('questions')} as has_questions, {_there('question_id')} or {_there('body')} as has_own, {_there('text')} as has_text,
  {", ".join(map(_scalar, ("set_id", "question_id", "format", "review_ref", "text", "gloss", "is_correct")))} from n) where kind = 'OBJECT'),
q as (select src, rec_id, path, node, question_id, format, owner as up_set from o where label = 'questions' and (in_list or has_own)
  union all select c.src, c.rec_id, c.path, c.node, c.question_id, c.format, p.owner from o c join o p on p.src = c.src and p.rec_id = c.rec_id and p.path = c.owner and p.label = 'questions' and not p.in_list and not p.has_own where not coalesce(c.label = 'questions' and (c.in_list or c.has_own), false)),
s as (select q.src, q.rec_id, q.path, q.node, t.node as set_node, t.set_id, q.question_id, coalesce(q.format, t.format) as format from q join o t on t.src = q.src and t.rec_id = q.rec_id and t.path = q.up_set and t.has_questions),
k as (select src, rec_id, node, owner as up_body, case when in_list then ord else 0 end as no, text, gloss, is_correct, has_text from o where label = 'choices' and (in_list or has_text)
  union all select k.src, k.rec_id, k.node, p.owner, k.ord, k.text, k.gloss, k.is_correct, k.has_text from o k join o p on p.src = k.src and p.rec_id = k.rec_id and p.path = k.owner and p.label = 'choices' and not p.in_list and not p.has_text),
c as (select k.src, k.rec_id, k.node, b.owner as up_question, u.node as question_node, k.no::int as choice_no, k.text, k.gloss, k.is_correct, k.has_text from k
  join o b on b.src = k.src and b.rec_id = k.rec_id and b.path = k.up_body and b.label = 'body' join o u on u.src = b.src and u.rec_id = b.rec_id and u.path = b.owner),
r as (select p.src, p.rec_id, p.owner, u.node as question_node, min(p.node) as node, min(p.review_ref) as review_ref from o p join o u on u.src = p.src and u.rec_id = p.rec_id and u.path = p.owner where p.label = 'provenance' and p.review_ref is not null group by all)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": _TREE + f"""
select c.src, c.rec_id, s.set_id, s.question_id, c.choice_no, coalesce(r.review_ref, '') as review_ref from c join s on s.src = c.src and s.rec_id = c.rec_id and s.path = c.up_question
left join r on r.src = s.src and r.rec_id = s.rec_id and r.owner = s.path where c.has_text and trim(s.format) = '{FORMAT}'""",
        "p1_sets": _TREE + """
select src, rec_id, node as set_node, set_id, format, (select count(*) from s where s.src = o.src and s.rec_id = o.rec_id and s.set_node = o.node) as n_questions from o where has_questions""",
        "p1_questions": _TREE + " select src, rec_id, node as question_node, set_node, set_id, question_id, format from s",
        "p1_choices": _TREE + " select src, rec_id, node as choice_node, question_node, choice_no, text, gloss, is_correct from c",
        "p1_reviews": _TREE + " select src, rec_id, node as review_node, question_node, review_ref from r",
    }
