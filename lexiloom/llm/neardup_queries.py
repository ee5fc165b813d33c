"""Queries of problem 3: question sentences that recur with small changes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import table
from . import neardup

FIELDS = {"grammar_mcq": "body.sentence_with_blank", "vocab_flashcard_en2ja": "body.example.en", "grammar_rewrite": "body.source_sentence"}


def sentences(spark: SparkSession, folder: str) -> DataFrame:
    """field, rec_id, text of the three tables."""
    parts = [table(spark, folder, t).select(F.lit(t).alias("field"), "rec_id", F.col(c).alias("text")) for t, c in FIELDS.items()]
    return reduce(DataFrame.unionByName, parts)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    members, classes = neardup.classes(sentences(spark, folder), "field", "rec_id", "text")
    pairs = neardup.row_pairs(members, neardup.links(classes))
    return pairs.select(F.col("by").alias("field"), "rec_id_a", "rec_id_b")


def p3_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Each row with its class, its group (the least row of the connected classes) and its number of linked classes."""
    members, classes = neardup.classes(sentences(spark, folder), "field", "rec_id", "text")
    pairs = neardup.materialise(neardup.links(classes), "links")
    degree = pairs.select(F.explode(F.array("a", "b")).alias("cls")).groupBy("cls").agg(F.count(F.lit(1)).alias("n_links"))
    first = members.groupBy("by", "cls").agg(F.min("row_id").alias("class_id"))
    named = neardup.components(classes, pairs).join(first, "cls")
    group = named.groupBy("label").agg(F.min("class_id").alias("group_id"))
    of_class = named.join(group, "label").join(degree, "cls", "left")
    return neardup.with_class(members, of_class.drop("by"), "cls").select(F.col("by").alias("field"), F.col("row_id").alias("rec_id"), "class_id", "group_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def queries() -> dict:
    return {f.__name__: f for f in (p3_found, p3_groups)}


_PLAIN = "translate(translate(text, '''’‘', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: Pairs of rows by their counts of common words, straight from the problem's sentence.
_PAIRS = f"""
with s as ({" union all ".join(f"select '{t}' as field, rec_id, {c} as text from {t}" for t, c in FIELDS.items())}),
w as (select field, rec_id, list_distinct(regexp_extract_all({_PLAIN}, '[a-z0-9]+')) as words from s where text is not null),
u as (select field, rec_id, len(words) as n, unnest(words) as word from w),
c as (select a.field, a.rec_id as rec_id_a, b.rec_id as rec_id_b, a.n as n_a, b.n as n_b, count(*) as n_both
  from u a join u b on a.field = b.field and a.word = b.word and a.rec_id < b.rec_id group by all),
p as (select field, rec_id_a, rec_id_b from c where 10 * n_both >= 7 * (n_a + n_b - n_both))"""


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": _PAIRS + " select field, rec_id_a, rec_id_b from p",
        "p3_groups": _PAIRS.replace("with s as", "with recursive s as", 1)
        + """,
k as (select field, rec_id, min(rec_id) over (partition by field, list_sort(words)) as class_id from w where len(words) > 0),
l as (select distinct p.field, a.class_id as x, b.class_id as y from p
  join k a on a.field = p.field and a.rec_id = p.rec_id_a join k b on b.field = p.field and b.rec_id = p.rec_id_b where a.class_id != b.class_id),
e as (select field, x, y from l union select field, y, x from l),
r as (select field, class_id as x, class_id as top from k union select e.field, e.y, r.top from r join e on e.field = r.field and e.x = r.x),
g as (select field, x, min(top) as group_id from r group by all),
d as (select field, x, count(*) as n_links from e group by all)
select k.field, k.rec_id, k.class_id, g.group_id, coalesce(d.n_links, 0) as n_links
from k join g on g.field = k.field and g.x = k.class_id left join d on d.field = k.field and d.x = k.class_id""",
    }
