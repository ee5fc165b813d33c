"""Queries of problem 7: held-out test items in the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..runtime import table
from . import leak

CONSECUTIVE = 12
NEAR_SHARE, NEAR_WINDOW = 0.8, 64


def _both(spark: SparkSession, folder: str) -> tuple[DataFrame, list[leak.Query]]:
    items = leak.load_queries(table(spark, folder, "eval_items"), "item_id", "text")
    return leak.index(table(spark, folder, "documents"), "doc_id", "text"), items


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents in which 12 consecutive words of an item stand consecutively."""
    return leak.phrases(*_both(spark, folder), CONSECUTIVE)


def p7_whole(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold all words of an item in order, and how often."""
    return leak.whole(*_both(spark, folder))


def p7_near(spark: SparkSession, folder: str) -> DataFrame:
    """Documents in which four fifths of an item's distinct words stand within 64 words, or as many as the item has."""
    return leak.proximity(*_both(spark, folder), NEAR_SHARE, NEAR_WINDOW)


def queries() -> dict:
    return {f.__name__: f for f in (p7_found, p7_whole, p7_near)}


# DuckDB has no compatibility composition; what the test tables hold of full-width forms and format characters is undone here
_WORDS = (
    "regexp_extract_all(lower(translate(regexp_replace({0}, '[''’‘ʼ＇\\x{{ad}}\\x{{600}}-\\x{{605}}\\x{{61c}}\\x{{180e}}\\x{{200b}}-\\x{{200f}}\\x{{202a}}-\\x{{202e}}\\x{{2060}}-\\x{{2064}}\\x{{2066}}-\\x{{206f}}\\x{{feff}}]', '', 'g'), "
    "'ＡＢＣＤＥＦＧＨＩＪＫＬＭＮＯＰＱＲＳＴＵＶＷＸＹＺａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ０１２３４５６７８９', 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789')), '[a-z0-9]+')"
)


def oracle_sql() -> dict[str, str]:
    """Every 12 words of an item looked for by their first and last; whole items as texts between spaces. Proximity is tested by brute force."""
    return {
        "p7_found": f"""
with d as (select doc_id, {_WORDS.format('text')} as w from documents where text is not null), i as (select item_id, {_WORDS.format('text')} as w from eval_items where text is not null),
g as (select item_id, array_to_string(list_slice(w, k, k + {CONSECUTIVE - 1}), ' ') as gram from (select item_id, w, unnest(range(1, len(w) - {CONSECUTIVE - 2})) as k from i)),
p as (select distinct split_part(gram, ' ', 1) as a, split_part(gram, ' ', {CONSECUTIVE}) as b from g),
t as (select doc_id, unnest(w) as a, unnest(range(1, len(w) + 1)) as k from d),
c as (select t.doc_id, t.k from t join t e on e.doc_id = t.doc_id and e.k = t.k + {CONSECUTIVE - 1} join p on p.a = t.a and p.b = e.a)
select distinct c.doc_id, g.item_id from c join d using (doc_id) join g on g.gram = array_to_string(list_slice(d.w, c.k, c.k + {CONSECUTIVE - 1}), ' ')""",
        # doubled spaces let copies that follow one another be counted
        "p7_whole": f"""
with d as (select doc_id, ' ' || array_to_string({_WORDS.format('text')}, '  ') || ' ' as s from documents where text is not null), i as (select item_id, ' ' || array_to_string({_WORDS.format('text')}, '  ') || ' ' as q from eval_items where text is not null)
select doc_id, item_id, (length(s) - length(replace(s, q, ''))) // length(q) as n_times from d join i on contains(d.s, i.q) where q <> '  '""",
    }
