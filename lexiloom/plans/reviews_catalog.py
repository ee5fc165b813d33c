"""Queries over reviews. The tables hold no reviews, so each rewrite question is given one by its number, sound or with a planted fault; the
SQL that makes them is the same for both engines, the SQL that judges them is written from the rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import levels
from ..operators import items, reviews
from ..runtime import materialise, table
from .registry import Registry

_registry = Registry()
query, queries, oracle_sql = _registry.query, _registry.queries, _registry.oracle_sql

KEY = ["rec_id"]
_FINE = ", ".join(f"'{v}'" for v in levels.FINE)

# --- reviews by number, in SQL that both engines read -----------------------------------------------------------------------

_REVIEWS = f"""select rec_id, 'grammar_rewrite' as format, level.value as level, cast(null as varchar(9)) as context, case when rec_id % 4 = 0 then 'travel' end as topic,
  case when rec_id % 3 = 0 then 'pass' else 'fail' end as verdict, body.source_sentence as source, replace(body.target_sentence_with_blank, '____', body.answer) as filled, target.ref as ref
from {{grammar_rewrite}} where level.value in ({_FINE}) and target.ref is not null and length(body.source_sentence) > 9 and body.answer is not null and body.target_sentence_with_blank is not null"""
_REFERENCES = """select g.id, case when g.kyoinban.present and g.kyoinban.level_raw is not null then g.kyoinban.level_raw else p.kyoinban.level_raw end as level_raw,
  case when g.kyoinban.present and g.kyoinban.level_raw is not null then g.kyoinban.name_ja else p.kyoinban.name_ja end as structure, case when g.kyoinban.present and g.kyoinban.level_raw is not null then null else p.id end as inherited_from
from {grammar} g left join {grammar} p on p.id = g.level.inherited_from and p.kyoinban.present and p.kyoinban.level_raw is not null and p.kyoinban.name_ja is not null
where (g.kyoinban.present and g.kyoinban.level_raw is not null and g.kyoinban.name_ja is not null) or (not (g.kyoinban.present and g.kyoinban.level_raw is not null) and p.id is not null)"""
_LEVELS = " union all ".join(f"select {i} as no, '{v}' as estimate" for i, v in enumerate(levels.FINE))
_ESTIMATE = """select r.rec_id, {no} as item_no, 'inversion' as structure, split_part(r.source, ' ', 2) as span, 'reviewer_estimate' as level_source, cast(null as varchar(9)) as grammar_item_id, e.estimate as level,
  case when r.rec_id % 8 = 0 then 'reviewer_estimate ' || e.estimate when r.rec_id % 8 = 1 then 'reviewer_estimate 推定' else 'reviewer_estimate 推定 ' || e.estimate end as evidence
from r join e on e.no = r.rec_id % 9 where r.rec_id % 29 <> 0 and split_part(r.source, ' ', 2) <> ''"""
_INVENTORY = f"""with r as ({_REVIEWS}), f as ({_REFERENCES}), e as ({_LEVELS})
select r.rec_id, 0 as item_no, case when r.rec_id % 10 = 1 then 'other' else coalesce(f.structure, 'none') end as structure, case when r.rec_id % 6 = 0 then substr(r.source, 2, 3) else split_part(r.source, ' ', 1) end as span, 'kyoinban' as level_source, r.ref as grammar_item_id,
  case when r.rec_id % 10 = 2 then 'B2.2' else coalesce(f.level_raw, 'A1.1') end as level, case when r.rec_id % 10 = 3 then 'x' else '教員版 ' || r.ref || ' ' || coalesce(f.level_raw, 'A1.1') || case when f.inherited_from is not null then ' 継承 ' || f.inherited_from else '' end end as evidence
from r left join f on f.id = r.ref where r.rec_id % 29 <> 0
union all {_ESTIMATE.format(no=1)}
union all {_ESTIMATE.format(no=2)} and r.rec_id % 5 = 0"""
_VIOLATIONS = f"""with i as ({{inventory}}), r as ({_REVIEWS})
select i.rec_id, 0 as violation_no, 'CHK-03' as code, 'body.source_sentence ' || chr(34) || i.span || chr(34) as location, i.evidence, r.level as expected_level, split_part(i.level, '-', 1) as actual_level from i join r on r.rec_id = i.rec_id where i.item_no = 0 and i.rec_id % 2 = 0
union all select i.rec_id, 1, 'CHK-03', 'body.source_sentence ' || chr(34) || i.span || chr(34), i.evidence, case when i.rec_id % 7 = 0 then 'A1.1' else r.level end, i.level from i join r on r.rec_id = i.rec_id where i.item_no = 1 and i.rec_id % 3 <> 0
union all select i.rec_id, 2, 'CHK-03', 'body.source_sentence ' || chr(34) || i.span || chr(34), i.evidence, r.level, i.level from i join r on r.rec_id = i.rec_id where i.item_no = 1 and i.rec_id % 11 = 0
union all select rec_id, 3, 'CHK-11', 'body', 'x', case when rec_id % 13 = 0 then 'A1' end, cast(null as varchar(9)) from r where rec_id % 4 = 1
union all select rec_id, 4, 'CHK-13', 'body', 'x', case when rec_id % 9 = 0 then null else 'A1' end, 'A2' from r where rec_id % 6 = 1
union all select rec_id, 5, 'CHK-03', 'body', 'x', level, 'C1' from r where rec_id % 31 = 0"""
_CHECK_IDS = " union all ".join(f"select {i + 1} as k, '{c}' as check_id" for i, c in enumerate(reviews.CHECK_FORMATS))
_CHECK_LIST = ", ".join(f"struct({i + 1} as k, '{c}' as check_id)" for i, c in enumerate(reviews.CHECK_FORMATS))
# grammar_rewrite is the eighth format; it has no context sentence
_APPLY = ", ".join(f"'{c}'" for c, own in reviews.CHECK_FORMATS.items() if 7 in own)
_CHECKS = f"""with r as ({_REVIEWS}), c as ({{every_check}}),
x as (select c.rec_id, c.k, c.check_id, case when c.check_id not in ({_APPLY}) then '形式⑧のため' when c.check_id = 'CHK-17' then '例文が1文のため' when c.check_id = 'CHK-19' and c.topic is null then 'トピック指定なしのため' end as reason from c)
select rec_id, check_id, case when reason is not null and (rec_id + k) % 37 = 0 then 'pass' when reason is not null then 'not_applicable' when (rec_id + k) % 17 = 0 or (k = 3 and rec_id % 2 = 0) then 'fail' when (rec_id + k) % 41 = 0 then 'not_applicable' else 'pass' end as result,
  case when reason is not null and (rec_id + k) % 43 <> 0 then reason else '' end as note from x"""
_DISPUTES = f"""select rec_id, 'V-LEN-01' as code, case when rec_id % 2 = 0 then 'body.source_sentence' else 'body.answer' end as location from ({_REVIEWS}) r where rec_id % 3 = 0"""
_REPORT = f"""select rec_id, case when rec_id % 5 = 0 then 'V-LEX-01' else 'V-LEN-01' end as code, 'body.source_sentence' as location from ({_REVIEWS}) r where rec_id % 4 <> 3"""
_NAMES = {"grammar_rewrite": "grammar_rewrite", "grammar": "grammar"}


def _duck(sql: str) -> str:
    return sql.format(**_NAMES, inventory=_INVENTORY.format(**_NAMES), every_check=f"select r.*, k.* from r, ({_CHECK_IDS}) k")


def _spark(spark: SparkSession, d: str, sql: str, **more: DataFrame) -> DataFrame:
    own = {n: table(spark, d, n) for n in _NAMES if f"{{{n}}}" in sql}
    given = {n: df for n, df in more.items() if f"{{{n}}}" in sql}
    sql = sql.replace("({inventory})", "(select * from {inventory})").replace("{every_check}", f"select r.*, inline(array({_CHECK_LIST})) from r")
    return spark.sql(sql, **own, **given)


def _given(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    r = _spark(spark, d, _REVIEWS)
    texts = F.array(F.struct(F.lit("body.source_sentence").alias("field"), F.col("source").alias("text")), F.struct(F.lit("body.target_sentence_with_blank#filled:answer").alias("field"), F.col("filled").alias("text")))
    inventory = materialise(_spark(spark, d, _INVENTORY), "inventory")
    return {
        "reviews": r.select("rec_id", "format", "level", "context", "topic", "verdict", texts.alias("texts")), "checks": _spark(spark, d, _CHECKS), "inventory": inventory,
        "violations": materialise(_spark(spark, d, _VIOLATIONS, inventory=inventory), "violations"), "grammar": table(spark, d, "grammar"),
    }


# --- judged by SQL ----------------------------------------------------------------------------------------------------------

_RANK = "coalesce(list_position([" + _FINE + "], {0}), 0)"
_REFS = "list_filter(string_split({0}, ' '), lambda x: regexp_full_match(x, 'gp:[0-9]+(-[0-9]+)?'))"
_LEVEL_REFS = "list_filter(string_split({0}, ' '), lambda x: regexp_full_match(x, '(A1\\.[123]|(A2|B1|B2)\\.[12])(-(A1\\.[123]|(A2|B1|B2)\\.[12]))?'))"
_WHOLE = "(i.span <> '' and regexp_matches({0}, case when regexp_matches(i.span, '^[\\p{{L}}\\p{{N}}]') then '(^|[^\\p{{L}}\\p{{N}}])' else '' end || regexp_escape(i.span) || case when regexp_matches(i.span, '[\\p{{L}}\\p{{N}}]$') then '([^\\p{{L}}\\p{{N}}]|$)' else '' end))"
_QUOTED = f"(list_contains({_REFS.format('{0}')}, a.grammar_item_id) and list_contains({_LEVEL_REFS.format('{0}')}, a.f_level) and (a.inherited_from is null or (list_contains({_REFS.format('{0}')}, a.inherited_from) and contains({{0}}, '継承'))))"


def _judged() -> str:
    inventory, violations, checks = _duck(_INVENTORY), _duck(_VIOLATIONS), _duck(_CHECKS)
    quoted = lambda e: _QUOTED.replace("{0}", e)
    return f"""
with rv as ({_duck(_REVIEWS)}), iv as ({inventory}), vi as ({violations}), ck as ({checks}), rf as ({_duck(_REFERENCES)}),
a as (select i.*, split_part(i.level, '-', 1) as intro, rv.level as top, {_WHOLE.format('rv.source')} as in_source, {_WHOLE.format('rv.filled')} as in_filled, rf.id is not null as known, rf.level_raw as f_level, rf.structure as f_structure, rf.inherited_from
  from iv i join rv on rv.rec_id = i.rec_id left join rf on rf.id = i.grammar_item_id),
pairs as (select a.rec_id, a.item_no, v.violation_no, {_RANK.format('a.intro')} > {_RANK.format('a.top')} and v.expected_level = a.top as excess from a join vi v on v.rec_id = a.rec_id and v.code = 'CHK-03' and v.actual_level = a.intro
  where contains(v.location, '"' || a.span || '"') and ((a.in_source and contains(v.location, 'body.source_sentence')) or (a.in_filled and contains(v.location, 'body.target_sentence_with_blank#filled:answer')))
  and case a.level_source when 'kyoinban' then a.known and a.level = a.f_level and a.structure = a.f_structure and {quoted('a.evidence')} and {quoted('v.evidence')} else v.evidence = a.evidence and contains(v.evidence, 'reviewer_estimate') end),
sides as (select rec_id, item_no > 0 as estimated, item_no, violation_no from pairs where excess),
li as (select rec_id, estimated, item_no, row_number() over (partition by rec_id, estimated order by item_no) as n from (select distinct rec_id, estimated, item_no from sides)),
lv as (select rec_id, estimated, violation_no, row_number() over (partition by rec_id, estimated order by violation_no) as n from (select distinct rec_id, estimated, violation_no from sides)),
m as (select li.rec_id, item_no, violation_no from li join lv using (rec_id, estimated, n)),
failed as (select distinct rec_id, check_id as code from ck where result = 'fail'), codes as (select distinct rec_id, code from vi),
reasons as (select ck.*, case when check_id not in ({_APPLY}) then '形式⑧のため' when check_id = 'CHK-17' then '例文が1文のため' when check_id = 'CHK-19' and topic is null then 'トピック指定なしのため' end as reason from ck join rv using (rec_id))
select rec_id, 'inventory/' || item_no as place, unnest(list_filter([
  case when not in_source and not in_filled then 'span' end, case when level_source = 'kyoinban' and not known then 'unresolved' end,
  case when level_source = 'kyoinban' and known and structure <> f_structure then 'structure' end, case when level_source = 'kyoinban' and known and level <> f_level then 'level' end,
  case when level_source = 'kyoinban' and known and not {quoted('a.evidence')} then 'evidence' end,
  case when level_source = 'reviewer_estimate' and not list_contains({_LEVEL_REFS.format('a.evidence')}, level) then 'estimated_level' end, case when level_source = 'reviewer_estimate' and not contains(a.evidence, '推定') then 'estimate_reason' end,
  case when {_RANK.format('intro')} > {_RANK.format('top')} and not exists (select 1 from failed f where f.rec_id = a.rec_id and f.code = 'CHK-03') then 'excess_not_failed' end,
  case when {_RANK.format('intro')} > {_RANK.format('top')} and not exists (select 1 from m where m.rec_id = a.rec_id and m.item_no = a.item_no) then 'excess_without_violation' end], lambda x: x is not null)) as kind from a
union all select rec_id, 'violations/' || violation_no, unnest(list_filter([
  case when code = 'CHK-03' and not exists (select 1 from m where m.rec_id = v.rec_id and m.violation_no = v.violation_no) then 'surplus' end,
  case when code in ('CHK-02', 'CHK-03', 'CHK-04', 'CHK-07', 'CHK-13') and (expected_level is null or actual_level is null) then 'levels_missing' end,
  case when code not in ('CHK-02', 'CHK-03', 'CHK-04', 'CHK-07', 'CHK-13') and (expected_level is not null or actual_level is not null) then 'levels_extra' end,
  case when code = 'CHK-03' and expected_level <> top then 'expected_level' end, case when code = 'CHK-03' and {_RANK.format('actual_level')} = 0 then 'actual_level' end,
  case when code = 'CHK-03' and {_RANK.format('actual_level')} > 0 and {_RANK.format('actual_level')} <= {_RANK.format('top')} then 'not_above' end,
  case when code = 'CHK-03' and {_RANK.format('actual_level')} > 0 and not exists (select 1 from pairs p where p.rec_id = v.rec_id and p.violation_no = v.violation_no) then 'without_item' end], lambda x: x is not null))
  from (select vi.*, rv.level as top from vi join rv using (rec_id)) v
union all select rec_id, check_id, case when reason is null then 'applies' else 'not_applicable' end from reasons where (reason is null and result = 'not_applicable') or (reason is not null and not (result = 'not_applicable' and note = reason))
union all select rec_id, code, 'failed_without_violation' from failed f where not exists (select 1 from codes c where c.rec_id = f.rec_id and c.code = f.code)
union all select rec_id, code, 'violation_without_failure' from codes c where not exists (select 1 from failed f where c.rec_id = f.rec_id and c.code = f.code)
union all select rec_id, 'inventory', 'empty' from rv where rec_id not in (select rec_id from iv)
union all select rec_id, 'verdict', 'verdict' from rv where verdict <> case when rec_id in (select rec_id from failed) then 'fail' else 'pass' end"""


@query(_judged())
def review_problems(spark, d):
    """Everything in which reviews disagree with themselves, their items or the grammar table, violations and items matched one to one."""
    g = _given(spark, d)
    return reviews.problems(g["reviews"], g["checks"], g["inventory"], g["violations"], g["grammar"], KEY)


@query(f"select id, level_raw, inherited_from, structure from ({_duck(_REFERENCES)})")
def teacher_references(spark, d):
    """The level, source and name that a grammar item is quoted by, its own or its parent's."""
    return reviews.teacher_references(table(spark, d, "grammar"))


@query(f"select d.rec_id, d.code, d.location from ({_duck(_DISPUTES)}) d where not exists (select 1 from ({_duck(_REPORT)}) p where p.rec_id = d.rec_id and p.code = d.code and p.location = d.location)")
def unknown_disputes(spark, d):
    """Disputes of violations that the machine report doesn't have."""
    return reviews.unknown_disputes(_spark(spark, d, _DISPUTES), _spark(spark, d, _REPORT), KEY)


@query(f"""
with p as (select rec_id, count(*) as n from ({_duck(_REPORT)}) where code = 'V-LEX-01' group by 1), r as (select rec_id, verdict as review from ({_duck(_REVIEWS)}) where rec_id % 7 <> 0)
select q.rec_id, coalesce(p.n, 0) as n_violations, r.review, case when p.n > 0 or r.review = 'fail' then 'fail' when r.review is null then 'pending' else 'pass' end as verdict from grammar_rewrite q left join p using (rec_id) left join r using (rec_id)""")
def composed_verdict(spark, d):
    """Verdicts of machine report and review together."""
    report, review = _spark(spark, d, _REPORT).where("code = 'V-LEX-01'"), _spark(spark, d, _REVIEWS).where("rec_id % 7 <> 0")
    return reviews.composed(table(spark, d, "grammar_rewrite"), report, review, KEY)


_TOP = "case when format like 'vocab%' then case level when 'A1' then 'A1.3' when 'A2' then 'A2.2' when 'B1' then 'B1.2' when 'B2' then 'B2.2' end else level end"


@query(f"""
with f(no, format) as (values {", ".join(f"({i}, '{f}')" for i, f in enumerate(items.FORMATS))}), c(check_id, own) as (values {", ".join(f"('{c}', {list(own)!r})" for c, own in reviews.CHECK_FORMATS.items())}),
q as (select rec_id, f.no, f.format, (rec_id % 2 = 0) as with_context, (rec_id % 3 = 0) as with_topic, (['A1', 'A2', 'B1', 'B2'])[(rec_id % 4)::int + 1] as level from grammar_rewrite join f on f.no = rec_id % 9)
select rec_id, check_id, case when not list_contains(own, no) then '形式' || substr('①②③④⑤⑥⑦⑧⑨', no + 1, 1) || 'のため' when check_id = 'CHK-17' and not with_context then '例文が1文のため' when check_id = 'CHK-19' and not with_topic then 'トピック指定なしのため' end as reason, {_TOP} as top from q, c""")
def check_matrix(spark, d):
    """For items of all nine formats, why each of the checks doesn't apply, and the highest level of their grammar."""
    n = F.col("rec_id")
    pick = lambda values, k: F.get(F.array(*map(F.lit, values)), (n % k).cast("int"))
    q = table(spark, d, "grammar_rewrite").select("rec_id", pick(items.FORMATS, 9).alias("format"), F.when(n % 2 == 0, "x").alias("context"), F.when(n % 3 == 0, "x").alias("topic"), pick(("A1", "A2", "B1", "B2"), 4).alias("level"))
    q = q.withColumn("check_id", F.explode(F.array(*map(F.lit, reviews.CHECK_FORMATS))))
    reason = reviews.not_applicable_reason(F.col("check_id"), F.col("format"), F.col("context"), F.col("topic"))
    return q.select("rec_id", "check_id", reason.alias("reason"), reviews.level_limit(F.col("format"), F.col("level")).alias("top"))
