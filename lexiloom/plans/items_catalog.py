"""Queries over the texts and checks of question items, format by format, with SQL written from the rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import items
from ..runtime import table
from .registry import Registry

_registry = Registry()
query, queries, oracle_sql = _registry.query, _registry.queries, _registry.oracle_sql

#: The formats that have a table of their own.
TABLES = ("vocab_mcq_en2ja", "vocab_flashcard_en2ja", "grammar_mcq", "grammar_rewrite", "grammar_example_selfcheck")
WORDS = {"A1": 10, "A2": 14, "B1": 20, "B2": 26}
EXPLANATIONS = {"brief": 20, "detailed": 60}
KEY = ["rec_id"]


def _each(spark, d, function, tables=TABLES) -> DataFrame:
    """The rows of a check of every table, with the table's format."""
    return reduce(DataFrame.unionByName, (function(table(spark, d, t), t).withColumn("format", F.lit(t)) for t in tables))


# each choice with its place
_PLACED = "(select rec_id, body, level, target, unnest(body.choices) as c, unnest(range(len(body.choices))) as i from {0})"
_ENGLISH = f"""
select 'vocab_mcq_en2ja' as format, rec_id, 'body.stem' as field, body.stem as text, true as sentence, true as target, level.value as lv from vocab_mcq_en2ja
union all select 'vocab_flashcard_en2ja', rec_id, 'body.example.en', body.example.en, true, true, level.value from vocab_flashcard_en2ja
union all select 'grammar_mcq', rec_id, 'body.sentence_with_blank#filled:answer', replace(body.sentence_with_blank, '____', list_filter(body.choices, lambda c: coalesce(c.is_correct, false))[1].text), true, false, level.value from grammar_mcq
union all select 'grammar_mcq', rec_id, 'body.sentence_with_blank#filled:choices[' || i || ']', replace(body.sentence_with_blank, '____', c.text), true, false, level.value from {_PLACED.format('grammar_mcq')} where not coalesce(c.is_correct, false)
union all select 'grammar_mcq', rec_id, 'body.context_sentence', body.context_sentence, true, false, level.value from grammar_mcq
union all select 'grammar_rewrite', rec_id, 'body.source_sentence', body.source_sentence, true, false, level.value from grammar_rewrite
union all select 'grammar_rewrite', rec_id, 'body.target_sentence_with_blank#filled:answer', replace(body.target_sentence_with_blank, '____', body.answer), true, false, level.value from grammar_rewrite
union all select 'grammar_example_selfcheck', rec_id, 'body.example.en', body.example.en, true, false, level.value from grammar_example_selfcheck
union all select 'grammar_example_selfcheck', rec_id, 'body.context_sentence', body.context_sentence, true, false, level.value from grammar_example_selfcheck"""


@query(f"select format, rec_id, field, text, sentence, target from ({_ENGLISH}) where text is not null")
def english_texts(spark, d):
    """The English texts of every question, by format."""
    return _each(spark, d, lambda q, t: items.english_texts(q, t, KEY)).drop("anchor")


_JAPANESE = f"""
select 'vocab_mcq_en2ja' as format, rec_id, 'body.stem_ja' as field, body.stem_ja as text from vocab_mcq_en2ja
union all select 'vocab_mcq_en2ja', rec_id, 'body.choices[' || i || '].text', c.text from {_PLACED.format('vocab_mcq_en2ja')}
union all select 'vocab_mcq_en2ja', rec_id, 'body.choices[' || i || '].gloss', c.gloss from {_PLACED.format('vocab_mcq_en2ja')}
union all select 'vocab_flashcard_en2ja', rec_id, 'body.gloss', body.gloss from vocab_flashcard_en2ja
union all select 'vocab_flashcard_en2ja', rec_id, 'body.example.ja', body.example.ja from vocab_flashcard_en2ja
union all select 'grammar_mcq', rec_id, 'body.example_ja', body.example_ja from grammar_mcq
union all select 'grammar_mcq', rec_id, 'explanation.text', explanation.text from grammar_mcq
union all select 'grammar_rewrite', rec_id, 'body.instruction', body.instruction from grammar_rewrite
union all select 'grammar_rewrite', rec_id, 'body.source_ja', body.source_ja from grammar_rewrite
union all select 'grammar_rewrite', rec_id, 'body.target_ja', body.target_ja from grammar_rewrite
union all select 'grammar_rewrite', rec_id, 'explanation.text', explanation.text from grammar_rewrite
union all select 'grammar_example_selfcheck', rec_id, 'body.example.ja', body.example.ja from grammar_example_selfcheck
union all select 'grammar_example_selfcheck', rec_id, 'explanation.text', explanation.text from grammar_example_selfcheck"""


@query(f"select format, rec_id, field, text from ({_JAPANESE}) where text is not null")
def japanese_texts(spark, d):
    """The members of every question that must be Japanese, by format."""
    return _each(spark, d, lambda q, t: items.japanese_texts(q, t, KEY))


_TOKENS = "regexp_extract_all(text, '[A-Za-z]+(?:[''’][A-Za-z]+)?|[0-9]+(?:[.,][0-9]+)*(?:st|nd|rd|th)?|[^\\sA-Za-z0-9]')"
_NONE = "null::varchar as evidence, null::varchar as expected, null::varchar as actual"
_BOUNDED = "case split_part({0}, '.', 1) when 'A1' then 10 when 'A2' then 14 when 'B1' then 20 when 'B2' then 26 end"
_EXPLAINED = "case explanation.type when 'brief' then 20 when 'detailed' then 60 end"


@query(f"""
with e as (select *, len(list_filter(regexp_split_to_array(text, '[.!?]+'), lambda x: regexp_matches(x, '[A-Za-z0-9]'))) as n_sentences, len(list_filter({_TOKENS}, lambda x: regexp_matches(x, '[A-Za-z0-9]'))) as n_words, {_BOUNDED.format('lv')} as most
  from ({_ENGLISH}) where text is not null)
select format, rec_id, 'V-SENT-01' as code, field as location, null::varchar as evidence, '1' as expected, n_sentences::varchar as actual from e where n_sentences <> 1
union all select format, rec_id, 'V-LEN-01', field, null, most::varchar, n_words::varchar from e where n_words > most
union all select format, rec_id, 'V-JPN-01', field, null, null, null from ({_JAPANESE}) where text is not null and not regexp_matches(text, '[\\x{{3040}}-\\x{{30ff}}\\x{{4e00}}-\\x{{9fff}}]')
{"".join(f'''union all select '{t}', rec_id, 'V-EXP-01', 'explanation.text', null, {_EXPLAINED}::varchar, length(nfc_normalize(explanation.text))::varchar from {t} where length(nfc_normalize(explanation.text)) > {_EXPLAINED}
''' for t in TABLES[2:])}
{"".join(f'''union all select '{t}', rec_id, 'V-SENT-01', 'body.context_sentence / body.context_required_by', null, null, null from {t} where (body.context_sentence is null) <> (body.context_required_by is null)
union all select '{t}', rec_id, 'V-SENT-01', 'body.context_required_by', body.context_required_by, null, null from {t} where body.context_required_by not in ('前文が肯定平叙', '前文が否定平叙')
''' for t in ('grammar_mcq', 'grammar_example_selfcheck'))}""")
def text_rules(spark, d):
    """V-SENT-01, V-LEN-01, V-JPN-01, V-EXP-01 over all texts of all questions."""
    return _each(spark, d, lambda q, t: items.text_problems(q, t, KEY, "level.value", WORDS, EXPLANATIONS))


@query("""
with s as (select rec_id, replace(body.target_sentence_with_blank, '____', case when rec_id % 3 = 0 then body.answer || '. Then' else body.answer end) as text from grammar_rewrite),
n as (select rec_id, len(list_filter(regexp_split_to_array(text, '[.!?]+'), lambda x: regexp_matches(x, '[A-Za-z0-9]'))) as n from s where text is not null)
select rec_id, 'V-CLZ-01' as code, 'body.sentence_with_blank#filled:answer' as location, null::varchar as evidence, null::varchar as expected, null::varchar as actual from n where n <> 1""")
def filled_cloze(spark, d):
    """V-CLZ-01 over the rewritten sentences, taken as cloze questions, a third with an answer that ends the sentence: filled in they are one sentence."""
    q = table(spark, d, "grammar_rewrite")
    no = F.lit(None).cast("string")
    body = F.struct(F.col("body.target_sentence_with_blank").alias("sentence_with_blank"), F.when(F.col("rec_id") % 3 == 0, F.concat("body.answer", F.lit(". Then"))).otherwise(F.col("body.answer")).alias("answer"), "body.answer_equivalents", no.alias("example_ja"), no.alias("context_sentence"), no.alias("context_required_by"))
    cloze = q.select("rec_id", "level", body.alias("body"), F.struct(no.alias("type"), no.alias("text")).alias("explanation"))
    return items.text_problems(cloze, "grammar_cloze", KEY, "level.value", WORDS, EXPLANATIONS).where("code = 'V-CLZ-01'")


@query("""
with first as (select set_id, arg_min(rec_id, rec_id) as r, count(distinct question_id) as n from grammar_rewrite group by 1),
c as (select f.set_id, q.format as f, q.level as l, f.n from first f join grammar_rewrite q on q.rec_id = f.r),
q as (select g.rec_id, g.format, g.level, regexp_extract(g.question_id, '^[a-z]+([0-9]+)$', 1)::int as no, c.f, c.l, least(2 * c.n, 20) as most from grammar_rewrite g join c using (set_id))
select rec_id, 'V-COND-01' as code, 'format' as location, null::varchar as evidence, f as expected, format as actual from q where format is distinct from f
union all select rec_id, 'V-COND-01', 'level', null, l.value, level.value from q where level.scale is distinct from l.scale or level.value is distinct from l.value
union all select rec_id, 'V-COND-01', 'question_id', null, most::varchar, no::varchar from q where no > most""")
def set_conditions(spark, d):
    """V-COND-01: questions against their set's conditions, here those of its first row and its number of questions."""
    q = table(spark, d, "grammar_rewrite")
    first = F.min_by(F.struct("format", "level"), "rec_id").alias("c")
    c = q.groupBy("set_id").agg(first, F.countDistinct("question_id").alias("requested_count"))
    c = c.select("set_id", F.col("c.format").alias("set_format"), F.col("c.level.scale").alias("set_scale"), F.col("c.level.value").alias("set_value"), "requested_count")
    return items.condition_problems(q, c, KEY, ["set_id"])


_THERE = "list_filter(body.choices, lambda c: c is not null)"


def _choices_sql(t: str, key: str) -> str:
    return f"""
select '{t}' as format, rec_id, 'V-CHO-01' as code, 'body.choices' as location, null::varchar as evidence, '4/1' as expected, n || '/' || ok as actual from (select rec_id, len({_THERE}) as n, len(list_filter({_THERE}, lambda x: coalesce(x.is_correct, false))) as ok from {t} where body.choices is not null) where n <> 4 or ok <> 1
union all select '{t}', rec_id, 'V-CHO-01', 'body.choices[*].text', null, null, null from (select rec_id, list_transform({_THERE}, lambda x: coalesce({key}, '\\0')) as k from {t} where body.choices is not null) where len(list_distinct(k)) <> len(k)"""


@query(_choices_sql("vocab_mcq_en2ja", "nfc_normalize(trim(x.text))") + " union all " + _choices_sql("grammar_mcq", "lower(trim(x.text))"))
def choice_rules(spark, d):
    """V-CHO-01, by Japanese keys and by English ones."""
    return _each(spark, d, lambda q, t: items.choice_problems(q, t, KEY), ("vocab_mcq_en2ja", "grammar_mcq"))


_ASKED = "split_part(q.level.value, '.', 1)"
_GROUP = "case {0} when 'noun' then 0 when 'number' then 0 when 'verb' then 1 when 'be-verb' then 1 when 'do-verb' then 1 when 'have-verb' then 1 when 'modal auxiliary' then 1 when 'adjective' then 2 when 'determiner' then 2 when 'adverb' then 3 when 'pronoun' then 4 when 'preposition' then 4 when 'conjunction' then 4 when 'interjection' then 4 when 'infinitive-to' then 4 end"


@query(f"""
with q as (select q.rec_id, q.body, q.target.ref as ref, {_ASKED} as asked, coalesce(q.body.pos_pool_relaxed, false) as relaxed,
  coalesce(l.pos, case when split_part(q.target.ref, ':', -1) = 'modal-auxiliary' then 'modal auxiliary' else split_part(q.target.ref, ':', -1) end) as tpos
  from vocab_mcq_en2ja q left join lexicon l on l.id = q.target.ref where q.body.choices is not null),
c as (select q.rec_id, q.asked, q.relaxed, q.tpos, unnest(q.body.choices) as c, unnest(range(len(q.body.choices))) as i from q),
a as (select c.*, c.c.anchor as a, not coalesce(c.c.is_correct, false) as wrong, l.id as e_id, l.headword as h, l.pos as p, l.level as v from c left join lexicon l on l.id = c.c.anchor.entry_id where c.c.anchor is not null),
u as (select distinct rec_id from a where wrong and relaxed and e_id is not null and a.pos = p and a.pos <> tpos),
w as (select rec_id, ref, list_transform(list_filter(body.choices, lambda x: x.anchor is not null), lambda x: coalesce(x.anchor.entry_id, '\\0')) as ids,
  list_transform(list_filter(body.choices, lambda x: x.anchor is not null and coalesce(x.is_correct, false)), lambda x: x.anchor.entry_id) as good,
  list_transform(list_filter(body.choices, lambda x: x.anchor is not null and not coalesce(x.is_correct, false)), lambda x: x.anchor.entry_id) as bad from q)
select rec_id, 'V-DIS-01' as code, 'body.choices[' || i || '].anchor' as location, a.entry_id as evidence, null::varchar as expected, null::varchar as actual from a
  where e_id is null or a.headword is distinct from h or a.pos is distinct from p or a.level is distinct from v
union all select rec_id, 'V-DIS-02', 'body.choices[' || i || '].anchor', a.entry_id, asked, a.level from a where wrong and (a.level is distinct from asked
  or not case when relaxed then coalesce({_GROUP.format('a.pos')} = {_GROUP.format('tpos')}, false) else a.pos is not distinct from tpos end)
union all select rec_id, 'V-DIS-02', 'body.pos_pool_relaxed', null, null, null from q where relaxed and rec_id not in (select rec_id from u)
union all select rec_id, 'V-DIS-03', 'body.choices[*].anchor.entry_id', array_to_string(list_filter(ids, lambda x: x <> '\\0'), ','), null, null from w
  where len(list_distinct(ids)) <> len(ids) or good is distinct from [ref] or len(list_filter(bad, lambda x: x is not distinct from ref)) > 0""")
def distractor_rules(spark, d):
    """V-DIS-01, V-DIS-02 and V-DIS-03 of choices' anchors."""
    return items.anchor_problems(table(spark, d, "vocab_mcq_en2ja"), "vocab_mcq_en2ja", KEY, table(spark, d, "lexicon"), "level.value")


def _once_sql(t: str, text: str) -> str:
    return f"""select '{t}' as format, rec_id, 'V-TGT-02' as code, 'body.target_surface#once' as location, s as evidence, null::varchar as expected, null::varchar as actual
from (select rec_id, body.target_surface as s, {text} as t from {t}) where not (s <> '' and instr(t, s) > 0 and instr(substr(t, instr(t, s) + 1), s) = 0)"""


def _level_sql(t: str) -> str:
    return f"""select '{t}' as format, q.rec_id, 'V-TGT-03' as code, 'target.ref' as location, q.target.ref as evidence, {_ASKED} as expected, l.level as actual from {t} q left join lexicon l on l.id = q.target.ref
where l.id is null or l.level is distinct from {_ASKED}"""


_VOCABULARY = {"vocab_mcq_en2ja": "body.stem", "vocab_flashcard_en2ja": "body.example.en"}


@query(" union all ".join([_once_sql(t, x) for t, x in _VOCABULARY.items()] + [_level_sql(t) for t in _VOCABULARY]))
def target_rules(spark, d):
    """V-TGT-03, and the part of V-TGT-02 that needs no tokens: where target_surface begins."""
    found = _each(spark, d, lambda q, t: items.target_problems(q, t, KEY, table(spark, d, "lexicon"), "level.value"), tuple(_VOCABULARY))
    return found.where("code = 'V-TGT-03' or location like '%#once'")


_TOKENS_OF = _TOKENS.replace("(text,", "({0},").replace("{1,", "{{1,")
_FIXED = "case {0} when 'gon' then 'go' when 'na' then 'to' when 'ca' then 'can' when 'wo' then 'will' when 'sha' then 'shall' else {0} end"


@query(f"""
with recursive b as (select 'vocab_mcq_en2ja' as format, rec_id, target.ref as ref, body.target_surface as surface, body.stem as x from vocab_mcq_en2ja union all select 'vocab_flashcard_en2ja', rec_id, target.ref, body.target_surface, body.example.en from vocab_flashcard_en2ja),
l as (select *, list_transform(s, lambda y: lower(y)) as w, list_transform(s, lambda y: {_FIXED.format('lower(y)')}) as f from (select format, rec_id, ref, {_TOKENS_OF.format('x')} as s from b where x is not null)),
p as (select id, is_multiword, list_transform({_TOKENS_OF.format('headword')}, lambda y: lower(y)) as k from lexicon),
t as (select format, rec_id, unnest(w) as word, unnest(range(len(w))) as start from l),
h as (select format, rec_id, start, len(k) as size, kind, id from (
  select t.format, t.rec_id, t.start, p.k, 2 as kind, p.id from t join p on p.is_multiword and p.k[1] = t.word join l on l.format = t.format and l.rec_id = t.rec_id and list_slice(l.w, t.start + 1, t.start + len(p.k)) = p.k
  union all select l.format, l.rec_id, t.start, p.k, 1, p.id from l join p on p.id = l.ref join t on t.format = l.format and t.rec_id = l.rec_id and (list_slice(l.w, t.start + 1, t.start + len(p.k)) = p.k or list_slice(l.f, t.start + 1, t.start + len(p.k)) = p.k))
  qualify row_number() over (partition by format, rec_id, start order by len(k) desc, kind, id) = 1),
nx as materialized (select h.format, h.rec_id, h.start, n.start as next from h asof join h n on h.format = n.format and h.rec_id = n.rec_id and h.start + h.size <= n.start),
g as (select format, rec_id, min(start) as start from h group by 1, 2 union all select g.format, g.rec_id, nx.next from g join nx on nx.format = g.format and nx.rec_id = g.rec_id and nx.start = g.start),
m as (select h.format, h.rec_id, count(*) as n, list(array_to_string(list_slice(l.s, h.start + 1, h.start + h.size), ' ')) as written from h join g using (format, rec_id, start) join l on l.format = h.format and l.rec_id = h.rec_id where h.kind = 1 group by 1, 2),
e as (select b.*, coalesce(m.n, 0) as n, m.written from b left join m using (format, rec_id))
select format, rec_id, 'V-TGT-02' as code, 'target.ref' as location, ref as evidence, '1' as expected, n::varchar as actual from e where n <> 1
union all select format, rec_id, 'V-TGT-02', 'body.target_surface', surface, null, null from e where not coalesce(list_contains(written, array_to_string({_TOKENS_OF.format('surface')}, ' ')), false)""")
def target_occurrences(spark, d):
    """V-TGT-02 by tokens: how often the target matches, and whether target_surface is a match."""
    found = _each(spark, d, lambda q, t: items.target_problems(q, t, KEY, table(spark, d, "lexicon"), "level.value"), tuple(_VOCABULARY))
    return found.where("code = 'V-TGT-02' and location not like '%#once'")


_SENTENCE = "trim(regexp_replace(lower(nfc_normalize({0})), '[\\s\\x{{a0}}\\x{{2009}}\\x{{202f}}\\x{{3000}}]+', ' ', 'g'))"


@query(f"""
with r as (select rec_id, body.answer as answer, body.source_sentence as source, case when rec_id % 4 = 0 then '  ' || upper(replace(body.source_sentence, ' ', '  ')) else replace(body.target_sentence_with_blank, '____', body.answer) end as filled,
  case when rec_id % 5 = 0 then list_append(body.answer_equivalents, ' ' || upper(body.answer) || ' ') when rec_id % 5 = 1 then list_concat(body.answer_equivalents, ['it', 'IT ']) else body.answer_equivalents end as others from grammar_rewrite),
k as (select rec_id, lower(trim(answer)) as a, list_transform(others, lambda x: lower(trim(x))) as e from r)
select rec_id, 'V-CLZ-02' as code, 'body.answer_equivalents' as location, {_NONE} from k where list_contains(e, a) or len(list_distinct(e)) <> len(e)
union all select rec_id, 'V-RWT-01', 'body.source_sentence / body.target_sentence_with_blank#filled:answer', null, null, null from r where {_SENTENCE.format('source')} = {_SENTENCE.format('filled')}""")
def form_rules(spark, d):
    """V-CLZ-02 and V-RWT-01, of which some rows are given what breaks them: an equivalent that is the answer or another one, a target that is the source."""
    q, n = table(spark, d, "grammar_rewrite"), F.col("rec_id")
    others = F.col("body.answer_equivalents")
    planted = F.when(n % 5 == 0, F.array_append(others, F.concat(F.lit(" "), F.upper("body.answer"), F.lit(" ")))).when(n % 5 == 1, F.concat(others, F.array(F.lit("it"), F.lit("IT ")))).otherwise(others)
    target = F.when(n % 4 == 0, F.concat(F.lit("  "), F.upper(F.replace("body.source_sentence", F.lit(" "), F.lit("  "))))).otherwise(F.col("body.target_sentence_with_blank"))
    body = F.col("body").withField("answer_equivalents", planted).withField("target_sentence_with_blank", target)
    return items.form_problems(q.withColumn("body", body), "grammar_rewrite", KEY)


_ANSWER = "list_filter(string_split_regex(lower(translate(nfc_normalize({}), '’.,?!;:', '''')), '[ \\t]+'), lambda x: x <> '')"


@query(f"""
with s as (select rec_id, {_ANSWER.format('body.source_sentence')} as t from grammar_rewrite where body.source_sentence is not null),
o as (select rec_id, t, case rec_id % 3 when 0 then t when 1 then list_reverse(t) else list_append(t, 'not') end as w from s)
select rec_id, 'V-ORD-01' as code, 'body.tokens_shuffled' as location, {_NONE} from o where list_sort(t) <> list_sort(w)
union all select rec_id, 'V-ORD-02', 'body.tokens_shuffled', null, null, null from o where t = w""")
def order_rules(spark, d):
    """V-ORD-01 and V-ORD-02 over source sentences taken as words to be put in order: as they stand, reversed, or with a word too many."""
    from ..functions import text

    q = table(spark, d, "grammar_rewrite").where("body.source_sentence is not null").select("rec_id", F.col("body.source_sentence").alias("s"))
    own = text.answer_tokens("s")
    shuffled = F.when(F.col("rec_id") % 3 == 0, own).when(F.col("rec_id") % 3 == 1, F.reverse(own)).otherwise(F.array_append(own, F.lit("not")))
    return items.form_problems(q.select("rec_id", F.struct(F.col("s").alias("answer_sentence"), shuffled.alias("tokens_shuffled")).alias("body")), "grammar_reorder", KEY)


@query("select rec_id, i as place, answers[i] as answer from (select rec_id, list_concat([body.answer], coalesce(body.answer_equivalents, [])) as answers, unnest(range(1, 2 + coalesce(len(body.answer_equivalents), 0))) as i from grammar_rewrite)")
def answer_lists(spark, d):
    """Each rewrite question's accepted answers in order."""
    own = F.posexplode(items.answer_list("body.answer", "body.answer_equivalents")).alias("place", "answer")
    return table(spark, d, "grammar_rewrite").select("rec_id", own).withColumn("place", (F.col("place") + 1).cast("long"))
