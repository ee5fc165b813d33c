"""All queries over the reference's own operators, with their SQL. Each runs over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import jsontext, levels, text
from ..operators import attempts, checks, contract, lookup, matching, reference, tokens, versions
from ..runtime import table
from ..streaming import deliveries

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}

WORD_LIMITS = {"A1": 10, "A2": 14, "B1": 18, "B2": 22}
EXPLANATION_LIMITS = {"brief": 40, "detailed": 120}
LEVEL_COUNTS = {"A1": 150, "A2": 362, "B1": 345, "B2": 300}
ALLOWED = ["T", "X", "DVD", "IT", "PC", "ATM"]
_KEY = ["set_id", "question_id", "generation"]
_QUESTION = ["set_id", "question_id"]


def query(sql: str | None = None):
    def register(function):
        _QUERIES[function.__name__] = function
        if sql:
            _SQL[function.__name__] = sql
        return function

    return register


# --- look-ups ---------------------------------------------------------------------------------------------------------------


@query("""
with f as (select * from lexicon where pos = 'noun' and level = 'A2'
  and ('Notions' in (core_inventory_1, core_inventory_2, threshold) or coalesce(core_inventory_1 = 'Notions', false) or coalesce(core_inventory_2 = 'Notions', false) or coalesce(threshold = 'Notions', false)))
select id, headword, (select count(*) from f) as total from f order by lower(headword), headword, pos, id limit 20""")
def lookup_filter_and(spark, d):
    found = lookup.filtered(table(spark, d, "lexicon"), pos="noun", level="A2", category="Notions")
    return lookup.page(found, lookup.in_order(found), 20).select("id", "headword", "total")


@query("""
with direct as (select * from lexicon where lower(headword) = 'clock'),
g as (select distinct unnest(group_ids) as g from direct),
m as (select distinct id from (select id, unnest(group_ids) as g from lexicon) join g using (g))
select id from direct union select id from m""")
def lookup_group_expand(spark, d):
    return lookup.expanded(table(spark, d, "lexicon"), "Clock")


@query("""
select target_id, id, priority, rank from (
  select t.id as target_id, e.id, case when t.core_inventory_1 = e.core_inventory_1 then 0 when t.threshold = e.threshold then 1 when t.core_inventory_2 = e.core_inventory_2 then 2 else 3 end as priority,
    row_number() over (partition by t.id order by case when t.core_inventory_1 = e.core_inventory_1 then 0 when t.threshold = e.threshold then 1 when t.core_inventory_2 = e.core_inventory_2 then 2 else 3 end,
      lower(e.headword), e.headword, e.pos, e.id) as rank
  from lexicon t join lexicon e on t.level = e.level and t.pos = e.pos and t.id <> e.id) where rank <= 5""")
def pool_ranked(spark, d):
    entries = table(spark, d, "lexicon")
    return lookup.pools(entries, entries, 5)


@query("""
with g as (select *, case when pos in ('noun','number') then 0 when pos in ('verb','be-verb','do-verb','have-verb','modal auxiliary') then 1 when pos in ('adjective','determiner') then 2
  when pos = 'adverb' then 3 when pos in ('pronoun','preposition','conjunction','interjection','infinitive-to') then 4 end as grp from lexicon),
s as (select t.id as target_id, e.id, 0 as relaxed, e.headword, e.pos from g t join g e on t.level = e.level and t.pos = e.pos and t.id <> e.id),
few as (select * from g t where (select count(*) from s where s.target_id = t.id) < 20),
w as (select t.id as target_id, e.id, 1 as relaxed, e.headword, e.pos from few t join g e on t.level = e.level and t.grp = e.grp and t.pos <> e.pos and t.id <> e.id),
r as (select *, row_number() over (partition by target_id order by relaxed, lower(headword), headword, pos, id) as rank from (select * from s union all select * from w))
select target_id, id, relaxed, rank from r where rank <= 3""")
def pool_relaxed(spark, d):
    entries = table(spark, d, "lexicon")
    return lookup.relaxed_pools(entries, entries, 3, least=20)


@query("""
with r as (select rec_id as n, target.display_name as typed, split_part(level.value, '.', 1) as level from vocab_mcq_en2ja where target.display_name is not null and level.value is not null),
j as (select r.n, r.typed, count(e.id) as n_any, count(e.id) filter (where e.level = r.level) as n_fit, min(e.id) filter (where e.level = r.level) as only_id
  from r left join lexicon e on lower(e.headword) = lower(r.typed) group by all)
select n, typed, case when n_fit = 1 then 'match' when n_fit > 1 then 'ambiguous_pos' when n_any > 0 then 'level_mismatch' else 'not_in_dictionary' end as status,
  case when n_fit = 1 then only_id end as entry_id from j""")
def resolve_targets(spark, d):
    q = table(spark, d, "vocab_mcq_en2ja")
    requests = q.select(F.col("rec_id").alias("n"), F.col("target.display_name").alias("typed"), levels.band("level.value").alias("level"), F.lit(None).cast("string").alias("pos"))
    return lookup.resolve(requests.where("typed is not null and level is not null"), table(spark, d, "lexicon"))


@query("""select rec_id, set_id, target.ref as ref from vocab_flashcard_en2ja where target.ref is not null
qualify row_number() over (partition by set_id, target.ref order by rec_id) = 1""")
def requested_once(spark, d):
    q = table(spark, d, "vocab_flashcard_en2ja").select("rec_id", "set_id", F.col("target.ref").alias("ref")).where("ref is not null")
    return lookup.first_of_each(q, "ref", "rec_id", ["set_id"])


@query("""select id, headword from lexicon where id not in (select target.ref from vocab_mcq_en2ja where target.ref is not null union all select target.ref from vocab_flashcard_en2ja where target.ref is not null)""")
def replacement_pool(spark, d):
    shown = table(spark, d, "vocab_mcq_en2ja").select("target.ref").union(table(spark, d, "vocab_flashcard_en2ja").select("target.ref")).withColumnRenamed("ref", "id").where("id is not null")
    return lookup.replacements(table(spark, d, "lexicon"), shown, "id").select("id", "headword")


_RANK = "list_position(['A1.1','A1.2','A1.3','A2.1','A2.2','B1.1','B1.2','B2.1','B2.2'], {})"


@query(f"""
select q.rec_id, count(*) as n_items from grammar_rewrite q join grammar g on g.target_eligible
  and {_RANK.format('q.level.value')} between {_RANK.format('g.level.min')} and {_RANK.format('g.level.max')} group by 1""")
def range_contains(spark, d):
    q = table(spark, d, "grammar_rewrite").select("rec_id", levels.fine_rank("level.value").alias("rank")).where("rank is not null")
    g = table(spark, d, "grammar").where("target_eligible").select("id", levels.fine_rank("level.min").alias("low"), levels.fine_rank("level.max").alias("high")).where("low is not null and high is not null")
    return lookup.containing(q, "rank", g, "low", "high").groupBy("rec_id").agg(F.count(F.lit(1)).alias("n_items"))


@query(f"""
select id, display_name from grammar where target_eligible and {_RANK.format("'A2.2'")} between {_RANK.format('level.min')} and {_RANK.format('level.max')}
  and (coalesce(contains(lower(item_list.name_ja), '受動態'), false) or coalesce(contains(lower(kyoinban.name_simple_ja), '受動態'), false)) and not coalesce(item_list.sentence_type_ja in ('否定平叙文', '肯定疑問文'), false)""")
def keyword_nullsafe_exclude(spark, d):
    found = lookup.grammar_at(table(spark, d, "grammar"), "A2.2", keyword="受動態", exclude=["否定平叙文", "肯定疑問文"], column="item_list.sentence_type_ja")
    return found.select("id", "display_name")


# --- building the reference tables ------------------------------------------------------------------------------------------


@query("""
with t as (select id, kyoinban.level_raw as raw from grammar where level.source = 'kyoinban_direct'),
j as (select g.id, g.parent_id, o.raw as own, p.raw as above from grammar g left join t o on o.id = g.id left join t p on p.id = g.parent_id)
select id, split_part(coalesce(own, above), '-', 1) as level_min, split_part(coalesce(own, above), '-', -1) as level_max,
  case when own is not null then 'kyoinban_direct' when above is not null then 'kyoinban_inherited' end as source, case when own is null and above is not null then parent_id end as inherited_from from j""")
def inherit_level(spark, d):
    g = table(spark, d, "grammar")
    return reference.inherited(g, g.where("level.source = 'kyoinban_direct'").select("id", F.col("kyoinban.level_raw").alias("level_raw")))


@query("""
with w as (select id as joined_id, headword, pos, unnest(range(0, len(string_split(headword, ' ')))) as position, string_split(headword, ' ') as parts from lexicon where is_multiword and not contains(headword, '-'))
select w.headword as headword_joined, w.pos, w.position::int as position, w.parts[w.position + 1] as variant, min(e.id) as entry_id, count(e.id) as n_entries, min(e.level) as level
from w left join lexicon e on e.headword = w.parts[w.position + 1] and e.pos = w.pos group by all""")
def variant_split_fk(spark, d):
    entries = table(spark, d, "lexicon")
    joined = entries.where("is_multiword and not contains(headword, '-')").select(F.replace("headword", F.lit(" "), F.lit("/")).alias("headword_joined"), "pos")
    return reference.variant_groups(joined, entries).withColumn("headword_joined", F.replace("headword_joined", F.lit("/"), F.lit(" ")))


@query("""
with m as (select unnest(group_ids) as group_id, id, pos, level from lexicon)
select group_id, 1 as kind_order, 'too_few' as kind from m group by 1 having count(*) < 2
union all select group_id, 4, 'mixed_pos' from m group by 1 having count(distinct pos) > 1
union all select group_id, 5, 'mixed_level' from m group by 1 having count(distinct level) > 1""")
def group_integrity(spark, d):
    m = table(spark, d, "lexicon").select(F.explode("group_ids").alias("group_id"), F.col("id").alias("entry_id"), F.col("pos").alias("entry_pos"), F.col("level").alias("entry_level"))
    place = attempts.W.partitionBy("group_id").orderBy("entry_id")
    return reference.group_problems(m.withColumn("position", F.row_number().over(place) - 1))


@query("select rec_id, target.ref as ref from grammar_mcq where target.ref is not null and target.ref not in (select id from grammar)")
def orphans_anti(spark, d):
    q = table(spark, d, "grammar_mcq").select("rec_id", F.col("target.ref").alias("ref"))
    return reference.orphans(q, "ref", table(spark, d, "grammar"), "id")


@query("select set_id, question_id, generation, count(*) as n, min(rec_id) as first_at from grammar_mcq group by 1, 2, 3 having count(*) > 1")
def duplicates_having(spark, d):
    return reference.duplicates(table(spark, d, "grammar_mcq"), _KEY, "rec_id")


@query("""
with w(value, n_expected) as (values ('A1', 150), ('A2', 362), ('B1', 345), ('B2', 300)), h as (select level as value, count(*) as n_actual from lexicon group by 1)
select coalesce(w.value, h.value) as value, coalesce(n_expected, 0)::bigint as n_expected, coalesce(n_actual, 0) as n_actual from w full join h on w.value is not distinct from h.value
where coalesce(n_expected, 0) <> coalesce(n_actual, 0)""")
def invariant_histogram(spark, d):
    return reference.histogram_problems(table(spark, d, "lexicon"), "level", LEVEL_COUNTS)


@query("""
select name, wanted::bigint as wanted, actual from (
  select unnest(['n_entries', 'n_headwords', 'n_multiword', 'n_ranges']) as name, unnest([1174, 1200, 1, 0]) as wanted,
    unnest([(select count(*) from lexicon), (select count(distinct (headword, pos)) from lexicon), (select count(*) from lexicon where is_multiword), (select count(*) from grammar where contains(kyoinban.level_raw, '-'))]) as actual)
where wanted is distinct from actual""")
def expectations(spark, d):
    e = table(spark, d, "lexicon").agg(F.count(F.lit(1)).alias("n_entries"), F.countDistinct(F.struct("headword", "pos")).alias("n_headwords"), F.count_if("is_multiword").alias("n_multiword"))
    g = table(spark, d, "grammar").agg(F.count_if(F.contains("kyoinban.level_raw", F.lit("-"))).alias("n_ranges"))
    return reference.expectation_problems(e, {"n_entries": 1174, "n_headwords": 1200, "n_multiword": 1}).unionByName(reference.expectation_problems(g, {"n_ranges": 0}))


@query("""
select rec_id as key, 'format' as column_name, 'null' as kind, format as value from grammar_mcq where format is null
union all select rec_id, 'format', 'spelling', format from grammar_mcq where format is not null and format not in ('grammar_mcq', 'grammar_cloze', 'grammar_reorder')
union all select rec_id, 'level_value', 'range', level.value from grammar_mcq where level.value is not null and not regexp_full_match(level.value, 'A1\\.[123]|(A2|B1|B2)\\.[12]')
union all select rec_id, 'ref', 'pattern', target.ref from grammar_mcq where target.ref is not null and not regexp_full_match(target.ref, 'gp:[0-9]+(-[0-9]+)?')""")
def cell_problems(spark, d):
    q = table(spark, d, "grammar_mcq").select("rec_id", "format", F.col("level.value").alias("level_value"), F.col("target.ref").alias("ref"))
    rules = {
        "format": {"null": F.col("format").isNull(), "spelling": ~F.col("format").isin("grammar_mcq", "grammar_cloze", "grammar_reorder")},
        "level_value": {"range": F.col("level_value").isNotNull() & levels.fine_rank("level_value").isNull()},
        "ref": {"pattern": ~F.col("ref").rlike("^gp:[0-9]+(-[0-9]+)?\\z")},
    }
    return reference.cell_problems(q, "rec_id", rules)


@query("select target.ref as ref, rec_id, min(rec_id) over (partition by target.ref) as first_at from grammar_rewrite where target.ref is not null")
def first_occurrence(spark, d):
    q = table(spark, d, "grammar_rewrite").select(F.col("target.ref").alias("ref"), "rec_id").where("ref is not null")
    return reference.first_of_group(q, "ref", "rec_id")


# --- versions and sets ------------------------------------------------------------------------------------------------------


@query("""
with a as (select a.entry_id as id, min(a.headword) as headword, min(a.level) as level from (select unnest(body.choices) as c from vocab_mcq_en2ja) t, lateral (select t.c.anchor as a) where a.entry_id is not null group by 1)
select coalesce(a.id, l.id) as id, case when l.id is null then 'added' when a.id is null then 'removed' else 'changed' end as bucket from lexicon l full join a on a.id = l.id
where l.id is null or a.id is null or l.headword is distinct from a.headword or l.level is distinct from a.level""")
def version_diff(spark, d):
    a = table(spark, d, "vocab_mcq_en2ja").select(F.explode("body.choices").alias("c")).select("c.anchor.*").where("entry_id is not null")
    recorded = a.groupBy(F.col("entry_id").alias("id")).agg(F.min("headword").alias("headword"), F.min("level").alias("level"))
    return versions.changes(table(spark, d, "lexicon"), recorded, "id", ["headword", "level"])


@query("""
with l as (select distinct target.ref as ref from grammar_mcq where target.ref is not null), r as (select distinct target.ref as ref from grammar_rewrite where target.ref is not null)
select ref, 'left' as side from l where ref not in (select ref from r) union all select ref, 'right' from r where ref not in (select ref from l)""")
def set_differences(spark, d):
    one = lambda t: table(spark, d, t).select(F.col("target.ref").alias("ref")).where("ref is not null")
    return versions.both_ways(one("grammar_mcq"), one("grammar_rewrite"), "ref")


@query("""
select ref from (select distinct target.ref as ref from grammar_mcq intersect select distinct target.ref from grammar_rewrite) where ref is not null""")
def set_intersection(spark, d):
    one = lambda t: table(spark, d, t).select(F.col("target.ref").alias("ref")).where("ref is not null")
    return versions.in_both(one("grammar_mcq"), one("grammar_rewrite"), "ref")


@query("select doc_id, sha256(text) as sha from documents where text is not null")
def checksum(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", jsontext.digest("text").alias("sha"))


# --- reuse ------------------------------------------------------------------------------------------------------------------

_SENTENCE = "trim(regexp_replace(lower(nfc_normalize({0})), '[\\s\\x{{a0}}\\x{{2009}}\\x{{202f}}\\x{{3000}}]+', ' ', 'g'))"


@query(f"""
with s as (select set_id, {_SENTENCE.format('body.example.en')} as sentence, body.example.en as raw from vocab_flashcard_en2ja where body.example.en is not null)
select sentence, count(distinct set_id) as n, min(raw) as example from s group by 1 having count(distinct set_id) > 1""")
def sentence_key_reuse(spark, d):
    q = table(spark, d, "vocab_flashcard_en2ja").where("body.example.en is not null").select("set_id", F.col("body.example.en").alias("raw")).withColumn("sentence", text.sentence_key("raw"))
    return q.groupBy("sentence").agg(F.countDistinct("set_id").alias("n"), F.min("raw").alias("example")).where("n > 1")


@query("""
select set_id, target.ref as ref, count(distinct question_id) as n, string_agg(distinct question_id, ',' order by question_id) as members from grammar_mcq where target.ref is not null group by 1, 2 having count(distinct question_id) > 1""")
def target_reuse(spark, d):
    q = table(spark, d, "grammar_mcq").select("set_id", "question_id", F.col("target.ref").alias("ref"))
    return checks.reuse(q, ["set_id"], "ref", "question_id")


@query("""
with a as (select set_id, question_id, c.anchor.entry_id as anchor from (select set_id, question_id, unnest(body.choices) as c from vocab_mcq_en2ja))
select set_id, anchor, count(distinct question_id) as n, string_agg(distinct question_id, ',' order by question_id) as members from a where anchor is not null group by 1, 2 having count(distinct question_id) > 1""")
def anchor_reuse_over_max(spark, d):
    q = table(spark, d, "vocab_mcq_en2ja").select("set_id", "question_id", F.explode("body.choices").alias("c")).select("set_id", "question_id", F.col("c.anchor.entry_id").alias("anchor"))
    return checks.reuse(q, ["set_id"], "anchor", "question_id", most=1)


# --- attempts ---------------------------------------------------------------------------------------------------------------

_GEN = "regexp_extract(generation, '^[a-z]+([0-9]+)$', 1)::int"


@query(f"""select set_id, question_id, generation, rec_id from grammar_mcq where provenance.review_ref is not null
qualify row_number() over (partition by set_id, question_id order by {_GEN} desc, rec_id) = 1""")
def latest_accepted(spark, d):
    q = table(spark, d, "grammar_mcq")
    return attempts.latest(q, _QUESTION, "generation", F.col("provenance.review_ref").isNotNull()).select(*_KEY, "rec_id")


@query(f"""
with t as (select *, 0 as p from grammar_mcq where provenance.machine_report_ref is not null and question_id = 'q01' qualify row_number() over (partition by set_id, question_id order by {_GEN} desc, rec_id) = 1),
a as (select *, 1 as p from grammar_mcq where provenance.review_ref is not null qualify row_number() over (partition by set_id, question_id order by {_GEN} desc, rec_id) = 1)
select set_id, question_id, generation, rec_id from (select * from t union all select * from a) qualify row_number() over (partition by set_id, question_id order by p) = 1""")
def latest_with_override(spark, d):
    q = table(spark, d, "grammar_mcq")
    found = attempts.latest_with_override(q, _QUESTION, "generation", F.col("provenance.review_ref").isNotNull(), F.col("provenance.machine_report_ref").isNotNull(), F.col("question_id") == "q01")
    return found.select(*_KEY, "rec_id")


@query("""select set_id, question_id, generation, rec_id from grammar_rewrite qualify row_number() over (partition by set_id, question_id, generation order by ingested_at desc nulls last, rec_id desc) = 1""")
def last_delivery(spark, d):
    return attempts.last_delivery(table(spark, d, "grammar_rewrite"), _KEY).select(*_KEY, "rec_id")


@query(f"""
select set_id, question_id, count(distinct g) as n, max(g) as last from (select set_id, question_id, {_GEN} as g from grammar_mcq) group by 1, 2 having min(g) <> 1 or max(g) <> count(distinct g)""")
def generation_gaps(spark, d):
    return attempts.gaps(table(spark, d, "grammar_mcq"), _QUESTION, "generation")


@query(f"""
with g as (select set_id, question_id, {_GEN} as g, bool_or(provenance.review_ref is not null) as ok from grammar_mcq group by all),
w as (select *, lead(g) over (partition by set_id, question_id order by g) is null as is_last from g)
select set_id, question_id, count(*) as n_generations, bool_or(is_last and ok) and bool_and(is_last or not ok) as sound from w group by 1, 2""")
def terminal_status(spark, d):
    return attempts.terminal(table(spark, d, "grammar_mcq"), _QUESTION, "generation", F.col("provenance.review_ref").isNotNull())


@query("""
with p as (select set_id, question_id, generation, unnest([provenance.candidate_ref, provenance.machine_report_ref, provenance.review_ref]) as ref from vocab_mcq_en2ja),
c as (select set_id, regexp_extract(ref, '(q[0-9]{2})\\.(gen[1-3])\\.(candidate|machine|request|review)\\.json$', 1) as question_id, regexp_extract(ref, '(q[0-9]{2})\\.(gen[1-3])\\.(candidate|machine|request|review)\\.json$', 2) as generation,
  regexp_extract(ref, '(q[0-9]{2})\\.(gen[1-3])\\.(candidate|machine|request|review)\\.json$', 3) as part, ref from p where ref is not null)
select set_id, question_id, generation, max(ref) filter (where part = 'candidate') as candidate, max(ref) filter (where part = 'machine') as machine, max(ref) filter (where part = 'review') as review,
  count(distinct part) filter (where part in ('candidate', 'machine', 'review')) = 3 as complete from c where part <> '' group by 1, 2, 3""")
def audit_parts_pivot(spark, d):
    q = table(spark, d, "vocab_mcq_en2ja").where("provenance is not null")
    refs = q.select("set_id", F.explode(F.array("provenance.candidate_ref", "provenance.machine_report_ref", "provenance.review_ref")).alias("ref"))
    named = attempts.classified(refs.withColumn("name", F.substring_index("ref", "/", -1))).where("kind = 'part'")
    return attempts.assembled(named, _KEY, "part", "ref", ["candidate", "machine", "review"])


@query("""
select set_id, question_id, generation, unnest(list_filter([case when provenance.generation is distinct from generation then 'generation' end], lambda x: x is not null)) as column_name from vocab_flashcard_en2ja where provenance is not null""")
def cross_document(spark, d):
    q = table(spark, d, "vocab_flashcard_en2ja").where("provenance is not null")
    key = ["rec_id", *_KEY]
    left, right = q.select(*key, F.struct("generation").alias("doc")), q.select(*key, F.struct("provenance.generation").alias("doc"))
    return attempts.unequal(left, right, key, ["doc.generation"]).select(*_KEY, "column_name")


# --- item checks ------------------------------------------------------------------------------------------------------------


@query("""
with s as (select rec_id, len(list_filter(regexp_extract_all(body.source_sentence, '[A-Za-z]+(?:[''’][A-Za-z]+)?|[0-9]+(?:[.,][0-9]+)*(?:st|nd|rd|th)?|[^\\sA-Za-z0-9]'), lambda x: regexp_matches(x, '[A-Za-z0-9]'))) as n,
  case split_part(level.value, '.', 1) when 'A1' then 10 when 'A2' then 14 when 'B1' then 18 when 'B2' then 22 end as most from grammar_rewrite)
select rec_id, 'too_many_words' as code, 'source_sentence' as location, null::varchar as evidence, most::varchar as expected, n::varchar as actual from s where n > most""")
def word_limit(spark, d):
    q = table(spark, d, "grammar_rewrite").select("rec_id", F.col("level.value").alias("level"), F.col("body.source_sentence").alias("source_sentence"))
    return checks.apply(q, [checks.word_limit("source_sentence", "source_sentence", "level", WORD_LIMITS)])


@query("""
select rec_id, 'too_long' as code, 'explanation' as location, null::varchar as evidence, most::varchar as expected, n::varchar as actual
from (select rec_id, length(explanation.text) as n, case explanation.type when 'brief' then 40 when 'detailed' then 120 end as most from grammar_mcq) where n > most""")
def explanation_limit(spark, d):
    q = table(spark, d, "grammar_mcq").select("rec_id", F.col("explanation.type").alias("kind"), F.col("explanation.text").alias("explanation"))
    return checks.apply(q, [checks.length_limit("explanation", "explanation", "kind", EXPLANATION_LIMITS)])


@query("""select doc_id, coalesce(regexp_matches(text, '[\\x{3040}-\\x{30ff}\\x{4e00}-\\x{9fff}]'), false) as japanese from documents""")
def script_check(spark, d):
    return table(spark, d, "documents").select("doc_id", text.has_japanese("text").alias("japanese"))


@query("""
select rec_id, 'half_pair' as code, 'context' as location, null::varchar as evidence, null::varchar as expected, null::varchar as actual from grammar_example_selfcheck where (body.context_sentence is null) <> (body.context_required_by is null)
union all select rec_id, 'sentence_count', 'example', null, '1', n::varchar from (select rec_id, len(list_filter(regexp_split_to_array(body.example.en, '[.!?]+'), lambda x: regexp_matches(x, '[A-Za-z0-9]'))) as n from grammar_example_selfcheck) where n <> 1""")
def sentence_structure(spark, d):
    q = table(spark, d, "grammar_example_selfcheck").select("rec_id", F.col("body.context_sentence").alias("a"), F.col("body.context_required_by").alias("b"), F.col("body.example.en").alias("en"))
    return checks.apply(q, [checks.paired("a", "b", "context"), checks.one_sentence("en", "example")])


_CHOICES = "list_filter(body.choices, lambda c: c is not null)"


@query(f"""
with q as (select rec_id, {_CHOICES} as c from grammar_mcq), m as (select rec_id, len(c) as n, len(list_filter(c, lambda x: coalesce(x.is_correct, false))) as ok, list_transform(c, lambda x: lower(trim(x.text))) as k from q where c is not null)
select rec_id, 'choice_count' as code, 'choices' as location, null::varchar as evidence, '4' as expected, n::varchar as actual from m where n <> 4
union all select rec_id, 'correct_count', 'choices', null, '1', ok::varchar from m where ok <> 1
union all select rec_id, 'same_choice', 'choices', null, null, null from m where len(list_distinct(k)) + (case when len(list_filter(k, lambda x: x is null)) > 0 then 1 else 0 end) <> len(k)""")
def choice_structure(spark, d):
    q = table(spark, d, "grammar_mcq").select("rec_id", F.col("body.choices").alias("choices"))
    return checks.apply(q, checks.choices("choices", "answer"))


@query(f"""
select rec_id, len(ok) as n_correct, case when len(ok) = 1 then replace(s, '____', ok[1].text) end as filled, case when len(ok) = 1 and contains(s, '____') then instr(replace(s, '____', ok[1].text), ok[1].text) > 0
  and instr(substr(replace(s, '____', ok[1].text), instr(replace(s, '____', ok[1].text), ok[1].text) + 1), ok[1].text) = 0 end as once
from (select rec_id, body.sentence_with_blank as s, list_filter({_CHOICES}, lambda c: coalesce(c.is_correct, false)) as ok from grammar_mcq where body.choices is not null and body.sentence_with_blank is not null)""")
def fill_blank(spark, d):
    q = table(spark, d, "grammar_mcq").where("body.choices is not null and body.sentence_with_blank is not null")
    q = q.withColumn("own", F.filter("body.choices", lambda c: c.isNotNull()))
    q = q.withColumn("c", checks.correct_choice("own")).withColumn("filled", text.fill_all("body.sentence_with_blank", "c.text"))
    n = F.size(F.filter("own", lambda c: F.coalesce(c["is_correct"], F.lit(False)))).cast("long")
    once = F.when(F.col("c").isNotNull() & F.contains("body.sentence_with_blank", F.lit(text.BLANK)), text.starts_once("c.text", "filled"))
    return q.select("rec_id", n.alias("n_correct"), "filled", once.alias("once"))


@query("""
select rec_id, (i - 1)::int as choice_no, replace(s, '____', c.text) as filled from (select rec_id, body.sentence_with_blank as s, unnest(body.choices) as c, unnest(range(1, len(body.choices) + 1)) as i from grammar_mcq) where c.text is not null and not c.is_correct""")
def wrong_fills(spark, d):
    return checks.wrong_fills(table(spark, d, "grammar_mcq"), "body.sentence_with_blank", "body.choices")


@query("""
with q as (select rec_id, i - 1 as no, c from (select rec_id, unnest(body.choices) as c, unnest(range(1, len(body.choices) + 1)) as i from vocab_mcq_en2ja) where c.anchor is not null),
j as (select q.*, l.id as e_id, l.headword as h, l.pos as p, l.level as v, case when l.pos in ('noun','number') then 0 when l.pos in ('verb','be-verb','do-verb','have-verb','modal auxiliary') then 1 when l.pos in ('adjective','determiner') then 2
  when l.pos = 'adverb' then 3 when l.pos in ('pronoun','preposition','conjunction','interjection','infinitive-to') then 4 end as g from q left join lexicon l on l.id = q.c.anchor.entry_id),
r as (select rec_id, any_value(g) as tg, any_value(p) as tp from j where c.is_correct group by 1)
select rec_id, 'choices/' || no as location, 'anchor_missing' as code, c.anchor.entry_id as evidence, null::varchar as expected, null::varchar as actual from j where e_id is null
union all select rec_id, 'choices/' || no, 'anchor_differs', c.anchor.entry_id, null, null from j where e_id is not null and (c.anchor.headword is distinct from h or c.anchor.pos is distinct from p or c.anchor.level is distinct from v)
union all select j.rec_id, 'choices/' || no, 'distractor_pos', null, tp, p from j join r on r.rec_id = j.rec_id where e_id is not null and not c.is_correct and p <> tp and not coalesce(g = tg, false)""")
def anchor_compare(spark, d):
    q = table(spark, d, "vocab_mcq_en2ja").select("rec_id", F.col("body.choices").alias("choices"))
    return checks.anchors(q, "choices", table(spark, d, "lexicon"))


_BAND = "split_part(upper(trim(translate(regexp_replace(level.value, '[\\x{ad}\\x{200b}-\\x{200f}\\x{2060}\\x{feff}]', '', 'g'), 'ＡＢＣａｂｃ０１２３４５６７８９．', 'ABCabc0123456789.'))), '.', 1)"
_GROUP_OF = "case {0} when 'noun' then 0 when 'number' then 0 when 'verb' then 1 when 'be-verb' then 1 when 'do-verb' then 1 when 'have-verb' then 1 when 'modal auxiliary' then 1 when 'adjective' then 2 when 'determiner' then 2 when 'adverb' then 3 when 'pronoun' then 4 when 'preposition' then 4 when 'conjunction' then 4 when 'interjection' then 4 when 'infinitive-to' then 4 end"


@query(f"""
with q as (select q.rec_id, q.body.choices as cs, q.target.ref as ref, {_BAND.replace('level.value', 'q.level.value')} as asked, coalesce(q.body.pos_pool_relaxed, false) as relaxed,
  coalesce(l.pos, case when split_part(q.target.ref, ':', -1) = 'modal-auxiliary' then 'modal auxiliary' else split_part(q.target.ref, ':', -1) end) as tpos from vocab_mcq_en2ja q left join lexicon l on l.id = q.target.ref),
c as (select q.*, unnest(cs) as c, unnest(range(len(cs))) as i from q), w as (select rec_id, asked, relaxed, tpos, i, c.anchor as a from c where c.anchor is not null and not coalesce(c.is_correct, false)),
k as (select rec_id, ref, list_filter(list_transform(list_filter(cs, lambda x: x is not null), lambda x: x.anchor.entry_id), lambda x: x is not null) as ids,
  list_transform(list_filter(cs, lambda x: x is not null and coalesce(x.is_correct, false)), lambda x: x.anchor.entry_id) as good, list_transform(list_filter(cs, lambda x: x is not null and not coalesce(x.is_correct, false)), lambda x: x.anchor.entry_id) as bad from q where cs is not null)
select rec_id, 'distractor_level' as code, 'choices/' || i as location, a.entry_id as evidence, asked as expected, a.level as actual from w where asked is not null and a.level is distinct from asked
union all select rec_id, 'distractor_pos', 'choices/' || i, a.entry_id, tpos, a.pos from w where tpos is not null and not case when relaxed then coalesce({_GROUP_OF.format('a.pos')} = {_GROUP_OF.format('tpos')}, false) else a.pos is not distinct from tpos end
union all select rec_id, 'relaxed_unused', 'pos_pool_relaxed', null, null, null from q where relaxed and cs is not null and tpos is not null and not exists (select 1 from w join lexicon l on l.id = w.a.entry_id and l.pos = w.a.pos where w.rec_id = q.rec_id and w.a.pos <> w.tpos)
union all select rec_id, 'anchor_repeated', 'choices', array_to_string(ids, ','), null, null from k where len(list_distinct(ids)) <> len(ids)
union all select rec_id, 'correct_not_target', 'choices', array_to_string(good, ','), ref, null from k where ref is not null and (len(good) <> 1 or good[1] is distinct from ref)
union all select rec_id, 'wrong_is_target', 'choices', ref, null, null from k where list_contains(bad, ref)""")
def anchor_rules(spark, d):
    """Level, part of speech, relaxed flag and identity of choices' anchors, which anchor_compare leaves out."""
    return checks.anchor_rules(table(spark, d, "vocab_mcq_en2ja"), "body.choices", "level.value", "target.ref", "body.pos_pool_relaxed", table(spark, d, "lexicon"))


@query("""
select rec_id, 'target_missing' as code, 'target/ref' as location, target.ref as evidence, null::varchar as expected, null::varchar as actual from vocab_mcq_en2ja where target.ref is not null and target.ref not in (select id from lexicon)""")
def target_exists(spark, d):
    return checks.targets(table(spark, d, "vocab_mcq_en2ja"), "target.ref", table(spark, d, "lexicon"))


@query(f"""
select q.rec_id, case when l.id is null then 'target_missing' else 'target_level' end as code, 'target/ref' as location, q.target.ref as evidence, case when l.id is not null then {_BAND} end as expected, l.level as actual
from vocab_mcq_en2ja q left join lexicon l on l.id = q.target.ref where q.target.ref is not null and (l.id is null or l.level <> {_BAND})""".replace("level.value", "q.level.value"))
def target_level(spark, d):
    """target_exists with the level that it leaves out: the entry's must be the question's."""
    return checks.targets(table(spark, d, "vocab_mcq_en2ja"), "target.ref", table(spark, d, "lexicon"), level="level.value")


@query(f"""
select q.rec_id, 'target_range' as code, 'target/ref' as location, q.target.ref as evidence, g.level.min || '-' || g.level.max as expected, q.level.value as actual
from grammar_rewrite q join grammar g on g.id = q.target.ref where not (g.target_eligible and coalesce({_RANK.format('q.level.value')} between {_RANK.format('g.level.min')} and {_RANK.format('g.level.max')}, false))""")
def target_range(spark, d):
    q = table(spark, d, "grammar_rewrite").select("rec_id", F.col("target.ref").alias("ref"), F.col("level.value").alias("item_level"))
    g = table(spark, d, "grammar")
    found = checks.out_of_range(q, "ref", "item_level", g)
    # concat_ws gives '' for a range without bounds, where SQL's || gives null
    return found.withColumn("expected", F.nullif("expected", F.lit("")))


@query("""
with k as (select rec_id, lower(trim(body.answer)) as a, list_transform(body.answer_equivalents, lambda x: lower(trim(x))) as e from grammar_rewrite)
select rec_id, 'equivalent_is_answer' as code, 'equivalents' as location, null::varchar as evidence, null::varchar as expected, null::varchar as actual from k where list_contains(e, a)
union all select rec_id, 'same_equivalent', 'equivalents', null, null, null from k where len(list_distinct(e)) <> len(e)
union all select rec_id, 'same_sentence', 'target', null, null, null from grammar_rewrite where trim(regexp_replace(lower(body.source_sentence), '\\s+', ' ', 'g')) = trim(regexp_replace(lower(replace(body.target_sentence_with_blank, '____', body.answer)), '\\s+', ' ', 'g'))""")
def rewrite_checks(spark, d):
    q = table(spark, d, "grammar_rewrite").select("rec_id", F.col("body.source_sentence").alias("source"), F.col("body.target_sentence_with_blank").alias("target"), F.col("body.answer").alias("answer"), F.col("body.answer_equivalents").alias("equivalents"))
    return checks.apply(q, [*checks.equivalents("answer", "equivalents"), checks.unchanged("source", "target", "answer")])


_ANSWER = "list_filter(string_split_regex(lower(translate(nfc_normalize({}), '’.,?!;:', '''')), '[ \\t]+'), lambda x: x <> '')"


@query(f"""
select rec_id, list_sort(s) = list_sort(t) as same_words, s = t as same_order from (select rec_id, {_ANSWER.format('body.source_sentence')} as s, {_ANSWER.format("replace(body.target_sentence_with_blank, '____', body.answer)")} as t from grammar_rewrite)
where s is not null and t is not null""")
def answer_tokens_multiset(spark, d):
    q = table(spark, d, "grammar_rewrite")
    q = q.select("rec_id", text.answer_tokens("body.source_sentence").alias("s"), text.answer_tokens(text.fill_all("body.target_sentence_with_blank", "body.answer")).alias("t")).where("s is not null and t is not null")
    return q.select("rec_id", (F.array_sort("s") == F.array_sort("t")).alias("same_words"), (F.col("s") == F.col("t")).alias("same_order"))


# --- vocabulary of texts ----------------------------------------------------------------------------------------------------

_TOKEN_SQL = "regexp_extract_all(text, '[A-Za-z]+(?:[''’][A-Za-z]+)?|[0-9]+(?:[.,][0-9]+)*(?:st|nd|rd|th)?|[^\\sA-Za-z0-9]')"
_DECISION_SQL = f"""
with t as (select doc_id, unnest({_TOKEN_SQL}) as surface from documents where lower(trim(lang)) like 'en%' and text is not null),
c as (select doc_id, surface, count(*) as n from t group by 1, 2),
e as (select lower(headword) as word, min(list_position(['A1','A2','B1','B2'], level)) as rank from lexicon where not is_multiword group by 1),
x as (select c.*, case when e.rank <= 2 then 'wordlist_match' when e.rank is not null then 'above_level' when surface in ('T','X','DVD','IT','PC','ATM') then 'allowlist'
  when regexp_matches(surface, '^[0-9]+([.,:][0-9]+)*$') or regexp_matches(surface, '(?i)^[0-9]+(st|nd|rd|th)$') or regexp_matches(surface, '^[^A-Za-z0-9]+$') or regexp_matches(surface, '(?i)^[a-z]+[''’]s$') or regexp_matches(surface, '(?i)^[a-z]+[''’](ll|re|ve|d|m|t)$') then 'exempt' else 'unknown' end as decision
  from c left join e on e.word = lower(c.surface))"""


def _english(spark, d):
    return table(spark, d, "documents").where(F.lower(F.trim("lang")).startswith("en") & F.col("text").isNotNull())


def _decided(spark, d):
    # a document's tokens are counted by surface before they are looked up: decisions depend on nothing else
    t = _english(spark, d).select("doc_id", F.explode(tokens.surfaces("text")).alias("surface")).groupBy("doc_id", "surface").agg(F.count(F.lit(1)).alias("n")).withColumn("word", F.lower("surface"))
    return tokens.decisions(t, table(spark, d, "lexicon"), ALLOWED, F.lit(2))


@query(_DECISION_SQL + " select doc_id, decision, sum(n)::bigint as n_tokens from x group by 1, 2")
def token_decision(spark, d):
    return _decided(spark, d).groupBy("doc_id", "decision").agg(F.sum("n").alias("n_tokens"))


@query(_DECISION_SQL + " select doc_id, surface, decision, n from x where decision in ('above_level', 'unknown')")
def lexical_violations(spark, d):
    return _decided(spark, d).where(F.col("decision").isin("above_level", "unknown")).select("doc_id", "surface", "decision", "n")


@query(_DECISION_SQL + """, v as (select doc_id, count(*) as n_problems from x where decision in ('above_level', 'unknown') group by 1)
select d.doc_id, coalesce(n_problems, 0) as n_problems, case when n_problems > 0 then 'fail' else 'pass' end as verdict from documents d left join v using (doc_id) where lower(trim(lang)) like 'en%' and text is not null""")
def verdict(spark, d):
    problems = _decided(spark, d).where(F.col("decision").isin("above_level", "unknown"))
    return tokens.verdicts(_english(spark, d), ["doc_id"], problems)


_TOKENS_OF = "regexp_extract_all({0}, '[A-Za-z]+(?:[''’][A-Za-z]+)?|[0-9]+(?:[.,][0-9]+)*(?:st|nd|rd|th)?|[^\\sA-Za-z0-9]')"
# the longest phrase that begins at each place, then from each one the next that begins where it has ended
_PHRASES_SQL = f"""
with recursive l as (select doc_id, s, list_transform(s, lambda x: lower(x)) as w from (select doc_id, {_TOKENS_OF.format('text')} as s from documents where lower(trim(lang)) like 'en%' and text is not null)),
p as (select id, list_transform({_TOKENS_OF.format('headword')}, lambda x: lower(x)) as k from lexicon where is_multiword),
t as (select doc_id, unnest(s) as surface, unnest(range(len(s))) as start from l),
h as (select t.doc_id, t.start, len(p.k) as size, p.id from t join p on p.k[1] = lower(t.surface) join l on l.doc_id = t.doc_id and list_slice(l.w, t.start + 1, t.start + len(p.k)) = p.k
  qualify row_number() over (partition by t.doc_id, t.start order by len(p.k) desc, p.id) = 1),
nx as materialized (select h.doc_id, h.start, n.start as next from h asof join h n on h.doc_id = n.doc_id and h.start + h.size <= n.start),
g as (select doc_id, min(start) as start from h group by 1 union all select g.doc_id, nx.next from g join nx on nx.doc_id = g.doc_id and nx.start = g.start),
spans as (select h.* from h join g on g.doc_id = h.doc_id and g.start = h.start)"""
_WHOLE_SQL = _PHRASES_SQL + """,
taken as (select doc_id, unnest(range(start, start + size)) as start from spans),
c as (select t.doc_id, t.surface, null::varchar as phrase_id, 1 as size, count(*) as n from t where not exists (select 1 from taken k where k.doc_id = t.doc_id and k.start = t.start) group by 1, 2
  union all select s.doc_id, array_to_string(list_slice(l.s, s.start + 1, s.start + s.size), ' '), s.id, s.size, count(*) from spans s join l on l.doc_id = s.doc_id group by all),
e as (select lower(headword) as word, min(list_position(['A1','A2','B1','B2'], level)) as rank from lexicon where not is_multiword group by 1),
x as (select c.*, case when c.phrase_id is not null then case when f.level in ('A1', 'A2') then 'multiword_match' else 'above_level' end when e.rank <= 2 then 'wordlist_match' when e.rank is not null then 'above_level' when surface in ('T','X','DVD','IT','PC','ATM') then 'allowlist'
  when regexp_matches(surface, '^[0-9]+([.,:][0-9]+)*$') or regexp_matches(surface, '(?i)^[0-9]+(st|nd|rd|th)$') or regexp_matches(surface, '^[^A-Za-z0-9]+$') or regexp_matches(surface, '(?i)^[a-z]+[''’]s$') or regexp_matches(surface, '(?i)^[a-z]+[''’](ll|re|ve|d|m|t)$') then 'exempt' else 'unknown' end as decision
  from c left join e on c.phrase_id is null and e.word = lower(c.surface) left join lexicon f on f.id = c.phrase_id)"""


def _decided_whole(spark, d):
    entries = table(spark, d, "lexicon")
    return tokens.phrase_decisions(tokens.counted(_english(spark, d), ["doc_id"], "text", tokens.phrase_patterns(entries)), entries, ALLOWED, F.lit(2))


@query(_WHOLE_SQL + " select doc_id, decision, sum(n * size)::bigint as n_tokens from x group by 1, 2")
def phrase_token_decision(spark, d):
    """token_decision with phrases first, which token_decision leaves out."""
    return _decided_whole(spark, d).groupBy("doc_id", "decision").agg(F.sum(F.col("n") * F.col("size")).alias("n_tokens"))


@query(_WHOLE_SQL + " select doc_id, surface, decision, n from x where decision in ('above_level', 'unknown')")
def phrase_lexical_violations(spark, d):
    """lexical_violations with phrases first; a phrase above the level is one violation."""
    return _decided_whole(spark, d).where(F.col("decision").isin("above_level", "unknown")).select("doc_id", "surface", "decision", "n")


@query(_WHOLE_SQL + """, v as (select doc_id, count(*) as n_problems from x where decision in ('above_level', 'unknown') group by 1)
select d.doc_id, coalesce(n_problems, 0) as n_problems, case when n_problems > 0 then 'fail' else 'pass' end as verdict from documents d left join v using (doc_id) where lower(trim(lang)) like 'en%' and text is not null""")
def phrase_verdict(spark, d):
    """verdict with phrases first."""
    return tokens.verdicts(_english(spark, d), ["doc_id"], _decided_whole(spark, d).where(F.col("decision").isin("above_level", "unknown")))


@query("""
with t as (select rec_id, unnest(string_split(lower(body.target_surface), ' ')) as word, lower(body.pos) as tag from vocab_flashcard_en2ja where body.target_surface is not null and body.pos is not null),
d as (select distinct * from t),
h as (select d.*, e.id, e.pos, list_position(['A1','A2','B1','B2'], e.level) as rank, case when e.pos = d.tag then 0 else 1048576 end as prio from d join lexicon e on lower(e.headword) = d.word),
b as (select rec_id, word, tag, id as entry_id, prio > 0 as fallback from h qualify row_number() over (partition by rec_id, word, tag order by prio, rank, id) = 1)
select d.rec_id, d.word, d.tag, b.entry_id, b.fallback from d left join b using (rec_id, word, tag)""")
def pos_fallback(spark, d):
    q = table(spark, d, "vocab_flashcard_en2ja").where("body.target_surface is not null and body.pos is not null")
    t = q.select("rec_id", F.explode(F.split(F.lower("body.target_surface"), " ")).alias("word"), F.lower("body.pos").alias("tag")).distinct()
    entries = table(spark, d, "lexicon")
    priority = entries.select(F.col("pos").alias("tag"), "pos").distinct().withColumn("prio", F.lit(0))
    return tokens.pos_choice(t, entries, priority)


@query(_PHRASES_SQL + " select doc_id, start::int as start, id as phrase_id, size::int as size from spans")
def phrase_greedy(spark, d):
    """Phrases of the vocabulary in English documents, greedily from the left."""
    return tokens.phrases(_english(spark, d), ["doc_id"], "text", tokens.phrase_patterns(table(spark, d, "lexicon")))


@query(f"""
with recursive t as (select rec_id, body.source_sentence as s, {_TOKENS_OF.format('body.source_sentence')} as k from grammar_rewrite where body.source_sentence is not null),
r as (select rec_id, s, k, 0::bigint as i, 0::bigint as start, 0::bigint as stop, 0 as sentence, false as ended from t
  union all select rec_id, s, k, i + 1, stop + instr(substr(s, stop + 1), k[i + 1]) - 1, stop + instr(substr(s, stop + 1), k[i + 1]) - 1 + length(k[i + 1]),
    case when ended and regexp_matches(k[i + 1], '^[A-Za-z0-9]') then sentence + 1 else sentence end, (ended and not regexp_matches(k[i + 1], '^[A-Za-z0-9]')) or k[i + 1] in ('.', '!', '?') from r where i < len(k))
select rec_id, k[i] as surface, lower(k[i]) as lemma, '' as tag, case when regexp_matches(k[i], '^[0-9]') then 'NUM' when regexp_matches(k[i], '^[A-Za-z]') then 'X' else 'PUNCT' end as upos, start::int as start, stop::int as "end", sentence from r where i > 0""")
def tagged_sentences(spark, d):
    """Tokens with offsets and sentence numbers by the plain tagger."""
    q = table(spark, d, "grammar_rewrite").select("rec_id", F.col("body.source_sentence").alias("s"))
    return tokens.tag(q, "s").select("rec_id", F.inline("tokens"))


# --- contracts --------------------------------------------------------------------------------------------------------------


@query("""
select event_id, array_to_string(list_sort(list_filter(['k', 'v'], lambda x: not list_contains(json_keys(props), x))), ',') as missing, array_to_string(list_sort(list_filter(json_keys(props), lambda x: x not in ('k', 'v'))), ',') as extra from events where props is not null""")
def json_keys(spark, d):
    e = table(spark, d, "events").where("props is not null").select("event_id", contract.key_sets("props", ["k", "v"]).alias("s"))
    return e.select("event_id", F.array_join("s.missing", ",").alias("missing"), F.array_join("s.extra", ",").alias("extra"))


_TEXT = {"type": "string", "min_length": 1}
_QUESTION_RULE = {
    "type": "object", "required": ["question_id", "level", "target", "body"],
    "properties": {
        "question_id": {"type": "string", "pattern": r"^q(0[1-9]|1[0-9]|20)\Z"}, "format": _TEXT,
        "level": {"type": "object", "required": ["scale", "value"], "properties": {"scale": {"enum": ["cefr", "cefrj"]}, "value": _TEXT}},
        "target": {"type": "object", "required": ["type", "ref"], "properties": {"type": _TEXT, "ref": _TEXT, "display_name": _TEXT}},
        "body": {"type": "object"}, "provenance": {"type": ["object", "null"]},
    },
}
SET_RULE = {
    "type": "object", "required": ["schema_version", "set_id", "format", "questions"],
    "properties": {
        "schema_version": {"type": "string", "pattern": "^1\\."}, "set_id": {"type": "string", "pattern": r"^[0-9]{8}-[0-9]{6}-[a-z0-9]{4}\Z"}, "created_at": _TEXT, "format": {"const": "vocab_mcq_en2ja"},
        "level": {"type": "object"}, "mode": {"enum": ["explicit", "proposal"]}, "requested_count": {"type": "integer", "minimum": 1, "maximum": 20}, "topic": {"type": ["string", "null"]},
        "questions": {"type": "array", "min_items": 1, "max_items": 20, "items": _QUESTION_RULE},
    },
}


@query()
def json_contract(spark, d):
    """Broken rules of received sets, by pointer; tested against hand-made texts."""
    return contract.violations(table(spark, d, "set_raw"), "raw_id", "payload", SET_RULE)


@query()
def canonical_json(spark, d):
    """Digest of each received set's canonical text, null where it isn't strict JSON."""
    return table(spark, d, "set_raw").select("raw_id", jsontext.digest(jsontext.canonical("payload")).alias("sha"))


# --- matching and streams ---------------------------------------------------------------------------------------------------


@query("""
with a as (select set_id, level.value as v, rec_id, row_number() over (partition by set_id, level.value order by rec_id) as n from grammar_mcq where level.value is not null),
b as (select set_id, level.value as v, rec_id, row_number() over (partition by set_id, level.value order by rec_id) as n from grammar_rewrite where level.value is not null)
select coalesce(a.set_id, b.set_id) as set_id, a.rec_id as left_id, b.rec_id as right_id from a full join b on a.set_id = b.set_id and a.v = b.v and a.n = b.n""")
def match_questions(spark, d):
    """One-to-one matches of rewrite questions with choice questions of the same set and level: the n-th of each, as a row has one level."""
    left = table(spark, d, "grammar_mcq").select("set_id", F.col("level.value").alias("v"), F.col("rec_id").alias("left_id")).where("v is not null")
    right = table(spark, d, "grammar_rewrite").select("set_id", F.col("level.value").alias("v"), F.col("rec_id").alias("right_id")).where("v is not null")
    return matching.match(left, right, "set_id", ["v"])


@query("""select o.o_orderkey from orders o where not exists (select 1 from lineitem l where l.l_orderkey = o.o_orderkey and l.l_returnflag = 'R')""")
def without_partner(spark, d):
    returned = table(spark, d, "lineitem").where("l_returnflag = 'R'").withColumnRenamed("l_orderkey", "o_orderkey")
    return matching.without_partner(table(spark, d, "orders"), returned, ["o_orderkey"]).select("o_orderkey")


@query(f"""
select set_id, question_id, max(g) as generation, arg_max(rec_id, g::bigint * 1000000000 - rec_id) as rec_id, count(*) as n from (select *, {_GEN} as g from grammar_mcq) where g is not null group by 1, 2""")
def latest_generation(spark, d):
    """The batch form of the stream that keeps each question's latest generation."""
    return deliveries.latest_generation_batch(table(spark, d, "grammar_mcq"))


# --- scalar functions -------------------------------------------------------------------------------------------------------


@query(f"""
select rec_id, lower(trim(body.answer)) as answer, {_SENTENCE.format('body.source_sentence')} as sentence, length(nfc_normalize(body.source_ja)) as n_characters,
  case when contains(substr(target.ref, 4), '-') then split_part(substr(target.ref, 4), '-', 1) end as parent, split_part(level.value, '.', 1) as band, {_RANK.format('level.value')} as rank,
  regexp_extract(question_id, '^[a-z]+([0-9]+)$', 1)::int as ordinal, '/target/' || replace(replace(target.ref, '~', '~0'), '/', '~1') as pointer
from grammar_rewrite""")
def scalar_functions(spark, d):
    number = F.substring(F.col("target.ref"), F.lit(4), F.length("target.ref"))
    return table(spark, d, "grammar_rewrite").select(
        "rec_id", text.answer_key("body.answer").alias("answer"), text.sentence_key("body.source_sentence").alias("sentence"), text.n_characters("body.source_ja").cast("long").alias("n_characters"),
        text.parent_number(number).alias("parent"), levels.band("level.value").alias("band"), levels.fine_rank("level.value").alias("rank"), text.ordinal("question_id").alias("ordinal"),
        F.concat(F.lit("/target"), text.pointer("target.ref")).alias("pointer"),
    )


@query("""
select id, 'lex:' || headword || ':' || replace(pos, ' ', '-') as built, id = 'lex:' || headword || ':' || replace(pos, ' ', '-') as same, regexp_matches(headword, '[ -]') as multiword,
  case level when 'A1' then 'A1.3' when 'A2' then 'A2.2' when 'B1' then 'B1.2' when 'B2' then 'B2.2' end as ceiling, split_part(id, ':', -1) as pos_of from lexicon""")
def entry_ids(spark, d):
    built = text.entry_id("headword", "pos")
    return table(spark, d, "lexicon").select("id", built.alias("built"), (F.col("id") == built).alias("same"), text.is_multiword("headword").alias("multiword"), levels.ceiling("level").alias("ceiling"), text.pos_of("id").alias("pos_of"))


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
