"""Queries over small functions and table operators, each with SQL written from its rule. Where the tables have no faults, some are planted by row number."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import jsontext, levels, text
from ..operators import attempts, lookup, reference, tokens, versions
from ..runtime import fresh_place, table
from ..sources import readers, sinks
from .registry import Registry

_registry = Registry()
query, queries, oracle_sql = _registry.query, _registry.queries, _registry.oracle_sql

_SPACE = "[\\s\\x0b\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"


def _stripped(x: str) -> str:
    return f"regexp_replace({x}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"


#: A text with white space and marks to be composed, by row number.
_ODD_SQL = "case rec_id % 4 when 0 then '  ' || body.gloss || chr(12288) when 1 then body.gloss || 'か' || chr(12441) when 2 then ' ' || chr(160) else body.gloss end"


def _odd(n, gloss):
    case = n % 4
    return F.when(case == 0, F.concat(F.lit("  "), gloss, F.lit("　"))).when(case == 1, F.concat(gloss, F.lit("が"))).when(case == 2, F.lit("  ")).otherwise(gloss)


@query(f"""
with t as (select rec_id, {_ODD_SQL} as x from vocab_flashcard_en2ja)
select rec_id, nullif({_stripped('nfc_normalize(x)')}, '') as clean, lower(nfc_normalize(x)) as lower_key, lower({_stripped('x')}) as answer_key, nfc_normalize({_stripped('x')}) as choice_key, length(nfc_normalize(x)) as n_characters from t""")
def text_keys(spark, d):
    """Clean text, lower-case, answer and choice keys, and length of composed text, over glosses given odd spaces and marks."""
    t = table(spark, d, "vocab_flashcard_en2ja").select("rec_id", _odd(F.col("rec_id"), F.col("body.gloss")).alias("x"))
    return t.select("rec_id", text.clean("x").alias("clean"), text.lower_key("x").alias("lower_key"), text.answer_key("x").alias("answer_key"), text.choice_key("x").alias("choice_key"), text.n_characters("x").cast("long").alias("n_characters"))


@query("""
with t as (select rec_id, body.target_sentence_with_blank || case when rec_id % 2 = 0 then ' ____.' else '' end as s, body.answer as a from grammar_rewrite)
select rec_id, replace(s, '____', a) as every, case when instr(s, '____') > 0 then substr(s, 1, instr(s, '____') - 1) || a || substr(s, instr(s, '____') + 4) else s end as first,
  case when instr(s, '____') > 0 then substr(s, 1, instr(s, '____') - 1) else s end as before, case when instr(s, '____') > 0 then '____' else '' end as match, case when instr(s, '____') > 0 then substr(s, instr(s, '____') + 4) else '' end as after from t""")
def blanks(spark, d):
    """All blanks filled, the first one filled, and the text around the first one."""
    t = table(spark, d, "grammar_rewrite").select("rec_id", F.concat("body.target_sentence_with_blank", F.when(F.col("rec_id") % 2 == 0, " ____.").otherwise("")).alias("s"), F.col("body.answer").alias("a"))
    parts = text.split_on("s", F.lit(text.BLANK))
    return t.select("rec_id", text.fill_all("s", "a").alias("every"), text.fill_first("s", "a").alias("first"), parts["before"].alias("before"), parts["match"].alias("match"), parts["after"].alias("after"))


@query("""
with t as (select id, case when instr(id, '-') > 0 then substr(id, 4) else substr(id, 4) || case efl is null when true then '.0' else '' end end as n from grammar),
o as (select doc_id as id, case doc_id % 4 when 0 then doc_id || '-x' when 1 then ' ' || doc_id || '.00 ' when 2 then doc_id || '-' || (doc_id % 7) else doc_id || '.5' end as n from documents)
select id, n, case when regexp_full_match(regexp_replace(trim(n), '\\.0+$', ''), '[0-9]+(-[0-9]+)?') then regexp_replace(trim(n), '\\.0+$', '') end as number from (select id, n from t union all select id::varchar, n from o)""")
def item_numbers(spark, d):
    """Ids read as digits or digits-digits, out of texts and integral numbers; null for anything else."""
    g = table(spark, d, "grammar").select("id", F.concat(F.substring("id", 4, 99), F.when(F.col("efl").isNull() & ~F.contains("id", F.lit("-")), ".0").otherwise("")).alias("n"))
    i = F.col("doc_id")
    odd = F.when(i % 4 == 0, F.concat(i, F.lit("-x"))).when(i % 4 == 1, F.concat(F.lit(" "), i, F.lit(".00 "))).when(i % 4 == 2, F.concat(i, F.lit("-"), i % 7)).otherwise(F.concat(i, F.lit(".5")))
    t = g.unionByName(table(spark, d, "documents").select(i.cast("string").alias("id"), odd.alias("n")))
    return t.select("id", "n", text.item_number("n").alias("number"))


@query("""
with t as (select rec_id, body.stem as t, case rec_id % 4 when 0 then substr(body.stem, 2, 9) when 1 then body.target_surface when 2 then substr(body.stem, 1, 5 + (rec_id % 3)::int) else 'zz' end as s from vocab_mcq_en2ja)
select rec_id, s <> '' and regexp_matches(t, case when regexp_matches(s, '^[\\p{L}\\p{N}]') then '(^|[^\\p{L}\\p{N}])' else '' end || regexp_escape(s) || case when regexp_matches(s, '[\\p{L}\\p{N}]$') then '([^\\p{L}\\p{N}]|$)' else '' end) as whole from t""")
def whole_spans(spark, d):
    """Whether a span stands in a sentence without cutting a word."""
    n, stem = F.col("rec_id"), F.col("body.stem")
    cut = F.when(n % 4 == 0, F.substring(stem, 2, 9)).when(n % 4 == 1, F.col("body.target_surface")).when(n % 4 == 2, F.substring(stem, F.lit(1), (5 + n % 3).cast("int"))).otherwise("zz")
    return table(spark, d, "vocab_mcq_en2ja").select("rec_id", text.holds_span(stem, cut).alias("whole"))


_EVIDENCE_SQL = "'見出し ' || id || ' (' || coalesce(kyoinban.level_raw, 'なし') || ') x' || id || ' ' || id || '- A1.2x ' || coalesce(level.min, '') || ', ' || coalesce(parent_id, '継承')"


@query(f"""
with t as (select id, string_split_regex({_EVIDENCE_SQL}, '[ (),]+') as w from grammar)
select id, array_to_string(list_sort(list_distinct(list_filter(w, lambda x: regexp_full_match(x, 'gp:[0-9]+(-[0-9]+)?')))), ' ') as refs,
  array_to_string(list_sort(list_distinct(list_filter(w, lambda x: regexp_full_match(x, '(A1\\.[123]|(A2|B1|B2)\\.[12])(-(A1\\.[123]|(A2|B1|B2)\\.[12]))?')))), ' ') as levels from t""")
def evidence_refs(spark, d):
    """Grammar references and levels (a range is one) that stand as whole tokens in texts that also hold cut ones."""
    g = table(spark, d, "grammar")
    e = F.concat(F.lit("見出し "), "id", F.lit(" ("), F.coalesce("kyoinban.level_raw", F.lit("なし")), F.lit(") x"), "id", F.lit(" "), "id", F.lit("- A1.2x "), F.coalesce("level.min", F.lit("")), F.lit(", "), F.coalesce("parent_id", F.lit("継承")))
    joined = lambda c: F.array_join(F.array_sort(c), " ")
    return g.select("id", joined(text.item_refs(e)).alias("refs"), joined(text.level_refs(e)).alias("levels"))


@query("""
with n as (select doc_id, doc_id * 13 as n from documents), r as (select doc_id, n, (n - 1) // 26 as a, (n - 1) % 26 as x from n), q as (select *, (a - 1) // 26 as b, (a - 1) % 26 as y from r)
select doc_id, case when b > 0 then chr((65 + (b - 1) % 26)::int) else '' end || case when a > 0 then chr((65 + y)::int) else '' end || chr((65 + x)::int) as name from q""")
def column_names(spark, d):
    """Spreadsheet names of columns counted from 1."""
    return table(spark, d, "documents").select("doc_id", text.column_name(F.col("doc_id") * 13).alias("name"))


@query("""
select doc_id, 'doc' || doc_id || '+lang' || coalesce(lang, '') as label, split_part((doc_id % 11) || '.' || (doc_id % 7) || '.0', '.', 1) as major,
  source || ' (' || lang || '). Retrieved from urn:' || doc_id || ' on ' || strftime(created_at, '%Y-%m-%d') || '.' as cited, '『' || source || '』(' || lang || '版) (URL: urn:' || doc_id || ' より' || year(created_at) || '年' || month(created_at) || '月ダウンロード)' as cited_ja from documents""")
def labels_and_citations(spark, d):
    """Version labels, the major part of versions, and citations of documents by source and date."""
    url = F.concat(F.lit("urn:"), "doc_id")
    version = F.concat(F.col("doc_id") % 11, F.lit("."), F.col("doc_id") % 7, F.lit(".0"))
    return table(spark, d, "documents").select(
        "doc_id", text.version_label(doc=F.col("doc_id").cast("string"), lang=F.coalesce("lang", F.lit(""))).alias("label"), text.major(version).alias("major"),
        text.citation("source", "lang", url, "created_at").alias("cited"), text.citation("source", "lang", url, "created_at", japanese=True).alias("cited_ja"),
    )


_OFFSETS = ("Z", "+09:00", "-14:00", "+14:30", "+15:00", "+09:60", "", ".5Z")


@query(f"""
with t as (select doc_id, case when doc_id % 9 = 0 then '2023-02-30' else strftime(created_at, '%Y-%m-%d') end || 'T' || strftime(created_at, '%H:%M:%S') || ({list(_OFFSETS)!r})[(doc_id % 8)::int + 1] as x from documents),
o as (select *, regexp_extract(x, '([+-])([0-9]{{2}}):([0-9]{{2}})$', 2) as h, regexp_extract(x, '([+-])([0-9]{{2}}):([0-9]{{2}})$', 3) as m from t)
select doc_id, case when regexp_full_match(x, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T[0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}(Z|[+-][0-9]{{2}}:[0-9]{{2}})') and (h = '' or (m <= '59' and (h < '14' or (h = '14' and m = '00')))) then epoch(try_cast(x as timestamptz))::bigint end as seconds from o""")
def moments(spark, d):
    """Times with an offset of at most 14 hours, as seconds; other shapes, offsets and days that don't exist are null."""
    day = F.when(F.col("doc_id") % 9 == 0, "2023-02-30").otherwise(F.date_format("created_at", "yyyy-MM-dd"))
    offset = F.get(F.array(*map(F.lit, _OFFSETS)), (F.col("doc_id") % 8).cast("int"))
    t = table(spark, d, "documents").select("doc_id", F.concat(day, F.lit("T"), F.date_format("created_at", "HH:mm:ss"), offset).alias("x"))
    return t.select("doc_id", F.unix_timestamp(text.moment("x")).alias("seconds"))


@query("""
with t as (select doc_id, case doc_id % 5 when 0 then '' when 1 then to_base64(encode(source || doc_id)) when 2 then rtrim(to_base64(encode(doc_id::varchar)), '=') when 3 then to_base64(encode(doc_id::varchar)) || chr(10) else left(to_base64(encode('abcd' || doc_id)), 6) || 'B=' end as x from documents)
select doc_id, x, coalesce(regexp_full_match(x, '([A-Za-z0-9+/]{4})*([A-Za-z0-9+/][AQgw]==|[A-Za-z0-9+/]{2}[AEIMQUYcgkosw048]=)?'), false) as sound, coalesce(x <> '' and regexp_full_match(x, '([A-Za-z0-9+/]{4})*([A-Za-z0-9+/][AQgw]==|[A-Za-z0-9+/]{2}[AEIMQUYcgkosw048]=)?'), false) as filled from t""")
def base64_texts(spark, d):
    """Whether a text is what encoding gives again: padding, line ends and spare bits count."""
    n = F.col("doc_id")
    enc = lambda c: F.base64(F.encode(c.cast("string"), "UTF-8"))
    x = F.when(n % 5 == 0, "").when(n % 5 == 1, enc(F.concat("source", "doc_id"))).when(n % 5 == 2, F.rtrim(enc(n), F.lit("="))).when(n % 5 == 3, F.concat(enc(n), F.lit("\n"))).otherwise(F.concat(F.left(enc(F.concat(F.lit("abcd"), n)), F.lit(6)), F.lit("B=")))
    t = table(spark, d, "documents").select("doc_id", x.alias("x"))
    return t.select("doc_id", "x", text.is_canonical_base64("x").alias("sound"), text.is_canonical_base64("x", allow_empty=False).alias("filled"))


@query("select raw_id, payload is not null and json_valid(payload) as sound from set_raw")
def strict_json(spark, d):
    """Whether a received set is JSON by the strict reader."""
    return table(spark, d, "set_raw").select("raw_id", jsontext.strict_problem("payload").isNull().alias("sound"))


@query("""
select rec_id, '{' || chr(10) || '  "generation": ' || to_json(generation) || ',' || chr(10) || '  "level": {' || chr(10) || '    "scale": ' || coalesce(to_json(level.scale)::varchar, 'null') || ',' || chr(10) || '    "value": ' || coalesce(to_json(level.value)::varchar, 'null') || chr(10)
  || '  },' || chr(10) || '  "rec_id": ' || rec_id || chr(10) || '}' || chr(10) as value from grammar_rewrite""")
def canonical_rows(spark, d):
    """Rows as canonical JSON: members in order, two spaces a level, nulls kept, a line feed at the end."""
    q = table(spark, d, "grammar_rewrite").select("rec_id", "level", "generation")
    return q.select("rec_id", jsontext.canonical(F.to_json(F.struct("rec_id", "level", "generation"), {"ignoreNullFields": "false"})).alias("value"))


@query("""
select l_orderkey, l_linenumber, case l_linenumber % 3 when 0 then true when 1 then false else l_quantity = l_quantity + 0.5 * (l_linenumber - 2) end as same from lineitem""")
def exact_numbers(spark, d):
    """Whether two number tokens are one value: '17.0' and '1.70e1' are, '17' and '17.00001' aren't."""
    n, q = F.col("l_linenumber"), F.col("l_quantity")
    whole = F.format_string("%.1f", q)
    other = F.when(n % 3 == 0, F.format_string("%.3fe1", q / 10)).when(n % 3 == 1, F.concat(whole, F.lit("0001"))).otherwise(F.format_string("%.2f", q + 0.5 * (n - 2)))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", jsontext.equal_numbers(whole, other).alias("same"))


# --- table operators --------------------------------------------------------------------------------------------------------


@query("select g.id, c.rel_freq.A1 as freq_a1, c.range.B2 as range_b2 from grammar g left join (select id, efl.rel_freq as rel_freq, efl.range as range from grammar where efl is not null) c on c.id = g.id")
def corpus_statistics(spark, d):
    """Items with a corpus's figures, null where it has none."""
    g = table(spark, d, "grammar")
    statistics = g.where("efl is not null").select("id", "efl.rel_freq", "efl.range")
    return reference.with_corpus(g.select("id"), statistics, ["rel_freq", "range"]).select("id", F.col("rel_freq.A1").alias("freq_a1"), F.col("range.B2").alias("range_b2"))


@query("select id, split_part(substr(id, 4), '-', 1) as parent from grammar where contains(id, '-') and 'gp:' || split_part(substr(id, 4), '-', 1) not in (select id from grammar where id not like '%7')")
def children_without_parent(spark, d):
    """Numbered children whose parent isn't among the items; those that end with 7 count as absent."""
    g = table(spark, d, "grammar").select("id", text.parent_number(F.substring("id", 4, 99)).alias("parent")).where("parent is not null")
    parents = table(spark, d, "grammar").where("id not like '%7'").select(F.substring("id", 4, 99).alias("number"))
    return reference.orphans(g, "parent", parents, "number")


@query("""
with e as (select doc_id::varchar as name, sha256(text) as sha256 from documents where text is not null and doc_id % 13 <> 0), a as (select doc_id::varchar as name, sha256(case when doc_id % 10 = 0 then upper(text) else text end) as sha256 from documents where text is not null and doc_id % 17 <> 0)
select coalesce(e.name, a.name) as name, e.sha256 as wanted, a.sha256 as actual from e full join a on e.name = a.name where e.sha256 is distinct from a.sha256""")
def digest_differences(spark, d):
    """Recorded against actual digests, with files changed, added and gone."""
    n = F.col("doc_id")
    t = table(spark, d, "documents").where("text is not null")
    own = lambda rows, c: rows.select(n.cast("string").alias("name"), jsontext.digest(c).alias("sha256"))
    return versions.digest_mismatches(own(t.where(n % 13 != 0), F.col("text")), own(t.where(n % 17 != 0), F.when(n % 10 == 0, F.upper("text")).otherwise(F.col("text"))))


@query("select target.ref as ref from grammar_mcq where target.ref is not null union select target.ref from grammar_rewrite where target.ref is not null")
def set_union(spark, d):
    one = lambda t: table(spark, d, t).select(F.col("target.ref").alias("ref")).where("ref is not null")
    return versions.in_either(one("grammar_mcq"), one("grammar_rewrite"), "ref")


@query("""
with n as (select 'duplicates' as name, count(*) as n_problems from (select 1 from grammar_mcq group by set_id, question_id, generation having count(*) > 1)
union all select 'orphans', count(*) from grammar_mcq where target.ref is not null and target.ref not in (select id from grammar)
union all select 'entries', count(*) from (select id from lexicon group by 1 having count(*) > 1))
select name, n_problems, n_problems = 0 as passed from n""")
def health_report(spark, d):
    """Every check with its number of problems, none left out after a failure."""
    q = table(spark, d, "grammar_mcq").select("rec_id", "set_id", "question_id", "generation", F.col("target.ref").alias("ref"))
    return reference.health_table({
        "duplicates": reference.duplicates(q, ["set_id", "question_id", "generation"], "rec_id"),
        "orphans": reference.orphans(q, "ref", table(spark, d, "grammar"), "id"),
        "entries": reference.duplicates(table(spark, d, "lexicon"), ["id"], "headword"),
    })


_CELLS = """(select set_id, 'level_value' as column_name, 'range' as kind, rec_id from grammar_mcq where level.value is not null and not regexp_full_match(level.value, 'A1\\.[123]|(A2|B1|B2)\\.[12]')
union all select set_id, 'format', 'null', rec_id from grammar_mcq where format is null union all select set_id, 'ref', 'pattern', rec_id from grammar_mcq where target.ref is not null and not regexp_full_match(target.ref, 'gp:[0-9]+(-[0-9]+)?'))"""


def _cells(spark, d) -> DataFrame:
    q = table(spark, d, "grammar_mcq").select("rec_id", "set_id", "format", F.col("level.value").alias("level_value"), F.col("target.ref").alias("ref"))
    rules = {
        "level_value": {"range": F.col("level_value").isNotNull() & levels.fine_rank("level_value").isNull()},
        "format": {"null": F.col("format").isNull()},
        "ref": {"pattern": ~F.col("ref").rlike("^gp:[0-9]+(-[0-9]+)?\\z")},
    }
    found = reference.cell_problems(q, "rec_id", rules)
    return found.join(q.select(F.col("rec_id").alias("key"), "set_id"), "key").select("set_id", "column_name", "kind", F.col("key").alias("rec_id"))


@query(f"""
with p as (select distinct * from {_CELLS}), r as (select *, row_number() over (partition by set_id order by column_name, kind, rec_id) as n_at, count(*) over (partition by set_id) as n_total from p)
select set_id, column_name, kind, rec_id, n_at::int as n_at, n_total from r where n_at <= 3""")
def first_problems(spark, d):
    """A set's first three problems in order, and how many there are."""
    return reference.first_problems(_cells(spark, d), ["set_id"], ["column_name", "kind", "rec_id"], 3)


@query(f"select set_id, column_name, kind, rec_id, row_number() over (order by set_id, rec_id, column_name, kind) as place from (select distinct * from {_CELLS})")
def problems_in_order(spark, d):
    """All problems numbered by sheet (set), row, column and kind, each once."""
    found = _cells(spark, d).distinct()
    return lookup.numbered(found, [F.col(c) for c in ("set_id", "rec_id", "column_name", "kind")], "place")


@query("select id, row_number() over (order by lower(headword), headword, pos, id) as ordinal from lexicon")
def vocabulary_order(spark, d):
    """Each entry's place in the vocabulary's order."""
    return lookup.with_ordinal(table(spark, d, "lexicon")).select("id", "ordinal")


@query("select id, row_number() over (order by split_part(substr(id, 4), '-', 1)::int, contains(id, '-'), case when contains(id, '-') then split_part(substr(id, 4), '-', 2)::int else 0 end) as ordinal from grammar")
def grammar_order(spark, d):
    """Each item's place by its numbers: parents by value, before their children."""
    number = F.substring("id", 4, 99)
    return lookup.numbered(table(spark, d, "grammar").select("id"), levels.number_key(number), "ordinal")


_TOKEN = "'[A-Za-z]+(?:[''’][A-Za-z]+)?|[0-9]+(?:[.,][0-9]+)*(?:st|nd|rd|th)?|[^\\sA-Za-z0-9]'"


@query(f"select id as phrase_id, len(regexp_extract_all(headword, {_TOKEN})) as size, row_number() over (order by len(regexp_extract_all(headword, {_TOKEN})) desc, id) as place from lexicon where is_multiword")
def phrase_order(spark, d):
    """Phrases in the order they are tried: the longest first, ties by id."""
    p = tokens.phrase_patterns(table(spark, d, "lexicon")).select("phrase_id", F.col("size").cast("long").alias("size"))
    return lookup.numbered(p, [F.col("size").desc(), F.col("phrase_id")], "place")


@query("""
with q as (select set_id, target.ref as ref, min(rec_id) as n from grammar_rewrite where target.ref is not null group by 1, 2), u as (select distinct set_id, target.ref as ref from grammar_mcq)
select set_id, arg_min(ref, n) as ref from q where not exists (select 1 from u where u.set_id = q.set_id and u.ref = q.ref) group by 1""")
def next_in_queue(spark, d):
    """Each set's first target in order that its choice questions haven't used."""
    q = table(spark, d, "grammar_rewrite").select("set_id", F.col("target.ref").alias("ref"), "rec_id").where("ref is not null").groupBy("set_id", "ref").agg(F.min("rec_id").alias("n"))
    used = table(spark, d, "grammar_mcq").select("set_id", F.col("target.ref").alias("ref"))
    return attempts.next_in_queue(q, used, ["set_id"], "ref", "n")


_TAGS = tuple(tokens.TAG_POS)


@query(f"""
with t(tag, pos) as (values {", ".join(f"('{t}', '{p[0]}')" for t, p in tokens.TAG_POS.items())}),
x as (select rec_id, ({list(_TAGS + ('TO', 'XX'))!r})[(rec_id % {len(_TAGS) + 2})::int + 1] as tag, (['VERB', 'AUX', 'PART', 'ADP', 'NOUN'])[(rec_id % 5)::int + 1] as upos, (['be', 'have', 'go'])[(rec_id % 3)::int + 1] as lemma from grammar_mcq)
select rec_id, case when upos in ('VERB', 'AUX') and lemma in ('be', 'do', 'have') then lemma || '-verb' when x.tag = 'TO' then case upos when 'PART' then 'infinitive-to' when 'ADP' then 'preposition' end else t.pos end as first_pos from x left join t using (tag)""")
def tag_map(spark, d):
    """The first part of speech to try for tagged tokens, by tag, class and lemma."""
    pick = lambda values: F.get(F.array(*map(F.lit, values)), (F.col("rec_id") % len(values)).cast("int"))
    tried = tokens.vocabulary_pos(pick((*_TAGS, "TO", "XX")), pick(("VERB", "AUX", "PART", "ADP", "NOUN")), pick(("be", "have", "go")))
    return table(spark, d, "grammar_mcq").select("rec_id", F.get(tried, F.lit(0)).alias("first_pos"))


@query("""
with n as (select distinct set_id, question_id, generation, case when rec_id % 7 = 0 then [1] when rec_id % 7 = 1 then [2] when rec_id % 7 = 2 then [1, 2] end as k, rec_id % 2 = 0 as went_on from grammar_rewrite
  qualify row_number() over (partition by set_id, question_id, generation order by rec_id) = 1)
select set_id, question_id, generation, 'candidate' as part, array_to_string(k, ',') as numbers from n where k is not null and (k <> range(1, len(k) + 1) or (len(k) >= 2 and went_on))""")
def invalid_sequences(spark, d):
    """Attempts whose invalid files have a gap, or that went on after the last one allowed, by files named after the questions."""
    q = table(spark, d, "grammar_rewrite").groupBy("set_id", "question_id", "generation").agg(F.min("rec_id").alias("n"))
    n = F.col("n")
    k = F.when(n % 7 == 0, F.array(F.lit(1))).when(n % 7 == 1, F.array(F.lit(2))).when(n % 7 == 2, F.array(F.lit(1), F.lit(2)))
    stem = F.concat("question_id", F.lit("."), "generation", F.lit(".candidate"))
    invalid = q.select("set_id", stem.alias("stem"), F.explode(k).alias("k")).select("set_id", F.concat("stem", F.lit(".invalid"), "k", F.lit(".txt")).alias("name"))
    regular = q.where(n % 2 == 0).select("set_id", F.concat(stem, F.lit(".json")).alias("name"))
    return attempts.invalid_sequences(attempts.classified(invalid.unionByName(regular)), ["set_id", "question_id", "generation"])


@query("""
with f as (select * from (select *, row_number() over w as i, count(*) over (partition by set_id, question_id, generation) as n from vocab_mcq_en2ja window w as (partition by set_id, question_id, generation order by ingested_at, rec_id)) where n > 1),
a as (select * from f where i = 1), b as (select * from f where i = n)
select a.set_id, a.question_id, a.generation, unnest(list_filter([case when a.level is distinct from (case when b.rec_id % 3 = 0 then struct_pack(scale := b.level.scale, value := 'X') else b.level end) then 'level' end, case when a.target is distinct from b.target then 'target' end, case when a.body is distinct from b.body then 'body' end], lambda x: x is not null)) as column_name
from a join b using (set_id, question_id, generation)""")
def redelivered_differences(spark, d):
    """Whole structures of a record's first and last delivery compared; a third of the last ones are given another level."""
    q = table(spark, d, "vocab_mcq_en2ja").select("set_id", "question_id", "generation", "rec_id", "ingested_at", "level", "target", "body")
    key = ["set_id", "question_id", "generation"]
    whole, at = F.struct("level", "target", "body", "rec_id"), F.struct("ingested_at", "rec_id")
    both = q.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min_by(whole, at).alias("a"), F.max_by(whole, at).alias("b")).where("n > 1")
    changed = F.when(F.col("b.rec_id") % 3 == 0, text.with_members("b.level", value=F.lit("X"))).otherwise(F.col("b.level"))
    left = both.select(*key, F.col("a").alias("doc"))
    right = both.select(*key, F.struct(changed.alias("level"), "b.target", "b.body").alias("doc"))
    return attempts.unequal(left, right, key, ["doc.level", "doc.target", "doc.body"])


@query("""
with s as (select c_custkey as n_row, case when c_custkey % 50 = 0 then '  ' else c_name end as a, case when c_custkey % 25 = 0 then null else c_mktsegment end as b from customer),
m as (select max(n_row) as m from s)
select n_row::bigint as n_row, 'blank_inside' as kind from s, m where n_row between 1 and m.m - 20 and trim(coalesce(a, '')) = '' and trim(coalesce(b, '')) = ''
union all select n_row, 'filled_after' from s, m where n_row > m.m - 20 and not (trim(coalesce(a, '')) = '' and trim(coalesce(b, '')) = '')""")
def sheet_slice(spark, d):
    """Blank rows inside a sheet's expected slice and filled ones after it; sheet rows are customers, some blanked."""
    n = F.col("c_custkey")
    s = table(spark, d, "customer").select(n.alias("n_row"), F.when(n % 50 == 0, "  ").otherwise(F.col("c_name")).alias("a"), F.when(n % 25 != 0, F.col("c_mktsegment")).alias("b"))
    last = s.agg(F.max("n_row")).first()[0]
    return reference.slice_problems(s, ["a", "b"], 1, last - 20).withColumn("n_row", F.col("n_row").cast("long"))


@query("select count(*) as n_rows from customer where not (c_custkey % 50 = 0)")
def sheet_rows(spark, d):
    """Rows of a sheet that hold anything."""
    n = F.col("c_custkey")
    s = table(spark, d, "customer").select(F.when(n % 50 == 0, " 　").otherwise(F.col("c_name")).alias("a"), F.when(n % 25 != 0, F.col("c_mktsegment")).alias("b"))
    return reference.not_blank(s, ["a", "b"]).agg(F.count(F.lit(1)).alias("n_rows"))


_HEADERS = ("REGION_1", "NOT_THERE", "AFRICA")


@query(f"""
with h as (select n_nationkey as position, case when n_nationkey < 3 then 'REGION_1' else n_name end as header from nation), w as (select unnest({list(_HEADERS)!r}) as name)
select 'count' as kind, name, (select count(*) from h where header = name)::varchar as found from w where (select count(*) from h where header = name) <> 1
union all select 'absent', name, null from w where name not in (select header from h)
union all select 'place', 'REGION_1', header from h where position = 3 and header <> 'REGION_1'
union all select 'prefix', 'REGION', min(position)::varchar from h where starts_with(header, (select header from h where position = 5)) having count(*) = 1""")
def sheet_headers(spark, d):
    """Headers that don't occur once, are absent, stand elsewhere, and the one place of a prefix; headers are nations' names."""
    h = table(spark, d, "nation").select(F.col("n_nationkey").alias("position"), F.when(F.col("n_nationkey") < 3, "REGION_1").otherwise(F.col("n_name")).alias("header"))
    none = F.lit(None).cast("string")
    parts = [
        reference.header_problems(h, list(_HEADERS)).select(F.lit("count").alias("kind"), "name", F.col("n").cast("string").alias("found")),
        reference.missing_names(h.select(F.col("header").alias("name")), list(_HEADERS), "name").select(F.lit("absent").alias("kind"), "name", none.alias("found")),
        reference.placed_headers(h, {0: "REGION_1", 3: "REGION_1"}).select(F.lit("place").alias("kind"), F.col("wanted").alias("name"), F.col("header").alias("found")),
        reference.prefixed_header(h, h.where("position = 5").first()["header"]).select(F.lit("prefix").alias("kind"), F.lit("REGION").alias("name"), F.col("position").cast("string").alias("found")),
    ]
    return reduce(DataFrame.unionByName, parts)


_ROLES = ("AFRICA", "ASIA", "NOWHERE")


@query(f"""
with m as (select r_name as role, case when r_regionkey = 0 then 'x' else repeat('a', 64) end as sha256, case when r_regionkey = 2 then '2024-02-30' else '2024-01-05' end as retrieved_date from region union all select 'ASIA', repeat('0', 64), '2024-01-05'),
w as (select unnest({list(_ROLES)!r}) as role)
select role, 'count' as kind from w where (select count(*) from m where m.role = w.role) <> 1 union all select role, 'unknown' from m where role not in (select role from w)
union all select role, 'sha256' from m where not regexp_full_match(sha256, '[0-9a-f]{{64}}') union all select role, 'date' from m where try_cast(retrieved_date as date) is null""")
def manifest(spark, d):
    """Problems of a manifest: roles that aren't there once, unknown ones, bad digests and dates."""
    k = F.col("r_regionkey")
    m = table(spark, d, "region").select(F.col("r_name").alias("role"), F.when(k == 0, "x").otherwise(F.repeat(F.lit("a"), 64)).alias("sha256"), F.when(k == 2, "2024-02-30").otherwise("2024-01-05").alias("retrieved_date"))
    more = spark.createDataFrame([("ASIA", "0" * 64, "2024-01-05")], m.schema)
    return readers.manifest_problems(m.unionByName(more), list(_ROLES))


@query("select doc_id, source from documents where doc_id % 2 = 0 union all select doc_id, source from documents where doc_id % 2 = 1")
def published(spark, d):
    """A table written once, then appended to without repeated keys, and read back."""
    t = table(spark, d, "documents").select("doc_id", "source")
    where = fresh_place(spark, "published")
    sinks.publish(t.where("doc_id % 2 = 0"), where, key=["doc_id"])
    sinks.append_new(t.where("doc_id % 2 = 1"), where, ["doc_id"])
    return spark.read.schema(t.schema).parquet(where)


@query("select 'new' as side, count(*) as n from documents where source is not null union all select 'old', count(*) from region")
def replaced_together(spark, d):
    """Two tables of a folder replaced together; the first is replaced again."""
    where = fresh_place(spark, "replaced")
    sinks.replace_together({"a": table(spark, d, "nation"), "b": table(spark, d, "region")}, where)
    sinks.replace_together({"a": table(spark, d, "documents").where("source is not null").select("doc_id")}, where)
    count = lambda name, side: spark.read.parquet(f"{where}/{name}").agg(F.count(F.lit(1)).alias("n")).select(F.lit(side).alias("side"), "n")
    return count("a", "new").unionByName(count("b", "old"))


@query("""
with e as (select id, pos, level, row_number() over (partition by pos, level order by id) - 1 as n from lexicon),
r as (select pos || ':' || level || ':' || (n // 3) as group_id, n % 3 as position, (n // 3) % 7 as no, id as entry_id, pos, level from e),
p as (select group_id, case when no = 1 and position > 0 then position + 1 else position end as position, case when no = 2 and position = 1 then null else entry_id end as entry_id, case when no = 2 and position = 1 then null when no = 5 and position = 0 then 'x' else pos end as pos,
  case when no = 2 and position = 1 then null when no = 3 and position = 0 then 'C9' else level end as level from r where not (no = 4 and position > 0)
  union all select group_id, max(position) + 1, min(entry_id), min(pos), min(level) from r where no = 0 group by 1)
select group_id, kind_order::int as kind_order, kind from (select group_id, count(*) as n, count(*) filter (where pos is null) as n_missing, count(distinct entry_id) as n_ids, count(distinct pos) as n_pos, count(distinct level) as n_levels, max(position) as last from p group by 1),
  lateral (select unnest([1, 2, 3, 4, 5, 6]) as kind_order, unnest(['too_few', 'missing_member', 'repeated_member', 'mixed_pos', 'mixed_level', 'position_gap']) as kind, unnest([n < 2, n_missing > 0, n_ids < n, n_pos > 1, n_levels > 1, last + 1 <> n]) as broken) where broken""")
def group_faults(spark, d):
    """Groups of three entries with planted faults of all six kinds, by the group's number: a member is repeated, misplaced, missing, gone or unlike the others."""
    place = F.row_number().over(attempts.W.partitionBy("pos", "level").orderBy("id")) - 1
    e = table(spark, d, "lexicon").select("id", "pos", "level", place.alias("n"))
    third = F.floor(F.col("n") / 3)
    r = e.select(F.concat_ws(":", "pos", "level", third.cast("string")).alias("group_id"), (F.col("n") % 3).alias("position"), (third % 7).alias("no"), F.col("id").alias("entry_id"), F.col("pos").alias("entry_pos"), F.col("level").alias("entry_level"))
    no, at = F.col("no"), F.col("position")
    gone = (no == 2) & (at == 1)
    own = r.where(~((no == 4) & (at > 0))).select(
        "group_id", F.when((no == 1) & (at > 0), at + 1).otherwise(at).alias("position"), F.when(~gone, F.col("entry_id")).alias("entry_id"),
        F.when(gone, None).when((no == 5) & (at == 0), "x").otherwise(F.col("entry_pos")).alias("entry_pos"), F.when(gone, None).when((no == 3) & (at == 0), "C9").otherwise(F.col("entry_level")).alias("entry_level"),
    )
    again = r.where(no == 0).groupBy("group_id").agg((F.max("position") + 1).alias("position"), F.min("entry_id").alias("entry_id"), F.min("entry_pos").alias("entry_pos"), F.min("entry_level").alias("entry_level"))
    return reference.group_problems(own.unionByName(again))


@query("""
with r as (select rec_id as n, target.display_name as typed, split_part(level.value, '.', 1) as level, case when rec_id % 10 = 0 then 'grammar_cloze' else format end as format from vocab_mcq_en2ja where target.display_name is not null and level.value is not null),
j as (select r.n, r.typed, count(e.id) as n_any, count(e.id) filter (where e.level = r.level) as n_fit, min(e.id) filter (where e.level = r.level) as only_id from r left join lexicon e on lower(e.headword) = lower(r.typed) where format = 'vocab_mcq_en2ja' group by all)
select n, typed, case when n_fit = 1 then 'match' when n_fit > 1 then 'ambiguous_pos' when n_any > 0 then 'level_mismatch' else 'not_in_dictionary' end as status, case when n_fit = 1 then only_id end as entry_id from j
union all select n, typed, 'format_not_allowed', null from r where format is distinct from 'vocab_mcq_en2ja'""")
def resolve_formats(spark, d):
    """Requests resolved where their format is allowed; a tenth ask for another one."""
    q = table(spark, d, "vocab_mcq_en2ja")
    fmt = F.when(F.col("rec_id") % 10 == 0, "grammar_cloze").otherwise(F.col("format"))
    r = q.select(F.col("rec_id").alias("n"), F.col("target.display_name").alias("typed"), levels.band("level.value").alias("level"), F.lit(None).cast("string").alias("pos"), fmt.alias("format"))
    return lookup.resolve(r.where("typed is not null and level is not null"), table(spark, d, "lexicon"), ["vocab_mcq_en2ja"])


@query("select id, display_name from grammar where id = 'gp:2-1'")
def item_by_id(spark, d):
    return lookup.by_id(table(spark, d, "grammar"), "gp:2-1").select("id", "display_name")


@query("""
select rec_id, to_json(struct_pack(ref := target.ref, name := 'x')) = to_json(struct_pack(ref := target.ref, name := case when rec_id % 2 = 0 then 'x' else 'y' end)) as same_whole, true as same_rest from grammar_rewrite where target is not null""")
def structs_compared(spark, d):
    """Two structs compared as a whole and without the member that may differ."""
    q = table(spark, d, "grammar_rewrite").where("target is not null")
    a = text.with_members(text.without_members("target", "type", "display_name"), name=F.lit("x"))
    b = text.with_members(a, name=F.when(F.col("rec_id") % 2 == 0, "x").otherwise("y"))
    return q.select("rec_id", a.eqNullSafe(b).alias("same_whole"), text.without_members(a, "name").eqNullSafe(text.without_members(b, "name")).alias("same_rest"))




@query("""
with t as (select rec_id, body.target_surface as word, case when rec_id % 9 = 0 then 'wo' when rec_id % 9 = 1 then body.target_surface || 'zz' else body.target_surface end as surface, case when rec_id % 9 = 1 then body.headword || 'q' else body.headword end as lemma, (['NN', 'NNP', 'VB', 'NNPS'])[(rec_id % 4)::int + 1] as tag
  from vocab_flashcard_en2ja where body.target_surface is not null and body.headword is not null),
e as (select lower(headword) as w, min(id) as entry_id, bool_or(pos = 'verb') as verb, bool_or(pos = 'noun') as noun from lexicon group by 1),
x as (select t.*, e.entry_id, not case when tag = 'VB' then verb else noun end as fallback from t left join e on e.w = lower(t.lemma))
select rec_id, unnest(list_filter([case when entry_id is not null and fallback then 'W-POS-01' end, case when entry_id is not null and tag in ('NNP', 'NNPS') then 'W-PROPN-01' end,
  case when lower(surface) in ('gon', 'na', 'ca', 'wo', 'sha') or (entry_id is null and lower(lemma) <> lower(surface)) then 'W-LEMMA-01' end], lambda c: c is not null)) as code, surface from x""")
def token_warnings(spark, d):
    """What decisions leave in doubt, over target words with tags by number, some with a fixed lemma or one that finds nothing."""
    n, surface, headword = F.col("rec_id"), F.col("body.target_surface"), F.col("body.headword")
    q = table(spark, d, "vocab_flashcard_en2ja").where(surface.isNotNull() & headword.isNotNull())
    t = q.select("rec_id", F.when(n % 9 == 0, "wo").when(n % 9 == 1, F.concat(surface, F.lit("zz"))).otherwise(surface).alias("surface"), F.when(n % 9 == 1, F.concat(headword, F.lit("q"))).otherwise(headword).alias("lemma"), F.get(F.array(*map(F.lit, ("NN", "NNP", "VB", "NNPS"))), (n % 4).cast("int")).alias("tag"))
    chosen = tokens.pos_choice(t.withColumn("word", F.lower("lemma")), table(spark, d, "lexicon"), tokens.tag_priorities(spark))
    decided = chosen.withColumn("decision", F.when(F.col("entry_id").isNull(), "unknown").otherwise("wordlist_match"))
    return tokens.warnings(decided, ["rec_id"])


@query("""
with t as (select rec_id, body.source_sentence as s, string_split_regex(trim(regexp_replace(body.source_sentence, '[^A-Za-z0-9]+', ' ', 'g')), ' ') as w from grammar_rewrite where regexp_full_match(body.source_sentence, '[A-Za-z]+( [A-Za-z]+)+[.!?]?'))
select rec_id, array_to_string(list_slice(w, 2, 3), ' ') as part, len(w[1]) + 1 as start from t where len(w) >= 3""")
def raw_slices(spark, d):
    """A sentence as it is written from its second token to its third, by the tokens' offsets."""
    q = table(spark, d, "grammar_rewrite").select("rec_id", F.col("body.source_sentence").alias("s")).where(F.col("s").rlike("^[A-Za-z]+( [A-Za-z]+)+[.!?]?\\z"))
    t = q.withColumn("t", tokens.located("s")).where(F.size(F.filter("t", lambda x: x["surface"].rlike("[A-Za-z]"))) >= 3)
    return t.select("rec_id", tokens.slice_of("s", "t", F.lit(1), F.lit(2)).alias("part"), F.get("t", F.lit(1))["start"].cast("long").alias("start"))


@query("select rec_id, rec_id % 4 = 0 as canonical from grammar_rewrite")
def canonical_bytes(spark, d):
    """Whether a text is byte for byte its canonical form; of four, one is: the others have a space too many, members in another order, or no line feed."""
    n, r = F.col("rec_id") % 4, F.col("rec_id").cast("string")
    a, b = F.concat(F.lit('  "a": '), r), F.lit('  "b": "é"')
    x = F.when(n == 0, F.concat(F.lit("{\n"), a, F.lit(",\n"), b, F.lit("\n}\n"))).when(n == 1, F.concat(F.lit("{\n"), a, F.lit(" ,\n"), b, F.lit("\n}\n"))).when(n == 2, F.concat(F.lit("{\n"), b, F.lit(",\n"), a, F.lit("\n}\n"))).otherwise(F.concat(F.lit("{\n"), a, F.lit(",\n"), b, F.lit("\n}")))
    return table(spark, d, "grammar_rewrite").select("rec_id", x.alias("x")).select("rec_id", jsontext.is_canonical("x").alias("canonical"))


@query("select (select count(*) from lexicon) as n_entries, (select count(*) from grammar) as n_items")
def reference_bundle(spark, d):
    """The reference tables behind one check of their counts and digests."""
    tables = {n: table(spark, d, n) for n in ("lexicon", "grammar")}
    counts = {n: t.count() for n, t in tables.items()}
    own = spark.createDataFrame([(n, f"{k:064x}") for n, k in counts.items()], "name string, sha256 string")
    b = readers.Bundle(spark, tables, recorded=own, actual=own, counts=counts)
    n = lambda t, c: b[t].agg(F.count(F.lit(1)).alias(c))
    return n("lexicon", "n_entries").withColumn("one", F.lit(1)).join(n("grammar", "n_items").withColumn("one", F.lit(1)), "one").drop("one")


@query("""
with s as (select distinct set_id, question_id from grammar_mcq where provenance.review_ref is not null), a as (select distinct set_id, question_id from grammar_mcq)
select set_id, question_id, 'left' as side from a where (set_id, question_id) not in (select (set_id, question_id) from s)""")
def slots_without_end(spark, d):
    """Slots none of whose attempts was accepted, and accepted ones without a slot: both sides of one difference."""
    key = F.concat_ws("|", "set_id", "question_id").alias("slot")
    q = table(spark, d, "grammar_mcq")
    found = versions.both_ways(q.select(key), q.where("provenance.review_ref is not null").select(key), "slot")
    return found.select(F.split_part("slot", F.lit("|"), F.lit(1)).alias("set_id"), F.split_part("slot", F.lit("|"), F.lit(2)).alias("question_id"), "side")
