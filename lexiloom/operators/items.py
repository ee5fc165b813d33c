"""Question items of nine formats: which of their members are English texts, which Japanese ones, and the checks that go over all of them.

An item has key columns, ``format``-specific members in ``body``, and for grammar formats ``explanation``. Members that are null or
missing give no text and so break no rule on texts; a choice without is_correct counts as a wrong one.
Checks return rows (key.., code, location, evidence, expected, actual) as in ``checks``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import levels, text
from ..runtime import if_small
from . import checks, lookup, tokens

# The formats in their order, those of vocabulary first.
FORMATS = (
    "vocab_mcq_en2ja", "vocab_mcq_ja2en", "vocab_flashcard_en2ja", "vocab_flashcard_ja2en",
    "grammar_mcq", "grammar_cloze", "grammar_reorder", "grammar_rewrite", "grammar_example_selfcheck",
)
VOCABULARY, GRAMMAR = FORMATS[:4], FORMATS[4:]
# The kinds of sentence that a preceding context may be required by.
CONTEXT_KINDS = ("前文が肯定平叙", "前文が否定平叙")
# The most question numbers of a set.
LAST_NUMBER = 20

_TEXT = "struct<field:string,text:string,sentence:boolean,target:boolean,anchor:string>"
_FILLED = "body.sentence_with_blank#filled:answer"


def _text(field: Column | str, value: Column, *, sentence: bool = True, target: bool = False, anchor: Column | None = None) -> Column:
    name = F.lit(field) if isinstance(field, str) else field
    return F.struct(name.alias("field"), value.alias("text"), F.lit(sentence).alias("sentence"), F.lit(target).alias("target"), (F.lit(None).cast("string") if anchor is None else anchor).alias("anchor"))


def _member(name: str) -> Column:
    return F.col(f"body.{name}")


def _numbered(array: Column, each: Callable[[Column, Column], Column]) -> Column:
    return F.coalesce(F.transform(array, each), F.array().cast(f"array<{_TEXT}>"))


def _at(before: str, i: Column, after: str = "") -> Column:
    return F.concat(F.lit(f"{before}["), i.cast("string"), F.lit(f"]{after}"))


def is_right(choice: Column) -> Column:
    return F.coalesce(choice["is_correct"], F.lit(False))


def right_text() -> Column:
    """Text of the first correct choice."""
    return F.get(F.filter(_member("choices"), is_right), F.lit(0))["text"]


def _filled(answer: Column, sentence: str = "sentence_with_blank") -> Column:
    return text.fill_all(_member(sentence), answer)


def _one(*texts: Column) -> Column:
    return F.array(*texts).cast(f"array<{_TEXT}>")


def english(fmt: str) -> Column:
    """array<struct<field, text, sentence, target, anchor>> of the English texts of a format: sentence tells whether rules on
    sentences hold for it, target whether the target has to occur in it, anchor the entry that a choice declares."""
    context = lambda: _text("body.context_sentence", _member("context_sentence"))
    example = lambda target: _one(_text("body.example.en", F.col("body.example.en"), target=target))
    by_format = {
        "vocab_mcq_en2ja": lambda: _one(_text("body.stem", _member("stem"), target=True)),
        "vocab_mcq_ja2en": lambda: F.concat(
            _one(_text(_FILLED, _member("sentence_complete"), target=True)),
            _numbered(_member("choices"), lambda c, i: _text(_at("body.choices", i, ".text"), c["text"], sentence=False, anchor=c["anchor"]["entry_id"])),
        ),
        "vocab_flashcard_en2ja": lambda: example(True),
        "vocab_flashcard_ja2en": lambda: example(True),
        "grammar_mcq": lambda: F.concat(
            _one(_text(_FILLED, _filled(right_text()))),
            _numbered(_member("choices"), lambda c, i: _text(_at("body.sentence_with_blank#filled:choices", i), F.when(~is_right(c), _filled(c["text"])))),
            _one(context()),
        ),
        "grammar_cloze": lambda: F.concat(
            _one(_text(_FILLED, _filled(_member("answer"))), context()),
            _numbered(_member("answer_equivalents"), lambda e, i: _text(_at("body.answer_equivalents", i), e, sentence=False)),
        ),
        "grammar_reorder": lambda: _one(_text("body.answer_sentence", _member("answer_sentence"))),
        "grammar_rewrite": lambda: _one(
            _text("body.source_sentence", _member("source_sentence")),
            _text("body.target_sentence_with_blank#filled:answer", _filled(_member("answer"), "target_sentence_with_blank")),
        ),
        "grammar_example_selfcheck": lambda: F.concat(example(False), _one(context())),
    }
    return F.filter(by_format[fmt](), lambda t: t["text"].isNotNull())


def japanese(fmt: str) -> Column:
    """array<struct<field, text>> of the members of a format that must be Japanese."""
    plain = lambda *names: F.array(*(F.struct(F.lit(n).alias("field"), F.col(n).alias("text")) for n in names))
    kind = "array<struct<field:string,text:string>>"

    def of_choices(*members: str) -> Column:
        each = F.transform(_member("choices"), lambda c, i: F.array(*(F.struct(_at("body.choices", i, f".{m}").alias("field"), c[m].alias("text")) for m in members)))
        return F.coalesce(F.flatten(each), F.array().cast(kind))

    by_format = {
        "vocab_mcq_en2ja": lambda: F.concat(plain("body.stem_ja"), of_choices("text", "gloss")),
        "vocab_mcq_ja2en": lambda: F.concat(plain("body.stem", "body.sentence_ja"), of_choices("gloss")),
        "vocab_flashcard_en2ja": lambda: plain("body.gloss", "body.example.ja"),
        "vocab_flashcard_ja2en": lambda: plain("body.gloss", "body.example.ja"),
        "grammar_rewrite": lambda: plain("body.instruction", "body.source_ja", "body.target_ja", "explanation.text"),
        "grammar_example_selfcheck": lambda: plain("body.example.ja", "explanation.text"),
    }
    rest = lambda: plain("body.example_ja", "explanation.text")
    return F.filter(by_format.get(fmt, rest)(), lambda t: t["text"].isNotNull())


def english_texts(items: DataFrame, fmt: str, key: list[str]) -> DataFrame:
    """key, format, field, text, sentence, target, anchor: one row per English text."""
    return items.select(*key, F.lit(fmt).alias("format"), F.inline(english(fmt)))


def japanese_texts(items: DataFrame, fmt: str, key: list[str]) -> DataFrame:
    """key, format, field, text: one row per text that must be Japanese."""
    return items.select(*key, F.lit(fmt).alias("format"), F.inline(japanese(fmt)))


def text_problems(items: DataFrame, fmt: str, key: list[str], level: str, word_limits: dict[str, int], explanation_limits: dict[str, int]) -> DataFrame:
    """V-SENT-01 and V-LEN-01 of sentences, V-CLZ-01 of a filled cloze, V-JPN-01 of Japanese members, V-EXP-01 of an explanation, V-SENT-01 of a context's pair."""
    parts = F.concat(
        F.transform(english(fmt), lambda t: F.struct(t["field"].alias("field"), t["text"].alias("text"), t["sentence"].alias("sentence"), F.lit(False).alias("japanese"))),
        F.transform(japanese(fmt), lambda t: F.struct(t["field"].alias("field"), t["text"].alias("text"), F.lit(False).alias("sentence"), F.lit(True).alias("japanese"))),
    )
    rows = items.select(*key, levels.band(level).alias("__band"), F.inline(parts))
    rows = rows.withColumn("__sentences", F.when(F.col("sentence"), tokens.sentence_count("text"))).withColumn("__words", F.when(F.col("sentence"), tokens.word_count("text")))
    most = F.element_at(F.create_map(*(F.lit(x) for kv in word_limits.items() for x in kv)), F.col("__band"))
    where = F.col("field")
    rules = [
        checks.violation("V-SENT-01", where, F.col("__sentences") != 1, expected=F.lit(1), actual=F.col("__sentences")),
        checks.violation("V-LEN-01", where, F.col("__words") > most, expected=most, actual=F.col("__words")),
        checks.violation("V-JPN-01", where, F.col("japanese") & ~text.has_japanese("text")),
    ]
    if fmt == "grammar_cloze":
        rules.append(checks.violation("V-CLZ-01", where, (where == _FILLED) & (F.col("__sentences") != 1)))
    out = checks.apply(rows, rules, key)
    own = []
    if fmt in GRAMMAR:
        limit = F.element_at(F.create_map(*(F.lit(x) for kv in explanation_limits.items() for x in kv)), F.col("explanation.type"))
        n = text.n_characters("explanation.text")
        own.append(checks.violation("V-EXP-01", "explanation.text", n > limit, expected=limit, actual=n))
    if fmt in ("grammar_mcq", "grammar_cloze", "grammar_example_selfcheck"):
        own += context_rules("body.context_sentence", "body.context_required_by")
    return out.unionByName(checks.apply(items, own, key)) if own else out


def context_rules(sentence: str, required_by: str) -> list[Column]:
    """V-SENT-01 of a context: both members or neither, and one of the kinds of sentence there are."""
    kind = F.col(required_by)
    return [
        checks.violation("V-SENT-01", f"{sentence} / {required_by}", F.col(sentence).isNull() != kind.isNull()),
        checks.violation("V-SENT-01", required_by, ~kind.isin(*CONTEXT_KINDS), evidence=kind),
    ]


def ordinal_cap(requested: Column) -> Column:
    """The highest question number that may be tried for so many requested questions."""
    return F.least(2 * requested, F.lit(LAST_NUMBER))


def condition_problems(items: DataFrame, conditions: DataFrame, key: list[str], on: list[str]) -> DataFrame:
    """V-COND-01: items of another format or level than their set's, or with a number beyond the cap.

    conditions: the columns of ``on``, set_format, set_scale, set_value, requested_count; items: format, level, question_id.
    Nulls differ from values and equal each other.
    """
    both = items.join(conditions, on)
    number, most = text.ordinal("question_id"), ordinal_cap(F.col("requested_count"))
    differs = ~(F.col("level.scale").eqNullSafe(F.col("set_scale")) & F.col("level.value").eqNullSafe(F.col("set_value")))
    return checks.apply(both, [
        checks.violation("V-COND-01", "format", ~F.col("format").eqNullSafe(F.col("set_format")), expected=F.col("set_format"), actual=F.col("format")),
        checks.violation("V-COND-01", "level", differs, expected=F.col("set_value"), actual=F.col("level.value")),
        checks.violation("V-COND-01", "question_id", number > most, expected=most, actual=number),
    ], key)


def choice_problems(items: DataFrame, fmt: str, key: list[str]) -> DataFrame:
    """V-CHO-01: four choices, one of them correct, no two alike by the format's key (composed and case kept in Japanese, lower case in English)."""
    own = F.filter(_member("choices"), lambda c: c.isNotNull())
    n, right = F.size(own), F.size(F.filter(own, is_right))
    texts = F.transform(own, lambda c: c["text"])
    norm = text.composed_keys(texts) if fmt == FORMATS[0] else F.transform(texts, text.answer_key)
    rows = items.where(_member("choices").isNotNull()).select(*key, n.alias("n"), right.alias("right"), norm.alias("keys"))
    return checks.apply(rows, [
        checks.violation("V-CHO-01", "body.choices", (F.col("n") != 4) | (F.col("right") != 1), expected=F.lit("4/1"), actual=F.concat_ws("/", F.col("n").cast("string"), F.col("right").cast("string"))),
        checks.violation("V-CHO-01", "body.choices[*].text", F.size(F.array_distinct("keys")) != F.size("keys")),
    ], key)


def target_problems(items: DataFrame, fmt: str, key: list[str], entries: DataFrame, level: str, tagger: tokens.Tagger | None = None) -> DataFrame:
    """V-TGT-02 and V-TGT-03 of vocabulary items: the target is in the vocabulary at the item's level, matches exactly once in the texts it has to occur
    in, and target_surface is what matched, begins at one place only, and (of a blank to be filled in) is the headword and completes the sentence."""
    surface, ref = _member("target_surface"), F.col("target.ref")
    e = entries.select(F.col("id").alias("__id"), F.col("headword").alias("__headword"), F.col("level").alias("__level"))
    e = if_small(e)
    asked = levels.band(level)
    here = [F.col(k) for k in key]
    texts = items.select(*here, ref.alias("__ref"), F.inline(english(fmt))).where("target").select(*key, "__ref", "text")
    own = tokens.phrase_patterns(entries, tagger, single=True)
    spans = tokens.phrase_spans(texts, key, "text", tokens.phrase_patterns(entries, tagger), tagger=tagger, target="__ref", own=own).where("kind = 'target'")
    found = spans.groupBy(*key).agg(F.count(F.lit(1)).alias("__n"), F.array_sort(F.collect_set("written")).alias("__written"))
    both = items.join(e, ref == F.col("__id"), "left").join(found, key, "left").withColumn("__n", F.coalesce("__n", F.lit(0)))
    where = F.array_join(tokens.surfaces(surface), " ")
    rules = [
        checks.violation("V-TGT-03", "target.ref", F.col("__id").isNull() | ~F.col("__level").eqNullSafe(asked), evidence=ref, expected=asked, actual=F.col("__level")),
        checks.violation("V-TGT-02", "target.ref", F.col("__n") != 1, evidence=ref, expected=F.lit(1), actual=F.col("__n")),
        checks.violation("V-TGT-02", "body.target_surface", ~F.coalesce(F.array_contains("__written", where), F.lit(False)), evidence=surface),
    ]
    shown = {FORMATS[0]: "body.stem", FORMATS[2]: "body.example.en", FORMATS[3]: "body.example.en"}.get(fmt)
    if shown:
        rules.append(surface_rule(shown))
    else:
        rules += [
            checks.violation("V-TGT-02", "body.target_surface", F.col("__id").isNotNull() & ~surface.eqNullSafe(F.col("__headword")), evidence=surface, expected=F.col("__headword")),
            checks.violation("V-TGT-02", "body.sentence_complete", ~_filled(surface).eqNullSafe(_member("sentence_complete"))),
        ]
    return checks.apply(both, rules, key)


def surface_rule(shown: str) -> Column:
    """V-TGT-02: target_surface begins at exactly one place of the sentence shown."""
    return checks.violation("V-TGT-02", "body.target_surface#once", ~text.starts_once(_member("target_surface"), shown), evidence=_member("target_surface"))


def anchor_problems(items: DataFrame, fmt: str, key: list[str], entries: DataFrame, level: str) -> DataFrame:
    """V-DIS-01, V-DIS-02 and V-DIS-03 of choices' anchors, a violation each for the member or choice that breaks it.

    V-DIS-01: an anchor is an entry and records its headword, part of speech and level; an English choice is the headword in any case. V-DIS-02:
    a wrong choice has the item's level and the target's part of speech, or a compatible one where the pool is relaxed; a relaxed
    pool uses another part of speech. V-DIS-03: anchors differ, and the correct choice's alone is the target. Choices without an
    anchor take no part; items without choices break nothing.
    """
    ref, relaxed = F.col("target.ref"), F.coalesce(_member("pos_pool_relaxed"), F.lit(False))
    e = entries.select(F.col("id").alias("__id"), F.struct("headword", "pos", "level").alias("__entry"))
    e = if_small(e)
    rows = items.where(_member("choices").isNotNull()).join(e, ref == F.col("__id"), "left")
    t_pos = F.coalesce(F.col("__entry.pos"), text.pos_of(ref))
    rows = rows.select(*key, levels.band(level).alias("__asked"), ref.alias("__ref"), relaxed.alias("__relaxed"), t_pos.alias("__pos"), _member("choices").alias("__choices"))

    each = rows.select(*key, "__asked", "__relaxed", "__pos", F.posexplode("__choices").alias("no", "c")).where("c.anchor is not null")
    each = each.join(e, F.col("c.anchor.entry_id") == F.col("__id"), "left")
    recorded = F.struct("c.anchor.headword", "c.anchor.pos", "c.anchor.level")
    bad = F.col("__id").isNull() | ~recorded.eqNullSafe(F.col("__entry"))
    if fmt == FORMATS[1]:
        bad = bad | ~F.lower("c.text").eqNullSafe(F.lower("__entry.headword"))
    pos = F.col("c.anchor.pos")
    fits = F.when(F.col("__relaxed"), F.coalesce(lookup.compatible_group(pos) == lookup.compatible_group("__pos"), F.lit(False))).otherwise(pos.eqNullSafe(F.col("__pos")))
    wrong = ~is_right(F.col("c"))
    where = _at("body.choices", F.col("no"), ".anchor")
    of_choices = checks.apply(each, [
        checks.violation("V-DIS-01", where, bad, evidence=F.col("c.anchor.entry_id")),
        checks.violation("V-DIS-02", where, wrong & ~(F.col("c.anchor.level").eqNullSafe(F.col("__asked")) & fits), evidence=F.col("c.anchor.entry_id"), expected=F.col("__asked"), actual=F.col("c.anchor.level")),
    ], key)
    used = each.where(wrong & F.col("__relaxed") & F.col("__id").isNotNull() & (pos == F.col("__entry.pos")) & (pos != F.col("__pos"))).select(*key).distinct()
    unused = checks.apply(rows.where("__relaxed").join(used, key, "left_anti"), [checks.violation("V-DIS-02", "body.pos_pool_relaxed", F.lit(True))], key)

    there = F.filter("__choices", lambda c: c["anchor"].isNotNull())
    ids = lambda cs: F.transform(cs, lambda c: c["anchor"]["entry_id"])
    right, others = ids(F.filter(there, is_right)), ids(F.filter(there, lambda c: ~is_right(c)))
    every = ids(there)
    broken = (F.size(F.array_distinct(every)) != F.size(every)) | ~(right == F.array("__ref")) | F.exists(others, lambda i: i.eqNullSafe(F.col("__ref")))
    whole = checks.apply(rows, [checks.violation("V-DIS-03", "body.choices[*].anchor.entry_id", F.coalesce(broken, F.lit(True)), evidence=F.array_join(every, ","))], key)
    return of_choices.unionByName(unused).unionByName(whole)


def form_problems(items: DataFrame, fmt: str, key: list[str]) -> DataFrame:
    """V-ORD-01 and V-ORD-02 of words to be put in order, V-CLZ-02 of equivalent answers, V-RWT-01 of a rewritten sentence."""
    rules = []
    if fmt == "grammar_reorder":
        rules += checks.reordered(_member("tokens_shuffled"), text.answer_tokens("body.answer_sentence"), codes=("V-ORD-01", "V-ORD-02"), location="body.tokens_shuffled")
    if fmt in ("grammar_cloze", "grammar_rewrite"):
        keys = F.transform(_member("answer_equivalents"), text.answer_key)
        broken = F.array_contains(keys, text.answer_key("body.answer")) | (F.size(F.array_distinct(keys)) != F.size(keys))
        rules.append(checks.violation("V-CLZ-02", "body.answer_equivalents", broken))
    if fmt == "grammar_rewrite":
        target = _filled(_member("answer"), "target_sentence_with_blank")
        rules.append(checks.violation("V-RWT-01", "body.source_sentence / body.target_sentence_with_blank#filled:answer", text.sentence_key("body.source_sentence") == text.sentence_key(target)))
    return checks.apply(items, rules, key)


def answer_list(answer: str, equivalents: str) -> Column:
    """The answer, then its equivalents in order."""
    return F.concat(F.array(answer), F.coalesce(equivalents, F.array().cast("array<string>")))
