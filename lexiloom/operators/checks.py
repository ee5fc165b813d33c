"""Checks of question items: every check returns the same long rows, a verdict is an aggregate over them.

A row is (key.., code, location, evidence, expected, actual). Data failures are rows; all checks run on all items.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import levels, text
from ..runtime import if_small
from . import lookup, tokens

KEY = ["rec_id"]


def violation(code: str, location: str | Column, broken: Column, *, evidence: Column | None = None, expected: Column | None = None, actual: Column | None = None) -> Column:
    """One check as a struct; unknown (null) conditions aren't violations."""
    none = F.lit(None).cast("string")
    as_text = lambda c: none if c is None else c.cast("string")
    return F.struct(F.lit(code).alias("code"), (F.lit(location) if isinstance(location, str) else location).alias("location"), as_text(evidence).alias("evidence"), as_text(expected).alias("expected"), as_text(actual).alias("actual"), F.coalesce(broken, F.lit(False)).alias("broken"))


def apply(items: DataFrame, checks: list[Column], key: list[str] = KEY) -> DataFrame:
    """All checks in one pass over the items."""
    broken = F.filter(F.array(*checks), lambda c: c["broken"])
    return items.select(*key, F.explode(broken).alias("c")).select(*key, "c.code", "c.location", "c.evidence", "c.expected", "c.actual")


def one_sentence(column: str, location: str) -> Column:
    n = tokens.sentence_count(column)
    return violation("sentence_count", location, n != 1, expected=F.lit(1), actual=n)


def paired(a: str, b: str, location: str) -> Column:
    """Two members that are null together or set together."""
    return violation("half_pair", location, F.col(a).isNull() != F.col(b).isNull())


def word_limit(column: str, location: str, level: Column | str, limits: dict[str, int]) -> Column:
    """No more words than the band of the item's level allows."""
    most = F.element_at(F.create_map(*(F.lit(x) for kv in limits.items() for x in kv)), levels.band(level))
    n = tokens.word_count(column)
    return violation("too_many_words", location, n > most, expected=most, actual=n)


def length_limit(column: str, location: str, kind: Column | str, limits: dict[str, int]) -> Column:
    """No more characters than the kind of text allows."""
    most = F.element_at(F.create_map(*(F.lit(x) for kv in limits.items() for x in kv)), F.col(kind) if isinstance(kind, str) else kind)
    n = text.n_characters(column)
    return violation("too_long", location, n > most, expected=most, actual=n)


def japanese(column: str, location: str) -> Column:
    return violation("no_japanese", location, F.col(column).isNotNull() & ~text.has_japanese(column))


def choices(column: str, key: str, *, n: int = 4) -> list[Column]:
    """n choices, one of them correct, no two alike by their key: 'answer' (stripped, lower case) or 'choice' (stripped, composed)."""
    own = F.filter(F.col(column), lambda c: c.isNotNull())
    texts = F.transform(own, lambda c: c["text"])
    keys = F.transform(texts, text.answer_key) if key == "answer" else text.composed_keys(texts)
    right = F.size(F.filter(own, lambda c: F.coalesce(c["is_correct"], F.lit(False))))
    return [
        violation("choice_count", column, F.size(own) != n, expected=F.lit(n), actual=F.size(own)),
        violation("correct_count", column, right != 1, expected=F.lit(1), actual=right),
        violation("same_choice", column, F.size(F.array_distinct(keys)) != F.size(keys)),
    ]


def correct_choice(column: str) -> Column:
    """The one correct choice, null unless there is exactly one."""
    right = F.filter(F.col(column), lambda c: F.coalesce(c["is_correct"], F.lit(False)))
    return F.when(F.size(right) == 1, right[0])


def wrong_fills(items: DataFrame, sentence: str, column: str, key: list[str] = KEY) -> DataFrame:
    """key, choice_no, filled: the sentence with each wrong choice in its blank."""
    rows = items.select(*key, F.col(sentence).alias("__s"), F.posexplode(column).alias("choice_no", "c"))
    return rows.where("c.text is not null and not c.is_correct").select(*key, "choice_no", text.fill_all("__s", "c.text").alias("filled"))


def anchors(items: DataFrame, column: str, entries: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Violations of choices' anchors: not in the vocabulary, recorded values that differ from it, wrong choices of an incompatible part of speech.

    What a question's level, target and relaxed flag ask of its anchors is in ``anchor_rules``.
    """
    rows = items.select(*key, F.posexplode(column).alias("choice_no", "c")).where("c.anchor is not null")
    e = entries.select(F.col("id").alias("e_id"), F.col("headword").alias("e_headword"), F.col("pos").alias("e_pos"), F.col("level").alias("e_level"))
    e = if_small(e)
    joined = rows.join(e, F.col("c.anchor.entry_id") == F.col("e_id"), "left")
    differs = reduce(lambda a, b: a | b, [~F.col(f"c.anchor.{m}").eqNullSafe(F.col(f"e_{m}")) for m in ("headword", "pos", "level")])
    right = joined.where("c.is_correct").select(*key, lookup.compatible_group("e_pos").alias("t_group"), F.col("e_pos").alias("t_pos")).dropDuplicates(key)
    both = joined.join(right, key, "left")
    place = F.concat(F.lit("choices/"), F.col("choice_no").cast("string"))
    there = F.col("e_id").isNotNull()
    checks = [
        violation("anchor_missing", "anchor", ~there, evidence=F.col("c.anchor.entry_id")),
        violation("anchor_differs", "anchor", there & differs, evidence=F.col("c.anchor.entry_id")),
        violation("distractor_pos", "anchor", there & ~F.col("c.is_correct") & (F.col("e_pos") != F.col("t_pos")) & ~F.coalesce(lookup.compatible_group("e_pos") == F.col("t_group"), F.lit(False)), expected=F.col("t_pos"), actual=F.col("e_pos")),
    ]
    return apply(both.withColumn("place", place), checks, [*key, "place"]).drop("location").withColumnRenamed("place", "location").select(*key, "code", "location", "evidence", "expected", "actual")


def anchor_rules(items: DataFrame, column: str, level: str, ref: str, relaxed: str, entries: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Violations of what a question asks of its choices' anchors, by the values they record.

    distractor_level, distractor_pos: a wrong choice has the question's level and the target's part of speech, or a compatible one where the
    pool is relaxed. relaxed_unused: a relaxed pool has a wrong choice of another part of speech. anchor_repeated, correct_not_target,
    wrong_is_target: anchors are distinct, and the one correct choice's alone is the target. Choices without an anchor, and a question's
    missing level, target or choices, break nothing here; a question without a correct choice does.
    """
    e = entries.select(F.col("id").alias("e_id"), F.col("pos").alias("e_pos"))
    e = if_small(e)
    t_pos = F.coalesce("e_pos", text.pos_of("__ref")).alias("t_pos")
    rows = items.select(*key, F.col(column).alias("__own"), levels.band(levels.read(level)).alias("__level"), F.col(ref).alias("__ref"), F.coalesce(relaxed, F.lit(False)).alias("__relaxed"))
    rows = rows.join(e, F.col("__ref") == F.col("e_id"), "left").select(*key, "__own", "__level", "__ref", "__relaxed", t_pos)
    is_right = lambda c: F.coalesce(c["is_correct"], F.lit(False))

    wrong = rows.select(*key, "__level", "__relaxed", "t_pos", F.posexplode("__own").alias("choice_no", "c")).where(F.col("c.anchor").isNotNull() & ~is_right(F.col("c")))
    own_pos = F.col("c.anchor.pos")
    fits = F.when(F.col("__relaxed"), F.coalesce(lookup.compatible_group(own_pos) == lookup.compatible_group("t_pos"), F.lit(False))).otherwise(own_pos.eqNullSafe(F.col("t_pos")))
    each = apply(wrong.withColumn("place", F.concat(F.lit("choices/"), F.col("choice_no").cast("string"))), [
        violation("distractor_level", "anchor", F.col("__level").isNotNull() & ~F.col("c.anchor.level").eqNullSafe(F.col("__level")), evidence=F.col("c.anchor.entry_id"), expected=F.col("__level"), actual=F.col("c.anchor.level")),
        violation("distractor_pos", "anchor", F.col("t_pos").isNotNull() & ~fits, evidence=F.col("c.anchor.entry_id"), expected=F.col("t_pos"), actual=own_pos),
    ], [*key, "place"]).drop("location").withColumnRenamed("place", "location").select(*key, "code", "location", "evidence", "expected", "actual")

    used = wrong.where("__relaxed and c.anchor.pos <> t_pos").join(e, (F.col("c.anchor.entry_id") == F.col("e_id")) & (own_pos == F.col("e_pos"))).select(*key).distinct()
    relaxed_rows = rows.where(F.col("__relaxed") & F.col("__own").isNotNull() & F.col("t_pos").isNotNull())
    unused = apply(relaxed_rows.join(used, key, "left_anti"), [violation("relaxed_unused", "pos_pool_relaxed", F.lit(True))], key)

    there = F.filter("__own", lambda c: c.isNotNull())
    ids = lambda cs: F.transform(cs, lambda c: c["anchor"]["entry_id"])
    known = F.filter(ids(there), lambda i: i.isNotNull())
    right, others = ids(F.filter(there, is_right)), ids(F.filter(there, lambda c: ~is_right(c)))
    whole = apply(rows.where("__own is not null"), [
        violation("anchor_repeated", "choices", F.size(F.array_distinct(known)) != F.size(known), evidence=F.array_join(known, ",")),
        violation("correct_not_target", "choices", F.col("__ref").isNotNull() & ((F.size(right) != 1) | ~F.get(right, F.lit(0)).eqNullSafe(F.col("__ref"))), evidence=F.array_join(right, ","), expected=F.col("__ref")),
        violation("wrong_is_target", "choices", F.array_contains(others, F.col("__ref")), evidence=F.col("__ref")),
    ], key)
    return each.unionByName(unused).unionByName(whole)


def targets(items: DataFrame, ref: str, table: DataFrame, key: list[str] = KEY, *, level: str | None = None) -> DataFrame:
    """Violations of target references that the table (column id) doesn't have; with level, also of those whose entry has another level than the item.

    An item's level counts by its band as it is meant; where it is missing, nothing is known to differ.
    """
    none = F.lit(None).cast("string")
    t = table.select(F.col("id").alias("__id"), (F.col("level") if level else none).alias("__actual"))
    t = if_small(t)
    asked = levels.band(levels.read(level)) if level else none
    joined = items.where(F.col(ref).isNotNull()).withColumn("__asked", asked).join(t, F.col(ref) == F.col("__id"), "left")
    there = F.col("__id").isNotNull()
    checks = [violation("target_missing", "target/ref", ~there, evidence=F.col(ref))]
    if level:
        differs = there & F.col("__asked").isNotNull() & ~F.col("__actual").eqNullSafe(F.col("__asked"))
        checks.append(violation("target_level", "target/ref", differs, evidence=F.col(ref), expected=F.col("__asked"), actual=F.col("__actual")))
    return apply(joined, checks, key)


def out_of_range(items: DataFrame, ref: str, level: str, grammar: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Violations of grammar targets that aren't eligible or whose range doesn't contain the item's level."""
    g = grammar.select(F.col("id").alias("__id"), "target_eligible", F.col("level.min").alias("low"), F.col("level.max").alias("high"))
    joined = items.join(g, F.col(ref) == F.col("__id"))
    fits = F.col("target_eligible") & levels.contains_rank(levels.fine_rank(level), levels.fine_rank("low"), levels.fine_rank("high"))
    return apply(joined, [violation("target_range", "target/ref", ~fits, evidence=F.col(ref), expected=F.concat_ws("-", "low", "high"), actual=F.col(level))], key)


def reordered(shuffled: Column, answer: Column, *, codes: tuple[str, str] = ("other_tokens", "same_order"), location: str = "tokens") -> list[Column]:
    """Tokens that must be the answer's, as often, but in another order."""
    return [
        violation(codes[0], location, F.array_sort(shuffled) != F.array_sort(answer)),
        violation(codes[1], location, shuffled == answer),
    ]


def equivalents(answer: str, others: str) -> list[Column]:
    """Equivalent answers that repeat the answer or one another."""
    keys = F.transform(F.col(others), lambda o: F.lower(text.strip(o)))
    return [
        violation("equivalent_is_answer", others, F.array_contains(keys, text.answer_key(answer))),
        violation("same_equivalent", others, F.size(F.array_distinct(keys)) != F.size(keys)),
    ]


def unchanged(source: str, target: str, answer: str) -> Column:
    """A rewritten sentence that equals its source."""
    return violation("same_sentence", target, text.sentence_key(source) == text.sentence_key(text.fill_all(target, answer)))


def reuse(rows: DataFrame, within: list[str], by: str, member: str, *, most: int = 1) -> DataFrame:
    """within, by, n, members (joined, in order): values that more than ``most`` distinct members share."""
    g = rows.where(F.col(by).isNotNull()).groupBy(*within, by).agg(F.countDistinct(member).alias("n"), F.array_join(F.array_sort(F.collect_set(F.col(member).cast("string"))), ",").alias("members"))
    return g.where(F.col("n") > most)
