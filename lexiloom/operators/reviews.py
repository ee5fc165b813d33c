"""What a review has to agree with: its item, its grammar inventory, its checks and violations, and the machine report it disputes.

Reviews are long tables that share key columns: ``reviews`` (format, level, context, topic, verdict, texts: array<struct<field, text>>), ``checks``
(check_id, result, note), ``inventory`` (item_no, structure, span, level_source, grammar_item_id, level, evidence), ``violations`` (violation_no,
code, location, evidence, expected_level, actual_level), ``disputes`` (code, location), ``report`` (code, location). A problem is a row
(key.., place, kind); every rule runs. Nulls in a compared member count as different from any value.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import levels, text
from ..runtime import if_small
from . import items, matching

# The formats a check applies to, by their places in the list of formats.
CHECK_FORMATS = {
    "CHK-01": (4, 5, 6, 7, 8), "CHK-02": (0, 1, 2, 3), "CHK-03": tuple(range(9)), "CHK-04": tuple(range(9)), "CHK-05": (0, 1, 4, 5, 7),
    "CHK-06": (0, 1), "CHK-07": (4,), "CHK-08": tuple(range(9)), "CHK-09": (3,), "CHK-10": (4, 5, 6, 7, 8), "CHK-11": tuple(range(9)),
    "CHK-12": tuple(range(9)), "CHK-13": tuple(range(9)), "CHK-14": (6,), "CHK-15": (5,), "CHK-16": (7,), "CHK-17": (4, 5, 6, 7, 8),
    "CHK-18": tuple(range(9)), "CHK-19": tuple(range(9)),
}
# Codes whose violations carry levels; the notes of checks that don't apply; the word that marks an inherited level.
LEVEL_CODES = ("CHK-02", "CHK-03", "CHK-04", "CHK-07", "CHK-13")
NUMERALS = "①②③④⑤⑥⑦⑧⑨"
NOT_THIS_FORMAT, ONE_SENTENCE, NO_TOPIC = "形式{}のため", "例文が1文のため", "トピック指定なしのため"
INHERITED = "継承"
# The check on grammar, whose violations belong to items of the inventory; where an item's level comes from.
GRAMMAR_CHECK = "CHK-03"
TEACHER, ESTIMATE = "kyoinban", "reviewer_estimate"


def not_applicable_reason(check_id: Column, fmt: Column, context: Column, topic: Column) -> Column:
    """Why a check doesn't apply to an item, null where it does."""
    applies = F.lit(False)
    for name, own in CHECK_FORMATS.items():
        applies = applies | ((check_id == name) & fmt.isin(*(items.FORMATS[i] for i in own)))
    of_format = F.create_map(*(F.lit(x) for f, n in zip(items.FORMATS, NUMERALS) for x in (f, NOT_THIS_FORMAT.format(n))))
    return (
        F.when(~applies, of_format[fmt])
        .when((check_id == "CHK-17") & context.isNull(), ONE_SENTENCE)
        .when((check_id == "CHK-19") & topic.isNull(), NO_TOPIC)
    )


def teacher_references(grammar: DataFrame) -> DataFrame:
    """id, level_raw, inherited_from, structure of items with a teacher's level of their own, or else their parent's; others have no row."""
    own = F.col("kyoinban.present") & F.col("kyoinban.level_raw").isNotNull()
    g = grammar.select("id", F.coalesce(own, F.lit(False)).alias("own"), F.col("kyoinban.level_raw").alias("level_raw"), F.col("kyoinban.name_ja").alias("structure"), F.col("level.inherited_from").alias("above"))
    direct = g.where("own and structure is not null").select("id", "level_raw", F.lit(None).cast("string").alias("inherited_from"), "structure")
    parent = direct.select(F.col("id").alias("above"), "level_raw", "structure")
    return direct.unionByName(g.where("not own").select("id", "above").join(parent, "above").select("id", "level_raw", F.col("above").alias("inherited_from"), "structure"))


def quotes(evidence: Column, item_id: Column, level_raw: Column, inherited_from: Column) -> Column:
    """Whether evidence names the item, its level and, where that is inherited, the item it comes from, each as a whole token."""
    refs = text.item_refs(evidence)
    heir = inherited_from.isNull() | (F.array_contains(refs, inherited_from) & evidence.contains(INHERITED))
    return F.coalesce(F.array_contains(refs, item_id) & F.array_contains(text.level_refs(evidence), level_raw) & heir, F.lit(False))


def level_limit(fmt: Column, level: Column) -> Column:
    """The highest fine level an item's grammar may have."""
    return F.when(fmt.isin(*items.VOCABULARY), levels.ceiling(level)).otherwise(level)


def _quoted(span: Column) -> Column:
    escaped = F.replace(F.replace(span, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.concat(F.lit('"'), escaped, F.lit('"'))


def _rows(df: DataFrame, key: list[str], place: Column, kinds: dict[str, Column]) -> DataFrame:
    """key, place, kind of all conditions that hold, in one pass."""
    named = F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in kinds.items()))
    return df.select(*key, place.alias("place"), F.explode(F.array_compact(named)).alias("kind"))


def with_references(reviews: DataFrame, inventory: DataFrame, grammar: DataFrame, key: list[str]) -> DataFrame:
    """inventory with its review's level limit, the fields whose text holds the span whole, and its teacher's reference (null where there is none)."""
    r = reviews.select(*key, level_limit(F.col("format"), F.col("level")).alias("limit"), "texts")
    ref = teacher_references(grammar).select(F.col("id").alias("grammar_item_id"), F.struct("level_raw", "inherited_from", "structure").alias("ref"))
    found = F.transform(F.filter("texts", lambda t: text.holds_span(t["text"], F.col("span"))), lambda t: t["field"])
    return inventory.join(r, key).join(if_small(ref), "grammar_item_id", "left").withColumn("fields", found).withColumn("intro", F.substring_index("level", "-", 1)).drop("texts")


def candidate_pairs(own: DataFrame, violations: DataFrame, key: list[str]) -> DataFrame:
    """key, item_no, violation_no, excess: violations of the grammar check that may belong to an item: its level, span and source of level agree.

    own comes from ``with_references``. Rows meet by key and level, so a review's rows are never paired with each other beyond that.
    """
    v = violations.where(F.col("code") == GRAMMAR_CHECK).select(*key, "violation_no", "location", F.col("evidence").alias("v_evidence"), "expected_level", F.col("actual_level").alias("intro"))
    both = own.join(v, [*key, "intro"])
    placed = F.contains("location", _quoted(F.col("span"))) & F.exists("fields", lambda f: F.contains(F.col("location"), f))
    ref = F.col("ref")
    named = lambda e: quotes(e, F.col("grammar_item_id"), ref["level_raw"], ref["inherited_from"])
    by_teacher = (F.col("level_source") == TEACHER) & ref.isNotNull() & (F.col("level") == ref["level_raw"]) & (F.col("structure") == ref["structure"]) & named(F.col("evidence")) & named(F.col("v_evidence"))
    by_estimate = (F.col("level_source") == ESTIMATE) & (F.col("v_evidence") == F.col("evidence")) & F.contains("v_evidence", F.lit(ESTIMATE))
    excess = (levels.fine_rank("intro") > levels.fine_rank("limit")) & (F.col("expected_level") == F.col("limit"))
    return both.where(placed & (by_teacher | by_estimate)).select(*key, "item_no", "violation_no", F.coalesce(excess, F.lit(False)).alias("excess"))


def problems(reviews: DataFrame, checks: DataFrame, inventory: DataFrame, violations: DataFrame, grammar: DataFrame, key: list[str]) -> DataFrame:
    """key, place, kind of everything in which a review disagrees with itself, its item or the grammar table.

    Items above the level limit and violations of the grammar check belong together one to one: as many of them as possible are
    matched, and what is left on either side is a problem.
    """
    own = with_references(reviews, inventory, grammar, key)
    pairs = candidate_pairs(own, violations, key)
    matched = matching.match_pairs(pairs.where("excess"), key, "item_no", "violation_no")
    failed = checks.where("result = 'fail'").select(*key, F.col("check_id").alias("code")).distinct()

    item = F.concat(F.lit("inventory/"), F.col("item_no").cast("string"))
    ref, teacher, estimate = F.col("ref"), F.col("level_source") == TEACHER, F.col("level_source") == ESTIMATE
    grammar_failed = failed.where(F.col("code") == GRAMMAR_CHECK).select(*key, F.lit(True).alias("grammar_failed"))
    seen = own.join(grammar_failed, key, "left").join(matched.select(*key, "item_no", F.lit(True).alias("matched")), [*key, "item_no"], "left")
    excess = levels.fine_rank("intro") > levels.fine_rank("limit")
    of_items = _rows(seen, key, item, {
        "span": F.size("fields") == 0,
        "unresolved": teacher & ref.isNull(),
        "structure": teacher & ref.isNotNull() & ~F.col("structure").eqNullSafe(ref["structure"]),
        "level": teacher & ref.isNotNull() & ~F.col("level").eqNullSafe(ref["level_raw"]),
        "evidence": teacher & ref.isNotNull() & ~quotes(F.col("evidence"), F.col("grammar_item_id"), ref["level_raw"], ref["inherited_from"]),
        "estimated_level": estimate & ~F.coalesce(F.array_contains(text.level_refs("evidence"), F.col("level")), F.lit(False)),
        "estimate_reason": estimate & ~F.coalesce(F.col("evidence").rlike("[\\u3040-\\u30ff\\u3400-\\u9fff]"), F.lit(False)),
        "excess_not_failed": excess & F.col("grammar_failed").isNull(),
        "excess_without_violation": excess & F.col("matched").isNull(),
    })

    limit = reviews.select(*key, level_limit(F.col("format"), F.col("level")).alias("limit"))
    known = pairs.select(*key, "violation_no").distinct().withColumn("known", F.lit(True))
    v = violations.join(limit, key).join(matched.select(*key, "violation_no", F.lit(True).alias("matched")), [*key, "violation_no"], "left").join(known, [*key, "violation_no"], "left")
    expected, actual, code = F.col("expected_level"), F.col("actual_level"), F.col("code")
    of_levels, both = code.isin(*LEVEL_CODES), expected.isNotNull() & actual.isNotNull()
    grammar_check, rank = code == GRAMMAR_CHECK, levels.fine_rank(actual)
    of_violations = _rows(v, key, F.concat(F.lit("violations/"), F.col("violation_no").cast("string")), {
        "surplus": grammar_check & F.col("matched").isNull(),
        "levels_missing": of_levels & ~both,
        "levels_extra": ~of_levels & (expected.isNotNull() | actual.isNotNull()),
        "expected_level": grammar_check & both & (expected != F.col("limit")),
        "actual_level": grammar_check & both & rank.isNull(),
        "not_above": grammar_check & both & (rank <= levels.fine_rank("limit")),
        "without_item": grammar_check & both & rank.isNotNull() & F.col("known").isNull(),
    })

    r = reviews.select(*key, "format", "context", "topic")
    reason = not_applicable_reason(F.col("check_id"), F.col("format"), F.col("context"), F.col("topic"))
    skipped = F.col("result") == "not_applicable"
    of_checks = _rows(checks.join(r, key), key, F.col("check_id"), {
        "applies": reason.isNull() & skipped,
        "not_applicable": reason.isNotNull() & ~F.coalesce(skipped & (F.col("note") == reason), F.lit(False)),
    })
    codes = violations.select(*key, "code").distinct()
    unfounded = failed.join(codes, [*key, "code"], "left_anti").select(*key, F.col("code").alias("place"), F.lit("failed_without_violation").alias("kind"))
    unfailed = codes.join(failed, [*key, "code"], "left_anti").select(*key, F.col("code").alias("place"), F.lit("violation_without_failure").alias("kind"))
    empty = reviews.join(inventory.select(*key).distinct(), key, "left_anti").select(*key, F.lit("inventory").alias("place"), F.lit("empty").alias("kind"))
    verdict = reviews.select(*key, "verdict").join(failed.select(*key).distinct().withColumn("failed", F.lit(True)), key, "left")
    verdict = _rows(verdict, key, F.lit("verdict"), {"verdict": ~F.col("verdict").eqNullSafe(F.when(F.col("failed"), "fail").otherwise("pass"))})
    return reduce(DataFrame.unionByName, [of_items, of_violations, of_checks, unfounded, unfailed, empty, verdict])


def unknown_disputes(disputes: DataFrame, report: DataFrame, key: list[str]) -> DataFrame:
    """Disputes whose code and place the machine report doesn't have."""
    return disputes.join(report.select(*key, "code", "location").distinct(), [*key, "code", "location"], "left_anti")


def composed(items_: DataFrame, machine: DataFrame, reviewed: DataFrame, key: list[str]) -> DataFrame:
    """key, n_violations, review, verdict: an item fails with a machine violation or a failed review; without a review it is 'pending' unless it fails."""
    n = machine.groupBy(*key).agg(F.count(F.lit(1)).alias("n_violations"))
    both = items_.select(*key).join(n, key, "left").join(reviewed.select(*key, F.col("verdict").alias("review")), key, "left").withColumn("n_violations", F.coalesce("n_violations", F.lit(0)))
    verdict = F.when((F.col("n_violations") > 0) | (F.col("review") == "fail"), "fail").when(F.col("review").isNull(), "pending").otherwise("pass")
    return both.select(*key, "n_violations", "review", verdict.alias("verdict"))
