"""Look-ups over the leveled vocabulary and grammar tables.

Filters combine with AND and reach the Parquet scan; a page is a top-k by a stable order, never the order of files. The total is
counted before the limit. No match is an empty page with total 0; contradicting options are errors before any job starts.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import levels, text
from ..runtime import materialise

CATEGORIES = ("core_inventory_1", "core_inventory_2", "threshold")
MAX_PAGE = 200


class InputError(ValueError):
    """Options that contradict each other or are out of range."""


def one_of(name: str, value: str | None, allowed: tuple[str, ...]) -> str | None:
    """An option's value, if it is one of those there are."""
    if value is not None and value not in allowed:
        raise InputError(f"{name} must be one of {', '.join(allowed)}")
    return value


def exclusive(**options) -> None:
    """Refuses options given together of which only one may be; a tuple stands for options that go together."""
    given = [n for n, v in options.items() if (any(x is not None for x in v) if isinstance(v, tuple) else v is not None)]
    if len(given) > 1:
        raise InputError(f"{' and '.join(given)} can't be combined")


# Fixed value: what the id of a grammar item looks like.
ITEM_ID = "gp:[0-9]+(-[0-9]+)?"


def by_id(items: DataFrame, item_id: str, pattern: str = ITEM_ID) -> DataFrame:
    """The row of an id; an id that doesn't look like one is refused before any job starts."""
    if not isinstance(item_id, str) or not re.fullmatch(pattern, item_id):
        raise InputError(f"no id: {item_id!r}")
    return items.where(F.col("id") == item_id)


def _limit(limit: int) -> int:
    if isinstance(limit, bool) or not isinstance(limit, int) or not 1 <= limit <= MAX_PAGE:
        raise InputError(f"limit must be 1 to {MAX_PAGE}")
    return limit


def in_order(entries: DataFrame) -> list[Column]:
    """The vocabulary's order: folded headword, headword, part of speech, id."""
    return [text.folded_key("headword"), F.col("headword"), F.col("pos"), F.col("id")]


def with_ordinal(entries: DataFrame, order: list[Column] | None = None, name: str = "ordinal") -> DataFrame:
    """entries with their place from 1 in an order (by default the vocabulary's), which has to be a total one."""
    return numbered(entries, order or in_order(entries), name)


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """rows with a running number from 1 in the given order, at any size: range partitions are sorted and counted, and each
    one's rows are numbered from where those before it end."""
    fields = rows.columns
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    # the number's high bits name the partition; the range bounds are drawn from a sample, so the parts are fixed before they are counted
    placed = materialise(placed, "numbered").withColumn("__part", F.shiftright("__at", 33))
    # one row per partition
    ends = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = ends.withColumn("__before", F.coalesce(F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    place = F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return placed.join(F.broadcast(before), "__part").select(*fields, place.alias(name))


def in_category(category: str) -> Column:
    """Whether any of the three columns names the category."""
    return F.coalesce(F.lit(category).isin(*map(F.col, CATEGORIES)), F.lit(False))


def filtered(entries: DataFrame, *, headword: str | None = None, pos: str | None = None, level: str | None = None, category: str | None = None) -> DataFrame:
    """All given filters at once; a headword also finds the members of every group that an entry of this headword is in."""
    found = entries
    for column, value in (("pos", pos), ("level", level)):
        if value is not None:
            found = found.where(F.col(column) == value)
    if category is not None:
        found = found.where(in_category(category))
    if headword is not None:
        found = found.join(expanded(entries, headword), "id", "left_semi")
    return found


def expanded(entries: DataFrame, headword: str) -> DataFrame:
    """id of the entries with this headword, in any case, and of all members of their groups."""
    direct = entries.where(text.folded_key("headword") == text.folded_key(F.lit(headword)))
    groups = direct.select(F.explode("group_ids").alias("group_id")).distinct()
    members = entries.select("id", F.explode("group_ids").alias("group_id")).join(groups, "group_id", "left_semi").select("id")
    return direct.select("id").union(members).distinct()


def page(found: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """The first rows in the given order, with total: the rows before the limit."""
    limit = _limit(limit)
    return found.orderBy(*order).limit(limit).withColumn("total", F.lit(found.count()).cast("long"))


def pools(targets: DataFrame, entries: DataFrame, k: int) -> DataFrame:
    """For each target entry, the k other entries of its level and part of speech that suit best, with rank.

    A shared category comes first, in the order first inventory, threshold, second inventory; then the vocabulary's order.
    """
    t = targets.select(F.col("id").alias("target_id"), "level", "pos", *(F.col(c).alias(f"t_{c}") for c in CATEGORIES))
    both = t.join(entries, ["level", "pos"]).where("id != target_id")
    same = lambda c: F.coalesce(F.col(c) == F.col(f"t_{c}"), F.lit(False))
    first = F.when(same("core_inventory_1"), 0).when(same("threshold"), 1).when(same("core_inventory_2"), 2).otherwise(3)
    ranked = both.withColumn("priority", first).withColumn("rank", F.row_number().over(W.partitionBy("target_id").orderBy("priority", *in_order(entries))))
    return ranked.where(F.col("rank") <= k).select("target_id", "id", "priority", "rank")


#: Parts of speech that may stand in for one another in a relaxed pool.
COMPATIBLE = (
    ("noun", "number"),
    ("verb", "be-verb", "do-verb", "have-verb", "modal auxiliary"),
    ("adjective", "determiner"),
    ("adverb",),
    ("pronoun", "preposition", "conjunction", "interjection", "infinitive-to"),
)


def compatible_group(pos: Column | str) -> Column:
    """Number of the compatible group of a part of speech, null outside all."""
    c = F.col(pos) if isinstance(pos, str) else pos
    out = F.lit(None).cast("int")
    for i, group in enumerate(COMPATIBLE):
        out = F.when(c.isin(*group), F.lit(i)).otherwise(out)
    return out


def relaxed_pools(targets: DataFrame, entries: DataFrame, k: int, *, least: int = 3) -> DataFrame:
    """Pools of the same part of speech, widened to compatible ones only where these have fewer than ``least`` rows."""
    t = targets.select(F.col("id").alias("target_id"), "level", F.col("pos").alias("t_pos"), compatible_group("pos").alias("pos_group"))
    e = entries.withColumn("pos_group", compatible_group("pos"))
    strict = t.join(e.select("id", "level", F.col("pos").alias("t_pos"), "headword", "pos"), ["level", "t_pos"]).where("id != target_id").withColumn("relaxed", F.lit(0))
    few = t.join(strict.groupBy("target_id").agg(F.count(F.lit(1)).alias("n")), "target_id", "left").where(F.coalesce("n", F.lit(0)) < least)
    wide = few.join(e.select("id", "level", "pos_group", "headword", "pos"), ["level", "pos_group"]).where("id != target_id and pos != t_pos").withColumn("relaxed", F.lit(1))
    columns = ["target_id", "id", "relaxed", "headword", "pos"]
    both = strict.select(*columns).unionByName(wide.select(*columns))
    rank = F.row_number().over(W.partitionBy("target_id").orderBy("relaxed", *in_order(entries)))
    return both.withColumn("rank", rank).where(F.col("rank") <= k).select("target_id", "id", "relaxed", "rank")


def grammar_at(items: DataFrame, level: str | None = None, *, keyword: str | None = None, exclude: list[str] | None = None, column: str = "parent_id") -> DataFrame:
    """Target-eligible grammar items whose range contains a fine level; a keyword in the name or the simple name, in any case; none of
    the excluded values of a column (parents, kinds of sentence). A null value is never excluded."""
    found = items
    if level is not None:
        one_of("level", level, levels.FINE)
        found = found.where(F.col("target_eligible") & levels.contains_rank(levels.fine_rank(F.lit(level)), levels.fine_rank("level.min"), levels.fine_rank("level.max")))
    if keyword is not None:
        key = text.folded_key(F.lit(keyword))
        either = [F.coalesce(F.contains(text.folded_key(c), key), F.lit(False)) for c in ("item_list.name_ja", "kyoinban.name_simple_ja")]
        found = found.where(either[0] | either[1])
    if exclude:
        found = found.where(~F.coalesce(F.col(column).isin(*exclude), F.lit(False)))
    return found


def containing(points: DataFrame, rank: str, ranges: DataFrame, low: str, high: str) -> DataFrame:
    """Rows of points with the ranges that contain their rank: ranges are small steps, so they become an equi-join."""
    steps = ranges.where(F.col(low) <= F.col(high)).withColumn("__step", F.explode(F.sequence(low, high)))
    return points.join(steps, F.col(rank) == F.col("__step")).drop("__step")


def resolve(requests: DataFrame, entries: DataFrame, formats: list[str] | None = None) -> DataFrame:
    """Each request (n, typed, level, pos or null; with formats also format) with status and the matching entry.

    match (exactly one), level_mismatch, not_in_dictionary, or ambiguous_pos; the request is read as typed text. Of formats outside those
    given every request is format_not_allowed.
    """
    if formats is not None:
        barred = requests.where(~F.coalesce(F.col("format").isin(*formats), F.lit(False)))
        barred = barred.select("n", "typed", F.lit("format_not_allowed").alias("status"), F.lit(None).cast("string").alias("entry_id"))
        return resolve(requests.where(F.col("format").isin(*formats)), entries).unionByName(barred)
    r = requests.withColumn("key", text.folded_key(text.half_width("typed")))
    e = entries.select(text.folded_key("headword").alias("key"), F.col("id").alias("entry_id"), F.col("level").alias("entry_level"), F.col("pos").alias("entry_pos"))
    both = r.join(e, "key", "left")
    fits_pos = F.col("entry_id").isNotNull() & F.coalesce(F.col("pos") == F.col("entry_pos"), F.lit(True))
    fits = fits_pos & (F.col("entry_level") == F.col("level"))
    seen = both.groupBy("n", "typed", "level", "pos").agg(
        F.count_if(F.col("entry_id").isNotNull()).alias("n_any"), F.count_if(fits_pos).alias("n_pos"), F.count_if(fits).alias("n_fit"), F.min(F.when(fits, F.col("entry_id"))).alias("only")
    )
    status = F.when(F.col("n_fit") == 1, "match").when(F.col("n_fit") > 1, "ambiguous_pos").when(F.col("n_pos") > 0, "level_mismatch").otherwise("not_in_dictionary")
    return seen.select("n", "typed", status.alias("status"), F.when(F.col("n_fit") == 1, F.col("only")).alias("entry_id"))


def first_of_each(requests: DataFrame, by: str, ordinal: str, within: list[str] | None = None) -> DataFrame:
    """Requests without repeats, their order kept."""
    return requests.withColumn("__n", F.row_number().over(W.partitionBy(*(within or []), by).orderBy(ordinal))).where("__n = 1").drop("__n")


def replacements(pool: DataFrame, shown: DataFrame, key: str) -> DataFrame:
    """The pool's rows not shown yet; their order is the pool's."""
    return pool.join(shown.select(key).distinct(), key, "left_anti")
