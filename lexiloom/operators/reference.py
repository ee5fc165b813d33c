"""Building the reference tables: sheet checks, typed rows, inheritance, variant groups, integrity and expectations.

Bad data are rows of a problem table (place, kind, detail), never exceptions; every rule runs, nothing stops early.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import levels, text
from ..runtime import if_small


def not_blank(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows in which any column holds something."""
    filled = [F.coalesce(text.strip(F.col(c).cast("string")) != "", F.lit(False)) for c in columns]
    return rows.where(reduce(lambda a, b: a | b, filled))


def slice_problems(rows: DataFrame, columns: list[str], start: int, end: int) -> DataFrame:
    """n_row, kind: blank rows inside the expected slice, filled ones after it, and expected rows that aren't there."""
    filled = reduce(lambda a, b: a | b, [F.coalesce(text.strip(F.col(c).cast("string")) != "", F.lit(False)) for c in columns])
    kind = F.when(F.col("n_row").between(start, end) & ~filled, "blank_inside").when((F.col("n_row") > end) & filled, "filled_after")
    there = rows.where(F.col("n_row").between(start, end)).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < end - start + 1)
    return rows.select("n_row", kind.alias("kind")).where("kind is not null").unionByName(there.select(F.lit(end).cast("int").alias("n_row"), F.lit("missing_rows").alias("kind")))


def header_problems(headers: DataFrame, expected: list[str]) -> DataFrame:
    """name, n: expected headers (column header) that don't occur exactly once."""
    want = headers.sparkSession.createDataFrame([(e,) for e in expected], "name string")
    n = headers.groupBy(F.col("header").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return want.join(n, "name", "left").select("name", F.coalesce("n", F.lit(0)).alias("n")).where("n != 1")


def prefixed_header(headers: DataFrame, prefix: str) -> DataFrame:
    """The one position whose header begins with prefix; no row where there are none or several."""
    hit = headers.where(F.col("header").startswith(prefix))
    return hit.agg(F.count(F.lit(1)).alias("n"), F.min("position").alias("position")).where("n = 1").select("position")


def placed_headers(headers: DataFrame, expected: dict[int, str]) -> DataFrame:
    """position, wanted, header: places where another header stands than expected."""
    want = headers.sparkSession.createDataFrame(list(expected.items()), "position int, wanted string")
    return want.join(headers, "position", "left").where(~F.col("header").eqNullSafe(F.col("wanted"))).select("position", "wanted", "header")


def missing_names(actual: DataFrame, expected: list[str], column: str) -> DataFrame:
    """Expected names that aren't there."""
    want = actual.sparkSession.createDataFrame([(e,) for e in expected], f"{column} string")
    return want.join(actual, column, "left_anti")


def cell_problems(rows: DataFrame, key: str, rules: dict[str, dict[str, Column]]) -> DataFrame:
    """key, column_name, kind, value: one row per broken rule. rules: column -> kind -> condition that is true where it's broken."""
    checks = [
        F.struct(F.lit(column).alias("column_name"), F.lit(kind).alias("kind"), F.col(column).cast("string").alias("value"), F.coalesce(broken, F.lit(False)).alias("broken"))
        for column, own in rules.items()
        for kind, broken in own.items()
    ]
    # one pass over the rows, however many rules there are
    return rows.select(F.col(key).alias("key"), F.explode(F.filter(F.array(*checks), lambda c: c["broken"])).alias("c")).select("key", "c.column_name", "c.kind", "c.value")


def duplicates(rows: DataFrame, by: list[str], place: str) -> DataFrame:
    """by, n, first_at: keys that occur more than once, with their first place."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first_at")).where("n > 1")


def orphans(children: DataFrame, key: str, parents: DataFrame, parent_key: str) -> DataFrame:
    """Children whose non-null key names no parent."""
    return children.where(F.col(key).isNotNull()).join(parents.select(F.col(parent_key).alias("__p")), F.col(key) == F.col("__p"), "left_anti")


def inherited(items: DataFrame, teacher: DataFrame) -> DataFrame:
    """id, level_min, level_max, source, inherited_from: an item's own row wins, else its parent's.

    items: id, parent_id; teacher: id, level_raw. A row without a readable range gives nothing to inherit.
    """
    ranges = teacher.select("id", levels.level_range("level_raw").alias("r")).where("r is not null")
    own = ranges.select("id", F.col("r").alias("own"))
    above = ranges.select(F.col("id").alias("parent_id"), F.col("r").alias("above"))
    both = items.select("id", "parent_id").join(own, "id", "left").join(above, "parent_id", "left")
    chosen = F.coalesce("own", "above")
    return both.select(
        "id", chosen["min"].alias("level_min"), chosen["max"].alias("level_max"),
        F.when(F.col("own").isNotNull(), "kyoinban_direct").when(F.col("above").isNotNull(), "kyoinban_inherited").alias("source"),
        F.when(F.col("own").isNull() & F.col("above").isNotNull(), F.col("parent_id")).alias("inherited_from"),
    )


def variant_groups(joined: DataFrame, entries: DataFrame) -> DataFrame:
    """One row per variant of each joined headword ('a/b', pos): position, variant, entry_id and how many entries it matched."""
    v = joined.select("headword_joined", "pos", F.posexplode(text.variants("headword_joined")).alias("position", "variant"))
    e = entries.select(F.col("headword").alias("variant"), "pos", "id", "level")
    n = v.join(e, ["variant", "pos"], "left").groupBy("headword_joined", "pos", "position", "variant")
    return n.agg(F.min("id").alias("entry_id"), F.count("id").alias("n_entries"), F.min("level").alias("level"))


def group_problems(members: DataFrame) -> DataFrame:
    """group_id, kind: of bridge rows (group_id, position, entry_id, entry_pos, entry_level), in the fixed order of kinds.

    1 fewer than two members, 2 a member that isn't there, 3 a member twice, 4 several parts of speech, 5 several levels, 6 a gap in positions.
    """
    g = members.groupBy("group_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("entry_pos").isNull()).alias("n_missing"), F.countDistinct("entry_id").alias("n_ids"),
        F.countDistinct("entry_pos").alias("n_pos"), F.countDistinct("entry_level").alias("n_levels"), F.max("position").alias("last"),
    )
    checks = [("too_few", F.col("n") < 2), ("missing_member", F.col("n_missing") > 0), ("repeated_member", F.col("n_ids") < F.col("n")), ("mixed_pos", F.col("n_pos") > 1), ("mixed_level", F.col("n_levels") > 1), ("position_gap", F.col("last") + 1 != F.col("n"))]
    kinds = F.array(*(F.struct(F.lit(i + 1).alias("kind_order"), F.lit(k).alias("kind"), c.alias("broken")) for i, (k, c) in enumerate(checks)))
    return g.select("group_id", F.explode(F.filter(kinds, lambda k: k["broken"])).alias("k")).select("group_id", "k.kind_order", "k.kind")


def histogram_problems(rows: DataFrame, column: str, expected: dict[str, int]) -> DataFrame:
    """value, n_expected, n_actual where a count differs from the expectation, both sides complete."""
    want = rows.sparkSession.createDataFrame(list(expected.items()), "value string, n_expected long")
    have = rows.groupBy(F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n_actual"))
    both = want.join(have, want["value"].eqNullSafe(have["value"]), "full_outer")
    both = both.select(F.coalesce(want["value"], have["value"]).alias("value"), F.coalesce("n_expected", F.lit(0)).alias("n_expected"), F.coalesce("n_actual", F.lit(0)).alias("n_actual"))
    return both.where("n_expected != n_actual")


def expectation_problems(measures: DataFrame, expected: dict[str, int]) -> DataFrame:
    """name, wanted, actual of the single row of measures that isn't as expected."""
    named = F.array(*(F.struct(F.lit(k).alias("name"), F.lit(v).cast("long").alias("wanted"), F.col(k).cast("long").alias("actual")) for k, v in expected.items()))
    return measures.select(F.inline(F.filter(named, lambda m: ~m["wanted"].eqNullSafe(m["actual"]))))


def first_of_group(rows: DataFrame, group: str, place: str) -> DataFrame:
    """rows with first_at: where their group begins. The minimum is taken before the shuffle, so a hot group stays in the tasks that have it."""
    first = rows.groupBy(F.col(group).alias("__group")).agg(F.min(place).alias("first_at"))
    return rows.join(if_small(first), F.col(group).eqNullSafe(F.col("__group"))).drop("__group")


def with_corpus(items: DataFrame, statistics: DataFrame, columns: list[str]) -> DataFrame:
    """items with a corpus's figures per id; null where the corpus has none."""
    return items.join(statistics.select("id", *columns), "id", "left")


def first_problems(problems: DataFrame, place: list[str], order: list[str], most: int) -> DataFrame:
    """problems with n_at (1 to most) and n_total: of each place the first ones in order, repeated ones once, and how many there are."""
    own = problems.select(*place, *order).distinct()
    total = own.groupBy(*place).agg(F.count(F.lit(1)).alias("n_total"))
    first = own.withColumn("n_at", F.row_number().over(W.partitionBy(*place).orderBy(*order))).where(F.col("n_at") <= most)
    return first.join(total, place)


def health_table(checks: dict[str, DataFrame]) -> DataFrame:
    """name, n_problems, passed of every problem table, in one plan."""
    one = [c.agg(F.count(F.lit(1)).alias("n_problems")).select(F.lit(name).alias("name"), "n_problems") for name, c in checks.items()]
    return reduce(DataFrame.unionByName, one).withColumn("passed", F.col("n_problems") == 0)


def health(checks: dict[str, DataFrame | bool]) -> list[dict]:
    """name, passed, n_problems of every check, none skipped after a failure. A check is a problem table or a plain truth."""
    out = []
    for name, check in checks.items():
        try:
            n = int(not check) if isinstance(check, bool) else check.count()
            out.append({"name": name, "passed": n == 0, "n_problems": n})
        except Exception as e:  # a check that breaks is a finding, too
            out.append({"name": name, "passed": False, "n_problems": -1, "error": type(e).__name__})
    return out
