"""Two level scales, their ranks, bands and ranges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _col, strip

# The scales in ascending order, and the highest fine level of each broad one.
BROAD = ("A1", "A2", "B1", "B2")
FINE = ("A1.1", "A1.2", "A1.3", "A2.1", "A2.2", "B1.1", "B1.2", "B2.1", "B2.2")
CEILING = {"A1": "A1.3", "A2": "A2.2", "B1": "B1.2", "B2": "B2.2"}
_FULL, _HALF = "ＡＢＣａｂｃ０１２３４５６７８９．", "ABCabc0123456789."


def _position(scale: tuple[str, ...], level: Column | str) -> Column:
    return F.nullif(F.array_position(F.array(*map(F.lit, scale)), _col(level)), F.lit(0).cast("long")).cast("int")


def broad_rank(level: Column | str) -> Column:
    """1 to 4, null for anything else."""
    return _position(BROAD, level)


def fine_rank(level: Column | str) -> Column:
    """1 to 9, null for anything else."""
    return _position(FINE, level)


def read(level: Column | str) -> Column:
    """A level as it is meant: half-width, upper case, without format characters and outer white space."""
    return F.upper(strip(F.translate(F.regexp_replace(_col(level), "\\p{Cf}", ""), _FULL, _HALF)))


def band(level: Column | str) -> Column:
    """The broad level of a fine one."""
    return F.substring_index(_col(level), ".", 1)


def ceiling(level: Column | str) -> Column:
    """The highest fine level within a broad one."""
    return F.element_at(F.create_map(*(F.lit(x) for kv in CEILING.items() for x in kv)), _col(level))


def level_range(raw: Column | str) -> Column:
    """struct<min, max> of 'X' or 'X-Y' (ascending); null where the text is neither."""
    t = _col(raw)
    low, high = F.split_part(t, F.lit("-"), F.lit(1)), F.split_part(t, F.lit("-"), F.lit(-1))
    one, two = ~t.contains("-") & fine_rank(low).isNotNull(), (fine_rank(low) < fine_rank(high)) & (F.size(F.split(t, "-")) == 2)
    return F.when(F.coalesce(one | two, F.lit(False)), F.struct(low.alias("min"), high.alias("max")))


def contains_rank(rank: Column | str, low: Column | str, high: Column | str) -> Column:
    """Closed-interval containment; a missing bound contains nothing."""
    return F.coalesce(_col(rank).between(_col(low), _col(high)), F.lit(False))


def number_key(number: Column | str) -> list[Column]:
    """Sort columns of '12' and '12-3': parent, parents first, child."""
    n = _col(number)
    return [F.split_part(n, F.lit("-"), F.lit(1)).cast("int"), n.contains("-"), F.coalesce(F.when(n.contains("-"), F.split_part(n, F.lit("-"), F.lit(2))).cast("int"), F.lit(0))]
