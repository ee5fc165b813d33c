"""Closed contracts for JSON texts: a rule tree, checked batch by batch, one problem row per broken rule.

A rule is a dict; its members are the common assertions: type, required, properties (nothing else is allowed unless open is true), items,
pattern, enum, const, min_length, max_length, minimum, maximum, min_items, max_items, unique, contains (how many items may fit:
min_contains, by default one, and max_contains), and one_of with a discriminator: {"tag": "format", "one_of": {"a": rule, ...}} checks only the branch the tag names, so errors come from it alone.
Numbers are compared exactly as written; booleans aren't numbers; lengths are code points of the composed text.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.jsontext import Exact, read_strict, write_canonical

Problem = tuple[str, str]


def _kind(v) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, Exact):
        return "integer" if v.value == v.value.to_integral_value() else "number"
    return {str: "string", list: "array", dict: "object"}[type(v)]


def _is(v, wanted: str) -> bool:
    kind = _kind(v)
    return kind == wanted or (wanted == "number" and kind == "integer")


def _step(at: str, member: str | int) -> str:
    return f"{at}/{str(member).replace('~', '~0').replace('/', '~1')}"


def _same(v, wanted) -> bool:
    if isinstance(v, Exact):
        return isinstance(wanted, (int, float, str, Decimal)) and not isinstance(wanted, (bool, str)) and v.value == Decimal(str(wanted))
    return type(v) is type(wanted) and v == wanted


def problems(v, rule: dict, at: str = "") -> list[Problem]:
    """(pointer, what) of every broken rule, in document order."""
    kinds = rule.get("type")
    if kinds and not any(_is(v, k) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        return [(at, f"type {_kind(v)}")]
    out: list[Problem] = []
    say = lambda what, where=at: out.append((where, what))
    if "one_of" in rule:
        tag = v.get(rule["tag"]) if isinstance(v, dict) else None
        branch = rule["one_of"].get(tag) if isinstance(tag, str) else None
        if branch is None:
            return [(_step(at, rule["tag"]), "tag")]
        out += problems(v, branch, at)
    if "enum" in rule and not any(_same(v, w) for w in rule["enum"]):
        say("enum")
    if "const" in rule and not _same(v, rule["const"]):
        say("const")
    if isinstance(v, Exact):
        if "minimum" in rule and v.value < Decimal(str(rule["minimum"])):
            say("minimum")
        if "maximum" in rule and v.value > Decimal(str(rule["maximum"])):
            say("maximum")
    elif isinstance(v, str):
        n = len(unicodedata.normalize("NFC", v))
        if n < rule.get("min_length", 0):
            say("min_length")
        if n > rule.get("max_length", n):
            say("max_length")
        if "pattern" in rule and not re.search(rule["pattern"], v):
            say("pattern")
    elif isinstance(v, list):
        if len(v) < rule.get("min_items", 0):
            say("min_items")
        if len(v) > rule.get("max_items", len(v)):
            say("max_items")
        if rule.get("unique") and len({write_canonical(x) for x in v}) < len(v):
            say("unique")
        if "contains" in rule:
            fitting = sum(not problems(x, rule["contains"]) for x in v)
            if not rule.get("min_contains", 1) <= fitting <= rule.get("max_contains", len(v)):
                say("contains")
        if "items" in rule:
            for i, x in enumerate(v):
                out += problems(x, rule["items"], _step(at, i))
    elif isinstance(v, dict):
        for m in rule.get("required", ()):
            if m not in v:
                say("required", _step(at, m))
        known = rule.get("properties")
        if known is not None:
            for m, x in v.items():
                if m in known:
                    out += problems(x, known[m], _step(at, m))
                elif not rule.get("open"):
                    say("additional", _step(at, m))
    return out


def violations(df: DataFrame, key: str, json: str, rule: dict, *, more: Callable[[object], list[Problem]] | None = None, first: int | None = None) -> DataFrame:
    """key, pointer, problem, n_total: of every text; 'json' at the root where it isn't strict JSON. ``more`` adds what a tree can't
    say, for values that fit the tree. ``first`` bounds the rows a text reports, not n_total."""
    kind = dict(df.dtypes)[key]
    out_type = df.select(key).schema[0].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    schema = pa.schema([(key, to_arrow_type(out_type)), ("pointer", pa.string()), ("problem", pa.string()), ("n_total", pa.int32())])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    value = read_strict(t)
                    found = problems(value, rule)
                    found = sorted(set(found or (more(value) if more else [])))
                except ValueError:
                    found = [("", "json")]
                for pointer, what in found[:first]:
                    for c, v in zip(out, (k, pointer, what, len(found))):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

    rows = df.select(key, json).where(F.col(json).isNotNull())
    return rows.mapInArrow(check, f"{key} {kind}, pointer string, problem string, n_total int")


def key_sets(json: Column | str, expected: list[str]) -> Column:
    """struct<missing, extra> of a JSON object's members against the expected ones, within the JVM."""
    own = F.json_object_keys(F.col(json) if isinstance(json, str) else json)
    want = F.array(*map(F.lit, expected))
    return F.struct(F.array_sort(F.array_except(want, own)).alias("missing"), F.array_sort(F.array_except(own, want)).alias("extra"))
