"""JSON as text: strict reading, exact numbers, canonical writing."""

from __future__ import annotations

import json
import re
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_DIGITS = 4300


class Exact(str):
    """A number as written; equal to another by value."""

    @property
    def value(self) -> Decimal:
        return Decimal(str(self))


def _no(token: str):
    raise ValueError(f"not finite: {token}")


def _members(pairs: list) -> dict:
    out = dict(pairs)
    if len(out) < len(pairs):
        raise ValueError("repeated member")
    return out


def read_strict(text: str, *, digits: int | None = MAX_DIGITS):
    """The value of a JSON text; numbers stay as written. Repeated members, NaN, infinities, lone surrogates and integers beyond ``digits`` are errors."""
    try:
        value = json.loads(text, parse_int=Exact, parse_float=Exact, parse_constant=_no, object_pairs_hook=_members)
    except RecursionError as e:
        raise ValueError("nested too deeply") from e
    todo = [value]
    while todo:
        v = todo.pop()
        if isinstance(v, Exact):
            if digits and len(v.lstrip("-")) > digits and v.lstrip("-").isdigit():
                raise ValueError("too many digits")
        elif isinstance(v, str):
            if re.search("[\ud800-\udfff]", v):
                raise ValueError("lone surrogate")
        elif isinstance(v, dict):
            todo += [*v, *v.values()]
        elif isinstance(v, list):
            todo += v
    return value


def write_canonical(value, depth: int = 0) -> str:
    """Sorted members, two spaces a level, numbers as written, no escapes beyond JSON's own."""
    pad = "  " * (depth + 1)
    if isinstance(value, dict):
        inner = [f"{pad}{json.dumps(k, ensure_ascii=False)}: {write_canonical(value[k], depth + 1)}" for k in sorted(value)]
        return "{\n" + ",\n".join(inner) + "\n" + pad[2:] + "}" if inner else "{}"
    if isinstance(value, list):
        inner = [pad + write_canonical(v, depth + 1) for v in value]
        return "[\n" + ",\n".join(inner) + "\n" + pad[2:] + "]" if inner else "[]"
    return str(value) if isinstance(value, Exact) else json.dumps(value, ensure_ascii=False, allow_nan=False)


def canonical_text(text: str) -> str:
    return write_canonical(read_strict(text, digits=None)) + "\n"


def _try(function):
    def run(text):
        try:
            return None if text is None else function(text)
        except ValueError:
            return None

    return run


@F.pandas_udf(T.StringType())
def canonical(text: pd.Series) -> pd.Series:
    """The canonical text of a JSON text, null where it isn't strict JSON."""
    return text.map(_try(canonical_text))


@F.pandas_udf(T.StringType())
def strict_problem(text: pd.Series) -> pd.Series:
    """Why a text isn't strict JSON, null where it is."""

    def why(t):
        if t is None:
            return "null"
        try:
            read_strict(t)
        except json.JSONDecodeError as e:
            return e.msg
        except ValueError as e:
            return str(e).split(":")[0]
        return None

    return text.map(why)


def is_canonical(text: Column | str) -> Column:
    """Whether a text is byte for byte its canonical form."""
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(canonical(c) == c, F.lit(False))


def same_numbers(a: str, b: str) -> bool:
    """Whether two number tokens are the same value, exactly."""
    return Exact(a).value == Exact(b).value


@F.pandas_udf(T.BooleanType())
def equal_numbers(a: pd.Series, b: pd.Series) -> pd.Series:
    """Whether two columns' number tokens are the same value, exactly; null where either is."""
    return pd.Series([None if x is None or y is None else same_numbers(x, y) for x, y in zip(a, b)], dtype=object)


def digest(content: Column | str) -> Column:
    """SHA-256 in hexadecimal of a text or of bytes."""
    return F.sha2(F.col(content) if isinstance(content, str) else content, 256)
