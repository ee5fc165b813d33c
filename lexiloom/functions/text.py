"""Text keys and small text functions, as column expressions; Arrow functions only where the JVM has none.

The keys differ on purpose: which of composition, folding, stripping and collapsing a comparison needs is part of its meaning.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLANK = "____"
_ENDS = "(?U)^\\s+|\\s+$"
_NOT_ASCII = "[^\\x00-\\x7f]"


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


@F.pandas_udf(T.StringType())
def _nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda s: s if s is None else unicodedata.normalize("NFC", s))


@F.pandas_udf(T.StringType())
def _folded(text: pd.Series) -> pd.Series:
    return text.map(lambda s: s if s is None else unicodedata.normalize("NFC", s).casefold())


def nfc(text: Column | str) -> Column:
    """Canonical composition. Only texts beyond ASCII leave the JVM."""
    c = _col(text)
    return F.coalesce(_nfc(F.when(c.rlike(_NOT_ASCII), c)), c)


def strip(text: Column | str) -> Column:
    """Without white space of any script at the ends."""
    return F.regexp_replace(_col(text), _ENDS, "")


def collapse(text: Column | str) -> Column:
    return F.regexp_replace(_col(text), "(?U)\\s+", " ")


def clean(text: Column | str) -> Column:
    """Composed and stripped; null where nothing is left."""
    return F.nullif(strip(nfc(text)), F.lit(""))


def folded_key(text: Column | str) -> Column:
    """For look-ups that ignore case fully: composed and case-folded."""
    c = _col(text)
    return F.coalesce(_folded(F.when(c.rlike(_NOT_ASCII), c)), F.lower(c))


def lower_key(text: Column | str) -> Column:
    return F.lower(nfc(text))


def sentence_key(text: Column | str) -> Column:
    """Composed, lower-cased, white space collapsed and stripped."""
    return strip(collapse(lower_key(text)))


def answer_key(text: Column | str) -> Column:
    """Stripped and lower-cased, not composed."""
    return F.lower(strip(text))


def choice_key(text: Column | str) -> Column:
    """Of Japanese choices: composed and stripped, case kept."""
    return nfc(strip(text))


#: Characters that no text to be compared holds: what stands between the texts of a list, and for a null.
_BETWEEN, _NULL = "\x01", "\x02"


def composed_keys(texts: Column) -> Column:
    """choice_key of each text of a list: they are composed together, as a list's items can't leave the JVM one by one."""
    joined = F.array_join(F.transform(texts, lambda t: F.coalesce(strip(t), F.lit(_NULL))), _BETWEEN)
    own = F.transform(F.split(nfc(joined), _BETWEEN), lambda t: F.nullif(t, F.lit(_NULL)))
    return F.when(F.size(texts) == 0, F.array().cast("array<string>")).otherwise(own)


def fill_all(text: Column | str, answer: Column | str) -> Column:
    return F.replace(_col(text), F.lit(BLANK), _col(answer))


def fill_first(text: Column | str, answer: Column | str) -> Column:
    """Only the first blank."""
    t, at = _col(text), F.locate(BLANK, _col(text))
    return F.when(at > 0, F.concat(F.substring(t, F.lit(1), at - 1), _col(answer), F.substring(t, at + len(BLANK), F.length(t)))).otherwise(t)


def entry_id(headword: Column | str, pos: Column | str) -> Column:
    return F.concat(F.lit("lex:"), _col(headword), F.lit(":"), F.replace(_col(pos), F.lit(" "), F.lit("-")))


def pos_of(ref: Column | str) -> Column:
    """Part of speech of an entry's id. One name is written with a space outside ids."""
    tail = F.substring_index(_col(ref), ":", -1)
    return F.when(tail == "modal-auxiliary", "modal auxiliary").otherwise(tail)


def item_number(value: Column | str) -> Column:
    """digits or digits-digits, from a text or an integral number; null for anything else."""
    t = strip(_col(value).cast("string"))
    t = F.regexp_replace(t, "\\.0+$", "")
    return F.when(t.rlike("^[0-9]+(-[0-9]+)?$"), t)


def is_multiword(text: Column | str) -> Column:
    return _col(text).rlike("[ -]")


def variants(joined: Column | str) -> Column:
    """The variants of 'a/b/c', composed and stripped."""
    return F.transform(F.split(nfc(joined), "/"), lambda v: F.regexp_replace(v, _ENDS, ""))


def parent_number(number: Column | str) -> Column:
    """What stands before the hyphen, null where there is none."""
    return F.when(_col(number).contains("-"), F.substring_index(_col(number), "-", 1))


def answer_tokens(text: Column | str) -> Column:
    """Words of an answer for comparing orders: curly apostrophes straight, stops dropped anywhere, lower case."""
    plain = F.translate(nfc(text), "’.,?!;:", "'")
    return F.filter(F.split(F.lower(plain), "[ \\t]+"), lambda w: w != "")


def n_characters(text: Column | str) -> Column:
    """Code points of the composed text."""
    return F.char_length(nfc(text))


def has_japanese(text: Column | str) -> Column:
    return F.coalesce(_col(text).rlike("[\\u3040-\\u30ff\\u4e00-\\u9fff]"), F.lit(False))


def starts_once(part: Column | str, text: Column | str) -> Column:
    """Whether part begins at exactly one place of text, overlapping places counted."""
    p, t = _col(part), _col(text)
    first = F.locate_col(p, t) if hasattr(F, "locate_col") else F.call_function("locate", p, t)
    again = F.call_function("locate", p, t, first + 1)
    return (F.length(p) > 0) & (first > 0) & (again == 0)


def quoted(text: Column) -> Column:
    """A text as a literal of Java's regular expressions."""
    return F.concat(F.lit("\\Q"), F.replace(text, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


# What counts as part of a word at the ends of a span.
_ALNUM = "[\\p{L}\\p{N}]"


def holds_span(text: Column | str, span: Column | str) -> Column:
    """Whether span stands in text without cutting a run of letters and digits at either end."""
    t, s = _col(text), _col(span)
    before = F.when(s.rlike(f"^{_ALNUM}"), F.lit(f"(?<!{_ALNUM})")).otherwise(F.lit(""))
    after = F.when(s.rlike(f"{_ALNUM}\\z"), F.lit(f"(?!{_ALNUM})")).otherwise(F.lit(""))
    return (F.length(s) > 0) & F.regexp_like(t, F.concat(before, quoted(s), after))


# References and fine levels (or ranges of them) as whole tokens of a text.
ITEM_REF = "(?<![A-Za-z0-9-])gp:[0-9]+(?:-[0-9]+)?(?![A-Za-z0-9-])"
_LEVEL = "(?:A1\\.[123]|A2\\.[12]|B1\\.[12]|B2\\.[12])"
LEVEL_REF = f"(?<![A-Za-z0-9.]){_LEVEL}(?:-{_LEVEL})?(?![A-Za-z0-9.])"


def item_refs(text: Column | str) -> Column:
    """Distinct grammar references in a text, bounded on both sides."""
    return F.array_distinct(F.regexp_extract_all(_col(text), F.lit(ITEM_REF), F.lit(0)))


def level_refs(text: Column | str) -> Column:
    """Distinct fine levels and ranges in a text, bounded on both sides; a range is one of them."""
    return F.array_distinct(F.regexp_extract_all(_col(text), F.lit(LEVEL_REF), F.lit(0)))


def column_name(number: Column | str) -> Column:
    """Spreadsheet letters of a column counted from 1."""
    start = F.struct(_col(number).cast("long").alias("left"), F.lit("").alias("name"))

    def letter(acc: Column, _: Column) -> Column:
        more = F.struct(F.floor((acc["left"] - 1) / 26).cast("long").alias("left"), F.concat(F.char(F.pmod(acc["left"] - 1, F.lit(26)) + 65), acc["name"]).alias("name"))
        return F.when(acc["left"] > 0, more).otherwise(acc)

    # 14 letters name more columns than there are whole numbers
    return F.aggregate(F.sequence(F.lit(1), F.lit(14)), start, letter, lambda acc: F.nullif(acc["name"], F.lit("")))


def pointer(*members: Column | str) -> Column:
    """A JSON pointer of member names."""
    escaped = [F.replace(F.replace(_col(m).cast("string"), F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1")) for m in members]
    return F.concat(*(x for e in escaped for x in (F.lit("/"), e))) if members else F.lit("")


def version_label(**parts: Column | str) -> Column:
    """'wl1+gp2+norm3' of wl=, gp=, norm=."""
    return F.concat_ws("+", *(F.concat(F.lit(k), _col(v)) for k, v in parts.items()))


def citation(title: Column | str, label: Column | str, url: Column | str, retrieved: Column | str, *, japanese: bool = False) -> Column:
    """One line that cites a source; the Japanese one has the year and the month without a leading zero. Null where a part is missing."""
    t, v, u, d = _col(title), _col(label), _col(url), _col(retrieved)
    if not japanese:
        return F.concat(t, F.lit(" ("), v, F.lit("). Retrieved from "), u, F.lit(" on "), F.date_format(d, "yyyy-MM-dd"), F.lit("."))
    return F.concat(F.lit("『"), t, F.lit("』("), v, F.lit("版) (URL: "), u, F.lit(" より"), F.year(d).cast("string"), F.lit("年"), F.month(d).cast("string"), F.lit("月ダウンロード)"))


def with_members(struct: Column | str, **values: Column) -> Column:
    """A struct with more members, or other values of those it has."""
    out = _col(struct)
    for name, value in values.items():
        out = out.withField(name, value)
    return out


def without_members(struct: Column | str, *names: str) -> Column:
    """A struct without some members, for comparing what is left."""
    return _col(struct).dropFields(*names)


def major(version: Column | str) -> Column:
    return F.split_part(_col(version), F.lit("."), F.lit(1))


def moment(text: Column | str) -> Column:
    """A time of second precision with an offset of at most 14 hours; null for anything else, calendar included."""
    t = _col(text)
    shape = "^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(Z|[+-][0-9]{2}:[0-9]{2})$"
    hours, minutes = F.regexp_extract(t, "[+-]([0-9]{2}):[0-9]{2}$", 1), F.regexp_extract(t, "[+-][0-9]{2}:([0-9]{2})$", 1)
    off = F.coalesce(F.try_to_number(F.nullif(hours, F.lit("")), F.lit("99")) * 60 + F.try_to_number(F.nullif(minutes, F.lit("")), F.lit("99")), F.lit(0))
    return F.when(t.rlike(shape) & (off <= 840) & ((minutes == "") | (minutes < "60")), F.try_to_timestamp(t))


def is_canonical_base64(text: Column | str, *, allow_empty: bool = True) -> Column:
    """Whether encoding what the text decodes to gives the text again."""
    t = _col(text)
    again = F.regexp_replace(F.base64(F.try_to_binary(t, F.lit("base64"))), "[\\r\\n]", "")
    return F.coalesce(again == t, F.lit(False)) & (F.lit(allow_empty) | (F.length(t) > 0))


def ordinal(ref: Column | str) -> Column:
    """The number at the end of 'q07' or 'gen2'."""
    return F.nullif(F.regexp_extract(_col(ref), "^[a-z]+([0-9]+)$", 1), F.lit("")).cast("int")


def split_on(text: Column | str, part: Column | str) -> Column:
    """struct<before, match, after> around the first match, all in before where there is none."""
    t, p = _col(text), _col(part)
    at = F.call_function("locate", p, t)
    hit = (at > 0) & (F.length(p) > 0)
    return F.struct(
        F.when(hit, F.substring(t, F.lit(1), at - 1)).otherwise(t).alias("before"),
        F.when(hit, p).otherwise("").alias("match"),
        F.when(hit, F.substring(t, at + F.length(p), F.length(t))).otherwise("").alias("after"),
    )


def half_width(text: Column | str) -> Column:
    """Input as typed: full-width digits, commas and spaces become half-width, spaces collapse; words stay."""
    return strip(collapse(F.translate(_col(text), "０１２３４５６７８９，　", "0123456789, ")))
