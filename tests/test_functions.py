"""Text, level and JSON functions, each with boundary pairs and nulls."""

import pytest
from pyspark.sql import functions as F

from lexiloom.functions import jsontext as j
from lexiloom.functions import levels as lv
from lexiloom.functions import text as t


def ev(spark, column, *rows, schema="a string, b string"):
    width = schema.count(",") + 1
    df = spark.createDataFrame([tuple(r) + (None,) * (width - len(r)) if isinstance(r, tuple) else (r,) + (None,) * (width - 1) for r in rows], schema)
    return [r[0] for r in df.coalesce(1).select(column).collect()]


def test_keys_stay_distinct(spark):
    assert ev(spark, t.folded_key("a"), "Straße", "STRASSE", None, "ABC") == ["strasse", "strasse", None, "abc"]
    assert ev(spark, t.lower_key("a"), "Straße", "É") == ["straße", "é"]
    assert ev(spark, t.sentence_key("a"), " A \t　b ", None) == ["a b", None]
    assert ev(spark, t.answer_key("a"), " É ") == ["é"]
    assert ev(spark, t.choice_key("a"), " がA ") == ["がA"]
    assert ev(spark, t.clean("a"), " 　", " x ", None) == [None, "x", None]


def test_blanks(spark):
    assert ev(spark, t.fill_all("a", "b"), ("____ x ____", "y"), ("x", "y")) == ["y x y", "x"]
    assert ev(spark, t.fill_first("a", "b"), ("____ x ____", "y"), ("x", "y"), ("😀 ____!", "y")) == ["y x ____", "x", "😀 y!"]


def test_ids(spark):
    assert ev(spark, t.entry_id("a", "b"), ("can", "modal auxiliary")) == ["lex:can:modal-auxiliary"]
    assert ev(spark, t.pos_of("a"), "lex:can:modal-auxiliary", "lex:a b:noun") == ["modal auxiliary", "noun"]
    assert ev(spark, t.item_number("a"), "12", " 12-3 ", "12.0", "12.5", "x", "", None) == ["12", "12-3", "12", None, None, None, None]
    assert ev(spark, t.parent_number("a"), "12-3", "12") == ["12", None]
    assert ev(spark, t.is_multiword("a"), "a b", "a-b", "ab") == [True, True, False]
    assert ev(spark, t.variants("a"), "a / b/c") == [["a", "b", "c"]]
    assert ev(spark, t.ordinal("a"), "q07", "gen2", "x", None) == [7, 2, None, None]
    assert ev(spark, t.column_name(F.col("a").cast("int")), "1", "26", "27", "52", "53", "702", "703", "728", "729", "18278") == ["A", "Z", "AA", "AZ", "BA", "ZZ", "AAA", "AAZ", "ABA", "ZZZ"]
    assert ev(spark, t.pointer("a", "b"), ("a/b", "m~n")) == ["/a~1b/m~0n"]
    assert ev(spark, t.version_label(wl="a", gp="b"), ("1", "2")) == ["wl1+gp2"]
    assert ev(spark, t.major("a"), "2.1.0") == ["2"]


def test_spans(spark):
    assert ev(spark, t.starts_once("b", "a"), ("aaa", "aa"), ("abcab", "c"), ("abc", "x"), ("abc", "")) == [False, True, False, False]
    assert ev(spark, t.holds_span("a", "b"), ("the cat sat", "cat"), ("concatenate", "cat"), ("a \\E.b", "\\E.b"), ("x", "")) == [True, False, True, False]
    assert ev(spark, t.item_refs("a"), "gp:1, gp:22-1. xgp:3 gp:4x gp:1") == [["gp:1", "gp:22-1"]]
    assert ev(spark, t.level_refs("a"), "A1.3 B2.2, A1.4 xA1.1 B1.1. A2.1-B1.2") == [["A1.3", "B2.2", "A2.1-B1.2"]]
    assert [tuple(x) for x in ev(spark, t.split_on("a", "b"), ("a cat sat", "cat"), ("x", "cat"))] == [("a ", "cat", " sat"), ("x", "", "")]
    assert ev(spark, t.answer_tokens("a"), "It’s, a  Dog.", "") == [["it's", "a", "dog"], []]
    assert ev(spark, t.n_characters("a"), "が", "😀") == [1, 1]
    assert ev(spark, t.has_japanese("a"), "abc", "aあ", "漢", None) == [False, True, True, False]
    assert ev(spark, t.half_width("a"), "　１２，３  x ") == ["12,3 x"]


def test_moments_and_base64(spark):
    good = ["2024-02-29T10:00:00+09:00", "2024-02-28T10:00:00Z", "2024-02-28T10:00:00-14:00"]
    bad = ["2024-02-30T10:00:00+09:00", "2024-02-28T10:00:00+14:01", "2024-02-28T10:00:00", "2024-02-28 10:00:00Z", None]
    assert [x is not None for x in ev(spark, t.moment("a"), *good, *bad)] == [True] * 3 + [False] * 5
    assert ev(spark, t.is_canonical_base64("a"), "YQ==", "YR==", "Y", "", "QUJD" * 40) == [True, False, False, True, True]
    assert ev(spark, t.is_canonical_base64("a", allow_empty=False), "") == [False]


def test_levels(spark):
    assert ev(spark, lv.fine_rank("a"), "A1.1", "B2.2", "A1", None) == [1, 9, None, None]
    assert ev(spark, lv.broad_rank("a"), "A1", "B2", "C1") == [1, 4, None]
    assert ev(spark, lv.band("a"), "A1.3", "B2") == ["A1", "B2"]
    assert ev(spark, lv.ceiling("a"), "A1", "B2", "X") == ["A1.3", "B2.2", None]
    got = ev(spark, lv.level_range("a"), "A1.1", "A1.1-B1.2", "B1.2-A1.1", "A1.1-A1.1", "A1.1-", "x", "A1.1-A1.2-A1.3", None)
    assert [x and tuple(x) for x in got] == [("A1.1", "A1.1"), ("A1.1", "B1.2"), None, None, None, None, None, None]
    rows = spark.createDataFrame([(x,) for x in ("12-10", "2", "12", "2-1", "12-2")], "a string")
    assert [r.a for r in rows.orderBy(*lv.number_key("a")).collect()] == ["2", "2-1", "12", "12-2", "12-10"]


def test_strict_and_canonical_json(spark):
    assert j.canonical_text('{"b": 1.50, "a": [null, {}]}') == '{\n  "a": [\n    null,\n    {}\n  ],\n  "b": 1.50\n}\n'
    for bad in ('{"a":1,"a":2}', "NaN", '"\\ud800"', "1" * 4301, "{} x", "", "[" * 100_000):
        with pytest.raises(ValueError):
            j.read_strict(bad)
    assert len(j.read_strict("1" * 4300)) == 4300
    assert j.same_numbers("1.0", "1") and j.same_numbers("1e2", "100") and not j.same_numbers("1", "1.0000000000000000000000001")
    good = j.canonical_text("[1]")
    assert ev(spark, j.is_canonical("a"), good, "[1]", "x", None) == [True, False, False, False]
    assert ev(spark, j.strict_problem("a"), "[1]", "NaN", None)[0] is None
