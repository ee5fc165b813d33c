"""The positional index against brute force over all documents."""

import re
import unicodedata

import pytest

from lexiloom.llm import leak
from lexiloom.llm import leak_queries as q


def _words(text):
    text = "".join(c for c in text if unicodedata.category(c) != "Cf")
    return re.findall("[a-z0-9]+", re.sub("['’‘ʼ]", "", unicodedata.normalize("NFKC", text).lower()))


def _runs(words, k):
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def brute(docs, items, k):
    of = {i: _runs(_words(t), k) for i, t in items if t is not None}
    return {(d, i) for d, t in docs if t is not None for own in [_runs(_words(t), k)] for i, runs in of.items() if own & runs}


def _rows(spark, rows, names):
    return spark.createDataFrame(rows, names)


@pytest.mark.parametrize("block", [None, 2000])
def test_tables(spark, folder, block, monkeypatch):
    if block:
        monkeypatch.setattr(leak, "BLOCK", block)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/eval_items.parquet").collect()]
    got = [tuple(r) for r in q.p7_found(spark, folder).collect()]
    want = brute(docs, items, q.CONSECUTIVE)
    assert len(got) == len(set(got)) and set(got) == want and want
    inside = {(d, i) for d, t in docs if t for i, x in items if f" {' '.join(_words(x))} " in f" {' '.join(_words(t))} "}
    assert {(r.doc_id, r.item_id) for r in q.p7_whole(spark, folder).collect()} == inside


DOCS = [(1, "a b c d e f"), (2, "x a b y c d"), (3, None), (4, ""), (5, "!!"), (6, "f a b c"), (7, "d e f"), (8, "a b c d e f"), (9, "a a a b b c a b c a"), (10, "Ａ b​c don’t"), (11, "z " * 200_000 + "a b c d")]
ITEMS = [(1, "a b c d"), (2, "c d e f g"), (3, None), (4, ""), (5, "q r s t"), (6, "a b c a"), (7, "a b c d"), (8, "bc dont")]


def test_small_cases(spark):
    blocks = leak.index(_rows(spark, DOCS, "k long, text string").withColumnRenamed("k", "doc_id"), "doc_id", "text")
    items = leak.load_queries(_rows(spark, ITEMS, "item_id long, text string"), "item_id", "text")
    for k in (1, 2, 3, 4, 5):
        assert {tuple(r) for r in leak.phrases(blocks, items, k).collect()} == brute(DOCS, ITEMS, k)
    near = {(r.doc_id, r.item_id): r.n_near for r in leak.proximity(blocks, items, 0.75, 5).collect()}
    want = {}
    for d, t in DOCS:
        w = _words(t or "")
        for i, x in ITEMS:
            own = set(_words(x or ""))
            most = max((len(own & set(w[s : s + 5])) for s in range(len(w))), default=0)
            if own and most >= -(-len(own) * 3 // 4):
                want[d, i] = most
    assert near == want


def test_empty_tables_and_bounds(spark, monkeypatch):
    none = _rows(spark, [], "doc_id long, text string")
    some = _rows(spark, ITEMS, "item_id long, text string")
    assert leak.phrases(leak.index(none, "doc_id", "text"), leak.load_queries(some, "item_id", "text"), 2).count() == 0
    assert leak.load_queries(some.limit(0), "item_id", "text") == []
    monkeypatch.setattr(leak, "MAX_QUERY_WORDS", 2)
    with pytest.raises(ValueError):
        leak.load_queries(some, "item_id", "text")


def test_near_finds_long_items_and_stays_within_documents(spark):
    long = " ".join(f"w{i}" for i in range(400))
    docs = [(1, f"x {long} y"), (2, " ".join(f"w{i}" for i in range(200))), (3, " ".join(f"w{i}" for i in range(200, 400)))]
    blocks = leak.index(_rows(spark, docs, "doc_id long, text string"), "doc_id", "text")
    items = leak.load_queries(_rows(spark, [(1, long), (2, " ".join(f"w{i}" for i in range(100)))], "item_id long, text string"), "item_id", "text")
    got = {(r.doc_id, r.item_id, r.n_words, r.n_near) for r in leak.proximity(blocks, items, 0.8, 64).collect()}
    assert got == {(1, 1, 400, 400), (1, 2, 100, 100), (2, 2, 100, 100)}
    assert {r.doc_id for r in leak.proximity(blocks, items[:1], 0.8, 900).collect()} == {1}
