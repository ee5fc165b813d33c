"""Links between sentences against brute force over all pairs."""

import re
from collections import defaultdict

import pytest

from lexiloom.llm import neardup as n
from lexiloom.llm import neardup_queries as q


def _words(text):
    low = re.sub("['’‘]", "", text)
    return frozenset(re.findall("[a-z0-9]+", re.sub("[A-Z]", lambda m: m[0].lower(), low)))


def brute(rows):
    rows = [(f, r, w) for f, r, t in rows if t is not None and (w := _words(t))]
    # words in both sentences, and words in at least one of them
    return {(f, min(r, s), max(r, s)) for i, (f, r, w) in enumerate(rows) for g, s, v in rows[i + 1 :] if f == g and 10 * len(w & v) >= 7 * len(w | v)}


def found(spark, rows):
    df = spark.createDataFrame(rows, "field string, rec_id long, text string")
    members, classes = n.classes(df, "field", "rec_id", "text")
    pairs = [tuple(x) for x in n.row_pairs(members, n.links(classes)).collect()]
    assert len(pairs) == len(set(pairs))
    return set(pairs)


def test_tables(spark, folder):
    rows = [tuple(r) for r in q.sentences(spark, folder).collect()]
    assert {tuple(r) for r in q.p3_found(spark, folder).collect()} == brute(rows)


def test_share_of_the_union(spark):
    """7 common words: of 10 in either they are a link; of 11 in either they aren't, though 7 of the smaller's 9."""
    seven = "a b c d e f g"
    rows = [("x", 1, seven), ("x", 2, seven + " h i j"), ("x", 3, seven + " k l m n"), ("x", 4, seven + " h i"), ("x", 5, seven + " k l"), ("x", 6, seven + " o p q")]
    assert found(spark, rows) == brute(rows)
    assert ("x", 1, 2) in brute(rows) and ("x", 1, 3) not in brute(rows) and ("x", 4, 5) not in brute(rows) and ("x", 2, 6) not in brute(rows)


@pytest.mark.parametrize("limits", [{}, {"LONG": 3}, {"LONG": 12, "HEAVY": 1}, {"BLOCK": 2, "HEAVY": 40}])
def test_small_sets_copies_and_odd_texts(spark, limits, monkeypatch):
    for name, value in limits.items():
        monkeypatch.setattr(n, name, value)
    texts = ["", None, "____ !", "a", "A", "a b", "b a", "a b c", "don't stop", "dont stop now", "K k", "c d e f g h i j k l", "c d e f g h i j k x y", "c d e f g h x y z w", "a " * 50_000, "v" * 60 + " a b"]
    texts += [" ".join(f"w{i}" for i in range(a, a + k)) for a, k in ((0, 300), (40, 300), (60, 300), (0, 215), (0, 199), (0, 201), (0, 140))]
    rows = [(f, i, t) for f in ("x", "y") for i, t in enumerate(texts)] + [("x", 100 + i, "same text here") for i in range(12)] + [("x", 200 + i, "same text here too") for i in range(7)]
    assert found(spark, rows) == brute(rows)


def test_random_edits(spark):
    import random

    r = random.Random(5)
    rows = []
    for i in range(60):
        base = [f"w{int(r.paretovariate(0.7)) % 400}" for _ in range(r.randint(1, 24))]
        for j in range(r.randint(1, 6)):
            edited = [w for w in base if r.random() > 0.1] + [f"n{r.randint(0, 30)}" for _ in range(r.randint(0, 2))]
            r.shuffle(edited)
            rows.append((r.choice("xy"), 10 * i + j, " ".join(edited)))
    assert found(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert found(spark, []) == set()


def test_groups_are_the_connected_rows(spark, folder):
    rows = [tuple(r) for r in q.sentences(spark, folder).collect()]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for f, a, b in brute(rows):
        parent[root((f, b))] = root((f, a))
    want = defaultdict(set)
    for f, r, t in rows:
        if t is not None and _words(t):
            want[root((f, r))].add((f, r))
    got = defaultdict(set)
    for r in q.p3_groups(spark, folder).collect():
        got[(r.field, r.group_id)].add((r.field, r.rec_id))
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
    assert all(k[1] == min(r for _, r in v) for k, v in got.items())


def test_hot_classes_stay_where_they_are(spark, monkeypatch):
    monkeypatch.setattr(n, "BLOCK", 1)
    monkeypatch.setattr(n, "HOT", 4)
    rows = spark.createDataFrame([(1, i) for i in range(30)] + [(k, 100 + k) for k in range(2, 40)], "cls long, row_id long")
    classes = spark.createDataFrame([(k, str(k)) for k in range(1, 38)], "cls long, v string")
    want = {(k, r, str(k)) for k, r in [(1, i) for i in range(30)] + [(k, 100 + k) for k in range(2, 38)]}
    assert {tuple(r) for r in n.with_class(rows, classes, "cls").collect()} == want
    assert {tuple(r) for r in n.with_class(rows, classes, "cls", "left").collect()} == want | {(k, 100 + k, None) for k in (38, 39)}
    texts = [("x", i, "one two three") for i in range(25)] + [("x", 50 + i, f"one two three w{i}") for i in range(3)] + [("x", 90, "z z")]
    assert found(spark, texts) == brute(texts)


def test_a_long_chain_settles(spark):
    pairs = spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long")
    cls = spark.createDataFrame([(i,) for i in range(302)], "cls long")
    labels = {r.cls: r.label for r in n.components(cls, pairs).collect()}
    assert set(labels.values()) == {0, 301} and labels[300] == 0
