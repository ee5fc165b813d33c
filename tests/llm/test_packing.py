"""Packing: exact round trip, capacities, small optima by brute force."""

import random
from collections import Counter, defaultdict
from functools import lru_cache

import pytest

from lexiloom.llm import packing as p
from lexiloom.llm import packing_queries as q


def _optimum(items, capacity):
    @lru_cache(None)
    def need(left):
        if not left:
            return 0
        first, rest = left[0], left[1:]
        best = 99
        for mask in range(1 << len(rest)):
            own = [rest[i] for i in range(len(rest)) if mask >> i & 1]
            if first + sum(own) <= capacity:
                best = min(best, 1 + need(tuple(rest[i] for i in range(len(rest)) if not mask >> i & 1)))
        return best

    return need(tuple(sorted(items, reverse=True)))


def test_small_cases_are_optimal():
    rng = random.Random(3)
    for _ in range(60):
        items = [rng.randint(1, 10) for _ in range(rng.randint(1, 9))]
        bins = p.complete(items, 10)
        assert Counter(sum(bins, [])) == Counter(items) and max(map(sum, bins)) <= 10
        assert len(bins) == _optimum(items, 10)
    assert p.complete([], 10) == []
    # best fit decreasing needs one bin more here
    assert len(p.best_fit([7, 6, 4, 3, 3, 3, 2, 2], 10)) >= len(p.complete([7, 6, 4, 3, 3, 3, 2, 2], 10)) == 3


def _check(rows, counted, capacity):
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append((r.piece, r.start_token, r.n_tokens))
        bins[r.sequence].append((r.offset, r.n_tokens))
    for doc, n in counted.items():
        own = sorted(pieces.pop(doc))
        assert [x[0] for x in own] == list(range(len(own))) and len(own) == -(-n // capacity)
        assert [x[1] for x in own] == [i * capacity for i in range(len(own))] and sum(x[2] for x in own) == n
    assert not pieces
    for own in bins.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= capacity
    return len(bins)


def test_tables(spark, folder):
    path = p.public_vocabulary(p.VOCABULARY)
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    counted = {r.doc_id: p.count_tokens(r.text, path) for r in docs if r.text}
    rows = q.p6_sequences(spark, folder).collect()
    n = _check(rows, counted, p.CAPACITY)
    assert n <= -(-sum(counted.values()) // p.CAPACITY) + 1
    want = {r.doc_id for r in docs if r.text and len(r.text.split()) > 4096}
    assert {r.doc_id for r in q.p6_found(spark, folder).collect()} == want == {d for d, k in counted.items() if k > 4096}
    assert q.p6_report(spark, folder).first().n_sequences == n


def test_many_shards_and_ties(spark, monkeypatch):
    monkeypatch.setattr(p, "SHARD", 50)
    rng = random.Random(9)
    sizes = {i: rng.choice([1, 5, 5, 5, 40, 99, 100, 100, 101, 250]) for i in range(700)}
    counted = spark.createDataFrame(list(sizes.items()), "doc_id long, n_tokens long")
    n = _check(p.sequences(counted, 100).collect(), sizes, 100)
    full = sum(s // 100 for s in sizes.values())
    assert n <= full + len(p.best_fit([s % 100 for s in sizes.values() if s % 100], 100)) + 3


def test_odd_texts(spark):
    docs = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "a b", 5), (3, "a b", 5), (4, "x" * 250_000, 5), (5, "<|endoftext|>", 5)], "doc_id long, text string, n_tokens long")
    counted = p.sizes(docs, "doc_id", "text")
    got = sorted((r.doc_id, r.n_tokens) for r in counted.collect())
    assert [d for d, _ in got] == [3, 3, 4, 5] and got[0][1] == 2 and got[3][1] > 1
    assert p.sequences(counted).where("doc_id = 3").count() == 2
    assert p.sequences(p.sizes(docs.limit(0), "doc_id", "text")).count() == 0


@pytest.mark.parametrize("text", ["a" * 120_000, " " * 300_000, "é" * 150_000])
def test_long_runs_are_counted(text):
    assert p.count_tokens(text, p.public_vocabulary(p.VOCABULARY)) > 0
