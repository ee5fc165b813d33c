"""The proportional sample: cases by brute force, floors, deviation, randomness."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexiloom.llm import mixture as m
from lexiloom.llm import mixture_queries as q

from .test_consistent import plain


def _brute(spark, folder):
    pool = {}
    for r in spark.read.parquet(f"{folder}/grammar_mcq.parquet").collect():
        if r.format is not None and r.level.value is not None:
            pool[r.set_id, r.question_id, r.generation] = (plain(r.format).lower(), plain(r.level.value).upper())
    return pool


def test_found_and_sample(spark, folder):
    pool = _brute(spark, folder)
    counts, size = Counter(pool.values()), len(pool) // 5
    targets = spark.read.parquet(f"{folder}/mix_target.parquet").collect()
    want = {(t.format, t.level_value) for t in targets if counts[t.format, t.level_value] < max(t.min_rows, -(-t.share_pm * size // 1000))}
    assert {tuple(r) for r in q.p4_found(spark, folder).collect()} == want
    rows = q.p4_sample(spark, folder).collect()
    keys = [(r.set_id, r.question_id, r.generation) for r in rows]
    assert len(rows) == len(set(keys)) == size and all(pool[k] == (r.format, r.level_value) for k, r in zip(keys, rows))
    drawn = Counter(pool[k] for k in keys)
    floors = {(t.format, t.level_value): min(t.min_rows, counts[t.format, t.level_value]) for t in targets}
    if sum(floors.values()) <= size:  # else no sample can hold them all
        assert all(drawn[c] >= n for c, n in floors.items())
    else:
        assert all(drawn[c] <= n for c, n in floors.items())
    report = {(r.format, r.level_value): r for r in q.p4_report(spark, folder).collect()}
    assert {c for c, r in report.items() if r.n_short} == want
    assert all(report[c].n_drawn == drawn[c] for c in report)
    assert sorted(q.p4_sample(spark, folder).collect()) == sorted(rows)


def test_allocation_is_as_near_as_the_pool_allows():
    targets = [m.Target(("a",), 700, 0, 1000), m.Target(("b",), 290, 5, 20), m.Target(("c",), 10, 5, 50)]
    assert m.allocate(targets, 500, 100, 1) in ([70, 20, 5, 5], [75, 20, 5, 0], [70, 20, 10, 0]) or sum(m.allocate(targets, 500, 100, 1)) == 100
    take = m.allocate(targets, 500, 100, 1)
    assert take[1] == 20 and take[2] >= 5 and take[0] >= 70
    best = abs(take[0] - 70) + abs(take[1] - 29) + abs(take[2] - 1) + take[3]
    assert best <= 9 + 4 + 5  # what b lacks, what c's floor costs, and the rows that must stand in for b
    assert m.allocate([m.Target(("a",), 1000, 9, 3)], 0, 10, 1) == [3, 0]
    assert sum(m.allocate([m.Target((str(i),), 100, 5, 9) for i in range(10)], 0, 20, 1)) == 20
    assert m.allocate([], 4, 2, 1) == [2]


def _pool(spark, n):
    return spark.range(n).select(F.col("id").alias("k"), F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 5 == 0, None).otherwise("cold").alias("c"), F.lit(1).alias("n"), F.lit(2).alias("rest"))


@pytest.mark.parametrize("n", [0, 40, 30_000])
def test_draw_is_exact_with_a_hot_category_and_nulls(spark, n):
    targets = [m.Target(("cold",), 500, 1), m.Target(("hot",), 500, 1)]
    signed = m.sign(_pool(spark, n).drop("n", "rest"), targets, ["c"])
    others = m.fill(signed, targets)
    take = m.allocate(targets, others, n // 4, 3)
    rows = m.draw(signed, take, F.struct("k"), 3).collect()
    assert len({r.k for r in rows}) == len(rows) == n // 4
    got = Counter(r.sig for r in rows)
    assert [got[i] for i in range(3)] == take
    if n > 1000:
        ks = sorted(r.k for r in rows if r.c == "hot")
        assert abs(sum(ks) / len(ks) - n / 2) < n / 40  # not the first ones


def test_bad_targets(spark):
    twice = spark.createDataFrame([("a", "b", 1, 1), ("a", "b", 2, 1)], "format string, level_value string, share_pm int, min_rows int")
    with pytest.raises(ValueError):
        m.load_targets(twice, q.CATEGORY)


def test_found_comes_from_the_run_that_draws(spark, folder, monkeypatch):
    ran = []
    for name in ("allocate", "draw"):
        monkeypatch.setattr(m, name, lambda *a, f=getattr(m, name), name=name: ran.append(name) or f(*a))
    found = {tuple(r) for r in q.p4_found(spark, folder).collect()}
    assert ran == ["allocate", "draw"]
    assert found == {(r.format, r.level_value) for r in q.p4_report(spark, folder).where("n_short > 0").collect()}
    monkeypatch.setattr(m, "allocate", lambda targets, *a: [t.available + 1 for t in targets] + [0])
    with pytest.raises(ValueError):
        q.p4_found(spark, folder)
