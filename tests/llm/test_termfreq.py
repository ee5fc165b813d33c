"""Term frequencies against counting by hand."""

from collections import Counter

from lexiloom.llm import termfreq as t
from lexiloom.llm import termfreq_queries as q

from .test_consistent import plain


def _brute(spark, folder):
    records = {}
    for r in spark.read.parquet(f"{folder}/vocab_mcq_en2ja.parquet").collect():
        texts = [c.text for c in r.body.choices or [] if c is not None and c.text is not None]
        records["choice_text", r.set_id, r.question_id, r.generation] = [plain(x) for x in texts]
    for r in spark.read.parquet(f"{folder}/grammar_mcq.parquet").collect():
        ref = r.target.ref if r.target else None
        records["target_ref", r.set_id, r.question_id, r.generation] = [] if ref is None else [plain(ref).lower()]
    n, n_records, total = Counter(), Counter(), Counter(k[0] for k in records)
    for k, terms in records.items():
        n.update((k[0], x) for x in terms)
        n_records.update((k[0], x) for x in set(terms))
    mark = {p: "common" if 40 * c > total[p[0]] else "rare" if c <= 2 else "" for p, c in n_records.items()}
    return {(*p, n[p], n_records[p], mark[p]) for p in n}


def test_tables(spark, folder):
    want = _brute(spark, folder)
    assert {tuple(r) for r in q.p5_terms(spark, folder).collect()} == want
    assert {tuple(r) for r in q.p5_found(spark, folder).collect()} == {(f, x, m) for f, x, _, _, m in want if m}


def test_heavy_and_light_terms_are_exact(spark):
    rows = [("f", ["hot"] * 3 + [f"t{i % 5000}", None, "", "x" * 3000]) for i in range(9000)] + [("g", ["hot"]), ("g", None), ("g", [])]
    got = {(r.field, r.term): (r.n_occurrences, r.n_records) for r in t.frequencies(spark.createDataFrame(rows, "field string, terms array<string>").repartition(7)).collect()}
    assert got["f", "hot"] == (27000, 9000) and got["g", "hot"] == (1, 1) and got["f", "x" * 3000] == (9000, 9000) and got["f", ""] == (9000, 9000)
    assert len(got) == 5000 + 4 and all(got["f", f"t{i}"] == ((2, 2) if i < 4000 else (1, 1)) for i in range(5000))


def test_empty_table(spark):
    assert t.frequencies(spark.createDataFrame([], "field string, terms array<string>")).count() == 0
