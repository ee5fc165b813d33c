"""Shredding against a recursive brute-force reading of the same records."""

import json
from collections import Counter

from pyspark.sql import functions as F

from lexiloom.operators import question_sets as qs
from lexiloom.operators.shred import node_rows


def _open(v):
    if isinstance(v, str):
        try:
            w = json.loads(v)
        except ValueError:
            return v
        w = _open(w)
        return w if isinstance(w, (dict, list)) else v
    return v


def _choices(body):
    body = _open(body)
    c = _open(body.get("choices")) if isinstance(body, dict) else None
    if isinstance(c, dict):
        c = [c] if c.get("text") is not None else [c[k] for k in sorted(c)]
    for i, x in enumerate(c or []):
        x = _open(x)
        if isinstance(x, dict) and x.get("text") is not None:
            yield i


def _sets(v):
    v = _open(v)
    if isinstance(v, list):
        for x in v:
            yield from _sets(x)
    elif isinstance(v, dict):
        if v.get("questions") is not None:
            yield v
        for k, x in v.items():
            if k != "questions":
                yield from _sets(x)


def brute(src, rec, value):
    for s in _sets(value):
        q = _open(s["questions"])
        if isinstance(q, dict):
            q = [q] if "question_id" in q or "body" in q else [q[k] for k in sorted(q)]
        for x in map(_open, q):
            if isinstance(x, dict) and (x.get("format") or s.get("format")) == qs.FORMAT:
                p = _open(x.get("provenance"))
                for i in _choices(x.get("body")):
                    yield (src, rec, s.get("set_id"), x.get("question_id"), i, (p or {}).get("review_ref") or "")


def test_found_equals_brute_force(spark, folder):
    got = Counter(map(tuple, qs.p1_found(spark, folder).select("src", "rec_id", "set_id", "question_id", "choice_no", "review_ref").collect()))
    want = Counter()
    for r in spark.read.parquet(f"{folder}/set_raw.parquet").collect():
        try:
            v = json.loads(r.payload or "x")
        except ValueError:
            continue
        want.update(brute("set_raw", r.raw_id, v))
    for r in spark.read.parquet(f"{folder}/vocab_mcq_en2ja.parquet").collect():
        d = r.asDict(recursive=True)
        want.update(brute(qs.FORMAT, r.rec_id, {"set_id": d["set_id"], "format": qs.FORMAT, "questions": [{k: d[k] for k in ("question_id", "format", "body", "provenance")}]}))
    assert got == want and len(want) > 100


def test_every_child_names_its_parent(spark, folder):
    e = qs.flat_tables(spark, folder)
    sets = e.sets.select("src", "doc", F.col("node").alias("up_set"))
    assert e.questions.join(sets, ["src", "doc", "up_set"], "left_anti").isEmpty()
    q = e.questions.select("src", "doc", F.col("node").alias("up_question"))
    assert e.reviews.join(q, ["src", "doc", "up_question"], "left_anti").isEmpty()


def _payloads(spark, texts):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "raw_id long, payload string, src string, node int")


def _tables(spark, folder, texts):
    questions = spark.read.parquet(f"{folder}/vocab_mcq_en2ja.parquet").limit(0)
    return qs.shred.entities(qs.adjacency(questions, _payloads(spark, texts)))


def test_odd_shapes(spark, folder):
    q = {"question_id": "q01", "body": {"choices": [None, {"text": "a"}, 3, {"text": None}]}}
    texts = [
        json.dumps({"set_id": "s", "format": qs.FORMAT, "questions": {"x": q, "y": dict(q, question_id="q02")}}),
        json.dumps(json.dumps({"received_by": "i", "set_id": "outer", "set": {"set_id": "in", "questions": [dict(q, format=qs.FORMAT)]}})),
        json.dumps({"set_id": "s", "format": "other", "questions": [q]}),
        json.dumps({"set_id": "s", "format": qs.FORMAT, "questions": [dict(q, body=json.dumps({"choices": {"b": {"text": "x"}, "a": {"text": "y"}, "c": None}}))]}),
        '{"set_id": "s", "format": "vocab_mcq_en2ja", "questions": [{"body": {"choices": [{"text": "\\ud800"}]}}]}',
        '{"questions": []} trailing', '{"a": NaN}', "", None, "null", "3", "[" * 100_000 + "]" * 100_000, '{"questions": []}',
    ]
    rows = sorted(map(tuple, qs.found(_tables(spark, folder, texts + [texts[1]])).collect()), key=str)
    assert [r[1:5] for r in rows if r[1] == 0] == [(0, "s", "q01", 1), (0, "s", "q02", 1)]
    assert [r[1:5] for r in rows if r[1] in (1, 13)] == [(1, "in", "q01", 1), (13, "in", "q01", 1)]
    assert [r[4] for r in rows if r[1] == 3] == [0, 1]
    assert [r[1] for r in rows] == [0, 0, 1, 13, 3, 3, 4]


def test_empty_tables_and_very_long_text(spark, folder):
    assert qs.found(_tables(spark, folder, [])).count() == 0
    long = json.dumps({"set_id": "s", "format": qs.FORMAT, "questions": [{"body": {"choices": [{"text": "語" * 300_000}] * 3}}]})
    assert qs.found(_tables(spark, folder, [long])).count() == 3


def test_nodes_keep_order_numbers_and_names():
    rows = node_rows('{"b": [1.50, true, null], "a": {"z": "x"}}')
    assert [(r[1], r[3], r[4], r[5], r[6]) for r in rows] == [
        (-1, None, None, "object", None), (0, "a", 0, "object", None), (1, "z", 0, "string", "x"), (0, "b", 1, "array", None),
        (3, "b", 0, "number", "1.50"), (3, "b", 1, "boolean", "true"), (3, "b", 2, "null", None),
    ]
