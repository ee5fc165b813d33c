"""Readers, sinks and streams over temporary folders."""

import json

import pytest
from pyspark.sql import functions as F

from lexiloom.sources import readers, sinks
from lexiloom.streaming import deliveries


def test_json_readers(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text('{"id":"a","headword":"h","is_multiword":true}\n{"id": 3\n', encoding="utf-8")
    rows = readers.json_lines(spark, str(tmp_path / "l.jsonl"), "lexicon", "1.4.2").cache()
    assert rows.where("corrupt is null").count() == 1 and rows.where("corrupt is not null").count() == 1
    with pytest.raises(readers.VersionError):
        readers.json_lines(spark, "x", "lexicon", "2.0.0")
    folder = tmp_path / "files"
    folder.mkdir()
    for name, content in (("a.json", b"[\n  1\n]\n"), ("b.json", b"[1]"), ("c.json", b"{"), ("d.json", b"\xff")):
        (folder / name).write_bytes(content)
    got = {r.name: (r.problem is None, r.canonical) for r in readers.json_texts(spark, str(folder)).collect()}
    assert got == {"a.json": (True, True), "b.json": (True, False), "c.json": (False, False), "d.json": (False, False)}
    digests = readers.digests(spark, str(folder))
    assert digests.count() == 4 and len(digests.first().sha256) == 64


def test_sheet_manifest_and_bundle(spark, tmp_path):
    (tmp_path / "s.csv").write_text('a,b\n"x, y",\n,\n', encoding="utf-8")
    rows = [tuple(r) for r in readers.sheet(spark, str(tmp_path / "s.csv"), ["p", "q"]).orderBy("n_row").collect()]
    assert rows[:2] == [(1, "a", "b"), (2, "x, y", None)]
    good = "0" * 64
    m = spark.createDataFrame([("w", good, "2024-02-29"), ("g", "x", "2024-02-30"), ("z", good, "2024-01-01")], "role string, sha256 string, retrieved_date string")
    assert sorted(tuple(r) for r in readers.manifest_problems(m, ["w", "g", "k"]).collect()) == [("g", "date"), ("g", "sha256"), ("k", "count"), ("z", "unknown")]
    assert readers.Bundle(spark, {"m": m}, counts={"m": 3})["m"].count() == 3
    with pytest.raises(ValueError):
        readers.Bundle(spark, {"m": m}, counts={"m": 4})["m"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    assert sorted(r.value for r in sinks.as_canonical(df).collect())[0] == '{\n  "k": 1,\n  "v": "a"\n}\n'
    out = str(tmp_path / "out")
    sinks.publish(df, out, key=["k"], dry=True)
    assert not (tmp_path / "out").exists()
    sinks.publish(df, out, key=["k"])
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.publish(df, out)
    with pytest.raises(sinks.Refused):
        sinks.publish(df.union(df), out + "2", key=["k"])
    log = str(tmp_path / "log")
    sinks.append_new(df, log, ["k"])
    sinks.append_new(df.withColumn("k", F.col("k") + 5), log, ["k"])
    with pytest.raises(sinks.Refused):
        sinks.append_new(df, log, ["k"])
    assert spark.read.parquet(log).count() == 4
    both = str(tmp_path / "both")
    sinks.replace_together({"a": df, "b": df}, both)
    sinks.replace_together({"a": df.limit(1), "b": df}, both)
    assert spark.read.parquet(both + "/a").count() == 1 and spark.read.parquet(both + "/b").count() == 2
    with pytest.raises(sinks.Refused):
        sinks.replace_together({"a": df}, both, inputs=[both])
    page = sinks.page([{"sentence": "a ____ <b> ____", "choices": [{"text": "x&y", "is_correct": True}, {"text": None}]}], "T")
    assert "<mark>x&amp;y</mark> &lt;b&gt; ____" in page and page.count("<li>") == 3


def _run(df, mode, name):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return df.sparkSession.table(name)


def test_streams_equal_the_batch(spark, folder, tmp_path):
    table = spark.read.parquet(f"{folder}/grammar_mcq.parquet")
    source = str(tmp_path / "in")
    table.repartition(3).write.parquet(source)
    stream = deliveries.stream(spark, source, table.schema)
    updates = _run(deliveries.latest_generation(stream), "update", "latest")
    last = updates.groupBy("set_id", "question_id").agg(F.max_by(F.struct("generation", "rec_id", "n"), "n").alias("s")).select("set_id", "question_id", "s.*")
    batch = deliveries.latest_generation_batch(table)
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, batch.collect()))
    once = _run(deliveries.once(stream.withColumn("ingested_at", F.col("ingested_at")), within="3000 days"), "append", "once")
    assert once.count() == table.select(*deliveries.KEY).distinct().count()
    days = _run(deliveries.by_day(stream, late="3000 days"), "complete", "days")
    assert days.agg(F.sum("n")).first()[0] == table.where("created_at is not null").count()


def test_audit_folder(spark, tmp_path):
    from lexiloom.operators import attempts

    for name in ("q01.gen1.candidate.json", "notes.md"):
        (tmp_path / "s1" / "review").mkdir(parents=True, exist_ok=True)
        (tmp_path / "s1" / "review" / name).write_text(json.dumps({}))
    got = {(r.set_id, r.name, r.kind) for r in attempts.read_audit(spark, str(tmp_path)).collect()}
    assert got == {("s1", "q01.gen1.candidate.json", "part"), ("s1", "notes.md", None)}
