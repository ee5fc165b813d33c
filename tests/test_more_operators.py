"""Matching by blocks, running numbers, queues, reviews' parts, rule trees, workbooks, views and guards, on hand-made rows."""

import itertools
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from lexiloom.functions import jsontext, text
from lexiloom.operators import attempts, contract, lookup, matching, reference, reviews, rules, tokens
from lexiloom.sources import sinks, workbooks


def largest(lefts, rights):
    """By trying all ways."""
    pairs = [(a, b) for a, blocks in lefts.items() for k in blocks for b in rights.get(k, ())]
    for n in range(min(len(lefts), len({b for _, b in pairs})), 0, -1):
        if any(len({a for a, _ in c}) == len({b for _, b in c}) == n for c in itertools.combinations(set(pairs), n)):
            return n
    return 0


def test_block_matching_is_maximum():
    r = random.Random(1)
    for _ in range(60):
        lefts = {i: sorted(r.sample("xyz", r.randint(1, 2))) for i in range(r.randint(0, 4))}
        rights = {k: sorted(r.sample(range(4), r.randint(0, 2))) for k in "xyz"}
        found = matching.block_matching(lefts, rights)
        assert len(set(found.values())) == len(found) == largest(lefts, rights)
        assert all(any(b in rights[k] for k in lefts[a]) for a, b in found.items())


def test_matching_over_mixed_blocks_has_no_cap(spark):
    big = 1 << 60  # ids that no double can tell apart
    left = spark.createDataFrame([("g", "a", big + i) for i in range(700)] + [("g", "b", big + i) for i in range(0, 700, 2)] + [("h", "a", 1)], "g string, k string, left_id long")
    right = spark.createDataFrame([("g", "a", big + i) for i in range(600)] + [("g", "b", big + 1000 + i) for i in range(50)] + [("i", "a", 5)], "g string, k string, right_id long")
    rows = matching.match(left, right, "g", ["k"]).collect()
    both = [r for r in rows if r.left_id is not None and r.right_id is not None]
    assert len(both) == len({r.left_id for r in both}) == len({r.right_id for r in both}) == 650
    assert {(r.g, r.left_id, r.right_id) for r in rows if r.g != "g"} == {("h", 1, None), ("i", None, 5)}
    assert len(rows) == 700 + 2


@pytest.mark.parametrize("n", [0, 1, 5000])
def test_running_numbers(spark, n):
    df = spark.range(n).select((F.col("id") * 7919 % 10007).alias("v"), "id").repartition(7)
    got = {(r.v, r.place) for r in lookup.numbered(df, [F.col("v").desc(), F.col("id")], "place").collect()}
    assert got == {(v, i + 1) for i, v in enumerate(sorted((i * 7919 % 10007 for i in range(n)), reverse=True))}


def test_a_hot_group_and_null_groups(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 10 == 0, None).when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("g"), "id")
    first = {r.g: r.first_at for r in reference.first_of_group(df, "g", "id").collect()}
    assert first[None] == 0 and first["hot"] == 3 and first["7"] == 7 and reference.first_of_group(df, "g", "id").count() == 3000
    top = reference.first_problems(df.select("g", (F.col("id") % 50).alias("p")), ["g"], ["p"], 2).where("g = 'hot'").collect()
    assert sorted((r.p, r.n_at) for r in top) == [(1, 1), (2, 2)] and {r.n_total for r in top} == {45}


def test_queue(spark):
    q = spark.createDataFrame([("s", "a", 1), ("s", "b", 2), ("t", "a", 1)], "set_id string, ref string, n int")
    used = spark.createDataFrame([("s", "a"), ("t", "a"), ("u", "z")], "set_id string, ref string")
    assert [tuple(r) for r in attempts.next_in_queue(q, used, ["set_id"], "ref", "n").collect()] == [("s", "b")]


def test_options():
    with pytest.raises(lookup.InputError):
        lookup.exclusive(pool_for="x", filters=("noun", None))
    lookup.exclusive(pool_for=None, filters=("noun", None))
    with pytest.raises(lookup.InputError):
        lookup.one_of("level", "C1", ("A1",))
    with pytest.raises(lookup.InputError):
        lookup.by_id(None, "gp:1-2-3")


def test_file_names(spark):
    names = ["q01.gen1.candidate.invalid2.txt", "q01.gen1.candidate.invalid3.txt", "q20.gen3.review.invalid3.txt", "q21.gen1.machine.json", "q02.gen1.tool-prompt.txt", "set_check.final.json", "slot.q03.outcome.json", "q01.gen1.candidate.json\n"]
    rows = attempts.classified(spark.createDataFrame([(n,) for n in names], "name string")).collect()
    assert [(r.kind, r.question_id, r.n_invalid) for r in rows] == [("invalid", "q01", 2), (None, None, None), ("invalid", "q20", 3), (None, None, None), ("work", "q02", None), ("set_check", None, None), ("outcome", "q03", None), (None, None, None)]


def test_levels_and_references_are_whole_tokens(spark):
    df = spark.createDataFrame([("gp:1-2、A1.2-A2.1 xgp:3 :gp:4 A1.2. B2.3 (B1.1)",)], "t string")
    r = df.select(text.item_refs("t").alias("i"), text.level_refs("t").alias("l")).first()
    assert (r.i, r.l) == (["gp:1-2", "gp:4"], ["A1.2-A2.1", "B1.1"])
    names = spark.createDataFrame([(1,), (26,), (27,), (702,), (703,), (18279,), (0,), (None,)], "n int").select(text.column_name("n")).collect()
    assert [r[0] for r in names] == ["A", "Z", "AA", "ZZ", "AAA", "AAAA", None, None]
    spans = spark.createDataFrame([("a ____ b", "____"), ("cat_s", "cat"), ("cats", "cat"), ("猫s", "s"), ("x", "")], "t string, s string").select(text.holds_span("t", "s")).collect()
    assert [r[0] for r in spans] == [True, True, False, False, False]


def test_numbers(spark):
    df = spark.createDataFrame([("1.0", "1"), ("1e2", "100"), ("0.1", "0.10000000000000000001"), (None, "1")], "a string, b string")
    assert [r[0] for r in df.select(jsontext.equal_numbers("a", "b")).collect()] == [True, True, False, None]


def test_tokens_keep_their_places(spark):
    df = spark.createDataFrame([("He said  “no-no” to X.",), ("",), (None,)], "t string").withColumn("k", tokens.located("t"))
    rows = df.select("k", tokens.slice_of("t", "k", F.lit(3), F.lit(5)).alias("s"), tokens.slice_of("t", "k", F.lit(3), F.lit(99)).alias("no")).collect()
    assert all(r.start == "He said  “no-no” to X.".find(r.surface, r.start) for r in rows[0].k)
    assert (rows[0].s, rows[0].no, rows[1].k, rows[2].k) == ("no-no", None, [], None)


def test_contains_counts():
    rule = {"type": "array", "contains": {"const": True}, "max_contains": 1}
    assert [contract.problems(v, rule) for v in ([True, False], [], [True, True])] == [[], [("", "contains")], [("", "contains")]]


def test_rules_are_closed():
    assert contract.problems({"format": "grammar_cloze", "x": 1}, rules.ITEM)[-1] == ("/x", "additional")
    assert contract.problems({"format": "other"}, rules.ITEM) == [("/format", "tag")]


def test_review_references(spark):
    def item(i, present, raw, name, above):
        return (i, (present, raw, name), (above,))

    rows = [item("gp:1", True, "A1.1", "n1", None), item("gp:1-1", False, None, None, "gp:1"), item("gp:2", True, "A2.1", None, None), item("gp:2-1", False, None, None, "gp:2"), item("gp:3", False, None, None, None)]
    g = spark.createDataFrame(rows, "id string, kyoinban struct<present:boolean,level_raw:string,name_ja:string>, level struct<inherited_from:string>")
    assert {tuple(r) for r in reviews.teacher_references(g).collect()} == {("gp:1", "A1.1", None, "n1"), ("gp:1-1", "A1.1", "gp:1", "n1")}


def test_reviews_match_as_many_as_can_be(spark):
    """Two items share a violation; one of them has a second one, so both are matched only if the first gives way."""
    reviews_ = spark.createDataFrame([(1, "grammar_mcq", "A1.1", None, None, "fail", [("f", "ab cd")])], "k int, format string, level string, context string, topic string, verdict string, texts array<struct<field:string,text:string>>")
    inv = spark.createDataFrame([(1, 0, "s", "ab", "reviewer_estimate", None, "B1.1", "reviewer_estimate B1.1 推定"), (1, 1, "s", "cd", "reviewer_estimate", None, "B1.1", "reviewer_estimate B1.1 推定")], "k int, item_no int, structure string, span string, level_source string, grammar_item_id string, level string, evidence string")
    e = "reviewer_estimate B1.1 推定"
    vio = spark.createDataFrame([(1, 0, "CHK-03", 'f "ab" "cd"', e, "A1.1", "B1.1"), (1, 1, "CHK-03", 'f "ab"', e, "A1.1", "B1.1")], "k int, violation_no int, code string, location string, evidence string, expected_level string, actual_level string")
    checks = spark.createDataFrame([(1, "CHK-03", "fail", "")], "k int, check_id string, result string, note string")
    g = spark.createDataFrame([], "id string, kyoinban struct<present:boolean,level_raw:string,name_ja:string>, level struct<inherited_from:string>")
    assert reviews.problems(reviews_, checks, inv, vio, g, ["k"]).collect() == []
    one = reviews.problems(reviews_, checks, inv, vio.where("violation_no = 1"), g, ["k"]).collect()
    assert [(r.place, r.kind) for r in one] == [("inventory/1", "excess_without_violation")]
    assert reviews.problems(reviews_.limit(0), checks.limit(0), inv.limit(0), vio.limit(0), g, ["k"]).count() == 0


def _workbook(path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="ALL" sheetId="1" r:id="r2"/><sheet name="B" sheetId="2" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/one.xml"/><Relationship Id="r2" Target="/xl/worksheets/two.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>head</t></si><si><r><t>a</t></r><r><t>b</t></r><rPh><t>x</t></rPh></si></sst>")
        z.writestr("xl/worksheets/two.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row r="4"><c r="B4"><v>1.50</v></c><c t="b"><v>1</v></c><c r="AA4" t="inlineStr"><is><t>in</t></is></c><c r="AB4"/></row></sheetData></worksheet>')
        z.writestr("xl/worksheets/one.xml", f"<worksheet {ns}><sheetData/></worksheet>")


def test_workbooks(spark, tmp_path):
    _workbook(tmp_path / "a.xlsx")
    (tmp_path / "b.xlsx").write_bytes(b"no")
    found = workbooks.cells(spark, str(tmp_path)).collect()
    assert sorted((r.sheet, r.n_row, r.n_column, r.value) for r in found if r.problem is None) == [("ALL", 1, 1, "head"), ("ALL", 1, 3, "ab"), ("ALL", 4, 2, "1.50"), ("ALL", 4, 3, "true"), ("ALL", 4, 27, "in")]
    assert [(r.name, r.problem) for r in found if r.problem] == [("b.xlsx", "BadZipFile")]
    df = workbooks.cells(spark, str(tmp_path))
    assert [tuple(r) for r in workbooks.sheet_names(df).collect()] == [("a.xlsx", 1, "ALL")]
    assert [tuple(r) for r in workbooks.rows(df, "ALL", ["p", "q", "r"]).orderBy("n_row").collect()] == [("a.xlsx", 1, "head", None, "ab"), ("a.xlsx", 4, None, "1.50", "true")]


def test_views():
    item = {"format": "vocab_mcq_ja2en", "body": {"stem": "犬", "sentence_complete": "A dog & a dog.", "target_surface": "dog", "choices": [{"text": "<cat>", "is_correct": False}, None, {"text": "dog", "is_correct": True}]}, "explanation": None}
    page = sinks.set_page([item, {}, {"format": "grammar_cloze", "body": {"answer": "x", "answer_equivalents": ["y"]}, "explanation": {"text": "e<"}}], "T&")
    assert "A <mark>dog</mark> &amp; a dog." in page and "&lt;cat&gt;" in page and "B. dog" in page and "e&lt;" in page and "T&amp;" in page and page.count("<section") == 3


def test_outputs_are_no_inputs(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "link").symlink_to(tmp_path / "in")
    for target, inputs in (("in", ["in"]), ("in/sub", ["in"]), (".", ["in"]), ("link", ["in"])):
        with pytest.raises(sinks.Refused):
            sinks.refuse_inputs(spark, str(tmp_path / target), [str(tmp_path / i) for i in inputs])
    sinks.refuse_inputs(spark, str(tmp_path / "inner"), [str(tmp_path / "in")])
