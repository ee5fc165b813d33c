"""Operators on hand-made rows: boundaries, nulls, ties, brute force."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from lexiloom.operators import attempts, checks, contract, lookup, matching, reference, tokens, versions


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


ENTRIES = [
    ("lex:colour:noun", "Colour", "noun", "A1", "x", None, None, False, ["g1"]), ("lex:color:noun", "color", "noun", "A1", None, None, "x", False, ["g1"]),
    ("lex:colour:verb", "colour", "verb", "B1", None, None, None, False, []), ("lex:ice cream:noun", "ice cream", "noun", "A2", None, "x", None, True, []),
    ("lex:cream:noun", "cream", "noun", "A2", None, None, None, False, []), ("lex:ice cream van:noun", "ice cream van", "noun", "B1", None, None, None, True, []),
]
SCHEMA = "id string, headword string, pos string, level string, core_inventory_1 string, core_inventory_2 string, threshold string, is_multiword boolean, group_ids array<string>"


@pytest.fixture(scope="module")
def entries(spark):
    return spark.createDataFrame(ENTRIES, SCHEMA).cache()


def test_lookups(spark, entries):
    assert {r.id for r in lookup.filtered(entries, headword="COLOUR").collect()} == {"lex:colour:noun", "lex:color:noun", "lex:colour:verb"}
    assert {r.id for r in lookup.filtered(entries, headword="colour", pos="noun", category="x").collect()} == {"lex:colour:noun", "lex:color:noun"}
    got = lookup.page(lookup.filtered(entries, pos="noun"), lookup.in_order(entries), 2).collect()
    assert [(r.headword, r.total) for r in got] == [("color", 5), ("Colour", 5)]
    assert lookup.page(lookup.filtered(entries, pos="none"), lookup.in_order(entries), 2).count() == 0
    for bad in (0, 201, True, "3"):
        with pytest.raises(lookup.InputError):
            lookup.page(entries, [], bad)
    assert [(r.headword, r.ordinal) for r in lookup.with_ordinal(entries).orderBy("ordinal").limit(3).collect()] == [("color", 1), ("Colour", 2), ("colour", 3)]


def test_pools_and_requests(spark, entries):
    got = rows(lookup.pools(entries.where("id = 'lex:colour:noun'"), entries, 5))
    assert got == [("lex:colour:noun", "lex:color:noun", 3, 1)]
    req = spark.createDataFrame([(1, "　Ｃolour", "A1", "noun"), (2, "colour", "A1", None), (3, "colour", "B2", None), (4, "nothing", "A1", None)], "n int, typed string, level string, pos string")
    assert {r.n: r.status for r in lookup.resolve(req, entries).collect()} == {1: "not_in_dictionary", 2: "match", 3: "level_mismatch", 4: "not_in_dictionary"}
    both = entries.withColumn("level", F.lit("A1"))
    assert {r.n: r.status for r in lookup.resolve(req.where("n = 2"), both).collect()} == {2: "ambiguous_pos"}
    dup = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "o int, k string")
    assert rows(lookup.first_of_each(dup, "k", "o")) == [(1, "a"), (3, "b")]
    assert rows(lookup.replacements(dup, dup.where("o = 1"), "k").select("o", "k")) == [(3, "b")]


def test_ranges(spark):
    g = spark.createDataFrame([("gp:1", True, ("A1.1", "A2.1"), None), ("gp:2", True, (None, None), "gp:1"), ("gp:3", False, ("A1.1", "B2.2"), "gp:1"), ("gp:4", True, ("A2.1", "A2.1"), "gp:9")], "id string, target_eligible boolean, level struct<min:string,max:string>, parent_id string")
    assert {r.id for r in lookup.grammar_at(g, "A2.1").collect()} == {"gp:1", "gp:4"}
    assert {r.id for r in lookup.grammar_at(g, "A2.1", exclude=["gp:9"]).collect()} == {"gp:1"}
    points = spark.createDataFrame([(1, 3), (2, 9), (3, None)], "p int, rank int")
    ranges = spark.createDataFrame([("a", 1, 3), ("b", 3, 9), ("c", 5, 4), ("d", None, 9)], "r string, low int, high int")
    assert {(r.p, r.r) for r in lookup.containing(points, "rank", ranges, "low", "high").collect()} == {(1, "a"), (1, "b"), (2, "b")}


def test_sheets_and_integrity(spark):
    sheet = spark.createDataFrame([(1, "h", None), (2, "a", "b"), (3, " ", None), (4, "c", None), (6, None, "x")], "n_row int, a string, b string")
    assert reference.not_blank(sheet, ["a", "b"]).count() == 4
    assert rows(reference.slice_problems(sheet, ["a", "b"], 2, 4)) == [(3, "blank_inside"), (6, "filled_after")]
    assert ("missing_rows",) in [r[1:] for r in rows(reference.slice_problems(sheet, ["a", "b"], 2, 9))]
    heads = spark.createDataFrame([(1, "ID"), (2, "Name"), (3, "Name"), (4, "Level (x)")], "position int, header string")
    assert rows(reference.header_problems(heads, ["ID", "Name", "Other"])) == [("Name", 2), ("Other", 0)]
    assert rows(reference.prefixed_header(heads, "Level")) == [(4,)] and rows(reference.prefixed_header(heads, "Name")) == []
    assert rows(reference.placed_headers(heads, {1: "ID", 2: "Nom", 9: "X"})) == [(2, "Nom", "Name"), (9, "X", None)]
    assert rows(reference.missing_names(heads, ["ID", "Z"], "header")) == [("Z",)]
    items = spark.createDataFrame([("1", None), ("1-1", "1"), ("1-2", "1"), ("2-1", "2")], "id string, parent_id string")
    teacher = spark.createDataFrame([("1", "A1.1-A2.1"), ("1-2", "B1.1"), ("2", "bad")], "id string, level_raw string")
    assert rows(reference.inherited(items, teacher)) == [
        ("1", "A1.1", "A2.1", "kyoinban_direct", None), ("1-1", "A1.1", "A2.1", "kyoinban_inherited", "1"), ("1-2", "B1.1", "B1.1", "kyoinban_direct", None), ("2-1", None, None, None, None),
    ]
    members = spark.createDataFrame([("g", 0, "a", "noun", "A1"), ("g", 2, "a", "verb", "A2"), ("h", 0, "x", None, None), ("k", 0, "p", "noun", "A1"), ("k", 1, "q", "noun", "A1")], "group_id string, position int, entry_id string, entry_pos string, entry_level string")
    assert rows(reference.group_problems(members)) == [("g", 3, "repeated_member"), ("g", 4, "mixed_pos"), ("g", 5, "mixed_level"), ("g", 6, "position_gap"), ("h", 1, "too_few"), ("h", 2, "missing_member")]
    assert rows(reference.histogram_problems(members, "entry_level", {"A1": 3, "B1": 1})) == [("A2", 0, 1), ("B1", 1, 0), (None, 0, 1)]
    made = reference.health({"fine": True, "bad": members, "broken": members.select(F.raise_error(F.lit("x")))})
    assert [(m["name"], m["passed"]) for m in made] == [("fine", True), ("bad", False), ("broken", False)]
    assert rows(reference.orphans(items, "parent_id", items, "id")) == [("2-1", "2")]


def test_versions(spark):
    old = spark.createDataFrame([("a", 1, None), ("b", 2, "x"), ("c", 3, None)], "k string, v int, w string")
    new = spark.createDataFrame([("b", 2, None), ("c", 3, None), ("d", None, None)], "k string, v int, w string")
    changed = versions.changes(old, new, "k", ["v", "w"])
    assert rows(changed) == [("a", "removed"), ("b", "changed"), ("d", "added")]
    assert [(r.bucket, r.n, r.first_keys) for r in versions.summary(changed, "k").orderBy("bucket").collect()] == [("added", 1, ["d"]), ("changed", 1, ["b"]), ("removed", 1, ["a"])]
    assert rows(versions.both_ways(old, new, "k")) == [("a", "left"), ("d", "right")]
    assert rows(versions.in_both(old, new, "k")) == [("b",), ("c",)] and versions.in_either(old, new, "k").count() == 4
    d = spark.createDataFrame([("f", "1"), ("g", "2")], "name string, sha256 string")
    assert rows(versions.digest_mismatches(d, d.where("name = 'f'"))) == [("g", "2", None)]


def _greedy(words, patterns):
    at, out = 0, []
    while at < len(words):
        hit = max(((len(p.split()), p) for p in patterns if words[at : at + len(p.split())] == p.split()), default=None)
        if hit:
            out.append((at, hit[1]))
            at += hit[0]
        else:
            at += 1
    return out


def test_phrases_against_a_sequential_version(spark):
    rng = random.Random(4)
    vocabulary = ["a", "b", "c"]
    patterns = sorted({" ".join(rng.choice(vocabulary) for _ in range(rng.randint(2, 4))) for _ in range(9)})
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 25))) for _ in range(60)]
    p = spark.createDataFrame([(x, x, len(x.split())) for x in patterns], "phrase_id string, phrase string, size int")
    got = {}
    for r in tokens.phrases(spark.createDataFrame(list(enumerate(texts)), "i int, t string"), ["i"], "t", p).collect():
        got.setdefault(r.i, []).append((r.start, r.phrase_id))
    assert {i: sorted(v) for i, v in got.items()} == {i: w for i, t in enumerate(texts) if (w := _greedy(t.split(), patterns))}


def test_longest_phrase_and_decisions(spark, entries):
    texts = spark.createDataFrame([(1, "The Ice cream van sold ICE CREAM.")], "i int, t string")
    assert rows(tokens.phrases(texts, ["i"], "t", tokens.phrase_patterns(entries))) == [(1, 1, "lex:ice cream van:noun", 3), (1, 5, "lex:ice cream:noun", 2)]
    t = tokens.positioned(spark.createDataFrame([(1, "Colour cream XYZ xyz 3rd Anna's can't ! 12:30 3rdx")], "i int, t string"), ["i"], "t")
    got = [r.decision for r in tokens.decisions(t, entries, ["XYZ"], F.lit(1)).orderBy("at").collect()]
    assert got == ["wordlist_match", "above_level", "allowlist", "unknown", "exempt", "exempt", "exempt", "exempt", "exempt", "exempt", "exempt", "exempt", "unknown"]
    prio = spark.createDataFrame([("VB", "verb", 0), ("VB", "noun", 1)], "tag string, pos string, prio int")
    w = spark.createDataFrame([("colour", "VB"), ("colour", "ZZ"), ("none", "VB")], "word string, tag string")
    assert rows(tokens.pos_choice(w, entries, prio)) == [("colour", "VB", "lex:colour:verb", False), ("colour", "ZZ", "lex:colour:noun", True), ("none", "VB", None, None)]


def test_tags_and_lemmas(spark):
    df = spark.createDataFrame([("ca", "ca", "MD", "AUX"), ("is", "be", "VBZ", "AUX"), ("to", "to", "TO", "PART"), ("to", "to", "TO", "X"), ("that", "", "IN", "SCONJ"), ("x", "x", "??", "X")], "s string, l string, t string, u string")
    lemma = tokens.fixed_lemma(F.col("s"), F.col("l"))
    got = [(r[0], r[1]) for r in df.coalesce(1).select(lemma, tokens.vocabulary_pos(F.col("t"), F.col("u"), lemma)).collect()]
    assert got == [("can", ["modal auxiliary"]), ("be", ["be-verb"]), ("to", ["infinitive-to"]), ("to", []), ("that", ["preposition", "conjunction"]), ("x", [])]
    assert tokens.tag_priorities(spark).where("tag = 'DT'").count() == 2


def test_tagger_offsets(spark):
    df = spark.createDataFrame([(1, "Hi, you. 3 cats!"), (2, None), (3, "")], "i int, t string")
    got = {r.i: r.tokens for r in tokens.tag(df, "t").collect()}
    assert [(x.surface, x.start, x.sentence) for x in got[1]] == [("Hi", 0, 0), (",", 2, 0), ("you", 4, 0), (".", 7, 0), ("3", 9, 1), ("cats", 11, 1), ("!", 15, 1)]
    assert got[2] is None and got[3] == []


def test_item_checks(spark):
    schema = "rec_id int, s string, level string, choices array<struct<text:string,is_correct:boolean>>, a string, b string"
    right, wrong = ("x", True), ("y", False)
    items = spark.createDataFrame([
        (1, "one two three. Four", "A1.1", [right, wrong, ("z", False), ("w", False)], None, None),
        (2, "one", "A1.1", [right, right, ("X ", False), None], "p", None),
        (3, None, None, None, None, "q"),
    ], schema)
    limits = [checks.word_limit("s", "s", "level", {"A1": 3}), checks.one_sentence("s", "s"), checks.paired("a", "b", "c"), *checks.choices("choices", "answer")]
    got = sorted((r.rec_id, r.code) for r in checks.apply(items, limits).collect())
    assert got == [(1, "sentence_count"), (1, "too_many_words"), (2, "choice_count"), (2, "correct_count"), (2, "half_pair"), (2, "same_choice"), (3, "half_pair")]
    verdict = tokens.verdicts(items, ["rec_id"], checks.apply(items, limits))
    assert rows(verdict) == [(1, 2, "fail"), (2, 4, "fail"), (3, 1, "fail")]
    o = spark.createDataFrame([(["a", "b"], ["b", "a"]), (["a"], ["a"]), (["a", "a"], ["a", "b"])], "x array<string>, y array<string>").withColumn("rec_id", F.monotonically_increasing_id())
    assert sorted(r.code for r in checks.apply(o, checks.reordered(F.col("x"), F.col("y"))).collect()) == ["other_tokens", "same_order"]


def test_audit_names_and_sequences(spark):
    names = ["q01.gen1.candidate.json", "q01.gen4.candidate.json", "q20.gen3.review.invalid2.txt", "set_check.final.json", "set_check.q02.gen1.json", "slot.q03.outcome.json", "x.json", "q21.gen1.candidate.json", "q01.gen1.candidate.invalid3.txt"]
    got = {r.name: (r.kind, r.question_id, r.generation, r.part, r.n_invalid) for r in attempts.classified(spark.createDataFrame([(n,) for n in names], "name string")).collect()}
    assert got["q01.gen1.candidate.json"] == ("part", "q01", "gen1", "candidate", None) and got["q01.gen4.candidate.json"][0] is None and got["x.json"][0] is None
    assert got["q21.gen1.candidate.json"][0] is None and got["q01.gen1.candidate.invalid3.txt"][0] is None
    assert got["q20.gen3.review.invalid2.txt"] == ("invalid", "q20", "gen3", "review", 2) and got["set_check.final.json"][0] == got["set_check.q02.gen1.json"][0] == "set_check"
    assert got["slot.q03.outcome.json"] == ("outcome", "q03", None, None, None)
    bad = spark.createDataFrame([("q01.gen1.review.invalid2.txt",), ("q02.gen1.candidate.invalid1.txt",), ("q02.gen1.candidate.invalid2.txt",), ("q02.gen1.candidate.json",), ("q03.gen1.review.invalid1.txt",)], "name string")
    assert rows(attempts.invalid_sequences(attempts.classified(bad), ["question_id", "generation"])) == [("q01", "gen1", "review", "2"), ("q02", "gen1", "candidate", "1,2")]


def test_generations(spark):
    data = [("s", "q1", "gen1", 1, True), ("s", "q1", "gen2", 2, False), ("s", "q2", "gen1", 3, False), ("s", "q2", "gen3", 4, True), ("s", "q3", "gen1", 5, True), ("s", "q3", "gen1", 6, True)]
    a = spark.createDataFrame(data, "set_id string, question_id string, generation string, rec_id int, ok boolean")
    key = ["set_id", "question_id"]
    assert [r.rec_id for r in attempts.latest(a, key, "generation", F.col("ok")).orderBy("question_id").collect()] == [1, 4, 5]
    over = attempts.latest_with_override(a, key, "generation", F.col("ok"), F.lit(True), F.col("question_id") == "q1")
    assert [r.rec_id for r in over.orderBy("question_id").collect()] == [2, 4, 5]
    assert rows(attempts.gaps(a, key, "generation")) == [("s", "q2", 2, 3)]
    assert [r.sound for r in attempts.terminal(a, key, "generation", F.col("ok")).orderBy("question_id").collect()] == [False, True, True]
    parts = spark.createDataFrame([(1, "a", "x"), (1, "b", "y"), (2, "a", "z")], "k int, kind string, v string")
    assert rows(attempts.assembled(parts, ["k"], "kind", "v", ["a", "b"])) == [(1, "x", "y", True), (2, "z", None, False)]


def _size(pairs):
    return max((k for k in range(len(pairs) + 1) for c in combinations(pairs, k) if len({a for a, _ in c}) == k == len({b for _, b in c})), default=0)


def test_matching_is_maximum(spark):
    rng = random.Random(2)
    for _ in range(150):
        pairs = list({(rng.randint(0, 4), rng.randint(10, 14)) for _ in range(rng.randint(0, 9))})
        got = matching.maximum_matching(pairs)
        assert set(got.items()) <= set(pairs) and len(set(got.values())) == len(got) == _size(pairs)
    left = spark.createDataFrame([("g", 1, "x"), ("g", 2, "x"), ("h", 3, "x"), ("h", 9, None)], "g string, left_id int, k string")
    right = spark.createDataFrame([("g", 7, "x"), ("h", 8, "y")], "g string, right_id int, k string")
    assert rows(matching.match(left, right, "g", ["k"])) == [("g", 1, 7), ("g", 2, None), ("h", 3, None), ("h", 9, None), ("h", None, 8)]


def test_contract(spark):
    rule = {"tag": "f", "one_of": {
        "a": {"type": "object", "required": ["n"], "properties": {"f": {}, "n": {"type": "integer", "minimum": 1, "maximum": 20}, "xs": {"type": "array", "unique": True, "max_items": 2, "contains": {"const": 1}}}},
        "b": {"type": "object", "open": True, "properties": {"s": {"type": "string", "min_length": 1, "max_length": 2, "pattern": "^.$", "enum": ["é", "zz"]}}},
    }}
    check = lambda s: contract.problems(contract.read_strict(s), rule)
    assert check('{"f":"a","n":1}') == check('{"f":"a","n":20.0}') == check('{"f":"b","s":"é","zz":1}')[:0] == []
    assert check('{"f":"a","n":20.5}') == [("/n", "type number")] and check('{"f":"a","n":true}') == [("/n", "type boolean")]
    assert check('{"f":"a","n":21,"z":0}') == [("/n", "maximum"), ("/z", "additional")]
    assert check('{"f":"a","xs":[2,2.0,3]}') == [("/n", "required"), ("/xs", "max_items"), ("/xs", "contains")]
    assert check('{"f":"a","n":1,"xs":[1,1]}') == [("/xs", "unique")]
    assert check('{"f":"q"}') == check('{}') == [("/f", "tag")] and check('{"f":"b","s":""}') == [("/s", "enum"), ("/s", "min_length"), ("/s", "pattern")]
    df = spark.createDataFrame([(1, '{"f":"a","n":1}'), (2, "{"), (3, None), (4, '{"f":"a","n":0,"z":1,"y":1}')], "k int, j string")
    assert rows(contract.violations(df, "k", "j", rule)) == [(2, "", "json", 1), (4, "/n", "minimum", 3), (4, "/y", "additional", 3), (4, "/z", "additional", 3)]
    assert contract.violations(df, "k", "j", rule, first=1).count() == 2
    keys = [tuple(r.s) for r in df.select(contract.key_sets("j", ["f", "q"]).alias("s")).where("s.missing is not null").collect()]
    assert keys[0] == (["q"], ["n"])


ANCHORED = "rec_id int, level string, ref string, relaxed boolean, choices array<struct<is_correct:boolean,anchor:struct<entry_id:string,pos:string,level:string>>>"


def test_anchor_rules(spark, entries):
    right = (True, ("lex:colour:noun", "noun", "A1"))
    color, verb, cream = (False, ("lex:color:noun", "noun", "A1")), (False, ("lex:colour:verb", "verb", "B1")), (False, ("lex:cream:noun", "noun", "A2"))
    number, modal = (False, ("lex:x:number", "number", "A1")), (False, ("lex:y:modal-auxiliary", "modal auxiliary", "B1"))
    one = [("lex:x:number", "x", "number", "A1", None, None, None, False, [])]
    items = spark.createDataFrame([
        (1, " \uff41\u200b1", "lex:colour:noun", False, [right, color, None, (False, None)]),
        (2, "A1", "lex:colour:noun", False, [right, cream, number]),
        (3, "A1", "lex:colour:noun", True, [right, number]),
        (4, "A1", "lex:colour:noun", True, [right, color]),
        (5, "A1", "lex:colour:noun", False, [(True, ("lex:color:noun", "noun", "A1")), (False, right[1]), color]),
        (6, "B1", "lex:no:modal-auxiliary", False, [modal, verb]),
        (7, None, None, None, [right, cream]),
        (8, "A1", "lex:colour:noun", True, None),
        (9, "A1", "lex:colour:noun", None, []),
        (10, "A1", "lex:colour:noun", True, [right, verb, (False, ("lex:none:number", "number", "A1"))]),
    ], ANCHORED)
    got = checks.anchor_rules(items, "choices", "level", "ref", "relaxed", entries.unionByName(spark.createDataFrame(one, SCHEMA)))
    assert sorted((r.rec_id, r.code, r.location) for r in got.collect()) == [
        (2, "distractor_level", "choices/1"), (2, "distractor_pos", "choices/2"), (4, "relaxed_unused", "pos_pool_relaxed"),
        (5, "anchor_repeated", "choices"), (5, "correct_not_target", "choices"), (5, "wrong_is_target", "choices"),
        (6, "correct_not_target", "choices"), (6, "distractor_pos", "choices/1"), (9, "correct_not_target", "choices"),
        (10, "distractor_level", "choices/1"), (10, "distractor_pos", "choices/1"),
    ]


def test_hyphenated_and_inflected_phrases(spark, entries):
    more = [("lex:T-shirt:noun", "T-shirt", "noun", "A1", None, None, None, True, []), ("lex:look after:verb", "look after", "verb", "A2", None, None, None, True, [])]
    e = entries.unionByName(spark.createDataFrame(more, SCHEMA))
    texts = spark.createDataFrame([(1, "A t-shirt, T-Shirts; ice-cream"), (2, "She looked after ice creams.")], "i int, t string")
    assert rows(tokens.phrases(texts, ["i"], "t", tokens.phrase_patterns(e))) == [(1, 1, "lex:T-shirt:noun", 3)]

    def tagger(batch):
        for out in tokens.plain_tagger(batch):
            yield [(s, {"looked": "look", "creams": "cream", "shirts": "shirt"}.get(low, low), *rest) for s, low, *rest in out]

    assert rows(tokens.phrases(texts, ["i"], "t", tokens.phrase_patterns(e, tagger), tagger)) == [(1, 1, "lex:T-shirt:noun", 3), (1, 5, "lex:T-shirt:noun", 3), (2, 1, "lex:look after:verb", 2), (2, 3, "lex:ice cream:noun", 2)]


def test_targets_and_declared_anchors_among_phrases(spark, entries):
    own = tokens.phrase_patterns(entries, single=True)
    texts = spark.createDataFrame([
        (1, "Colour of ice cream van", "lex:ice cream:noun", None), (2, "ice cream, cream", "lex:cream:noun", None),
        (3, "ice cream", "lex:ice cream:noun", None), (4, "Ice Cream", None, "lex:ice cream:noun"), (5, "a colour", None, "lex:colour:noun"), (6, "colour", "lex:colour:noun", "lex:colour:noun"),
    ], "i int, t string, target string, declared string")
    got = tokens.phrase_spans(texts, ["i"], "t", tokens.phrase_patterns(entries), target="target", declared="declared", own=own)
    assert rows(got) == [
        (1, 2, "lex:ice cream van:noun", 3, "multiword_match", "ice cream van"), (2, 0, "lex:ice cream:noun", 2, "multiword_match", "ice cream"), (2, 3, "lex:cream:noun", 1, "target", "cream"),
        (3, 0, "lex:ice cream:noun", 2, "target", "ice cream"), (4, 0, "lex:ice cream:noun", 2, "wordlist_match", "Ice Cream"), (6, 0, "lex:colour:noun", 1, "wordlist_match", "colour"),
    ]


def test_phrases_are_decided_before_single_words(spark, entries):
    more = [("lex:upstairs room:noun", "upstairs room", "noun", "A2", None, None, None, True, []), ("lex:T-shirt:noun", "T-shirt", "noun", "A1", None, None, None, True, [])]
    e = entries.unionByName(spark.createDataFrame(more, SCHEMA))
    texts = spark.createDataFrame([(1, "Upstairs room, upstairs room: a T-shirt, an ice cream van and cream"), (2, "upstairs"), (3, "T-shirt cream T-shirt"), (4, "")], "i int, t string")
    got = tokens.phrase_decisions(tokens.counted(texts, ["i"], "t", tokens.phrase_patterns(e)), e, ["a", "an", "and"], F.lit(2))
    assert rows(got.where("decision <> 'exempt'").select("i", "surface", "size", "n", "decision")) == sorted([
        (1, "Upstairs room", 2, 1, "multiword_match"), (1, "upstairs room", 2, 1, "multiword_match"), (1, "T - shirt", 3, 1, "multiword_match"), (1, "ice cream van", 3, 1, "above_level"),
        (1, "cream", 1, 1, "wordlist_match"), (1, "a", 1, 1, "allowlist"), (1, "an", 1, 1, "allowlist"), (1, "and", 1, 1, "allowlist"),
        (2, "upstairs", 1, 1, "unknown"), (3, "T - shirt", 3, 2, "multiword_match"), (3, "cream", 1, 1, "wordlist_match"),
    ], key=str)
    assert rows(tokens.verdicts(texts, ["i"], got.where("decision in ('above_level', 'unknown')"))) == [(1, 1, "fail"), (2, 1, "fail"), (3, 0, "pass"), (4, 0, "pass")]


def test_target_levels(spark, entries):
    data = [(1, "a1", "lex:colour:noun"), (2, "B1", "lex:colour:noun"), (3, "A1", "lex:none:noun"), (4, None, "lex:colour:noun"), (5, "A1", None), (6, "A2.1", "lex:cream:noun")]
    items = spark.createDataFrame(data, "rec_id int, level string, ref string")
    got = [(r.rec_id, r.code, r.expected, r.actual) for r in checks.targets(items, "ref", entries, level="level").collect()]
    assert sorted(got) == [(2, "target_level", "B1", "A1"), (3, "target_missing", None, None)]
    assert rows(checks.targets(items, "ref", entries).select("rec_id", "code")) == [(3, "target_missing")]


def test_matching_of_large_and_of_mixed_groups(spark):
    left = spark.range(600).selectExpr("'g' as g", "cast(id as int) as left_id", "'x' as k")
    right = spark.range(700).selectExpr("'g' as g", "cast(1000 + id as int) as right_id", "'x' as k")
    got = matching.match(left, right, "g", ["k"])
    pairs = got.where("left_id is not null and right_id is not null").collect()
    assert len(pairs) == len({r.left_id for r in pairs}) == len({r.right_id for r in pairs}) == 600 and got.count() == 700
    mixed = spark.createDataFrame([("h", 1, "x"), ("h", 1, "y"), ("h", 2, "x")], "g string, left_id int, k string")
    others = spark.createDataFrame([("h", 7, "x"), ("h", 8, "y"), ("h", 9, None)], "g string, right_id int, k string")
    assert rows(matching.match(mixed, others, "g", ["k"])) == [("h", 1, 8), ("h", 2, 7), ("h", None, 9)]
