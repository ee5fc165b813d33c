"""Texts and checks of items on hand-made rows, all nine formats."""

import json

import pytest
from pyspark.sql import functions as F

from lexiloom.operators import items, rules

CHOICES = "array<struct<text:string,is_correct:boolean,gloss:string,anchor:struct<entry_id:string,headword:string,pos:string,level:string>>>"
PLAIN = "array<struct<text:string,is_correct:boolean>>"
BODY = {
    "vocab_mcq_en2ja": f"stem string, target_surface string, stem_ja string, choices {CHOICES}, pos_pool_relaxed boolean",
    "vocab_mcq_ja2en": f"stem string, sentence_with_blank string, sentence_complete string, target_surface string, sentence_ja string, choices {CHOICES}, pos_pool_relaxed boolean",
    "vocab_flashcard_en2ja": "headword string, pos string, gloss string, example struct<en:string,ja:string>, target_surface string",
    "vocab_flashcard_ja2en": "headword string, pos string, gloss string, example struct<en:string,ja:string>, target_surface string",
    "grammar_mcq": f"sentence_with_blank string, choices {PLAIN}, example_ja string, context_sentence string, context_required_by string",
    "grammar_cloze": "sentence_with_blank string, cue string, answer string, answer_equivalents array<string>, example_ja string, context_sentence string, context_required_by string",
    "grammar_reorder": "tokens_shuffled array<string>, answer_sentence string, example_ja string",
    "grammar_rewrite": "source_sentence string, instruction string, target_sentence_with_blank string, answer string, answer_equivalents array<string>, source_ja string, target_ja string",
    "grammar_example_selfcheck": "example struct<en:string,ja:string>, context_sentence string, context_required_by string",
}
HEAD = "rec_id long, set_id string, question_id string, format string, level struct<scale:string,value:string>, target struct<type:string,ref:string,display_name:string>, explanation struct<type:string,text:string>"


def _struct(fields: str) -> str:
    out, depth = "", 0
    for c in fields:  # "a string" becomes "a:string" at the outer level only
        depth += (c == "<") - (c == ">")
        out += ":" if c == " " and depth == 0 and out and out[-1] not in ",:" and not out.endswith(", ") else c
    return f"struct<{out.replace(', ', ',')}>"


def frame(spark, fmt, *bodies, level="A1.1", ref="lex:dog:noun", **more):
    rows = []
    for i, body in enumerate(bodies):
        row = {"rec_id": i, "set_id": "s", "question_id": "q01", "format": fmt, "level": {"scale": "cefrj", "value": level}, "target": {"type": "x", "ref": ref, "display_name": "d"}, "explanation": None, "body": body, **more}
        rows.append((json.dumps(row),))
    return spark.createDataFrame(rows, "j string").select(F.from_json("j", f"{HEAD}, body {_struct(BODY[fmt])}").alias("r")).select("r.*")


def got(df):
    return sorted((r.rec_id, r.code, r.location) for r in df.collect())


TEXTS = {
    "vocab_mcq_en2ja": ({"stem": "A dog.", "choices": []}, [("body.stem", "A dog.", True, True, None)]),
    "vocab_mcq_ja2en": (
        {"sentence_complete": "A dog.", "choices": [{"text": "dog", "anchor": {"entry_id": "lex:dog:noun"}}, None]},
        [("body.sentence_with_blank#filled:answer", "A dog.", True, True, None), ("body.choices[0].text", "dog", False, False, "lex:dog:noun")],
    ),
    "vocab_flashcard_ja2en": ({"example": {"en": "x"}}, [("body.example.en", "x", True, True, None)]),
    "grammar_mcq": (
        {"sentence_with_blank": "I ____.", "choices": [{"text": "ran", "is_correct": False}, {"text": "run", "is_correct": True}, {"text": None}], "context_sentence": "c"},
        [("body.sentence_with_blank#filled:answer", "I run.", True, False, None), ("body.sentence_with_blank#filled:choices[0]", "I ran.", True, False, None), ("body.context_sentence", "c", True, False, None)],
    ),
    "grammar_cloze": (
        {"sentence_with_blank": "____ and ____", "answer": "a", "answer_equivalents": ["b", None, "c"]},
        [("body.sentence_with_blank#filled:answer", "a and a", True, False, None), ("body.answer_equivalents[0]", "b", False, False, None), ("body.answer_equivalents[2]", "c", False, False, None)],
    ),
    "grammar_reorder": ({"answer_sentence": "I go."}, [("body.answer_sentence", "I go.", True, False, None)]),
    "grammar_rewrite": ({"source_sentence": "s", "target_sentence_with_blank": "t ____", "answer": None}, [("body.source_sentence", "s", True, False, None)]),
    "grammar_example_selfcheck": ({"example": None, "context_sentence": None}, []),
}


@pytest.mark.parametrize("fmt", TEXTS)
def test_english_texts(spark, fmt):
    body, want = TEXTS[fmt]
    rows = items.english_texts(frame(spark, fmt, body), fmt, ["rec_id"]).collect()
    assert [(r.field, r.text, r.sentence, r.target, r.anchor) for r in rows] == want


@pytest.mark.parametrize("fmt", BODY)
def test_missing_bodies_and_empty_tables(spark, fmt):
    for df in (frame(spark, fmt, {}), frame(spark, fmt, {}).limit(0)):
        assert items.english_texts(df, fmt, ["rec_id"]).count() == 0 and items.japanese_texts(df, fmt, ["rec_id"]).count() == 0
        assert items.text_problems(df, fmt, ["rec_id"], "level.value", {"A1": 3}, {"brief": 2}).count() == 0


def test_japanese_texts(spark):
    df = frame(spark, "vocab_mcq_en2ja", {"stem_ja": "文", "choices": [{"text": "犬", "gloss": None}, {"text": "cat", "gloss": "猫"}]})
    assert [(r.field, r.text) for r in items.japanese_texts(df, "vocab_mcq_en2ja", ["rec_id"]).collect()] == [("body.stem_ja", "文"), ("body.choices[0].text", "犬"), ("body.choices[1].text", "cat"), ("body.choices[1].gloss", "猫")]
    df = frame(spark, "grammar_reorder", {"example_ja": "例"}, explanation={"type": "brief", "text": "e"})
    assert got(items.text_problems(df, "grammar_reorder", ["rec_id"], "level.value", {}, {"brief": 3})) == [(0, "V-JPN-01", "explanation.text")]


def test_text_problems(spark):
    df = frame(
        spark, "grammar_cloze", {"sentence_with_blank": "One ____ three.", "answer": "two", "context_required_by": "前文が肯定平叙"},
        {"sentence_with_blank": "One ____ three", "answer": "two. Then", "context_sentence": "Well.", "context_required_by": "否定"}, {"sentence_with_blank": "a b c ____", "answer": "d"},
        explanation={"type": "brief", "text": "がぎ"},
    )
    found = got(items.text_problems(df, "grammar_cloze", ["rec_id"], "level.value", {"A1": 3}, {"brief": 1}))
    filled = "body.sentence_with_blank#filled:answer"
    assert found == [
        (0, "V-EXP-01", "explanation.text"), (0, "V-SENT-01", "body.context_sentence / body.context_required_by"),
        (1, "V-CLZ-01", filled), (1, "V-EXP-01", "explanation.text"), (1, "V-LEN-01", filled), (1, "V-SENT-01", "body.context_required_by"), (1, "V-SENT-01", filled),
        (2, "V-EXP-01", "explanation.text"), (2, "V-LEN-01", filled),
    ]
    assert items.text_problems(df, "grammar_cloze", ["rec_id"], "level.value", {"A1": 9}, {"brief": 2}).where("code = 'V-EXP-01'").count() == 0  # two characters once composed


def test_conditions_and_the_cap_on_numbers(spark):
    df = frame(spark, "grammar_reorder", {}, {}, {}).withColumn("question_id", F.concat(F.lit("q0"), F.col("rec_id") + 4)).withColumn("format", F.when(F.col("rec_id") != 1, F.col("format")))
    c = spark.createDataFrame([("s", "grammar_reorder", "cefrj", "A1.2", 2)], "set_id string, set_format string, set_scale string, set_value string, requested_count int")
    assert got(items.condition_problems(df, c, ["rec_id"], ["set_id"])) == [(0, "V-COND-01", "level"), (1, "V-COND-01", "format"), (1, "V-COND-01", "level"), (1, "V-COND-01", "question_id"), (2, "V-COND-01", "level"), (2, "V-COND-01", "question_id")]
    assert [r[0] for r in spark.range(3).select(items.ordinal_cap(F.col("id") * 7)).collect()] == [0, 14, 20]


def test_choice_keys_differ_by_language(spark):
    four = lambda *t: {"choices": [{"text": x, "is_correct": i == 0} for i, x in enumerate(t)]}
    bodies = (four("が", "が ", "a", "A"), four("a", "A", "b", "c"), four("a", "b", "c"), {"choices": None}, four())
    where = "body.choices[*].text"
    assert got(items.choice_problems(frame(spark, "vocab_mcq_en2ja", *bodies), "vocab_mcq_en2ja", ["rec_id"])) == [(0, "V-CHO-01", where), (2, "V-CHO-01", "body.choices"), (4, "V-CHO-01", "body.choices")]
    assert got(items.choice_problems(frame(spark, "grammar_mcq", *bodies), "grammar_mcq", ["rec_id"])) == [(0, "V-CHO-01", where), (1, "V-CHO-01", where), (2, "V-CHO-01", "body.choices"), (4, "V-CHO-01", "body.choices")]


@pytest.fixture(scope="module")
def entries(spark):
    rows = [("dog", "noun", "A1"), ("dog", "verb", "B1"), ("cat", "noun", "A1"), ("hot dog", "noun", "A1"), ("seven", "number", "A1"), ("big", "adjective", "A1")]
    return spark.createDataFrame([(f"lex:{h}:{p}", h, p, v, " " in h) for h, p, v in rows], "id string, headword string, pos string, level string, is_multiword boolean")


def anchor(head, pos, level, right=False, **more):
    return {"text": head, "is_correct": right, "anchor": {"entry_id": f"lex:{head}:{pos}", "headword": head, "pos": pos, "level": level, **more}}


def test_anchors(spark, entries):
    dog, cat, seven, verb, big = anchor("dog", "noun", "A1", True), anchor("cat", "noun", "A1"), anchor("seven", "number", "A1"), anchor("dog", "verb", "B1"), anchor("big", "adjective", "A1")
    bodies = (
        {"choices": [dog, cat]}, {"choices": [dog, seven]}, {"choices": [dog, seven], "pos_pool_relaxed": True}, {"choices": [dog, cat], "pos_pool_relaxed": True}, {"choices": [dog, verb, big]},
        {"choices": [dog, cat, cat]}, {"choices": [cat | {"is_correct": True}, dog | {"is_correct": False}]}, {"choices": [dog, anchor("zebra", "noun", "A1"), {"text": "x", "is_correct": False}]}, {"choices": [dog, cat | {"text": "CAT"}]}, {"choices": [dog, cat | {"text": "kitty"}]},
    )
    of = lambda no, code: [(no, code, f"body.choices[{i}].anchor") for i in (1, 2)]
    same = "body.choices[*].anchor.entry_id"
    want = [(1, "V-DIS-02", of(1, "x")[0][2]), (3, "V-DIS-02", "body.pos_pool_relaxed"), *of(4, "V-DIS-02"), (5, "V-DIS-03", same), (6, "V-DIS-03", same), of(7, "V-DIS-01")[0]]
    df = frame(spark, "vocab_mcq_ja2en", *bodies, level="A1")
    assert got(items.anchor_problems(df, "vocab_mcq_ja2en", ["rec_id"], entries, "level.value")) == [*want, of(9, "V-DIS-01")[0]]
    df = frame(spark, "vocab_mcq_en2ja", *bodies, level="A1")
    assert got(items.anchor_problems(df, "vocab_mcq_en2ja", ["rec_id"], entries, "level.value")) == want


def test_targets(spark, entries):
    card = lambda en, surface: {"example": {"en": en}, "target_surface": surface}
    bodies = (card("My Dog ran.", "Dog"), card("A dog saw a dog.", "dog"), card("A hot dog.", "dog"), card("A dogma of a dog.", "dog"), card("A dog.", "dogs"), card(None, None))
    where, once = "body.target_surface", "body.target_surface#once"
    found = got(items.target_problems(frame(spark, "vocab_flashcard_en2ja", *bodies, level="A1"), "vocab_flashcard_en2ja", ["rec_id"], entries, "level.value"))
    assert [x for x in found if x[0] < 5] == [(1, "V-TGT-02", once), (1, "V-TGT-02", "target.ref"), (2, "V-TGT-02", where), (2, "V-TGT-02", "target.ref"), (3, "V-TGT-02", once), (4, "V-TGT-02", where), (4, "V-TGT-02", once)]
    assert [x[0] for x in got(items.target_problems(frame(spark, "vocab_flashcard_en2ja", bodies[0], level="A2"), "vocab_flashcard_en2ja", ["rec_id"], entries, "level.value").where("code = 'V-TGT-03'"))] == [0]
    blank = {"sentence_with_blank": "A ____.", "sentence_complete": "A dog.", "target_surface": "dog"}
    df = frame(spark, "vocab_mcq_ja2en", blank, blank | {"sentence_complete": "A  dog."}, blank | {"target_surface": "Dog"}, level="A1")
    assert got(items.target_problems(df, "vocab_mcq_ja2en", ["rec_id"], entries, "level.value")) == [(1, "V-TGT-02", "body.sentence_complete"), (2, "V-TGT-02", "body.sentence_complete"), (2, "V-TGT-02", where), (2, "V-TGT-02", where)]


def test_forms(spark):
    df = frame(spark, "grammar_reorder", {"answer_sentence": "I don’t go, now.", "tokens_shuffled": ["i", "don't", "go", "now"]}, {"answer_sentence": "I go", "tokens_shuffled": ["go", "i", "i"]}, {"answer_sentence": "I go", "tokens_shuffled": ["go", "i"]})
    assert got(items.form_problems(df, "grammar_reorder", ["rec_id"])) == [(0, "V-ORD-02", "body.tokens_shuffled"), (1, "V-ORD-01", "body.tokens_shuffled")]
    df = frame(spark, "grammar_rewrite", {"source_sentence": "Café now", "target_sentence_with_blank": "CAFÉ ____", "answer": " now", "answer_equivalents": ["x", " X"]}, {"answer": "a", "answer_equivalents": ["A "]}, {"answer": "a"})
    assert [x[:2] for x in got(items.form_problems(df, "grammar_rewrite", ["rec_id"]))] == [(0, "V-CLZ-02"), (0, "V-RWT-01"), (1, "V-CLZ-02")]
    assert [r[0] for r in df.select(items.answer_list("body.answer", "body.answer_equivalents")).collect()] == [[" now", "x", " X"], ["a", "A "], ["a"]]


def test_every_format_has_a_contract():
    assert list(rules.BODIES) == list(items.FORMATS) == list(rules.ITEM["one_of"])
