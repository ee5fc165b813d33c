"""Queries over closed contracts: the questions as JSON by the contract of their format, and documents made from questions by number, sound
or with a planted fault."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import levels
from ..operators import contract, rules
from ..runtime import table
from .registry import Registry

_registry = Registry()
query, queries, oracle_sql = _registry.query, _registry.queries, _registry.oracle_sql


def _json(*columns) -> F.Column:
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


# --- items ------------------------------------------------------------------------------------------------------------------


def _filled(x: str, at: str) -> list[tuple[str, str, str]]:
    """SQL of a text that has to be there: (condition, pointer, problem)."""
    return [(f"{x} is null", at, "type null"), (f"{x} = ''", at, "min_length")]


def _shaped(x: str, at: str, pattern: str) -> list[tuple[str, str, str]]:
    return [(f"{x} is null", at, "type null"), (f"not regexp_full_match({x}, '{pattern}', 's')", at, "pattern")]


_FINE = ", ".join(f"'{v}'" for v in levels.FINE)
_BROAD = ", ".join(f"'{v}'" for v in levels.BROAD)
_POS = ", ".join(f"'{p}'" for p in rules.POS)
_ENTRY = "lex:[^:]+:(" + "|".join(p.replace(" ", "-") for p in rules.POS) + ")"


def _head(scale: str, values: str, kind: str, ref: str) -> list[tuple[str, str, str]]:
    return [
        *_shaped("question_id", "/question_id", "q(0[1-9]|1[0-9]|20)"), (f"level.scale is distinct from '{scale}'", "/level/scale", "const"), (f"level.value is null or level.value not in ({values})", "/level/value", "enum"),
        (f"target.type is distinct from '{kind}'", "/target/type", "const"), *_shaped("target.ref", "/target/ref", ref), *_filled("target.display_name", "/target/display_name"),
    ]


def _maybe(x: str, at: str) -> list[tuple[str, str, str]]:
    return [(f"{x} = ''", at, "min_length")]


_EXPLAINED = lambda kind: [(f"explanation.type is distinct from '{kind}'", "/explanation/type", "const"), *_filled("explanation.text", "/explanation/text")]
_CASES = {
    "grammar_rewrite": [
        *_head("cefrj", _FINE, "grammar", "gp:[0-9]+(-[0-9]+)?"), *_EXPLAINED("brief"),
        *(c for m in ("source_sentence", "instruction", "answer", "source_ja", "target_ja") for c in _filled(f"body.{m}", f"/body/{m}")),
        *_shaped("body.target_sentence_with_blank", "/body/target_sentence_with_blank", "[^_]*____[^_]*"),
        ("body.answer_equivalents is null", "/body/answer_equivalents", "type null"), ("len(list_distinct(body.answer_equivalents)) < len(body.answer_equivalents)", "/body/answer_equivalents", "unique"),
    ],
    "grammar_example_selfcheck": [
        *_head("cefrj", _FINE, "grammar", "gp:[0-9]+(-[0-9]+)?"), *_EXPLAINED("detailed"), *_filled("body.example.en", "/body/example/en"), *_filled("body.example.ja", "/body/example/ja"),
        *_maybe("body.context_sentence", "/body/context_sentence"), *_maybe("body.context_required_by", "/body/context_required_by"),
    ],
    "vocab_flashcard_en2ja": [
        *_head("cefr", _BROAD, "lexical", _ENTRY), *(c for m in ("headword", "gloss", "target_surface") for c in _filled(f"body.{m}", f"/body/{m}")),
        (f"body.pos is null or body.pos not in ({_POS})", "/body/pos", "enum"), *_filled("body.example.en", "/body/example/en"), *_filled("body.example.ja", "/body/example/ja"),
    ],
}
_SOUND = "level is not null and target is not null and body is not null"


def _item_sql(t: str) -> str:
    sound = _SOUND + (" and explanation is not null" if t.startswith("grammar") else "") + (" and body.example is not null" if "example" in t or "card" in t else "")
    cases = ", ".join(f"case when {c} then struct_pack(pointer := '{at}', problem := '{p}') end" for c, at, p in _CASES[t])
    return f"select '{t}' as source, rec_id, unnest(list_filter([{cases}], lambda x: x is not null)) as p from {t} where format = '{t}' and {sound}"


@query("with p as (" + " union all ".join(map(_item_sql, _CASES)) + ") select source, rec_id, p.pointer as pointer, p.problem as problem, count(*) over (partition by source, rec_id)::int as n_total from p")
def item_contract(spark, d):
    """Questions as JSON against the contract of their format."""
    out = None
    for t in _CASES:
        q = table(spark, d, t).where(F.col("format") == t)
        q = q.where(_SOUND + (" and explanation is not null" if t.startswith("grammar") else "") + (" and body.example is not null" if "example" in t or "card" in t else ""))
        members = ["question_id", "format", "level", "target", "body", *(["explanation"] if t.startswith("grammar") else [])]
        found = contract.violations(q.select("rec_id", _json(*members).alias("json")), "rec_id", "json", rules.ITEM).withColumn("source", F.lit(t))
        out = found if out is None else out.unionByName(found)
    return out


@query("""
select rec_id, '/format' as pointer, 'tag' as problem from grammar_mcq where format is null or format not in ('grammar_mcq', 'grammar_cloze', 'grammar_reorder')
union all select rec_id, '/body/choices', 'additional' from grammar_mcq where format in ('grammar_cloze', 'grammar_reorder')
union all select rec_id, '/body/' || unnest(['answer', 'answer_equivalents', 'cue']), 'required' from grammar_mcq where format = 'grammar_cloze'
union all select rec_id, '/body/' || unnest(['answer_sentence', 'tokens_shuffled']), 'required' from grammar_mcq where format = 'grammar_reorder'
union all select rec_id, '/body/' || unnest(['context_required_by', 'context_sentence', 'sentence_with_blank']), 'additional' from grammar_mcq where format = 'grammar_reorder'""")
def misfiled_items(spark, d):
    """Choice questions against the contract of the format they are filed under: unknown formats, and bodies that belong to another one."""
    q = table(spark, d, "grammar_mcq").where("body is not null")
    found = contract.violations(q.select("rec_id", _json("question_id", "format", "level", "target", "body", "explanation").alias("json")), "rec_id", "json", rules.ITEM)
    body = F.col("pointer").startswith("/body/") & F.col("problem").isin("required", "additional")
    return found.where((F.col("problem") == "tag") | body).select("rec_id", "pointer", "problem")


# --- documents by number ----------------------------------------------------------------------------------------------------


def _planted(sql_cases: dict[int, list[tuple[str, str]]], k: int) -> str:
    """SQL of the problems that each residue of the row's number has."""
    rows = ", ".join(f"({n}, '{at}', '{p}', {len(own)})" for n, own in sql_cases.items() for at, p in own)
    return f"select q.rec_id, c.pointer, c.problem, c.n_total::int as n_total from grammar_rewrite q join (values {rows}) c(n, pointer, problem, n_total) on c.n = q.rec_id % {k}"


def _by_number(spark, d, texts: list[str], rule: dict, more) -> DataFrame:
    """Each question's number takes one of the texts in turn."""
    q = table(spark, d, "grammar_rewrite").select("rec_id", F.get(F.array(*map(F.lit, texts)), (F.col("rec_id") % len(texts)).cast("int")).alias("json"))
    return contract.violations(q, "rec_id", "json", rule, more=more)


_SET = '{"set_id": "20240105-155411-k7x2", "format": "grammar_mcq", "level": {"scale": "cefrj", "value": "A2.1"}, "mode": "explicit", "requested_count": 2, "topic": null, "created_at": "2024-01-05T15:54:11+09:00", "tool": "t", "model": "m", "config_snapshot": {"limits": {"set_question_max": 20}, "proper_nouns": ["Ken", "Rome"]}, "preferred_proper_nouns": ["Ken"], "final_question_ids": ["q01", "q03"]}'
_SET_TEXTS = [
    _SET, _SET.replace("k7x2", "K7X2"), _SET.replace('"cefrj"', '"cefr"'), _SET.replace("15:54:11", "15:54:12"), _SET.replace('["Ken"]', '["Bob"]'), _SET.replace('"q01", "q03"', '"q03", "q01"'),
    _SET.replace('"requested_count": 2', '"requested_count": 1'), _SET.replace('"topic": null', '"topic": ""'), _SET.replace('"mode": "explicit", ', ""), _SET.replace('"tool"', '"more": 1, "tool"'),
    _SET.replace("+09:00", "+14:30"), _SET.replace('"requested_count": 2', '"requested_count": 2.5'), _SET.replace('"requested_count": 2', '"requested_count": true'), _SET.replace('"Ken", "Rome"', '"Ken", "Ken"'), _SET + "}",
    _SET.replace('"set_question_max": 20', '"set_question_max": 1'), _SET.replace('"q01", "q03"', '"q01", "q21"'),
]


@query(_planted({
    1: [("/set_id", "pattern")], 2: [("/level", "scale")], 3: [("/created_at", "set_id")], 4: [("/preferred_proper_nouns", "not_allowed")], 5: [("/final_question_ids", "order")],
    6: [("/final_question_ids", "too_many")], 7: [("/topic", "min_length")], 8: [("/mode", "required")], 9: [("/more", "additional")], 10: [("/created_at", "pattern")], 11: [("/requested_count", "type number")],
    12: [("/requested_count", "type boolean")], 13: [("/config_snapshot/proper_nouns", "unique")], 14: [("", "json")], 15: [("/requested_count", "limit")], 16: [("/final_question_ids/1", "pattern")],
}, 17))
def set_contract(spark, d):
    """Metadata of sets, each fault once in seventeen."""
    return _by_number(spark, d, _SET_TEXTS, rules.SET, rules.set_problems)


_SESSION = '{"set_id": "20240105-155411-k7x2", "created_at": "x", "format": "vocab_mcq_ja2en", "level": {"scale": "cefr", "value": "B1"}, "mode": "proposal", "requested_count": 2, "targets": ["a", "b", "c"], "topic": null, "preferred_proper_nouns": [], "model": "m", "tool": "t"}'
_SESSION_TEXTS = [
    _SESSION, _SESSION.replace('"proposal"', '"explicit"'), _SESSION.replace('"c"', '"c", "d", "e"'), _SESSION.replace('"a", "b", "c"', '"a"'), _SESSION.replace('"c"]', '"c", "d"]'), _SESSION.replace('"B1"', '"B1.1"'),
    _SESSION.replace('"requested_count": 2', '"requested_count": 21'), _SESSION.replace('"a"', '""'), _SESSION.replace('"vocab_mcq_ja2en"', '"vocab"'), _SESSION.replace('"model": "m", ', ""),
]


@query(_planted({1: [("/targets", "number")], 2: [("/targets", "number")], 3: [("/targets", "number")], 5: [("/level", "scale")], 6: [("/requested_count", "maximum")], 7: [("/targets/0", "min_length")], 8: [("/format", "enum")], 9: [("/model", "required")]}, 10))
def session_contract(spark, d):
    """What a session starts from, each fault once in ten."""
    return _by_number(spark, d, _SESSION_TEXTS, rules.SESSION, rules.session_problems)


_OUTCOME = '{"set_id": "20240105-155411-k7x2", "slot_question_id": "q02", "status": "accepted", "attempted_question_ids": ["q02", "q04"], "accepted_question_id": "q04", "teacher_decision": null}'
_GIVEN_UP = _OUTCOME.replace('"accepted",', '"reduced",').replace('"q04", "teacher_decision": null', 'null, "teacher_decision": "reduce"')
_OUTCOME_TEXTS = [
    _OUTCOME, _GIVEN_UP, _OUTCOME.replace('"accepted",', '"reduced",'), _GIVEN_UP.replace('"reduced"', '"accepted"'), _OUTCOME.replace('["q02", "q04"]', '["q04", "q02"]'), _OUTCOME.replace('["q02", "q04"]', '["q03", "q04"]'),
    _OUTCOME.replace('["q02", "q04"]', "[]"), _OUTCOME.replace('"q02", "q04"]', '"q02", "q02"]'), _OUTCOME.replace('"accepted",', '"open",'),
]


@query(_planted({
    2: [("/accepted_question_id", "status"), ("/teacher_decision", "status")], 3: [("/accepted_question_id", "status"), ("/teacher_decision", "status")], 4: [("/accepted_question_id", "status"), ("/attempted_question_ids", "order")],
    5: [("/attempted_question_ids", "first")], 6: [("/attempted_question_ids", "min_items")], 7: [("/attempted_question_ids", "unique")], 8: [("/status", "enum")],
}, 9))
def outcome_contract(spark, d):
    """Outcomes of slots, each fault once in nine."""
    return _by_number(spark, d, _OUTCOME_TEXTS, rules.OUTCOME, rules.outcome_problems)


_INVALID = '{"audit_format": "aud09-v2", "kind": "validation_failure", "diagnostic": "no", "raw_output_base64": "eA=="}'
_PROCESS = '{"audit_format": "aud09-v2", "kind": "process_failure", "exit_code": null, "stderr_base64": ""}'
_INVALID_TEXTS = [
    _INVALID, _PROCESS, _INVALID.replace("eA==", "eB=="), _INVALID.replace('"eA=="', '""'), _INVALID.replace('"no"', '"  "'), _INVALID.replace("validation_failure", "failure"), _PROCESS.replace("null", "1.5"),
    _PROCESS.replace('"exit_code": null, ', ""), _PROCESS.replace('""}', '"eA"}'), _INVALID.replace("aud09-v2", "v1"), "[1]",
]


@query(_planted({
    2: [("/raw_output_base64", "base64")], 3: [("/raw_output_base64", "min_length")], 4: [("/diagnostic", "pattern")], 5: [("/kind", "tag")], 6: [("/exit_code", "type number")], 7: [("/exit_code", "required")],
    8: [("/stderr_base64", "base64")], 9: [("/audit_format", "const")], 10: [("", "type array")],
}, 11))
def invalid_contract(spark, d):
    """Envelopes of invalid answers, of three kinds, each fault once in eleven."""
    return _by_number(spark, d, _INVALID_TEXTS, rules.INVALID, rules.invalid_problems)
