"""Contracts of the documents that are exchanged: items of nine formats, sets, sessions, outcomes of slots and envelopes of invalid answers.

Each is a closed rule tree for ``contract.violations``; where members depend on each other, a function says so for documents that fit the tree.
"""

from __future__ import annotations

import base64
import binascii

from ..functions import levels
from ..functions.jsontext import Exact
from . import items
from .contract import Problem

# The parts of speech of the vocabulary.
POS = (
    "noun", "verb", "adjective", "adverb", "pronoun", "preposition", "determiner", "conjunction", "number",
    "modal auxiliary", "be-verb", "interjection", "do-verb", "have-verb", "infinitive-to",
)
# Patterns of ids, of a sentence with one blank, of a word to be put in order, of a moment.
QUESTION_ID = r"^q(0[1-9]|1[0-9]|20)\Z"
SET_ID = r"^[0-9]{8}-[0-9]{6}-[a-z0-9]{4}\Z"
ENTRY_ID = rf"^lex:[^:]+:({'|'.join(p.replace(' ', '-') for p in POS)})\Z"
ITEM_ID = r"^gp:[0-9]+(-[0-9]+)?\Z"
ONE_BLANK = r"^[^_]*____[^_]*\Z"
LOWER_WORD = r"^[^A-Z\s]+\Z"
MOMENT = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(Z|[+-](0[0-9]|1[0-3]):[0-5][0-9]|[+-]14:00)\Z"
# The kinds of envelopes and what they hold, the name of their layout.
ENVELOPE = "aud09-v2"

TEXT = {"type": "string", "min_length": 1}
NULLABLE = {"type": ["string", "null"], "min_length": 1}
_FLAG = {"type": "boolean"}


def closed(**members: dict) -> dict:
    """An object with exactly these members."""
    return {"type": "object", "required": list(members), "properties": members}


def _pattern(p: str) -> dict:
    return {"type": "string", "pattern": p}


def _four(choice: dict) -> dict:
    right = {"type": "object", "required": ["is_correct"], "properties": {"is_correct": {"const": True}}, "open": True}
    return {"type": "array", "min_items": 4, "max_items": 4, "items": choice, "contains": right, "max_contains": 1}


_ANCHOR = closed(entry_id=_pattern(ENTRY_ID), headword=TEXT, pos={"enum": POS}, level={"enum": levels.BROAD})
_VOCABULARY_CHOICES = _four(closed(text=TEXT, is_correct=_FLAG, anchor=_ANCHOR, gloss=TEXT))
_GRAMMAR_CHOICES = _four(closed(text=TEXT, is_correct=_FLAG))
_EXAMPLE = closed(en=TEXT, ja=TEXT)
_EQUIVALENTS = {"type": "array", "unique": True, "items": TEXT}
_BLANK = _pattern(ONE_BLANK)
_CONTEXT = {"context_sentence": NULLABLE, "context_required_by": NULLABLE}
_CARD = closed(headword=TEXT, pos={"enum": POS}, gloss=TEXT, example=_EXAMPLE, target_surface=TEXT)
BODIES = {
    "vocab_mcq_en2ja": closed(stem=TEXT, target_surface=TEXT, stem_ja=TEXT, choices=_VOCABULARY_CHOICES, pos_pool_relaxed=_FLAG),
    "vocab_mcq_ja2en": closed(stem=TEXT, sentence_with_blank=_BLANK, sentence_complete=TEXT, target_surface=TEXT, sentence_ja=TEXT, choices=_VOCABULARY_CHOICES, pos_pool_relaxed=_FLAG),
    "vocab_flashcard_en2ja": _CARD,
    "vocab_flashcard_ja2en": _CARD,
    "grammar_mcq": closed(sentence_with_blank=_BLANK, choices=_GRAMMAR_CHOICES, example_ja=TEXT, **_CONTEXT),
    "grammar_cloze": closed(sentence_with_blank=_BLANK, cue=NULLABLE, answer=TEXT, answer_equivalents=_EQUIVALENTS, example_ja=TEXT, **_CONTEXT),
    "grammar_reorder": closed(tokens_shuffled={"type": "array", "min_items": 4, "items": _pattern(LOWER_WORD)}, answer_sentence=TEXT, example_ja=TEXT),
    "grammar_rewrite": closed(source_sentence=TEXT, instruction=TEXT, target_sentence_with_blank=_BLANK, answer=TEXT, answer_equivalents=_EQUIVALENTS, source_ja=TEXT, target_ja=TEXT),
    "grammar_example_selfcheck": closed(example=_EXAMPLE, **_CONTEXT),
}


def _item(fmt: str) -> dict:
    vocabulary = fmt in items.VOCABULARY
    scale, values = ("cefr", levels.BROAD) if vocabulary else ("cefrj", levels.FINE)
    kind, ref = ("lexical", ENTRY_ID) if vocabulary else ("grammar", ITEM_ID)
    members = {
        "question_id": _pattern(QUESTION_ID), "format": {"const": fmt}, "level": closed(scale={"const": scale}, value={"enum": values}),
        "target": closed(type={"const": kind}, ref=_pattern(ref), display_name=TEXT), "body": BODIES[fmt],
    }
    if not vocabulary:
        members["explanation"] = closed(type={"const": "detailed" if fmt == items.FORMATS[-1] else "brief"}, text=TEXT)
    return closed(**members)


#: An item of any format; problems come from the branch its format names.
ITEM = {"type": "object", "tag": "format", "one_of": {f: _item(f) for f in items.FORMATS}}

_COUNT = {"type": "integer", "minimum": 1, "maximum": items.LAST_NUMBER}
_LEVEL = closed(scale={"type": "string"}, value={"type": "string"})
_NAMES = {"type": "array", "unique": True, "items": TEXT}
_QUESTION_IDS = {"type": "array", "min_items": 1, "unique": True, "items": _pattern(QUESTION_ID)}
_MODE = {"enum": ["explicit", "proposal"]}
SET = closed(
    set_id=_pattern(SET_ID), format={"enum": items.FORMATS}, level=_LEVEL, mode=_MODE, requested_count=_COUNT, topic=NULLABLE, created_at=_pattern(MOMENT), tool=TEXT, model=TEXT,
    config_snapshot=closed(limits={"type": "object", "open": True}, proper_nouns={**_NAMES, "min_items": 1}), preferred_proper_nouns=_NAMES, final_question_ids=_QUESTION_IDS,
)
SESSION = closed(
    set_id=_pattern(SET_ID), created_at=TEXT, format={"enum": items.FORMATS}, level=_LEVEL, mode=_MODE, requested_count=_COUNT, targets={"type": "array", "items": TEXT},
    topic=NULLABLE, preferred_proper_nouns={"type": "array", "items": {"type": "string"}}, model=TEXT, tool=TEXT,
)
OUTCOME = closed(
    set_id=_pattern(SET_ID), slot_question_id=_pattern(QUESTION_ID), status={"enum": ["accepted", "reduced"]}, attempted_question_ids=_QUESTION_IDS,
    accepted_question_id={"type": ["string", "null"]}, teacher_decision={"type": ["string", "null"]},
)
_SAID = _pattern(r"\S")
INVALID = {
    "type": "object", "tag": "kind",
    "one_of": {
        "validation_failure": closed(audit_format={"const": ENVELOPE}, kind=TEXT, diagnostic=_SAID, raw_output_base64=TEXT),
        "utf8_encode_failure": closed(audit_format={"const": ENVELOPE}, kind=TEXT, position=_SAID, reason=_SAID),
        "process_failure": closed(audit_format={"const": ENVELOPE}, kind=TEXT, exit_code={"type": ["integer", "null"]}, stderr_base64={"type": "string"}),
    },
}


def _level_problems(v: dict) -> list[Problem]:
    """A level is of the scale that its format's items have."""
    scale, values = ("cefr", levels.BROAD) if v["format"] in items.VOCABULARY else ("cefrj", levels.FINE)
    return [] if v["level"]["scale"] == scale and v["level"]["value"] in values else [("/level", "scale")]


def _number(v: Exact) -> int:
    return int(v.value)


def set_problems(v: dict) -> list[Problem]:
    """Of a set: its level fits its format, its time is the one in its id, its names are allowed, its questions ascend and aren't too many."""
    out, count = _level_problems(v), _number(v["requested_count"])
    stamp = v["created_at"][:19].replace("-", "").replace(":", "").replace("T", "-")
    if stamp != v["set_id"][:15]:
        out.append(("/created_at", "set_id"))
    most = v["config_snapshot"]["limits"].get("set_question_max")
    if not isinstance(most, Exact) or most.value < count:
        out.append(("/requested_count", "limit"))
    if set(v["preferred_proper_nouns"]) - set(v["config_snapshot"]["proper_nouns"]):
        out.append(("/preferred_proper_nouns", "not_allowed"))
    own = v["final_question_ids"]
    if own != sorted(own):
        out.append(("/final_question_ids", "order"))
    elif len(own) > count:
        out.append(("/final_question_ids", "too_many"))
    return out


def session_problems(v: dict) -> list[Problem]:
    """Of a session: as many targets as requested, or, where they are proposed, up to the cap on tries."""
    out, count, n = _level_problems(v), _number(v["requested_count"]), len(v["targets"])
    if (n != count) if v["mode"] == "explicit" else not count <= n <= min(2 * count, items.LAST_NUMBER):
        out.append(("/targets", "number"))
    return out


def outcome_problems(v: dict) -> list[Problem]:
    """Of a slot's outcome: tries ascend and begin with the slot; the last one is accepted, or none and the slot is given up."""
    out, tried = [], v["attempted_question_ids"]
    if tried != sorted(tried):
        out.append(("/attempted_question_ids", "order"))
    elif tried[0] != v["slot_question_id"]:
        out.append(("/attempted_question_ids", "first"))
    accepted, decision = (tried[-1], None) if v["status"] == "accepted" else (None, "reduce")
    if v["accepted_question_id"] != accepted:
        out.append(("/accepted_question_id", "status"))
    if v["teacher_decision"] != decision:
        out.append(("/teacher_decision", "status"))
    return out


def _canonical_base64(value: str) -> bool:
    try:
        return base64.b64encode(base64.b64decode(value, validate=True)).decode("ascii") == value
    except (ValueError, binascii.Error):
        return False


def invalid_problems(v: dict) -> list[Problem]:
    """Of an envelope: bytes are what encoding gives again."""
    return [(f"/{m}", "base64") for m in ("raw_output_base64", "stderr_base64") if m in v and not _canonical_base64(v[m])]
