"""What a text asks of its reader, as numbers: length, vocabulary, syntax and cohesion distributions over its sentences.

``features`` reads the whole text. Sentences end at a stop, question or exclamation mark before white space, or at a line's end; list
marks, speakers, headings and addresses are no part of them. Words that begin with a capital inside a sentence count as names.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np

from .leak import _invisible

LEVELS = {"A1": 1, "A2": 2, "B1": 3, "B2": 4}
BEYOND = 5
LONG = 9

# Words that join clauses or sentences.
SUBORDINATORS = frozenset("although because before after since while when whereas whereby which who whom whose that if unless until though inasmuch insofar as than what how why where whether".split())
CONNECTIVES = frozenset("however therefore moreover furthermore nevertheless consequently thus hence still yet then also instead meanwhile".split())
AUXILIARIES = frozenset("is are was were be been being am has have had do does did will would can could shall should may might must".split())
PRONOUNS = frozenset("i you he she it we they me him her us them my your his its our their this these those".split())

_END = re.compile(r"(?<=[.!?])[\"')\]]*\s+|\n+")
_MARK = re.compile(r"^\s*(?:#+\s.*$|[-*•]\s+|\(?\d+[.)]\s+|[A-Z][a-z]+:\s+)")
_ADDRESS = re.compile(r"\S*://\S*|<[^<>]*>")
_WORD = re.compile(r"[A-Za-z]+(?:['’][A-Za-z]+)?")
_SUFFIXES = ("ies", "es", "s", "ied", "ed", "d", "ing", "ly", "er", "est")

_LENGTH_CUTS = (6, 9, 12, 16, 22, 30, 40)
_HARD_CUTS = (0.08, 0.2, 0.35, 0.55)
_QUANTILES = (0.1, 0.25, 0.5, 0.75, 0.9)
_SPREAD = ("words", "letters", "level", "hard", "clauses")

NAMES = (
    [f"{c}_{q}" for c in _SPREAD for q in ("mean", "sd", "q10", "q25", "q50", "q75", "q90")]
    + [f"share_{i}{j}" for i in range(len(_LENGTH_CUTS) + 1) for j in range(len(_HARD_CUTS) + 1)]
    + [f"level_{k}" for k in range(BEYOND + 1)]
    + ["names", "commas", "passives", "connectives", "pronouns", "types", "overlap", "n_sentences", "n_words", "longest"]
)


def word_level(word: str, levels: dict[str, int]) -> int:
    """The lexicon's level of a word or of what is left without an ending; beyond it for other long words, 0 for short ones."""
    found = levels.get(word)
    if found is not None:
        return found
    for suffix in _SUFFIXES:
        if word.endswith(suffix) and len(word) > len(suffix) + 2:
            stem = word[: -len(suffix)]
            for form in (stem, stem + "e", stem + "y", stem[:-1] if stem[-1:] == stem[-2:-1] else stem):
                found = levels.get(form)
                if found is not None:
                    return found
    return BEYOND if len(word) >= LONG else 0


def plain(text: str) -> str:
    """Compatibility-composed, without invisible format characters."""
    return text if text.isascii() else unicodedata.normalize("NFKC", text.translate(_invisible))


def sentences(text: str) -> list[str]:
    text = plain(text)
    if "://" in text or "<" in text:
        text = _ADDRESS.sub(" ", text)
    return [s for s in (_MARK.sub("", part) for part in _END.split(text)) if s.strip()]


def features(text: str, levels: dict[str, int], known: dict[str, int]) -> list[float]:
    """The numbers NAMES of a text. known remembers words' levels between texts."""
    rows, weights, tallies = [], [], np.zeros(BEYOND + 1)
    names = commas = passives = connectives = pronouns = 0
    kinds: set[str] = set()
    overlaps: list[float] = []
    before: set[str] = set()
    for sentence in sentences(text):
        found = _WORD.findall(sentence)
        if not found:
            continue
        level_sum = counted = hard = letters = clauses = be = 0
        content: set[str] = set()
        for i, raw in enumerate(found):
            word = raw.lower()
            if i and raw[0].isupper() and word != "i" and not raw.isupper():
                names += 1
                be = 0
                continue
            level = known.get(word)
            if level is None:
                level = known[word] = word_level(word, levels)
            if not i and level in (0, BEYOND) and word not in SUBORDINATORS and raw[0].isupper() and word[-1] in "aeioun" and level == 0 and len(word) > 5:
                names += 1  # an unknown capitalised word at the start
                continue
            tallies[level] += 1
            letters += len(word)
            counted += 1
            if level:
                level_sum += level
                content.add(word)
                hard += level >= BEYOND
            elif word in SUBORDINATORS:
                clauses += 1
            elif word in CONNECTIVES:
                connectives += 1
            elif word in PRONOUNS:
                pronouns += 1
            if be and word[-2:] in ("ed", "en"):
                passives += 1
            be = word in AUXILIARIES or (be and word[-2:] == "ly")
        if not counted:
            continue
        commas += sentence.count(",")
        kinds |= content
        if before and content:
            overlaps.append(len(before & content) / min(len(before), len(content)))
        before = content
        n = len(found)
        rows.append((n, letters / counted, level_sum / max(1, len(content)), hard / counted, (clauses + sentence.count(",")) / n))
        weights.append(n)
    if not rows:
        return [0.0] * len(NAMES)
    x, w = np.array(rows), np.array(weights, float)
    out: list[float] = []
    total = w.sum()
    for j in range(x.shape[1]):
        column = x[:, j]
        order = column.argsort()
        reach = w[order].cumsum() / total
        mean = float((column * w).sum() / total)
        out += [mean, float(np.sqrt(max(0.0, ((column - mean) ** 2 * w).sum() / total)))]
        out += column[order][np.minimum(np.searchsorted(reach, _QUANTILES), len(w) - 1)].tolist()
    cell = np.searchsorted(_LENGTH_CUTS, x[:, 0]) * (len(_HARD_CUTS) + 1) + np.searchsorted(_HARD_CUTS, x[:, 3])
    out += (np.bincount(cell, w, (len(_LENGTH_CUTS) + 1) * (len(_HARD_CUTS) + 1)) / total).tolist()
    out += (tallies / max(1.0, tallies.sum())).tolist()
    overlap = sum(overlaps) / len(overlaps) if overlaps else 0.0
    out += [names / total, commas / total, passives / total, connectives / total, pronouns / total, len(kinds) / total, overlap, float(len(w)), float(total), float(w.max())]
    return out
