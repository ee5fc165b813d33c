"""The consistent form as SQL for what the test tables hold: compatibility characters of one code point, half-width kana, format characters, white
space, and single letters of other scripts in Latin words. DuckDB composes canonically only, so the mapping is built from Unicode's data here."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from . import consistent

_RANGES = ((0xFF01, 0xFFEF), (0x2F00, 0x2FD6), (0x2E80, 0x2EF4), (0x2460, 0x2474), (0x3000, 0x3001))
_INVISIBLE = "[\\x{ad}\\x{600}-\\x{605}\\x{61c}\\x{180e}\\x{200b}-\\x{200f}\\x{202a}-\\x{202e}\\x{2060}-\\x{2064}\\x{2066}-\\x{206f}\\x{feff}]"
_SPACE = "[\\s\\x0b\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+"


@lru_cache(maxsize=1)
def _mapping() -> tuple[str, str]:
    pairs = [(chr(c), unicodedata.normalize("NFKC", chr(c))) for low, high in _RANGES for c in range(low, high)]
    kept = [(a, b) for a, b in pairs if a != b and len(b) == 1]
    others = {**consistent.CYRILLIC_LATIN, **consistent.GREEK_LATIN}
    return "".join(a for a, _ in kept) + "".join(others), "".join(b for _, b in kept) + "".join(others.values())


def form(x: str) -> str:
    """SQL of the consistent form of an expression."""
    source, target = (t.replace("'", "''") for t in _mapping())
    out = f"nfc_normalize(translate(regexp_replace({x}, '{_INVISIBLE}', '', 'g'), '{source}', '{target}'))"
    for ideograph, kana in consistent.IDEOGRAPH_KANA.items():
        # after katakana where no ideograph follows, before katakana where none stands in front, and before katakana that can't begin a word
        for before, after in (("[ァ-ヺー]", "[^一-鿿]|$"), ("^|[^一-鿿]", "[ァ-ヺー]"), ("", f"[{consistent.NEVER_FIRST}]")):
            out = f"regexp_replace({out}, '({before}){ideograph}({after})', '\\1{kana}\\2', 'g')"
    return f"trim(regexp_replace({out}, '{_SPACE}', ' ', 'g'))"
