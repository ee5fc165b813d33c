"""Consistent forms against a plain sequential version."""

import random
import re
import unicodedata

from lexiloom.llm import consistent as c
from lexiloom.llm import text_queries

KANA = re.compile("[ァ-ヺー]")


def plain(text):
    """Word by word, on the decomposed text, without joins."""
    text = unicodedata.normalize("NFKD", "".join(ch for ch in text if unicodedata.category(ch) != "Cf"))
    text = unicodedata.normalize("NFC", text)  # bases of the words below are looked at without their marks
    parts = unicodedata.normalize("NFD", text)
    bases = [i for i, ch in enumerate(parts) if not unicodedata.combining(ch)]
    out, base = list(parts), [parts[i] for i in bases]
    for m in re.finditer("[A-Za-zА-яѐ-ԯΑ-ωЀ-Џ]+", "".join(base)):
        word = m[0]
        if all(ch.isascii() or ch in c.CYRILLIC_LATIN or ch in c.GREEK_LATIN for ch in word):
            for k, ch in enumerate(word):
                out[bases[m.start() + k]] = c.CYRILLIC_LATIN.get(ch) or c.GREEK_LATIN.get(ch) or ch
    joined = "".join(base)
    for m in re.finditer(f"[ァ-ヺー{''.join(c.IDEOGRAPH_KANA)}]+", joined):
        kana = [k for k, ch in enumerate(m[0]) if KANA.match(ch)]
        han = lambda k: 0 <= k < len(joined) and ("一" <= joined[k] <= "鿿" or joined[k] >= "\U00020000")
        for k, ch in enumerate(m[0]):
            if ch in c.IDEOGRAPH_KANA and kana:
                after = joined[m.start() + k + 1 : m.start() + k + 2]
                if k < kana[0] and han(m.start() - 1) and not (after and after in c.NEVER_FIRST):
                    continue
                if k > kana[-1] and han(m.end()):
                    continue
                out[bases[m.start() + k]] = c.IDEOGRAPH_KANA[ch]
    return " ".join(unicodedata.normalize("NFC", "".join(out)).split())


def _forms(spark, texts):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "id int, text string, form_ string")
    return {r.id: r.form for r in c.with_form(df, "text", "form").collect()}


def test_random_texts(spark):
    rng = random.Random(5)
    alphabet = list("abcXTМаоесΟΤ ゲーム力プ一夕方二階ハンカチｶﾞﾊﾟ゙゚​­　 ｔＡ１éêệậ̈각ﷺ㍍½①⼝口。、、Å") + ["́", "̣", "\U0001f600", "\U00020000"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 14))) for _ in range(1500)]
    # vowels and finals of Hangul join what stands before them, so they get texts without look-alikes
    alphabet = list("abc각ガ゙ệ ") + ["́", "̣", "ᄀ", "ᅡ", "ᆨ", "\u0dd9", "\u0dcf", "\u0dca"]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 14))) for _ in range(1500)]
    got = _forms(spark, texts)
    assert [(t, got[i], plain(t)) for i, t in enumerate(texts) if got[i] != plain(t)] == []


def test_named_cases(spark):
    cases = {
        "ガイ卜゙は": "ガイドは", "ラジ才": "ラジオ", "タワ一の洞察": "タワーの洞察", "ホテル一階": "ホテル一階", "夕方ホテル": "夕方ホテル", "昨日二ュース": "昨日ニュース",
        "Тシャツ": "Tシャツ", "AΤМ": "ATM", "Москва": "Москва", "Mосква сор": "Москва сор", "Lumkеthru さん": "Lumkethru さん", "​­": "", " 　 ": "",
        "ậb": "ậb", "ﾎﾞｰﾙ": "ボール", "努力": "努力", "": "", "二階": "二階", "q̣̇": "q̣̇",
    }
    got = _forms(spark, list(cases))
    assert {t: got[i] for i, t in enumerate(cases)} == cases


def test_nulls_repeats_long_and_empty(spark):
    got = _forms(spark, [None, "ｶﾞ", "ｶﾞ", "ｶﾞ​" * 60_000])
    assert got[0] is None and got[1] == got[2] == "ガ" and got[3] == "ガ" * 60_000
    assert _forms(spark, []) == {}


def test_found_in_the_tables(spark, folder):
    rows = text_queries.learner_texts(spark, folder).where("text is not null").collect()
    want = sorted((r.src, r.rec_id, r.choice_no) for r in rows if plain(r.text) != r.text)
    assert want and sorted(map(tuple, text_queries.p2_found(spark, folder).collect())) == want
