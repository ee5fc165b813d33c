"""Tokens of English texts, their vocabulary decision, and greedy phrase matches."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import levels
from ..runtime import if_small

# A word with an inner apostrophe, a number, or any other visible character.
TOKEN = "[A-Za-z]+(?:['’][A-Za-z]+)?|[0-9]+(?:[.,][0-9]+)*(?:st|nd|rd|th)?|[^\\sA-Za-z0-9]"


# Lemmas that replace a tagger's for fragments of contractions.
LEMMA_FIXES = {"gon": "go", "na": "to", "ca": "can", "wo": "will", "sha": "shall"}

# Parts of speech of the vocabulary for each tag, the preferred one first.
TAG_POS = {
    "NN": ("noun",), "NNS": ("noun",), "NNP": ("noun",), "NNPS": ("noun",),
    "JJ": ("adjective",), "JJR": ("adjective",), "JJS": ("adjective",),
    "VB": ("verb",), "VBP": ("verb",), "VBZ": ("verb",), "VBD": ("verb",), "VBN": ("verb",), "VBG": ("verb",),
    "MD": ("modal auxiliary",),
    "RB": ("adverb",), "RBR": ("adverb",), "RBS": ("adverb",), "WRB": ("adverb",),
    "PRP": ("pronoun",), "PRP$": ("pronoun",), "WP": ("pronoun",), "WP$": ("pronoun",),
    "DT": ("determiner", "pronoun"), "PDT": ("determiner", "pronoun"), "WDT": ("determiner", "pronoun"),
    "IN": ("preposition", "conjunction"), "CC": ("conjunction",), "CD": ("number",), "UH": ("interjection",),
    "EX": ("adverb", "pronoun"), "RP": ("adverb", "preposition"),
}


#: Places where a phrase can begin are told by a list of first words up to this many; beyond it every place is tried.
MAX_BEGINS = 10_000


class Tagger(Protocol):
    """What a tagging model has to offer; it is called once per batch of texts."""

    def __call__(self, texts: list[str]) -> Iterator[list[tuple[str, str, str, str, int, int, int]]]:
        """(surface, lemma, tag, upos, start, end, sentence) of each token of each text."""


def plain_tagger(texts: list[str]) -> Iterator[list[tuple]]:
    """Without a model: surfaces by pattern, lemma in lower case, tag unknown; sentences end with . ! or ?"""
    pattern = re.compile(TOKEN, re.ASCII)  # the white space that ``surfaces`` knows; other spaces are tokens of their own, which are exempt
    for t in texts:
        out, sentence, ended = [], 0, False
        for m in pattern.finditer(t):
            surface = m[0]
            if ended and surface[0].isalnum():
                sentence, ended = sentence + 1, False
            ended = ended or surface in ".!?"
            upos = "NUM" if surface[0].isdigit() else "X" if surface[0].isalpha() else "PUNCT"
            out.append((surface, surface.lower(), "", upos, m.start(), m.end(), sentence))
        yield out


_TAGS = "array<struct<surface:string,lemma:string,tag:string,upos:string,start:int,end:int,sentence:int>>"


def tag(df: DataFrame, column: str, tagger: Tagger = plain_tagger) -> DataFrame:
    """df with tokens: an array of structs by the tagger, batch by batch; null stays null."""
    names = ("surface", "lemma", "tag", "upos", "start", "end", "sentence")
    kind = pa.list_(pa.struct([(n, pa.string()) for n in names[:4]] + [(n, pa.int32()) for n in names[4:]]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(batch.schema.get_field_index(column)).to_pylist()
            done = iter(tagger([t for t in own if t is not None]))
            tokens = [None if t is None else [dict(zip(names, x)) for x in next(done)] for t in own]
            arrays = [batch.column(i) for i in range(batch.num_columns)] + [pa.array(tokens, kind)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, "tokens"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{fields}, tokens {_TAGS}")


def surfaces(column: Column | str) -> Column:
    """The plain tokenizer's surfaces, within the JVM."""
    return F.regexp_extract_all(F.col(column) if isinstance(column, str) else column, F.lit(TOKEN), F.lit(0))


def positioned(df: DataFrame, key: list[str], column: str) -> DataFrame:
    """key, at, surface, word (lower case): one row per token."""
    return df.select(*key, F.posexplode(surfaces(column)).alias("at", "surface")).withColumn("word", F.lower("surface"))


def exemption(surface: Column) -> Column:
    """Class of a token that needs no vocabulary: numeric, symbol, possessive, contraction, in this order; else null."""
    return (
        F.when(surface.rlike("^[0-9]+([.,:][0-9]+)*\\z|(?i)^[0-9]+(st|nd|rd|th)\\z"), "numeric")
        .when(surface.rlike("^[^A-Za-z0-9]+$"), "symbol")
        .when(surface.rlike("(?i)^[a-z]+['’]s$"), "possessive")
        .when(surface.rlike("(?i)^[a-z]+['’](ll|re|ve|d|m|t)$"), "contraction")
    )


def best_entries(entries: DataFrame) -> DataFrame:
    """word, entry_id, level, rank, n_pos: per headword the entry of the lowest level, then the vocabulary's first."""
    e = entries.where("not is_multiword").select(F.lower("headword").alias("word"), "id", "pos", "level", levels.broad_rank("level").alias("rank"))
    return e.groupBy("word").agg(F.min_by("id", F.struct("rank", "pos", "id")).alias("entry_id"), F.min("rank").alias("rank"), F.min_by("level", F.struct("rank", "pos", "id")).alias("level"), F.countDistinct("pos").alias("n_pos"))


def fixed_lemma(surface: Column, lemma: Column) -> Column:
    """The lemma to look up: of a contraction's fragment the fixed one, else the tagger's, else the surface."""
    fixes = F.create_map(*(F.lit(x) for kv in LEMMA_FIXES.items() for x in kv))
    return F.coalesce(fixes[F.lower(surface)], F.nullif(lemma, F.lit("")), surface)


def vocabulary_pos(tag: Column, upos: Column, lemma: Column) -> Column:
    """Parts of speech to try for a tagged token, in order: be, do and have first, then 'to' by its use, then by tag."""
    by_tag = F.create_map(*(x for k, v in TAG_POS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    own = upos.isin("VERB", "AUX") & lemma.isin("be", "do", "have")
    to = F.when(upos == "PART", F.array(F.lit("infinitive-to"))).when(upos == "ADP", F.array(F.lit("preposition"))).otherwise(F.array().cast("array<string>"))
    return F.when(own, F.array(F.concat(lemma, F.lit("-verb")))).when(tag == "TO", to).otherwise(F.coalesce(by_tag[tag], F.array().cast("array<string>")))


def tag_priorities(spark) -> DataFrame:
    """tag, pos, prio for pos_choice."""
    return spark.createDataFrame([(t, p, i) for t, ps in TAG_POS.items() for i, p in enumerate(ps)], "tag string, pos string, prio int")


def pos_choice(tokens: DataFrame, entries: DataFrame, priority: DataFrame) -> DataFrame:
    """tokens (key.., word, tag) with entry_id and fallback: the entry whose part of speech comes first for the tag, else of the lowest level.

    priority: tag, pos, prio. Ties go to the vocabulary's first entry; fallback tells that no part of speech of the tag was there.
    """
    keys = tokens.columns
    e = entries.select(F.lower("headword").alias("word"), F.col("id").alias("entry_id"), "pos", levels.broad_rank("level").alias("rank"))
    hit = tokens.join(e, "word").join(priority, ["tag", "pos"], "left")
    order = F.struct(F.coalesce("prio", F.lit(1 << 20)), "rank", "entry_id")
    chosen = hit.groupBy(*keys).agg(F.min_by(F.struct("entry_id", F.col("prio").isNull().alias("fallback")), order).alias("c"))
    return tokens.join(chosen, keys, "left").select(*keys, "c.entry_id", "c.fallback")


def decisions(tokens: DataFrame, entries: DataFrame, allowed: list[str], ceiling: Column) -> DataFrame:
    """tokens with entry_id, level, decision: wordlist_match, above_level, allowlist, exempt or unknown; the first that holds.

    allowed surfaces count as they are written; ceiling is the broad rank a text may use.
    """
    e = best_entries(entries)
    known = tokens.join(if_small(e), "word", "left")
    decision = (
        F.when(F.col("rank") <= ceiling, "wordlist_match")
        .when(F.col("rank").isNotNull(), "above_level")
        .when(F.col("surface").isin(*allowed) if allowed else F.lit(False), "allowlist")
        .when(exemption(F.col("surface")).isNotNull(), "exempt")
        .otherwise("unknown")
    )
    return known.select(*tokens.columns, "entry_id", "level", decision.alias("decision"))


def warnings(rows: DataFrame, key: list[str]) -> DataFrame:
    """key, code, surface of what a decision leaves in doubt. rows: key, surface, lemma and tag by a tagger, entry_id, fallback, decision.

    W-POS-01: the entry has none of the tag's parts of speech. W-PROPN-01: a proper noun's tag on a word of the vocabulary. W-LEMMA-01: the
    lemma was a fixed one, or another one than the surface and found nothing.
    """
    fixed, matched = F.lower("surface").isin(*LEMMA_FIXES), F.col("entry_id").isNotNull()
    lost = ~fixed & ~matched & (F.col("decision") == "unknown") & (F.lower(F.coalesce(F.nullif("lemma", F.lit("")), "surface")) != F.lower("surface"))
    rules = [("W-POS-01", matched & F.col("fallback")), ("W-PROPN-01", matched & F.col("tag").isin("NNP", "NNPS")), ("W-LEMMA-01", fixed | lost)]
    named = F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in rules))
    return rows.select(*key, "surface", F.explode(F.array_compact(named)).alias("code")).select(*key, "code", "surface")


def located(column: Column | str) -> Column:
    """array<struct<surface, start, end>> of a text's tokens, offsets counted from 0, within the JVM; for sentences rather than whole books."""
    c = F.col(column) if isinstance(column, str) else column
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<surface:string,start:int,end:int>>").alias("own"))

    def add(acc: Column, s: Column) -> Column:
        at = F.call_function("locate", s, c, acc["at"])
        return F.struct((at + F.length(s)).alias("at"), F.array_append(acc["own"], F.struct(s.alias("surface"), (at - 1).alias("start"), (at - 1 + F.length(s)).alias("end"))).alias("own"))

    return F.aggregate(surfaces(c), start, add, lambda acc: acc["own"])


def slice_of(column: Column | str, tokens: Column | str, first: Column, last: Column) -> Column:
    """The text as it is written from one token's start to another's end (places in the tokens, from 0); null beyond them."""
    c, t = (F.col(x) if isinstance(x, str) else x for x in (column, tokens))
    start, end = F.get(t, first)["start"], F.get(t, last)["end"]
    return F.substring(c, start + 1, end - start)


def phrase_patterns(entries: DataFrame, tagger: Tagger | None = None, *, single: bool = False) -> DataFrame:
    """phrase_id, phrase, size: headwords of several words (single: all), by their lower-cased tokens.

    They are cut by the tokenizer of the texts, so a hyphen is a token of its own in both.
    """
    e = entries if single else entries.where("is_multiword")
    e = e.select("id", "headword")
    words = surfaces("headword") if tagger is None else F.col("tokens.surface")
    e = e if tagger is None else tag(e, "headword", tagger)
    return e.select(F.col("id").alias("phrase_id"), F.concat_ws(" ", F.transform(words, F.lower)).alias("phrase"), F.size(words).alias("size"))


#: Which pattern is taken among those of the same length at the same place.
_KINDS = ("wordlist_match", "target", "multiword_match")


def phrase_spans(
    texts: DataFrame, key: list[str], column: str, patterns: DataFrame, *, tagger: Tagger | None = None, target: str | None = None, declared: str | None = None, own: DataFrame | None = None
) -> DataFrame:
    """key, start, phrase_id, size, kind, written: greedy matches, left to right, the longest at each place (ties by id), none overlapping.

    A pattern matches the surfaces or the lemmas, which a tagger gives; without one they are the surfaces. target and declared name columns
    with entry ids, whose patterns (of any size) are in ``own``: a text's target matches like a phrase, also by corrected lemmas, and wins
    ties; its declared anchor matches where it is the whole text, and wins over both. kind is multiword_match, target or wordlist_match.
    N-grams are made only of the lengths that occur among the patterns and of places where one can begin; what is consumed is decided
    per text by a fold over its hits.
    """
    sizes = sorted(r[0] for r in patterns.select("size").distinct().collect())
    begins = [r[0] for r in patterns.select(F.substring_index("phrase", " ", 1)).distinct().limit(MAX_BEGINS + 1).collect()]
    ids = [c for c in (target, declared) if c]
    if tagger is None:
        base = texts.select(*key, *ids, surfaces(column).alias("s"))
        lemmas, fixed = None, F.transform("s", lambda x: F.lower(fixed_lemma(x, F.lit(None).cast("string"))))
    else:
        base = tag(texts.select(*key, *ids, column), column, tagger).withColumn("s", F.col("tokens.surface"))
        lemmas = F.transform("tokens", lambda t: F.lower(F.coalesce(F.nullif(t["lemma"], F.lit("")), t["surface"])))
        fixed = F.transform("tokens", lambda t: F.lower(fixed_lemma(t["surface"], t["lemma"])))
    base = base.withColumn("w", F.transform("s", F.lower))
    written = lambda i, n: F.array_join(F.slice("s", i + 1, n), " ").alias("written")

    def grams(words: Column) -> Column:
        at = F.sequence(F.lit(0), F.size("s") - 1)
        at = F.filter(at, lambda i: F.get(words, i).isin(*begins)) if len(begins) <= MAX_BEGINS else at
        # near the text's end a slice is shorter than n and so is no pattern of n tokens
        each = F.transform(at, lambda i: F.array(*(F.struct(i.alias("start"), F.lit(n).alias("n"), F.array_join(F.slice(words, i + 1, n), " ").alias("phrase"), written(i, n)) for n in sizes)))
        return F.when(F.size("s") > 0, F.flatten(each)).otherwise(F.array().cast("array<struct<start:int,n:int,phrase:string,written:string>>"))

    sequences = [F.col("w")] + ([F.col("l")] if lemmas is not None else [])
    base = base.withColumn("l", lemmas) if lemmas is not None else base
    every = F.concat(*(grams(q) for q in sequences)) if sizes else F.array().cast("array<struct<start:int,n:int,phrase:string,written:string>>")
    best = patterns.groupBy("phrase", F.col("size").alias("n")).agg(F.min("phrase_id").alias("phrase_id"))
    hits = base.select(*key, F.inline(every)).join(if_small(best), ["phrase", "n"])
    hits = hits.select(*key, "start", (-F.col("n")).alias("minus"), F.lit(2).alias("kind"), "phrase_id", "written")
    if ids:
        o = own.select(F.col("phrase_id").alias("__id"), F.split("phrase", " ").alias("p"), F.col("size").alias("n"))
        o = if_small(o)
    if target:
        t = base.join(o, F.col(target) == F.col("__id")).where(F.size("s") >= F.col("n")).withColumn("f", fixed)
        at = F.filter(F.sequence(F.lit(0), F.size("s") - F.col("n")), lambda i: (F.slice("w", i + 1, F.col("n")) == F.col("p")) | (F.slice("f", i + 1, F.col("n")) == F.col("p")))
        found = t.select(*key, F.inline(F.transform(at, lambda i: F.struct(i.alias("start"), (-F.col("n")).alias("minus"), F.lit(1).alias("kind"), F.col("__id").alias("phrase_id"), written(i, F.col("n"))))))
        hits = hits.unionByName(found)
    if declared:
        whole = base.join(o, F.col(declared) == F.col("__id")).where("w = p and n > 0")
        hits = hits.unionByName(whole.select(*key, F.lit(0).alias("start"), (-F.col("n")).alias("minus"), F.lit(0).alias("kind"), F.col("__id").alias("phrase_id"), F.array_join("s", " ").alias("written")))

    per = hits.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("start", "minus", "kind", "phrase_id", "written"))).alias("hits"))
    empty = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<start:int,minus:int,kind:int,phrase_id:string,written:string>>").alias("own"))
    kept = F.aggregate("hits", empty, lambda acc, h: F.when(h["start"] >= acc["end"], F.struct((h["start"] - h["minus"]).alias("end"), F.concat(acc["own"], F.array(h)).alias("own"))).otherwise(acc), lambda acc: acc["own"])
    m = per.select(*key, F.explode(kept).alias("m"))
    return m.select(*key, "m.start", "m.phrase_id", (-F.col("m.minus")).alias("size"), F.get(F.array(*map(F.lit, _KINDS)), "m.kind").alias("kind"), "m.written")


def phrases(texts: DataFrame, key: list[str], column: str, patterns: DataFrame, tagger: Tagger | None = None) -> DataFrame:
    """key, start, phrase_id, size of the vocabulary's phrases in the texts, by ``phrase_spans``."""
    return phrase_spans(texts, key, column, patterns, tagger=tagger).select(*key, "start", "phrase_id", "size")


def counted(texts: DataFrame, key: list[str], column: str, patterns: DataFrame) -> DataFrame:
    """key, surface, phrase_id, size, n: how often each phrase (its tokens joined by spaces) stands in a text, and each surface outside all phrases.

    What phrases consume is taken off the surfaces' counts, so texts are never shuffled; phrase_id is null and size 1 for single tokens.
    """
    none = F.lit(None).cast("string")
    every = texts.select(*key, F.explode(surfaces(column)).alias("surface")).select(*key, "surface", none.alias("phrase_id"), F.lit(1).alias("size"), F.lit(1).alias("n"))
    consumed = F.transform(F.split("written", " "), lambda x: F.struct(x.alias("surface"), none.alias("phrase_id"), F.lit(1).alias("size"), F.lit(-1).alias("n")))
    phrase = F.array(F.struct(F.col("written").alias("surface"), "phrase_id", "size", F.lit(1).alias("n")))
    spans = phrase_spans(texts, key, column, patterns).select(*key, F.inline(F.concat(consumed, phrase)))
    return every.unionByName(spans).groupBy(*key, "surface", "phrase_id", "size").agg(F.sum("n").alias("n")).where("n > 0")


def phrase_decisions(rows: DataFrame, entries: DataFrame, allowed: list[str], ceiling: Column) -> DataFrame:
    """rows of ``counted`` with entry_id, level, decision: phrases by their entry's level (multiword_match or above_level), the rest by ``decisions``."""
    single = decisions(rows.withColumn("word", F.when(F.col("phrase_id").isNull(), F.lower("surface"))), entries, allowed, ceiling)
    p = entries.select(F.col("id").alias("phrase_id"), F.col("level").alias("p_level"), levels.broad_rank("level").alias("p_rank"))
    both = single.join(if_small(p), "phrase_id", "left")
    own = F.col("phrase_id").isNotNull()
    decision = F.when(own & (F.col("p_rank") <= ceiling), "multiword_match").when(own, "above_level").otherwise(F.col("decision"))
    return both.select(*rows.columns, F.coalesce("phrase_id", "entry_id").alias("entry_id"), F.when(own, F.col("p_level")).otherwise(F.col("level")).alias("level"), decision.alias("decision"))


def verdicts(texts: DataFrame, key: list[str], problems: DataFrame) -> DataFrame:
    """key, n_problems, verdict of every text: it fails with one problem or more."""
    n = problems.groupBy(*key).agg(F.count(F.lit(1)).alias("n_problems"))
    joined = texts.select(*key).join(n, key, "left").withColumn("n_problems", F.coalesce("n_problems", F.lit(0)))
    return joined.withColumn("verdict", F.when(F.col("n_problems") > 0, "fail").otherwise("pass"))


def word_count(column: Column | str) -> Column:
    """Tokens that aren't punctuation or symbols."""
    return F.size(F.filter(surfaces(column), lambda s: s.rlike("[A-Za-z0-9]")))


def sentence_count(column: Column | str) -> Column:
    """Sentences by the plain rule: runs ended by . ! or ? or the text's end, with a word in them."""
    c = F.col(column) if isinstance(column, str) else column
    return F.size(F.filter(F.split(c, "[.!?]+"), lambda s: s.rlike("[A-Za-z0-9]")))


def ranked_first(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group."""
    return rows.withColumn("__n", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where("__n = 1").drop("__n")


