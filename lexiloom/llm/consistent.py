"""One consistent form for text that reads the same but differs in its characters.

The form: invisible format characters (category Cf) go first; the rest is compatibility-composed (NFKC); each
letter comes from the script its word is written in; each run of white space is one U+0020, none at either end.

Distinct texts are exploded to positioned code points, joined with broadcast decompositions and look-alikes (both
bounded by Unicode's repertoire, about 20,000 rows), marks ordered by combining class, recomposed, and rebuilt. Texts made
of characters that can't change in any context pass a quick check beforehand: they are their own form.

Defined results: null stays null; a text of format characters or white space only becomes ''; repeated texts share one
form; very long texts are treated whole; an empty table stays empty. Columns added are named by the caller.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters of other scripts that look like a Latin letter.
CYRILLIC_LATIN = dict(zip("АВЕЅІЈКМНОРСТУХҮѴԚԜасеһіјорԛѕуѵхԝԁ", "ABESIJKMHOPCTYXYVQWacehijopqsyvxwd"))
GREEK_LATIN = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧον", "ABEZHIKMNOPTYXov"))
# Ideographs that look like a katakana letter or the prolonged sound mark.
IDEOGRAPH_KANA = dict(zip("一二八力卜口夕工才", "ーニハカトロタエオ"))
# Katakana that can't begin a word.
NEVER_FIRST = "ァィゥェォッャュョヮンー"

_KANA = "ァ-ヺー"
_LIKE = "".join(IDEOGRAPH_KANA)
#: Finds any character that may change, or a look-alike ideograph beside katakana.
_MAY_CHANGE = f"[^ !-~ぁ-ゖ{_KANA}一-鿿、。「」]|^ | $|  |[{_KANA}][{_LIKE}]|[{_LIKE}][{_KANA}]"


@lru_cache(maxsize=1)
def _unicode() -> tuple[list, list, list]:
    """Decompositions (none for format characters), combining properties, and compositions of whole clusters."""
    decomposed, properties, composed = [], {}, []
    for code in range(sys.maxunicode + 1):
        ch = chr(code)
        if unicodedata.category(ch) in ("Cs", "Cn", "Co"):
            continue
        if unicodedata.category(ch) == "Cf":
            decomposed.append((ch, []))
            continue
        parts = unicodedata.normalize("NFKD", ch)
        if parts != ch:
            decomposed.append((ch, list(parts)))
        if ccc := unicodedata.combining(ch):
            properties.setdefault(ch, [0, False])[0] = ccc
        full = unicodedata.normalize("NFD", ch)
        if full != ch and len(full) > 1 and unicodedata.normalize("NFC", full) == ch:
            composed.append((full, ch))
            for part in full[1:]:  # it may join what stands before it
                properties.setdefault(part, [0, False])[1] = True
    for ch in properties:
        properties[ch][0] = unicodedata.combining(ch)
    return decomposed, [(k, *v) for k, v in properties.items()], composed


def _look_alikes() -> list[tuple]:
    """ch and what to write for it in a Latin, Cyrillic, Greek or katakana word."""
    rows: dict[str, list] = {}
    for column, pairs in ((1, CYRILLIC_LATIN), (2, GREEK_LATIN)):
        for other, latin in pairs.items():
            rows.setdefault(other, [None] * 4)[0] = latin
            row = rows.setdefault(latin, [None] * 4)
            row[column] = row[column] or other
    for ideograph, kana in IDEOGRAPH_KANA.items():
        rows.setdefault(ideograph, [None] * 4)[3] = kana
    return [(k, *v) for k, v in rows.items()]


_STRING, _STRINGS = pa.string(), pa.list_(pa.string())
_TABLES = {
    "decomposed": ([("ch", _STRING), ("parts", _STRINGS)], lambda: _unicode()[0]),
    "properties": ([("ch", _STRING), ("ccc", pa.int32()), ("glue", pa.bool_())], lambda: _unicode()[1]),
    "composed": ([("cluster", _STRING), ("composite", _STRING)], lambda: _unicode()[2]),
    "look_alikes": ([(n, _STRING) for n in ("base", "latin", "cyrillic", "greek", "kana")], _look_alikes),
}


def _mapping(spark: SparkSession, name: str) -> DataFrame:
    """A mapping table; its size is bounded by the repertoire, so it is broadcast."""
    fields, make = _TABLES[name]
    rows = make()
    columns = [pa.array(list(c), kind) for c, (_, kind) in zip(zip(*rows), fields)]
    return F.broadcast(spark.createDataFrame(pa.table(columns, names=[n for n, _ in fields])))


def may_change(text: Column) -> Column:
    """False where the text is surely its own consistent form."""
    return F.coalesce(text.rlike(_MAY_CHANGE), F.lit(False))


@F.pandas_udf(T.StringType())
def _composed(text: pd.Series) -> pd.Series:
    return text.map(lambda s: s if s is None else unicodedata.normalize("NFC", s))


def _code_points(texts: DataFrame, spark: SparkSession) -> DataFrame:
    """tid, text (at the start only), p, ch, ccc, glue: decomposed code points; each text begins with an empty one."""
    start = F.array(F.lit(""))
    points = texts.select(F.md5("text").alias("tid"), "text").select(
        "tid", "text", F.posexplode(F.concat(start, F.regexp_extract_all("text", F.lit("(?s)."), F.lit(0)))).alias("at", "ch")
    )
    points = points.select("tid", F.when(F.col("at") == 0, F.col("text")).alias("text"), "at", "ch")
    points = points.join(_mapping(spark, "decomposed"), "ch", "left")
    points = points.select("tid", "text", "at", F.posexplode(F.coalesce("parts", F.array("ch"))).alias("sub", "ch"))
    points = points.join(_mapping(spark, "properties"), "ch", "left")
    return points.select("tid", "text", (F.col("at") * 32 + F.col("sub")).alias("p"), "ch", F.coalesce("ccc", F.lit(0)).alias("ccc"), F.coalesce("glue", F.lit(False)).alias("glue"))


def _clusters(points: DataFrame) -> DataFrame:
    """tid, text, k, base, rest: each starter with what follows it, marks in canonical order."""
    w = W.partitionBy("tid").orderBy("p")
    points = points.withColumns({
        "starter": F.sum(F.when(F.col("ccc") == 0, 1).otherwise(0)).over(w),
        "k": F.sum(F.when((F.col("ccc") == 0) & ~F.col("glue"), 1).otherwise(0)).over(w),
    })
    ordered = F.array_sort(F.collect_list(F.struct("starter", "ccc", "p", "ch")))
    clusters = points.groupBy("tid", "k").agg(F.max("text").alias("text"), ordered.alias("own"))
    return clusters.select("tid", "k", "text", F.col("own")[0]["ch"].alias("base"), F.array_join(F.transform(F.slice("own", 2, 1 << 30), lambda x: x["ch"]), "").alias("rest"))


def _in_script(clusters: DataFrame, spark: SparkSession) -> DataFrame:
    """Bases written in the script of their word."""
    base, kind, before = F.col("base"), F.col("kind"), F.col("before")
    w = W.partitionBy("tid").orderBy("k")
    rows = clusters.join(_mapping(spark, "look_alikes"), "base", "left")
    rows = rows.withColumn(
        "kind",
        F.when(F.col("kana").isNotNull(), "J")
        .when(base.rlike("^\\p{IsLatin}"), "L")
        .when(base.rlike(f"^[{_KANA}ㇰ-ㇿ]"), "K")
        .when(base.rlike("^\\p{IsCyrillic}"), "Y")
        .when(base.rlike("^\\p{IsGreek}"), "G")
        .when(base.rlike("^\\p{IsHan}"), "C")
        .otherwise("O"),
    )
    rows = rows.withColumns({"before": F.coalesce(F.lag("kind").over(w), F.lit("O")), "after": F.coalesce(F.lead("kind").over(w), F.lit("O")), "next": F.lead("base").over(w)})
    letter, kana = ("L", "Y", "G"), ("K", "J")
    rows = rows.withColumns({
        "word": F.sum(F.when(kind.isin(*letter) & ~before.isin(*letter), 1).otherwise(0)).over(w),
        "island": F.sum(F.when(kind.isin(*kana) & ~before.isin(*kana), 1).otherwise(0)).over(w),
    })
    count = lambda condition, over: F.sum(F.when(condition, 1).otherwise(0)).over(over)
    word, text = W.partitionBy("tid", "word"), W.partitionBy("tid")
    n = {s: count(kind == s, word) for s in letter}
    # letters without a counterpart in the other script show which one the word is in
    no_latin_y, no_latin_g = (kind == "Y") & F.col("latin").isNull(), (kind == "G") & F.col("latin").isNull()
    rows = rows.withColumns({
        "n_l": n["L"], "n_y": n["Y"], "n_g": n["G"],
        "own_y": count(no_latin_y, word), "own_g": count(no_latin_g, word),
        "text_y": count(no_latin_y, text), "text_g": count(no_latin_g, text),
    })
    c = F.col
    only_y, only_g = (c("n_l") + c("n_g") == 0), (c("n_l") + c("n_y") == 0)
    script = (
        F.when(only_y & (c("text_y") > 0), "Y")  # a word of a text in that script
        .when(only_g & (c("text_g") > 0), "G")
        .when(c("own_y") + c("own_g") == 0, "L")
        .when((c("own_y") > 0) & (c("n_y") >= c("n_l")) & (c("n_y") >= c("n_g")), "Y")
        .when((c("own_g") > 0) & (c("n_g") > c("n_l")) & (c("n_g") > c("n_y")), "G")
        .otherwise("L")
    )
    island = W.partitionBy("tid", "island")
    rows = rows.withColumns({
        "first_kana": F.min(F.when(kind == "K", c("k"))).over(island),
        "last_kana": F.max(F.when(kind == "K", c("k"))).over(island),
        "left": F.min(F.when(kind.isin(*kana), F.struct("k", "before"))).over(island)["before"],
        "right": F.max(F.when(kind.isin(*kana), F.struct("k", "after"))).over(island)["after"],
    })
    kana_word = (
        F.when(c("first_kana").isNull(), False)
        .when(c("k") < c("first_kana"), (c("left") != "C") | c("next").isin(*NEVER_FIRST))
        .when(c("k") > c("last_kana"), c("right") != "C")
        .otherwise(True)
    )
    written = (
        F.when(kind == "J", F.when(kana_word, c("kana")))
        .when(kind.isin(*letter) & (kind != script), F.when(script == "L", c("latin")).when(script == "Y", c("cyrillic")).when(script == "G", c("greek")))
    )
    return rows.select("tid", "k", "text", F.coalesce(written, base).alias("base"), "rest")


def forms(texts: DataFrame) -> DataFrame:
    """text, form: of each distinct text (column text) that may change."""
    spark = texts.sparkSession
    texts = texts.select("text").where(may_change(F.col("text"))).distinct()
    clusters = _in_script(_clusters(_code_points(texts, spark)), spark)
    clusters = clusters.withColumn("cluster", F.when(F.col("rest") != "", F.concat("base", "rest")))
    clusters = clusters.join(_mapping(spark, "composed"), "cluster", "left")
    whole = clusters.select("tid", "k", "text", F.coalesce("composite", "cluster", "base").alias("out"), (F.col("cluster").isNotNull() & F.col("composite").isNull()).alias("loose"))
    texts = whole.groupBy("tid").agg(F.max("text").alias("text"), F.array_sort(F.collect_list(F.struct("k", "out"))).alias("own"), F.max("loose").alias("loose"))
    texts = texts.select("text", "loose", F.array_join(F.transform("own", lambda x: x["out"]), "").alias("form"))
    # a cluster that isn't one composite as a whole (several marks, say) is composed from its parts
    texts = texts.select("text", F.coalesce(_composed(F.when(F.col("loose"), F.col("form"))), F.col("form")).alias("form"))
    return texts.select("text", F.trim(F.regexp_replace("form", "(?U)[\\s\\x1c-\\x1f]+", " ")).alias("form"))


def with_form(df: DataFrame, source: str, target: str) -> DataFrame:
    """df with column target: the consistent form of column source."""
    changed = forms(df.select(F.col(source).alias("text")))
    changed = changed.select(F.col("text").alias("__text"), F.col("form").alias("__form"))
    # texts that stay as they are, often one of them in most rows, meet nothing here: each row gets a key of its own
    own = F.concat(F.lit("\x00"), F.monotonically_increasing_id().cast("string"))
    keyed = df.withColumn("__key", F.when(may_change(F.col(source)), F.col(source)).otherwise(own))
    return keyed.join(changed, (F.col("__key") == F.col("__text")) & (F.col(source) == F.col("__text")), "left").withColumn(target, F.coalesce("__form", F.col(source))).drop("__key", "__text", "__form")


def inconsistent(df: DataFrame, source: str) -> DataFrame:
    """The rows of df whose column source isn't in its consistent form, with that form as column form."""
    rows = df.where(may_change(F.col(source)))
    changed = forms(rows.select(F.col(source).alias("text"))).where("form != text").select(F.col("text").alias("__text"), "form")
    return rows.join(changed, rows[source] == changed["__text"]).drop("__text")
