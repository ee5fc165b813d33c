"""Sinks: canonical JSON, write-once publishing, replacing several tables together, and a page to read."""

from __future__ import annotations

import html
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import jsontext


class Refused(RuntimeError):
    """A write that would lose something."""


def _fs(df: DataFrame, path: str):
    jvm = df.sparkSession._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()), where, jvm.org.apache.hadoop.fs.Path


def refuse_inputs(spark: SparkSession, target: str, inputs: list[str]) -> None:
    """Refuse a target that is an input, lies in one, or holds one; links are followed where the file system has them."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def real(place: str) -> str:
        where = jvm.org.apache.hadoop.fs.Path(place)
        fs = where.getFileSystem(conf)
        whole = fs.makeQualified(where)
        if fs.exists(whole):
            whole = fs.resolvePath(whole)
        text = whole.toString().rstrip("/")
        return "file:" + os.path.realpath(text.removeprefix("file://").removeprefix("file:")) if text.startswith("file:") else text

    own = real(target)
    for i in map(real, inputs):
        if own == i or own.startswith(i + "/") or i.startswith(own + "/"):
            raise Refused("the output is an input")


def as_canonical(df: DataFrame) -> DataFrame:
    """Column value: each row as canonical JSON text, nulls kept."""
    return df.select(jsontext.canonical(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})).alias("value"))


def publish(df: DataFrame, path: str, *, key: list[str] | None = None, dry: bool = False) -> DataFrame:
    """Write once: an existing target, or a key given twice, refuses the write. dry plans and writes nothing."""
    if key and not df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        raise Refused("repeated key")
    if not dry:
        df.write.mode("errorifexists").parquet(path)
    return df


def append_new(df: DataFrame, path: str, key: list[str]) -> None:
    """Append rows to an audit table; a key that is there already refuses the whole batch."""
    fs, where, _ = _fs(df, path)
    if fs.exists(where):
        there = df.sparkSession.read.parquet(path)
        if not df.join(there.select(*key), key, "left_semi").isEmpty():
            raise Refused("an audit row is there already")
    if not df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        raise Refused("repeated key")
    df.write.mode("append").parquet(path)


def replace_together(tables: dict[str, DataFrame], folder: str, *, inputs: list[str] | None = None) -> None:
    """Replace several tables of a folder: all are staged first, then moved; a failed move puts the old ones back."""
    any_df = next(iter(tables.values()))
    fs, root, path = _fs(any_df, folder)
    refuse_inputs(any_df.sparkSession, folder, inputs or [])
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/.staged/{name}")
    moved: list[str] = []
    try:
        for name in tables:
            old, kept = path(f"{folder}/{name}"), path(f"{folder}/.old/{name}")
            fs.mkdirs(kept.getParent())
            if fs.exists(old) and not fs.rename(old, kept):
                raise Refused(f"{name} can't be set aside")
            moved.append(name)
            if not fs.rename(path(f"{folder}/.staged/{name}"), old):
                raise Refused(f"{name} can't be moved")
    except Exception:
        for name in moved:
            old, kept = path(f"{folder}/{name}"), path(f"{folder}/.old/{name}")
            if fs.exists(kept):
                fs.delete(old, True)
                fs.rename(kept, old)
        raise
    finally:
        fs.delete(path(f"{folder}/.staged"), True)
    fs.delete(path(f"{folder}/.old"), True)


#: What each format's view shows at once and what it shows as the answer, by members of the body; a choice list is shown between them.
VIEWS = {
    "vocab_mcq_en2ja": (("stem",), ("stem_ja",)),
    "vocab_mcq_ja2en": (("stem", "sentence_with_blank"), ("sentence_complete", "sentence_ja")),
    "vocab_flashcard_en2ja": (("headword", "pos"), ("gloss", "example.en", "example.ja")),
    "vocab_flashcard_ja2en": (("gloss", "pos"), ("headword", "example.en", "example.ja")),
    "grammar_mcq": (("context_sentence", "sentence_with_blank"), ("example_ja",)),
    "grammar_cloze": (("context_sentence", "sentence_with_blank", "cue"), ("answer", "answer_equivalents", "example_ja")),
    "grammar_reorder": (("tokens_shuffled",), ("answer_sentence", "example_ja")),
    "grammar_rewrite": (("source_sentence", "instruction", "target_sentence_with_blank"), ("answer", "answer_equivalents", "source_ja", "target_ja")),
    "grammar_example_selfcheck": (("context_sentence", "example.en"), ("example.ja",)),
}


def _marked(value: str, surface: str | None) -> str:
    """A text with the first place of its target marked."""
    before, found, after = value.partition(surface) if surface else (value, "", "")
    return html.escape(before) + (f"<mark>{html.escape(found)}</mark>" if found else "") + html.escape(after)


def item_view(item: dict) -> str:
    """One question as its format is shown: what is asked, the choices by letter, and behind a fold the answer and its explanation. Members that are missing are left out."""
    body = item.get("body") or {}

    def part(path: str) -> str:
        value = body
        for name in path.split("."):
            value = (value or {}).get(name)
        if not value:
            return ""
        value = " / ".join(map(str, value)) if isinstance(value, (list, tuple)) else str(value)
        return f"<p class='{path.replace('.', '-')}'>{_marked(value, body.get('target_surface'))}</p>"

    asked, answer = VIEWS.get(item.get("format"), ((), ()))
    choices = [c for c in body.get("choices") or [] if c]
    letters = "".join(f"<li value='{i}'>{html.escape(c.get('text') or '')}</li>" for i, c in enumerate(choices, 1))
    right = ", ".join(f"{chr(64 + i)}. {html.escape(c.get('text') or '')}" for i, c in enumerate(choices, 1) if c.get("is_correct"))
    said = (item.get("explanation") or {}).get("text") or ""
    shown = "".join(map(part, asked)) + (f"<ol type='A'>{letters}</ol>" if letters else "")
    hidden = (f"<p class='right'>{right}</p>" if right else "") + "".join(map(part, answer)) + (f"<p class='explanation'>{html.escape(said)}</p>" if said else "")
    return f"<section class='{html.escape(item.get('format') or 'unknown')}'>{shown}<details>{hidden}</details></section>"


def set_page(items: list[dict], title: str) -> str:
    """One published set as a page of its questions' views, for the screen and for print. For one set, on the driver."""
    style = "section{break-inside:avoid}@media print{details{display:block}}"
    head = f"<!doctype html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title><style>{style}</style></head>"
    return f"{head}<body><h1>{html.escape(title)}</h1>{''.join(map(item_view, items))}</body></html>\n"


def page(rows: list[dict], title: str) -> str:
    """Sentences with the blank filled by the answer, and their choices, on one page. For one set, on the driver."""
    out = [f"<!doctype html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1><ol>"]
    for r in rows:
        answer = next((c["text"] for c in r.get("choices") or [] if c.get("is_correct")), None)
        sentence = html.escape(r.get("sentence") or "")
        if answer is not None:
            sentence = sentence.replace("____", f"<mark>{html.escape(answer)}</mark>", 1)
        choices = "".join(f"<li>{html.escape(c.get('text') or '')}</li>" for c in r.get("choices") or [])
        out.append(f"<li><p>{sentence}</p>" + (f"<ul>{choices}</ul>" if choices else "") + "</li>")
    return "".join(out) + "</ol></body></html>\n"
