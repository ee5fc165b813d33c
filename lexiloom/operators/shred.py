"""Adjacency-table shredding of deeply nested records into related flat tables.

``nodes`` turns every value of every record into one row: node number, parent, label, ordinal and scalar.
``objects`` joins object nodes with their scalar children and pivots these into columns; ``Entities`` links
the objects to sets, questions, choices and reviews, every child naming its parent.

Defined results: a null document, or one that isn't valid JSON (also NaN, a byte-order mark, nesting deeper than
the parser's limit), has no nodes. Of repeated member names the last counts. Text that holds a JSON object or
array counts as that value, at any depth. Repeated rows are separate documents. An empty table gives empty tables.
Columns beyond those named are never read, so their names can't clash.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import if_small, materialise

NODES = (
    "src string, rec_id long, doc long, node int, parent int, owner int, label string, ordinal int, kind string, scalar string"
)
_ARROW = pa.schema(
    [("src", pa.string()), ("rec_id", pa.int64()), ("doc", pa.int64())]
    + [(c, pa.int32()) for c in ("node", "parent", "owner")]
    + [("label", pa.string()), ("ordinal", pa.int32()), ("kind", pa.string()), ("scalar", pa.string())]
)


class _Number(str):
    """A JSON number as written."""


def _refuse(token: str) -> None:
    raise ValueError(f"{token} is no JSON")


def strict_json(text: str):
    """The value of a JSON text, numbers as written; ValueError where it isn't valid JSON."""
    try:
        return json.loads(text, parse_int=_Number, parse_float=_Number, parse_constant=_refuse)
    except RecursionError as e:
        raise ValueError("nested too deeply") from e


def _held(value):
    """What a text holds if that is a JSON object or array (or text that holds one), else the text."""
    if type(value) is str and value.lstrip()[:1] in ("{", "[", '"'):
        try:
            inner = strict_json(value)
        except ValueError:
            return value
        inner = _held(inner)
        return inner if isinstance(inner, (dict, list)) else value
    return value


# Kinds of values, by the numbers that stand for them while a batch is built.
_KINDS = pa.array(["object", "array", "null", "boolean", "number", "string"])
_OBJECT, _ARRAY, _NULL, _BOOLEAN, _NUMBER, _STRING = range(6)


def _walk(text: str, parents: list, owners: list, labels: list, ordinals: list, kinds: list, scalars: list) -> int:
    """Append one JSON text's nodes, in document order, and return their number; node n is the n-th appended."""
    try:
        value = strict_json(text)
    except ValueError:
        return 0
    n, stack = 0, [(value, -1, -1, None, None)]
    pop, push = stack.pop, stack.append
    while stack:
        value, parent, owner, label, ordinal = pop()
        scalar, own = None, type(value)
        if own is str:
            first = value[:1]
            if first and (first in '{["' or first.isspace()):
                value = _held(value)
                own = type(value)
        if own is str:
            kind, scalar = _STRING, value
        elif own is dict:
            kind = _OBJECT
            if value:
                names = sorted(value)
                for i in range(len(names) - 1, -1, -1):
                    push((value[names[i]], n, n, names[i], i))
        elif own is list:
            kind = _ARRAY
            for i in range(len(value) - 1, -1, -1):
                push((value[i], n, owner, label, i))
        elif own is _Number:
            kind, scalar = _NUMBER, str(value)
        elif own is bool:
            kind, scalar = _BOOLEAN, "true" if value else "false"
        else:
            kind = _NULL
        parents.append(parent)
        owners.append(owner)
        labels.append(label)
        ordinals.append(ordinal)
        kinds.append(kind)
        scalars.append(scalar)
        n += 1
    return n


def node_rows(text: str | None) -> list[tuple]:
    """(node, parent, owner, label, ordinal, kind, scalar) of one JSON text, in document order.

    parent is the enclosing value, owner the enclosing object; an array's items carry its label and count from 0;
    an object's members count in ascending order of their names.
    """
    columns: list[list] = [[] for _ in range(6)]
    n = 0 if text is None else _walk(text, *columns)
    columns[4] = [_KINDS[k].as_py() for k in columns[4]]
    return list(zip(range(n), *columns))


def _sound(text: str | None) -> str | None:
    """Lone surrogates, which no UTF-8 can hold, become U+FFFD."""
    return None if text is None else text.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")


def _strings(values: list) -> pa.Array:
    try:
        return pa.array(values, pa.string())
    except UnicodeEncodeError:
        return pa.array([_sound(v) for v in values], pa.string())


#: Nodes from which on a batch is handed over.
_BATCH = 100_000


def _shred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        start, done, counts = 0, 0, []
        columns: list[list] = [[] for _ in range(6)]
        texts = batch.column(3).to_pylist()
        for i, text in enumerate(texts):
            counts.append(_walk(text, *columns))
            done += counts[-1]
            if done and (done >= _BATCH or i + 1 == len(texts)):
                yield _batch(batch.slice(start, i + 1 - start), counts, columns)
                start, done, counts = i + 1, 0, []
                columns = [[] for _ in range(6)]


def _batch(documents: pa.RecordBatch, counts: list[int], columns: list[list]) -> pa.RecordBatch:
    """The nodes of some documents: each document's own columns repeated for its nodes, which are numbered from 0."""
    sizes = np.array(counts)
    at = pa.array(np.repeat(np.arange(len(sizes)), sizes))
    node = np.arange(int(sizes.sum()), dtype=np.int32) - np.repeat(np.cumsum(sizes) - sizes, sizes).astype(np.int32)
    parents, owners, labels, ordinals, kinds, scalars = columns
    arrays = [documents.column(c).take(at) for c in range(3)]
    arrays += [pa.array(node), pa.array(np.array(parents, np.int32)), pa.array(np.array(owners, np.int32)), _strings(labels), pa.array(ordinals, pa.int32()), _KINDS.take(pa.array(np.array(kinds, np.int8))), _strings(scalars)]
    return pa.RecordBatch.from_arrays(arrays, schema=_ARROW)


def documents(df: DataFrame, src: str, rec_id: str, text: Column) -> DataFrame:
    """src, rec_id, text of a table's JSON texts."""
    return df.select(F.lit(src).alias("src"), F.col(rec_id).cast("long").alias("rec_id"), text.alias("text")).where(F.col("text").isNotNull())


def nodes(texts: DataFrame) -> DataFrame:
    """The adjacency table of documents; doc numbers them, over all sources."""
    one = texts.withColumn("doc", F.monotonically_increasing_id())
    return one.select("src", "rec_id", "doc", "text").mapInArrow(_shred, NODES)


_MEMBERS = ("set_id", "question_id", "format", "text", "review_ref", "gloss", "is_correct")
_PARTS = ("questions", "question_id", "body", "text", "choices")


def objects(table: DataFrame) -> DataFrame:
    """Object nodes joined with their scalar children, which become columns; has_* tells which parts an object has."""
    children = table.where((F.col("parent") == F.col("owner")) & F.col("label").isin(*_MEMBERS, *_PARTS))
    scalar = F.col("kind").isin("string", "number", "boolean")
    wide = children.groupBy("doc", F.col("owner").alias("node")).agg(
        *(F.max(F.when((F.col("label") == m) & scalar, F.col("scalar"))).alias(m) for m in _MEMBERS),
        # a member that isn't null, be it a scalar or a whole structure
        *(F.coalesce(F.max((F.col("label") == p) & (F.col("kind") != "null")), F.lit(False)).alias(f"has_{p}") for p in _PARTS),
    )
    own = table.where(F.col("kind") == "object").select(
        "src", "doc", "rec_id", "node", "owner", "label", "ordinal", (F.col("parent") != F.col("owner")).alias("in_list")
    )
    return own.join(wide, ["doc", "node"], "left")


@dataclass
class Entities:
    """Flat tables of sets, questions, choices and reviews; (doc, node) is the key of each, up_* names the parent, (src, rec_id) the row it came from."""

    sets: DataFrame
    questions: DataFrame
    choices: DataFrame
    reviews: DataFrame


def entities(table: DataFrame, *, keep: bool = True) -> Entities:
    """Link objects to entities. With keep, the adjacency table and the objects are written to the shared folder."""
    table = materialise(table, "nodes") if keep else table
    objs = objects(table)
    objs = materialise(objs, "objects") if keep else objs
    has = {p: F.coalesce(F.col(f"has_{p}"), F.lit(False)) for p in _PARTS}

    def keyed_by_name(label: str, *single: str) -> DataFrame:
        """Members of objects that stand for a list: of this label, in no list, and without the parts that one item has. up is their owner."""
        odd = objs.where((F.col("label") == label) & ~F.col("in_list") & ~reduce(lambda a, b: a | b, (has[p] for p in single)))
        return objs.join(if_small(odd.select("doc", F.col("node").alias("owner"), F.col("owner").alias("up"))), ["doc", "owner"])

    sets = objs.where(has["questions"]).select("src", "doc", "node", "rec_id", "set_id", "format")

    # a question: an item of the list, the one object there instead of a list, or a member of an object of questions
    direct = (F.col("label") == "questions") & (F.col("in_list") | has["question_id"] | has["body"])
    held = objs.where(direct).select("src", "doc", "node", "rec_id", "question_id", "format", F.col("owner").alias("up_set"))
    named = (
        keyed_by_name("questions", "question_id", "body")
        .where(~F.coalesce(direct, F.lit(False)))
        .select("src", "doc", "node", "rec_id", "question_id", "format", F.col("up").alias("up_set"))
    )
    of_set = sets.select("doc", F.col("node").alias("up_set"), F.col("set_id"), F.col("format").alias("set_format"))
    questions = (
        held.unionByName(named)
        .join(of_set, ["doc", "up_set"])
        .select("src", "doc", "node", "up_set", "rec_id", "set_id", "question_id", F.coalesce("format", "set_format").alias("format"))
    )

    # a choice: an item of the list, a named member of an object of choices, or one object there instead of a list
    of_choices = F.col("label") == "choices"
    listed = objs.where(of_choices & F.col("in_list")).select("src", "doc", "node", "rec_id", "text", "has_text", "gloss", "is_correct", F.col("ordinal").alias("choice_no"), F.col("owner").alias("up_body"))
    single = objs.where(of_choices & ~F.col("in_list") & has["text"]).select("src", "doc", "node", "rec_id", "text", "has_text", "gloss", "is_correct", F.lit(0).alias("choice_no"), F.col("owner").alias("up_body"))
    keyed = (
        keyed_by_name("choices", "text")
        .select("src", "doc", "node", "rec_id", "text", "has_text", "gloss", "is_correct", F.col("ordinal").alias("choice_no"), F.col("up").alias("up_body"))
    )
    bodies = objs.where(F.col("label") == "body").select("doc", F.col("node").alias("up_body"), F.col("owner").alias("up_question"))
    choices = listed.unionByName(single).unionByName(keyed).join(bodies, ["doc", "up_body"])
    reviews = (
        objs.where((F.col("label") == "provenance") & F.col("review_ref").isNotNull())
        .groupBy("doc", F.col("owner").alias("up_question"))
        .agg(F.min("src").alias("src"), F.min("node").alias("node"), F.min("rec_id").alias("rec_id"), F.min("review_ref").alias("review_ref"))
    )
    return Entities(sets, questions, choices, reviews)
