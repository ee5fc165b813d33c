"""Reading level of each document: boosted trees over its distributions, calibrated and cross-validated by source.

Each document's features are computed once, where it is read, into a table of the shared folder. The model is trained on the documents that
raters labelled, at most MAX_LABELLED of them (by a hash of their id, a bounded sample); each counts as often as it was
rated, with the mean of its grades. Predictions for labelled documents by forests that saw none of their source give the
calibration, an ascending step function, and the report by source. Every document is then scored.

Defined results: documents that are no English, or too short, or without text are left out; a null source is one source;
labels of unknown bands or of documents left out don't count; without any label grade and band are null; repeated
rows are scored each; an empty table gives none.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import materialise
from . import boosting, readability

BANDS = ("easy", "middle", "hard")
MAX_LABELLED = 20_000
#: A lexicon is a fixed table; larger ones are refused rather than sent to every task.
MAX_LEXICON = 200_000
FOLDS = 5
LEAST_CHARS = 200
_KNOWN = 200_000


@dataclass
class Model:
    forest: boosting.Forest
    steps: tuple[np.ndarray, np.ndarray]

    def grade(self, x: np.ndarray) -> np.ndarray:
        return boosting.calibrated(self.steps, self.forest.predict(x))


def load_levels(lexicon: DataFrame) -> dict[str, int]:
    """Lowest level of each one-word headword."""
    rows = lexicon.where("not is_multiword").groupBy(F.lower("headword").alias("word")).agg(F.min("level").alias("level")).limit(MAX_LEXICON + 1).collect()
    if len(rows) > MAX_LEXICON:
        raise ValueError(f"a lexicon of more than {MAX_LEXICON} words")
    return {r["word"]: readability.LEVELS[r["level"]] for r in rows if r["level"] in readability.LEVELS}


def eligible(documents: DataFrame) -> DataFrame:
    """English documents of LEAST_CHARS characters or more."""
    english = F.lower(F.trim("lang")).startswith("en")
    return documents.where(english & (F.col("n_chars") >= LEAST_CHARS) & F.col("text").isNotNull())


def feature_table(documents: DataFrame, levels: dict[str, int]) -> DataFrame:
    """doc_id, source, x: the features of each document, a table of the shared folder."""
    shared = documents.sparkSession.sparkContext.broadcast(levels)
    schema = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("x", pa.list_(pa.float32()))])

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            x = []
            for text in batch.column(2):
                x.append(readability.features(text.as_py(), shared.value, known))
                if len(known) > _KNOWN:
                    known.clear()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x, pa.list_(pa.float32()))], schema=schema)

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text")
    return materialise(rows.mapInArrow(compute, "doc_id long, source string, x array<float>"), "features")


@dataclass
class Labelled:
    doc_id: np.ndarray
    source: np.ndarray
    x: np.ndarray
    y: np.ndarray
    weight: np.ndarray
    fold: np.ndarray


def labelled(table: DataFrame, labels: DataFrame) -> Labelled:
    """The training rows: at most MAX_LABELLED rated documents."""
    grade = F.array_position(F.array(*map(F.lit, BANDS)), F.col("band")) - 1
    rated = labels.withColumn("grade", grade).where("grade >= 0").groupBy("doc_id").agg(F.avg("grade").alias("y"), F.count(F.lit(1)).alias("weight"))
    one = table.join(rated, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED).collect()
    one.sort(key=lambda r: (r["doc_id"], r["x"]))
    source = np.array([r["source"] or "" for r in one], object)
    fold = np.array([zlib.crc32(s.encode()) % FOLDS for s in source], np.int64)
    x = np.array([r["x"] for r in one], np.float32).reshape(len(one), len(readability.NAMES)).astype(float)
    return Labelled(np.array([r["doc_id"] for r in one], np.int64), source, x, np.array([r["y"] for r in one], float), np.array([r["weight"] for r in one], float), fold)


def train(data: Labelled, **settings) -> tuple[Model | None, np.ndarray]:
    """The calibrated model, and each training row's calibrated grade by forests that saw none of its source."""
    if not len(data.y):
        return None, np.empty(0)
    held_out = boosting.cross_predict(data.x, data.y, data.weight, data.fold, **settings)
    steps = boosting.isotonic(held_out, data.y, data.weight) if len(np.unique(data.fold)) > 1 else (np.empty(0), np.empty(0))
    return Model(boosting.fit(data.x, data.y, data.weight, **settings), steps), boosting.calibrated(steps, held_out)


def bands(grade: np.ndarray) -> list[str]:
    return [BANDS[i] for i in np.clip(np.floor(grade + 0.5), 0, 2).astype(int)]


def score(table: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, source, grade, band of each row of the feature table."""
    if model is None:
        return table.select("doc_id", "source", F.lit(None).cast("double").alias("grade"), F.lit(None).cast("string").alias("band"))
    shared = table.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("grade", pa.float64()), ("band", pa.string())])

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(2).flatten().to_numpy().reshape(batch.num_rows, -1).astype(float)
            grade = shared.value.grade(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(grade), pa.array(bands(grade))], schema=schema)

    return table.mapInArrow(predict, "doc_id long, source string, grade double, band string")
