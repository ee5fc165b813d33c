"""Question records as a stream: redelivered ones dropped, late ones kept, and the latest generation of each question kept up to date."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = ["set_id", "question_id", "generation"]


def stream(spark: SparkSession, path: str, schema, *, files_per_trigger: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def once(records: DataFrame, *, within: str = "30 days") -> DataFrame:
    """Each natural key once; its state is kept until ``within`` after its arrival, as redeliveries come within days."""
    return records.withWatermark("ingested_at", within).dropDuplicatesWithinWatermark(KEY)


def by_day(records: DataFrame, *, late: str = "10 days") -> DataFrame:
    """Records and formats per day of creation; days are final once nothing that late can come."""
    day = F.window("created_at", "1 day")
    return records.withWatermark("created_at", late).groupBy(day, "format").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("day"), "format", "n")


_STATE = "generation int, rec_id long, n long"
_OUT = "set_id string, question_id string, generation int, rec_id long, n long"


def _fold(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """State of one question: its highest generation, that one's first row, and the rows seen."""
    best, rec, n = state.get if state.exists else (0, -1, 0)
    for rows in batches:
        n += len(rows)
        for g, r in zip(rows.g, rows.rec_id):
            if g > best or (g == best and r < rec):
                best, rec = int(g), int(r)
    state.update((best, rec, n))
    yield pd.DataFrame({"set_id": [key[0]], "question_id": [key[1]], "generation": [best], "rec_id": [rec], "n": [n]})


def latest_generation(records: DataFrame) -> DataFrame:
    """An update per question and trigger: its latest generation so far. Order of arrival doesn't matter."""
    rows = records.select("set_id", "question_id", F.regexp_extract("generation", "([0-9]+)$", 1).cast("int").alias("g"), "rec_id").where("g is not null")
    return rows.groupBy("set_id", "question_id").applyInPandasWithState(_fold, _OUT, _STATE, "update", "NoTimeout")


def latest_generation_batch(records: DataFrame) -> DataFrame:
    """The same over a whole table."""
    rows = records.select("set_id", "question_id", F.regexp_extract("generation", "([0-9]+)$", 1).cast("int").alias("g"), "rec_id").where("g is not null")
    top = F.max_by("rec_id", F.struct("g", -F.col("rec_id")))
    return rows.groupBy("set_id", "question_id").agg(F.max("g").alias("generation"), top.alias("rec_id"), F.count(F.lit(1)).alias("n"))
