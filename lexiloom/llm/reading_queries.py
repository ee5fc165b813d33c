"""Queries of problem 8: how demanding each English document is."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import table
from . import reading


def _features(spark: SparkSession, folder: str) -> tuple[DataFrame, reading.Labelled]:
    levels = reading.load_levels(table(spark, folder, "lexicon"))
    features = reading.feature_table(reading.eligible(table(spark, folder, "documents")), levels)
    return features, reading.labelled(features, table(spark, folder, "level_labels"))


def _scored(spark: SparkSession, folder: str) -> DataFrame:
    features, data = _features(spark, folder)
    return reading.score(features, reading.train(data)[0])


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return _scored(spark, folder).select("doc_id", "band")


def p8_profile(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and mean grade of each source by band."""
    return _scored(spark, folder).groupBy("source", "band").agg(F.count(F.lit(1)).alias("n_documents"), F.round(F.avg("grade"), 4).alias("mean_grade"))


def p8_validation(spark: SparkSession, folder: str) -> DataFrame:
    """By fold of sources: rated documents, mean error of the calibrated grade, and share of ratings that name the predicted band."""
    _, data = _features(spark, folder)
    _, held_out = reading.train(data)
    rows = []
    for k in np.unique(data.fold):
        at = data.fold == k
        off = np.abs(held_out[at] - data.y[at])
        same = np.abs(np.clip(np.floor(held_out[at] + 0.5), 0, 2) - data.y[at]) < 0.5
        rows.append((int(k), len(set(data.source[at])), int(at.sum()), float(np.average(off, weights=data.weight[at])), float(np.average(same, weights=data.weight[at]))))
    return spark.createDataFrame(rows, "fold int, n_sources int, n_documents int, mean_error double, agreement double")


def queries() -> dict:
    return {f.__name__: f for f in (p8_found, p8_profile, p8_validation)}


def oracle_sql() -> dict[str, str]:
    """None: a trained model has no SQL; the tests hold its held-out accuracy."""
    return {}
