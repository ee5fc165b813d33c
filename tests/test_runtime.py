"""Materialised tables and shipping."""

import os

import pytest

from lexiloom import runtime


def test_materialised_tables_are_read_again_and_discarded(spark):
    runtime.discard(spark)
    df = runtime.materialise(spark.createDataFrame([(1, "a"), (2, None)], "k int, v string"), "t")
    (where,) = runtime._written[spark.sparkContext.applicationId]
    assert where.startswith(runtime.shared_folder(spark) + "/lexiloom/") and sorted(map(tuple, df.collect())) == [(1, "a"), (2, None)]
    assert runtime.discard(spark) == 1 and not os.path.exists(where.removeprefix("file://"))
    assert runtime.materialise(df.sparkSession.createDataFrame([], "k int"), "empty").count() == 0


def test_the_shared_folder_is_the_one_named(spark, monkeypatch):
    assert runtime.shared_folder(spark) == (spark.conf.get("spark.checkpoint.dir", None) or runtime.shared_folder(spark)).rstrip("/")

    class Named:
        conf = type("C", (), {"get": staticmethod(lambda k, d=None: "hdfs://x/y/" if k == "spark.checkpoint.dir" else d)})
        sparkContext = None

    assert runtime.shared_folder(Named()) == "hdfs://x/y"

    class Cluster:
        conf = type("C", (), {"get": staticmethod(lambda k, d=None: d)})
        sparkContext = type("S", (), {"master": "yarn"})

    with pytest.raises(RuntimeError):
        runtime.shared_folder(Cluster())


def test_shipping_happens_once(spark):
    runtime.ship(spark)
    before = dict(runtime._shipped)
    runtime.ship(spark)
    assert runtime._shipped == before and os.path.exists(before[spark.sparkContext.applicationId])
