"""Session settings, table access and lineage cuts shared by all operators."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Options an interactive or test session starts from; a cluster brings its own.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.compression.codec": "zstd",
}


def session(name: str = "lexiloom", cores: int | str = "*", **options: str) -> SparkSession:
    """A local session with this library's defaults (or the running session)."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    for key, value in {**DEFAULTS, **options}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


_shipped: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Let the session's Python workers import this package, wherever they start; once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    folder = tempfile.mkdtemp(prefix="lexiloom-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    code, root = os.path.join(folder, "lexiloom.zip"), Path(__file__).resolve().parent
    with zipfile.ZipFile(code, "w", zipfile.ZIP_DEFLATED) as z:
        for file in sorted(root.rglob("*.py")):
            z.write(file, file.relative_to(root.parent))
    context.addPyFile(code)
    _shipped[context.applicationId] = code


_local_folder: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it in spark.checkpoint.dir.

    Only where that setting is absent (a local session) a temporary folder is made, once.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not _local_folder:
        _local_folder.append(tempfile.mkdtemp(prefix="lexiloom-"))
        atexit.register(shutil.rmtree, _local_folder[0], ignore_errors=True)
    return "file://" + _local_folder[0]


_written: dict[str, list[str]] = {}


def discard(spark: SparkSession) -> int:
    """Delete the tables that this application has materialised; returns their number. Results not yet read are lost with them."""
    own = _written.pop(spark.sparkContext.applicationId, [])
    jvm = spark._jvm
    for where in own:
        path = jvm.org.apache.hadoop.fs.Path(where)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return len(own)


def _leave_nothing() -> None:
    """At the program's end: delete what is left, if its session still runs."""
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.sparkContext._jsc is not None:
        try:
            discard(spark)
        except Exception:  # the gateway may be gone already; the tables then stay for whoever owns the folder
            pass


atexit.register(_leave_nothing)


def fresh_place(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, dropped by ``discard`` like a materialised table."""
    where = f"{shared_folder(spark)}/lexiloom/{label}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(where)
    return where


def materialise(df: DataFrame, label: str, *, mode: str = "errorifexists") -> DataFrame:
    """Write ``df`` as a table of the shared folder and read it back.

    The lineage ends there, so neither a lost executor nor a second use computes it again. The table's
    name is new each time; ``discard`` drops the run's tables once its results are read, at the latest when the program ends.
    """
    spark = df.sparkSession
    where = fresh_place(spark, label)
    df.write.mode(mode).option("compression", "zstd").parquet(where)
    return spark.read.schema(df.schema).parquet(where)


def bounded(rows: DataFrame, most: int = 200_000) -> bool:
    """Whether a table is small enough to be sent to every task: its rows are counted, up to the bound."""
    return rows.limit(most + 1).count() <= most


def if_small(rows: DataFrame) -> DataFrame:
    """rows to be broadcast where they are few enough, else to be joined as Spark sees fit."""
    return F.broadcast(rows) if bounded(rows) else rows


def slots(spark: SparkSession) -> int:
    """Tasks that can run at once, at least one."""
    return max(1, spark.sparkContext.defaultParallelism)


def public_vocabulary(name: str) -> str:
    """Path of a public tokenizer's vocabulary file: LEXILOOM_TOKENIZERS or /opt/tokenizers."""
    return os.path.join(os.environ.get("LEXILOOM_TOKENIZERS", "/opt/tokenizers"), name)
