"""Readers: explicit schemas, nothing inferred; what can't be read becomes rows, not exceptions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import jsontext
from ..operators import lookup, versions

LEXICON = "id string, headword string, pos string, level string, core_inventory_1 string, core_inventory_2 string, threshold string, is_multiword boolean, group_ids array<string>"
GROUPS = "group_id string, headword_joined string, pos string, level string, member_ids array<string>"
_FREQ = "struct<A1:double,A2:double,B1:double,B2:double,C1:double>"
_RANGE = "struct<A1:bigint,A2:bigint,B1:bigint,B2:bigint,C1:bigint>"
GRAMMAR = (
    "id string, item_list_id string, parent_id string, display_name string, target_eligible boolean, "
    "item_list struct<name_ja:string,sentence_type_ja:string,shorthand_code:string,grammatical_item_en:string,sentence_type_en:string,note:string,pattern_shorthand:string,regex_treetagger:string>, "
    "kyoinban struct<present:boolean,name_ja:string,name_simple_ja:string,name_en:string,level_raw:string>, "
    f"level struct<min:string,max:string,source:string,inherited_from:string>, efl struct<rel_freq:{_FREQ},range:{_RANGE}>"
)
#: Schemas by name and version; a reader takes the same major version only.
SCHEMAS = {("lexicon", "1.0.0"): LEXICON, ("lexicon_group", "1.0.0"): GROUPS, ("grammar", "1.0.0"): GRAMMAR}


class VersionError(ValueError):
    """Data of another major version."""


def schema(name: str, version: str) -> T.StructType:
    """The schema for data of a version: the same major one, whatever its minor and patch numbers."""
    own = {v.split(".")[0]: s for (n, v), s in SCHEMAS.items() if n == name}
    found = own.get(str(version).split(".")[0])
    if found is None:
        raise VersionError(f"no schema of {name} for version {version}")
    return T.StructType.fromDDL(found) if hasattr(T.StructType, "fromDDL") else T._parse_datatype_string(found)


def json_lines(spark: SparkSession, path: str, name: str, version: str = "1.0.0") -> DataFrame:
    """Rows of a JSON-lines file by the named schema, with corrupt: the text of lines that aren't such a row."""
    full = T.StructType([*schema(name, version).fields, T.StructField("corrupt", T.StringType())])
    return spark.read.schema(full).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "corrupt").json(path)


def json_texts(spark: SparkSession, path: str) -> DataFrame:
    """name, text, problem, canonical of whole JSON files: strict reading with the reason where it fails."""
    files = spark.read.format("binaryFile").load(path)
    text = F.when(F.is_valid_utf8("content"), F.decode("content", "UTF-8"))
    rows = files.select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), text.alias("text"))
    problem = F.when(F.col("text").isNull(), "not UTF-8").otherwise(jsontext.strict_problem("text"))
    return rows.withColumn("problem", problem).withColumn("canonical", jsontext.is_canonical("text"))


def sheet(spark: SparkSession, path: str, columns: list[str], *, separator: str = ",") -> DataFrame:
    """n_row (from 1) and the raw columns of a delimited export of a sheet; its rows keep the file's order. Workbooks are read by ``workbooks``."""
    raw = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    rows = spark.read.schema(raw).option("sep", separator).option("multiLine", "true").csv(path)
    placed = lookup.numbered(rows.withColumn("__at", F.monotonically_increasing_id()), [F.col("__at")], "n_row")
    return placed.select(F.col("n_row").cast("int").alias("n_row"), *columns)


def digests(spark: SparkSession, path: str) -> DataFrame:
    """name, sha256 of the files at a path."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), jsontext.digest("content").alias("sha256"))


def manifest_problems(manifest: DataFrame, roles: list[str]) -> DataFrame:
    """role, kind: roles that aren't there exactly once, and entries with a bad digest or date."""
    n = manifest.groupBy("role").agg(F.count(F.lit(1)).alias("n"))
    want = manifest.sparkSession.createDataFrame([(r,) for r in roles], "role string")
    absent = want.join(n, "role", "left").where(F.coalesce("n", F.lit(0)) != 1).select("role", F.lit("count").alias("kind"))
    extra = manifest.join(want, "role", "left_anti").select("role", F.lit("unknown").alias("kind"))
    digest = manifest.where(~F.coalesce(F.col("sha256").rlike("^[0-9a-f]{64}$"), F.lit(False))).select("role", F.lit("sha256").alias("kind"))
    date = manifest.where(F.coalesce(F.try_to_date("retrieved_date", "yyyy-MM-dd").isNull(), F.lit(True))).select("role", F.lit("date").alias("kind"))
    return absent.unionByName(extra).unionByName(digest).unionByName(date)


class Bundle:
    """The reference tables behind one check of their digests and counts, done once and not with every query."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame], *, recorded: DataFrame | None = None, actual: DataFrame | None = None, counts: dict[str, int] | None = None):
        self.tables = tables
        self.problems: list[str] = []
        if recorded is not None and actual is not None:
            self.problems += [f"digest:{r[0]}" for r in versions.digest_mismatches(recorded, actual).limit(50).collect()]
        for name, n in (counts or {}).items():
            if tables[name].count() != n:
                self.problems.append(f"count:{name}")

    def __getitem__(self, name: str) -> DataFrame:
        if self.problems:
            raise ValueError("; ".join(self.problems))
        return self.tables[name]
