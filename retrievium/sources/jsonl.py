"""JSON lines and reports: scans with explicit schemas, and sinks. Spark skips blank lines by itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..schemas import schema as named

BAD = "_corrupt_record"


def _schema(s: str | StructType) -> StructType:
    return named(s) if isinstance(s, str) and " " not in s else StructType.fromDDL(s) if isinstance(s, str) else s


def read_strict(spark: SparkSession, path: str | list[str], schema: str | StructType) -> DataFrame:
    """Fails on a malformed line."""
    return spark.read.schema(_schema(schema)).option("mode", "FAILFAST").json(path)


def read_tolerant(spark: SparkSession, path: str | list[str], schema: str | StructType) -> DataFrame:
    """Leaves malformed lines out; a missing field is null."""
    return spark.read.schema(_schema(schema)).option("mode", "DROPMALFORMED").json(path)


def read_with_errors(spark: SparkSession, path: str | list[str], schema: str | StructType) -> DataFrame:
    """Malformed lines come as rows that hold nothing but the line, in _corrupt_record."""
    s = StructType([*_schema(schema).fields]).add(BAD, "string")
    return spark.read.schema(s).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD).json(path)


def read_whole(spark: SparkSession, path: str | list[str], schema: str | StructType | None = None, tolerant: bool = False) -> DataFrame:
    """A file is one JSON object or an array of them; with tolerant, a file that isn't JSON has no rows."""
    r = spark.read.option("multiLine", True).option("mode", "DROPMALFORMED" if tolerant else "PERMISSIVE")
    return (r.schema(_schema(schema)) if schema else r).json(path)


def write(df: DataFrame, path: str, keep_nulls: bool = False) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", not keep_nulls).json(path)


def write_report(df: DataFrame, path: str) -> None:
    """A report, which is a few rows, as one file."""
    df.coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_by_category(df: DataFrame, path: str, column: str = "category") -> None:
    df.write.mode("overwrite").partitionBy(column).json(path)


def read_categories(spark: SparkSession, root: str, schema: str | StructType, category: str | None = None, skip_combined: bool = True, pattern: str = "*.jsonl") -> DataFrame:
    """All files of the pattern in root/<category> (or root/category=<category>, as write_by_category has it), or of one, with `category` and `file`; what an earlier combination wrote is left out."""
    own = spark.read.schema(_schema(schema)).option("mode", "DROPMALFORMED").option("pathGlobFilter", pattern).json(f"{root}/{category or '*'}")
    own = own.withColumn("file", F.col("_metadata.file_path")).withColumn("category", F.regexp_replace(F.element_at(F.split("file", "/"), -2), "^category=", ""))
    return own.where(~F.col("file").endswith("_combined.jsonl")) if skip_combined else own


def read_config(spark: SparkSession, path: str) -> DataFrame:
    """key, value of lines key=value; comments and lines without = are left out."""
    line = F.trim("value")
    parts = F.split(line, "=", 2)
    return spark.read.text(path).where(~line.startswith("#") & line.contains("=")).select(F.trim(parts[0]).alias("key"), F.trim(parts[1]).alias("value"))
