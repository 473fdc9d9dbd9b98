"""Documents from files and to files: one JSON text in column `doc`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_json_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """A document for each line; blank lines are none. Splits with the files."""
    return spark.read.text(path).where(F.trim("value") != "").select(F.col("value").alias("doc"))


def read_json_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """A document for each file, with the file's path."""
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("doc"), F.col("_metadata.file_path").alias("file"))


def read_json_bytes(spark: SparkSession, path: str) -> DataFrame:
    """A document for each file, bytes checked as UTF-8: doc is NULL and valid_utf8 false where they aren't."""
    raw = spark.read.format("binaryFile").load(path)
    return raw.select(F.try_validate_utf8(F.col("content").cast("string")).alias("doc"), F.col("path").alias("file"), F.is_valid_utf8(F.col("content").cast("string")).alias("valid_utf8"))


def stream_json_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.text(path).where(F.trim("value") != "").select(F.col("value").alias("doc"))


def from_columns(df: DataFrame, columns: list[str], doc: str = "doc") -> DataFrame:
    """df with a document of some of its columns; NULLs become JSON nulls."""
    return df.withColumn(doc, F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))


def write_json_lines(df: DataFrame, path: str, doc: str = "doc") -> None:
    df.select(doc).write.text(path)
