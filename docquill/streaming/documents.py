"""Queries and edits on streams of JSON lines: row transforms without state, so that no watermark is needed and every output mode that
appends will do. A line that isn't JSON is a row with its error and never stops the stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from docquill.functions.registry import DEFAULT, Registry
from docquill.operators.documents import merge_documents, patch_documents, select_nodes
from docquill.operators.evaluate import Limits
from docquill.sources.readers import stream_json_lines


def stream_nodes(spark: SparkSession, path: str, query: str, registry: Registry = DEFAULT, limits: Limits = Limits()) -> DataFrame:
    return select_nodes(stream_json_lines(spark, path), "doc", query, registry, limits)


def stream_patched(spark: SparkSession, path: str, patch: str) -> DataFrame:
    return patch_documents(stream_json_lines(spark, path), "doc", patch)


def stream_merged(spark: SparkSession, path: str, patch: str) -> DataFrame:
    return merge_documents(stream_json_lines(spark, path), "doc", patch)


def write_stream(df: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Parquet files at path, each row once; once: what is there now, then stop."""
    writer = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
