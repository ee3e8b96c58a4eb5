"""A landing folder as a stream: files become rows once, known by their content."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.document import fingerprint, parse_state


def new_documents(spark: SparkSession, folder: str, pattern: str = "*.pdf", delay: str = "1 day") -> DataFrame:
    """path, modified, fingerprint, state, content of files as they come; equal contents within the delay once."""
    rows = spark.readStream.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    rows = rows.select("path", F.col("modificationTime").alias("modified"), fingerprint(F.col("content")).alias("fingerprint"), parse_state(F.col("content")).alias("state"), "content")
    return rows.withWatermark("modified", delay).dropDuplicatesWithinWatermark(["fingerprint"])


def quality_stream(lines: DataFrame) -> DataFrame:
    """Running count of pages by status of a stream of pages that have one."""
    return lines.groupBy("native_text_status").agg(F.count(F.lit(1)).alias("pages"))
