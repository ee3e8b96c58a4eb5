"""Files as rows: local or remote stores through Spark's readers; a Python data source for parsers."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.document import fingerprint, parse_state


def read_documents(spark: SparkSession, path: str, pattern: str = "*.pdf", most_bytes: int | None = None) -> DataFrame:
    """path, length, fingerprint, state and content; too long ones are left out before they are read."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    rows = rows if most_bytes is None else rows.filter(F.col("length") <= most_bytes)
    return rows.select("path", "length", fingerprint(F.col("content")).alias("fingerprint"), parse_state(F.col("content")).alias("state"), "content")


class EvidenceSource(DataSource):
    """``spark.read.format("leafweir_evidence").option("parser", "module:function")``: one partition per path.

    The parser takes a path and yields tuples (page, text): PDF engines are not part of this library,
    so that any can be put in. Registered with ``spark.dataSource.register(EvidenceSource)``.
    """

    @classmethod
    def name(cls) -> str:
        return "leafweir_evidence"

    def schema(self) -> str:
        return "path string, page int, text string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.paths = [p for p in options.get("paths", options.get("path", "")).split(",") if p]
        self.parser = options.get("parser", "leafweir.sources.files:plain_pages")

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        import importlib

        module, _, function = self.parser.partition(":")
        for page, text in getattr(importlib.import_module(module), function)(partition.value):
            yield partition.value, page, text


def plain_pages(path: str) -> Iterator[tuple[int, str]]:
    """Text files as pages, parted by form feeds."""
    with open(path, encoding="utf-8") as f:
        for i, text in enumerate(f.read().split("\f"), 1):
            yield i, text
