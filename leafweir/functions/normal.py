"""Unicode normalisation, which Spark SQL lacks: an Arrow function over whole batches."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .text import strip_controls


def nfkc(rows: DataFrame, columns: str | list[str], strip: bool = False) -> DataFrame:
    """The rows with this column (or these) in NFKC (null stays null), and without control characters if so asked."""
    names = [columns] if isinstance(columns, str) else columns
    places = [rows.columns.index(c) for c in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in places:
                texts = [t if t is None or t.isascii() else unicodedata.normalize("NFKC", t) for t in batch.column(at).to_pylist()]
                batch = batch.set_column(at, batch.schema.field(at), pa.array(texts, type=pa.string()))
            yield batch

    out = rows.mapInArrow(run, rows.schema)
    return out.withColumns({c: strip_controls(out[c]) for c in names}) if strip else out
