"""Folds over the rows of one page, where the rule depends on order and no window can say it.

Rows are dealt and sorted by page and streamed as Arrow batches; a fold gets one page's columns as lists
and gives rows. Only the page at hand is held: the last of a batch waits for the next batch's first rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType, _parse_datatype_string


def by_page(rows: DataFrame, columns: list[str], order: list, fold: Callable[[int, int, dict[str, list]], list[tuple]], schema: str) -> DataFrame:
    """Rows of ``schema`` that the fold gives for (doc_id, page, columns as lists) of every page, in ``order`` within it."""
    from pyspark.sql.pandas.types import to_arrow_schema

    cols = ["doc_id", "page", *columns]
    kind: StructType = _parse_datatype_string(schema)
    out = to_arrow_schema(kind)

    def packed(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*found, strict=True), out, strict=True)], schema=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        found: list[tuple] = []

        def apply(part: pa.Table) -> None:
            found.extend(fold(part.column("doc_id")[0].as_py(), part.column("page")[0].as_py(), {c: part.column(c).to_pylist() for c in columns}))

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            if held is not None:
                table = pa.concat_tables([held, table])
            doc, page = (table.column(c).to_numpy() for c in ("doc_id", "page"))
            begin = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (page[1:] != page[:-1])])).tolist()
            for a, b in zip(begin[:-1], begin[1:], strict=True):
                apply(table.slice(a, b - a))
            held = table.slice(begin[-1])
            if len(found) >= 4096:
                yield packed(found)
                found.clear()
        if held is not None:
            apply(held)
        if found:
            yield packed(found)

    return rows.select(*cols).repartition("doc_id", "page").sortWithinPartitions("doc_id", "page", *order).mapInArrow(run, schema)
