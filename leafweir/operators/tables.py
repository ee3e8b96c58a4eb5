"""Tables of aligned text, sparse numeric rows under headers, headers split off their tables.

Cells are rows doc_id, page, line, word, text and box. Folding rows into tables looks at neighbours
only, so it is windows and joins within a page.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T

# fixed values
ALIGNED_ROWS, ALIGNED_GAP, ALIGNED_CELLS, NUMERIC_GAP = 5, 24.0, 3, 48.0
SPARSE_CELLS, SPARSE_HEADERS, SPARSE_SCAN, SPLIT_ROWS, SPLIT_GAP = 3, 3, 20, 10, 8.0
CADENCE_SHARE, CADENCE_SLACK = 0.65, 0.25


def rows_of(cells: DataFrame) -> DataFrame:
    """One row per line: top, bottom, cells, numeric cells, array of left edges to 5 points, texts."""
    return cells.groupBy("doc_id", "page", "line").agg(
        F.min("y").alias("top"), F.max(F.col("y") + F.col("height")).alias("bottom"), F.count(F.lit(1)).alias("cells"), F.sum(T.numeric_cell(F.col("text")).cast("int")).alias("numeric"),
        F.sort_array(F.collect_set(F.floor(F.col("x") / 5))).alias("lefts"), F.transform(F.sort_array(F.collect_list(F.struct("x", "word", "text"))), lambda s: s["text"]).alias("texts"),
    )


def _folded(rows: DataFrame, gap: float, same: bool) -> DataFrame:
    order = Window.partitionBy("doc_id", "page").orderBy("top", "line")
    near = F.col("top") - F.lag("bottom").over(order) <= gap
    shared = F.size(F.array_intersect("lefts", F.lag("lefts").over(order))) >= 2 if same else F.lit(True)
    marked = rows.withColumn("_new", F.when(F.coalesce(near & shared, F.lit(False)), 0).otherwise(1))
    return marked.withColumn("table", (F.sum("_new").over(order) - 1).cast("int")).drop("_new")


def aligned_text_tables(rows: DataFrame) -> DataFrame:
    """Five or more rows of three or more cells with two left edges in common with the row before."""
    folded = _folded(rows.filter(F.col("cells") >= ALIGNED_CELLS), ALIGNED_GAP, True)
    return folded.groupBy("doc_id", "page", "table").agg(F.min("line").alias("first_line"), F.max("line").alias("last_line"), F.count(F.lit(1)).alias("row_count"), F.max("cells").alias("column_count")).filter(F.col("row_count") >= ALIGNED_ROWS)


def numeric_tables(rows: DataFrame) -> DataFrame:
    """Two or more rows with three cells, two of them numeric, at most 48 points apart, of regular cadence."""
    folded = _folded(rows.filter("cells >= 3 and numeric >= 2"), NUMERIC_GAP, False)
    order = Window.partitionBy("doc_id", "page", "table").orderBy("top", "line")
    stepped = folded.withColumn("step", F.col("top") - F.lag("top").over(order))
    usual = stepped.groupBy("doc_id", "page", "table").agg(F.median("step").alias("usual"))
    per = stepped.join(usual, ["doc_id", "page", "table"]).groupBy("doc_id", "page", "table").agg(
        F.min("line").alias("first_line"), F.max("line").alias("last_line"), F.count(F.lit(1)).alias("row_count"), F.max("cells").alias("column_count"),
        F.avg((F.abs(F.col("step") - F.col("usual")) <= F.greatest(F.lit(2.0), CADENCE_SLACK * F.col("usual"))).cast("int")).alias("cadence"),
    )
    return per.filter((F.col("row_count") >= 2) & (F.coalesce("cadence", F.lit(1.0)) >= CADENCE_SHARE)).drop("cadence")


def sparse_tables(rows: DataFrame) -> DataFrame:
    """A labelled row of three or more numbers under three or more rows without any, close above."""
    order = Window.partitionBy("doc_id", "page").orderBy("top", "line")
    heads = F.sum(F.when((F.col("numeric") == 0) & (F.col("cells") >= 2), 1).otherwise(0)).over(order.rowsBetween(-SPARSE_SCAN, -1))
    others = F.sum(F.when(F.col("numeric") >= 2, 1).otherwise(0)).over(order.rowsBetween(-SPARSE_SCAN, -1))
    after = F.lead("numeric").over(order)
    rows = rows.withColumns({"heads": heads, "others": F.coalesce(others, F.lit(0)), "after": F.coalesce(after, F.lit(0))})
    labelled = ~T.numeric_cell(F.get("texts", F.lit(0)))
    return rows.filter((F.col("numeric") >= SPARSE_CELLS) & labelled & (F.col("heads") >= SPARSE_HEADERS) & (F.col("others") == 0) & (F.col("after") < 2)).select("doc_id", "page", "line", "cells", "numeric", "heads")


def merge_split_headers(tables: DataFrame) -> DataFrame:
    """Tables with a small one right above taken in: rows doc_id, page, table, top, bottom, row_count."""
    small = tables.filter(F.col("row_count") <= SPLIT_ROWS).select("doc_id", "page", F.col("table").alias("head"), F.col("top").alias("h_top"), F.col("bottom").alias("h_bottom"), F.col("row_count").alias("h_rows"))
    gap = F.col("top") - F.col("h_bottom")
    pair = tables.join(small, ["doc_id", "page"]).filter((F.col("head") != F.col("table")) & (gap >= 0) & (gap <= SPLIT_GAP))
    best = pair.groupBy("doc_id", "page", "table").agg(F.min(F.struct(gap.alias("gap"), "head", "h_top", "h_rows")).alias("b"))
    gone = best.select("doc_id", "page", F.col("b.head").alias("table")).distinct()
    kept = tables.join(gone, ["doc_id", "page", "table"], "left_anti").join(best, ["doc_id", "page", "table"], "left")
    return kept.select("doc_id", "page", "table", F.coalesce("b.h_top", "top").alias("top"), "bottom", (F.col("row_count") + F.coalesce("b.h_rows", F.lit(0))).alias("row_count"))


def continued_labels(rows: DataFrame) -> DataFrame:
    """Rows of one text cell right under a labelled numeric row, joined to its label: doc_id, page, line, label."""
    order = Window.partitionBy("doc_id", "page").orderBy("top", "line")
    one = (F.col("cells") == 1) & (F.col("numeric") == 0)
    nxt = F.lead(F.when(one, F.get("texts", F.lit(0)))).over(order)
    close = F.lead("top").over(order) - F.col("bottom") <= 6
    label = F.get("texts", F.lit(0))
    return rows.withColumn("_next", F.when(close, nxt)).filter((F.col("numeric") >= 2) & ~T.numeric_cell(label)).select("doc_id", "page", "line", F.concat_ws(" ", label, F.col("_next")).alias("label"))
