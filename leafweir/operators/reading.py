"""Reading order: where the layout and the native text disagree. Each rule is its own relation.

A block's native place is where its text first stands in the page's text (null: not there, or twice).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import rules

# fixed values
EARLY, LATE, NATIVE_LATE, NATIVE_EARLY, LEAST_PROBE = 0.25, 0.75, 0.5, 0.1, 8


def native_places(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """Blocks with layout (0..1 by order) and native (0..1 by characters) of each that stands once in the text."""
    kept = [c for c in blocks.columns if c not in ("doc_id", "page", "lines")]
    order = Window.partitionBy("doc_id", "page").orderBy("block")
    many = Window.partitionBy("doc_id", "page")
    rows = blocks.drop("lines").withColumns({"k": F.row_number().over(order) - 1, "n": F.count(F.lit(1)).over(many)})
    grouped = rows.groupBy("doc_id", "page").agg(F.collect_list(F.struct(*kept, "k", "n")).alias("own"))
    # one row a page: its text is read where it stands, not sent once for each block
    paged = grouped.join(pages.select("doc_id", "page", F.col("text").alias("page_text"), "char_count"), ["doc_id", "page"])
    probe = lambda b: F.trim(F.substring_index(b["text"], "\n", 1))

    def native(b: Column) -> Column:
        at = F.instr(F.col("page_text"), probe(b))
        once = F.instr(F.substr(F.col("page_text"), at + 1), probe(b)) == 0
        return F.when((F.length(probe(b)) >= LEAST_PROBE) & (at > 0) & once, (at - 1) / F.greatest(F.col("char_count"), F.lit(1)))

    placed = paged.select("doc_id", "page", "char_count", F.explode(F.transform("own", lambda b: F.struct(b.alias("b"), native(b).alias("native")))).alias("r"))
    out = placed.select("doc_id", "page", "r.b.*", "char_count", "r.native")
    return out.withColumn("layout", F.col("k") / F.greatest(F.col("n") - 1, F.lit(1)))


def divergent_blocks(placed: DataFrame) -> DataFrame:
    """Early blocks whose text comes late, and late blocks whose text comes first."""
    late = (F.col("layout") <= EARLY) & (F.col("native") >= NATIVE_LATE)
    early = (F.col("layout") >= LATE) & (F.col("native") <= NATIVE_EARLY)
    return rules.warning(placed.filter((F.col("n") >= 4) & (late | early)), "reading_order_divergence", F.when(late, "late").otherwise("early"), F.col("block"))


def out_of_sequence(placed: DataFrame, least: int = 3) -> DataFrame:
    """Pages on which so many neighbours, or a third of them, stand in the opposite order in the text."""
    order = Window.partitionBy("doc_id", "page").orderBy("block")
    rows = placed.filter("native is not null").withColumn("back", (F.col("native") < F.lag("native").over(order)).cast("int"))
    per = rows.groupBy("doc_id", "page").agg(F.sum("back").alias("back"), F.count(F.lit(1)).alias("n"))
    return rules.warning(per.filter((F.col("back") >= least) & (F.col("back") * 3 >= F.col("n"))), "reading_order_divergence", F.concat_ws("/", "back", "n"))


def column_lists(placed: DataFrame, page_width: float, least_blocks: int = 8, least_columns: int = 3) -> DataFrame:
    """Pages of many blocks in columns that the text brings row by row."""
    rows = placed.filter("native is not null").withColumn("col", F.floor(F.col("x") / max(18.0, page_width * 0.04)))
    cols = rows.groupBy("doc_id", "page", "col").agg(F.count(F.lit(1)).alias("k")).filter("k >= 2").groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("cols"), F.sum("k").alias("blocks"))
    order = Window.partitionBy("doc_id", "page").orderBy("native")
    turns = rows.withColumn("turn", (F.col("col") != F.lag("col").over(order)).cast("int")).groupBy("doc_id", "page").agg(F.sum("turn").alias("turns"))
    found = cols.join(turns, ["doc_id", "page"]).filter((F.col("blocks") >= least_blocks) & (F.col("cols") >= least_columns) & (F.col("turns") >= 2 * F.col("cols")))
    return rules.warning(found, "reading_order_divergence", F.concat_ws("/", "turns", "cols"))


def form_labels(labels: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages whose field labels, top to bottom, stand in another order in the text."""
    order = Window.partitionBy("doc_id", "page").orderBy("y", "x")
    rows = labels.filter("label is not null").join(pages.select("doc_id", "page", F.col("text").alias("page_text")), ["doc_id", "page"]).withColumn("at", F.expr("instr(page_text, label)")).filter("at > 0")
    rows = rows.withColumn("back", (F.col("at") < F.lag("at").over(order)).cast("int"))
    per = rows.groupBy("doc_id", "page").agg(F.sum("back").alias("back"), F.count(F.lit(1)).alias("n"))
    return rules.warning(per.filter("n >= 4 and back * 2 >= n"), "reading_order_divergence", F.concat_ws("/", "back", "n"))
