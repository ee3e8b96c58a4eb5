"""Vertical CJK columns and ruby: sessions down a column, range joins from ruby to base."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as G
from ..functions import text as T

# fixed values
LEAST_RUN, STEP, RUBY_FONT, RUBY_GAP_EM = 5, (0.7, 1.8), 0.6, 1.05


def vertical_runs(spans: DataFrame, least: int = LEAST_RUN) -> DataFrame:
    """Single CJK glyphs one under another at one x, a regular step apart: doc_id, page, run, text, box, glyphs."""
    glyphs = spans.filter((F.length("text") <= 2) & T.cjk_leading(F.col("text"))).withColumn("col", F.floor(F.col("x") / F.greatest("font_size", F.lit(1.0)) + 0.5))
    order = Window.partitionBy("doc_id", "page", "col").orderBy("y", "word")
    step = (F.col("y") - F.lag("y").over(order)) / F.greatest("font_size", F.lit(1.0))
    new = F.when(step.between(*STEP), 0).otherwise(1)
    rows = glyphs.withColumn("new", new).withColumn("part", F.sum("new").over(order))
    said = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("y", "word", "text"))), lambda s: s["text"]), "")
    runs = rows.groupBy("doc_id", "page", "col", "part").agg(said.alias("text"), F.count(F.lit(1)).alias("glyphs"), F.max("font_size").alias("font_size"), *G.union_aggs()).filter(F.col("glyphs") >= least)
    return runs.withColumn("run", F.row_number().over(Window.partitionBy("doc_id", "page").orderBy(F.desc("x"), "y")) - 1).drop("col", "part")


def vertical_blocks(runs: DataFrame, gap_em: float = 2.0) -> DataFrame:
    """Neighbouring columns, right to left, as blocks: doc_id, page, block, text, box."""
    order = Window.partitionBy("doc_id", "page").orderBy("run")
    apart = F.lag("x").over(order) - (F.col("x") + F.col("width"))
    aside = F.least(F.col("y") + F.col("height"), F.lag(F.col("y") + F.col("height")).over(order)) <= F.greatest(F.col("y"), F.lag("y").over(order))
    new = F.when(F.coalesce((apart <= gap_em * F.col("font_size")) & ~aside, F.lit(False)), 0).otherwise(1)
    rows = runs.withColumn("new", new).withColumn("block", F.sum("new").over(order) - 1)
    said = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("run", "text"))), lambda s: s["text"]), "\n")
    return rows.groupBy("doc_id", "page", "block").agg(said.alias("text"), F.count(F.lit(1)).alias("columns"), *G.union_aggs())


def horizontal_ruby(spans: DataFrame) -> DataFrame:
    """Small kana just above a base: each ruby span with the base that shares most of its width."""
    pick = lambda p: spans.select("doc_id", "page", F.col("line").alias(f"{p}_line"), F.col("word").alias(f"{p}_word"), F.col("text").alias(f"{p}_text"), F.col("font_size").alias(f"{p}_em"), G.box().alias(f"{p}_box"))
    ruby = pick("ruby").filter(F.col("ruby_text").rlike(r"^[\p{IsHiragana}\p{IsKatakana}]+$"))
    base = pick("base").filter(F.col("base_text").rlike(r"\p{IsHan}"))
    gap = F.col("base_box.y") - F.col("ruby_box.y")
    near = (F.col("ruby_em") <= RUBY_FONT * F.col("base_em")) & (gap > 0) & (gap <= RUBY_GAP_EM * F.col("base_em")) & (G.x_overlap(F.col("ruby_box"), F.col("base_box")) > 0)
    pair = ruby.join(base, ["doc_id", "page"]).filter(near)
    best = Window.partitionBy("doc_id", "page", "ruby_line", "ruby_word").orderBy(F.desc(G.horizontal_overlap_ratio(F.col("ruby_box"), F.col("base_box"))), gap, "base_line", "base_word")
    return pair.withColumn("n", F.row_number().over(best)).filter("n = 1").select("doc_id", "page", "ruby_line", "ruby_word", "ruby_text", "base_line", "base_word", "base_text")


def merge_ruby(associations: DataFrame) -> DataFrame:
    """Ruby over neighbouring words of one line as one association."""
    order = Window.partitionBy("doc_id", "page", "base_line").orderBy("base_word", "ruby_word")
    new = F.when(F.col("base_word") - F.lag("base_word").over(order) <= 1, 0).otherwise(1)
    rows = associations.withColumn("new", new).withColumn("part", F.sum("new").over(order))
    join = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("base_word", "ruby_word", c))), lambda s: s[c]), "")
    base = F.array_join(F.transform(F.sort_array(F.collect_set(F.struct("base_word", "base_text"))), lambda s: s["base_text"]), "")
    return rows.groupBy("doc_id", "page", "base_line", "part").agg(join("ruby_text").alias("ruby"), base.alias("base")).drop("part")
