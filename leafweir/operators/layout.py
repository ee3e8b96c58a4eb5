"""Layout: spans to lines, lines to blocks, headings, column order, numeric tables.

Where the rule is greedy and depends on order (lines anchored on their first span, first-fit columns)
it is a fold over one page (``folds``); a page is bounded. What windows can say is a window.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as G
from ..functions import text as T
from .folds import by_page

# fixed values: heading tiers over the body font
TIERS = ((1.40, 1), (1.25, 2), (1.15, 3), (1.08, 4))
COLUMN_SLACK = 0.05
GUTTER_BIN, GUTTER_GAP, FONT = 5, 9.0, 12.0


def dedupe_items(items: DataFrame) -> DataFrame:
    """Text items drawn twice at one place (size, matrix to 3 digits, font): the first, with line ends joined."""
    key = ["doc_id", "page", "str", F.round("width", 3).alias("w3"), F.round("height", 3).alias("h3"), F.transform("transform", lambda v: F.round(v, 3)).alias("m3"), F.coalesce("font_name", F.lit("")).alias("font")]
    return items.groupBy(*key).agg(F.min("ord").alias("ord"), F.bool_or("has_eol").alias("has_eol"), F.min_by("width", "ord").alias("width"), F.min_by("height", "ord").alias("height"), F.min_by("transform", "ord").alias("transform")).withColumnRenamed("font", "font_name").drop("w3", "h3", "m3")


def lines_from_spans(spans: DataFrame, gutter_em: float = 4.0) -> DataFrame:
    """Greedy rows anchored on their first span (half its height), cut at gutters; one row per line."""

    def page(doc: int, number: int, c: dict[str, list]) -> list[tuple]:
        x, y, w, h, font, text, order = (c[k] for k in ("x", "y", "width", "height", "font_size", "text", "ord"))
        rows: list[list[int]] = []
        for i in range(len(y)):
            for row in reversed(rows):
                if abs(y[i] - y[row[0]]) <= max(h[row[0]], 1.0) * 0.5:
                    row.append(i)
                    break
            else:
                rows.append([i])
        out: list[tuple] = []
        for row in rows:
            row.sort(key=lambda i: (x[i], order[i]))
            runs = [[row[0]]]
            for a, b in zip(row, row[1:], strict=False):
                if x[b] - (x[a] + w[a]) > max(font[b], 1.0) * gutter_em:
                    runs.append([])
                runs[-1].append(b)
            for run in runs:
                said = [text[run[0]]]
                for a, b in zip(run, run[1:], strict=False):
                    said += [" ", text[b]] if x[b] - (x[a] + w[a]) > 0.18 * max(font[b], 1) else [text[b]]
                fonts = Counter(font[i] for i in run)
                left, top = min(x[i] for i in run), min(y[i] for i in run)
                # the first of the commonest sizes
                out.append((doc, number, len(out), "".join(said), left, top, max(x[i] + w[i] for i in run) - left, max(y[i] + h[i] for i in run) - top, fonts.most_common(1)[0][0]))
        return out

    return by_page(spans, ["x", "y", "width", "height", "font_size", "text", "ord"], ["y", "x", "ord"], page, "doc_id long, page int, line int, text string, x double, y double, width double, height double, font_size double")


def sessions(lines: DataFrame, gap: float = 0.8) -> DataFrame:
    """Lines to blocks: a block ends at a gap of more than ``gap`` heights, another size or no common x."""
    order = Window.partitionBy("doc_id", "page").orderBy("y", "x", "line")
    prev = {c: F.lag(c).over(order) for c in ("x", "y", "width", "height", "font_size")}
    apart = F.col("y") - (prev["y"] + prev["height"]) > gap * F.greatest("height", prev["height"])
    size = F.greatest("font_size", prev["font_size"]) > 1.3 * F.least("font_size", prev["font_size"])
    aside = F.least(F.col("x") + F.col("width"), prev["x"] + prev["width"]) <= F.greatest("x", prev["x"])
    new = F.when(prev["y"].isNull() | apart | size | aside, 1).otherwise(0)
    return lines.withColumn("_new", new).withColumn("block", (F.sum("_new").over(order) - 1).cast("int")).drop("_new")


def body_font(lines: DataFrame) -> DataFrame:
    """doc_id, page, body: median font size of a page, each line weighted by its characters."""
    rows = lines.select("doc_id", "page", "font_size", F.length(F.trim("text")).alias("n")).filter("n > 0 and font_size > 0")
    order = Window.partitionBy("doc_id", "page").orderBy("font_size")
    run = rows.groupBy("doc_id", "page", "font_size").agg(F.sum("n").alias("n")).withColumn("upto", F.sum("n").over(order)).withColumn("all", F.sum("n").over(Window.partitionBy("doc_id", "page")))
    return run.filter(F.col("upto") >= F.col("all") / 2).groupBy("doc_id", "page").agg(F.min("font_size").alias("body"))


def heading_text(text: Column) -> Column:
    """Text that can be a heading: short, with a letter, no caption, handle, address or sentence end."""
    t = F.trim(text)
    return (F.length(t).between(2, 120)) & t.rlike(r"\p{L}") & ~t.rlike(T.CAPTION) & ~t.rlike(r"(?i)^(?:https?://|www\.|@|doi:)") & ~t.rlike(r"[,;]$") & ~t.rlike(r"[.!?]\s+\p{Lu}.*[.!?]$")


def headings(blocks: DataFrame, fonts: DataFrame) -> DataFrame:
    """Blocks with level (1 to 4) and confidence where their font stands out from the page's body font."""
    rate = F.col("font_size") / F.col("body")
    level = F.coalesce(*[F.when(rate >= least, n) for least, n in TIERS])
    able = heading_text(F.col("text")) & (F.col("n_lines") <= 3)
    out = blocks.join(fonts, ["doc_id", "page"], "left").withColumn("level", F.when(able, level))
    return out.withColumn("confidence", F.when(F.col("level").isNotNull(), G.half_up(F.least(F.lit(1.0), 0.5 + (rate - 1)), 2)))


def neighbours(blocks: DataFrame) -> DataFrame:
    """Each block's nearest block above and below that shares some of its width (null where there is none)."""
    o = blocks.select(F.col("doc_id").alias("od"), F.col("page").alias("op"), F.col("block").alias("other"), G.box().alias("_o"))
    b = blocks.select("doc_id", "page", "block", G.box().alias("_b"))
    pair = b.join(o, (F.col("doc_id") == F.col("od")) & (F.col("page") == F.col("op")) & (F.col("block") != F.col("other")) & (G.x_overlap(F.col("_b"), F.col("_o")) > 0))
    above, below = F.col("_b.y") - G.bottom(F.col("_o")), F.col("_o.y") - G.bottom(F.col("_b"))
    near = pair.groupBy("doc_id", "page", "block").agg(F.min_by("other", F.when(above >= 0, F.struct(above, "other"))).alias("above"), F.min_by("other", F.when(below >= 0, F.struct(below, "other"))).alias("below"))
    return b.select("doc_id", "page", "block").join(near, ["doc_id", "page", "block"], "left")


def column_order(blocks: DataFrame, page_width: float) -> DataFrame:
    """Reading order (ord): wide blocks part the page into runs; a run is read column by column."""
    wide = F.col("width") > page_width * 0.6
    down = Window.partitionBy("doc_id", "page").orderBy("y", "x", "block")
    run = blocks.withColumn("_wide", wide.cast("int")).withColumn("_run", F.sum("_wide").over(down) * 2 - F.col("_wide"))
    col = F.when(F.col("_wide") == 1, 0).otherwise(F.floor(F.col("x") / (page_width * COLUMN_SLACK)))
    order = Window.partitionBy("doc_id", "page").orderBy("_run", "_col", "y", "x", "block")
    return run.withColumn("_col", col).withColumn("ord", F.row_number().over(order) - 1).drop("_wide", "_run", "_col")


def _gaps(spans: DataFrame) -> DataFrame:
    """Neighbours of a row: the gap between them, the smaller font, the row's left and right end, and both texts."""
    row = Window.partitionBy("doc_id", "page", "line")
    order = row.orderBy("x", "word")
    font = F.when(F.col("font_size") > 0, F.col("font_size")).otherwise(FONT)
    end = F.col("x") + F.col("width")
    return spans.withColumns({
        "_end": F.lag(end).over(order), "_left": F.min("x").over(row), "_right": F.max(end).over(row), "_font": F.least(font, F.lag(font).over(order)), "_before": F.lag("text").over(order),
        "_numbers": F.sum(table_number(F.col("text")).cast("int")).over(row),
    }).filter("_end is not null").withColumn("_gap", F.col("x") - F.col("_end"))


def _recurring(rows: DataFrame, place: Column, least: int) -> DataFrame:
    binned = rows.withColumn("bin", (F.floor(place / GUTTER_BIN + 0.5) * GUTTER_BIN).cast("long"))
    return binned.groupBy("doc_id", "page", "bin").agg(F.countDistinct("line").alias("rows")).filter(F.col("rows") >= least)


def table_number(text: Column) -> Column:
    """A cell of a number column: a number, or a dash in its place."""
    return (F.trim(text) == "-") | T.numeric_cell(text)


def recurring_gutters(spans: DataFrame, page_width: float) -> DataFrame:
    """doc_id, page, bin, rows: middles of gaps that part rows of most of the page's width into two sides, on three rows or more."""
    sides = (F.col("_end") - F.col("_left") >= 0.25 * page_width) & (F.col("_right") - F.col("x") >= 0.25 * page_width)
    wide = (F.col("_right") - F.col("_left") >= 0.6 * page_width) & (F.col("_gap") >= F.greatest(1.05 * F.col("_font"), F.lit(GUTTER_GAP)))
    return _recurring(_gaps(spans).filter(wide & sides), F.col("_end") + F.col("_gap") / 2, 3)


def recurring_panels(spans: DataFrame, page_width: float) -> DataFrame:
    """doc_id, page, bin, rows: where the right part of wide rows begins after a gap, past 58 % of the page, on two rows or more."""
    wide = (F.col("_right") - F.col("_left") >= 0.6 * page_width) & (F.col("_gap") >= F.greatest(0.9 * F.col("_font"), F.lit(GUTTER_GAP)))
    aside = (F.col("x") >= 0.58 * page_width) & (F.col("_end") - F.col("_left") >= 0.4 * page_width)
    return _recurring(_gaps(spans).filter(wide & aside), F.col("x"), 2)


def table_gutters(spans: DataFrame, page_width: float) -> DataFrame:
    """doc_id, page, bin, rows: middles of gaps between numbers, in rows of three or more, on four rows or more."""
    able = (F.col("_numbers") >= 3) & table_number(F.col("text")) & table_number(F.col("_before")) & (F.col("_right") - F.col("_left") >= min(0.4 * page_width, 96.0))
    return _recurring(_gaps(spans).filter(able & (F.col("_gap") >= F.greatest(1.05 * F.col("_font"), F.lit(GUTTER_GAP)))), F.col("_end") + F.col("_gap") / 2, 4)


def table_rows(spans: DataFrame, cells: int = 3, numeric: int = 2) -> DataFrame:
    """Rows with at least so many cells, so many of them numeric: doc_id, page, line, cells, numeric."""
    rows = spans.groupBy("doc_id", "page", "line").agg(F.count(F.lit(1)).alias("cells"), F.sum(T.numeric_cell(F.col("text")).cast("int")).alias("numeric"))
    return rows.filter((F.col("cells") >= cells) & (F.col("numeric") >= numeric))


def numeric_rows(spans: DataFrame) -> DataFrame:
    """Rows of nothing but numbers and currency signs, two numbers or more: doc_id, page, line."""
    number, sign = T.numeric_cell(F.col("text")), T.currency_only(F.col("text"))
    rows = spans.groupBy("doc_id", "page", "line").agg(F.sum(number.cast("int")).alias("n"), F.bool_and(number | sign).alias("all"))
    return rows.filter("n >= 2 and all").select("doc_id", "page", "line")


def places(values: Column, apart: float) -> Column:
    """How many places values (an array) take when those within ``apart`` of a place's first are at it."""
    start = F.struct(F.lit(0).alias("n"), F.lit(-1e12).alias("at"))
    return F.aggregate(F.sort_array(values), start, lambda a, v: F.when(v - a["at"] > apart, F.struct((a["n"] + 1).alias("n"), v.alias("at"))).otherwise(a), lambda a: a["n"])


def chart_numbers(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Groups of lines (by ``keys``) that are numbers of a drawing rather than a table: keys, grid, fragment, legend.

    grid: 40 numbers, three quarters tiny, on six columns and rows; fragment: eight lines, mostly tiny numbers on three
    columns and two rows; legend: five small numbers on four columns and up to four rows that lie far apart.
    """
    number = T.numeric_cell(F.col("text"))
    tiny = number & (F.col("font_size") <= 6.5) & (F.col("height") <= 6.5) & (F.col("width") <= 10.5)
    small = number & (F.col("font_size") <= 7) & (F.col("height") <= 8)
    at = lambda test, a, b: F.collect_list(F.when(test, F.col(a) + F.col(b) / 2))
    n = lambda test: F.sum(test.cast("int"))
    per = lines.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("lines"), n(number).alias("numbers"), n(tiny).alias("tiny"), n(small).alias("small"), at(tiny, "x", "width").alias("tx"), at(tiny, "y", "height").alias("ty"), at(small, "x", "width").alias("sx"), at(small, "y", "height").alias("sy")
    )
    columns, rows = places(F.col("tx"), 12.0), places(F.col("ty"), 4.0)
    numbers = F.greatest("numbers", F.lit(1))
    grid = (F.col("numbers") >= 40) & (F.col("tiny") / numbers >= 0.75) & (columns >= 6) & (rows >= 6)
    fragment = (F.col("lines") >= 8) & (F.col("numbers") / F.col("lines") >= 0.6) & (F.col("tiny") / numbers >= 0.7) & (columns >= 3) & (rows >= 2)
    sparse = places(F.col("sy"), 4.0)
    far = (sparse >= 2) & ((F.array_max("sy") - F.array_min("sy")) / (sparse - 1) >= 36)
    legend = (F.col("numbers") >= 5) & (F.col("small") / numbers >= 0.75) & (places(F.col("sx"), 12.0) >= 4) & sparse.between(1, 4) & F.coalesce(far, F.lit(False))
    return per.select(*keys, grid.alias("grid"), fragment.alias("fragment"), legend.alias("legend"))


def text_order(items: DataFrame, row: list[str]) -> DataFrame:
    """Items (x, text) with their place in each row: from the right where most that say anything are right-to-left."""
    rtl = T.rtl_dominant(F.col("text"))
    ltr = ~rtl & F.col("text").rlike(r"[A-Za-z\x{C0}-\x{24F}]")
    whole = Window.partitionBy(*row)
    turned = (F.sum(rtl.cast("int")).over(whole) > 0) & (F.sum(rtl.cast("int")).over(whole) >= F.sum(ltr.cast("int")).over(whole))
    rows = items.withColumn("_key", F.when(turned, -F.col("x")).otherwise(F.col("x")))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*row).orderBy("_key", "text")) - 1).drop("_key")


def tables(rows: DataFrame, gap: int = 1) -> DataFrame:
    """Table rows folded into tables: neighbouring lines belong together."""
    order = Window.partitionBy("doc_id", "page").orderBy("line")
    new = F.when(F.coalesce(F.col("line") - F.lag("line").over(order) > gap, F.lit(True)), 1).otherwise(0)
    marked = rows.withColumn("_new", new).withColumn("table", (F.sum("_new").over(order) - 1).cast("int"))
    return marked.groupBy("doc_id", "page", "table").agg(F.min("line").alias("first_line"), F.max("line").alias("last_line"), F.count(F.lit(1)).alias("row_count"), F.max("cells").alias("column_count")).filter("row_count >= 2")


def currency_folded(cells: DataFrame) -> DataFrame:
    """Cells of a row with currency signs put before the number they belong to.

    A lone sign before a number, and a sign at a number's end when another number follows, go to that one.
    """
    order = Window.partitionBy("doc_id", "page", "line").orderBy("word")
    text = F.trim("text")
    sign, last = T.currency_only(text), F.right(text, F.lit(1))
    rest = F.rtrim(F.expr("substring(trim(text), 1, length(trim(text)) - 1)"))
    trailing = F.contains(F.lit(T.CURRENCY), last) & (F.length(text) > 1) & T.numeric_cell(rest)
    follows = F.coalesce(F.lead(T.numeric_cell(F.col("text"))).over(order), F.lit(False))
    rows = cells.withColumns({"_moves": F.when(follows & (sign | trailing), last), "_rest": F.when(trailing & follows, rest).otherwise(text), "_gone": sign & follows})
    said = F.concat(F.coalesce(F.concat(F.lag("_moves").over(order), F.lit(" ")), F.lit("")), "_rest")
    return rows.withColumn("text", said).filter(~F.col("_gone")).drop("_moves", "_rest", "_gone")
