"""Evidence tables: pages, lines, blocks and spans laid out from the supplied tables by fixed rules.

A text's lines are cut after ``COLUMNS`` characters and set 40 to a page of 612 x 792 points, 18 apart
from 36; a character is 6 wide. A short line without end punctuation is set in 18, all else in 12.
Blocks begin at a text line or a page.

A document's pages, lines, blocks and words all come out of its one row: ``page_rows`` has a page's lines
as an array, and ``pages_of``, ``lines_of``, ``blocks_of`` read it, by projection and explode, without a
shuffle. ``pages`` and ``blocks`` build the same from a table of lines, as a parser delivers them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geometry import half_up, union_aggs

PAGE_WIDTH, PAGE_HEIGHT = 612.0, 792.0
COLUMNS, PER_PAGE = 90, 40


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_LINE = ("line", "text", "start", "x", "y", "width", "height", "font_size")


def _cells(text: Column) -> Column:
    """Lines of a text as an array of (text, first: begins a line of the text)."""
    return F.flatten(
        F.transform(
            F.split(F.coalesce(text, F.lit("")), "\n"),
            lambda t: F.transform(
                F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.length(t) / COLUMNS).cast("int") - 1)),
                lambda j: F.struct(F.substring(t, j * COLUMNS + 1, F.lit(COLUMNS)).alias("text"), (j == 0).alias("first")),
            ),
        )
    )


def _line(cell: Column, row: Column) -> list[Column]:
    """The columns of a line that stands in this row of its page."""
    text = cell["text"]
    font = F.when((F.length(text) > 0) & (F.length(text) <= 40) & ~text.rlike("[.!?,;:|]$"), 18.0).otherwise(12.0)
    given = (row.cast("int"), text, cell["first"] | (row == 0), F.lit(36.0), 36.0 + 18.0 * row, 6.0 * F.length(text), font, font)
    return [c.alias(n) for c, n in zip(given, _LINE, strict=True)]


def lines(documents: DataFrame) -> DataFrame:
    """doc_id, source, page, line, text, start, x, y, width, height, font_size; start: begins a block."""
    rows = documents.select("doc_id", "source", F.posexplode(_cells(F.col("text"))).alias("n", "cell"))
    return rows.select("doc_id", "source", (F.floor(F.col("n") / PER_PAGE) + 1).cast("int").alias("page"), *_line(F.col("cell"), F.col("n") % PER_PAGE))


def page_total(text: Column) -> Column:
    """On how many pages a text is set."""
    n = F.aggregate(F.split(F.coalesce(text, F.lit("")), "\n"), F.lit(0).cast("long"), lambda a, t: a + F.greatest(F.lit(1).cast("long"), F.ceil(F.length(t) / COLUMNS)))
    return F.ceil(n / PER_PAGE).cast("int")


def page_keys(documents: DataFrame) -> DataFrame:
    """doc_id, page of every page, without its lines."""
    return documents.select("doc_id", F.explode(F.sequence(F.lit(1), page_total(F.col("text")))).alias("page"))


def page_rows(documents: DataFrame) -> DataFrame:
    """doc_id, source, page, lines: a page's lines in order."""
    cells = documents.select("doc_id", "source", _cells(F.col("text")).alias("cells"))
    paged = F.transform(F.sequence(F.lit(0), F.floor((F.size("cells") - 1) / PER_PAGE).cast("int")), lambda k: F.slice("cells", k * PER_PAGE + 1, F.lit(PER_PAGE)))
    rows = cells.select("doc_id", "source", F.posexplode(paged).alias("k", "own"))
    return rows.select("doc_id", "source", (F.col("k") + 1).alias("page"), F.transform("own", lambda c, i: F.struct(*_line(c, i))).alias("lines"))


def lines_of(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "source", "page", F.inline("lines"))


def pages_of(rows: DataFrame) -> DataFrame:
    """As ``pages``."""
    ink = F.aggregate("lines", F.lit(0.0), lambda a, l: a + l["width"] * l["height"])
    text = F.array_join(F.transform("lines", lambda l: l["text"]), "\n")
    return _sized(rows.select("doc_id", "source", "page", text.alias("text"), ink.alias("ink")))


def blocks_of(rows: DataFrame) -> DataFrame:
    """As ``blocks``."""
    begins = F.filter(F.transform("lines", lambda l, i: F.when(l["start"] | (i == 0), i)), lambda i: i.isNotNull())
    cut = rows.select("doc_id", "source", "page", "lines", begins.alias("at"))
    own = F.transform("at", lambda a, k: F.slice("lines", a + 1, F.coalesce(F.get("at", k + 1), F.size("lines")) - a))
    cut = cut.select("doc_id", "source", "page", F.posexplode(own).alias("block", "own"))
    most = lambda f: F.array_max(F.transform("own", f))
    x, y = F.array_min(F.transform("own", lambda l: l["x"])), F.array_min(F.transform("own", lambda l: l["y"]))
    return cut.select(
        "doc_id", "source", "page", "block", F.array_join(F.transform("own", lambda l: l["text"]), "\n").alias("text"), F.size("own").cast("long").alias("n_lines"), most(lambda l: l["font_size"]).alias("font_size"),
        half_up(x).alias("x"), half_up(y).alias("y"), half_up(most(lambda l: l["x"] + l["width"]) - x).alias("width"), half_up(most(lambda l: l["y"] + l["height"]) - y).alias("height"), F.col("own").alias("lines"),
    )


def blocks(line_rows: DataFrame) -> DataFrame:
    """doc_id, source, page, block, text, n_lines, font_size, the box of each block (from 0 on a page), lines."""
    order = Window.partitionBy("doc_id", "page").orderBy("line")
    numbered = line_rows.withColumn("block", (F.sum(F.col("start").cast("int")).over(order) - 1).cast("int"))
    own = F.sort_array(F.collect_list(F.struct(*_LINE)))
    grouped = numbered.groupBy("doc_id", "source", "page", "block").agg(F.count(F.lit(1)).alias("n_lines"), F.max("font_size").alias("font_size"), *union_aggs(), own.alias("lines"))
    return grouped.select("doc_id", "source", "page", "block", F.array_join(F.transform("lines", lambda l: l["text"]), "\n").alias("text"), "n_lines", "font_size", "x", "y", "width", "height", "lines")


def pages(line_rows: DataFrame) -> DataFrame:
    """doc_id, source, page, text, char_count, text_coverage, width, height."""
    said = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "text"))), lambda s: s["text"]), "\n")
    return _sized(line_rows.groupBy("doc_id", "source", "page").agg(said.alias("text"), F.sum(F.col("width") * F.col("height")).alias("ink")))


def _sized(rows: DataFrame) -> DataFrame:
    coverage = half_up(F.col("ink") / (PAGE_WIDTH * PAGE_HEIGHT), 3).alias("text_coverage")
    return rows.select("doc_id", "source", "page", "text", F.length("text").cast("long").alias("char_count"), coverage, F.lit(PAGE_WIDTH).alias("width"), F.lit(PAGE_HEIGHT).alias("height"))


def spans(line_rows: DataFrame) -> DataFrame:
    """doc_id, page, line, word, text and the box of each space-separated word."""
    rows = line_rows.select("doc_id", "page", "line", "y", "height", "font_size", "text", F.posexplode(F.split("text", " ")).alias("word", "own")).filter(F.length("own") > 0)
    before = F.when(F.col("word") > 0, F.length(F.expr("substring_index(text, ' ', word)")) + 1).otherwise(0)
    return rows.select("doc_id", "page", "line", "word", F.col("own").alias("text"), (36.0 + 6.0 * before).alias("x"), "y", (6.0 * F.length("own")).alias("width"), "height", "font_size")


#: The same rules in SQL, for the checks: CTEs line, block and page.
SQL = """
cut as (select doc_id, source, flatten(list_transform(string_split(coalesce(text, ''), chr(10)), lambda t: list_transform(range(0, greatest(1, cast(ceil(length(t) / 90.0) as bigint))), lambda j: {'text': substr(t, j * 90 + 1, 90), 'first': j = 0}))) as cells from documents),
cell as (select doc_id, source, unnest(cells) as c, generate_subscripts(cells, 1) - 1 as n from cut),
line as (select doc_id, source, cast(n // 40 + 1 as integer) as page, cast(n % 40 as integer) as line, c.text as text, c.first or n % 40 = 0 as start,
  36.0::double as x, (36.0 + 18.0 * (n % 40))::double as y, (6.0 * length(c.text))::double as width,
  (case when length(c.text) between 1 and 40 and not regexp_matches(c.text, '[.!?,;:|]$') then 18.0 else 12.0 end)::double as height, height as font_size from cell),
numbered as (select *, cast(sum(start::int) over (partition by doc_id, page order by line) - 1 as integer) as block from line),
block as (select doc_id, source, page, block, string_agg(text, chr(10) order by line) as text, count(*) as n_lines, max(font_size) as font_size,
  min(x) as x, min(y) as y, max(x + width) - min(x) as width, max(y + height) - min(y) as height from numbered group by all),
page as (select doc_id, source, page, string_agg(text, chr(10) order by line) as text, length(string_agg(text, chr(10) order by line)) as char_count,
  floor(sum(width * height) / (612.0 * 792.0) * 1000 + 0.5) / 1000 as text_coverage from line group by all),
words as (select doc_id, page, line, y, height, font_size, string_split(text, ' ') as w from line),
span as (select * from (select doc_id, page, line, cast(generate_subscripts(w, 1) - 1 as integer) as word, unnest(w) as text, 36.0::double + 6.0::double * unnest(list_transform(range(0, len(w)), lambda i: length(array_to_string(w[1:i], ' ')) + (i > 0)::int)) as x, y, 6.0::double * length(unnest(w)) as width, height, font_size from words) where length(text) > 0)
"""
