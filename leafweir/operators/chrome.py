"""Repeated page chrome: what stands at one height at the edge of many of a document's pages.

Only blocks in a band along the top and bottom edge, and single lines in a narrower one, are looked at,
so body text that recurs is never chrome. Their texts are keys; labels that count pages have a second
key without their digits. A key that stands at one height (to 5 points) on at least two and half of the
pages marks its blocks; a line's key marks that line, and a block is cut where its lines differ.

blocks: doc_id, page, block, text, the box, lines (array of line, text, x, y, width, height, font_size).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as G
from ..functions import text as T

# fixed values: bands (least points, share of the page), bin and sizes
BIN = 5.0
BLOCK_BAND, LINE_BAND = (60.0, 0.1), (24.0, 0.04)
LINE_CHARS, LINE_SHARE, LABEL_CHARS = 20, 0.2, 80
COUNTERS = ("page", "slide", "lecture")
CONTROLS = ("yes", "no", "stop")
PAGE_NUMBER = "#page-number"
EDGE_BAND, EDGE_WIDTH, EDGE_HEIGHT, EDGE_CHARS, MARKER_CHARS, MARKER_SIZE = (36.0, 0.08), 0.05, 0.1, 12, 3, 0.05
MARKER_AWAY, MARKER_ASIDE = 80.0, 24.0


def counts_pages(text: Column, width: Column, page_width: float) -> Column:
    """Short text that names its page: a bare number, or one that begins with (or, if narrow, holds) a word for pages."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), lambda w: w != "")
    named = F.arrays_overlap(words, F.array(*map(F.lit, COUNTERS))) | F.lower(text).rlike(r"(?<![\p{L}\p{N}_])p\.[\p{L}\p{N}_]")
    first = F.get(words, F.lit(0)).isin(*COUNTERS) & F.lower(F.substring(text, 1, 1)).isin(*{c[0] for c in COUNTERS}) | F.lower(text).rlike(r"^p\.[\p{L}\p{N}_]")
    bare = (F.length(text) <= 12) & (F.length(T.without(text, r"[\p{N}\s.\-]")) == 0)
    return (F.length(text).between(1, LABEL_CHARS)) & F.coalesce((bare & (width <= 0.12 * page_width)) | first | (named & (width <= 0.25 * page_width)), F.lit(False))


def without_digits(text: Column) -> Column:
    """The text with each number as one mark; null where it has none, or too few letters to be known by."""
    compact = T.without(text, r"\s")
    spaced_number = (compact != text) & F.length(compact).between(2, 4) & (F.length(T.without(compact, r"\p{N}")) == 0)
    said = T.count(text, r"\p{N}") > 0
    return F.when(spaced_number, PAGE_NUMBER).when(said & (T.letters(text) >= 4), F.regexp_replace(text, r"\p{N}+", "#"))


def _band(y: Column, height: Column, page_height: float, band: tuple[float, float]) -> Column:
    deep = max(band[0], band[1] * page_height)
    return (y <= deep) | (y + height >= page_height - deep)


def _keys(text: Column, label: Column) -> Column:
    plain = F.when(F.length(text) > 0, text)
    return F.array_distinct(F.filter(F.array(plain, F.when(label, without_digits(text))), lambda k: k.isNotNull()))


def candidates(blocks: DataFrame, page_width: float, page_height: float) -> DataFrame:
    """doc_id, page, block, line (null: the whole block), bin, key: every key of what stands in a band, in one pass over the blocks."""
    control = F.lower(F.regexp_replace(T.collapsed(F.col("text")), r"\.$", "")).isin(*CONTROLS)
    own = blocks.filter(_band(F.col("y"), F.col("height"), page_height, BLOCK_BAND) & ~control)

    def keyed(line: Column, y: Column, text: Column, width: Column, least: bool) -> Column:
        def told(t: Column) -> Column:
            label = counts_pages(t, width, page_width)
            worth = ((F.length(t) >= LINE_CHARS) | (width >= LINE_SHARE * page_width) | label) if least else F.lit(True)
            bin_ = (F.floor(y / BIN + 0.5) * BIN).cast("long")
            return F.when(worth, F.transform(_keys(t, label), lambda k: F.struct(line.alias("line"), k.alias("key"), bin_.alias("bin"))))

        return T.once(T.collapsed(text), told)

    whole = keyed(F.lit(None).cast("int"), F.col("y"), F.col("text"), F.col("width"), False)
    low = F.filter("lines", lambda l: _band(l["y"], l["height"], page_height, LINE_BAND))
    single = F.transform(low, lambda l: keyed(l["line"].cast("int"), l["y"], l["text"], l["width"], True))
    every = F.flatten(F.filter(F.concat(F.array(whole), single), lambda k: k.isNotNull()))
    return own.select("doc_id", "page", "block", F.inline(every))


def _counted(found: DataFrame) -> DataFrame:
    """Candidates with whole, and on how many pages of the document their key stands at their height."""
    rows = found.withColumn("whole", F.col("line").isNull())
    return rows.withColumn("on_pages", F.size(F.collect_set("page").over(Window.partitionBy("doc_id", "whole", "bin", "key"))).cast("long")).filter("on_pages >= 2")


def _recurring(found: DataFrame, blocks: DataFrame) -> DataFrame:
    total = blocks.groupBy("doc_id").agg(F.countDistinct("page").alias("total"))
    return _counted(found).join(total, "doc_id").filter(F.col("on_pages") >= F.ceil(F.col("total") / 2)).drop("total")


def repeated_keys(blocks: DataFrame, page_width: float, page_height: float) -> DataFrame:
    """doc_id, whole (a block's key, else a line's), bin, key, on_pages: keys on at least max(2, half) of the pages."""
    return _recurring(candidates(blocks, page_width, page_height), blocks).select("doc_id", "whole", "bin", "key", "on_pages").distinct()


def mark_repeated(blocks: DataFrame, page_width: float, page_height: float) -> DataFrame:
    """Blocks with ``repeated``; a block of which only some lines are is cut, and the page's blocks numbered anew."""
    hit = _recurring(candidates(blocks, page_width, page_height), blocks)
    of_block = hit.groupBy("doc_id", "page", "block").agg(F.max("whole").alias("whole"), F.collect_set("line").alias("some"))
    # one row a page, so that blocks are dealt out by page, once, and numbered where they lie
    flags = of_block.groupBy("doc_id", "page").agg(F.map_from_entries(F.collect_list(F.struct("block", F.struct("whole", "some")))).alias("_hit"))
    rows = blocks.join(flags, ["doc_id", "page"], "left").withColumn("_own", F.try_element_at("_hit", F.col("block")))
    rows = rows.withColumns({"_whole": F.coalesce(F.col("_own.whole"), F.lit(False)), "_some": F.coalesce(F.col("_own.some"), F.array().cast("array<int>"))}).drop("_hit", "_own")
    is_some = lambda l: F.array_contains("_some", l["line"])
    rows = rows.withColumn("repeated", F.col("_whole") | ((F.size("lines") > 0) & F.forall("lines", is_some)))
    rows = rows.withColumn("_cut", ~F.col("repeated") & (F.size("_some") > 0))
    # runs of lines that are (not) repeated: each begins where the mark changes
    change = F.filter(F.transform("lines", lambda l, i: F.when((i == 0) | (is_some(l) != is_some(F.get("lines", F.greatest(i - 1, F.lit(0))))), i)), lambda i: i.isNotNull())
    runs = T.once(change, lambda at: F.transform(at, lambda a, k: F.slice("lines", a + 1, F.coalesce(F.get(at, k + 1), F.size("lines")) - a)))
    low, high = (lambda ls, c: F.array_min(F.transform(ls, c))), (lambda ls, c: F.array_max(F.transform(ls, c)))

    def again(ls: Column) -> Column:
        x, y = low(ls, lambda l: l["x"]), low(ls, lambda l: l["y"])
        return F.struct(
            F.array_join(F.transform(ls, lambda l: l["text"]), "\n").alias("text"), F.size(ls).cast("long").alias("n_lines"), high(ls, lambda l: l["font_size"]).alias("font_size"), G.half_up(x).alias("x"), G.half_up(y).alias("y"),
            G.half_up(high(ls, lambda l: l["x"] + l["width"]) - x).alias("width"), G.half_up(high(ls, lambda l: l["y"] + l["height"]) - y).alias("height"), ls.alias("lines"), is_some(F.get(ls, F.lit(0))).alias("repeated"),
        )

    made = ["text", "n_lines", "font_size", "x", "y", "width", "height", "lines", "repeated"]
    plain = F.struct(*made)
    parts = F.when(F.col("_cut"), F.transform(runs, again)).otherwise(F.array(plain))
    own = [c for c in blocks.columns if c not in made]
    cut = rows.select(*own, F.posexplode(parts).alias("_part", "_p")).select(*own, "_part", *[F.col(f"_p.{c}").alias(c) for c in made])
    number = F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("block", "_part")) - 1
    both = cut.withColumn("block", number.cast("int")).select("doc_id", "page", "block", *[c for c in blocks.columns if c not in ("doc_id", "page", "block")], "repeated")
    if "level" in blocks.columns:  # chrome is no heading
        both = both.withColumn("level", F.when(~F.col("repeated"), F.col("level")))
    return both


def mark_page_edges(blocks: DataFrame, page_width: float, page_height: float) -> DataFrame:
    """Blocks marked (column ``repeated``, kept where it was set) that are chapter marks down a side of the page.

    A vertical run along a side whose text stands on a second page, and numbers or chapter signs right
    beside such a run; in a document of one page only what reads as a chapter sign. blocks also have writing_mode.
    """
    deep = max(EDGE_BAND[0], EDGE_BAND[1] * page_width)
    right = page_width - (F.col("x") + F.col("width"))
    aside = (F.col("x") <= deep) | (right <= deep)
    key = T.without(F.translate(F.col("text"), "".join(map(chr, range(0xFF10, 0xFF1A))), "0123456789"), r"[\s\x{3000}]")
    rows = blocks.withColumns({"_key": key, "_side": F.when(F.col("x") <= right, "left").otherwise("right"), "_aside": aside, "_cx": F.col("x") + F.col("width") / 2, "_cy": F.col("y") + F.col("height") / 2})
    sign = F.translate(F.col("_key"), "第章編部", "")
    reads = F.col("_key").isin(*"第章編部") | ((F.length(T.without(sign, r"\p{N}")) == 0) & (F.length(sign) > 0) & (F.length(F.col("_key")) - F.length(sign) <= 2) & F.col("_key").rlike(r"^第?\p{N}+[章編部]?$"))
    anchor = F.col("_aside") & (F.col("writing_mode") == "vertical") & (F.col("width") <= EDGE_WIDTH * page_width) & (F.col("height") >= EDGE_HEIGHT * page_height)
    rows = rows.withColumns({"_anchor": F.coalesce(anchor, F.lit(False)), "_reads": reads})
    chrome = F.col("_anchor") & F.length("_key").between(1, EDGE_CHARS) & ~F.col("_key").rlike("[。、]")
    a = rows.filter("_anchor").select(F.col("doc_id").alias("ad"), F.col("page").alias("ap"), F.col("_side").alias("a_side"), F.col("_cx").alias("a_cx"), F.col("y").alias("ay"), (F.col("y") + F.col("height")).alias("ab"))
    small = F.col("_aside") & F.col("_reads") & F.length("_key").between(1, MARKER_CHARS) & (F.col("height") <= MARKER_SIZE * page_height) & (F.col("width") <= MARKER_SIZE * page_width)
    beside = (F.col("doc_id") == F.col("ad")) & (F.col("page") == F.col("ap")) & (F.col("_side") == F.col("a_side")) & (F.abs(F.col("_cx") - F.col("a_cx")) <= MARKER_ASIDE) & (F.col("_cy") >= F.col("ay") - MARKER_AWAY) & (F.col("_cy") <= F.col("ab") + MARKER_AWAY)
    ref = lambda df, kind: df.select("doc_id", "page", "block", F.col("_key").alias("key"), F.col("_reads").alias("reads"), F.lit(kind).alias("kind"))
    refs = ref(rows.filter(chrome), "run").unionByName(ref(rows.filter(small).join(a, beside, "left_semi"), "marker"))
    total = blocks.groupBy("doc_id").agg(F.countDistinct("page").alias("total"))
    on = refs.groupBy("doc_id", "kind", "key").agg(F.countDistinct("page").alias("on_pages"))
    told = refs.join(on, ["doc_id", "kind", "key"]).join(total, "doc_id")
    one = (F.col("total") == 1) & ((F.col("kind") == "marker") | (F.col("reads") & (F.length("key") <= 6)))
    hit = told.filter(one | ((F.col("total") > 1) & (F.col("on_pages") >= 2))).select("doc_id", "page", "block").distinct().withColumn("_hit", F.lit(True))
    before = F.col("repeated") if "repeated" in blocks.columns else F.lit(False)
    return blocks.join(hit, ["doc_id", "page", "block"], "left").withColumn("repeated", before | F.coalesce("_hit", F.lit(False))).drop("_hit")


def body_text(marked: DataFrame) -> DataFrame:
    """doc_id, page, body: page text without repeated blocks."""
    kept = F.when(~F.col("repeated"), F.struct("block", "text"))
    return marked.groupBy("doc_id", "page").agg(F.array_join(F.transform(F.sort_array(F.collect_list(kept)), lambda s: s["text"]), "\n").alias("body"))


def body_near_chrome(marked: DataFrame, gap: float = 6.0) -> DataFrame:
    """Body blocks that a repeated block overlaps, or else follows at less than ``gap``: the worst one of each."""
    # the page's chrome comes to its blocks by a window: the marks are worked out once
    chrome = F.collect_list(F.when(F.col("repeated"), F.struct(F.col("block").alias("chrome"), F.col("x").alias("cx"), F.col("y").alias("cy"), F.col("width").alias("cw"), F.col("height").alias("ch")))).over(Window.partitionBy("doc_id", "page"))
    light = marked.select("doc_id", "page", "block", "repeated", "x", "y", "width", "height").withColumn("_chrome", chrome)
    pair = light.filter(~F.col("repeated")).select("doc_id", "page", "block", "x", "y", "width", "height", F.inline("_chrome"))
    pair = pair.filter((F.col("cy") + F.col("ch") > F.col("y")) & (F.least(F.col("x") + F.col("width"), F.col("cx") + F.col("cw")) > F.greatest("x", "cx")))
    depth = F.least(F.col("y") + F.col("height"), F.col("cy") + F.col("ch")) - F.greatest("y", "cy")
    below = F.col("cy") - (F.col("y") + F.col("height"))
    pair = pair.withColumns({"depth": depth, "gap": below}).filter((F.col("depth") > 0) | F.col("gap").between(0, gap) & (F.col("gap") < gap))
    worst = F.min(F.when(F.col("depth") > 0, F.struct((-F.col("depth")).alias("rank"), "chrome", "depth"))).alias("over")
    near = F.min(F.when(F.col("depth") <= 0, F.struct(F.col("gap").alias("rank"), "chrome", "gap"))).alias("near")
    found = pair.groupBy("doc_id", "page", "block").agg(worst, near)
    return found.select("doc_id", "page", "block", F.coalesce("over.chrome", "near.chrome").alias("other_block"), F.col("over.depth").alias("overlap"), F.when(F.col("over").isNull(), F.col("near.gap")).alias("gap"))
