"""Text overlap: pairs of a page's blocks whose lines collide, less those that are one text, a mark or a formula by design.

What a block's (and each of its lines') words are is told once for each block, before blocks meet. Pairs
come from a join on the page with intersecting boxes as residual; tests on a pair combine what is known of
its two blocks, structs with box, lines, vertical and these marks:

n letters without blanks; formula (stands in a context of formulas), signs and strong (signs of mathematics),
piece (letters, a short label or mostly symbols), prose (prose or formulas), dotted, mark (1-3 signs of
punctuation), wordless (1-3 characters, no letter), number, letters (letters and digits alone).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as G
from ..functions import predicates as P
from ..functions import text as T

# fixed values
DEPTH = 0.5
MOST = 8
FRAGMENT_CHARS, MARK_CHARS, FRAGMENT_WIDTH, FRAGMENT_HEIGHT, WIDER = 12, 3, 40.0, 12.0, 4
NOTE_LINES, NOTE_HEIGHT, NOTE_SHARE, NOTE_CHARS, NOTE_LINE_CHARS, NOTE_SLACK, PROSE_CHARS, NOTE_EDGE = 2, 16.0, 0.85, 80, 24, 6.0, 45, 0.2
NUMBER_HEIGHT, LABEL_HEIGHT, LABEL_CHARS, LABEL_ZONE = 24.0, 18.0, 40, 0.35
ICON_SIZE = 36.0
SAME_CHARS, SAME_VERTICAL, SAME_LONG, SAME_GRAMS, SAME_AREA = 3, 4, 8, 0.72, 0.6
FIGURE_LEAST, FIGURE_MOST, FIGURE_HOLDS = 0.015, 0.45, 0.8
STRONG_MATH = "±=+-−×÷∫√∞≤≥<>|_^{}∑∏∂∆∇∈∉∪∩⊂⊃⊆⊇≈≠≡∝∀∃∥‖′″"
WEAK_MATH = "()[]"
NUMBER_SIGNS = ",，.．:：%％+-−–—/／()（）※年月日現末在"
TOPICS = ("attention", "dimension", "head", "key", "matrix", "matrices", "model", "parameter", "projection", "query", "queries", "value", "vector")
BULLETS, HYPHENS = "!•▲▶►▸", "-‐‑–"


def _compact(text: Column) -> Column:
    return T.without(text, r"\s+")


def _any(*tests: Column) -> Column:
    return reduce(lambda a, b: a | b, tests)


def _either(test, a: Column, b: Column) -> Column:
    return test(a, b) | test(b, a)


def _depth(a: Column, b: Column) -> Column:
    """Vertical overlap over the lower height."""
    return G.y_overlap(a, b) / F.greatest(F.least(a["height"], b["height"]), F.lit(0.001))


def _meets(a: Column, b: Column) -> Column:
    return (G.x_overlap(a, b) > 0) & (G.y_overlap(a, b) > 0)


def _sits_on(box: Column, block: Column, centred: bool, slack: float = 0.0) -> Column:
    """The box stands in one of the block's lines (and, unless it may be, not at that line's middle)."""
    cx, cy = box["x"] + box["width"] / 2, box["y"] + box["height"] / 2

    def on(l: Column) -> Column:  # noqa: E741
        at = (cx >= l["x"] - slack) & (cx <= G.right(l) + slack) & _meets(box, l) & (_depth(box, l) >= DEPTH)
        return at if centred else at & (F.abs(cy - (l["y"] + l["height"] / 2)) >= 0.12 * l["height"])

    return F.exists(block["lines"], on)


def _first_line(block: Column) -> Column:
    return F.get(block["lines"], F.lit(0))


# -- formulas --------------------------------------------------------------------------------------


def _signs(text: Column, signs: str) -> Column:
    return (F.length(F.translate(text, signs, "")) < F.length(text)) | text.rlike(r"[\x{370}-\x{3FF}]")


def _letters(text: Column, least: int) -> Column:
    """The words, all single Latin letters, at least so many of them."""
    words = F.filter(F.split(F.translate(text, ".,;:·…", "      "), r"\s+"), lambda w: w != "")
    return (F.size(words) >= least) & F.forall(words, lambda w: w.rlike("^[A-Za-z]$"))


def formula_context(text: Column) -> Column:
    """Signs of mathematics, two capitals as a pair, a list of letters, or letters listed where a model is described."""
    words = F.split(F.lower(T.collapsed(text)), r"[^a-z0-9]+")
    topic = F.exists(words, lambda w: w.isin(*TOPICS, *[t + "s" for t in TOPICS]))
    listed = T.collapsed(text).rlike(r"(?:^|[\s(])[A-Za-z]\s*(?:[,;]|(?:and|or)\b)\s*(?:[A-Za-z]\s*(?:[,;]|(?:and|or)\b)\s*)*[A-Za-z](?:[\s).,;]|$)")
    pair = text.rlike(r"\b[A-Z]\s*(?:,|and)\s*[A-Z]\b")
    return _any(_signs(text, STRONG_MATH + WEAK_MATH), pair, topic & listed, _letters(text, 2))


def told(text: Column) -> dict[str, Column]:
    """What is known of a block's words."""
    compact, plain = _compact(text), T.collapsed(text)
    words, n = F.split(F.trim(text), r"\s+"), F.length(compact)
    label = (F.size(words) <= 8) & (n <= NOTE_LINE_CHARS) & F.forall(words, lambda w: w.rlike("^[A-Za-z0-9]+$"))
    dense = n.between(1, 12) & (T.count(compact, r"\P{Alnum}") / F.greatest(n, F.lit(1)) >= 0.5)
    alone = F.forall(words, lambda w: w.rlike("^[A-Za-z]$"))
    number = (T.count(text, "[0-9０-９]") >= 2) & (F.length(T.without(F.translate(F.trim(text), NUMBER_SIGNS, ""), r"[0-9０-９\s]")) == 0)
    return {
        "n": n, "formula": formula_context(text), "signs": _signs(compact, STRONG_MATH + WEAK_MATH), "strong": _signs(compact, STRONG_MATH), "piece": alone | label | dense,
        "prose": (F.length(plain) >= PROSE_CHARS) & plain.rlike(r"\p{L}{3,}\s+\p{L}{3,}"), "dotted": P.dotted_texture(text), "mark": n.between(1, MARK_CHARS) & (F.length(T.without(compact, r"[\p{P}\p{S}]")) == 0),
        "wordless": n.between(1, MARK_CHARS) & (F.length(T.without(compact, r"[\p{L}\p{N}]")) == n), "number": number, "letters": T.without(text, r"[^\p{L}\p{N}]"),
    }


def formula_like(own: Column, beside: Column) -> Column:
    """A formula's piece: strong signs, or signs or pieces beside something that is one."""
    return own["strong"] | ((own["signs"] | own["piece"]) & beside["formula"])


def formula_note(note: Column, block: Column) -> Column:
    """A block of up to two small lines of a formula that sit on the other's lines."""
    count = F.size(note["lines"])
    shape = count.between(1, NOTE_LINES) & (F.size(block["lines"]) > 0) & note["n"].between(1, NOTE_CHARS) & ((count == 1) | (note["height"] <= NOTE_HEIGHT)) & (note["height"] <= NOTE_SHARE * block["height"])
    return shape & formula_like(note, block) & ((count == 1) | block["prose"] | block["formula"]) & F.forall(note["lines"], lambda l: _sits_on(l, block, True, NOTE_SLACK))


def _note_line(line: Column, other: Column, own: Column, block: Column) -> Column:
    """A formula's line that stands at, or hardly reaches into, a line of the other block."""
    shape = line["n"].between(1, NOTE_LINE_CHARS) & (line["height"] <= FRAGMENT_HEIGHT)
    known = formula_like(own, block) & (block["prose"] | block["formula"] | other["formula"])
    cx = line["x"] + line["width"] / 2
    at = (cx >= other["x"] - NOTE_SLACK) & (cx <= G.right(other) + NOTE_SLACK)
    hardly = G.x_overlap(line, other) / F.greatest(F.least(line["width"], other["width"]), F.lit(0.001)) <= NOTE_EDGE
    return shape & (_depth(line, other) >= DEPTH) & (at | hardly) & known


# -- marks and fragments ---------------------------------------------------------------------------


def _mark_box(box: Column, beside: Column) -> Column:
    return box["mark"] & (box["width"] <= FRAGMENT_WIDTH) & (box["height"] <= FRAGMENT_HEIGHT) & (beside["width"] >= WIDER * box["width"])


def inline_mark(mark: Column, block: Column) -> Column:
    return (F.size(mark["lines"]) <= 1) & _mark_box(mark, block) & _sits_on(_first_line(mark), block, True)


def inline_fragment(part: Column, block: Column) -> Column:
    """A few letters set above or below the middle of one of the other's lines."""
    small = part["n"].between(1, FRAGMENT_CHARS) & (F.size(part["lines"]) <= 1) & (part["width"] <= FRAGMENT_WIDTH) & (part["height"] <= FRAGMENT_HEIGHT)
    return small & (block["width"] >= WIDER * part["width"]) & _sits_on(_first_line(part), block, False)


def icon_mark(mark: Column, block: Column) -> Column:
    """A bullet or icon right before the other's first line."""
    line = _first_line(block)
    small = mark["wordless"] & (F.size(mark["lines"]) == 1) & (F.greatest(mark["width"], mark["height"]) <= ICON_SIZE) & (block["width"] >= WIDER * mark["width"])
    level = G.y_overlap(_first_line(mark), line) / F.greatest(F.least(mark["height"], line["height"]), F.lit(0.001)) >= DEPTH
    return F.coalesce(small & level & (F.abs(line["x"] - G.right(mark)) <= 0.75 * mark["width"]), F.lit(False))


def number_label(label: Column, value: Column) -> Column:
    """A short label in the top of a large number's box."""
    small = label["n"].between(1, LABEL_CHARS) & (F.size(label["lines"]) == 1) & (label["height"] <= LABEL_HEIGHT)
    shown = (F.size(value["lines"]) == 1) & (value["height"] >= NUMBER_HEIGHT) & value["number"]
    cy = label["y"] + label["height"] / 2
    zone = F.greatest(value["height"] * LABEL_ZONE, _first_line(value)["font_size"] * 0.8)
    return F.coalesce(small & shown & (G.x_overlap(label, value) > 0) & (cy >= value["y"] - 2) & (cy <= value["y"] + zone), F.lit(False))


# -- one text --------------------------------------------------------------------------------------


def line_continues(a: Column, b: Column) -> Column:
    """The lower block goes on below the upper's last line, whose box is only high for what stands in it."""

    def below(upper: Column, lower: Column) -> Column:
        u, l = F.get(upper["lines"], F.size(upper["lines"]) - 1), _first_line(lower)  # noqa: E741
        down = l["y"] - u["y"]
        near = (down > 0) & (down <= 1.4 * F.greatest(u["font_size"], l["font_size"])) & (l["y"] < G.bottom(u))
        indent = (l["x"] >= u["x"] - 2) & (l["x"] - u["x"] <= F.greatest(F.lit(42.0), 4 * u["font_size"])) & (G.x_overlap(u, l) > 0)
        said = F.trim(u["text"])
        high = (u["height"] > 1.35 * u["font_size"]) | (l["height"] > 1.35 * l["font_size"])
        opened = F.contains(F.lit(BULLETS), F.substring(said, 1, 1)) & F.substring(said, 2, 1).rlike(r"\s")
        cut = F.contains(F.lit(HYPHENS), F.right(said, F.lit(1))) & (F.length(said) > 0)
        return F.coalesce(near & indent & (high | opened | cut), F.lit(False))

    return F.when(a["y"] <= b["y"], below(a, b)).otherwise(below(b, a))


def _grams(text: Column, n: int = 3) -> Column:
    size = F.least(F.length(text), F.lit(n))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - size + 1)), lambda i: F.substr(text, i, size)))


def extracted_twice(a: Column, b: Column) -> Column:
    """Boxes over one another whose letters are alike, or contain one another, or share most three-letter strings."""
    area = G.overlap_area(a, b) / F.greatest(F.least(G.area(a), G.area(b)), F.lit(0.001))

    def alike(short: Column, long: Column) -> Column:
        n = F.length(short)
        within = F.contains(long, short)
        column = (n >= SAME_VERTICAL) & (a["vertical"] | b["vertical"]) & (T.count(short, T.CJK) / F.greatest(n, F.lit(1)) >= 0.6) & within
        own = _grams(short)
        share = F.size(F.array_intersect(own, _grams(long))) / F.size(own)
        return ((short == long) & (n >= SAME_CHARS)) | column | ((n >= SAME_LONG) & (within | (share >= SAME_GRAMS)))

    first = F.length(a["letters"]) <= F.length(b["letters"])
    # words are only compared where boxes are all but one
    return F.when(area >= SAME_AREA, F.when(first, alike(a["letters"], b["letters"])).otherwise(alike(b["letters"], a["letters"]))).otherwise(F.lit(False))


def suppressed(a: Column, b: Column) -> Column:
    return _any(
        a["vertical"] & b["vertical"], a["dotted"], b["dotted"], line_continues(a, b), _either(inline_fragment, a, b), _either(inline_mark, a, b), _either(formula_note, a, b),
        _either(number_label, a, b), _either(icon_mark, a, b), extracted_twice(a, b),
    )


def shared_area(a: Column, b: Column) -> Column:
    """Sum over pairs of lines that overlap by half of their height, less marks and formula notes."""
    # tests on words only where lines overlap at all
    part = lambda l, m: F.when((_depth(l, m) >= DEPTH) & (G.overlap_area(l, m) > 0), F.when(_either(_mark_box, l, m) | _note_line(l, m, a, b) | _note_line(m, l, b, a), 0.0).otherwise(G.overlap_area(l, m))).otherwise(0.0)
    return F.aggregate(a["lines"], F.lit(0.0), lambda s, l: s + F.aggregate(b["lines"], F.lit(0.0), lambda t, m: t + part(l, m)))


def pairs(blocks: DataFrame, images: DataFrame | None = None, page_area: float = 0.0) -> DataFrame:
    """doc_id, page, block, other_block, area of every pair of unrepeated blocks that collide.

    Pairs that both lie in one raster figure (1.5 to 45 % of the page) are left out, given images.
    """
    body = blocks.filter(~F.col("repeated")) if "repeated" in blocks.columns else blocks
    vertical = F.coalesce(F.col("writing_mode") == "vertical", F.lit(False)) if "writing_mode" in blocks.columns else F.lit(False)
    box = ("x", "y", "width", "height")

    def known(l: Column) -> Column:
        said = told(l["text"])
        return F.struct(*[l[c].alias(c) for c in (*box, "text", "font_size")], *[said[c].alias(c) for c in ("n", "formula", "mark")])

    # which boxes meet is asked first: words are only read where some do
    light = body.select("doc_id", "page", F.struct("block", *box).alias("s"))
    keys = ["doc_id", "page"]
    pair = light.withColumnRenamed("s", "a").join(light.withColumnRenamed("s", "b"), keys).filter((F.col("a.block") < F.col("b.block")) & _meets(F.col("a"), F.col("b")))
    pair = pair.select(*keys, F.col("a.block").alias("ba"), F.col("b.block").alias("bb"))
    # one row a page, so that blocks with their words are not dealt out by number
    some = pair.groupBy(*keys).agg(F.array_union(F.collect_set("ba"), F.collect_set("bb")).alias("_some"))
    # a block without lines is one itself
    whole = F.array(F.struct("text", *box, F.col("height").alias("font_size")))
    plain = F.transform("lines", lambda l: F.struct(*[l[c].alias(c) for c in ("text", *box, "font_size")]))
    rows = body.join(some, keys).filter(F.array_contains("_some", F.col("block"))).drop("_some").withColumn("_lines", F.when(F.size("lines") > 0, plain).otherwise(whole)).withColumns({f"_{k}": v for k, v in told(F.col("text")).items()})
    own = F.struct("block", *box, F.transform("_lines", known).alias("lines"), vertical.alias("vertical"), *[F.col(f"_{k}").alias(k) for k in told(F.col("text"))])
    # a repartition by page keeps what is told before the joins, where it is read for every pair
    rows = rows.select(*keys, "block", own.alias("s")).repartition(*keys)
    a, b = F.col("a"), F.col("b")
    pair = pair.join(rows.select(*keys, F.col("block").alias("ba"), F.col("s").alias("a")), [*keys, "ba"]).join(rows.select(*keys, F.col("block").alias("bb"), F.col("s").alias("b")), [*keys, "bb"])
    if images is not None:
        share = F.col("width") * F.col("height") / page_area
        figure = images.filter(share.between(FIGURE_LEAST, FIGURE_MOST)).select(F.col("doc_id").alias("id_"), F.col("page").alias("ip"), G.box().alias("_i"))
        holds = lambda s: G.overlap_area(s, F.col("_i")) >= FIGURE_HOLDS * G.area(s)
        pair = pair.join(figure, (F.col("doc_id") == F.col("id_")) & (F.col("page") == F.col("ip")) & holds(a) & holds(b) & (G.area(a) > 0) & (G.area(b) > 0), "left_anti")
    kept = pair.filter(~F.coalesce(suppressed(a, b), F.lit(False))).withColumn("area", shared_area(a, b)).filter("area >= 1")
    return kept.select("doc_id", "page", F.col("a.block").alias("block"), F.col("b.block").alias("other_block"), "area")


def largest(found: DataFrame, most: int = MOST) -> DataFrame:
    """The largest ``most`` overlaps of each page with their rank, and how many it has."""
    page = Window.partitionBy("doc_id", "page")
    ranked = found.withColumns({"rank": F.row_number().over(page.orderBy(F.col("area").desc(), "block", "other_block")), "pairs": F.count(F.lit(1)).over(page)})
    return ranked.filter(F.col("rank") <= most).select("doc_id", "page", "block", "other_block", G.half_up(F.col("area")).alias("area"), "rank", "pairs")
