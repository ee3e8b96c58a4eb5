"""Links, form fields, annotations and structure: projections and nearest joins within a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as T

# fixed values: annotation flag bits, lowest first
FLAGS = ["invisible", "hidden", "print", "noZoom", "noRotate", "noView", "readOnly", "locked", "toggleNoView", "lockedContents"]


def annotation_kind(subtype: Column) -> Column:
    return F.when(subtype == "Link", "link").when(subtype == "Widget", "field").when(subtype == "Popup", None).otherwise("annotation")


def boxed(rows: DataFrame, page_height: float) -> DataFrame:
    """rect (bottom-left corners) as x, y, width, height; flags as names."""
    b = G.rect_to_box(F.col("rect"), F.lit(page_height))
    out = rows.withColumn("_b", b).select("*", "_b.x", "_b.y", "_b.width", "_b.height").drop("_b", "rect")
    return out.withColumn("flag_names", T.flag_names(F.col("flags"), FLAGS)) if "flags" in rows.columns else out


def link_target(url: Column, dest: Column) -> Column:
    return F.when(url.isNotNull(), F.struct(F.lit("url").alias("type"), url.alias("target"))).when(dest.isNotNull(), F.struct(F.lit("destination").alias("type"), dest.alias("target")))


def link_text(links: DataFrame, lines: DataFrame, slack: float = 2.0, least: float = 0.45) -> DataFrame:
    """Each link with the text of the lines that lie in its box, or overlap it by enough, in order."""
    a = links.withColumn("_a", G.box())
    l = lines.select(F.col("doc_id").alias("ld"), F.col("page").alias("lp"), F.col("line").alias("ll"), F.col("text").alias("said"), G.box().alias("_l"))  # noqa: E741
    inside = (F.col("_l.x") >= F.col("_a.x") - slack) & (G.right(F.col("_l")) <= G.right(F.col("_a")) + slack) & (F.col("_l.y") >= F.col("_a.y") - slack) & (G.bottom(F.col("_l")) <= G.bottom(F.col("_a")) + slack)
    pair = a.join(l, (F.col("doc_id") == F.col("ld")) & (F.col("page") == F.col("lp")) & (inside | (G.overlap_of_smaller(F.col("_a"), F.col("_l")) >= least)))
    said = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ll", "said"))), lambda s: s["said"]), " ")
    return links.join(pair.groupBy("doc_id", "page", "link").agg(said.alias("text")), ["doc_id", "page", "link"], "left")


def field_type(kind: Column, radio: Column, check: Column, push: Column) -> Column:
    return F.when(kind == "Tx", "text").when((kind == "Btn") & push, "button").when((kind == "Btn") & radio, "radio").when((kind == "Btn") & check, "checkbox").when(kind == "Ch", "choice").when(kind == "Sig", "signature").otherwise("unknown")


def selected(value: Column) -> Column:
    return F.coalesce((F.length(value) > 0) & (value != "Off"), F.lit(False))


def nearest_label(fields: DataFrame, lines: DataFrame, reach: float = 150.0) -> DataFrame:
    """Each field with the line that scores least: beside it by gap and centre, above or below it by gap and alignment."""
    f = fields.withColumn("_f", G.box())
    l = lines.filter(F.length(F.trim("text")) > 0).select(F.col("doc_id").alias("ld"), F.col("page").alias("lp"), F.col("line").alias("ll"), F.trim("text").alias("said"), G.box().alias("_l"))  # noqa: E741
    centre = F.abs((F.col("_f.y") + F.col("_f.height") / 2) - (F.col("_l.y") + F.col("_l.height") / 2))
    middle = F.abs((F.col("_f.x") + F.col("_f.width") / 2) - (F.col("_l.x") + F.col("_l.width") / 2))
    beside, level = -G.x_overlap(F.col("_f"), F.col("_l")), G.y_overlap(F.col("_f"), F.col("_l")) > 0
    apart, along = -G.y_overlap(F.col("_f"), F.col("_l")), G.horizontal_overlap_ratio(F.col("_f"), F.col("_l"))
    left = G.right(F.col("_l")) <= F.col("_f.x") + 1
    score = F.when(level & (beside >= -1) & (beside <= reach), F.when(left, 0).otherwise(6) + beside + centre * 2).when((apart >= -1) & (apart <= reach) & (along > 0), F.when(F.col("_l.y") < F.col("_f.y"), 8).otherwise(16) + apart * 2 + (1 - along) * 32 + middle * 0.04)
    relation = F.when(level, F.when(left, "left").otherwise("right")).otherwise(F.when(F.col("_l.y") < F.col("_f.y"), "above").otherwise("below"))
    pair = f.join(l, (F.col("doc_id") == F.col("ld")) & (F.col("page") == F.col("lp"))).withColumns({"score": score, "relation": relation}).filter("score is not null")
    best = pair.groupBy("doc_id", "page", "field").agg(F.min(F.struct("score", "ll", F.col("said").alias("label"), "relation")).alias("b"))
    return fields.join(best.select("doc_id", "page", "field", "b.label", "b.relation", G.half_up(F.col("b.score")).alias("score")), ["doc_id", "page", "field"], "left")


def missing_annotation_text(annotations: DataFrame, pages: DataFrame) -> DataFrame:
    """Visible free-text notes whose words are not in the page's text."""
    flat = lambda c: F.lower(F.regexp_replace(c, r"\s+", ""))
    rows = annotations.filter("subtype = 'FreeText' and not array_contains(flag_names, 'hidden')").join(pages.select("doc_id", "page", F.col("text").alias("page_text")), ["doc_id", "page"])
    return rows.filter((F.length(flat(F.col("contents"))) > 0) & ~F.contains(flat(F.col("page_text")), flat(F.col("contents")))).drop("page_text")


def structure_tables(cells: DataFrame) -> DataFrame:
    """Structure-tree cells (table, row, col, text, header) as grids: one row per table row."""
    return cells.groupBy("doc_id", "page", "table", "row").agg(F.transform(F.sort_array(F.collect_list(F.struct("col", "text"))), lambda c: c["text"]).alias("cells"), F.bool_and("header").alias("header"))


# -- pages of HTML as evidence ---------------------------------------------------------------------

_HREF = r'(?i)<a\s+[^>]*href="([^"]*)"[^>]*>([^<]*)</a>'


def html_links(pages: DataFrame) -> DataFrame:
    """page_id, link, target, text, type of every anchor of a page's HTML."""
    pairs = F.arrays_zip(F.regexp_extract_all("html", F.lit(_HREF), F.lit(1)).alias("target"), F.regexp_extract_all("html", F.lit(_HREF), F.lit(2)).alias("text"))
    rows = pages.select("page_id", F.posexplode(F.filter(pairs, lambda p: p["target"].isNotNull())).alias("link", "a"))
    kind = F.when(F.col("a.target").rlike("(?i)^https?://"), "url").when(F.col("a.target").startswith("#"), "destination").otherwise("relative")
    return rows.select("page_id", "link", F.col("a.target").alias("target"), T.collapsed(F.col("a.text")).alias("text"), kind.alias("type"))


def html_headings(pages: DataFrame) -> DataFrame:
    """page_id, ord, level, text of every heading."""
    pattern = r"(?i)<h([1-6])[^>]*>([^<]*)</h[1-6]>"
    pairs = F.arrays_zip(F.regexp_extract_all("html", F.lit(pattern), F.lit(1)).alias("level"), F.regexp_extract_all("html", F.lit(pattern), F.lit(2)).alias("text"))
    return pages.select("page_id", F.posexplode(pairs).alias("ord", "h")).select("page_id", "ord", F.col("h.level").cast("int").alias("level"), T.collapsed(F.col("h.text")).alias("text"))


def html_cells(pages: DataFrame) -> DataFrame:
    """page_id, row, col, text, header of every table cell."""
    rows = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))).alias("row", "tr"))
    cell = r"(?is)<t([hd])[^>]*>(.*?)</t[hd]>"
    pairs = F.arrays_zip(F.regexp_extract_all("tr", F.lit(cell), F.lit(1)).alias("kind"), F.regexp_extract_all("tr", F.lit(cell), F.lit(2)).alias("text"))
    return rows.select("page_id", "row", F.posexplode(pairs).alias("col", "c")).select("page_id", "row", "col", T.collapsed(F.regexp_replace("c.text", "<[^>]*>", "")).alias("text"), (F.lower("c.kind") == "h").alias("header"))


def crossing_penalty(candidates: DataFrame, fields: DataFrame, each: float = 40.0) -> DataFrame:
    """Label candidates (doc_id, page, field, line boxes as l_x...) with a penalty for every other field between the two."""
    o = fields.select(F.col("doc_id").alias("od"), F.col("page").alias("op"), F.col("field").alias("other"), G.box().alias("_o"))
    c = candidates.withColumns({"_f": G.box(), "_l": G.box("l_")})
    x, y = F.least("_f.x", "_l.x"), F.least("_f.y", "_l.y")
    hull = F.struct(x.alias("x"), y.alias("y"), (F.greatest(G.right(F.col("_f")), G.right(F.col("_l"))) - x).alias("width"), (F.greatest(G.bottom(F.col("_f")), G.bottom(F.col("_l"))) - y).alias("height"))
    c = c.withColumn("_h", hull)
    hit = (F.col("doc_id") == F.col("od")) & (F.col("page") == F.col("op")) & (F.col("field") != F.col("other")) & (G.overlap_area(F.col("_h"), F.col("_o")) >= 0.5 * G.area(F.col("_o")))
    n = c.join(o, hit).groupBy("doc_id", "page", "field", "line").agg((F.count(F.lit(1)) * each).alias("penalty"))
    return candidates.join(n, ["doc_id", "page", "field", "line"], "left").withColumn("penalty", F.coalesce("penalty", F.lit(0.0)))


def currency_prompts(fields: DataFrame, lines: DataFrame, marker_gap: float = 14.0, prompt_gap: float = 140.0) -> DataFrame:
    """Fields right after a lone currency sign, with the prompt to the sign's left on its row."""
    f = fields.select("doc_id", "page", "field", G.box().alias("_f"))
    l = lambda p: lines.select(F.col("doc_id").alias(f"{p}d"), F.col("page").alias(f"{p}p"), F.trim("text").alias(f"{p}t"), G.box().alias(f"_{p}"))  # noqa: E731, E741
    sign, prompt = l("s").filter(T.currency_only(F.col("st"))), l("q").filter(F.col("qt").rlike(r"\p{L}"))
    row = lambda a, b: G.y_overlap(F.col(a), F.col(b)) > 0
    after = F.col("_f.x") - G.right(F.col("_s"))
    before = F.col("_s.x") - G.right(F.col("_q"))
    pair = f.join(sign, (F.col("doc_id") == F.col("sd")) & (F.col("page") == F.col("sp")) & row("_f", "_s") & after.between(-1, marker_gap))
    pair = pair.join(prompt, (F.col("doc_id") == F.col("qd")) & (F.col("page") == F.col("qp")) & row("_s", "_q") & before.between(-1, prompt_gap))
    best = pair.groupBy("doc_id", "page", "field").agg(F.min_by("qt", F.struct(before, "qt")).alias("prompt"))
    return fields.join(best, ["doc_id", "page", "field"], "left")
