"""Hand-built evidence for queries whose results are known: the same pages for every document of the table.

A page is planted for each finding; the expected rows stand beside it, as SQL over the documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import quality
from .plans import detect
from .sources import evidence as ev

W, H = ev.PAGE_WIDTH, ev.PAGE_HEIGHT
_LINE = "page int, line int, text string, x double, y double, width double, height double, font_size double"
_BOX = "x double, y double, width double, height double"

_WORDS = "Plain words of a page that nobody would complain of"
_SCAN = "Words of a page that lie over its scan, long enough to be a text of their own here"
_LOST = "Thenativetextofthispagehaslostthespacesbetweenitswordsand" + "readsas onelong wordwhereagoodengineseeswordsandtheirspaces quitewell" * 2
_SEEN = "The native text of this page has lost the spaces between its words and" + " reads as one long word where a good engine sees words and their spaces quite well" * 2
#: page -> its text; a page's lines are its text's, 18 apart from 100, unless they are given below.
TEXTS = {
    1: "" * 30 + " ab", 2: "A text with a bad � sign", 3: "שלום עולם " * 8, 4: "<latexit sha1=x>" + "A" * 90 + "</latexit>", 5: _WORDS, 6: _WORDS, 7: "Employee number 12-345", 8: _SCAN, 9: "#$%& *(+) =-[] {;} " * 8,
    10: "a b c d word e f g h other " * 12, 11: "", 12: _SCAN, 13: _LOST, 14: "Some words", 15: "", 16: "", 17: _WORDS, 18: _WORDS, 19: _WORDS, 20: "", 21: "\n".join(["." * 12] * 8), 22: "Words far too small to read", 23: _WORDS, 24: _WORDS,
    25: _WORDS, 26: "", 27: "Words " * 40 + "\nThe title of it all", 28: _WORDS, 29: _WORDS, 30: "Last name\nFirst name\nStreet\nTown\nYear", 31: "\x01" * 4 + "bad glyphs of a page", 32: "A\x01 title of the one page",
}
#: The lines that are set elsewhere than their text's would be: page -> (text, x, y, width, height, font).
LINES = {
    20: [(t, 40.0, y + 20 * i + d, 120.0, 10.0, f) for d, f in ((0, 10.0), (300, 12.0)) for i, (t, y) in enumerate((("Invoice number", 50.0), ("Customer address", 50.0), ("Delivery date", 50.0)))],
    22: [("Words far too small to read", 40.0, 100.0, 30.0, 1.5, 1.5)],
    23: [("A line that runs over the page's edge", 500.0, 300.0, 120.0, 12.0, 12.0)],
    24: [("A block that lies beyond the page", 580.0, 300.0, 60.0, 12.0, 12.0)],
    25: [("Body text of the first column", 36.0, 100.0, 200.0, 12.0, 12.0), ("Another text that runs over it", 100.0, 104.0, 200.0, 12.0, 12.0)],
    26: [(f"{r}{c}.0", 100.0 + 80 * c, 100.0 + 20 * r, 30.0, 10.0, 10.0) for r in range(1, 7) for c in range(1, 4)],
    27: [("The title of it all", 40.0, 60.0, 300.0, 20.0, 20.0), ("Words " * 40, 40.0, 200.0, 500.0, 12.0, 12.0)],
    28: [("Body text that goes on nearly to the end", 40.0, 770.0, 400.0, 12.0, 12.0)],
    29: [("Body text that a foot stands right below", 40.0, 700.0, 400.0, 12.0, 12.0), ("A foot of every page", 40.0, 714.0, 300.0, 10.0, 10.0)],
    4: [("<latexit sha1=x>" + "A" * 90 + "</latexit>", 40.0, 100.0, 500.0, 12.0, 12.0)],
    8: [(_SCAN, 40.0, 100.0, 566.0, 12.0, 12.0), ("A block off the scan", 590.0, 300.0, 90.0, 12.0, 12.0)],
    31: [("A block off the page of bad glyphs", 590.0, 300.0, 90.0, 12.0, 12.0)],
    32: [("A\x01 title of the one page", 40.0, 60.0, 200.0, 20.0, 20.0)],
}
_FULL = (6.0, 6.0, 600.0, 780.0)
IMAGES = [(p, 0, *_FULL) for p in (8, 9, 10, 12, 13)] + [(16, 0, 50.0, 50.0, 500.0, 600.0), (17, 0, 50.0, 300.0, 500.0, 300.0)]
VECTORS = [(14, 7.68 * 0 + 40.0 + 20 * (i % 20), 90.0 + 20 * (i // 20), 7.68, 7.68) for i in range(260)] + [(15, 100.0 + 30 * i, 100.0, 20.0, 20.0) for i in range(4)]
#: What has to come out: (page, code, severity, block, detail).
EXPECTED = [
    (1, "glyph_garbage_text", "warning", None, "ok"), (1, "xfa_static_content", "warning", None, ""), (2, "localized_glyph_noise", "warning", None, "replacement"), (3, "rtl_script_text", "warning", None, "100.0"), (4, "raw_embedded_source_text", "warning", None, "latexit"),
    (5, "font_mapping_warning", "warning", None, "cmap"), (6, "invisible_text", "error", None, "2"), (7, "text_under_opaque_fill", "error", None, "1"),
    *[(p, "raster_backed_text_layer", "warning", None, "0.966") for p in (8, 9, 10, 12, 13)], (9, "raster_text_layer_symbol_noise", "warning", None, "1.0"), (10, "raster_text_layer_word_fragmentation", "warning", None, "96/96/120"),
    (11, "ocr_low_confidence", "warning", None, "0.3"), (12, "ocr_native_text_mismatch", "warning", None, "0.732"), (13, "ocr_native_spacing_loss", "warning", None, "6/45"),
    (14, "dense_vector_graphics", "warning", None, "260"), (15, "vector_graphics_no_native_text", "warning", None, "4"), (16, "raster_image_no_native_text", "warning", None, "0"), (17, "large_raster_low_text_overlap", "warning", None, "0"),
    (18, "annotation_text_missing_from_native", "warning", None, ""), (19, "optional_content_text_may_include_hidden_layers", "warning", None, ""), (20, "duplicate_text_layer", "warning", None, "3"), (21, "dot_leader_noise", "warning", None, "8/96"), (22, "tiny_native_text_noise", "warning", None, "1"),
    (23, "page_edge_text_truncated", "error", 0, "right:1"), (24, "off_page", "error", 0, "right"), (25, "text_overlap", "warning", 0, "1/1088.0/1"), (26, "tabular_numeric_layout", "warning", None, "18/3/6"), (27, "reading_order_divergence", "warning", 0, "242"),
    (28, "near_bottom_edge", "warning", 0, "10.0"), (29, "body_near_repeated_chrome", "warning", 0, "1/2.0"), (30, "reading_order_divergence", "warning", None, "4/5"), (31, "glyph_garbage_text", "warning", None, "mixed_glyph_indices"), (32, "localized_glyph_noise", "warning", 0, "display"),
]


def _rows(spark: SparkSession, documents: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    """The rows, for every document."""
    return documents.select("doc_id").crossJoin(F.broadcast(spark.createDataFrame(rows, schema)))


def evidence(spark: SparkSession, documents: DataFrame) -> detect.Evidence:
    """A page for each warning code (``EXPECTED``), with every kind of evidence."""
    made = []
    for p, text in TEXTS.items():
        own = LINES.get(p) or [(t, 40.0, 100.0 + 18 * i, 6.0 * len(t), 12.0, 12.0) for i, t in enumerate(text.split("\n")) if t]
        made += [(p, i, *line) for i, line in enumerate(own)]
    lines = _rows(spark, documents, made, _LINE)
    pages = quality.with_quality(_rows(spark, documents, [(p, t, len(t), 0.2) for p, t in TEXTS.items()], "page int, text string, char_count long, text_coverage double").withColumns({"width": F.lit(W), "height": F.lit(H)}))
    line = F.struct("line", "text", F.lit(True).alias("start"), "x", "y", "width", "height", "font_size")
    blocks = lines.select("doc_id", "page", F.col("line").alias("block"), "text", "x", "y", "width", "height", "font_size", F.lit(1).cast("long").alias("n_lines"), F.array(line).alias("lines"), ((F.col("page") == 29) & (F.col("line") == 1)).alias("repeated"))
    rows = lambda r, s: _rows(spark, documents, r, s)
    return detect.Evidence(
        pages, lines, blocks, lines.withColumn("word", F.lit(0)),
        images=rows(IMAGES, f"page int, image int, {_BOX}"), vectors=rows(VECTORS, f"page int, {_BOX}"),
        invisible=rows([(6, "invisible"), (6, "invisible"), (8, "invisible")], "page int, kind string"),
        runs=rows([(7, "Employee number 12-345", 1, 40.0, 100.0, 120.0, 12.0), (7, "Other words", 2, 40.0, 300.0, 120.0, 12.0), (8, "Over a scan", 1, 40.0, 100.0, 120.0, 12.0)], f"page int, text string, run int, {_BOX}"),
        fills=rows([(7, 1, 38.0, 98.0, 130.0, 20.0), (7, 1, 38.0, 298.0, 130.0, 20.0), (8, 1, 38.0, 98.0, 130.0, 20.0)], f"page int, preceding_runs int, {_BOX}"),
        ocr=rows([(11, "seen", 0.3), (12, _SCAN[::-1], 0.95), (13, _SEEN, 0.95), (5, "seen", 0.3)], "page int, text string, confidence double"),
        annotations=rows([(18, "FreeText", "a note that is nowhere else", ["print"]), (17, "FreeText", "plain WORDS", ["print"]), (19, "FreeText", "hidden", ["hidden"])], "page int, subtype string, contents string, flag_names array<string>"),
        labels=rows([(30, t, 40.0, 100.0 + 20 * i) for i, t in enumerate(["Year", "Town", "Street", "First name", "Last name"])], "page int, label string, x double, y double"),
        marked=rows([(19, True), (18, False)], "page int, optional boolean"), layers=rows([(True,), (False,)], "visible boolean"),
        parser=rows([(5, "Warning: no cmap table available"), (2, "toUnicode failed"), (6, "other")], "page int, message string"), forms=documents.select("doc_id", F.lit(True).alias("xfa"), F.lit(False).alias("acro_form")),
    )


def values(rows: list[tuple]) -> str:
    """Rows as SQL values."""
    say = lambda v: "null" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int | float) else "'" + v.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(say, r)) + ")" for r in rows)


def warnings(spark: SparkSession, documents: DataFrame) -> DataFrame:
    return detect.detect(evidence(spark, documents), W, H).select("doc_id", "page", "code", "severity", F.coalesce("block", F.lit(-1)).alias("block"), "detail")


# -- visual regions --------------------------------------------------------------------------------

#: page -> images, vectors, tables, fields, annotations, lines (text and box); sizes as on a page of 612 x 792.
REGIONS = {
    1: {"images": [(100.0, 200.0, 200.0, 150.0)], "lines": [("Figure 1. Sales", 120.0, 360.0, 100.0, 12.0), ("Body text far below", 36.0, 600.0, 300.0, 12.0)]},
    2: {"images": [_FULL, (100.0, 200.0, 200.0, 150.0)]},
    3: {"images": [_FULL]},
    4: {"vectors": [(100.0 + 12 * i, 300.0 + 5 * (i % 3), 10.0, 10.0) for i in range(8)]},
    5: {"tables": [(60.0, 300.0, 400.0, 100.0), (60.0, 262.0, 400.0, 20.0)]},
    6: {"tables": [(60.0, 100.0, 400.0, 80.0), (60.0, 500.0, 400.0, 120.0)], "fields": [(300.0, 650.0, 100.0, 14.0), (300.0, 670.0, 100.0, 14.0)]},
    7: {"images": [(100.0, 200.0, 200.0, 150.0), (110.0, 210.0, 120.0, 100.0)]},
    8: {"annotations": [("Square", 50.0, 60.0, 80.0, 40.0), ("Link", 200.0, 60.0, 80.0, 40.0)]},
    9: {"images": [(20.0, 20.0, 300.0, 30.0)], "lines": [("A foot", 10.0, 15.0, 330.0, 40.0)]},
    10: {"images": [(100.0, 200.0, 200.0, 150.0)]},
    11: {"images": [_FULL]},
    12: {"vectors": [(5.0, 5.0, 602.0, 782.0)] + [(60.0 + 130 * (i % 4), 100.0 + 60 * (i // 4), 40.0, 30.0) for i in range(24)], "lines": [(f"Box {i}", 62.0 + 130 * (i % 4), 105.0 + 90 * (i // 4), 60.0, 12.0) for i in range(24)]},
}
#: (page, region, kind, x, y, width, height, sources, caption): what has to be left.
REGIONS_EXPECTED = [
    (1, 1, "raster", 100.0, 200.0, 200.0, 150.0, 1, "Figure 1. Sales"), (2, 1, "raster", 100.0, 200.0, 200.0, 150.0, 1, None), (3, 1, "raster", *_FULL, 1, None), (4, 1, "vector", 100.0, 300.0, 94.0, 20.0, 1, None), (5, 1, "table", 60.0, 262.0, 400.0, 138.0, 2, None),
    (6, 1, "table", 60.0, 100.0, 400.0, 80.0, 1, None), (6, 2, "table", 60.0, 500.0, 400.0, 120.0, 1, None), (6, 3, "form", 300.0, 650.0, 100.0, 34.0, 1, None), (7, 1, "raster", 100.0, 200.0, 200.0, 150.0, 2, None), (8, 1, "annotation", 50.0, 60.0, 80.0, 40.0, 1, None),
    (12, 1, "vector", 62.0, 105.0, 450.0, 462.0, 1, None),
]


def visual_regions(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """Images with caption, before a page and alone; clusters, tables with headers, fields, notes, chrome, blank pages, low scans, a diagram."""
    from .plans import visual

    rows = lambda r, s: _rows(spark, documents, r, s)
    every = lambda key: [(p, i, *b) for p, page in REGIONS.items() for i, b in enumerate(page.get(key, []))]
    box = lambda key, n: rows(every(key), f"page int, {n} int, {_BOX}")
    lines = rows(every("lines"), f"page int, line int, text string, {_BOX}").withColumn("font_size", F.lit(12.0))
    blocks = lines.withColumnRenamed("line", "block").withColumns({"n_lines": F.lit(1).cast("long"), "repeated": F.col("page") == 9})
    status = [(p, "ok", "empty_but_visual_content" if p == 11 else "ok", 0.01 if p == 11 else 0.2, 10) if p != 10 else (p, "blank", "empty", 0.0, 0) for p in REGIONS]
    pages = rows(status, "page int, visual_status string, native_text_status string, render_content_ratio double, char_count long")
    notes = rows(every("annotations"), f"page int, annotation int, subtype string, {_BOX}").withColumn("flag_names", F.array(F.lit("print")))
    found = visual.build(pages, lines, blocks, box("images", "image"), box("vectors", "vector").drop("vector"), W, H, box("tables", "table").drop("table"), box("fields", "field"), notes)
    return found.select("doc_id", "page", "region", "kind", *[F.round(c, 2).alias(c) for c in ("x", "y", "width", "height")], "sources", F.coalesce("caption", F.lit("")).alias("caption"))
