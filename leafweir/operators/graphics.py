"""Content streams as evidence: images, vectors, text runs and dark fills of a page's operators.

A stream is a table doc_id, page, ord, fn, args (array<double>), text. The graphics state (matrix,
text mode, fill colour and opacity, saved states) is a fold over one page's operators, so it runs in
``applyInPandas``; what can be said by rows (counts, last mode without nesting) is plain SQL.

fn: save, restore, transform, paint_image, rectangle, fill, stroke, end_path, fill_rgb, fill_alpha,
text_mode, show_text (args: a, b, c, d, e, f, advance). Coordinates are from the bottom left.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import rules

# fixed values
INVISIBLE, LEAST_ALPHA, DARK, LEAST_BOX = 3, 0.9, 0.2, 0.5
EVIDENCE = "doc_id long, page int, kind string, ord int, text string, x double, y double, width double, height double, preceding_runs int"
_PAINTS = ("fill", "stroke", "paint_image", "shading")


def _times(m, n):
    return (m[0] * n[0] + m[2] * n[1], m[1] * n[0] + m[3] * n[1], m[0] * n[2] + m[2] * n[3], m[1] * n[2] + m[3] * n[3], m[0] * n[4] + m[2] * n[5] + m[4], m[1] * n[4] + m[3] * n[5] + m[5])


def _box(m, x0, y0, x1, y1, page_height):
    xs = [m[0] * x + m[2] * y + m[4] for x in (x0, x1) for y in (y0, y1)]
    ys = [m[1] * x + m[3] * y + m[5] for x in (x0, x1) for y in (y0, y1)]
    return min(xs), page_height - max(ys), max(xs) - min(xs), max(ys) - min(ys)


def interpret(ops: DataFrame, page_width: float, page_height: float) -> DataFrame:
    """Rows of kind image, vector, text, invisible and fill, in drawing order, boxes from the top left."""

    def page(pdf: pd.DataFrame) -> pd.DataFrame:
        state = {"m": (1.0, 0.0, 0.0, 1.0, 0.0, 0.0), "mode": 0, "dark": True, "alpha": 1.0}
        stack, path, out, runs = [], [], [], 0

        def put(kind, n, text, box, preceding=0):
            out.append((pdf["doc_id"].iloc[0], pdf["page"].iloc[0], kind, n, text, *box, preceding))

        for op in pdf.sort_values("ord", kind="stable").itertuples():
            a = [] if op.args is None else [float(v) for v in op.args]
            if op.fn == "save":
                stack.append(dict(state))
            elif op.fn == "restore" and stack:
                state = stack.pop()
            elif op.fn == "transform" and len(a) == 6:
                state["m"] = _times(state["m"], a)
            elif op.fn == "paint_image":
                put("image", op.ord, None, _box(state["m"], 0, 0, 1, 1, page_height))
            elif op.fn == "rectangle" and len(a) == 4:
                path.append(_box(state["m"], a[0], a[1], a[0] + a[2], a[1] + a[3], page_height))
            elif op.fn == "fill_rgb" and len(a) == 3:
                state["dark"] = 0.2126 * a[0] + 0.7152 * a[1] + 0.0722 * a[2] <= DARK
            elif op.fn == "fill_alpha" and a:
                state["alpha"] = a[0]
            elif op.fn == "text_mode" and a:
                state["mode"] = int(a[0])
            elif op.fn in ("fill", "stroke"):
                for b in path:
                    sheet = b[2] >= page_width * 0.98 and b[3] >= page_height * 0.98
                    if max(b[2], b[3]) >= LEAST_BOX and not (sheet and op.fn == "fill" and not state["dark"]):
                        put("vector", op.ord, None, b)
                    if op.fn == "fill" and state["dark"] and state["alpha"] >= LEAST_ALPHA:
                        put("fill", op.ord, None, b, runs)
                path = []
            elif op.fn == "end_path":
                path = []
            elif op.fn == "show_text":
                m = _times(state["m"], a[:6]) if len(a) >= 6 else state["m"]
                runs += 1
                put("invisible" if state["mode"] == INVISIBLE else "text", op.ord, op.text, _box(m, 0, 0, a[6] if len(a) > 6 else 0, 1, page_height), runs)
        return pd.DataFrame(out, columns=[c.split()[0] for c in EVIDENCE.split(", ")])

    return ops.groupBy("doc_id", "page").applyInPandas(page, EVIDENCE)


def of_kind(evidence: DataFrame, kind: str) -> DataFrame:
    """Rows of one kind, numbered from 0 as they were drawn."""
    rows = evidence.filter(F.col("kind") == kind)
    return rows.withColumn(kind, F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("ord", "x", "y")) - 1).drop("kind")


def paint_counts(ops: DataFrame) -> DataFrame:
    """doc_id, page, image_count, vector_count: painting operators, no state needed."""
    return ops.filter(F.col("fn").isin(*_PAINTS)).groupBy("doc_id", "page").agg(F.sum((F.col("fn") == "paint_image").cast("int")).alias("image_count"), F.sum((F.col("fn") != "paint_image").cast("int")).alias("vector_count"))


def invisible_text(evidence: DataFrame, images: DataFrame, page_area: float) -> DataFrame:
    """Pages with text drawn invisibly and no image over nearly all of them."""
    scan = images.filter(F.col("width") * F.col("height") >= 0.9 * page_area).select("doc_id", "page").distinct()
    found = evidence.filter("kind = 'invisible'").groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("n")).join(scan, ["doc_id", "page"], "left_anti")
    return rules.warning(found, "invisible_text", F.col("n"))


def dense_vectors(pages: DataFrame, vectors: DataFrame, page_area: float, most: int = 250) -> DataFrame:
    """Pages of many vectors, unless text dominates and the vectors are small decoration."""
    size = vectors.groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("vectors"), F.sum(F.col("width") * F.col("height")).alias("area"))
    text = (F.col("char_count") >= 1000) & (F.col("text_coverage") >= 0.15) & (F.col("area") < 0.05 * page_area)
    return rules.warning(pages.join(size, ["doc_id", "page"]).filter((F.col("vectors") >= most) & ~text), "dense_vector_graphics", F.col("vectors"))


def vectors_without_text(pages: DataFrame, vectors: DataFrame, page_width: float, page_height: float) -> DataFrame:
    """Pages of vectors (not all hairlines at the edge) with neither text nor images."""
    edge = (F.least("width", "height") <= 1) & ((F.col("x") <= 12) | (F.col("y") <= 12) | (F.col("x") + F.col("width") >= page_width - 12) | (F.col("y") + F.col("height") >= page_height - 12))
    some = vectors.filter(~edge).groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("n"))
    blank = F.coalesce(F.col("visual_status") == "blank", F.lit(False)) if "visual_status" in pages.columns else F.lit(False)
    return rules.warning(pages.filter("char_count = 0 and image_count = 0").filter(~blank).join(some, ["doc_id", "page"]), "vector_graphics_no_native_text", F.col("n"))


def raster_without_text(pages: DataFrame, images: DataFrame, page_area: float) -> DataFrame:
    """Pages without text whose largest image takes half of them or more; block is that image's number."""
    best = images.groupBy("doc_id", "page").agg(F.max_by("image", F.struct(F.col("width") * F.col("height"), -F.col("image"))).alias("image"), (F.max(F.col("width") * F.col("height")) / page_area).alias("share"))
    return rules.warning(pages.filter("char_count = 0").join(best, ["doc_id", "page"]).filter("share >= 0.5"), "raster_image_no_native_text", F.col("image"))


def font_mapping(parser_warnings: DataFrame, quality: DataFrame, found: DataFrame) -> DataFrame:
    """Pages whose parser complained of character maps, of good status and with no glyph warning yet."""
    bad = parser_warnings.filter(F.lower("message").rlike("cmap|tounicode")).select("doc_id", "page").distinct()
    ok = quality.filter("native_text_status = 'ok' and char_count > 0").select("doc_id", "page")
    prior = found.filter("code in ('glyph_garbage_text', 'localized_glyph_noise')").select("doc_id", "page")
    return rules.warning(bad.join(ok, ["doc_id", "page"], "left_semi").join(prior, ["doc_id", "page"], "left_anti"), "font_mapping_warning", F.lit("cmap"))


def hidden_layers(marked: DataFrame, layers: DataFrame) -> DataFrame:
    """Pages with text in optional content of documents that hide a group."""
    hidden = layers.filter(~F.col("visible")).select("doc_id").distinct()
    return rules.warning(marked.filter("optional").select("doc_id", "page").distinct().join(hidden, "doc_id", "left_semi"), "optional_content_text_may_include_hidden_layers", F.lit(""))


def xfa(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """One warning, on the first page, of documents with an XFA form: by what stands on their pages."""
    first = pages.groupBy("doc_id").agg(F.min("page").alias("page"), F.max(F.length(F.trim("text"))).alias("most"), F.bool_or(F.lower("text").rlike("please wait|if this message is not eventually replaced")).alias("placeholder"))
    shaped = documents.filter("xfa").join(first, "doc_id")
    code = F.when(F.col("placeholder") & (F.col("most") <= 2000), "xfa_form").when(F.col("most") > 32, "xfa_static_content").when(F.col("acro_form"), "xfa_fields_only").otherwise("xfa_form")
    return shaped.select("doc_id", "page", code.alias("code"), F.when((code == "xfa_form") & F.col("placeholder"), "error").otherwise("warning").alias("severity"), F.lit(None).cast("int").alias("block"), F.lit("").alias("detail"))


def physical(rows: DataFrame) -> DataFrame:
    """Geometry in points: all lengths times the page's user unit (1 where unknown)."""
    unit = F.coalesce("user_unit", F.lit(1.0))
    return rows.withColumns({c: F.col(c) * unit for c in ("x", "y", "width", "height", "font_size") if c in rows.columns})
