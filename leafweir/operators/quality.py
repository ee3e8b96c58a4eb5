"""Page quality: native-text and visual status, overview rows, document map."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T

# fixed values: thresholds of the two cascades
UNUSABLE, MIXED, GEOMETRY_NOISE = 0.3, 0.05, 0.1
SPARSE_CHARS, SPARSE_COVERAGE, DENSE_VECTORS, DENSE_CHARS = 200, 0.02, 250, 40
VISUAL_OK, VISUAL_SPARSE, VISUAL_TRACE = 0.005, 0.001, 0.0005
UNRELIABLE = ("unusable_glyph_indices", "mixed_glyph_indices", "empty_but_visual_content", "sparse_text_with_visual_content")


def visual_status(content: Column, has_text: Column, has_graphics: Column, has_annotation: Column) -> Column:
    """ok, sparse or blank of a render's content ratio; null without a render."""
    return (
        F.when(content.isNull(), None)
        .when(content > VISUAL_OK, "ok")
        .when(content > VISUAL_SPARSE, "sparse")
        .when((content > 0) & has_text & ~has_graphics, "sparse")
        .when((content >= VISUAL_TRACE) & (has_graphics | has_annotation), "sparse")
        .when((content > 0) & has_annotation, "sparse")
        .otherwise("blank")
    )


def native_text_status(npr: Column, chars: Column, coverage: Column, images: Column, vectors: Column, visual: Column) -> Column:
    sparse = ((chars <= SPARSE_CHARS) & (coverage < SPARSE_COVERAGE)) | ((chars <= DENSE_CHARS) & (vectors >= DENSE_VECTORS))
    graphics = (images > 0) | (vectors > 0)
    shown = graphics & F.coalesce(visual != "blank", F.lit(True))
    return (
        F.when(npr >= UNUSABLE, "unusable_glyph_indices")
        .when(npr >= MIXED, "mixed_glyph_indices")
        .when((chars > 0) & F.coalesce(visual == "blank", F.lit(False)), "sparse_text_on_blank_visual")
        .when((chars > 0) & graphics & sparse, "sparse_text_with_visual_content")
        .when(chars > 0, "ok")
        .when(shown | F.coalesce(visual.isin("ok", "sparse"), F.lit(False)), "empty_but_visual_content")
        .otherwise("empty")
    )


def with_quality(pages: DataFrame) -> DataFrame:
    """Pages (text, char_count, text_coverage; image_count, vector_count, render_content_ratio where known) with their statuses."""
    has = set(pages.columns)
    images, vectors = (F.col(c) if c in has else F.lit(0) for c in ("image_count", "vector_count"))
    content = F.col("render_content_ratio") if "render_content_ratio" in has else F.lit(None).cast("double")
    noted = F.col("visible_annotation") if "visible_annotation" in has else F.lit(False)
    out = pages.withColumns({"non_printable_count": T.non_printable_count(F.col("text")), "non_printable_ratio": T.non_printable_ratio(F.col("text"))})
    out = out.withColumn("visual_status", visual_status(content, F.col("char_count") > 0, (images > 0) | (vectors > 0), noted))
    return out.withColumn("native_text_status", native_text_status(F.col("non_printable_ratio"), F.col("char_count"), F.col("text_coverage"), images, vectors, F.col("visual_status")))


def unreliable(status: Column) -> Column:
    return status.isin(*UNRELIABLE)


def unreliable_pages(pages: DataFrame) -> DataFrame:
    """doc_id, ranges: the pages of each document whose native text is not to be trusted."""
    return page_ranges(pages.filter(unreliable(F.col("native_text_status"))).select("doc_id", "page"), ["doc_id"])


def unreliable_geometry(pages: DataFrame) -> DataFrame:
    """doc_id, page where glyphs are so bad that boxes say nothing either."""
    bad = (F.col("native_text_status") == "unusable_glyph_indices") | ((F.col("native_text_status") == "mixed_glyph_indices") & (F.col("non_printable_ratio") >= GEOMETRY_NOISE))
    return pages.filter(bad).select("doc_id", "page")


def overview(pages: DataFrame, children: dict[str, DataFrame]) -> DataFrame:
    """One row per page of documents with more than one, with a count of each child table's rows."""
    many = Window.partitionBy("doc_id")
    out = pages.withColumn("total_pages", F.count(F.lit(1)).over(many)).filter("total_pages > 1")
    for name, rows in children.items():
        n = rows.groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias(name))
        out = out.join(n, ["doc_id", "page"], "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def page_ranges(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Consecutive pages of each key folded to ranges: keys, pages (n), ranges like ``1-3, 7``."""
    distinct = rows.select(*keys, "page").distinct()
    island = F.col("page") - F.row_number().over(Window.partitionBy(*keys).orderBy("page"))
    runs = distinct.withColumn("island", island).groupBy(*keys, "island").agg(F.min("page").alias("first"), F.max("page").alias("last"), F.count(F.lit(1)).alias("n"))
    said = F.when(F.col("first") == F.col("last"), F.col("first").cast("string")).otherwise(F.concat_ws("-", "first", "last"))
    folded = runs.groupBy(*keys).agg(F.sum("n").alias("pages"), F.sort_array(F.collect_list(F.struct("first", said.alias("r")))).alias("rs"))
    return folded.select(*keys, "pages", F.array_join(F.transform("rs", lambda r: r["r"]), ", ").alias("ranges"))


def parse_runs(spec: str) -> list[tuple[int, int]]:
    """(first, last) of each page or range of ``1-3,7``, as written."""
    out = []
    for part in spec.split(","):
        ends = part.strip().split("-")
        if len(ends) > 2 or not all(e.strip().isascii() and e.strip().isdigit() for e in ends):
            raise ValueError(f"not a page or range: {part!r}")
        lo, hi = int(ends[0]), int(ends[-1])
        if lo < 1 or hi < lo:
            raise ValueError(f"not a page or range: {part!r}")
        out.append((lo, hi))
    return out


def parse_ranges(spec: str, total: int, most_skipped: int = 100) -> tuple[list[int], list[int], bool]:
    """Pages of ``1-3,7`` within 1..total, those outside (at most so many), and whether more were outside."""
    pages: set[int] = set()
    skipped: set[int] = set()
    cut = False
    for lo, hi in parse_runs(spec):
        pages.update(range(lo, min(hi, total) + 1))
        for p in range(max(lo, total + 1), hi + 1):
            if len(skipped) >= most_skipped and p not in skipped:
                cut = True
                break
            skipped.add(p)
    if not pages:
        raise ValueError(f"no page of {spec!r} is within 1-{total}")
    return sorted(pages), sorted(skipped), cut


def select_pages(rows: DataFrame, spec: str) -> DataFrame:
    """Rows of the pages a range names, as a filter that reaches the scan."""
    runs = parse_runs(spec)
    test = F.lit(False)
    for lo, hi in runs:
        test = test | F.col("page").between(lo, hi)
    return rows.filter(test)


def unreadable_report(warnings: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, code, pages, ranges: what document-wide codes cover (all pages) and page codes do (their own)."""
    wide = warnings.filter(F.col("code").isin("xfa_form", "xfa_fields_only", "xfa_static_content")).select("doc_id", "code").distinct().join(pages.select("doc_id", "page"), "doc_id")
    own = warnings.filter(F.col("code").isin("glyph_garbage_text", "raster_image_no_native_text")).select("doc_id", "code", "page")
    return page_ranges(wide.unionByName(own), ["doc_id", "code"])
