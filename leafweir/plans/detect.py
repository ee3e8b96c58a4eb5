"""All warning rules over one body of evidence, with the gates between them.

Rules on text and counts run on every page. Rules on geometry are held back on pages whose text lies over
a full-page image (their boxes are those of a hidden layer) and on pages whose glyphs are so bad that boxes
say nothing. Blocks near the bottom are judged only in documents of several pages, where chrome is known.
All lengths are in points: where pages have a ``user_unit``, boxes are multiplied by it first.

Pages and blocks, which most rules read, are written once to the shared folder, in buckets of pages: the
plan of all rules would else hold the layout a dozen times over, and deal it out as often. The warnings of a few rules at a time are written there too:
with each stage that ends, the driver is told the whole plan anew, and a plan of all rules fills its memory.
No table is sent to all executors for its small file: rows of many alike pages take next to no room in one.
"""

from __future__ import annotations

from dataclasses import dataclass, fields, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import chrome, forms, graphics, layout, ocr, overlap, quality, reading, rules
from ..sources.store import bucketed, materialize


#: Rules that are run together.
AT_ONCE = 4


@dataclass(frozen=True)
class Evidence:
    """Tables of one body of documents; those that a parser or engine did not deliver are None.

    pages with quality columns, blocks marked for repeated chrome; graphics from ``graphics.interpret``.
    """

    pages: DataFrame
    lines: DataFrame
    blocks: DataFrame
    spans: DataFrame
    images: DataFrame | None = None
    vectors: DataFrame | None = None
    invisible: DataFrame | None = None
    runs: DataFrame | None = None
    fills: DataFrame | None = None
    ocr: DataFrame | None = None
    annotations: DataFrame | None = None
    labels: DataFrame | None = None
    marked: DataFrame | None = None
    layers: DataFrame | None = None
    parser: DataFrame | None = None
    forms: DataFrame | None = None


def in_points(e: Evidence) -> Evidence:
    """Boxes and font sizes times each page's user unit."""
    if "user_unit" not in e.pages.columns:
        return e
    units = e.pages.select("doc_id", "page", "user_unit").filter("user_unit <> 1")
    boxed = {f.name: getattr(e, f.name) for f in fields(e) if f.name not in ("pages", "ocr", "marked", "layers", "parser", "forms") and getattr(e, f.name) is not None}
    scaled = {name: graphics.physical(df.join(units, ["doc_id", "page"], "left")).drop("user_unit") for name, df in boxed.items()}
    return replace(e, **scaled)


def _text(e: Evidence) -> list[DataFrame]:
    return [rules.text_rules(e.pages), rules.single_display_glyph(e.pages, e.blocks), rules.dot_leaders(e.lines), rules.tiny_text(e.lines)]


def _evidence(e: Evidence, backed: DataFrame | None, width: float, height: float) -> list[DataFrame]:
    """Rules on images, vectors, OCR, annotations and layers, where these are there."""
    area, out = width * height, []
    keys = ["doc_id", "page"]
    images = e.images if e.images is not None else e.pages.select(*keys, F.lit(0).alias("image"), *[F.lit(0.0).alias(c) for c in ("x", "y", "width", "height")]).limit(0)
    hidden = [rules.duplicate_text_layer(e.spans)]
    if e.invisible is not None:
        hidden.append(graphics.invisible_text(e.invisible, images, area))
    if e.runs is not None and e.fills is not None:
        hidden.append(rules.text_under_fill(e.runs, e.fills))
    out += hidden if backed is None else [w.join(backed.select(*keys), keys, "left_anti") for w in hidden]
    if backed is not None:
        scanned = e.pages.join(backed.select(*keys), keys, "left_semi")
        ok = scanned.filter("native_text_status = 'ok'")
        out += [backed, rules.symbol_noise(ok), rules.word_fragmentation(ok.filter("visual_status is null or visual_status <> 'blank'"))]
    if e.ocr is not None:
        weak = e.pages.filter("native_text_status <> 'ok'").select(*keys)
        out.append(rules.low_confidence_ocr(e.ocr, weak if backed is None else weak.unionByName(backed.select(*keys))))
        if backed is not None:
            both = scanned.select(*keys, F.col("text").alias("native")).join(e.ocr.select(*keys, F.col("text").alias("ocr"), "confidence"), keys)
            out += [rules.warning(ocr.native_mismatch(both), "ocr_native_text_mismatch", F.col("ratio")), rules.warning(ocr.page_spacing_loss(both), "ocr_native_spacing_loss", F.concat_ws("/", "native_spaces", "ocr_spaces"))]
    counted = e.pages
    for name, table in (("image_count", e.images), ("vector_count", e.vectors)):
        if table is not None and name not in counted.columns:
            n = table.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
            counted = counted.join(n, keys, "left").withColumn(name, F.coalesce(name, F.lit(0)))
        elif name not in counted.columns:
            counted = counted.withColumn(name, F.lit(0))
    if e.vectors is not None:
        out += [graphics.dense_vectors(counted, e.vectors, area), graphics.vectors_without_text(counted, e.vectors, width, height)]
    if e.images is not None:
        told = e.pages.filter("char_count > 0").filter(~F.col("native_text_status").isin(*rules.GARBAGE)).select(*keys)
        out += [graphics.raster_without_text(counted, e.images, area), rules.large_raster_low_text(e.images.join(told, keys, "left_semi"), e.lines, area)]
    if e.annotations is not None:
        missing = forms.missing_annotation_text(e.annotations, e.pages).select(*keys).distinct()
        out.append(rules.warning(missing, "annotation_text_missing_from_native", F.lit("")))
    if e.marked is not None and e.layers is not None:
        out.append(graphics.hidden_layers(e.marked, e.layers))
    if e.forms is not None:
        out.append(graphics.xfa(e.forms, e.pages))
    return out


def _geometry(e: Evidence, width: float, height: float) -> list[DataFrame]:
    placed = bucketed(reading.native_places(e.blocks, e.pages).select("doc_id", "page", "block", "x", "n", "layout", "native"), "places", True)
    several = e.pages.groupBy("doc_id").agg(F.countDistinct("page").alias("n")).filter("n >= 2").select("doc_id")
    near, found = chrome.body_near_chrome(e.blocks), overlap.largest(overlap.pairs(e.blocks, e.images, width * height))
    out = [
        rules.page_edge_truncated(e.spans, width, height, e.blocks), rules.off_page(e.blocks, width, height), rules.numeric_layout(e.lines), rules.late_heading(e.blocks, e.pages),
        reading.out_of_sequence(placed), reading.divergent_blocks(placed), reading.column_lists(placed, width),
        rules.near_bottom_edge(e.blocks, width, height, layout.body_font(e.lines)).join(several, "doc_id", "left_semi"),
        rules.warning(found, "text_overlap", F.concat_ws("/", "other_block", "area", "pairs"), F.col("block")), rules.warning(near, "body_near_repeated_chrome", F.concat_ws("/", "other_block", "overlap", "gap"), F.col("block")),
    ]
    if e.labels is not None:
        out.append(reading.form_labels(e.labels, e.pages))
    return out


def _found(warnings: list[DataFrame]) -> DataFrame:
    """The warnings of all these rules, those of a few at a time written to the shared folder."""
    return reduce(DataFrame.unionByName, [materialize(rules.all_of(*warnings[i : i + AT_ONCE]), "warnings") for i in range(0, len(warnings), AT_ONCE)])


def detect(evidence: Evidence, width: float, height: float, dealt: bool = False) -> DataFrame:
    """doc_id, page, code, severity, block, detail, rank: the warnings of every page, ordered within it.

    dealt: pages and blocks come from a table in buckets of pages (``store.bucketed``).
    """
    e = in_points(evidence)
    e = replace(e, **{f.name: getattr(e, f.name).hint("merge") for f in fields(e) if getattr(e, f.name) is not None})
    e = replace(e, pages=bucketed(e.pages, "pages", dealt), blocks=bucketed(e.blocks, "blocks", dealt))
    keys = ["doc_id", "page"]
    backed = None
    if e.images is not None:
        vectors = e.vectors.groupBy(*keys).agg(F.count(F.lit(1)).alias("vector_count")) if e.vectors is not None else None
        sized = e.pages.drop("vector_count") if vectors is not None else e.pages
        sized = sized.join(vectors, keys, "left").withColumn("vector_count", F.coalesce("vector_count", F.lit(0))) if vectors is not None else sized if "vector_count" in sized.columns else sized.withColumn("vector_count", F.lit(0))
        backed = bucketed(rules.raster_backed(sized, e.images), "backed", dealt)
    held = quality.unreliable_geometry(e.pages)
    held = held if backed is None else held.unionByName(backed.select(*keys)).distinct()
    found = _found([*_text(e), *_evidence(e, backed, width, height)])
    if e.parser is not None:
        found = found.unionByName(graphics.font_mapping(e.parser, e.pages, found))
    shaped = _found(_geometry(e, width, height)).join(held, keys, "left_anti")
    return rules.settle(found.unionByName(shaped))
