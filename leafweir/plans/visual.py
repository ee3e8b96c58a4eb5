"""Visual regions of pages out of all evidence: candidates of every kind, suppressed, merged, labelled, ranked."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import labels, regions
from ..sources.store import materialize


def build(
    pages: DataFrame, lines: DataFrame, blocks: DataFrame, images: DataFrame, vectors: DataFrame, width: float, height: float, tables: DataFrame | None = None, fields: DataFrame | None = None, annotations: DataFrame | None = None, most: int = regions.MOST
) -> DataFrame:
    """doc_id, page, region, kind, box, sources, boxes, caption, label, area_ratio, score: at most ``most`` regions of a page.

    pages carry native_text_status, visual_status and render_content_ratio; blocks are marked for chrome.
    """
    area = width * height
    found = [regions.raster_candidates(images, width, height), regions.vector_candidates(vectors), regions.mixed_diagrams(images, vectors, area), regions.page_diagrams(blocks, vectors, images, width, height), regions.ruled_candidates(vectors)]
    if tables is not None:
        found.append(regions.table_candidates(tables))
    if fields is not None:
        found.append(regions.form_candidates(fields))
    if annotations is not None:
        found.append(regions.annotation_candidates(annotations))
    at = materialize(reduce(DataFrame.unionByName, found), "region-candidates")
    at = regions.without_blank_pages(regions.without_form_backplanes(at, area), pages)
    at = regions.without_low_content_scans(at, pages, blocks, [x for x in (vectors, fields, annotations) if x is not None], width, height)
    at = regions.without_background(regions.without_lone_backplanes(at, pages, images, width, height), width, height)
    at = materialize(regions.without_table_strips(regions.without_vector_backplanes(at, area)), "regions")
    at = regions.without_background(regions.merged(regions.merged_strips(at)), width, height)
    at = regions.without_chrome(regions.without_contained(at), blocks)
    at = materialize(regions.captioned(at, lines), "captioned-regions")
    # a number within its page: labels are found for each
    numbered = at.withColumn("region", F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("y", "x", "width", "height", "kind")))
    kinds = ["lead_in", "plain_label", "heading", "inside_label", "panel_title", "source"]
    labelled = labels.attach_all(numbered.withColumn("caption", F.col("caption")), lines, area, kinds)
    at = regions.settled(labelled.withColumn("label", F.get("associated", F.lit(0))).select("doc_id", "page", "kind", "x", "y", "width", "height", "sources", "boxes", "caption", "label"))
    return regions.ranked(regions.without_contained(regions.without_table_strips(at)), width, height, most)
