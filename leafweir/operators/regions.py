"""Visual regions: candidates merged, suppressed, captioned, ranked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as G
from ..functions import text as T
from .folds import by_page

MOST = 12
_SCHEMA = "doc_id long, page int, kind string, x double, y double, width double, height double, sources int, boxes int"


def raster_candidates(images: DataFrame, page_width: float, page_height: float) -> DataFrame:
    """Images of at least 1.5 % of the page or 30 % of a side."""
    big = (F.col("width") * F.col("height") >= 0.015 * page_width * page_height) | (F.col("width") >= 0.3 * page_width) | (F.col("height") >= 0.3 * page_height)
    return images.filter(big).select("doc_id", "page", F.lit("raster").alias("kind"), "x", "y", "width", "height", F.lit(1).alias("sources"), F.lit(1).alias("boxes"))


def vector_candidates(vectors: DataFrame, gap: float = 10.0, least_boxes: int = 6) -> DataFrame:
    """Connected components of a page's vector boxes (gap apart at most), by union-find in one page."""

    def page(doc: int, number: int, c: dict[str, list]) -> list[tuple]:
        x, y, w, h = (c[k] for k in ("x", "y", "width", "height"))
        root = list(range(len(x)))

        def top(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        reached: list[int] = []  # boxes that end no higher than the gap above the one at hand; rows come from the top
        for i in range(len(x)):
            reached = [j for j in reached if y[j] + h[j] + gap >= y[i]]
            for j in reached:
                if x[j] - gap <= x[i] + w[i] and x[i] - gap <= x[j] + w[j]:
                    root[top(i)] = top(j)
            reached.append(i)
        groups: dict[int, list[int]] = {}
        for i in range(len(x)):
            groups.setdefault(top(i), []).append(i)
        out = []
        for own in groups.values():
            if len(own) >= least_boxes:
                left, up = min(x[i] for i in own), min(y[i] for i in own)
                out.append((doc, number, "vector", left, up, max(x[i] + w[i] for i in own) - left, max(y[i] + h[i] for i in own) - up, 1, len(own)))
        return out

    return by_page(vectors, ["x", "y", "width", "height"], ["y", "x", "width", "height"], page, _SCHEMA)


def merged(candidates: DataFrame, overlap: float = 0.75, alike: float = 0.0) -> DataFrame:
    """First-fit merge, in order, of candidates that overlap by so much of the smaller one and are so alike in area."""

    def page(doc: int, number: int, c: dict[str, list]) -> list[tuple]:
        out: list[list] = []
        for kind, x, y, w, h, sources, boxes in zip(*(c[k] for k in ("kind", "x", "y", "width", "height", "sources", "boxes")), strict=True):
            for o in out:
                across, down = min(o[3] + o[5], x + w) - max(o[3], x), min(o[4] + o[6], y + h) - max(o[4], y)
                small, large = sorted((o[5] * o[6], w * h))
                if across > 0 and down > 0 and small > 0 and across * down / small >= overlap and small / large >= alike:
                    left, up = min(o[3], x), min(o[4], y)
                    o[5], o[6] = max(o[3] + o[5], x + w) - left, max(o[4] + o[6], y + h) - up
                    o[3], o[4], o[7], o[8] = left, up, o[7] + sources, o[8] + boxes
                    if o[2] != kind:
                        o[2] = "mixed"
                    break
            else:
                out.append([doc, number, kind, x, y, w, h, sources, boxes])
        return [tuple(o) for o in out]

    return by_page(candidates, ["kind", "x", "y", "width", "height", "sources", "boxes"], ["y", "x", "width", "height"], page, _SCHEMA)


def without_contained(candidates: DataFrame, share: float = 0.9, larger: float = 1.5) -> DataFrame:
    """Without candidates that lie within a much larger one of as many sources."""
    rows = candidates.withColumn("_b", G.box())
    o = candidates.select(F.col("doc_id").alias("od"), F.col("page").alias("op"), F.col("sources").alias("os"), G.box().alias("_o"))
    within = G.overlap_area(F.col("_b"), F.col("_o")) >= share * G.area(F.col("_b"))
    return rows.join(o, (F.col("doc_id") == F.col("od")) & (F.col("page") == F.col("op")) & (F.col("os") >= F.col("sources")) & (G.area(F.col("_o")) >= larger * G.area(F.col("_b"))) & within, "left_anti").drop("_b")


def without_background(candidates: DataFrame, page_width: float, page_height: float, share: float = 0.85) -> DataFrame:
    """Without near-full-page candidates where a page has others."""
    full = F.col("width") * F.col("height") >= share * page_width * page_height
    fore = F.bool_or(~full).over(Window.partitionBy("doc_id", "page"))
    return candidates.withColumn("_fore", fore).filter(~(full & F.col("_fore"))).drop("_fore")


def captioned(candidates: DataFrame, lines: DataFrame, reach: float = 40.0) -> DataFrame:
    """Each candidate with the nearest caption line above or below it within reach."""
    c = candidates.withColumns({"_b": G.box(), "_id": F.struct("x", "y", "width", "height", "kind")})
    l = lines.filter(F.trim("text").rlike(T.CAPTION)).select(F.col("doc_id").alias("ld"), F.col("page").alias("lp"), F.col("line").alias("ll"), F.col("text").alias("said"), G.box().alias("_l"))  # noqa: E741
    away = F.greatest(F.lit(0.0), -G.y_overlap(F.col("_b"), F.col("_l")))
    pair = c.join(l, (F.col("doc_id") == F.col("ld")) & (F.col("page") == F.col("lp")) & (G.x_overlap(F.col("_b"), F.col("_l")) > 0) & (away <= reach), "left")
    return pair.groupBy("doc_id", "page", "_id").agg(*[F.first(k).alias(k) for k in candidates.columns if k not in ("doc_id", "page")], F.min_by("said", F.when(F.col("said").isNotNull(), F.struct(away, "ll"))).alias("caption")).drop("_id")


def ranked(candidates: DataFrame, page_width: float, page_height: float, most: int = MOST) -> DataFrame:
    """The best ``most`` of each page by score, numbered in reading order."""
    priority = F.when(F.col("caption").isNotNull(), 2).otherwise(1) if "caption" in candidates.columns else F.lit(1)
    share = F.col("width") * F.col("height") / (page_width * page_height)
    score = priority * 100 + share * 20 + F.least("boxes", F.lit(50))
    best = Window.partitionBy("doc_id", "page").orderBy(F.desc("score"), "y", "x", "width", "height")
    kept = candidates.withColumn("area_ratio", G.half_up(share, 3)).withColumn("score", score).withColumn("_n", F.row_number().over(best)).filter(F.col("_n") <= most).drop("_n")
    return kept.withColumn("region", F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("y", "x", "width", "height")))


def build(images: DataFrame, vectors: DataFrame, lines: DataFrame, page_width: float, page_height: float) -> DataFrame:
    found = raster_candidates(images, page_width, page_height).unionByName(vector_candidates(vectors))
    kept = without_contained(without_background(merged(found), page_width, page_height))
    return ranked(captioned(kept, lines), page_width, page_height)


# -- more candidates -------------------------------------------------------------------------------


def table_candidates(tables: DataFrame) -> DataFrame:
    """Layout tables (doc_id, page and box) as candidates."""
    return tables.select("doc_id", "page", F.lit("table").alias("kind"), "x", "y", "width", "height", F.lit(1).alias("sources"), F.lit(1).alias("boxes"))


def annotation_candidates(annotations: DataFrame) -> DataFrame:
    """Visible markup annotations as candidates."""
    shown = annotations.filter("not array_contains(flag_names, 'hidden') and subtype not in ('Link', 'Widget', 'Popup')")
    return shown.select("doc_id", "page", F.lit("annotation").alias("kind"), "x", "y", "width", "height", F.lit(1).alias("sources"), F.lit(1).alias("boxes"))


def form_candidates(fields: DataFrame, gap: float = 18.0) -> DataFrame:
    """Fields down a page with no gap over ``gap`` as one form region each."""
    order = Window.partitionBy("doc_id", "page").orderBy("y", "x")
    low = F.max(F.col("y") + F.col("height")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = fields.withColumn("_new", F.when(F.coalesce(F.col("y") - low <= gap, F.lit(False)), 0).otherwise(1)).withColumn("_part", F.sum("_new").over(order))
    grouped = rows.groupBy("doc_id", "page", "_part").agg(F.count(F.lit(1)).cast("int").alias("boxes"), *G.union_aggs())
    return grouped.select("doc_id", "page", F.lit("form").alias("kind"), "x", "y", "width", "height", F.lit(1).alias("sources"), "boxes")


def ruled_candidates(vectors: DataFrame, kind: str = "table", gap: float = 14.0, least: int = 8, across: int = 3, down: int = 2, thick: float = 1.5) -> DataFrame:
    """Clusters of thin rules with enough level and upright ones."""
    rules_ = vectors.filter((F.least("width", "height") <= thick) & (F.greatest("width", "height") >= 18))
    found = vector_candidates(rules_, gap, least)
    v = rules_.select(F.col("doc_id").alias("vd"), F.col("page").alias("vp"), G.box().alias("_v"))
    inside = G.touches(F.col("_b"), F.col("_v"), 1.0)
    pair = found.withColumn("_b", G.box()).join(v, (F.col("doc_id") == F.col("vd")) & (F.col("page") == F.col("vp")) & inside)
    level = F.col("_v.width") >= F.col("_v.height")
    per = pair.groupBy("doc_id", "page", "x", "y", "width", "height", "boxes").agg(F.sum(level.cast("int")).alias("level"), F.sum((~level).cast("int")).alias("upright")).filter((F.col("level") >= across) & (F.col("upright") >= down))
    return per.select("doc_id", "page", F.lit(kind).alias("kind"), "x", "y", "width", "height", F.lit(1).alias("sources"), "boxes")


def mixed_diagrams(images: DataFrame, vectors: DataFrame, page_area: float, least_images: int = 3, least_vectors: int = 2) -> DataFrame:
    """Small images and connectors of a page as one region when together they take 3 to 50 % of it."""
    small = images.filter(F.col("width") * F.col("height") < 0.1 * page_area)
    a = small.select("doc_id", "page", "x", "y", "width", "height", F.lit(1).alias("i"), F.lit(0).alias("v"))
    b = vectors.select("doc_id", "page", "x", "y", "width", "height", F.lit(0).alias("i"), F.lit(1).alias("v"))
    per = a.unionByName(b).groupBy("doc_id", "page").agg(F.sum("i").alias("i"), F.sum("v").alias("v"), *G.union_aggs())
    share = F.col("width") * F.col("height") / page_area
    return per.filter((F.col("i") >= least_images) & (F.col("v") >= least_vectors) & share.between(0.03, 0.5)).select("doc_id", "page", F.lit("mixed").alias("kind"), "x", "y", "width", "height", F.lit(2).alias("sources"), (F.col("i") + F.col("v")).cast("int").alias("boxes"))


def merged_strips(candidates: DataFrame, gap: float = 12.0, share: float = 0.5) -> DataFrame:
    """Low raster strips taken into the nearest vector chart that shares half of their width."""
    strip = (F.col("kind") == "raster") & F.col("height").between(8, 36) & (F.col("width") >= 70)
    s = candidates.filter(strip).withColumn("_s", G.box())
    chart = candidates.filter("kind = 'vector'").select(F.col("doc_id").alias("cd"), F.col("page").alias("cp"), G.box().alias("_c"))
    away = F.greatest(F.lit(0.0), -G.y_overlap(F.col("_s"), F.col("_c")))
    pair = s.join(chart, (F.col("doc_id") == F.col("cd")) & (F.col("page") == F.col("cp")) & (away <= gap) & (G.horizontal_overlap_ratio(F.col("_s"), F.col("_c")) >= share))
    best = pair.groupBy("doc_id", "page", "_s").agg(F.min(F.struct(away.alias("away"), "_c")).alias("b")).select("doc_id", "page", "_s", F.col("b._c").alias("_c"))
    grown = best.groupBy("doc_id", "page", "_c").agg(F.min("_s.x").alias("sx"), F.min("_s.y").alias("sy"), F.max(G.right(F.col("_s"))).alias("sr"), F.max(G.bottom(F.col("_s"))).alias("sb"), F.count(F.lit(1)).cast("int").alias("n"))
    keep = s.join(best.select("doc_id", "page", "_s"), ["doc_id", "page", "_s"], "left_anti").drop("_s").unionByName(candidates.filter(~strip))
    rows = keep.withColumn("_c", G.box()).join(grown, ["doc_id", "page", "_c"], "left").filter((F.col("kind") == "vector") | F.col("n").isNull())
    x, y = F.least("x", F.coalesce("sx", "x")), F.least("y", F.coalesce("sy", "y"))
    r, b = F.greatest(F.col("x") + F.col("width"), F.coalesce("sr", F.lit(0.0))), F.greatest(F.col("y") + F.col("height"), F.coalesce("sb", F.lit(0.0)))
    return rows.select("doc_id", "page", "kind", x.alias("x"), y.alias("y"), (r - x).alias("width"), (b - y).alias("height"), (F.col("sources") + F.coalesce("n", F.lit(0))).alias("sources"), "boxes")


# -- more suppressions -----------------------------------------------------------------------------


def _count_within(candidates: DataFrame, others: DataFrame, share: float) -> DataFrame:
    rows = candidates.withColumn("_b", G.box())
    o = others.select(F.col("doc_id").alias("od"), F.col("page").alias("op"), G.box().alias("_o"))
    hit = G.overlap_area(F.col("_b"), F.col("_o")) >= share * G.area(F.col("_o"))
    n = rows.join(o, (F.col("doc_id") == F.col("od")) & (F.col("page") == F.col("op")) & hit).groupBy("doc_id", "page", "kind", "_b").agg(F.count(F.lit(1)).alias("within"))
    return rows.join(n, ["doc_id", "page", "kind", "_b"], "left").withColumn("within", F.coalesce("within", F.lit(0))).drop("_b")


def without_form_backplanes(candidates: DataFrame, page_area: float) -> DataFrame:
    """Without vectors of 30 % of the page behind two or more form regions."""
    counted = _count_within(candidates, candidates.filter("kind = 'form'"), 0.5)
    return counted.filter(~((F.col("kind") == "vector") & (F.col("width") * F.col("height") >= 0.3 * page_area) & (F.col("within") >= 2))).select(*candidates.columns)


def without_vector_backplanes(candidates: DataFrame, page_area: float) -> DataFrame:
    """Without vectors of 25 % of the page behind two or more rasters, unless they are dense."""
    counted = _count_within(candidates, candidates.filter("kind = 'raster'"), 0.9)
    return counted.filter(~((F.col("kind") == "vector") & (F.col("width") * F.col("height") >= 0.25 * page_area) & (F.col("within") >= 2) & (F.col("boxes") < 40))).select(*candidates.columns)


def without_table_strips(candidates: DataFrame) -> DataFrame:
    """Without narrow vectors that tables cover: column rules, not charts."""
    rows = candidates.withColumn("_b", G.box())
    t = candidates.filter("kind = 'table'").select(F.col("doc_id").alias("td"), F.col("page").alias("tp"), G.box().alias("_t"))
    strip = (F.col("kind") == "vector") & (G.overlap_area(F.col("_b"), F.col("_t")) >= 0.85 * G.area(F.col("_b"))) & (F.col("width") <= 0.5 * F.col("_t.width")) & (F.col("height") >= 0.7 * F.col("_t.height"))
    return rows.join(t, (F.col("doc_id") == F.col("td")) & (F.col("page") == F.col("tp")) & strip, "left_anti").drop("_b")


def without_chrome(candidates: DataFrame, chrome_blocks: DataFrame, share: float = 0.55) -> DataFrame:
    """Without regions that repeated blocks cover for the most part."""
    rows = candidates.withColumn("_b", G.box())
    c = chrome_blocks.filter("repeated").select(F.col("doc_id").alias("cd"), F.col("page").alias("cp"), G.box().alias("_c"))
    return rows.join(c, (F.col("doc_id") == F.col("cd")) & (F.col("page") == F.col("cp")) & (G.overlap_area(F.col("_b"), F.col("_c")) >= share * G.area(F.col("_b"))), "left_anti").drop("_b")


def equivalent_merged(candidates: DataFrame) -> DataFrame:
    """First-fit merge of candidates that are all but the same box."""
    return merged(candidates, 0.98, 0.98)


def page_diagrams(blocks: DataFrame, vectors: DataFrame, images: DataFrame | None, page_width: float, page_height: float) -> DataFrame:
    """Pages without images whose many short blocks stand in several columns over a page-wide drawing: the blocks' hull as a region.

    At least 20 vectors, one of nearly the whole page, and 20 blocks that are neither prose nor page marks,
    at four places across or more; the hull takes 70 % of the width, 55 % of the height, at most 85 % of the page.
    """
    text = T.collapsed(F.col("text"))
    prose = ((F.length(text) >= 24) & (F.col("width") >= 0.45 * page_width) & (F.col("n_lines") <= 1)) | ((F.length(text) >= 90) & (F.col("width") >= 0.55 * page_width) & ((F.col("n_lines") >= 3) | (F.col("height") >= 0.12 * page_height)))
    mark = (F.col("y") > 0.96 * page_height) | ((F.col("y") > 0.93 * page_height) & (F.length(T.without(text, "[0-9]")) == 0)) | ((F.col("x") <= 0.06 * page_width) & (F.col("width") <= 0.05 * page_width))
    own = blocks.filter((F.length(text) > 0) & ~prose & ~mark)
    own = own.filter(~F.col("repeated")) if "repeated" in blocks.columns else own
    middle = F.when((F.col("width") <= 0.35 * page_width) & (F.col("height") <= 0.25 * page_height), F.col("x") + F.col("width") / 2)
    per = own.groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(middle)).alias("middles"), *[a.alias(n) for a, n in zip((F.min("x"), F.min("y"), F.max(F.col("x") + F.col("width")), F.max(F.col("y") + F.col("height"))), ("x0", "y0", "x1", "y1"), strict=True)])
    gap = max(36.0, 0.08 * page_width)
    start = F.struct(F.lit(0).alias("n"), F.lit(-1e9).alias("last"))
    places = F.aggregate("middles", start, lambda a, m: F.when(m - a["last"] >= gap, F.struct((a["n"] + 1).alias("n"), m.alias("last"))).otherwise(a), lambda a: a["n"])
    full = (F.col("width") >= 0.9 * page_width) & (F.col("height") >= 0.9 * page_height)
    drawn = vectors.groupBy("doc_id", "page").agg(F.count(F.lit(1)).cast("int").alias("boxes"), F.max(full).alias("full")).filter("full and boxes >= 20")
    rows = per.filter((F.col("n") >= 20) & (places >= 4)).join(drawn, ["doc_id", "page"])
    if images is not None:
        rows = rows.join(images.select("doc_id", "page").distinct(), ["doc_id", "page"], "left_anti")
    x, y = F.greatest(F.lit(0.0), "x0"), F.greatest(F.lit(0.0), "y0")
    w, h = F.least(F.lit(page_width), "x1") - x, F.least(F.lit(page_height), "y1") - y
    rows = rows.select("doc_id", "page", F.lit("vector").alias("kind"), x.alias("x"), y.alias("y"), w.alias("width"), h.alias("height"), F.lit(1).alias("sources"), "boxes")
    return rows.filter((F.col("width") >= 0.7 * page_width) & (F.col("height") >= 0.55 * page_height) & (F.col("width") * F.col("height") <= 0.85 * page_width * page_height))


def _nearly_full(page_width: float, page_height: float) -> Column:
    return (F.col("width") >= 0.9 * page_width) & (F.col("height") >= 0.9 * page_height)


def without_blank_pages(candidates: DataFrame, pages: DataFrame) -> DataFrame:
    """Without the regions of pages that a render shows to be blank."""
    return candidates.join(pages.filter("visual_status = 'blank'").select("doc_id", "page"), ["doc_id", "page"], "left_anti")


def without_low_content_scans(candidates: DataFrame, pages: DataFrame, blocks: DataFrame, others: list[DataFrame], page_width: float, page_height: float) -> DataFrame:
    """Without full-page rasters of pages of which a render shows next to nothing and no other evidence says more."""
    low = pages.filter("native_text_status = 'empty_but_visual_content' and render_content_ratio <= 0.02").select("doc_id", "page")
    for other in [blocks.filter(F.length(F.trim("text")) > 0), *others]:
        low = low.join(other.select("doc_id", "page").distinct(), ["doc_id", "page"], "left_anti")
    scan = (F.col("kind") == "raster") & _nearly_full(page_width, page_height)
    return candidates.filter(~scan).unionByName(candidates.filter(scan).join(low, ["doc_id", "page"], "left_anti"))


def without_lone_backplanes(candidates: DataFrame, pages: DataFrame, images: DataFrame, page_width: float, page_height: float) -> DataFrame:
    """Without full-page vectors of one source, unless they are all that a page shows."""
    only = pages.filter("native_text_status = 'empty_but_visual_content' and (visual_status is null or visual_status <> 'blank') and char_count = 0").select("doc_id", "page").join(images.select("doc_id", "page").distinct(), ["doc_id", "page"], "left_anti")
    plane = (F.col("kind") == "vector") & (F.col("sources") == 1) & _nearly_full(page_width, page_height)
    return candidates.filter(~plane).unionByName(candidates.filter(plane).join(only, ["doc_id", "page"], "left_semi"))


_LABELLED = _SCHEMA + ", caption string, label string"


def settled(candidates: DataFrame) -> DataFrame:
    """Candidates with caption and label (null: none), put together where they are one thing, in order within a page.

    A table takes the nearest header strip right above it; tables of one label stacked closely are one; boxes all
    but the same are one; of two that share a text and overlap, the larger stays.
    """
    kinds = ["kind", "x", "y", "width", "height", "sources", "boxes", "caption", "label"]

    def page(doc: int, number: int, c: dict[str, list]) -> list[tuple]:
        rows = [dict(zip(kinds, r, strict=True)) for r in zip(*(c[k] for k in kinds), strict=True)]
        area = lambda r: r["width"] * r["height"]
        across = lambda a, b: min(a["x"] + a["width"], b["x"] + b["width"]) - max(a["x"], b["x"])
        down = lambda a, b: min(a["y"] + a["height"], b["y"] + b["height"]) - max(a["y"], b["y"])
        over = lambda a, b: max(0.0, across(a, b)) * max(0.0, down(a, b)) / max(1e-9, min(area(a), area(b)))
        alike = lambda a, b: min(area(a), area(b)) / max(1e-9, max(area(a), area(b)))
        level = lambda a, b: max(0.0, across(a, b)) / max(1e-9, min(a["width"], b["width"]))
        texts = lambda r: {t for t in (r["caption"], r["label"]) if t}

        def union(a: dict, b: dict, kind: str | None = None) -> dict:
            x, y = min(a["x"], b["x"]), min(a["y"], b["y"])
            return {
                "kind": kind or (a["kind"] if a["kind"] == b["kind"] else "mixed"), "x": x, "y": y, "width": max(a["x"] + a["width"], b["x"] + b["width"]) - x, "height": max(a["y"] + a["height"], b["y"] + b["height"]) - y,
                "sources": a["sources"] + b["sources"], "boxes": a["boxes"] + b["boxes"], "caption": a["caption"] or b["caption"], "label": a["label"] or b["label"],
            }

        def first_fit(rows: list[dict], fits, join) -> list[dict]:
            out: list[dict] = []
            for r in rows:
                at = next((i for i, o in enumerate(out) if fits(o, r)), None)
                if at is None:
                    out.append(r)
                else:
                    out[at] = join(out[at], r)
            return out

        def heads(head: dict, table: dict) -> bool:
            gap = table["y"] - (head["y"] + head["height"])
            return head["kind"] in ("table", "vector", "mixed") and head["y"] < table["y"] and head["height"] <= 0.75 * table["height"] and 0.3 * table["width"] <= head["width"] <= 1.25 * table["width"] and level(head, table) >= 0.85 and -0.18 * table["height"] <= gap <= 28

        used: set[int] = set()
        joined = []
        for i, table in enumerate(rows):
            able = [(max(0.0, table["y"] - (h["y"] + h["height"])) + abs(table["x"] - h["x"]) / 10, j) for j, h in enumerate(rows) if table["kind"] == "table" and j != i and j not in used and heads(h, table)]
            if able:
                used.add(min(able)[1])
                table = union(table, rows[min(able)[1]], "table")
            joined.append(table)
        rows = [r for i, r in enumerate(joined) if i not in used]
        gap = lambda a, b: max(a["y"] - (b["y"] + b["height"]), b["y"] - (a["y"] + a["height"]), 0.0)
        rows = first_fit(rows, lambda a, b: a["kind"] == b["kind"] == "table" and bool(texts(a) & texts(b)) and level(a, b) >= 0.9 and gap(a, b) <= 24, union)
        rows = first_fit(rows, lambda a, b: over(a, b) >= 0.98 and alike(a, b) >= 0.98, union)
        same = lambda a, b: bool(texts(a) & texts(b)) and over(a, b) >= 0.6 and (alike(a, b) >= 0.5 or (a["kind"] != b["kind"] and a["caption"] is not None and a["caption"] == b["caption"] and over(a, b) >= 0.8))
        larger = lambda a, b: max((a, b), key=area) | {"sources": a["sources"] + b["sources"], "boxes": a["boxes"] + b["boxes"]}
        rows = first_fit(rows, same, larger)
        return [(doc, number, *(r[k] for k in kinds)) for r in rows]

    return by_page(candidates, kinds, ["y", "x", "width", "height", "kind"], page, _LABELLED)
