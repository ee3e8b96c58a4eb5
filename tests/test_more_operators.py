"""Graphics, page text, vertical text, reading order, tables, labels, regions, rendering, tools."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafweir.operators import graphics, labels, pagetext, reading, regions, tables, vertical
from leafweir.plans import render, tools

OPS = "doc_id long, page int, ord int, fn string, args array<double>, text string"
BOXES = "doc_id long, page int, kind string, x double, y double, width double, height double, sources int, boxes int"


def ops(spark, *rows):
    return spark.createDataFrame([(1, 1, i, fn, None if a is None else [float(v) for v in a], t) for i, (fn, a, t) in enumerate(rows)], OPS)


def test_image_boxes_follow_the_matrix(spark):
    got = graphics.interpret(ops(spark, ("save", None, None), ("transform", [50, 0, 0, 50, 100, 600], None), ("paint_image", None, None), ("restore", None, None), ("transform", [10, 0, 0, 10, 0, 0], None), ("paint_image", None, None)), 612.0, 792.0)
    assert [(r.x, r.y, r.width, r.height) for r in graphics.of_kind(got, "image").orderBy("image").collect()] == [(100.0, 142.0, 50.0, 50.0), (0.0, 782.0, 10.0, 10.0)]


def test_fills_and_runs(spark):
    stream = ops(
        spark, ("show_text", [1, 0, 0, 1, 10, 20, 100], "Employee SSN"), ("fill_rgb", [0, 0, 0], None), ("rectangle", [10, 18, 110, 14], None), ("fill", None, None), ("show_text", [1, 0, 0, 1, 10, 20, 50], "after"),
        ("fill_rgb", [1, 1, 1], None), ("rectangle", [0, 0, 612, 792], None), ("fill", None, None), ("fill_rgb", [0, 0, 0], None), ("fill_alpha", [0.5], None), ("rectangle", [0, 0, 9, 9], None), ("fill", None, None),
        ("text_mode", [3], None), ("show_text", [1, 0, 0, 1, 0, 0, 5], "unseen"), ("rectangle", [0, 0, 5, 5], None), ("end_path", None, None), ("fill", None, None),
    )
    got = graphics.interpret(stream, 612.0, 792.0).collect()
    assert [(r.kind, r.text, r.preceding_runs) for r in got] == [("text", "Employee SSN", 1), ("vector", None, 0), ("fill", None, 1), ("text", "after", 2), ("vector", None, 0), ("invisible", "unseen", 3)]
    n = graphics.paint_counts(stream).first()
    assert (n.image_count, n.vector_count) == (0, 4)
    images = spark.createDataFrame([(1, 1, 0.0, 0.0, 612.0, 792.0)], "doc_id long, page int, x double, y double, width double, height double")
    evidence = graphics.interpret(stream, 612.0, 792.0)
    assert graphics.invisible_text(evidence, images.limit(0), 612.0 * 792).count() == 1 and graphics.invisible_text(evidence, images, 612.0 * 792).count() == 0


def test_vector_and_raster_rules(spark):
    pages = spark.createDataFrame([(1, 1, 0, 0.0, 0), (1, 2, 2000, 0.3, 0), (1, 3, 10, 0.0, 0)], "doc_id long, page int, char_count long, text_coverage double, image_count int")
    v = spark.createDataFrame([(1, p, float(90 + 20 * (i % 20)), float(90 + 20 * (i // 20)), 2.0, 2.0) for p in (1, 2, 3) for i in range(260)], "doc_id long, page int, x double, y double, width double, height double")
    area = 612.0 * 792
    assert sorted(r.page for r in graphics.dense_vectors(pages, v, area).collect()) == [1, 3]
    assert [r.page for r in graphics.vectors_without_text(pages, v, 612.0, 792.0).collect()] == [1]
    edge = v.limit(3).withColumns({"x": F.lit(0.0), "width": F.lit(0.5)})
    assert graphics.vectors_without_text(pages, edge, 612.0, 792.0).count() == 0
    images = spark.createDataFrame([(1, 1, 0, 100.0, 100.0), (1, 1, 1, 600.0, 600.0)], "doc_id long, page int, image int, width double, height double")
    assert [(r.page, r.detail) for r in graphics.raster_without_text(pages, images, area).collect()] == [(1, "1")]
    layers = spark.createDataFrame([(1, False)], "doc_id long, visible boolean")
    assert graphics.hidden_layers(pages.withColumn("optional", F.col("page") == 2), layers).first().page == 2
    said = spark.createDataFrame([(1, 1, "Please wait...")], "doc_id long, page int, text string")
    form = spark.createDataFrame([(1, True, True)], "doc_id long, xfa boolean, acro_form boolean")
    assert (lambda r: (r.code, r.severity))(graphics.xfa(form, said).first()) == ("xfa_form", "error")
    assert graphics.xfa(form, said.withColumn("text", F.lit("x"))).first().code == "xfa_fields_only"


ITEM = "doc_id long, page int, ord int, str string, x double, y double, width double, height double, font_size double, has_eol boolean"


def items(spark, *rows):
    return spark.createDataFrame([(1, 1, i, s, float(x), float(y), float(w), 10.0, 10.0, eol) for i, (s, x, y, w, eol) in enumerate(rows)], ITEM)


@pytest.mark.parametrize(
    ("rows", "text"),
    [
        ([("Hello", 0, 10, 25, False), ("world", 28, 10, 25, True), ("next", 0, 25, 20, False)], "Hello world\nnext"),
        ([("Hel", 0, 10, 15, False), ("lo", 15.5, 10, 10, False)], "Hello"),
        ([("日本", 0, 10, 20, False), ("語", 22, 10, 10, False)], "日本語"),
        ([("a", 0, 10, 5, False), ("b", 0, 60, 5, False)], "a\nb"),
        ([("see", 0, 10, 15, False), ("https://x.y", 16.2, 10, 50, False)], "see https://x.y"),
        ([("עולם", 0, 10, 20, False), ("שלום", 30, 10, 20, False)], "שלום עולם"),
    ],
)
def test_page_text(spark, rows, text):
    assert pagetext.page_text(items(spark, *rows)).first().text == text


def test_text_predicates(spark):
    say = lambda c, t: spark.range(1).select(c(F.lit(t)).alias("v")).first().v
    assert say(pagetext.prepress, "DRAFT 3 TYPESET: x") and not say(pagetext.prepress, "a draft")
    assert say(pagetext.mirrored, "(") == ")" and say(pagetext.mirrored, "()") == "()"


def word(line, k, text, x, y, size=10.0):
    return (1, 1, line, k, text, float(x), float(y), len(text) * size, size, size)


WORD = "doc_id long, page int, line int, word int, text string, x double, y double, width double, height double, font_size double"


def test_spaced_rows(spark):
    rows = spark.createDataFrame([word(0, 0, "Wide", 0, 0), word(0, 1, "set", 70, 0), word(0, 2, "row", 130, 0), word(1, 0, "日", 0, 30), word(1, 1, "本", 25, 30), word(2, 0, "no", 0, 50), word(2, 1, "gap", 21, 50), word(2, 2, "here", 52, 50)], WORD)
    assert [r.line for r in pagetext.wide_word_rows(rows, 612.0).collect()] == [0]
    assert [r.line for r in pagetext.cjk_display_rows(rows).collect()] == [1]


def test_vertical_runs_and_ruby(spark):
    rows = [word(i, 0, c, 300, 20 + 12 * i) for i, c in enumerate("縦書きの本文")] + [word(20 + i, 0, c, 280, 20 + 12 * i) for i, c in enumerate("二行目もある")] + [word(40, 0, "横", 10, 300), word(41, 0, "字", 10, 400)]
    runs = vertical.vertical_runs(spark.createDataFrame(rows, WORD)).orderBy("run").collect()
    assert [(r.text, r.glyphs) for r in runs] == [("縦書きの本文", 6), ("二行目もある", 6)]
    blocks = vertical.vertical_blocks(spark.createDataFrame(runs)).collect()
    assert [(b.text, b.columns) for b in blocks] == [("縦書きの本文\n二行目もある", 2)]
    ruby = spark.createDataFrame([word(0, 0, "かん", 0, 92, 5.0), word(0, 1, "じ", 10, 92, 5.0), word(1, 0, "漢", 0, 100), word(1, 1, "字", 10, 100), word(2, 0, "とおい", 0, 10, 5.0)], WORD)
    pairs = vertical.horizontal_ruby(ruby)
    assert sorted((r.ruby_text, r.base_text) for r in pairs.collect()) == [("かん", "漢"), ("じ", "字")]
    assert [(r.ruby, r.base) for r in vertical.merge_ruby(pairs).collect()] == [("かんじ", "漢字")]


BLOCK = "doc_id long, page int, block int, text string, x double, y double"


def test_reading_order(spark):
    said = [f"paragraph number {i} here" for i in range(8)]
    blocks = spark.createDataFrame([(1, 1, i, t, 36.0, 20.0 * i) for i, t in enumerate(said)], BLOCK)
    text = lambda order: spark.createDataFrame([(1, 1, "\n".join(said[i] for i in order), sum(len(said[i]) + 1 for i in order) - 1)], "doc_id long, page int, text string, char_count long")
    placed = lambda order: reading.native_places(blocks, text(order))
    assert reading.divergent_blocks(placed(range(8))).count() == 0 and reading.out_of_sequence(placed(range(8))).count() == 0
    assert [(r.block, r.detail) for r in reading.divergent_blocks(placed([1, 2, 3, 4, 5, 6, 7, 0])).collect()] == [(0, "late")]
    assert reading.out_of_sequence(placed([7, 6, 5, 4, 3, 2, 1, 0])).first().detail == "7/8"
    columns = spark.createDataFrame([(1, 1, i, t, 36.0 + 180 * (i // 3), 20.0 * (i % 3)) for i, t in enumerate([*said, "paragraph number 8 here"])], BLOCK)
    rows = [0, 3, 6, 1, 4, 7, 2, 5, 8]
    full = [*said, "paragraph number 8 here"]
    native = spark.createDataFrame([(1, 1, "\n".join(full[i] for i in rows), 200)], "doc_id long, page int, text string, char_count long")
    assert reading.column_lists(reading.native_places(columns, native), 612.0).count() == 1
    named = spark.createDataFrame([(1, 1, f"label {i}", 0.0, 10.0 * i) for i in range(4)], "doc_id long, page int, label string, x double, y double")
    back = spark.createDataFrame([(1, 1, "label 3 label 2 label 1 label 0")], "doc_id long, page int, text string")
    assert reading.form_labels(named, back).first().detail == "3/4"


CELL = "doc_id long, page int, line int, word int, text string, x double, y double, width double, height double"


def grid(rows, top=100.0, step=12.0, first=0):
    return [(1, 1, first + i, j, t, 40.0 + 100 * j, top + step * i, 30.0, 10.0) for i, row in enumerate(rows) for j, t in enumerate(row)]


def test_tables(spark):
    text = spark.createDataFrame(grid([["Name", "Place", "Note"]] + [["a", "b", "c"]] * 4), CELL)
    found = tables.aligned_text_tables(tables.rows_of(text)).first()
    assert (found.row_count, found.column_count, found.first_line, found.last_line) == (5, 3, 0, 4)
    numbers = spark.createDataFrame(grid([["x", "1", "2"], ["y", "3", "4"], ["z", "5", "6"]]) + grid([["far", "1", "2"], ["off", "1", "2"]], 400.0, first=10), CELL)
    assert sorted(r.row_count for r in tables.numeric_tables(tables.rows_of(numbers)).collect()) == [2, 3]
    sparse = spark.createDataFrame(grid([["h", "i"]] * 3 + [["Total", "1", "2", "3"]]), CELL)
    assert [r.line for r in tables.sparse_tables(tables.rows_of(sparse)).collect()] == [3]
    parts = spark.createDataFrame([(1, 1, 0, 10.0, 30.0, 2), (1, 1, 1, 35.0, 300.0, 20), (1, 1, 2, 400.0, 500.0, 12)], "doc_id long, page int, table int, top double, bottom double, row_count long")
    assert sorted((r.table, r.top, r.row_count) for r in tables.merge_split_headers(parts).collect()) == [(1, 10.0, 22), (2, 400.0, 12)]
    wrapped = spark.createDataFrame(grid([["Long label", "1", "2"], ["goes on"], ["Next", "3", "4"]]), CELL)
    assert [r.label for r in tables.continued_labels(tables.rows_of(wrapped)).orderBy("line").collect()] == ["Long label goes on", "Next"]


def test_labels(spark):
    region = spark.createDataFrame([(1, 1, 1, 100.0, 200.0, 300.0, 200.0)], "doc_id long, page int, region int, x double, y double, width double, height double")
    line = lambda i, t, y: (1, 1, i, t, 100.0, float(y), 120.0, 10.0)
    lines = spark.createDataFrame([line(0, "Overview of results", 130), line(1, "The numbers are:", 180), line(2, "inside text", 300), line(3, "Figure 2. Counts", 410), line(4, "Source: survey", 425), line(5, "far below", 700)], "doc_id long, page int, line int, text string, x double, y double, width double, height double")
    got = labels.attach_all(region, lines, 612.0 * 792).first()
    assert (got.caption, got.lead_in, got.inside_label, got.source) == ("Figure 2. Counts", "The numbers are:", "inside text", "Source: survey")
    assert got.heading == "The numbers are:" and got.associated[0] == "Figure 2. Counts"
    table = region.withColumns({"kind": F.lit("table"), "x": F.lit(40.0), "width": F.lit(530.0), "caption_x": F.lit(50.0), "caption_width": F.lit(200.0)})
    cut = labels.columns_clamped(table, 612.0).first()
    assert (cut.x, cut.width) == (40.0, 234.0)


def boxes(spark, *rows):
    return spark.createDataFrame([(1, 1, k, float(x), float(y), float(w), float(h), 1, n) for k, x, y, w, h, n in rows], BOXES)


def test_region_suppression(spark):
    area = 612.0 * 792
    kinds = lambda df: sorted(r.kind for r in df.collect())
    forms = boxes(spark, ("vector", 0, 0, 500, 500, 8), ("form", 10, 10, 50, 50, 3), ("form", 100, 100, 50, 50, 3))
    assert kinds(regions.without_form_backplanes(forms, area)) == ["form", "form"]
    pictures = boxes(spark, ("vector", 0, 0, 500, 500, 8), ("raster", 10, 10, 50, 50, 1), ("raster", 100, 100, 50, 50, 1))
    assert kinds(regions.without_vector_backplanes(pictures, area)) == ["raster", "raster"]
    assert kinds(regions.without_vector_backplanes(pictures.withColumn("boxes", F.lit(50)), area)) == ["raster", "raster", "vector"]
    strips = boxes(spark, ("table", 0, 0, 300, 200, 1), ("vector", 100, 10, 20, 180, 8), ("vector", 400, 10, 20, 180, 8))
    assert kinds(regions.without_table_strips(strips)) == ["table", "vector"]
    chart = boxes(spark, ("vector", 100, 100, 200, 100, 30), ("raster", 100, 205, 150, 20, 1), ("raster", 400, 400, 150, 20, 1))
    got = {(r.kind, r.height, r.sources) for r in regions.merged_strips(chart).collect()}
    assert got == {("vector", 125.0, 2), ("raster", 20.0, 1)}
    heads = spark.createDataFrame([(1, 1, True, 100.0, 100.0, 200.0, 100.0)], "doc_id long, page int, repeated boolean, x double, y double, width double, height double")
    assert kinds(regions.without_chrome(chart, heads)) == ["raster", "raster"]
    assert regions.equivalent_merged(boxes(spark, ("raster", 0, 0, 100, 100, 1), ("raster", 0, 0, 100, 100.5, 1), ("raster", 0, 0, 100, 140, 1))).count() == 2


def test_region_candidates(spark):
    fields = spark.createDataFrame([(1, 1, 10.0, 10.0 * y, 50.0, 8.0) for y in (1, 2, 3, 20, 21)], "doc_id long, page int, x double, y double, width double, height double")
    assert sorted(r.boxes for r in regions.form_candidates(fields).collect()) == [2, 3]
    grid_ = [(1, 1, 100.0, 100.0 + 20 * i, 200.0, 1.0) for i in range(6)] + [(1, 1, 100.0 + 50 * i, 100.0, 1.0, 100.0) for i in range(5)]
    ruled = regions.ruled_candidates(spark.createDataFrame(grid_, "doc_id long, page int, x double, y double, width double, height double"), least=8).collect()
    assert [(r.kind, r.boxes) for r in ruled] == [("table", 11)]
    small = fields.limit(3).withColumns({"width": F.lit(60.0), "height": F.lit(60.0), "x": F.col("y") * 5})
    assert regions.mixed_diagrams(small, fields.limit(2), 612.0 * 792).count() == 1


def test_rendering(spark):
    assert render.scale_of(None) == 2.0 and render.ocr_scale(0.5) == 2.0 and render.png_name(3) == "page-0003.png"
    assert render.ocr_languages("eng+jpn+eng") == ["eng", "jpn"]
    for bad in (lambda: render.scale_of(4.1), lambda: render.ocr_languages("e-ng"), lambda: render.region_of((0, 0, 700, 5), 612, 792)):
        with pytest.raises(ValueError):
            bad()
    assert render.crop_pixels((10, 20, 30, 40), 2, 0, 612, 792) == (20, 40, 60, 80)
    assert render.crop_pixels((10, 20, 30, 40), 1, 90, 612, 792) == (732, 10, 40, 30)
    px = np.full((10, 20, 4), 255, dtype=np.uint8)
    px[2:4, 5:9, :3] = 0
    assert render.content_stats(px.tobytes(), 20) == (0.04, (5, 2, 4, 2)) and render.content_stats(np.full((2, 2, 4), 255, dtype=np.uint8).tobytes(), 2) == (0.0, None)
    pages = spark.createDataFrame([(1, "a", 1), (1, "a", 2)], "doc_id long, path string, page int")
    got = render.with_content(render.rendered(pages, lambda path, page, scale: (px.tobytes(), 20))).collect()
    assert [(r.page, r.render_content_ratio, r.bounds) for r in got] == [(1, 0.04, [5, 2, 4, 2]), (2, 0.04, [5, 2, 4, 2])]
    names = spark.createDataFrame([(1, 1, "p.png"), (2, 1, "p.png"), (3, 1, "q.png")], "doc_id long, page int, name string")
    assert sorted(r.path for r in render.unique_paths(names).collect()) == ["p-2.png", "p.png", "q.png"]
    assert render.content_box((4, 2, 10, 6), 2.0, (1, 1)) == (2.5, 1.5, 5.0, 3.0)


def test_tools(spark):
    long = "\n".join(f"line {i} of many." for i in range(900))
    docs = spark.createDataFrame([(1, "Short text.\nTwo lines.", "s"), (2, long, "s")], "doc_id long, text string, source string")
    got = {r.doc_id: (r.kind, r.body) for r in tools.read(docs).collect()}
    assert got[1][0] == "body" and "Two lines." in got[1][1] and got[2][0] == "map" and "text:ok: 1-23" in got[2][1]
    assert tools.read(docs, "1").filter("kind = 'body'").count() == 2
    places = tools.find(docs, ["many"], most=10).collect()
    assert len(places) == 10 and places[0].left_out == 890


def test_warnings_are_found_for_documents_with_a_map_alone(spark, monkeypatch):
    from leafweir.plans import detect

    seen, plain = [], detect.detect
    monkeypatch.setattr(detect, "detect", lambda e, *size: seen.extend(r.doc_id for r in e.pages.select("doc_id").distinct().collect()) or plain(e, *size))
    docs = spark.createDataFrame([(1, "Short text.", "s"), (2, "\n".join(f"line {i}." for i in range(801)), "s"), (3, "x" * 90 * 800, "s"), (4, None, "s")], "doc_id long, text string, source string")
    assert {r.doc_id: r.kind for r in tools.read(docs).collect()} == {1: "body", 2: "map", 3: "body", 4: "body"}
    assert seen == [2]
