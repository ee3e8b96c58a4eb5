"""Operators on small evidence, and every registered query against its SQL."""

import os

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from leafweir import catalogue
from leafweir.operators import chrome, document, forms, layout, ocr, quality, regions, rules, search
from leafweir.plans import process, report
from leafweir.sources import cache, files
from leafweir.streaming import landing

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(
    ("spec", "total", "want"),
    [("1-3,7,9-10", 10, ([1, 2, 3, 7, 9, 10], [], False)), ("5,1,3,1", 10, ([1, 3, 5], [], False)), ("1-100", 5, ([1, 2, 3, 4, 5], list(range(6, 101)), False)), ("4-400", 5, ([4, 5], list(range(6, 106)), True))],
)
def test_page_ranges(spec, total, want):
    assert quality.parse_ranges(spec, total) == want


@pytest.mark.parametrize("spec", ["abc", "0", "5-1", "11-20", "1,,3", "1-2-3", "", "-1"])
def test_bad_page_ranges(spec):
    with pytest.raises(ValueError):
        quality.parse_ranges(spec, 10)


def test_islands(spark):
    rows = spark.createDataFrame([(1, p) for p in (1, 2, 3, 7, 9, 10, 9)], "doc_id long, page int")
    assert quality.page_ranges(rows, ["doc_id"]).first().ranges == "1-3, 7, 9-10"
    assert quality.select_pages(rows, "2-7,10").count() == 4


@pytest.mark.parametrize(
    ("npr", "chars", "coverage", "images", "vectors", "content", "want"),
    [
        (0.3, 9, 0.5, 0, 0, None, "unusable_glyph_indices"), (0.05, 9, 0.5, 0, 0, None, "mixed_glyph_indices"), (0.0, 9, 0.5, 0, 0, 0.0, "sparse_text_on_blank_visual"),
        (0.0, 200, 0.01, 1, 0, None, "sparse_text_with_visual_content"), (0.0, 40, 0.9, 0, 250, None, "sparse_text_with_visual_content"), (0.0, 201, 0.01, 1, 0, None, "ok"),
        (0.0, 0, 0.0, 1, 0, None, "empty_but_visual_content"), (0.0, 0, 0.0, 0, 0, None, "empty"), (0.0, 0, 0.0, 0, 0, 0.01, "empty_but_visual_content"), (0.0, 0, 0.0, 1, 0, 0.0, "empty"),
    ],
)
def test_text_status(spark, npr, chars, coverage, images, vectors, content, want):
    c = F.lit(content).cast("double")
    visual = quality.visual_status(c, F.lit(chars > 0), F.lit(images + vectors > 0), F.lit(False))
    assert spark.range(1).select(quality.native_text_status(F.lit(npr), F.lit(chars), F.lit(coverage), F.lit(images), F.lit(vectors), visual).alias("s")).first().s == want


BLOCK = "doc_id long, page int, block int, text string, x double, y double, width double, height double, font_size double, n_lines long"


def with_lines(df):
    """Blocks whose lines are their text's, each as high as its share of the block."""
    said = F.split("text", "\n")
    h = F.col("height") / F.size(said)
    line = lambda t, i: F.struct(i.alias("line"), t.alias("text"), F.lit(True).alias("start"), F.col("x").alias("x"), (F.col("y") + i * h).alias("y"), F.col("width").alias("width"), h.alias("height"), F.col("font_size").alias("font_size"))
    return df.withColumn("lines", F.transform(said, line))


def marked(spark, rows, height=792.0):
    return chrome.mark_repeated(with_lines(spark.createDataFrame(rows, BLOCK)), 612.0, height)


def test_chrome(spark):
    rows = [(1, p, b, t, 50.0, y, 100.0, 10.0, 10.0, 1) for p in (1, 2, 3) for b, t, y in ((0, f"Report  page {p}", 30.0), (1, f"body {'abc'[p - 1]}", 728.0), (2, "Footer" if p < 3 else "Other", 740.0), (3, f"Row total {7 * p} units", 400.0), (4, "Same", 410.0))]
    found = marked(spark, rows).collect()
    # rows amid the page stay, whatever they share; labels count pages only at the edge
    assert {(r.page, r.block) for r in found if r.repeated} == {(1, 0), (2, 0), (3, 0), (1, 2), (2, 2)}
    near = chrome.body_near_chrome(spark.createDataFrame(found)).collect()
    assert {(r.page, r.block, r.other_block, r.overlap, r.gap) for r in near} == {(1, 1, 2, None, 2.0), (2, 1, 2, None, 2.0)}
    body = {r.page: r.body for r in chrome.body_text(spark.createDataFrame(found)).collect()}
    assert body == {1: "body a\nRow total 7 units\nSame", 2: "body b\nRow total 14 units\nSame", 3: "body c\nOther\nRow total 21 units\nSame"}


def test_only_labels_lose_their_digits(spark):
    text = [lambda p: f"Total 1{p} of the year", lambda p: f"{p} 4", lambda p: f"Slide {p}: results of all the towns", lambda p: f"p.{p} of it all", lambda p: "Yes."]
    for k, t in enumerate(text):
        rows = [(1, p, 0, t(p), 50.0, 20.0, 150.0, 10.0, 10.0, 1) for p in (1, 2)]
        assert {r.repeated for r in marked(spark, rows).collect()} == {k in (2, 3)}
    rows = [(1, p, 0, f"{p} 4", 50.0, 20.0, 30.0, 10.0, 10.0, 1) for p in (1, 2)]
    assert {r.repeated for r in marked(spark, rows).collect()} == {True}
    # on one page nothing repeats; heights may differ by what rounds to 5 points alike
    assert not any(r.repeated for r in marked(spark, rows[:1]).collect())
    assert {r.repeated for r in marked(spark, [(1, 1, 0, "Head", 9.0, 22.4, 30.0, 9.0, 9.0, 1), (1, 2, 0, "Head", 9.0, 18.0, 30.0, 9.0, 9.0, 1)]).collect()} == {True}
    assert {r.repeated for r in marked(spark, [(1, 1, 0, "Head", 9.0, 22.5, 30.0, 9.0, 9.0, 1), (1, 2, 0, "Head", 9.0, 22.4, 30.0, 9.0, 9.0, 1)]).collect()} == {False}


def test_a_foot_is_cut_where_its_lines_differ(spark):
    rows = [(1, p, 0, f"Issued by the office of records\nsheet of {'xyz'[p - 1] * 9}", 36.0, 765.0, 300.0, 20.0, 10.0, 2) for p in (1, 2, 3)]
    got = sorted((r.page, r.block, r.text, r.repeated, r.y, r.height, r.n_lines) for r in marked(spark, rows).collect())
    assert got[:2] == [(1, 0, "Issued by the office of records", True, 765.0, 10.0, 1), (1, 1, "sheet of xxxxxxxxx", False, 775.0, 10.0, 1)] and len(got) == 6


def test_marks_down_the_page_s_side(spark):
    kind = BLOCK + ", writing_mode string"
    run = lambda p, text: (1, p, 0, text, 590.0, 100.0, 14.0, 120.0, 10.0, 1, "vertical")
    sign = lambda p, text: (1, p, 1, text, 588.0, 225.0, 16.0, 16.0, 10.0, 1, "horizontal")
    far = lambda p: (1, p, 2, "3", 20.0, 225.0, 16.0, 16.0, 10.0, 1, "horizontal")
    rows = [run(1, "防災の備え"), sign(1, "第3章"), far(1), run(2, "防災の備え"), sign(2, "第３章"), far(2), run(3, "ほかの章"), sign(3, "4")]
    got = chrome.mark_page_edges(spark.createDataFrame(rows, kind), 612.0, 792.0).filter("repeated").collect()
    assert {(r.page, r.block) for r in got} == {(1, 0), (1, 1), (2, 0), (2, 1)}
    one = chrome.mark_page_edges(spark.createDataFrame([run(1, "第3章"), sign(1, "4"), far(1)], kind), 612.0, 792.0).filter("repeated").collect()
    assert {(r.page, r.block) for r in one} == {(1, 0), (1, 1)}


def test_edges(spark):
    rows = [(1, 1, 0, "inside", 10.0, 10.0, 50.0, 10.0, 10.0, 1), (1, 1, 1, "right", 580.0, 10.0, 50.0, 10.0, 10.0, 1), (1, 1, 2, "left and low", -9.0, 790.0, 50.0, 20.0, 10.0, 1), (1, 1, 3, "a little", 562.0, 10.0, 52.0, 10.0, 10.0, 1)]
    got = {(r.block, r.detail) for r in rules.off_page(spark.createDataFrame(rows, BLOCK), 612.0, 792.0).collect()}
    assert got == {(1, "right"), (2, "left/bottom")}
    low = [(1, 1, i, t, 36.0, 770.0, w, 12.0, 12.0, 1) for i, (t, w) in enumerate([("Body text that ends low", 500.0), ("12", 20.0), ("xiv", 20.0), ("page 3 of 9", 80.0), ("see https://example.com", 400.0), ("March 3, 2021", 100.0)])]
    assert [r.block for r in rules.near_bottom_edge(spark.createDataFrame(low, BLOCK), 612.0, 792.0).collect()] == [0]
    runs = [(1, 1, 0, "a run over the edge", 520.0, 10.0, 100.0, 10.0, 10.0, 1), (1, 1, 1, "ends with a stop.", 520.0, 10.0, 100.0, 10.0, 10.0, 1), (1, 1, 2, "far over the edge", 600.0, 10.0, 100.0, 10.0, 10.0, 1), (1, 1, 3, "short", 580.0, 10.0, 40.0, 10.0, 10.0, 1)]
    assert [r.detail for r in rules.page_edge_truncated(spark.createDataFrame(runs, BLOCK), 612.0, 792.0).collect()] == ["right:1"]


def test_truncated_blocks_are_not_off_page(spark):
    rows = spark.createDataFrame([(1, 1, "off_page", "error", 3, "right"), (1, 1, "off_page", "error", 4, "right"), (1, 1, "page_edge_text_truncated", "error", 3, ""), (1, 1, "dot_leader_noise", "warning", None, "")], "doc_id long, page int, code string, severity string, block int, detail string")
    assert [(r.code, r.block) for r in rules.settle(rows).orderBy("rank").collect()] == [("off_page", 4), ("page_edge_text_truncated", 3), ("dot_leader_noise", None)]


def test_text_under_fill(spark):
    spans = spark.createDataFrame([(1, 1, 1, "secret", 10.0, 20.0, 100.0, 10.0), (1, 1, 3, "later text", 10.0, 20.0, 100.0, 10.0), (1, 1, 1, "beside", 300.0, 20.0, 50.0, 10.0)], "doc_id long, page int, run int, text string, x double, y double, width double, height double")
    fills = spark.createDataFrame([(1, 1, 9.0, 19.0, 110.0, 12.0, 2)], "doc_id long, page int, x double, y double, width double, height double, preceding_runs int")
    assert rules.text_under_fill(spans, fills).first().detail == "1"


SPAN = "doc_id long, page int, ord int, text string, x double, y double, width double, height double, font_size double"


def span(i, text, x, y, size=10.0):
    return (1, 1, i, text, float(x), float(y), len(text) * size * 0.5, size, size)


def test_lines_from_spans(spark):
    rows = [span(0, "Hello", 10, 100), span(1, "world", 40, 102), span(2, "far", 300, 100), span(3, "next", 10, 120), span(4, "er", 30, 120)]
    got = layout.lines_from_spans(spark.createDataFrame(rows, SPAN)).orderBy("line").collect()
    assert [(r.text, r.x) for r in got] == [("Hello world", 10.0), ("far", 300.0), ("nexter", 10.0)]


def test_slow_drift_anchors_on_the_first(spark):
    rows = [span(i, f"w{i}", 10 + 40 * i, 100 + 3 * i) for i in range(4)]
    got = layout.lines_from_spans(spark.createDataFrame(rows, SPAN), gutter_em=99).orderBy("line").collect()
    assert [r.text for r in got] == ["w0 w1", "w2 w3"]


def test_columns_are_read_one_after_the_other(spark):
    rows = [(1, 1, i, t, float(x), float(y), float(w), 10.0, 10.0, 1) for i, (t, x, y, w) in enumerate([("title", 36, 30, 540), ("r1", 320, 60, 200), ("l1", 36, 60, 200), ("l2", 36, 90, 200), ("r2", 320, 90, 200), ("end", 36, 200, 540)])]
    got = layout.column_order(spark.createDataFrame(rows, BLOCK), 612.0).orderBy("ord").collect()
    assert [r.text for r in got] == ["title", "l1", "l2", "r1", "r2", "end"]


def test_items_drawn_twice(spark):
    rows = [(1, 1, 0, "A", 5.0, 10.0, [1.0, 0.0, 0.0, 1.0, 5.0, 5.0], "f", False), (1, 1, 1, "A", 5.0001, 10.0, [1.0, 0.0, 0.0, 1.0, 5.0001, 5.0], "f", True), (1, 1, 2, "A", 5.0, 10.0, [1.0, 0.0, 0.0, 1.0, 50.0, 5.0], "f", False)]
    got = layout.dedupe_items(spark.createDataFrame(rows, "doc_id long, page int, ord int, str string, width double, height double, transform array<double>, font_name string, has_eol boolean")).orderBy("ord").collect()
    assert [(r.ord, r.has_eol) for r in got] == [(0, True), (2, False)]


def test_currency_is_folded(spark):
    rows = [(1, 1, 0, i, t) for i, t in enumerate(["Total", "$", "12", "$", "x"])]
    got = layout.currency_folded(spark.createDataFrame(rows, "doc_id long, page int, line int, word int, text string")).orderBy("word").collect()
    assert [r.text for r in got] == ["Total", "$ 12", "$", "x"]


LINE = "doc_id long, page int, line int, text string, x double, y double, width double, height double"


@pytest.fixture(scope="module")
def page(spark):
    said = ["Abc needle in NEEDLE", "no such", "hy-", "phen here", "日 本 語 text", "needle"]
    return spark.createDataFrame([(1, 1, i, t, 10.0, 20.0 * i, 6.0 * len(t), 12.0) for i, t in enumerate(said)], LINE)


def test_search(page):
    got = search.matches(page, search.compile_queries(["needle", "日本"])).orderBy("line", "start").collect()
    assert [(r.line, r.start, r.match, r.query) for r in got] == [(0, 4, "needle", 0), (0, 14, "NEEDLE", 0), (4, 0, "日 本", 1), (5, 0, "needle", 0)]
    assert (got[0].x, got[0].width) == (34.0, 36.0)
    assert search.matches(page, search.compile_queries("needle", case_sensitive=True)).count() == 2
    assert search.matches(page, search.compile_queries(r"n\w+e", regex=True)).count() == 3
    assert search.capped(search.matches(page, search.compile_queries("needle")), 1).count() == 1
    assert [r.text for r in search.hyphenated(page).collect()] == ["hyphen"]
    assert search.with_context(search.matches(page, search.compile_queries("such")), page).first().context == "no such"
    region = search.crop_region(search.matches(page, search.compile_queries("such")), page, 612.0, 792.0).first().region
    assert (region.x, region.y, region.width) == (0.0, 8.0, 64.0)


def test_matches_of_nothing_keep_places(spark):
    rows = spark.createDataFrame([(1, 1, 0, "abxcx", 0.0, 0.0, 50.0, 10.0), (1, 1, 1, "\ufdd0x\ufdd1x", 0.0, 0.0, 40.0, 10.0)], "doc_id long, page int, line int, text string, x double, y double, width double, height double")
    got = sorted((r.line, r.match, r.start, r.x) for r in search.matches(rows, search.compile_queries("(?=a)|x", regex=True)).collect())
    assert got == [(0, "x", 2, 20.0), (0, "x", 4, 40.0), (1, "x", 1, 10.0), (1, "x", 3, 30.0)]


def test_time_runs_out_by_page_and_document(spark):
    line = lambda d, p, n, t: (d, p, n, t, 0.0, 0.0, 10.0, 10.0)
    rows = [line(1, p, 0, "a" * 40 + "b") for p in range(1, 6)] + [line(2, 1, 0, "aa")]
    frame = spark.createDataFrame(rows, "doc_id long, page int, line int, text string, x double, y double, width double, height double").coalesce(1)
    got = {(r.doc_id, r.page): (r.match, r.timed_out) for r in search.matches_guarded(frame, search.compile_queries("^(a|aa)+$", regex=True), 0.2, 0.5).collect()}
    assert got == {**{(1, p): (None, True) for p in range(1, 6)}, (2, 1): ("aa", False)}
    pages = spark.createDataFrame([(1, p, c) for p, c in ((1, 400.0), (2, 5000.0), (3, 599.0), (4, 1.0))], "doc_id long, page int, cost_ms double")
    assert [r.searched for r in search.budget(pages, 1000, 1999).orderBy("page").collect()] == [True, True, True, False]


def test_joined_lines_match_over_the_joint(spark):
    line = lambda n, t, x, y: (1, 1, n, t, x, y, 60.0, 10.0)
    rows = spark.createDataFrame([line(0, "about docu-", 0.0, 0.0), line(1, "ments of docu", 0.0, 12.0), line(2, "First", 300.0, 0.0), line(3, "name", 300.0, 12.0)], "doc_id long, page int, line int, text string, x double, y double, width double, height double")
    hit = lambda q: sorted((r.line, r.match) for r in search.across_lines(rows, search.compile_queries(q)).collect())
    assert hit("documents") == [(0, "documents")] and hit("about") == [] and hit("first name") == [(2, "First name")]
    assert sorted(r.line for r in search.everywhere(rows, search.compile_queries("docu")).collect()) == [0, 1]


@pytest.mark.parametrize("bad", ["", "   ", ["ok", ""]])
def test_empty_queries(bad):
    with pytest.raises(ValueError):
        search.compile_queries(bad)
    with pytest.raises(ValueError):
        search.compile_queries("(", regex=True)


def test_runaway_patterns_time_out(spark):
    rows = spark.createDataFrame([(1, 1, 0, "a" * 60 + "b"), (1, 1, 1, "aa")], "doc_id long, page int, line int, text string")
    rows = rows.withColumns({c: F.lit(1.0) for c in ("x", "y", "width", "height")})
    got = {r.line: (r.match, r.timed_out) for r in search.matches_guarded(rows, search.compile_queries("^(a|aa)+$", regex=True), page_seconds=0.3).collect()}
    assert got == {0: (None, True), 1: ("aa", False)}


def test_bag_difference(spark):
    kind = "doc_id long, page int, query int, line int, start int, match string"
    native = spark.createDataFrame([(1, 1, 0, 0, 0, "A"), (1, 1, 0, 1, 0, "a")], kind)
    seen = spark.createDataFrame([(1, 1, 0, i, 0, "a") for i in range(4)] + [(1, 1, 0, 9, 0, "b")], kind)
    assert sorted(r.line for r in search.bag_difference(native, seen).collect()) == [2, 3, 9]


def test_forms(spark):
    raw = spark.createDataFrame([(1, 1, 0, [100.0, 700.0, 160.0, 720.0], 6)], "doc_id long, page int, link int, rect array<double>, flags int")
    box = forms.boxed(raw, 792.0).first()
    assert (box.x, box.y, box.width, box.height, box.flag_names) == (100.0, 72.0, 60.0, 20.0, ["hidden", "print"])
    lines = spark.createDataFrame([(1, 1, 0, "Name", 40.0, 100.0, 30.0, 10.0), (1, 1, 1, "Above", 80.0, 60.0, 60.0, 10.0), (1, 1, 2, "Far", 40.0, 600.0, 30.0, 10.0)], LINE)
    fields = spark.createDataFrame([(1, 1, 0, 80.0, 100.0, 100.0, 10.0), (1, 1, 1, 500.0, 300.0, 20.0, 10.0)], "doc_id long, page int, field int, x double, y double, width double, height double")
    got = {r.field: (r.label, r.relation) for r in forms.nearest_label(fields, lines).collect()}
    assert got == {0: ("Name", "left"), 1: (None, None)}
    links = fields.withColumnRenamed("field", "link").withColumns({"x": F.lit(39.0), "y": F.lit(99.0), "width": F.lit(40.0), "height": F.lit(12.0)})
    assert forms.link_text(links, lines).first().text == "Name"


def test_ocr(spark):
    rows = spark.createDataFrame([(1, "hello world", "olleh dlrow", 0.9), (2, "hello world", "hello world", 0.9), (3, "hello world", "olleh dlrow", 0.5)], "doc_id long, native string, ocr string, confidence double")
    assert [r.doc_id for r in ocr.native_mismatch(rows).collect()] == [1]
    long = "some words that go on for quite a while " * 5
    lost = spark.createDataFrame([(1, long.replace(" ", ""), long, 0.9), (2, long, long, 0.9)], "doc_id long, native string, ocr string, confidence double")
    assert [r.doc_id for r in ocr.spacing_loss(lost).collect()] == [1]
    words = spark.createDataFrame([(1, 1, i, t, float(x), float(y), 20.0, 10.0) for i, (t, x, y) in enumerate([("b", 40, 1), ("a", 10, 0), ("c", 10, 30)])], "doc_id long, page int, word int, text string, x double, y double, width double, height double")
    assert [r.text for r in ocr.words_to_lines(words).orderBy("line").collect()] == ["a b", "c"]


def test_spacing_loss_on_whole_pages(spark):
    long = "some words that go on for quite a while " * 90
    tail = long[:2400] + long[2400:].replace(" ", "")
    rows = [(1, long.replace(" ", ""), long), (2, long, long), (3, long.replace(" ", "").replace("w", "x").replace("o", "y"), long), (4, tail[:600], long[:600]), (5, long[:2400].replace(" ", "") + long[2400:], long)]
    pairs = spark.createDataFrame([(*r, 0.9) for r in rows], "doc_id long, native string, ocr string, confidence double")
    assert sorted(r.doc_id for r in ocr.spacing_loss(pairs).collect()) == [1, 5]
    assert sorted(r.doc_id for r in ocr.page_spacing_loss(pairs).collect()) == [1, 5]


def test_seven_tenths_of_the_spaces_are_few_enough(spark):
    pairs = spark.createDataFrame([(d, " ".join(["ab"] * (n + 1)) + "cd" * (90 - n), " ".join(["ab"] * (n + 1) + ["cd"] * (90 - n)), 0.9) for d, n in ((1, 63), (2, 64))], "doc_id long, native string, ocr string, confidence double")
    assert [(r.doc_id, r.native_spaces, r.ocr_spaces) for r in ocr.spacing_loss(pairs).collect()] == [(1, 63, 90)]


def test_the_plan_warns_of_body_near_chrome(spark):
    from leafweir.plans import process

    text = "\n".join(line for title in ("Apples", "Pears") for line in (title, "Chrome on each page", *[f"A body line about {title.lower()} that goes on and ends with a stop."] * 38))
    docs = spark.createDataFrame([(1, text, "src0")], "doc_id long, text string, source string")
    found = process.process(docs).warnings.filter("code = 'body_near_repeated_chrome'").select("page", "block").collect()
    assert {(1, 0), (2, 0)} <= {tuple(r) for r in found}



def test_regions(spark):
    vectors = spark.createDataFrame([(1, 1, 120.0 + 14 * (i % 20), 150.0 + 14 * (i // 20), 6.0, 6.0) for i in range(260)] + [(1, 1, 500.0, 700.0, 5.0, 5.0)], "doc_id long, page int, x double, y double, width double, height double")
    images = spark.createDataFrame([(1, 1, 0, 100.0, 400.0, 200.0, 100.0), (1, 1, 1, 110.0, 410.0, 90.0, 90.0), (1, 1, 2, 0.0, 0.0, 612.0, 792.0)], "doc_id long, page int, image int, x double, y double, width double, height double")
    lines = spark.createDataFrame([(1, 1, 0, "Figure 3 shows", 100.0, 505.0, 90.0, 10.0)], LINE)
    got = regions.build(images.filter("image < 2"), vectors, lines, 612.0, 792.0).orderBy("region").collect()
    assert [(r.kind, r.caption) for r in got] == [("vector", None), ("raster", "Figure 3 shows")]
    assert regions.without_background(regions.raster_candidates(images, 612.0, 792.0), 612.0, 792.0).count() == 2
    assert regions.without_background(regions.raster_candidates(images.filter("image = 2"), 612.0, 792.0), 612.0, 792.0).count() == 1


def test_documents(spark, tmp_path):
    good, cut = b"%PDF-1.4 some text %%EOF", b"%PDF-1.4 some"
    for name, data in (("a.pdf", good), ("b.pdf", cut), ("c.pdf", b"hello"), ("d.txt", good)):
        (tmp_path / name).write_bytes(data)
    got = {os.path.basename(r.path): r.state for r in files.read_documents(spark, str(tmp_path)).collect()}
    assert got == {"a.pdf": "ok", "b.pdf": "truncated", "c.pdf": "not_pdf"}
    assert files.read_documents(spark, str(tmp_path), most_bytes=10).count() == 1
    rows = spark.createDataFrame([(1, "A.txt", b"x"), (1, "a.txt", b"y"), (1, "A.txt", b"x"), (1, "b/c.txt", b"z")], "doc_id long, name string, content binary")
    names = [r.file_name for r in document.merge_attachments(rows, rows).orderBy("ordinal").collect()]
    assert names == ["a-2.txt", "A.txt", "b_c.txt"]
    nodes = spark.createDataFrame([(1, 1, None, 0, "One", "u", None), (1, 2, 1, 0, "", None, None), (1, 3, 2, 0, "Deep", None, "d")], "doc_id long, node int, parent int, ord int, title string, url string, dest string")
    assert [(r.title, r.depth, r.type) for r in document.outline(nodes).orderBy("path").collect()] == [("One", 1, "url"), ("Deep", 2, "destination")]


@pytest.mark.parametrize("url", ["http://127.0.0.1/x", "http://10.1.2.3", "http://[::1]/", "http://169.254.1.1", "ftp://example.com", "http://"])
def test_private_hosts_are_refused(url):
    with pytest.raises(ValueError):
        document.assert_routable(url)
    with pytest.raises(ValueError):
        document.assert_routable("http://sly.example", lambda *_: [(0, 0, 0, "", ("192.168.0.1", 80))])
    assert document.assert_routable("http://93.184.216.34/")


def test_cache(spark, tmp_path):
    root, key = str(tmp_path / "cache"), cache.cache_key({"pages": "1-2", "password": "s", "scale": None})
    assert key == cache.cache_key({"password": "s", "pages": "1-2"}) != cache.cache_key({"pages": "1-2", "password": "t"})
    assert cache.get(spark, root, key) is None
    cache.put(spark.createDataFrame([("f1", 1), ("f2", 2)], "fingerprint string, n int"), root, key)
    cache.put(spark.createDataFrame([("f1", 5)], "fingerprint string, n int"), root, key)
    assert sorted(r.n for r in cache.get(spark, root, key).collect()) == [2, 5]
    assert cache.drop(spark, root, key) and cache.get(spark, root, key) is None


def test_landing_folder_as_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, data in (("a.pdf", b"%PDF-1 %%EOF"), ("b.pdf", b"%PDF-1 %%EOF"), ("c.pdf", b"%PDF-2 %%EOF")):
        (tmp_path / "in" / name).write_bytes(data)
    spark.conf.set("spark.sql.streaming.schemaInference", "true")
    stream = landing.new_documents(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("landed").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    stream.awaitTermination(60)
    assert spark.table("landed").count() == 2


def test_data_source(spark, tmp_path):
    (tmp_path / "x.txt").write_text("one\ftwo")
    spark.dataSource.register(files.EvidenceSource)
    got = spark.read.format("leafweir_evidence").option("paths", str(tmp_path / "x.txt")).load().orderBy("page").collect()
    assert [(r.page, r.text) for r in got] == [(1, "one"), (2, "two")]


def test_reports(spark):
    assert report.encode_table({"pages": [{"a": 1, "b": "x, y"}, {"a": 2, "b": "z"}], "n": None}) == 'pages[2]{a,b}:\n  1,"x, y"\n  2,z\nn: null'
    assert report.encode_table({"a": {"b": [1, True]}, "c": []}) == "a:\n  b[2]: 1,true\nc[0]:"
    rows = spark.createDataFrame([(1, 0, ["h", "i|j"]), (1, 1, ["1", None])], "doc_id long, row int, cells array<string>")
    assert report.markdown_table(rows, ["doc_id"], "row").first().markdown == "| h | i\\|j |\n| --- | --- |\n| 1 |  |"
    sections = spark.createDataFrame([(1, p, "x" * 10) for p in range(1, 6)], "doc_id long, page int, section string")
    assert report.within_budget(sections, 35).count() == 3 and report.markdown(sections, 35).first().markdown.endswith("[... 2 more pages]")
    assert spark.range(1).select(report.escape_xml(F.lit('<a&"\x01>')).alias("x")).first().x == "&lt;a&amp;&quot;�&gt;"


@pytest.mark.parametrize("bad", [{"format": "pdf"}, {"matches_only": True}, {"strip_repeated": True, "format": "json"}, {"map": True, "format": "xml"}, {"scale": 5.0}])
def test_options(bad):
    with pytest.raises(ValueError):
        process.Options(**bad)


@pytest.mark.parametrize("options", [{}, {"format": "json"}, {"format": "xml"}, {"format": "table"}, {"map": True}, {"strip_repeated": True, "pages": "1-2"}, {"search": ["the"], "matches_only": True}])
def test_whole_plan(spark, options):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(30)
    assert process.process_to_text(docs, process.Options(**options)).count() > 0


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for name in os.listdir(SF):
        db.sql(f"create view {name.removesuffix('.parquet')} as select * from '{SF}/{name}'")
    return db


def plain(df):
    df = df[sorted(df.columns)]
    say = lambda v: "" if v is None or pd.isna(v) else f"{float(v):.9g}" if isinstance(v, int | float) or hasattr(v, "dtype") else str(v)
    return sorted(tuple(map(say, row)) for row in df.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF).toPandas()
    if name in catalogue.ORACLE_SQL:
        assert plain(got) == plain(duck.sql(catalogue.ORACLE_SQL[name]).df())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
