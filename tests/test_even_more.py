"""Predicates, bytes, document features, search sources, form details, report tables."""

import zlib

import pytest
from pyspark.sql import functions as F

from leafweir.functions import predicates as P
from leafweir.operators import document, forms, quality, search
from leafweir.plans import report
from leafweir.sources import pdfbytes


@pytest.mark.parametrize(
    ("predicate", "yes", "no"),
    [
        (P.numbered_heading, "3. Results", "3 apples"), (P.decimal_section, "2.1 Methods", "2.1"), (P.lettered_section, "A. Scope", "a. scope"), (P.sentence_fragment, "and so on", "Summary"), (P.caption, "Figure 2", "Configure 2"),
        (P.usable_label, "Name", "..."), (P.label_chrome, "Page 3 of 9", "Name of payer"), (P.field_marker, "12a", "12ab"), (P.form_section, "Part II Income", "party"), (P.item_marker, "1a. Wages", "Wages"),
        (P.dotted_texture, "." * 30, "a.b.c."), (P.unreadable_code, "xfa_form", "off_page"),
    ],
)
def test_predicates(spark, predicate, yes, no):
    col = lambda v: F.lit(v) if isinstance(v, str) else v
    row = spark.range(1).select(predicate(col(yes)).alias("a"), predicate(col(no)).alias("b")).first()
    assert row.a and not row.b


def test_names_and_labels(spark):
    row = spark.range(1).select(P.name_matches_label(F.lit("firstName"), F.lit("Your first name")).alias("a"), P.name_contradicts_label(F.lit("zipCode"), F.lit("First name")).alias("b"), P.caption_kind(F.lit("Table 3: x")).alias("k")).first()
    assert row.a and row.b and row.k == "table"


@pytest.mark.parametrize(("data", "want"), [("(a\\(b\\)\\101)", "a(b)A"), ("(nest (ed))", "nest (ed)"), ("<48 69>", "Hi"), ("<FEFF0041>", "A"), ("(open", None), ("x", None), ("<4G>", None), ("(a\\\nb)", "ab")])
def test_string_tokens(data, want):
    assert pdfbytes.string_token(data, 0) == want


def test_button_captions(spark):
    packed = b"7 0 8 52 << /T (Reset) /MK << /CA (Clear form) >> >>             << /T (No) >>"
    first = packed.index(b"<<")
    body = packed[:first].replace(b"52", str(packed.index(b"<< /T (No)") - first).encode()) + packed[first:]
    stream = zlib.compress(body)
    data = b"%PDF-1.5\n1 0 obj << /T (Go) /MK << /BG [1] /CA (Submit) >> >> endobj\n2 0 obj << /Type /ObjStm /N 2 /First " + str(first).encode() + b" /Filter /FlateDecode >> stream\n" + stream + b"\nendstream endobj %%EOF"
    assert pdfbytes.button_captions(data) == {"Go": "Submit", "Reset": "Clear form"}
    rows = spark.createDataFrame([("a", bytearray(data)), ("b", bytearray(b"")), ("c", None)], "path string, content binary")
    assert {r.path: r.captions for r in pdfbytes.captions(rows).collect()} == {"a": {"Go": "Submit", "Reset": "Clear form"}, "b": {}, "c": {}}


def test_document_features(spark):
    row = spark.range(1).select(document.permissions(F.lit(4 + 512)).alias("p"), document.permissions(F.lit(None).cast("int")).alias("all"), document.password_failure(F.lit(2)).alias("w"), document.page_mode(F.lit("UseNone")).alias("m")).first()
    assert row.p == ["print", "extract"] and len(row["all"]) == 8 and row.w == "password wrong" and row.m is None
    groups = spark.createDataFrame([(1, 1, None, 0, "a", False), (1, 2, 1, 0, "b", True), (1, 3, None, 1, "c", True)], "doc_id long, layer int, parent int, ord int, name string, visible boolean")
    assert [(r.name, r.visible, r.depth) for r in document.layer_order(groups).orderBy("path").collect()] == [("a", False, 1), ("b", False, 2), ("c", True, 1)]
    links = spark.createDataFrame([(1, "x"), (1, "y")], "doc_id long, target string")
    names = spark.createDataFrame([(1, "x", 4)], "doc_id long, name string, page int")
    assert {r.target: r.target_page for r in document.resolve_destinations(links, names).collect()} == {"x": 4, "y": None}
    ids = spark.createDataFrame([(1,), (2,)], "doc_id long")
    pages = spark.createDataFrame([(1,), (1,)], "doc_id long")
    assert {r.doc_id: (r.total_pages, r.outline_count) for r in document.features(ids, pages, pages.limit(0), pages.limit(1), pages.limit(0)).collect()} == {1: (2, 1), 2: (0, 0)}
    box = spark.range(1).select(document.run_envelope(F.array(*map(F.lit, [0.0, 10.0, -10.0, 0.0, 100.0, 50.0])), F.lit(5.0), F.lit(800.0)).alias("b")).first().b
    assert tuple(box) == (90.0, 700.0, 10.0, 50.0)


LINE = "doc_id long, page int, line int, text string, x double, y double, width double, height double"


def test_search_sources(spark):
    lines = spark.createDataFrame([(1, 1, 0, "Total", 50.0, 10.0, 30.0, 10.0), (1, 1, 1, "income", 47.0, 22.0, 36.0, 10.0), (1, 1, 2, "aside", 300.0, 22.0, 36.0, 10.0)], LINE)
    assert [r.text for r in search.stacked_labels(lines).collect()] == ["Total income"]
    spent = spark.createDataFrame([(1, p, c) for p, c in ((1, 400.0), (2, 599.0), (3, 5000.0), (4, 1.0))], "doc_id long, page int, cost_ms double")
    assert [r.searched for r in search.within_time(spent, 1000.0).orderBy("page").collect()] == [True, True, True, False]
    words = spark.createDataFrame([(1, 1, 0, 0, "Hello", 0.0, 0.0, 30.0, 10.0), (1, 1, 0, 1, "world", 36.0, 0.0, 30.0, 10.0)], "doc_id long, page int, line int, word int, text string, x double, y double, width double, height double")
    hit = search.matches(spark.createDataFrame([(1, 1, 0, "Hello world", 0.0, 0.0, 66.0, 10.0)], LINE), search.compile_queries("lo wo"))
    assert [(r.part, r.x, r.width) for r in search.owners(hit, words).orderBy("part").collect()] == [(0, 18.0, 12.0), (1, 36.0, 12.0)]
    assert search.without_precise_duplicates(hit, hit).count() == 0 and search.without_precise_duplicates(hit, hit.withColumn("y", F.lit(90.0))).count() == 1
    fields = spark.createDataFrame([(1, 1, 0, "Alice", "Name", ["Bob", "alice b"], 5.0, 6.0, 70.0, 8.0)], "doc_id long, page int, field int, value string, caption string, options array<string>, x double, y double, width double, height double")
    got = search.field_matches(fields, search.compile_queries("alice")).collect()
    assert sorted(r.match for r in got) == ["Alice", "alice"] and {(r.x, r.width, r.source) for r in got} == {(5.0, 70.0, "formField")}
    links = spark.createDataFrame([(1, 1, 0, "https://example.com/paper", "our paper", 0.0, 0.0, 9.0, 9.0), (1, 1, 1, "https://example.com/paper", "example.com paper", 0.0, 0.0, 9.0, 9.0)], "doc_id long, page int, link int, target string, text string, x double, y double, width double, height double")
    assert [r.line for r in search.link_matches(links, search.compile_queries("paper")).collect()] == [0]


def test_form_details(spark):
    fields = spark.createDataFrame([(1, 1, 0, 200.0, 10.0, 50.0, 10.0), (1, 1, 1, 100.0, 10.0, 50.0, 10.0)], "doc_id long, page int, field int, x double, y double, width double, height double")
    far = fields.filter("field = 0").withColumns({"line": F.lit(0), "l_x": F.lit(10.0), "l_y": F.lit(10.0), "l_width": F.lit(40.0), "l_height": F.lit(10.0)})
    assert forms.crossing_penalty(far, fields).first().penalty == 40.0
    lines = spark.createDataFrame([(1, 1, 0, "$", 190.0, 10.0, 5.0, 10.0), (1, 1, 1, "Amount due", 100.0, 10.0, 60.0, 10.0)], LINE)
    assert {r.field: r.prompt for r in forms.currency_prompts(fields, lines).collect()} == {0: "Amount due", 1: None}


def test_report_tables(spark):
    pages = spark.createDataFrame([(1, 1, 10, 0, 2), (1, 2, 20, 0, 0)], "doc_id long, page int, char_count long, images int, links int")
    assert report.overview_table(pages, ["images", "links"]).first().markdown == "| page | chars | links |\n| --- | --- | --- |\n| 1 | 10 | 2 |\n| 2 | 20 | 0 |"
    fields = spark.createDataFrame([(1, 1, 0, "n", "Name", "text", "Al"), (1, 1, 1, "m", None, "text", None), (1, 2, 0, "x", None, "checkbox", None), (1, 2, 1, "y", None, "text", "")], "doc_id long, page int, field int, name string, label string, type string, value string")
    got = {r.page: r.markdown for r in report.field_table(fields).collect()}
    assert got[1] == "| field | type | value |\n| --- | --- | --- |\n| Name | text | Al |\n| m | text |  |" and got[2] == "blank form: 1 checkbox, 1 text"
    warned = spark.createDataFrame([(1, 1, "xfa_form"), (2, 3, "glyph_garbage_text")], "doc_id long, page int, code string")
    where = {(r.doc_id, r.code): r.ranges for r in quality.unreadable_report(warned, pages).collect()}
    assert where == {(1, "xfa_form"): "1-2", (2, "glyph_garbage_text"): "3"}
