"""Grammars of cells, slugs, page feet and glyph noise on hand-written cases."""

import pytest
from pyspark.sql import functions as F

from leafweir.functions import text as T
from leafweir.operators import overlap, pagetext, rules


def told(spark, test, texts):
    return {r.t: r.v for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", test(F.col("t")).alias("v")).collect()}


@pytest.mark.parametrize(
    ("test", "yes", "no"),
    [
        (T.numeric_cell, ["1", "-3.5%", "$1,200", "(12)", "2.5x", "2.5 X", "1st", "3rd / 4th", "under 5", "about $", "1 below 7", "4 · 10^6", "12 %"][:9] + ["3rd / 4th", "1 below 7", "4 · 10^6", "12 %"], ["", "abc", "-", "5 kg", "x5", "1sts", "five", "under five", "Q1", "2x4"]),
        (T.numeric_line, ["1", "1,200 %", " 4 - 5 "], ["", "1x", "a", "1" * 81, "·5"]),
        (T.currency_only, [" $", "€ "], ["$$", "$1", "", "5"]),
        (T.cjk_repeated_run, ["日" * 8, "日 日\t日 日日日　日日", "x日日日日日日日日x"], ["日" * 7, "日" * 7 + "本日", "aaaaaaaaaa", "日日日日\n日日日日", ""]),
        (
            pagetext.prepress,
            ["DRAFT copy TYPESET: now", "1/2/2020_r3 10:30 am", "1/2/20r3 minor edits, p. 4 9:05pm", "REV. 1/2/20_r1", "Rev. 1/2/20_r1 v. 12_ab_Spring list_7", "v. 2020_ABC_Cover-2_01", "2020_AB_Title page_3", "* Footnotes have been moved to  back page"],
            ["", "a draft", "TYPESET: then DRAFT", "1/2/2020 10:30 am", "1/2/2020_r3", "2020_ab_Title_3", "2020_AB_3", "footnotes moved to back page", "v. two"],
        ),
        (rules.source_note, ["(出典)総務省", "資料:内閣府", "注1)これ", "※なお", "統計を基に作成", "同書より筆者引用。", "省「情報の調査」", "Source: BBC", "Notes : all", "『資料』"], ["", "出典について", "source of it", "本文です。", "注意"]),
        (lambda t: overlap.formula_context(t), ["f(x) = 2", "points A and B", "x, y and z of the model", "a b c", "the vector a, b or c"], ["plain words here", "a word, and more", "Model of a town"]),
    ],
)
def test_grammars(spark, test, yes, no):
    got = told(spark, test, [*yes, *no])
    assert {t for t, v in got.items() if v} == set(yes)


def test_digraphs(spark):
    got = told(spark, T.digraph_samples, ["waLJter eLJ LJx aLJb1 naïLJvé xLJYa aLJbLJc", "none", None])
    assert got["waLJter eLJ LJx aLJb1 naïLJvé xLJYa aLJbLJc"] == ["waLJter", "aLJb1", "naïLJvé"] and got["none"] == []


@pytest.mark.parametrize(("text", "value"), [("i", 1), ("XIV", 14), ("mcmxcix", 1999), ("mmmm", 4000), ("iiii", None), ("vx", None), ("ic", None), ("", None), ("abc", None), ("xxc", None), ("iix", None)])
def test_roman_numerals(spark, text, value):
    assert told(spark, rules.roman_value, [text])[text] == value


@pytest.mark.parametrize(
    ("text", "width", "want"),
    [
        ("12", 30, True), ("12", 50, False), ("12345", 30, False), ("xiv", 30, True), ("page 3 of 9", 90, True), ("Page 3", 101, False), ("CS101 Lecture 5 - 18", 170, True), ("Slide 2–4", 100, True), ("Lecture five", 100, False), ("Lecture 5 - 18 b", 100, False),
        ("March 3, 2021", 100, True), ("Sept. 4", 100, True), ("Marc 3", 100, False), ("May 3 2021", 100, True), ("May 3, 21", 100, False), ("see www.a.org", 400, True), ("xwww.a", 400, False), ("doi:10.1/2", 300, True), ("", 10, False), ("body text", 300, False),
    ],
)
def test_bottom_references(spark, text, width, want):
    assert told(spark, lambda t: rules.bottom_reference(t, F.lit(float(width))), [text])[text] is want


def written(df, what: str) -> int:
    """How often a function stands in the plan that runs."""
    return df._jdf.queryExecution().optimizedPlan().toString().count(what)


def test_words_of_names_are_read_once(spark):
    from leafweir import catalogue

    # of the line, of the name made of it, of the label
    found = catalogue.field_names(spark, "/root/testdata/sf0.001")
    assert written(found, "Alnum") + written(found, "A-Za-z0-9") <= 3
    said = ["fooBar_baz.Qux", "aBCd9E", " .x", "", "ÄrgerUndB", None]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(said)], "i int, s string")
    assert [r.t for r in rows.orderBy("i").select(T.field_name_tokens(F.col("s")).alias("t")).collect()] == [["foo", "bar", "baz", "qux"], ["a", "bcd9", "e"], ["x"], [], ["rger", "und", "b"], None]


def test_a_distance_is_taken_once(spark):
    from leafweir import catalogue

    assert written(catalogue.ocr_native_mismatch(spark, "/root/testdata/sf0.001"), "levenshtein(") == 1


def test_pages_go_to_python_once(spark):
    from leafweir import catalogue

    found = catalogue.ocr_spacing_loss_pages(spark, "/root/testdata/sf0.001")
    assert written(found, "levenshtein(") == 1 and written(found, "MapInArrow") == 1


def test_runs_are_found_without_a_step_for_each_letter(spark):
    from leafweir import catalogue

    assert "aggregate(" not in catalogue.localized_glyph_noise(spark, "/root/testdata/sf0.001").select("doc_id")._jdf.queryExecution().optimizedPlan().toString().split("cjk_run")[0].rsplit("cjk_doubled", 1)[1]
    said = {"日" * 8: True, "日 日　日日\t日日日日": True, "日" * 7: False, "日日日日x日日日日": False, "xxxxxxxx日": False, "\U00020000" * 8: True, "日本" * 8: False}
    rows = spark.createDataFrame([(t, y) for t, y in said.items()], "t string, y boolean").select("y", T.cjk_repeated_run(F.col("t")).alias("found"), T.has_cjk(F.col("t")).alias("some")).collect()
    assert all(r.y == r.found and r.some for r in rows)


@pytest.mark.parametrize("name", ["chrome_cut_blocks", "strip_repeated_body", "body_near_chrome"])
def test_blocks_are_laid_out_for_candidates_counts_and_marks_alone(spark, name):
    from leafweir import catalogue

    # two layouts, the documents' own and the planted edges, for each of the three
    assert written(catalogue.QUERIES[name](spark, "/root/testdata/sf0.001"), "Relation") <= 6


def test_words_and_blocks_stay_on_their_page(spark):
    spans = spark.createDataFrame([(1, 1, t, y, f) for t, y, f in (("Invoice", 1.0, 9.0), ("Invoice", 90.0, 12.0))], "doc_id long, page int, text string, y double, font_size double").repartition(3, "doc_id", "page")
    blocks = spark.createDataFrame([(1, 1, 0, "a b", 0.0, 0.0, 9.0, 9.0, [])], "doc_id long, page int, block int, text string, x double, y double, width double, height double, lines array<struct<text: string, x: double, y: double, width: double, height: double, font_size: double>>").repartition(3, "doc_id", "page")
    for found in (rules.duplicate_text_layer(spans, least_pairs=1).hint("merge"), overlap.pairs(blocks)):
        semi = [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "LeftSemi" in line]
        assert semi == []
    assert [r.detail for r in rules.duplicate_text_layer(spans.unionByName(spans.withColumns({"text": F.lit("Address"), "y": F.col("y") + 5})), least_pairs=2).collect()] == ["2"]


def test_a_few_rules_are_run_at_once_and_no_page_is_sent_to_all(spark, monkeypatch):
    from leafweir.operators import reading
    from leafweir.plans import detect, process
    from leafweir.sources import store

    asked, plain = [], rules.all_of
    monkeypatch.setattr(rules, "all_of", lambda *frames: asked.append(len(frames)) or plain(*frames))
    docs = spark.createDataFrame([(1, "A text of some words.\nAnd more.", "s")], "doc_id long, text string, source string")
    found = process.process(docs)
    found.warnings.collect()
    assert max(asked) <= detect.AT_ONCE
    pages, blocks = store.bucketed(found.pages, "pages"), store.bucketed(found.blocks, "blocks")
    plan = reading.native_places(blocks, pages)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "Exchange" not in plan


def test_matches_are_found_once_for_their_regions(spark):
    from leafweir import catalogue

    assert written(catalogue.search_context_region(spark, "/root/testdata/sf0.001"), "Relation") == 2


def test_words_are_dealt_out_once_for_lines_and_pages(spark):
    from leafweir import catalogue

    assert catalogue.page_text_join(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString().count("Exchange hash") == 1
