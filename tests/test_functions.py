"""Geometry and text columns on hand-built rows."""

import pytest
from pyspark.sql import functions as F

from leafweir.functions import geometry as G
from leafweir.functions import text as T
from leafweir.functions.normal import nfkc

BOX = "struct<x:double,y:double,width:double,height:double>"


@pytest.fixture(scope="module")
def one(spark):
    def value(column, **given):
        row = spark.range(1)
        for k, v in given.items():
            row = row.withColumn(k, F.from_json(F.lit(v[1]), v[0]) if isinstance(v, tuple) else F.lit(v))
        return row.select(column.alias("v")).first().v

    return value


def boxes(a, b):
    say = lambda v: (BOX, '{"x":%s,"y":%s,"width":%s,"height":%s}' % v)
    return {"a": say(a), "b": say(b)}


def test_half_up_goes_to_plus_infinity(one):
    assert one(G.half_up(F.col("v0")), v0=-2.375) == -2.37
    assert one(G.half_up(F.col("v0"), 0), v0=2.5) == 3 and one(G.half_up(F.col("v0"), 0), v0=-2.5) == -2


@pytest.mark.parametrize(
    ("a", "b", "area", "smaller", "similar"),
    [((0, 0, 10, 10), (5, 5, 10, 10), 25, 0.25, 1.0), ((0, 0, 10, 10), (20, 0, 5, 5), 0, 0.0, 0.25), ((0, 0, 10, 10), (2, 2, 2, 2), 4, 1.0, 0.04), ((0, 0, 0, 0), (0, 0, 5, 5), 0, 0.0, 0.0)],
)
def test_overlaps(one, a, b, area, smaller, similar):
    given = boxes(a, b)
    x, y = F.col("a"), F.col("b")
    assert one(G.overlap_area(x, y), **given) == area
    assert one(G.overlap_of_smaller(x, y), **given) == smaller
    assert one(G.area_similarity(x, y), **given) == similar


def test_touching_within_a_gap(one):
    given = boxes((0, 0, 10, 10), (14, 0, 5, 5))
    assert one(G.touches(F.col("a"), F.col("b"), 4.0), **given) and not one(G.touches(F.col("a"), F.col("b"), 3.9), **given)


def test_pad_clamp_and_rect(one):
    given = boxes((-5, 3, 20, 10), (0, 0, 1, 1))
    assert tuple(one(G.pad_and_clamp(F.col("a"), F.lit(100.0), F.lit(12.0), 4.0), **given)) == (0.0, 0.0, 19.0, 12.0)
    rect = ("array<double>", "[160,720,100,700]")
    assert tuple(one(G.rect_to_box(F.col("r"), F.lit(792.0)), r=rect)) == (100.0, 72.0, 60.0, 20.0)
    quad = ("array<double>", "[0,10,5,10,0,0,5,0]")
    assert [tuple(b) for b in one(G.quad_boxes(F.col("q"), F.lit(20.0)), q=quad)] == [(0.0, 10.0, 5.0, 10.0)]
    assert one(G.quad_boxes(F.col("q"), F.lit(20.0)), q=("array<double>", "[1,2]")) == []
    assert one(G.matrix_font_size(F.col("m"), 9.0), m=("array<double>", "[0,12,-3,0]")) == 12.0
    assert one(G.matrix_font_size(F.col("m"), 9.0), m=("array<double>", "[0,0,0,0]")) == 9.0


@pytest.mark.parametrize(("text", "yes"), [("1,234.5", True), ("$12", True), ("12%", True), ("2.5x", True), ("under 5", True), ("3rd", True), ("7a", False), ("", False), ("-", False), ("(4)", True)])
def test_numeric_cells(one, text, yes):
    assert one(T.numeric_cell(F.col("t")), t=text) is yes


def test_text_statistics(one):
    assert one(T.non_printable_ratio(F.col("t")), t="ab\x01\x7f") == 0.5
    assert one(T.utf16_units(F.col("t")), t="a😀") == 3
    assert one(T.private_use_ratio(F.col("t")), t="\ue000 a") == 0.5
    assert one(T.dot_leader_length(F.col("t")), t=". . . .") == 4 and one(T.dot_leader_length(F.col("t")), t="..") is None
    assert one(T.digraph_samples(F.col("t")), t="aLJb cLJd aLJb x") == ["aLJb", "cLJd"]
    assert one(T.cjk_spacing_pairs(F.col("t")), t="日 本 語x 語") == 2
    assert one(T.cjk_doubled_pairs(F.col("t")), t="日日本本語") == 2
    assert one(T.cjk_repeated_run(F.col("t")), t="語" * 8) and not one(T.cjk_repeated_run(F.col("t")), t="語" * 7)
    assert one(T.sequential_extension_run(F.col("t")), t="".join(chr(0x3400 + 2 * i) for i in range(8)))
    assert not one(T.sequential_extension_run(F.col("t")), t="".join(chr(0x3400 + i * i) for i in range(8)))
    assert one(T.latin1_mojibake(F.col("t")), t="Ã©Ã¨Ã") and not one(T.latin1_mojibake(F.col("t")), t="été")
    assert one(T.rtl_dominant(F.col("t")), t="שלום a") and not one(T.rtl_dominant(F.col("t")), t="hello ש")
    assert one(T.strip_controls(F.col("t")), t="a\x01b\n\x02\nc") == "ab\nc"
    assert one(T.field_name_tokens(F.col("t")), t="firstName_of.Owner") == ["first", "name", "of", "owner"]
    assert one(T.flag_names(F.col("n"), ["a", "b", "c"]), n=5) == ["a", "c"]
    assert one(T.short_sample(F.col("t"), 8), t="abc  defghij") == "abc d..."


def test_nfkc(spark):
    rows = spark.createDataFrame([("ﬁ（Ａ１ｶﾞ\x01",), (None,), ("",)], "t string")
    assert [r.t for r in nfkc(rows, "t", strip=True).collect()][:2] == ["fi(A1ガ", ""]
