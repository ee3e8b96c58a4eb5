"""Predicates on the text and shape of lines, blocks and boxes, as boolean columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import geometry as G
from . import text as T

# fixed values: grammars
NUMBERED = r"^(?:\d+|[IVXLC]+)[.)]\s+\p{L}"
DECIMAL = r"^\d+(?:\.\d+)+\.?\s+\p{L}"
LETTERED = r"^[A-Z][.)]\s+\p{Lu}"
ITEM_MARK = r"^(?:\d{1,2}[a-z]?|[a-z])[.)]?\s"
FIELD_MARK = r"^\d{1,2}[a-z]?\.?$"
FORM_SECTION = r"(?i)^(?:part|section|schedule)\s+(?:[IVXLC]+|\d+|[A-Z])\b"
SENTENCE_ENDS = ".!?。！？"
URL_LIKE = r"(?i)^(?:https?://|www\.|doi:|arxiv:)\S+$"


def numbered_heading(text: Column) -> Column:
    return F.trim(text).rlike(NUMBERED)


def decimal_section(text: Column) -> Column:
    return F.trim(text).rlike(DECIMAL)


def lettered_section(text: Column) -> Column:
    return F.trim(text).rlike(LETTERED) & (F.length(F.trim(text)) <= 80)


def sentence_fragment(text: Column) -> Column:
    """Reads like running text: begins small, cites, is cut or ends as a sentence, is parted by commas and long, or has many words."""
    t = F.trim(text)
    words = F.size(F.filter(F.split(t, r"\s+"), lambda w: w != ""))
    cites = F.lower(t).rlike(r"(?<![\p{L}\p{N}_])et al\.")
    parted = t.rlike("[,;、。，；]") & ((F.length(t) > 24) | (T.count(t, T.CJK) >= 12))
    ended = F.contains(F.lit(SENTENCE_ENDS), F.right(t, F.lit(1))) & (F.length(t) > 0)
    runs = t.rlike(r"^\p{Ll}") | cites | t.rlike(r"[\p{L}\p{N}]-$") | ended | parted | (words > 16)
    return ~numbered_heading(text) & ~lettered_section(text) & runs


def small_heading_fragment(text: Column) -> Column:
    """Too much like running text for a heading of the third level: a fragment, parted, or of more than seven words."""
    t = F.trim(text)
    words = F.size(F.filter(F.split(t, r"\s+"), lambda w: w != ""))
    return sentence_fragment(text) | (~numbered_heading(text) & (t.rlike("[,;:]") | (words > 7)))


def lone_number(text: Column, width: Column, x: Column, before: Column, before_x: Column, before_width: Column, page_width: float) -> Column:
    """A short number set apart from the prose line before it: left of its start, or hardly below it."""
    t = T.collapsed(text)
    bare = F.length(t).between(1, 12) & (F.length(T.without(t, r"[\p{N}\s.\-]")) == 0) & (width <= 0.12 * page_width)
    over = F.least(before_x + before_width, x + width) - F.greatest(before_x, x)
    return F.coalesce(bare & before.rlike(r"\p{L}") & ((x < before_x) | (over < 0.5 * width)), F.lit(False))


def caption(text: Column) -> Column:
    return F.trim(text).rlike(T.CAPTION)


def caption_kind(text: Column) -> Column:
    return F.when(F.trim(text).rlike(r"(?i)^(?:fig(?:ure)?\.?|図)\s*[0-9]"), "figure").when(F.trim(text).rlike(r"(?i)^(?:table|tab\.|表)\s*[0-9]"), "table")


def usable_label(text: Column, most: int = 220) -> Column:
    t = F.trim(text)
    return F.length(t).between(1, most) & t.rlike(r"[\p{L}\p{N}]")


def label_chrome(text: Column) -> Column:
    """Page numbers, form numbers and the like, which label no field."""
    return F.trim(text).rlike(r"(?i)^(?:page\s*\d+(?:\s+of\s+\d+)?|form\s+[\w-]+|omb\s+no\.?.*|\d{1,3}|rev\.?\s.*)$")


def field_marker(text: Column) -> Column:
    return F.trim(text).rlike(FIELD_MARK)


def form_section(text: Column) -> Column:
    return F.trim(text).rlike(FORM_SECTION)


def item_marker(text: Column) -> Column:
    return F.trim(text).rlike(ITEM_MARK)


def name_and_label(name: Column, label: Column) -> Column:
    """matches: every word of the field's name is in the label; contradicts: the name has words of three letters, and none is in it."""
    words = F.struct(T.field_name_tokens(name).alias("name"), T.field_name_tokens(label).alias("label"))

    def told(w: Column) -> Column:
        long = F.filter(w["name"], lambda t: F.length(t) >= 3)
        matches = (F.size(w["name"]) > 0) & (F.size(F.array_except(w["name"], w["label"])) == 0)
        return F.struct(matches.alias("matches"), ((F.size(long) > 0) & ~F.arrays_overlap(long, w["label"])).alias("contradicts"))

    return T.once(words, told)


def name_matches_label(name: Column, label: Column) -> Column:
    """Every word of the field's name is in the label."""
    return name_and_label(name, label)["matches"]


def name_contradicts_label(name: Column, label: Column) -> Column:
    """The name has words, and none is in the label."""
    return name_and_label(name, label)["contradicts"]


def compact_label(text: Column, width: Column) -> Column:
    return (F.length(F.trim(text)) <= 60) & (width <= 140) & text.rlike(r"\p{L}")


def usable_box(b: Column, least: float = 18.0) -> Column:
    return (b["width"] >= least) & (b["height"] >= least)


def near_full_page(b: Column, page_width: float, page_height: float) -> Column:
    return (b["width"] >= 0.9 * page_width) & (b["height"] >= 0.9 * page_height)


def side_chrome(b: Column, page_width: float, page_height: float) -> Column:
    """A rail down a side."""
    return (b["width"] <= 0.08 * page_width) & (b["height"] >= 0.6 * page_height) & ((b["x"] <= 0.08 * page_width) | (G.right(b) >= 0.92 * page_width))


def horizontal_chrome(b: Column, page_width: float, page_height: float) -> Column:
    """A rule or band along the top or bottom."""
    return (b["height"] <= 0.04 * page_height) & (b["width"] >= 0.5 * page_width) & ((b["y"] <= 0.12 * page_height) | (G.bottom(b) >= 0.88 * page_height))


def background(b: Column, page_width: float, page_height: float) -> Column:
    return G.area(b) >= 0.85 * page_width * page_height


def micro_vector(b: Column) -> Column:
    return (G.area(b) <= 100) & (F.greatest(b["width"], b["height"]) <= 18) & (F.greatest(b["width"], b["height"]) >= 0.5)


def dotted_texture(text: Column, dots: int = 12, share: float = 0.65) -> Column:
    """Dots as decoration rather than words."""
    n, shown = T.count(text, "[.·•․‥…]"), T.count(text, r"\S")
    return (n >= dots) & (n / F.greatest(shown, F.lit(1)) >= share) & (T.count(text, r"[\p{L}\p{N}]") / F.greatest(shown, F.lit(1)) <= 0.2)


def unreadable_code(code: Column) -> Column:
    return code.isin("xfa_form", "xfa_fields_only", "xfa_static_content")
