"""Texts attached to visual regions: captions, headings, panel titles, plain labels, lead-ins, sources.

All are one nearest join within a page that differs in pattern, side, reach and share of width; the
nearest line of each region wins, ties by order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as T


@dataclass(frozen=True)
class Rule:
    """kind of label; where it stands (above, below, either, inside); how far; how much of the narrower width; which text."""

    kind: str
    side: str
    reach: float
    width: float
    most: int
    pattern: str | None = None
    least_area: float = 0.0


# fixed values
RULES = {
    "caption": Rule("caption", "either", 54.0, 0.2, 600, T.CAPTION),
    "heading": Rule("heading", "above", 96.0, 0.2, 160, None, 0.08),
    "panel_title": Rule("panel_title", "above", 42.0, 0.2, 260, r"^\(?[A-Za-z]\)[\s.]", 0.035),
    "plain_label": Rule("plain_label", "either", 28.0, 0.45, 120),
    "inside_label": Rule("inside_label", "inside", 0.0, 0.0, 120, None, 0.05),
    "lead_in": Rule("lead_in", "above", 36.0, 0.2, 240, r":\s*$"),
    "source": Rule("source", "below", 56.0, 0.3, 240, r"(?i)^(?:sources?|資料|出典)\s*[:：]"),
}


def bare_reference(text: Column) -> Column:
    """A caption's number without a caption."""
    return F.trim(text).rlike(r"(?i)^(?:fig(?:ure)?\.?|table|図|表)\s*[0-9]+[.:]?$")


def useful(text: Column) -> Column:
    """Text that can label something: a letter, and not mostly marks."""
    return text.rlike(r"\p{L}") & (T.symbol_ratio(text) < 0.5)


def attach(regions: DataFrame, lines: DataFrame, rule: Rule, page_area: float) -> DataFrame:
    """regions (doc_id, page, region, box) with the text of the line that the rule picks, as ``rule.kind``."""
    r = regions.select("doc_id", "page", "region", G.box().alias("_r")).filter(G.area(F.col("_r")) >= rule.least_area * page_area)
    text = F.trim("text")
    fit = (F.length(text).between(1, rule.most)) & useful(text) & (text.rlike(rule.pattern) if rule.pattern else ~text.rlike(T.CAPTION))
    l = lines.filter(fit).select(F.col("doc_id").alias("ld"), F.col("page").alias("lp"), F.col("line").alias("ll"), text.alias("said"), G.box().alias("_l"))  # noqa: E741
    above, below = F.col("_r.y") - G.bottom(F.col("_l")), F.col("_l.y") - G.bottom(F.col("_r"))
    inside = G.overlap_area(F.col("_r"), F.col("_l")) >= 0.9 * G.area(F.col("_l"))
    away = F.when(above >= 0, above).when(below >= 0, below).otherwise(F.lit(0.0))
    ok = {"above": (above >= 0) & (above <= rule.reach), "below": (below >= 0) & (below <= rule.reach), "either": ~inside & (away <= rule.reach), "inside": inside}[rule.side]
    wide = G.horizontal_overlap_ratio(F.col("_r"), F.col("_l")) >= rule.width if rule.width else F.lit(True)
    best = r.join(l, (F.col("doc_id") == F.col("ld")) & (F.col("page") == F.col("lp")) & ok & wide).groupBy("doc_id", "page", "region").agg(F.min_by("said", F.struct(away, "ll")).alias(rule.kind))
    return regions.join(best, ["doc_id", "page", "region"], "left")


def attach_all(regions: DataFrame, lines: DataFrame, page_area: float, kinds: list[str] | None = None, most: int = 3) -> DataFrame:
    """Every kind of label, and ``associated``: up to ``most`` distinct ones, captions first."""
    kinds = kinds or list(RULES)
    for k in kinds:
        regions = attach(regions, lines, RULES[k], page_area)
    found = F.array_distinct(F.filter(F.array(*map(F.col, kinds)), lambda x: x.isNotNull()))
    return regions.withColumn("associated", F.slice(found, 1, most))


def columns_clamped(regions: DataFrame, page_width: float, margin: float = 24.0) -> DataFrame:
    """Table regions over both columns whose caption stands in one: cut to that column."""
    left, right = page_width * 0.45, page_width * 0.55
    end = F.col("x") + F.col("width")
    both = (F.col("kind") == "table") & (F.col("x") < left) & (end > right)
    to_left = both & (F.col("caption_x") + F.col("caption_width") <= right)
    to_right = both & (F.col("caption_x") >= left)
    x = F.when(to_right, F.greatest("x", F.col("caption_x") - margin)).otherwise(F.col("x"))
    stop = F.when(to_left, F.least(end, F.col("caption_x") + F.col("caption_width") + margin)).otherwise(end)
    return regions.withColumn("_x", x).withColumn("width", stop - F.col("_x")).withColumn("x", F.col("_x")).drop("_x")
