"""OCR evidence against native text. Engines are outside Spark: words come as a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.normal import nfkc


def confidence(raw: Column) -> Column:
    """0..100 of an engine as 0..1."""
    return G.half_up(F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw / 100)), 3)


def words_to_page(words: DataFrame, scale: float) -> DataFrame:
    """Pixel boxes as page units."""
    return words.select(*[c for c in words.columns if c not in ("x", "y", "width", "height")], *[G.half_up(F.col(c) / scale).alias(c) for c in ("x", "y", "width", "height")])


def words_to_lines(words: DataFrame, tolerance: float = 0.75) -> DataFrame:
    """Words to lines: a line goes on while tops differ by less than so much of a height."""
    from pyspark.sql.window import Window

    order = Window.partitionBy("doc_id", "page").orderBy("y", "x", "word")
    new = F.coalesce(F.abs(F.col("y") - F.lag("y").over(order)) > tolerance * F.col("height"), F.lit(True)).cast("int")
    rows = words.withColumn("_new", new).withColumn("line", F.sum("_new").over(order) - 1)
    said = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x", "word", "text"))), lambda s: s["text"]), " ")
    return rows.groupBy("doc_id", "page", "line").agg(said.alias("text"), *G.union_aggs())


def _plain(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def _within(a: Column, b: Column, most: Column) -> Column:
    """Edit distance, or -1 beyond ``most``: banded, so that texts of any length stay affordable."""
    return F.when(a == b, 0).otherwise(F.call_function("levenshtein", a, b, F.floor(most).cast("int")))


#: What is counted in a page's text, and the name of its count.
_COUNTED = {r"[\p{L}\p{N}]": "alnum", r"\s": "spaces", r"[\p{L}\p{N}]+": "runs"}


def _letters(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "")


def native_mismatch(pairs: DataFrame, least_confidence: float = 0.85, least_ratio: float = 0.5) -> DataFrame:
    """Of pages with native and OCR text of 3 to 200 characters and like length, those that differ by half or more."""
    size = lambda s: (F.length(s["a"]), F.length(s["b"]))
    # as an array of one or none, so that each text and each distance is worked out once
    said = F.filter(F.array(F.struct(_plain(F.col("native")).alias("a"), _plain(F.col("ocr")).alias("b"))), lambda s: F.least(*size(s)).between(3, 200) & F.greatest(*size(s)).between(3, 200) & (F.least(*size(s)) / F.greatest(*size(s)) >= 0.75))
    apart = F.transform(said, lambda s: F.struct(s["a"].alias("a"), s["b"].alias("b"), F.levenshtein(s["a"], s["b"]).alias("distance")))
    rated = F.transform(apart, lambda s: F.struct(s["a"].alias("a"), s["b"].alias("b"), s["distance"].alias("distance"), G.half_up(s["distance"] / F.greatest(*size(s)), 3).alias("ratio")))
    return pairs.filter(F.col("confidence") >= least_confidence).select("*", F.inline(F.filter(rated, lambda s: s["ratio"] >= least_ratio)))


def spacing_loss(pairs: DataFrame, least_confidence: float = 0.85) -> DataFrame:
    """Pages of 120 characters or more whose native text is the OCR text with spaces lost."""
    squeeze = lambda c: F.regexp_replace(F.lower(c), r"\s+", "")
    spaces = lambda c: F.regexp_count(F.trim(c), F.lit(r"\s+"))
    rows = pairs.filter((F.col("confidence") >= least_confidence) & (F.length("ocr") >= 120))
    rows = rows.withColumns({"distance": _within(squeeze(F.col("native")), squeeze(F.col("ocr")), 0.12 * F.length(squeeze(F.col("ocr")))), "native_spaces": spaces(F.col("native")), "ocr_spaces": spaces(F.col("ocr"))})
    # whole numbers: 0.7 * 680 is less than 476 in binary
    return rows.filter((F.col("distance") >= 0) & (10 * F.col("native_spaces") <= 7 * F.col("ocr_spaces")))


def page_spacing_loss(pairs: DataFrame, least_confidence: float = 0.85) -> DataFrame:
    """Whole raster-backed pages, of any length from 120 characters on, under all conditions of the reference:
    like letters, but less white space, longer tokens and fewer word runs in the native text."""
    rows = nfkc(pairs.filter(F.col("confidence") >= least_confidence).withColumns({"_a": F.col("native"), "_b": F.col("ocr")}), ["_a", "_b"])
    size = lambda s: (F.length(s["a"]), F.length(s["b"]))
    count = lambda c, what: F.regexp_count(F.col(c), F.lit(what)).alias(f"{c}_{_COUNTED[what]}")

    def lost(s: Column) -> Column:
        # products in place of quotients: counts of letters and runs are above 0 here
        n, o = s["native_alnum"], s["ocr_alnum"]
        spaced = (s["ocr_spaces"] >= 0.14 * o) & (s["native_spaces"] / n <= 0.6 * s["ocr_spaces"] / o)
        return (n >= 120) & (o >= 120) & spaced & (n >= 8 * s["native_runs"]) & (o <= 7 * s["ocr_runs"]) & (s["native_runs"] <= 0.65 * s["ocr_runs"])

    # as an array of one or none, so that each text, count and distance is worked out once
    said = F.filter(F.array(F.struct(_letters(F.col("_a")).alias("a"), _letters(F.col("_b")).alias("b"))), lambda s: (F.greatest(*size(s)) >= 120) & (F.least(*size(s)) / F.greatest(*size(s)) >= 0.75))
    apart = F.filter(F.transform(said, lambda s: _within(s["a"], s["b"], 0.12 * F.greatest(*size(s)))), lambda d: d >= 0)
    told = F.transform(apart, lambda d: F.struct(d.alias("distance"), *[count(c, what) for c in ("native", "ocr") for what in _COUNTED]))
    return rows.select(*pairs.columns, F.inline(F.filter(told, lost)))
