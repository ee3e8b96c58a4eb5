"""Page text from text items in stream order: separators by gaps, scripts and line ends.

Every decision looks one item back, so separators are window expressions and the text one ordered
aggregate. Items: doc_id, page, ord, str, x, y, width, height, font_size, has_eol.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T

# fixed values
LINE_BREAK_EM, CJK_TIGHT_EM, ARABIC_EM, LATIN_EM, DETACHED_EM = 1.5, 0.3, 0.12, 0.18, 0.1
DETACHED = r"(?i)^(?:https?://|www\.|doi:|arxiv:)"
MIRRORED = {"(": ")", ")": "(", "[": "]", "]": "[", "{": "}", "}": "{", "<": ">", ">": "<", "«": "»", "»": "«"}


def _digits(c: Column, least: int, most: int) -> Column:
    return F.coalesce(F.length(c).between(least, most) & (F.length(T.without(c, "[0-9]")) == 0), F.lit(False))


def _revision(token: Column) -> Column:
    """A date by slashes with a revision number after it: 3/14/2021_r2."""
    parts = F.split(token, "/")
    end = F.split(F.lower(F.get(parts, F.lit(2))), "_?r")
    return (F.size(parts) == 3) & _digits(F.get(parts, F.lit(0)), 1, 2) & _digits(F.get(parts, F.lit(1)), 1, 2) & (F.size(end) == 2) & _digits(F.get(end, F.lit(0)), 2, 4) & _digits(F.get(end, F.lit(1)), 1, 99)


def _slug(text: Column, any_case: bool) -> Column:
    """A job's file name: number, client's letters, a title and a page number, parted by underscores."""
    parts = F.split(text, "_")
    client = F.get(parts, F.lit(1))
    letters = (F.upper(client) if any_case else client).rlike("^[A-Z]{1,5}$")
    title = F.array_join(F.slice(parts, F.lit(3), F.greatest(F.size(parts) - 3, F.lit(0))), "_")
    fits = title.rlike(r"^[\p{L}\p{N}]") & (F.length(T.without(title, r"[\p{L}\p{N}_ -]")) == 0)
    return (F.size(parts) >= 4) & _digits(F.get(parts, F.lit(0)), 2, 4) & F.coalesce(letters, F.lit(False)) & F.coalesce(fits, F.lit(False)) & _digits(F.get(parts, F.size(parts) - 1), 1, 3)


def prepress(text: Column) -> Column:
    """Printers' slugs and proof marks, which are no content: read word by word."""
    t = F.trim(F.coalesce(text, F.lit("")))
    words = F.filter(F.split(t, r"\s+"), lambda w: w != "")
    low = F.transform(words, lambda w: F.lower(w))
    first, n = F.get(low, F.lit(0)), F.size(words)
    ahead = F.array_position(low, "typeset:")
    typeset = F.coalesce((F.array_position(F.transform(low, lambda w: T.without(w, r"[^\p{L}\p{N}_]")), "draft") > 0) & (ahead > F.array_position(F.transform(low, lambda w: T.without(w, r"[^\p{L}\p{N}_]")), "draft")), F.lit(False))
    # a time of day: one word (9:30pm) or two (9:30 pm)
    clock = lambda w: (F.size(F.split(w, ":")) == 2) & _digits(F.get(F.split(w, ":"), F.lit(0)), 1, 2) & _digits(F.get(F.split(w, ":"), F.lit(1)), 2, 2)
    half = lambda w: w.isin("am", "pm")
    last, prior = F.get(low, n - 1), F.get(low, F.greatest(n - 2, F.lit(0)))
    joined = half(F.right(last, F.lit(2))) & clock(F.regexp_replace(last, "[ap]m$", ""))
    timed = F.when(half(last) & clock(prior), 2).when(joined, 1).otherwise(0)
    note = F.array_join(F.slice(words, F.lit(2), F.greatest(n - 1 - timed, F.lit(0))), " ")
    noted = (F.length(note) <= 120) & (F.length(T.without(note, r"[\p{L}\p{N}#'’.,:/_ -]")) == 0)
    revised = F.coalesce(_revision(first) & (timed > 0) & (n > timed) & noted, F.lit(False))
    rest = F.array_join(F.slice(words, F.lit(3), F.greatest(n - 2, F.lit(0))), " ")
    version = lambda c: F.startswith(F.lower(c), F.lit("v. ")) & _slug(F.trim(F.substring(c, 3, 10_000)), True)
    marked = F.coalesce((first == "rev.") & _revision(F.get(low, F.lit(1))) & ((n == 2) | version(rest)), F.lit(False))
    words_in = F.lower(t)
    moved = F.startswith(t, F.lit("*")) & F.regexp_replace(words_in, r"^[*\s]+", "").rlike(r"^footnotes?(?![\p{L}\p{N}_])") & F.contains(F.regexp_replace(words_in, r"\s+", " "), F.lit("moved to back page"))
    return (F.length(t) > 0) & (typeset | revised | marked | F.coalesce(version(t), F.lit(False)) | F.coalesce(_slug(t, False), F.lit(False)) | moved)


def mirrored(text: Column) -> Column:
    """A lone bracket as its counterpart."""
    return F.when(F.length(text) == 1, F.translate(text, "".join(MIRRORED), "".join(MIRRORED.values()))).otherwise(text)


def semantic_space(before: Column, after: Column, gap: Column, em: Column) -> Column:
    """Whether a gap parts words: thresholds by the scripts on either side."""
    ends = lambda p: before.rlike(p)
    starts = lambda p: after.rlike(p)
    arabic = ends(r"\p{IsArabic}$") & starts(r"^\p{IsArabic}")
    latin = ends(r"[\p{IsLatin}\p{IsGreek}\p{N})\].,;:!?]$") & starts(r"^[\p{IsLatin}\p{IsGreek}\p{N}(]")
    detached = ends(r"[\p{L}\p{N})\]]$") & starts(DETACHED)
    share = gap / F.greatest(em, F.lit(1.0))
    return (arabic & (share >= ARABIC_EM)) | (latin & (share >= LATIN_EM)) | (detached & (share >= DETACHED_EM))


def page_text(items: DataFrame) -> DataFrame:
    """doc_id, page, text: stream order, breaks at line ends and jumps, CJK closed up, right-to-left rows turned."""
    order = Window.partitionBy("doc_id", "page").orderBy("ord")
    back = {c: F.lag(c).over(order) for c in ("str", "x", "y", "width", "has_eol", "font_size")}
    em = F.greatest(F.coalesce("font_size", F.lit(12.0)), F.lit(1.0))
    jump = F.abs(F.col("y") - back["y"]) > LINE_BREAK_EM * F.greatest(em, F.coalesce(back["font_size"], em))
    gap = F.col("x") - (back["x"] + back["width"])
    cjk = T.cjk_leading(F.reverse(back["str"])) & T.cjk_leading(F.col("str")) & (F.abs(gap) <= CJK_TIGHT_EM * em)
    spaced = back["str"].rlike(r"\s$") | F.col("str").rlike(r"^\s")
    lead = F.when(back["str"].isNull(), "").when(back["has_eol"] | jump, "\n").when(cjk | spaced, "").when(semantic_space(back["str"], F.col("str"), gap, em), " ").otherwise("")
    rows = items.withColumn("lead", lead)
    row = F.sum((F.col("lead") == "\n").cast("int")).over(order)
    rows = rows.withColumn("row", row).withColumn("rtl", T.rtl_dominant(F.col("str")))
    rtl = Window.partitionBy("doc_id", "page", "row")
    turned = (F.sum(F.col("rtl").cast("int")).over(rtl) * 2 >= F.count(F.lit(1)).over(rtl)) & (F.max("rtl").over(rtl))
    rows = rows.withColumn("key", F.when(turned, -F.col("x")).otherwise(F.col("ord").cast("double"))).withColumn("said", F.when(turned & (F.col("lead") != "\n"), F.concat(F.lit(" "), mirrored(F.col("str")))).otherwise(F.concat(F.when(F.col("lead") == "\n", "").otherwise(F.col("lead")), "str")))
    line = rows.groupBy("doc_id", "page", "row").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("key", "ord", "said"))), lambda s: s["said"]), "").alias("line"))
    return line.groupBy("doc_id", "page").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("row", F.ltrim("line").alias("line")))), lambda s: s["line"]), "\n").alias("text"))


def wide_word_rows(spans: DataFrame, page_width: float) -> DataFrame:
    """Rows of three to six short Latin words set wide apart, yet one line: doc_id, page, line."""
    order = Window.partitionBy("doc_id", "page", "line").orderBy("x", "word")
    gap = F.col("x") - F.lag(F.col("x") + F.col("width")).over(order)
    rows = spans.withColumn("gap", gap).groupBy("doc_id", "page", "line").agg(
        F.count(F.lit(1)).alias("n"), F.bool_and(F.col("text").rlike(r"^\p{IsLatin}{1,16}$")).alias("latin"), F.max("gap").alias("most"), F.max("font_size").alias("em"), (F.max(F.col("x") + F.col("width")) - F.min("x")).alias("across")
    )
    return rows.filter(F.col("latin") & F.col("n").between(3, 6) & (F.col("across") <= 0.85 * page_width) & (F.col("most") <= 0.2 * page_width) & (F.col("most") > F.greatest(1.5 * F.col("em"), F.lit(16.0)))).select("doc_id", "page", "line")


def cjk_display_rows(spans: DataFrame) -> DataFrame:
    """Rows of two to twelve single CJK glyphs set 0.8 to 4 em apart."""
    order = Window.partitionBy("doc_id", "page", "line").orderBy("x", "word")
    gap = F.col("x") - F.lag(F.col("x") + F.col("width")).over(order)
    rows = spans.withColumn("gap", gap / F.greatest("font_size", F.lit(1.0))).groupBy("doc_id", "page", "line").agg(F.count(F.lit(1)).alias("n"), F.bool_and((F.length("text") == 1) & T.cjk_leading(F.col("text"))).alias("cjk"), F.bool_and(F.col("gap").isNull() | F.col("gap").between(0.8, 4)).alias("apart"))
    return rows.filter("cjk and apart and n between 2 and 12").select("doc_id", "page", "line")
