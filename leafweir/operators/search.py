"""Search over lines: literal and regular expressions, several queries at once, five kinds of source.

A query is compiled on the driver to a Java pattern; matching sets marks around every match and reads
the places off them, so a literal search never leaves the JVM. Patterns that may backtrack without end
go through ``matches_guarded``: an Arrow function with a time limit a page and one a document.
"""

from __future__ import annotations

import math
import re
import time
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as G

CAP = 10_000
PAGE_SECONDS, REQUEST_SECONDS = 1.0, 12.0
#: Stand around matches; noncharacters, which text has only by mistake.
_OPEN, _SHUT = "\ufdd0", "\ufdd1"
SOURCES = ("native", "formField", "annotation", "link", "ocr")
_CJK = "぀-ヿ㐀-鿿가-힯"


@dataclass(frozen=True)
class Query:
    text: str
    pattern: str
    index: int
    ignore_case: bool


def compile_queries(queries: str | list[str], regex: bool = False, case_sensitive: bool = False, normalize: bool = True) -> list[Query]:
    """Literal queries are escaped, with free space between CJK letters; empty ones are refused."""
    out = []
    for i, q in enumerate([queries] if isinstance(queries, str) else queries):
        said = unicodedata.normalize("NFKC", q) if normalize and not regex else q
        if not said.strip():
            raise ValueError("an empty query")
        if regex:
            _check(said, i)
            body = said
        else:
            parts = [re.sub(r"([\\^$.|?*+()\[\]{}])", r"\\\1", c) for c in said]
            body = "".join(p + (r"\s*" if a != " " and re.match(f"[{_CJK}]", a) and b and re.match(f"[{_CJK}]", b) else "") for p, a, b in zip(parts, said, [*said[1:], ""], strict=True))
        out.append(Query(q, body if case_sensitive else f"(?iu){body}", i, not case_sensitive))
    return out


def _check(pattern: str, i: int) -> None:
    """Refuses a pattern that the engine which will run it does not take (Python's where no session is there)."""
    session = SparkSession.getActiveSession()
    try:
        if session is not None:
            session._jvm.java.util.regex.Pattern.compile(pattern)
        else:
            re.compile(pattern)
    except (re.error, Py4JError, PySparkException) as e:
        raise ValueError(f"query {i} is no pattern: {pattern!r}") from e


def _placed(rows: DataFrame, source: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """Rows with line boxes, query, match and start as results: the matched part's box, a character as wide as any of its line."""
    unit = F.when(F.length("text") > 0, F.col("width") / F.length("text")).otherwise(F.lit(0.0))
    return rows.select(
        "doc_id", "page", "line", "query", "match", "start", F.lit(source).alias("source"),
        G.half_up(F.col("x") + unit * F.col("start")).alias("x"), "y", G.half_up(unit * F.length("match")).alias("width"), "height", *extra,
    )


def matches(lines: DataFrame, queries: list[Query], source: str = "native", extra: tuple[str, ...] = ()) -> DataFrame:
    """One row per match: doc_id, page, line, query, match, start (from 0), source and the matched part's box.

    lines: doc_id, page, line, text, x, y, width, height. Matches of nothing are left out, but count as steps.
    """
    marked = lambda q: F.regexp_replace(F.translate("text", _OPEN + _SHUT, "\ufffd\ufffd"), q.pattern, f"{_OPEN}$0{_SHUT}")
    each = F.explode(F.array(*[F.struct(F.lit(q.index).alias("query"), F.split(marked(q), _OPEN).alias("parts")) for q in queries]))
    rows = lines.withColumn("_q", each).filter(F.size("_q.parts") > 1)
    # each part but the first is a match, a mark, and what stands up to the next match
    before = lambda i: F.aggregate(F.slice("_q.parts", F.lit(1), i), F.lit(0), lambda n, p: n + F.length(p)) - (i - 1)
    found = F.transform(F.sequence(F.lit(1), F.size("_q.parts") - 1), lambda i: F.struct(F.substring_index(F.get("_q.parts", i), _SHUT, 1).alias("t"), before(i).alias("s")))
    rows = rows.withColumn("_m", F.explode(F.filter(found, lambda m: F.length(m["t"]) > 0)))
    return _placed(rows.withColumns({"query": F.col("_q.query"), "match": F.col("_m.t"), "start": F.col("_m.s")}), source, extra)


def matches_guarded(lines: DataFrame, queries: list[Query], page_seconds: float = PAGE_SECONDS, request_seconds: float = REQUEST_SECONDS, source: str = "native") -> DataFrame:
    """As ``matches``, and timed_out; under a time limit for each page and for each document.

    A page whose time is spent gives one row of each query not done, without a match; so does every page
    after the document's time. A document's lines are taken as they come: time is counted over neighbouring ones.
    """
    compiled = [(q.index, q.pattern.removeprefix("(?iu)"), q.ignore_case) for q in queries]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        own = [(i, regex.compile(p, regex.I if ci else 0)) for i, p, ci in compiled]
        whole = request_budget(request_seconds)
        doc, page, spent, on_page, done = None, None, 0.0, 0.0, set()
        for batch in batches:
            out = []
            for d, p, n, t, *box in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "page", "line", "text", "x", "y", "width", "height")), strict=True):
                if (d, p) != (doc, page):
                    spent, on_page, done = spent if d == doc else 0.0, 0.0, set()
                    doc, page = d, p
                for i, pattern in own:
                    left = min(page_seconds - on_page, whole - spent)
                    began = time.perf_counter()
                    try:
                        if left <= 0:
                            raise TimeoutError
                        out += [(d, p, n, i, m.group(), m.start(), False, t, *box) for m in pattern.finditer(t or "", timeout=left) if m.group()]
                    except TimeoutError:
                        if i not in done:
                            done.add(i)
                            out.append((d, p, n, i, None, None, True, t, *box))
                    took = time.perf_counter() - began
                    spent, on_page = spent + took, on_page + took
            columns = list(zip(*out, strict=True)) if out else [()] * 12
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.bool_(), pa.string(), *[pa.float64()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "page", "line", "query", "match", "start", "timed_out", "text", "x", "y", "width", "height"])

    schema = "doc_id long, page int, line int, query int, match string, start int, timed_out boolean, text string, x double, y double, width double, height double"
    found = lines.select("doc_id", "page", "line", "text", "x", "y", "width", "height").mapInArrow(run, schema)
    placed = _placed(found.filter(~F.col("timed_out")), source).withColumn("timed_out", F.lit(False))
    late = found.filter("timed_out").select(*[F.col(c) if c in ("doc_id", "page", "line", "query", "timed_out") else (F.lit(source) if c == "source" else F.lit(None)).cast(t).alias(c) for c, t in placed.dtypes])
    return placed.unionByName(late)


def budget(pages: DataFrame, page_ms: float = 1000 * PAGE_SECONDS, request_ms: float = 1000 * REQUEST_SECONDS) -> DataFrame:
    """doc_id, page, cost_ms with ``searched``: pages are searched while time is left; a page costs at most its own limit."""
    return within_time(pages.withColumn("cost_ms", F.least(F.col("cost_ms").cast("double"), F.lit(float(page_ms)))), request_ms)


def capped(found: DataFrame, most: int = CAP) -> DataFrame:
    """At most so many matches of a query on a page from one source, in reading order."""
    order = Window.partitionBy("doc_id", "page", "query", "source").orderBy("line", "start")
    return found.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= most).drop("_n")


def with_context(found: DataFrame, lines: DataFrame, least: float = 0.5) -> DataFrame:
    """Each match with the text of the line that overlaps it most (by at least half) and contains it."""
    l = lines.select(F.col("doc_id").alias("ld"), F.col("page").alias("lp"), F.col("text").alias("context"), G.box().alias("_l"), F.col("line").alias("ll"))  # noqa: E741
    m = found.withColumn("_b", G.box())
    over = G.overlap_of_smaller(F.col("_b"), F.col("_l"))
    keys = ["doc_id", "page", "line", "query", "start"]
    pair = m.join(l, (F.col("doc_id") == F.col("ld")) & (F.col("page") == F.col("lp")) & (over >= least) & F.contains(F.col("context"), F.col("match")))
    best = pair.groupBy(*keys).agg(F.max_by("context", F.struct(over, -F.col("ll"))).alias("context"))
    return found.join(best, keys, "left")


def crop_region(found: DataFrame, lines: DataFrame, page_width: float, page_height: float, pad: float = 12.0) -> DataFrame:
    """Each match with its crop: the smallest line around its centre, or itself, padded and kept on the page."""
    # a page's lines come to its matches as one row, so that matches are found once and not joined with themselves
    boxes = lines.groupBy("doc_id", "page").agg(F.collect_list(F.struct("x", "y", "width", "height", "line")).alias("_lines"))
    cx, cy = F.col("x") + F.col("width") / 2, F.col("y") + F.col("height") / 2
    around = F.filter("_lines", lambda l: (cx >= l["x"]) & (cx <= l["x"] + l["width"]) & (cy >= l["y"]) & (cy <= l["y"] + l["height"]))
    best = F.array_min(F.transform(around, lambda l: F.struct(G.area(l).alias("area"), l["line"].alias("line"), F.struct(*[l[c].alias(c) for c in ("x", "y", "width", "height")]).alias("box"))))["box"]
    region = G.pad_and_clamp(F.col("_at"), F.lit(page_width), F.lit(page_height), pad)
    placed = found.join(boxes, ["doc_id", "page"], "left").withColumn("_at", F.coalesce(best, G.box()))
    return placed.select(*found.columns, region.alias("region"))


def hyphenated(lines: DataFrame, ahead: int = 6) -> DataFrame:
    """Lines ending with a hyphen, joined with the next line (within ``ahead``) that begins at the same place."""
    order = Window.partitionBy("doc_id", "page").orderBy("line")
    nexts = [F.when(F.abs(F.lead("x", k).over(order) - F.col("x")) <= 2, F.lead("text", k).over(order)) for k in range(1, ahead + 1)]
    rows = lines.withColumn("_next", F.coalesce(*nexts)).filter(F.col("text").rlike(r"\p{L}-$") & F.col("_next").isNotNull())
    first = F.regexp_extract("_next", r"^\S+", 0)
    return rows.select("doc_id", "page", "line", F.concat(F.expr("substring(text, 1, length(text) - 1)"), first).alias("text"), "x", "y", "width", "height", (F.length("text") - 1).alias("joint"))


def collapse(hits: DataFrame, texts: int = 4) -> DataFrame:
    """Hits with one page, source and rounded region as one: count, a few distinct texts, first-seen order."""
    spot = F.struct(*[F.floor(F.col(f"region.{c}") + 0.5).cast("int").alias(c) for c in ("x", "y", "width", "height")])
    grouped = hits.withColumn("spot", spot).groupBy("doc_id", "page", "source", "spot").agg(F.count(F.lit(1)).alias("hits"), F.min(F.struct("line", "start", "query")).alias("first"), F.slice(F.sort_array(F.collect_set("match")), 1, texts).alias("texts"))
    return grouped.withColumn("ord", F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "first", "source", "spot")))


def bag_difference(precise: DataFrame, more: DataFrame) -> DataFrame:
    """OCR hits beyond as many native hits of the same page, query and lower-cased text."""
    key = F.lower("match").alias("key")
    budget = precise.groupBy("doc_id", "page", "query", key).agg(F.count(F.lit(1)).alias("budget"))
    order = Window.partitionBy("doc_id", "page", "query", "key").orderBy("line", "start")
    rows = more.withColumn("key", F.lower("match")).withColumn("n", F.row_number().over(order))
    return rows.join(budget, ["doc_id", "page", "query", "key"], "left").filter(F.col("n") > F.coalesce("budget", F.lit(0))).drop("key", "n", "budget")


def anchor_restates_target(anchor: Column, target: Column) -> Column:
    """Every word of the anchor is a word of the target."""
    words = lambda c: F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) > 0)
    return (F.size(words(anchor)) > 0) & (F.size(F.array_except(words(anchor), words(target))) == 0)


def ordered(found: DataFrame) -> DataFrame:
    """With ord: native, then form fields, annotations, links and OCR; in reading order within."""
    rank = F.array_position(F.array(*map(F.lit, SOURCES)), F.col("source"))
    return found.withColumn("ord", F.row_number().over(Window.partitionBy("doc_id").orderBy("page", rank, "query", "line", "start")))


def matches_only(found: DataFrame) -> DataFrame:
    """Report lines of one document's matches, as one text."""
    said = F.concat(F.lit("p"), "page", F.lit(" ["), "source", F.lit("] "), "match")
    return ordered(found).groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", said.alias("s")))), lambda r: r["s"]), "\n").alias("report"), F.count(F.lit(1)).alias("matches"))


def stacked_labels(lines: DataFrame, ahead: int = 24, gap_em: float = 1.6) -> DataFrame:
    """Short lines joined with the nearest line right below that shares their middle: labels set on two lines."""
    a = lines.filter(F.length(F.trim("text")).between(1, 40)).withColumn("_a", G.box())
    b = lines.select(F.col("doc_id").alias("bd"), F.col("page").alias("bp"), F.col("line").alias("bl"), F.col("text").alias("bt"), G.box().alias("_b"))
    below = F.col("_b.y") - G.bottom(F.col("_a"))
    middle = F.abs((F.col("_a.x") + F.col("_a.width") / 2) - (F.col("_b.x") + F.col("_b.width") / 2)) <= F.greatest(F.col("_a.height"), F.lit(4.0))
    pair = a.join(b, (F.col("doc_id") == F.col("bd")) & (F.col("page") == F.col("bp")) & (F.col("bl") > F.col("line")) & (F.col("bl") <= F.col("line") + ahead) & (below >= 0) & (below <= gap_em * F.col("_a.height")) & middle)
    best = pair.groupBy("doc_id", "page", "line").agg(F.min_by(F.struct("bt", "_b"), F.struct(below, "bl")).alias("n"), F.first("text").alias("t"), F.first("_a").alias("_a"))
    x, y = F.least("_a.x", "n._b.x"), F.col("_a.y")
    return best.select("doc_id", "page", "line", F.concat_ws(" ", F.trim("t"), F.trim("n.bt")).alias("text"), x.alias("x"), y.alias("y"), (F.greatest(G.right(F.col("_a")), G.right(F.col("n._b"))) - x).alias("width"), (G.bottom(F.col("n._b")) - y).alias("height"), F.length(F.trim("t")).alias("joint"))


def vertical_lines(runs: DataFrame) -> DataFrame:
    """Vertical columns (``vertical.vertical_runs``) as lines to be searched; a match's place is down the column."""
    return runs.select("doc_id", "page", F.col("run").alias("line"), "text", "x", "y", "width", "height")


def request_budget(seconds: float | None = None) -> float:
    """Seconds of a request: a limit may be drawn tighter, never wider or away."""
    return seconds if seconds is not None and math.isfinite(seconds) and 0 <= seconds <= REQUEST_SECONDS else REQUEST_SECONDS


def within_time(timed: DataFrame, budget_ms: float) -> DataFrame:
    """Pages (doc_id, page, cost_ms) that a request's time budget reaches: those before which it was not yet spent."""
    order = Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    return timed.withColumn("searched", F.coalesce(F.sum("cost_ms").over(order), F.lit(0)) < budget_ms)


def owners(found: DataFrame, spans: DataFrame) -> DataFrame:
    """Each match cut into the parts of the words that it runs over: doc_id, page, line, query, start, part and box."""
    s = spans.select(F.col("doc_id").alias("sd"), F.col("page").alias("sp"), F.col("line").alias("sl"), F.col("word").alias("part"), G.box().alias("_s"))
    m = found.withColumn("_m", G.box())
    pair = m.join(s, (F.col("doc_id") == F.col("sd")) & (F.col("page") == F.col("sp")) & (F.col("line") == F.col("sl")) & (G.x_overlap(F.col("_m"), F.col("_s")) > 0.01))
    left = F.greatest(F.col("_m.x"), F.col("_s.x"))
    return pair.select("doc_id", "page", "line", "query", "start", "part", G.half_up(left).alias("x"), F.col("_s.y").alias("y"), G.half_up(F.least(G.right(F.col("_m")), G.right(F.col("_s"))) - left).alias("width"), F.col("_s.height").alias("height"))


def without_precise_duplicates(more: DataFrame, precise: DataFrame, least: float = 0.5) -> DataFrame:
    """Matches with no precise one of the same query and text over half of them."""
    m = more.withColumn("_m", G.box())
    p = precise.select(F.col("doc_id").alias("pd"), F.col("page").alias("pp"), F.col("query").alias("pq"), F.lower("match").alias("pt"), G.box().alias("_p"))
    return m.join(p, (F.col("doc_id") == F.col("pd")) & (F.col("page") == F.col("pp")) & (F.col("query") == F.col("pq")) & (F.lower("match") == F.col("pt")) & (G.overlap_of_smaller(F.col("_m"), F.col("_p")) >= least), "left_anti").drop("_m")


def field_matches(fields: DataFrame, queries: list[Query]) -> DataFrame:
    """Matches in values, captions and options of form fields, placed on the field."""
    said = F.explode(F.array_distinct(F.filter(F.flatten(F.array(F.array("value", "caption"), F.coalesce("options", F.array().cast("array<string>")))), lambda t: t.isNotNull())))
    rows = fields.withColumn("text", said).withColumn("line", F.col("field"))
    return matches(rows, queries, "formField").drop("x", "width", "start").join(fields.select("doc_id", "page", F.col("field").alias("line"), "x", "width"), ["doc_id", "page", "line"]).withColumn("start", F.lit(0))


def link_matches(links: DataFrame, queries: list[Query]) -> DataFrame:
    """Matches in link targets, unless the link's own text says them already."""
    rows = links.filter(~F.coalesce(anchor_restates_target(F.col("text"), F.col("target")), F.lit(False)))
    rows = rows.select("doc_id", "page", F.col("link").alias("line"), F.col("target").alias("text"), "x", "y", "width", "height")
    return matches(rows, queries, "link")


def annotation_matches(annotations: DataFrame, queries: list[Query]) -> DataFrame:
    """Matches in what notes say and in their titles, placed on the note; the same match of one note is one."""
    said = F.explode(F.array_distinct(F.filter(F.array("contents", "title"), lambda t: F.length(t) > 0)))
    rows = annotations.withColumn("text", said).withColumn("line", F.col("annotation"))
    found = matches(rows, queries, "annotation").select("doc_id", "page", "line", "query", "match", "source").distinct().withColumn("start", F.lit(0))
    return found.join(annotations.select("doc_id", "page", F.col("annotation").alias("line"), "x", "y", "width", "height"), ["doc_id", "page", "line"])


def ocr_matches(words: DataFrame, queries: list[Query], native: DataFrame) -> DataFrame:
    """Matches in lines of recognised words, beyond as many native ones of the same text and none over the same place."""
    from . import ocr

    lines = ocr.words_to_lines(words).withColumn("line", F.col("line").cast("int"))
    return without_precise_duplicates(bag_difference(native, matches(lines, queries, "ocr")), native)


def across_lines(lines: DataFrame, queries: list[Query]) -> DataFrame:
    """Matches that run over the joint of words parted by a hyphen, or of labels set on two lines."""
    out = None
    for joined in (hyphenated(lines), stacked_labels(lines)):
        found = matches(joined, queries, extra=("joint",)).filter((F.col("start") < F.col("joint")) & (F.col("start") + F.length("match") > F.col("joint"))).drop("joint")
        out = found if out is None else out.unionByName(found)
    return out


def everywhere(lines: DataFrame, queries: list[Query], fields: DataFrame | None = None, annotations: DataFrame | None = None, links: DataFrame | None = None, words: DataFrame | None = None) -> DataFrame:
    """Matches of all five sources, those of joined lines only over the joint, at most ``CAP`` a page, query and source."""
    cols = ["doc_id", "page", "line", "query", "match", "start", "source", "x", "y", "width", "height"]
    native = matches(lines, queries)
    out = native.select(*cols).unionByName(across_lines(lines, queries).select(*cols))
    for table, find in ((fields, field_matches), (annotations, annotation_matches), (links, link_matches)):
        if table is not None:
            out = out.unionByName(find(table, queries).select(*cols))
    if words is not None:
        out = out.unionByName(ocr_matches(words, queries, native).select(*cols))
    return capped(out)
