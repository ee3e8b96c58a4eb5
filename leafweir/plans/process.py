"""The whole plan: documents to pages with layout, quality and warnings, and on to a report."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import chrome, layout, quality, search
from ..sources import evidence as ev
from ..sources.store import bucketed
from . import detect, report

FORMATS = ("markdown", "json", "xml", "table")


@dataclass
class Options:
    """What is asked for. Cross-option rules are checked before anything is planned."""

    pages: str | None = None
    format: str = "markdown"
    search: list[str] = field(default_factory=list)
    regex: bool = False
    case_sensitive: bool = False
    matches_only: bool = False
    strip_repeated: bool = False
    map: bool = False
    scale: float | None = None

    def __post_init__(self) -> None:
        if self.format not in FORMATS:
            raise ValueError(f"format must be one of {', '.join(FORMATS)}")
        if self.matches_only and not self.search:
            raise ValueError("matches_only needs a search")
        if self.strip_repeated and self.format != "markdown":
            raise ValueError("strip_repeated is for markdown")
        if self.map and self.format != "markdown":
            raise ValueError("map is for markdown")
        if self.scale is not None and not 0 < self.scale <= 4:
            raise ValueError("scale must be within 0 and 4")


@dataclass
class Result:
    """Frames of one plan; each is computed only when it is used."""

    rows: DataFrame
    lines: DataFrame
    pages: DataFrame
    blocks: DataFrame
    headings: DataFrame
    evidence: dict[str, DataFrame]
    matches: DataFrame | None
    unsearched: DataFrame | None = None

    @cached_property
    def warnings(self) -> DataFrame:
        """Every rule reads the layout, so it is written to the shared folder once, and dealt out by page before."""
        _, lines, pages, blocks = _laid(bucketed(self.rows, "page-rows"))
        return detect.detect(detect.Evidence(pages, lines, blocks, ev.spans(lines), **self.evidence), ev.PAGE_WIDTH, ev.PAGE_HEIGHT, dealt=True)


def _laid(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Page rows, and of them lines, pages with quality and blocks marked for repeated chrome."""
    return rows, ev.lines_of(rows), quality.with_quality(ev.pages_of(rows)), chrome.mark_repeated(ev.blocks_of(rows), ev.PAGE_WIDTH, ev.PAGE_HEIGHT)


def process(documents: DataFrame, options: Options | None = None, fields: DataFrame | None = None, links: DataFrame | None = None, words: DataFrame | None = None, **evidence: DataFrame) -> Result:
    """The plan of a body of documents.

    Form fields, links and recognised words are searched too; further evidence (``detect.Evidence``: images,
    ocr, annotations, ...) by name. ``unsearched`` are pages on which a pattern's time ran out.
    """
    options = options or Options()
    rows = ev.page_rows(documents)
    if options.pages:
        rows = quality.select_pages(rows, options.pages)
        evidence = {k: quality.select_pages(v, options.pages) if "page" in v.columns else v for k, v in evidence.items()}
    rows, lines, pages, blocks = _laid(rows)
    headed = layout.headings(blocks, layout.body_font(lines))
    matches = late = None
    if options.search:
        queries = search.compile_queries(options.search, options.regex, options.case_sensitive)
        if options.regex:  # a user's pattern may never end
            own = search.matches_guarded(lines, queries)
            matches, late = search.capped(own.filter(~F.col("timed_out")).drop("timed_out")), own.filter("timed_out").select("doc_id", "page", "query").distinct()
        else:
            matches = search.everywhere(lines, queries, fields, evidence.get("annotations"), links, words)
    return Result(rows, lines, pages, blocks, headed, evidence, matches, late)


def process_to_text(documents: DataFrame, options: Options | None = None) -> DataFrame:
    """doc_id and the serialised document."""
    options = options or Options()
    r = process(documents, options)
    if options.matches_only:
        return search.matches_only(r.matches)
    if options.map:
        return report.document_map(r.pages, r.warnings)
    if options.format == "json":
        return report.json_pages(r.pages.select("doc_id", "page", "text", "char_count", "native_text_status"))
    if options.format == "xml":
        return report.xml_pages(r.pages)
    if options.format == "table":
        return report.table_notation(report.json_pages(r.pages.select("doc_id", "page", "char_count", "native_text_status")))
    pages = chrome.body_text(r.blocks).withColumnRenamed("body", "text") if options.strip_repeated else r.pages
    return report.markdown(report.markdown_sections(pages))
