"""Serialised reports: JSON, XML, Markdown and an indented table notation, a document map, a body budget."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.quality import page_ranges

def escape_xml(text: Column) -> Column:
    """Escaped; characters that XML forbids become U+FFFD."""
    t = F.regexp_replace(text, r"[\x{0}-\x{8}\x{B}\x{C}\x{E}-\x{1F}\x{FFFE}\x{FFFF}]", "�")
    for raw, said in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        t = F.replace(t, F.lit(raw), F.lit(said))
    return t


def json_pages(pages: DataFrame) -> DataFrame:
    """doc_id, json: pages of a document in order, as one array."""
    cols = [c for c in pages.columns if c != "doc_id"]
    return pages.groupBy("doc_id").agg(F.to_json(F.sort_array(F.collect_list(F.struct("page", *[c for c in cols if c != "page"])))).alias("json"))


def xml_pages(pages: DataFrame) -> DataFrame:
    page = F.concat(F.lit('<page number="'), "page", F.lit('">'), escape_xml(F.col("text")), F.lit("</page>"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page", page.alias("s")))), lambda s: s["s"]), "")
    return pages.groupBy("doc_id").agg(F.concat(F.lit("<document>"), body, F.lit("</document>")).alias("xml"))


def markdown_sections(pages: DataFrame) -> DataFrame:
    """doc_id, page, section: a heading and the page's text."""
    return pages.select("doc_id", "page", F.concat(F.lit("## Page "), "page", F.lit("\n\n"), "text", F.lit("\n")).alias("section"))


def markdown_table(rows: DataFrame, keys: list[str], order: str, cells: str = "cells") -> DataFrame:
    """Rows of cells as a Markdown table per key, the first row as its head."""
    cell = lambda c: F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
    line = F.concat(F.lit("| "), F.array_join(F.transform(F.col(cells), cell), " | "), F.lit(" |"))
    lines = F.transform(F.sort_array(F.collect_list(F.struct(F.col(order), line.alias("l"), F.size(cells).alias("n")))), lambda s: s)
    grouped = rows.groupBy(*keys).agg(lines.alias("_l"))
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), F.get("_l", F.lit(0))["n"]))
    return grouped.select(*keys, F.array_join(F.concat(F.array(F.get("_l", F.lit(0))["l"], rule), F.transform(F.slice("_l", 2, 2**30), lambda s: s["l"])), "\n").alias("markdown"))


def within_budget(sections: DataFrame, budget: int) -> DataFrame:
    """The first sections of each document that fit the budget together."""
    run = F.sum(F.length("section")).over(Window.partitionBy("doc_id").orderBy("page"))
    return sections.withColumn("upto", run).filter(F.col("upto") <= budget)


def markdown(sections: DataFrame, budget: int | None = None) -> DataFrame:
    """doc_id, pages, markdown: the whole document, or its first sections that fit a budget and a note of how many do not."""
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page", "section"))), lambda s: s["section"]), "\n").alias("body")
    if budget is None:
        return sections.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages"), body.alias("markdown"))
    kept = within_budget(sections, budget).groupBy("doc_id").agg(body, F.count(F.lit(1)).alias("kept"))
    total = sections.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages"))
    left = F.col("pages") - F.coalesce("kept", F.lit(0))
    note = F.when(left > 0, F.concat(F.lit("\n[... "), left, F.lit(" more pages]"))).otherwise("")
    return total.join(kept, "doc_id", "left").select("doc_id", "pages", F.concat(F.coalesce("body", F.lit("")), note).alias("markdown"))


def document_map(quality: DataFrame, warnings: DataFrame) -> DataFrame:
    """doc_id, item, ranges: page ranges of each text status and each warning code."""
    status = page_ranges(quality.select("doc_id", "page", F.concat(F.lit("text:"), "native_text_status").alias("item")), ["doc_id", "item"])
    codes = page_ranges(warnings.select("doc_id", "page", F.concat(F.lit("warning:"), "code").alias("item")), ["doc_id", "item"])
    return status.unionByName(codes)


# -- indented table notation -----------------------------------------------------------------------


def _scalar(v) -> str:
    if v is None or isinstance(v, bool | int | float):
        return json.dumps(v)
    plain = v and v == v.strip() and not re.search(r'[,:"\\\n\r\t\[\]{}]', v) and not re.fullmatch(r"-?\d+(\.\d+)?([eE][+-]?\d+)?|true|false|null|-.*", v)
    return v if plain else json.dumps(v, ensure_ascii=False)


def encode_table(value, name: str = "", depth: int = 0) -> str:
    """A JSON value as indented keys; arrays of alike flat objects as a head and rows of values."""
    pad, key = "  " * depth, f"{_scalar(name)}" if name else ""
    if isinstance(value, dict):
        inner = "\n".join(encode_table(v, k, depth + bool(name)) for k, v in value.items())
        return f"{pad}{key}:\n{inner}" if name and value else f"{pad}{key}:" if name else inner
    if isinstance(value, list):
        head = f"{pad}{key}[{len(value)}]"
        flat = [isinstance(v, dict) and not any(isinstance(x, dict | list) for x in v.values()) for v in value]
        if value and all(flat) and value[0] and all(list(v) == list(value[0]) for v in value):
            return f"{head}{{{','.join(map(_scalar, value[0]))}}}:\n" + "\n".join("  " * (depth + 1) + ",".join(map(_scalar, v.values())) for v in value)
        if all(not isinstance(v, dict | list) for v in value):
            return f"{head}: " + ",".join(map(_scalar, value)) if value else f"{head}:"
        return f"{head}:\n" + "\n".join(f"{'  ' * (depth + 1)}-\n{encode_table(v, '', depth + 2)}" for v in value)
    return f"{pad}{key}: {_scalar(value)}" if name else pad + _scalar(value)


def table_notation(documents: DataFrame, column: str = "json") -> DataFrame:
    """doc_id, notation of JSON strings: an Arrow function, as it nests freely."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = [None if s is None else encode_table({"pages": json.loads(s)}) for s in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(said, type=pa.string())], names=["doc_id", "notation"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), column).mapInArrow(run, "doc_id long, notation string")


def overview_table(pages: DataFrame, counts: list[str]) -> DataFrame:
    """doc_id, markdown: a density table of pages; a count column shows where any page of the document has it."""
    shown = [F.when(F.max(c).over(Window.partitionBy("doc_id")) > 0, F.col(c).cast("string")) for c in counts]
    cells = F.filter(F.array(F.col("page").cast("string"), F.col("char_count").cast("string"), *shown), lambda x: x.isNotNull())
    heads = F.filter(F.array(F.lit("page"), F.lit("chars"), *[F.when(F.max(c).over(Window.partitionBy("doc_id")) > 0, F.lit(c)) for c in counts]), lambda x: x.isNotNull())
    rows = pages.select("doc_id", "page", cells.alias("cells"), heads.alias("heads"))
    top = rows.groupBy("doc_id").agg(F.first("heads").alias("cells")).select("doc_id", F.lit(0).alias("page"), "cells")
    return markdown_table(rows.select("doc_id", "page", "cells").unionByName(top), ["doc_id"], "page")


def field_table(fields: DataFrame) -> DataFrame:
    """doc_id, page, markdown: fields with label, type and value; a blank form is one line of types and numbers."""
    filled = F.bool_or(F.length(F.trim(F.coalesce("value", F.lit("")))) > 0).over(Window.partitionBy("doc_id", "page"))
    rows = fields.withColumn("_filled", filled)
    cells = F.array(F.coalesce("label", "name"), F.col("type"), F.coalesce("value", F.lit("")))
    full = rows.filter("_filled").select("doc_id", "page", F.col("field").alias("row"), cells.alias("cells"))
    head = full.select("doc_id", "page").distinct().select("doc_id", "page", F.lit(-1).alias("row"), F.array(F.lit("field"), F.lit("type"), F.lit("value")).alias("cells"))
    per = rows.filter(~F.col("_filled")).groupBy("doc_id", "page", "type").agg(F.count(F.lit(1)).alias("n"))
    blank = per.groupBy("doc_id", "page").agg(F.concat(F.lit("blank form: "), F.array_join(F.sort_array(F.collect_list(F.concat_ws(" ", "n", "type"))), ", ")).alias("markdown"))
    return markdown_table(full.unionByName(head), ["doc_id", "page"], "row").unionByName(blank)
