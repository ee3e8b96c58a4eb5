"""Document-level evidence: fingerprints, sources, attachments, outline, viewer actions."""

from __future__ import annotations

import ipaddress
import socket
from urllib.parse import urlsplit

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def fingerprint(content: Column) -> Column:
    """First 16 hexadecimal digits of the content's SHA-256."""
    return F.substring(F.sha2(content, 256), 1, 16)


def parse_state(content: Column) -> Column:
    """ok, not_pdf (no header in the first 1,024 bytes) or truncated (no end mark in the last)."""
    text = lambda c: F.decode(c, "ISO-8859-1")
    head = text(F.substring(content, 1, 1024))
    tail = text(F.substring(content, -1024, 1024))
    return F.when(~F.contains(head, F.lit("%PDF-")), "not_pdf").when(~F.contains(tail, F.lit("%%EOF")), "truncated").otherwise("ok")


def source_kind(source: Column) -> Column:
    return F.when(source.rlike("(?i)^https?://"), "remote").otherwise("local")


def assert_routable(url: str, resolve=socket.getaddrinfo) -> str:
    """The URL, if its host is public; private, loopback, link-local and reserved hosts are refused."""
    parts = urlsplit(url)
    if parts.scheme.lower() not in ("http", "https") or not parts.hostname:
        raise ValueError(f"not an http(s) address: {url}")
    try:
        found = [ipaddress.ip_address(parts.hostname)]
    except ValueError:
        found = [ipaddress.ip_address(x[4][0]) for x in resolve(parts.hostname, parts.port or 443)]
    if not found or any(not a.is_global for a in found):
        raise ValueError(f"refused: {parts.hostname} is not a public host")
    return url


def merge_attachments(*tables: DataFrame) -> DataFrame:
    """Rows doc_id, name, content of several sources as one list: equal name and content once, the first stays."""
    rows = None
    for i, t in enumerate(tables):
        t = t.select("doc_id", "name", "content", F.lit(i).alias("_src"), F.sha2("content", 256).alias("sha256"))
        rows = t if rows is None else rows.unionByName(t)
    first = Window.partitionBy("doc_id", "name", "sha256").orderBy("_src")
    kept = rows.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    return unique_names(kept).drop("_src")


def unique_names(rows: DataFrame) -> DataFrame:
    """Safe file names, alike regardless of case told apart by ``-2``, ``-3``; ordinal in order of name."""
    safe = F.regexp_replace("name", r"[\\/:*?\"<>|\x00-\x1F]", "_")
    same = Window.partitionBy("doc_id", F.lower(safe)).orderBy("name", "sha256")
    stem, ext = F.regexp_replace(safe, r"\.[^.]*$", ""), F.regexp_extract(safe, r"(\.[^.]*)$", 1)
    out = rows.withColumn("_k", F.row_number().over(same)).withColumn("file_name", F.when(F.col("_k") > 1, F.concat(stem, F.lit("-"), F.col("_k"), ext)).otherwise(safe)).drop("_k")
    return out.withColumn("ordinal", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.lower("file_name"), "file_name")))


def resolve_attachment(rows: DataFrame, selector: str) -> DataFrame:
    """By name, regardless of case, or by ordinal from 1."""
    test = F.lower("name") == selector.lower()
    return rows.filter(test | (F.col("ordinal") == int(selector)) if selector.isdigit() else test)


def attachment_body(mime: Column, content: Column) -> Column:
    """Text inline, images as base64, other kinds as metadata only (null)."""
    return F.when(mime.startswith("text/"), F.decode(content, "UTF-8")).when(mime.startswith("image/"), F.base64(content))


def script_count(actions: Column) -> Column:
    """Scripts in a map of event to array of scripts."""
    return F.aggregate(F.map_values(actions), F.lit(0), lambda a, x: a + F.size(x))


def clean_actions(actions: Column) -> Column:
    """Without empty scripts, nor events left without any."""
    kept = F.transform_values(actions, lambda _, v: F.filter(v, lambda s: F.length(F.trim(s)) > 0))
    return F.map_filter(kept, lambda _, v: F.size(v) > 0)


def outline(nodes: DataFrame) -> DataFrame:
    """Bookmark nodes (doc_id, node, parent, ord, title, url, dest): depth, path and target of those with a title.

    Children of untitled nodes move up to the nearest titled ancestor. A recursive query over the
    adjacency table.
    """
    spark = nodes.sparkSession
    return spark.sql(
        """
        with recursive walk as (
          select doc_id, node, ord, title, url, dest, case when coalesce(title, '') = '' then 0 else 1 end as depth, cast(format_string('%06d', ord) as string) as path from {nodes} where parent is null
          union all
          select n.doc_id, n.node, n.ord, n.title, n.url, n.dest, w.depth + case when coalesce(n.title, '') = '' then 0 else 1 end, concat(w.path, '.', format_string('%06d', n.ord)) from walk w join {nodes} n on n.doc_id = w.doc_id and n.parent = w.node
        )
        select doc_id, node, title, depth, path, case when url is not null then 'url' when dest is not null then 'destination' end as type, coalesce(url, dest) as target
        from walk where coalesce(title, '') <> ''
        """,
        nodes=nodes,
    )


def marked_text(items: DataFrame) -> DataFrame:
    """Text of each marked-content id: items (ord, mcid, artifact, text) trimmed and joined by spaces."""
    kept = F.when(~F.coalesce("artifact", F.lit(False)) & (F.length(F.trim("text")) > 0), F.struct("ord", F.trim("text").alias("t")))
    said = F.array_join(F.transform(F.sort_array(F.collect_list(kept)), lambda s: s["t"]), " ")
    return items.filter("mcid is not null").groupBy("doc_id", "page", "mcid").agg(said.alias("text"))


def xfa_shape(content: Column, acro_form: Column, placeholder: Column) -> Column:
    return F.when(content, "static_content").when(acro_form, "fields_only").when(placeholder, "viewer_placeholder").otherwise("unknown")


# fixed values: permission bits by number
PERMISSIONS = {"print": 4, "modify": 8, "copy": 16, "annotate": 32, "fillForms": 256, "extract": 512, "assemble": 1024, "printHighQuality": 2048}
#: Parser error codes of encrypted documents.
_PASSWORD = {1: "password needed", 2: "password wrong"}


def permissions(bits: Column) -> Column:
    """Names of the permissions that are granted; null bits grant all."""
    granted = lambda n, b: F.when(bits.isNull() | (bits.bitwiseAND(F.lit(b)) != 0), F.lit(n))
    return F.filter(F.array(*[granted(n, b) for n, b in PERMISSIONS.items()]), lambda x: x.isNotNull())


def password_failure(code: Column) -> Column:
    return F.when(code == 1, _PASSWORD[1]).when(code == 2, _PASSWORD[2])


def page_mode(mode: Column) -> Column:
    return F.when(mode != "UseNone", mode)


def resolve_destinations(links: DataFrame, destinations: DataFrame) -> DataFrame:
    """Links with the page that their named destination stands for (null where it is unknown)."""
    to = destinations.select("doc_id", F.col("name").alias("target"), F.col("page").alias("target_page")).dropDuplicates(["doc_id", "target"])
    return links.join(to, ["doc_id", "target"], "left")


def layer_order(groups: DataFrame) -> DataFrame:
    """Optional-content groups (doc_id, layer, parent, ord, name, visible) with depth, path and what shows: one is seen only with all above it."""
    return groups.sparkSession.sql(
        """
        with recursive walk as (
          select doc_id, layer, name, visible, 1 as depth, cast(format_string('%06d', ord) as string) as path from {g} where parent is null
          union all
          select g.doc_id, g.layer, g.name, w.visible and g.visible, w.depth + 1, concat(w.path, '.', format_string('%06d', g.ord)) from walk w join {g} g on g.doc_id = w.doc_id and g.parent = w.layer
        ) select * from walk
        """,
        g=groups,
    )


def features(documents: DataFrame, pages: DataFrame, attachments: DataFrame, outline_nodes: DataFrame, scripts: DataFrame) -> DataFrame:
    """One row per document: page, attachment, outline and script counts."""
    n = lambda rows, name: rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias(name))
    out = documents
    for rows, name in ((pages, "total_pages"), (attachments, "attachment_count"), (outline_nodes, "outline_count"), (scripts, "javascript_action_count")):
        out = out.join(n(rows, name), "doc_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def run_envelope(matrix: Column, advance: Column, page_height: Column) -> Column:
    """The upright box of a turned text run: matrix [a, b, c, d, e, f], advance along it, one em across."""
    corner = lambda i, j: (matrix[0] * i * advance + matrix[2] * j + matrix[4], matrix[1] * i * advance + matrix[3] * j + matrix[5])
    points = [corner(i, j) for i in (0, 1) for j in (0, 1)]
    xs, ys = [p[0] for p in points], [p[1] for p in points]
    return F.struct(F.least(*xs).alias("x"), (page_height - F.greatest(*ys)).alias("y"), (F.greatest(*xs) - F.least(*xs)).alias("width"), (F.greatest(*ys) - F.least(*ys)).alias("height"))
