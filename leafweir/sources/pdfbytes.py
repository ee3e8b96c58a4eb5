"""What can be read off a document's bytes without a parser: object streams, string tokens, button captions.

Plain Python on bytes, mapped over rows in Arrow batches by ``captions``.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

MOST_CAPTION = 500
_ESCAPES = {"n": "\n", "r": "\r", "t": "\t", "b": "\b", "f": "\f"}


def string_token(data: str, start: int) -> str | None:
    """The string that begins at ``start``: ``(literal)`` with nesting and escapes, or ``<hex>``; null if none does."""
    if data[start : start + 1] == "<":
        end = data.find(">", start)
        digits = re.sub(r"\s", "", data[start + 1 : end]) if end > 0 else "?"
        if not re.fullmatch("[0-9A-Fa-f]*", digits):
            return None
        return _decoded(bytes.fromhex(digits + "0" * (len(digits) % 2)))
    if data[start : start + 1] != "(":
        return None
    out, depth, i = [], 0, start
    while i < len(data):
        c = data[i]
        if c == "\\":
            i += 1
            octal = re.match("[0-7]{1,3}", data[i : i + 3])
            if octal:
                out.append(chr(int(octal.group(), 8) & 255))
                i += len(octal.group()) - 1
            elif data[i : i + 1] not in ("\n", "\r"):
                out.append(_ESCAPES.get(data[i : i + 1], data[i : i + 1]))
        elif c == "(":
            depth += 1
            if depth > 1:
                out.append(c)
        elif c == ")":
            depth -= 1
            if not depth:
                return _decoded("".join(out).encode("latin-1"))
            out.append(c)
        else:
            out.append(c)
        i += 1
    return None


def _decoded(raw: bytes) -> str:
    return raw[2:].decode("utf-16-be", "replace") if raw[:2] == b"\xfe\xff" else raw.decode("latin-1")


def object_streams(data: bytes) -> Iterator[tuple[int, str]]:
    """(number, body) of the objects in deflated object streams; damaged ones are passed over."""
    for m in re.finditer(rb"/Type\s*/ObjStm\b(.{0,400}?)stream\r?\n", data, re.S):
        head = data[max(0, m.start() - 400) : m.end()]
        n, first = re.search(rb"/N\s+(\d+)", head), re.search(rb"/First\s+(\d+)", head)
        if not n or not first:
            continue
        try:
            body = zlib.decompressobj().decompress(data[m.end() :]).decode("latin-1")
        except zlib.error:
            continue
        at = int(first.group(1))
        pairs = body[:at].split()
        places = [(int(a), at + int(b)) for a, b in zip(pairs[::2], pairs[1::2], strict=False)][: int(n.group(1))]
        for i, (number, begin) in enumerate(places):
            yield number, body[begin : places[i + 1][1] if i + 1 < len(places) else None]


def button_captions(data: bytes) -> dict[str, str]:
    """Field name to the caption that its appearance (``/MK << /CA (...) >>``) gives, in plain and packed objects."""
    found: dict[str, str] = {}
    plain = (m.group(1) for m in re.finditer(r"\d+\s+\d+\s+obj(.*?)endobj", data.decode("latin-1"), re.S))
    for body in (*plain, *(b for _, b in object_streams(data))):
        mark = re.search(r"/MK\s*<<.*?/CA\s*(?=[(<])", body, re.S)
        name = re.search(r"/T\s*(?=[(<])", body)
        if mark and name:
            caption, field = string_token(body, mark.end()), string_token(body, name.end())
            if caption and field and len(caption) <= MOST_CAPTION:
                found.setdefault(field, caption)
    return found


def captions(documents: DataFrame) -> DataFrame:
    """path, captions (map of field name to caption) of binary rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [list(button_captions(c or b"").items()) for c in batch.column("content").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(got, type=pa.map_(pa.string(), pa.string()))], names=["path", "captions"])

    return documents.select("path", "content").mapInArrow(run, "path string, captions map<string,string>")
