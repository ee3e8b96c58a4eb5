"""Document fingerprints by closed syncmers (op 2).

A k-mer of the text's UTF-8 bytes is an anchor when the least of its inner s-mers, by hash, stands
at its first or last place. Whether it is one depends on its own bytes alone, so an edit elsewhere
moves no anchor, and every run of ``k - s + 1`` k-mers holds at least one. A text of up to ``FINE`` bytes has, besides, each of its four-byte strings (or the whole of it) as a
fine anchor.

A fingerprint lists the anchors in order: for each, one byte for the distance from the one before
(distances cannot exceed ``k - s + 1``; the first counts from the start) and
three of its hash, all in base64. Fine anchors follow in the same form behind a mark. ``likeness`` is the
Dice share of anchors in common, as multisets; ``matches`` gives the places. Two texts with fine anchors
are compared by these, any others by the syncmers, so both sides always have the same kind.

Defined results: null counts as empty; two empty texts are alike (1), an empty and another are not (0).
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._store import fan_out
from ._text import CHUNK_BYTES, Chunk, all_spans, chunks, prefix_hash, ranges, sliding, span_hash

K, S = 32, 12
SHORT = 4
#: Most bytes of a text with fine anchors: beyond, half a text holds several syncmers
FINE = 256
#: Stands before the fine anchors; no distance is 255
MARK = b"\xff\0\0\0"


def anchors(data: np.ndarray, off: np.ndarray, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, start byte, hash) of each anchor in a chunk, in order."""
    prefix = prefix_hash(data)
    inner = all_spans(prefix, s)
    least = sliding(inner, k - s + 1, np.minimum)
    n = len(least)
    hit = (inner[:n] == least) | (inner[k - s : k - s + n] == least)
    at = np.flatnonzero(hit)
    text = np.searchsorted(off, at, side="right") - 1
    inside = at + k <= off[text + 1]
    at, text = at[inside], text[inside]
    value = span_hash(prefix, at, at + k)
    return text, at - off[text], value


def fine_anchors(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same of each four-byte string of the texts of 1 to ``FINE`` bytes."""
    size = np.diff(off)
    short = np.flatnonzero((size > 0) & (size <= FINE))
    grams = np.maximum(size[short] - SHORT + 1, 1)
    text, at = np.repeat(short, grams), ranges(off[short], grams)
    value = span_hash(prefix_hash(data), at, np.minimum(at + SHORT, off[text + 1]))
    return text, at - off[text], value


def _packed(text: np.ndarray, at: np.ndarray, value: np.ndarray, texts: int) -> list[bytes]:
    gap = np.diff(at, prepend=0)
    first = np.flatnonzero(np.diff(text, prepend=-1))
    gap[first] = at[first]
    packed = np.empty((len(at), 4), dtype=np.uint8)
    packed[:, 0] = gap
    for j in range(3):
        packed[:, j + 1] = (value >> np.uint64(40 + 8 * j)).astype(np.uint8)
    raw, cut = packed.tobytes(), np.searchsorted(text, np.arange(texts + 1)) * 4
    return [raw[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]


def encode(c: Chunk, k: int = K, s: int = S) -> list[str]:
    n = c.hi - c.lo
    coarse, fine = _packed(*anchors(c.data, c.off, k, s), n), _packed(*fine_anchors(c.data, c.off), n)
    return [base64.b64encode(a + MARK + b if b else a).decode() for a, b in zip(coarse, fine, strict=True)]


def _levels(fingerprint: str) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places, 24-bit hashes) of the syncmers and, where there are some, of the fine anchors."""
    packed = np.frombuffer(base64.b64decode(fingerprint or ""), dtype=np.uint8).reshape(-1, 4).astype(np.int64)
    mark = np.flatnonzero(packed[:, 0] == MARK[0])
    parts = [packed[: mark[0]], packed[mark[0] + 1 :]] if len(mark) else [packed]
    return [(np.cumsum(p[:, 0]), p[:, 1] | p[:, 2] << 8 | p[:, 3] << 16) for p in parts]


def decode(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    """(places, 24-bit hashes) of the finest anchors."""
    return _levels(fingerprint)[-1]


def _same_level(a: str, b: str) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    x, y = _levels(a), _levels(b)
    level = min(len(x), len(y)) - 1
    return x[level], y[level]


def likeness(a: str, b: str) -> float:
    if not a or not b:
        return float(a == b)
    (_, x), (_, y) = _same_level(a, b)
    if not len(x) or not len(y):
        return 0.0
    both = np.concatenate([x, y])
    value, inverse = np.unique(both, return_inverse=True)
    one, other = np.bincount(inverse[: len(x)], minlength=len(value)), np.bincount(inverse[len(x) :], minlength=len(value))
    return float(2 * np.minimum(one, other).sum() / len(both))


def matches(a: str, b: str) -> list[tuple[int, int]]:
    """Places (in a, in b) of equal anchors, the i-th of a value with the i-th."""
    (p, x), (q, y) = _same_level(a, b)
    left, right = {}, {}
    for places, values, into in ((p, x, left), (q, y, right)):
        for at, v in zip(places.tolist(), values.tolist(), strict=True):
            into.setdefault(v, []).append(at)
    return sorted(m for v in left.keys() & right.keys() for m in zip(left[v], right[v], strict=False))


def fingerprint_texts(texts: list[str], k: int = K, s: int = S) -> list[str]:
    out: list[str] = []
    for c in chunks(pa.array(texts, type=pa.large_string())):
        out += encode(c, k, s)
    return out


def fingerprints(docs: DataFrame, k: int = K, s: int = S) -> DataFrame:
    """doc_id, fingerprint for every row: one pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch.column("text")):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(c.lo, c.hi - c.lo), pa.array(encode(c, k, s))], names=["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fingerprint string")


_RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _compare(ids: list, texts: list[str], following: list[str], k: int, s: int) -> dict:
    changed = [edited(a, b) for a, b in zip(texts, following, strict=True)]
    prints, changed_prints = fingerprint_texts(texts, k, s), fingerprint_texts(changed, k, s)
    next_prints = fingerprint_texts(following[-1:], k, s)
    nexts = [*prints[1:], *next_prints]
    return {
        "doc_id": pa.array(ids, type=pa.int64()), "n_chars": pa.array([len(t) for t in texts], type=pa.int64()),
        "edited_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]), "fingerprint": pa.array(prints), "edited_fingerprint": pa.array(changed_prints),
        "near_edited": pa.array([likeness(a, b) for a, b in zip(prints, changed_prints, strict=True)]), "near_next": pa.array([likeness(a, b) for a, b in zip(prints, nexts, strict=True)]),
    }


def _cuts_above(value: Column, cuts: list[int]) -> Column:
    """How many of the falling cuts are above the value (all, if it is null), by two steps of about a root of their number."""
    if not cuts:
        return F.lit(0)
    width = math.isqrt(len(cuts) - 1) + 1
    blocks = [cuts[i : i + width] for i in range(0, len(cuts), width)]
    above = lambda c: F.coalesce(c > value, F.lit(True))
    whole = F.size(F.filter(F.array(*[F.lit(b[-1]) for b in blocks]), above))
    rest = F.get(F.array(*[F.array(*map(F.lit, b)) for b in blocks]), whole)
    return F.when(whole == len(blocks), len(cuts)).otherwise(whole * width + F.size(F.filter(rest, above))).cast("int")


def edited_likeness(docs: DataFrame, k: int = K, s: int = S) -> DataFrame:
    """Each text against its edited form and its follower, by descending id (ties by text; null ids last).

    Texts are dealt once, by ranges of ids cut at quantiles, and sorted. A task holds one row back until
    its follower comes. The last row of a range needs the first of the next one: that row is dealt to
    both, as a guard behind the range's own rows. After the last range comes the first.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    parts = max(1, fan_out(docs))
    cuts = rows.agg(F.percentile_approx("doc_id", [i / parts for i in range(parts - 1, 0, -1)] or [0.5], F.lit(max(10_000, 100 * parts)))).first()[0] or []
    cuts = sorted(set(cuts), reverse=True)
    # range number: how many cuts the id is not above; a null id is below them all
    rows = rows.withColumn("part", _cuts_above(F.col("doc_id"), cuts))
    heads = rows.groupBy("part").agg(F.max("doc_id").alias("top"))
    around = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # one row for each range: bounded by the number of partitions
    follows = heads.select("part", F.coalesce(F.lag("part").over(Window.orderBy("part")), F.last("part").over(around)).alias("before"), "top")
    guard = rows.join(F.broadcast(follows.withColumnRenamed("part", "own")), (F.col("part") == F.col("own")) & F.col("doc_id").eqNullSafe(F.col("top")))
    guard = guard.groupBy("own").agg(F.first("before").alias("part"), F.first("doc_id").alias("doc_id"), F.min("text").alias("text")).select("doc_id", "text", "part", F.lit(True).alias("guard"))
    order = ["part", "guard", F.col("doc_id").desc_nulls_last(), "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        texts: list[str] = []
        size = 0
        for batch in batches:
            for i, text, guards in zip(*(batch.column(x).to_pylist() for x in ("doc_id", "text", "guard")), strict=True):
                ids.append(i)
                texts.append(text)
                size += len(text)
                if guards or len(texts) > 256 or size > CHUNK_BYTES:
                    if len(texts) > 1:
                        yield pa.RecordBatch.from_pydict(_compare(ids[:-1], texts[:-1], texts[1:], k, s))
                    ids, texts = (ids[-1:], texts[-1:]) if not guards else ([], [])
                    size = sum(map(len, texts))
        if texts:
            raise ValueError("a range came without its guard")

    every = rows.withColumn("guard", F.lit(False)).unionByName(guard)
    return every.repartitionById(max(1, len(cuts) + 1), "part").sortWithinPartitions(*order).mapInArrow(run, _RESULT)
