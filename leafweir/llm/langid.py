"""Language identification by nearest centroids (op 6).

A text is a vector of hashed byte 1- to 3-grams of its letters (other bytes count as one space),
weighted by count * idf and set to length one (so that the language of most of a text decides). Each language has several centroids, from
spherical k-means over the vectors of a bounded, hash-picked sample of its learned texts. A text
gets the language of the nearest centroid by cosine. It is rejected when it lies further from that
centroid than its language's reach for its length (short texts lie further from any centroid), learned
from prefixes of the sampled texts and interpolated between them. A reach is the least of

* the given quantile of the sample's own distances, taken as at most three times the 0.9 quantile (so that
  some per cent of junk do not set it), times ``slack``;
* ``margin`` times the distance of the nearest other language: the median over that language's sample,
  so mislabelled rows do not move it;

but not less than the 0.9 quantile (two labels of one language do not reject each other).

Document frequencies come from all learned texts. Learning reads text and language of the rows that
it is given; a prediction reads the text alone.

Defined results: a null text or one without a letter is ``und`` with score 0 and rejected. Rows with
a null language are not learned from. With nothing to learn from every text is ``und``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._text import CHUNK_BYTES, U64, Chunk, chunks, mix64

DIMS = 4096
SAMPLE = 400
#: Most sampled texts of all languages together: with more than 40 of them, each has fewer
TOTAL = 16_000
CENTROIDS = 4
QUANTILE, SLACK, MARGIN, MOST = 0.99, 2.2, 0.8, 0.97
#: Bytes of the prefixes that a reach is learned at; the last stands for whole texts
SIZES = (8, 16, 32, 64, 128, 256, 512, 1024)

_MAP = np.full(256, 32, dtype=np.uint8)
_MAP[97:123] = np.arange(97, 123)
_MAP[65:91] = np.arange(97, 123)
_MAP[128:] = np.arange(128, 256)
#: UTF-8 lead byte C3: upper-case Latin-1 letters are 32 below the lower-case ones
_FOLD_FROM, _FOLD_TO = 0x80, 0x9E


class Model(NamedTuple):
    languages: list[str]
    owner: np.ndarray
    centroids: np.ndarray
    #: centroids x sizes
    reach: np.ndarray
    idf: np.ndarray


def _grams(c: Chunk, dims: int) -> np.ndarray:
    """texts x dims counts."""
    n = c.hi - c.lo
    low = _MAP[c.data]
    if len(low) > 1:
        upper = np.flatnonzero((c.data[:-1] == 0xC3) & (c.data[1:] >= _FOLD_FROM) & (c.data[1:] <= _FOLD_TO)) + 1
        low[upper] += 32
        space = low == 32
        run = np.zeros(len(low), dtype=bool)
        run[1:] = space[1:] & space[:-1]
        run[c.off[:-1][c.off[:-1] < len(low)]] = False
        keep = ~run
        off = np.concatenate([[0], np.cumsum(keep)])[c.off]
        low = low[keep]
    else:
        off = c.off
    text = np.repeat(np.arange(n), np.diff(off))
    a = low.astype(U64)
    out = np.zeros(n * dims, dtype=np.float32)
    for k in (1, 2, 3):
        m = len(a) - k + 1
        if m <= 0:
            break
        code = a[:m].copy()
        for j in range(1, k):
            code = code << U64(8) | a[j : j + m]
        inside = text[:m] == text[k - 1 :]
        if k == 1:
            inside &= low != 32
        place = text[:m] * dims + (mix64(code + U64(k << 32)) % U64(dims)).astype(np.int64)
        out += np.bincount(place[inside], minlength=n * dims).astype(np.float32)
    return out.reshape(n, dims)


def _vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = counts * idf
    norm = np.sqrt((v * v).sum(axis=1, keepdims=True))
    return v / np.maximum(norm, 1e-12)


def _small(column: pa.Array, dims: int) -> Iterator[Chunk]:
    """Chunks of at most so many texts that their count matrix stays within some MB."""
    most = max(1, CHUNK_BYTES // dims)
    for lo in range(0, len(column), most):
        for c in chunks(column.slice(lo, most)):
            yield Chunk(c.lo + lo, c.hi + lo, c.data, c.off)


def fit(rows: DataFrame, dims: int = DIMS, sample: int = SAMPLE, centroids: int = CENTROIDS, quantile: float = QUANTILE, slack: float = SLACK, seed: int = 11, margin: float = MARGIN, total: int = TOTAL) -> Model:
    """rows: text, lang. At most ``sample`` vectors (and beginnings of texts) of each language, and ``total`` of all, go to the driver."""
    known = rows.filter("lang is not null and text is not null").select("text", "lang")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(dims, dtype=np.int64), 0
        for batch in batches:
            for c in _small(batch.column("text"), dims):
                df += (_grams(c, dims) > 0).sum(axis=0)
                n += c.hi - c.lo
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"at": pa.array(np.append(at, -1)), "n": pa.array(np.append(df[at], n))})

    got = known.select("text").mapInArrow(frequencies, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    at, n = got.column("at").to_numpy(), got.column("n").to_numpy()
    texts, df = int(n[at == -1].sum()), np.zeros(dims)
    df[at[at >= 0]] = n[at >= 0]
    idf = (np.log((1 + texts) / (1 + df)) + 1).astype(np.float32)
    sample = max(1, min(sample, total // max(1, known.select(F.countDistinct("lang")).first()[0])))
    # the sample: per language the rows of least text hash, kept as they are met (a hot language is no larger than another)
    picked = known.withColumn("h", F.xxhash64("text")).groupBy("lang", F.pmod("h", F.lit(sample)).alias("slot")).agg(F.min_by("text", "h").alias("text"))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in _small(batch.column("text"), dims):
                v = _vectors(_grams(c, dims), idf).astype(np.float16)
                own = batch.slice(c.lo, c.hi - c.lo)
                head = pc.binary_slice(own.column("text").cast(pa.binary()), 0, SIZES[-2])
                yield pa.RecordBatch.from_arrays([own.column("lang"), own.column("slot"), pa.array([x.tobytes() for x in v], type=pa.binary()), head], names=["lang", "slot", "v", "head"])

    sampled = picked.select("lang", "slot", "text").mapInArrow(vectors, "lang string, slot long, v binary, head binary").toArrow().sort_by([("lang", "ascending"), ("slot", "ascending")])
    languages = sorted(set(sampled.column("lang").to_pylist()))
    parts = [sampled.filter(pc.equal(sampled.column("lang"), lang)) for lang in languages]
    whole = lambda part: np.frombuffer(b"".join(part.column("v").to_pylist()), dtype=np.float16).reshape(len(part), dims).astype(np.float32)
    owner, found = [], []
    for i, part in enumerate(parts):
        x = whole(part)
        c, _ = _cluster(x, min(centroids, len(x)), seed)
        owner += [i] * len(c)
        found += list(c)
    c, owner = np.array(found, dtype=np.float32).reshape(-1, dims), np.array(owner, dtype=np.int64)
    if not languages:
        return Model(languages, owner, c, np.zeros((0, len(SIZES))), idf)
    first = np.searchsorted(owner, np.arange(len(languages)))
    # distance of each language's texts from each language's nearest centroid, at each size
    reach = np.zeros((len(languages), len(SIZES)))
    for j, size in enumerate(SIZES):
        far = []
        for part in parts:
            if size < SIZES[-1]:
                cut = pc.binary_slice(part.column("head").combine_chunks(), 0, size)
                cos = np.concatenate([_vectors(_grams(x, dims), idf) @ c.T for x in _small(cut, dims)])
            else:
                cos = whole(part) @ c.T
            far.append(1 - np.maximum.reduceat(cos, first, axis=1))
        middle = np.array([np.median(d, axis=0) for d in far])
        np.fill_diagonal(middle, np.inf)
        for i, d in enumerate(far):
            top, most = np.quantile(d[:, i], [0.9, quantile])
            reach[i, j] = min(MOST, max(top, min(slack * min(most, 3 * top), margin * middle[:, i].min())))
    return Model(languages, owner, c, reach[owner], idf)


def _cluster(x: np.ndarray, k: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means with far-apart starts."""
    draw = np.random.default_rng(seed)
    c = x[[int(draw.integers(len(x)))]]
    while len(c) < k:
        far = 1 - (x @ c.T).max(axis=1).clip(-1, 1)
        c = np.concatenate([c, x[[int(draw.choice(len(x), p=far / far.sum()))]]]) if far.sum() > 1e-9 else c[: len(c)]
        if far.sum() <= 1e-9:
            break
    near = np.zeros(len(x), dtype=np.int64)
    for _ in range(20):
        before, near = near, (x @ c.T).argmax(axis=1)
        for j in range(len(c)):
            own = x[near == j]
            if len(own):
                m = own.mean(axis=0)
                c[j] = m / max(1e-12, float(np.sqrt((m * m).sum())))
        if (before == near).all():
            break
    return c, (x @ c.T).argmax(axis=1)


def _reach(reach: np.ndarray, k: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Reach of centroid k for a text of this size, between the sizes by the logarithm."""
    at = (np.log2(np.maximum(size, 1)) - np.log2(SIZES[0])).clip(0, len(SIZES) - 1)
    low = np.minimum(at.astype(np.int64), len(SIZES) - 2)
    part = at - low
    return reach[k, low] * (1 - part) + reach[k, low + 1] * part


def predict_arrow(model: Model, column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """lang_pred, score, rejected of a column of texts."""
    n, dims = len(column), len(model.idf)
    best, score, rejected = np.full(n, -1), np.zeros(n), np.ones(n, dtype=bool)
    letter = pc.match_substring_regex(column, r"\pL").fill_null(False).to_numpy(zero_copy_only=False)
    if len(model.centroids):
        for c in _small(column, dims):
            counts = _grams(c, dims)
            cos = _vectors(counts, model.idf) @ model.centroids.T
            k = cos.argmax(axis=1)
            far = _reach(model.reach, k, counts.sum(axis=1) / 3)
            s = cos[np.arange(len(k)), k]
            best[c.lo : c.hi], score[c.lo : c.hi], rejected[c.lo : c.hi] = model.owner[k], s, 1 - s > far
        best[~letter], score[~letter], rejected[~letter] = -1, 0, True
    names = np.array([*model.languages, "und"], dtype=object)
    return pa.array(names[best], type=pa.string()), score.clip(0, 1), rejected


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, rejected for every row: one pass, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x centroids x dims

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score, rejected = predict_arrow(shared.value, batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lang, pa.array(score), pa.array(rejected)], names=["doc_id", "lang_pred", "score", "rejected"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that are not rejected, all columns kept as they are."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(~predict_arrow(shared.value, batch.column(at))[2]))

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 3, is 1 (a null id is not)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def crc(doc_id: int) -> int:
    return zlib.crc32(str(doc_id).encode())
