"""Quality classifier: ordinal cumulative-link regression on graded ratings (op 5).

Grades 0 < 1 < ... < G share one vector of weights over hashed text features; ordered thresholds
``t_1 < ... < t_G`` turn a score into P(grade >= g) = sigmoid(score - t_g). Thresholds are kept in
order by holding their gaps as exponentials. Scores give the expected grade and the tail
probability P(grade >= ``select``), by which texts are selected.

Features (whole texts): presence of each word and of each run of punctuation, by hash; binned shape
figures: shares of upper-case, lower-case, digits, spaces and punctuation, words alike that adjoin,
distinct words and lines, word length, length, words a line. Only words whose grades differ from
those of the sample by ``Z`` standard deviations keep a weight: the many others would add up to noise
in long texts.

Fitting takes at most ``sample`` labelled rows, those of least hash of (doc_id, text): a bound that
is a parameter, as the model's size is. Scoring covers every row and needs no shuffle.

Defined results: null and empty texts have a bias and shape only. Rows without a label or with null
grades are not learned from. With no labelled row at all every grade is as likely.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._text import U64, Chunk, Words, chunks, mix64, prefix_hash, ranges, span_hash, words

BITS = 18
SAMPLE = 12_000
EPOCHS = 12
LEAST_STEPS = 500
Z = 4.0
_SHAPES = 12
_BINS = 12


class Model(NamedTuple):
    weights: np.ndarray
    known: np.ndarray
    thresholds: np.ndarray
    bits: int


def grade_of(quality: Column, toxic: Column) -> Column:
    """0 toxic, 1 of low quality, 2 good; null where neither label says."""
    return F.when(toxic == 1, 0).when(quality == 0, 1).when(quality == 1, 2)


_CLASS = np.zeros(256, dtype=np.uint8)  # 0 other
_CLASS[[*range(65, 91)]] = 1
_CLASS[[*range(97, 123), *range(128, 256)]] = 2
_CLASS[48:58] = 3
_CLASS[[9, 10, 11, 12, 13, 32]] = 4


def _shape(c: Chunk, w: Words, distinct: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    """texts x _SHAPES bin numbers."""
    n = c.hi - c.lo
    size = np.maximum(np.diff(c.off), 1).astype(np.float64)
    kinds = np.zeros((n, 5))
    cls = _CLASS[c.data]
    for k in range(5):
        run = np.concatenate([[0], np.cumsum(cls == k)])
        kinds[:, k] = run[c.off[1:]] - run[c.off[:-1]]
    shares = kinds / size[:, None]
    letters = np.maximum(kinds[:, 1] + kinds[:, 2], 1)
    newline = np.concatenate([[0], np.cumsum(c.data == 10)])
    lines = newline[c.off[1:]] - newline[c.off[:-1]] + 1
    nw = np.maximum(n_words, 1)
    h = w.hash
    again = np.concatenate([[0], np.cumsum(np.append(False, h[1:] == h[:-1]))]) if len(h) else np.zeros(1, dtype=np.int64)
    alike = again[w.off[1:]] - again[w.off[:-1]]
    root = lambda x: np.sqrt(x) * _BINS
    cols = [
        *(root(shares[:, k]) for k in range(5)), root(kinds[:, 1] / letters), root(alike / nw), distinct / nw * _BINS,
        letters / nw, np.log2(size), np.log2(1 + n_words / lines), root(kinds[:, 0] / (kinds[:, 0] + nw)),
    ]
    return np.stack([np.clip(x, 0, _BINS - 1).astype(np.int64) for x in cols], axis=1)


def features(c: Chunk, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offsets, word features, texts x _SHAPES shape features): features of each text, no value twice."""
    w = words(c)
    n = c.hi - c.lo
    text = np.repeat(np.arange(n), np.diff(w.off))
    mark = _CLASS[c.data] == 0
    edge = np.ones(len(mark) + 1, dtype=bool)
    edge[1:-1] = mark[1:] != mark[:-1]
    edge[c.off] = True
    border = np.flatnonzero(edge)
    start, end = border[:-1], border[1:]
    run = mark[start] if len(mark) else np.zeros(0, dtype=bool)
    start, end = (start[run], end[run]) if len(mark) else (border[:0], border[:0])
    marks = mix64(span_hash(prefix_hash(c.data), start, end) + U64(1))
    h = (np.concatenate([w.hash, marks]) >> U64(64 - bits)).astype(np.int64)
    key = np.unique(np.concatenate([text, np.searchsorted(c.off, start, side="right") - 1]) * (1 << bits) + h)
    own = key >> bits
    off = np.searchsorted(own, np.arange(n + 1))
    shape = _shape(c, w, np.diff(off), np.diff(w.off))
    return off, key & ((1 << bits) - 1), (1 << bits) + shape + np.arange(_SHAPES) * _BINS


def _scores(m: Model, off: np.ndarray, feature: np.ndarray, shape: np.ndarray) -> np.ndarray:
    value = m.known[feature]
    total = np.concatenate([[0], np.cumsum(value * m.weights[feature])])
    return (total[off[1:]] - total[off[:-1]]) + m.weights[shape].sum(axis=1) / np.sqrt(_SHAPES)


def _tails(score: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(score[:, None] - thresholds, -40, 40)))


def fit(docs: DataFrame, graded: DataFrame, bits: int = BITS, sample: int = SAMPLE, epochs: int = EPOCHS, seed: int = 7) -> Model:
    """docs: doc_id, text; graded: doc_id, grade. The sample is picked among the labels, so only its texts move.

    Of contradicting grades of an id the lowest holds; of several texts of an id the one of least hash.
    """
    lowest = graded.filter("doc_id is not null and grade is not null").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.min("grade").cast("int").alias("grade"))
    pick = lowest.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), "text").join(F.broadcast(pick), "_id")  # at most `sample` ids
    one = texts.groupBy("_id", "grade").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    size = 1 << bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch.column("text")):
                off, feature, shape = features(c, bits)
                lists = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(feature.astype(np.int32)))
                shapes = pa.ListArray.from_arrays(pa.array(np.arange(0, shape.size + 1, _SHAPES, dtype=np.int32)), pa.array(shape.ravel().astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column("_id").slice(c.lo, c.hi - c.lo), batch.column("grade").slice(c.lo, c.hi - c.lo), lists, shapes], names=["_id", "grade", "words", "shape"])

    got = one.mapInArrow(run, "_id long, grade int, words array<int>, shape array<int>").toArrow()
    if not got.num_rows:
        return Model(np.zeros(size + _SHAPES * _BINS), np.ones(size), np.zeros(1), bits)
    got = got.sort_by("_id").combine_chunks()
    grade = got["grade"].to_numpy().astype(np.int64)
    lists = got["words"].combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    off, feature = lists.offsets.to_numpy().astype(np.int64), lists.values.to_numpy().astype(np.int64)
    shapes = got["shape"].combine_chunks()
    shapes = shapes.chunk(0) if isinstance(shapes, pa.ChunkedArray) else shapes
    shape = shapes.values.to_numpy().astype(np.int64).reshape(len(grade), _SHAPES)
    return _descend(off, feature, shape, grade, bits, epochs, seed)


def _descend(off, feature, shape, grade, bits, epochs, seed) -> Model:
    """Adam over mini-batches on the cumulative-link likelihood."""
    size, levels = 1 << bits, int(grade.max())
    owner = np.repeat(np.arange(len(grade)), np.diff(off))
    df, keep = np.bincount(feature, minlength=size), np.zeros(size, dtype=bool)
    for g in range(1, levels + 1):
        p = (grade >= g).mean()
        k = np.bincount(feature[grade[owner] >= g], minlength=size)
        keep |= np.abs(k - df * p) >= Z * np.sqrt(df * p * (1 - p) + 0.5)
    known = (keep & (df >= 5)).astype(np.float64)
    dim = size + _SHAPES * _BINS
    w, m1, m2 = np.zeros(dim), np.zeros(dim), np.zeros(dim)
    # thresholds t_1, t_1 + e^a, ...
    share = np.clip([(grade >= g).mean() for g in range(1, levels + 1)], 1e-3, 1 - 1e-3)
    start = -np.log(share / (1 - share))
    q = np.concatenate([start[:1], np.log(np.maximum(np.diff(start), 0.05))]) if levels else np.zeros(1)
    q1, q2 = np.zeros(len(q)), np.zeros(len(q))
    weight = len(grade) / (np.bincount(grade, minlength=levels + 1) * (levels + 1.0)).clip(1)
    weight = np.sqrt(weight)  # rare grades count more, not fully evenly
    draw, step = np.random.default_rng(seed), 0

    def cuts() -> np.ndarray:
        return q[0] + np.concatenate([[0], np.cumsum(np.exp(q[1:]))])

    batch = int(np.clip(len(grade) // 40, 16, 256))
    for _ in range(max(epochs, -(-LEAST_STEPS * batch // len(grade)))):
        order = draw.permutation(len(grade))
        for lo in range(0, len(order), batch):
            at = np.sort(order[lo : lo + batch])
            n = off[at + 1] - off[at]
            own, f = np.repeat(np.arange(len(at)), n), feature[ranges(off[at], n)]
            v = known[f]
            score = np.bincount(own, v * w[f], minlength=len(at)) + w[shape[at]].sum(axis=1) / np.sqrt(_SHAPES)
            t = cuts()
            tail = _tails(score, t)
            above = np.concatenate([np.ones((len(at), 1)), tail, np.zeros((len(at), 1))], axis=1)
            g = grade[at]
            i = np.arange(len(at))
            p = np.maximum(above[i, g] - above[i, g + 1], 1e-9)
            slope = above * (1 - above)
            scale = weight[g] / p
            d_score = -(slope[i, g] - slope[i, g + 1]) * scale
            d_t = np.zeros(levels + 2)
            np.add.at(d_t, g, slope[i, g] * scale)
            np.add.at(d_t, g + 1, -slope[i, g + 1] * scale)
            d_t = d_t[1:-1] / len(at)
            d_q = np.concatenate([[d_t.sum()], [d_t[j:].sum() * np.exp(q[j]) for j in range(1, len(q))]])
            d = np.bincount(f, v * d_score[own], minlength=dim) / len(at)
            d += np.bincount(shape[at].ravel(), np.repeat(d_score, _SHAPES) / np.sqrt(_SHAPES), minlength=dim) / len(at)
            d += 2e-5 * w
            step += 1
            for x, dx, a, b, rate in ((w, d, m1, m2, 0.05), (q, d_q, q1, q2, 0.02)):
                a *= 0.9
                a += 0.1 * dx
                b *= 0.99
                b += 0.01 * dx * dx
                x -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-6)
    return Model(w, known, cuts(), bits)


def score(docs: DataFrame, model: Model, select: int | None = None, at_least: float = 0.5) -> DataFrame:
    """doc_id, expected_grade, p_select, keep for every row; keep where P(grade >= select) reaches at_least."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size: 2 ** bits weights
    top = len(model.thresholds) if select is None else select

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for c in chunks(batch.column("text")):
                tail = _tails(_scores(m, *features(c, m.bits)), m.thresholds)
                expected, p = tail.sum(axis=1), tail[:, top - 1]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(c.lo, c.hi - c.lo), pa.array(expected), pa.array(p), pa.array(p >= at_least)], names=["doc_id", "expected_grade", "p_select", "keep"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, expected_grade double, p_select double, keep boolean")


def grades(labels: DataFrame) -> DataFrame:
    """doc_id, grade of a table of quality and toxic labels."""
    return labels.select("doc_id", grade_of(F.col("quality"), F.col("toxic")).alias("grade"))
