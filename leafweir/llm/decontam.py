"""Benchmark decontamination by prefix-filtered set join (op 3).

Every run of ten consecutive item words is a window (an item of one to nine words is one window).
A window is contained in a text when its words occur there consecutively. Its elements are its
three-word shingles (fewer in shorter windows), ordered by rarity over the whole corpus; as all of
them must occur, the one rarest shingle is the prefix that has to be joined. A text's shingle that
meets a prefix fixes where the window would start (position bound) and end (length bound); the
words in between are then compared one by one.

The corpus is read twice: once to count how often each benchmark shingle occurs, once to join.
Windows go to the tasks in blocks of at most ``block`` (bounded memory); a larger benchmark takes
one pass over the corpus for each block, and texts are put together by id and text afterwards.

Defined results: null or wordless texts have no words, no hits and the digest of nothing. Items that
are null or wordless have no window. Items with equal ids count as one id; the windows of an item
without an id hit words as others do, but it is not among the items.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import U64, chunks, gram_hash, ranges, words

WINDOW = 10
SHINGLE = 3
BLOCK = 200_000


class Block(NamedTuple):
    """Distinct windows (w x WINDOW word hashes, zero-padded), lengths, and the items of each."""

    words: np.ndarray
    length: np.ndarray
    item_off: np.ndarray
    items: np.ndarray
    grams: dict[int, np.ndarray]


def _shingle_size(length: int) -> int:
    return min(SHINGLE, length)


def item_windows(texts: list[str], ids: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes, length, item id) of every window."""
    rows, lengths, owners = [], [], []
    for c in chunks(pa.array(texts, type=pa.large_string())):
        w = words(c)
        n = np.diff(w.off)
        full = np.where(n >= WINDOW, n - WINDOW + 1, 0)
        at = ranges(w.off[:-1], full)
        if len(at):
            rows.append(w.hash[at[:, None] + np.arange(WINDOW)])
            lengths.append(np.full(len(at), WINDOW))
            owners.append(np.repeat(np.arange(c.lo, c.hi), full))
        for i in np.flatnonzero((n > 0) & (n < WINDOW)):
            row = np.zeros((1, WINDOW), dtype=U64)
            row[0, : n[i]] = w.hash[w.off[i] : w.off[i + 1]]
            rows.append(row)
            lengths.append(np.array([n[i]]))
            owners.append(np.array([c.lo + i]))
    if not rows:
        return np.zeros((0, WINDOW), dtype=U64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.concatenate(rows), np.concatenate(lengths), np.asarray(ids, dtype=np.int64)[np.concatenate(owners)]


def _blocks(benchmark: DataFrame, block: int) -> Iterator[Block]:
    """The benchmark, item by item, in blocks of about ``block`` windows; one is held at a time."""

    def packed(rows: list, lengths: list, owners: list, named: list) -> Block:
        w, n, o, has = (np.concatenate(x) for x in (rows, lengths, owners, named))
        w, inverse = np.unique(np.column_stack([w, n.astype(U64)]), axis=0, return_inverse=True)
        pair = np.unique(np.column_stack([inverse.ravel(), o])[has], axis=0)
        n = w[:, -1].astype(np.int64)
        grams: dict[int, list] = {}
        for size, of in _by_length(n):
            grams.setdefault(_shingle_size(size), []).append(_row_grams(w[of, :size], _shingle_size(size)).ravel())
        return Block(np.ascontiguousarray(w[:, :-1]), n, np.searchsorted(pair[:, 0], np.arange(len(w) + 1)), pair[:, 1], {k: np.unique(np.concatenate(g)) for k, g in grams.items()})

    held: tuple[list, ...] = ([], [], [], [])
    size = 0
    for item in benchmark.select(F.col("item_id").cast("long"), F.col("text")).filter("text is not null").toLocalIterator():
        w, n, o = item_windows([item[1]], [0 if item[0] is None else item[0]])
        for lo in range(0, len(n), block):
            part = slice(lo, lo + block)
            for into, x in zip(held, (w[part], n[part], o[part], np.full(len(n[part]), item[0] is not None)), strict=True):
                into.append(x)
            size += len(held[0][-1])
            if size >= block:
                yield packed(*held)
                held, size = ([], [], [], []), 0
    if size:
        yield packed(*held)


def _by_length(n: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    for size in np.unique(n).tolist():
        yield size, np.flatnonzero(n == size)


def _row_grams(w: np.ndarray, k: int) -> np.ndarray:
    """``gram_hash`` of every k consecutive words of each row."""
    rows, n = w.shape
    flat = gram_hash(np.ascontiguousarray(w).ravel(), k)
    return flat[np.arange(rows)[:, None] * n + np.arange(n - k + 1)]


def _find(table: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in values that are in the sorted table, and where in it."""
    at = np.searchsorted(table, values)
    at[at == len(table)] = 0
    hit = np.flatnonzero(table[at] == values)
    return hit, at[hit]


def _maybe(table: np.ndarray) -> np.ndarray:
    """A small filter on 20 low bits, so most shingles need no search."""
    filt = np.zeros(1 << 20, dtype=bool)
    filt[(table & U64((1 << 20) - 1)).astype(np.int64)] = True
    return filt


def _counts(docs: DataFrame, block: Block) -> dict[int, np.ndarray]:
    """How often each shingle of the block's windows occurs in the corpus."""
    shared = docs.sparkSession.sparkContext.broadcast({k: (v, _maybe(v)) for k, v in block.grams.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {k: np.zeros(len(v), dtype=np.int64) for k, (v, _) in shared.value.items()}
        for batch in batches:
            for c in chunks(batch.column("text")):
                h = words(c).hash
                for k, (table, filt) in shared.value.items():
                    g = gram_hash(h, k)  # counts over text borders are too many by a few; only the order matters
                    g = g[filt[(g & U64((1 << 20) - 1)).astype(np.int64)]]
                    total[k] += np.bincount(_find(table, g)[1], minlength=len(table))
        for k, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict({"k": pa.array(np.full(len(at), k), type=pa.int32()), "at": pa.array(at, type=pa.int64()), "n": pa.array(n[at], type=pa.int64())})

    found = docs.select("text").mapInArrow(run, "k int, at long, n long").groupBy("k", "at").agg(F.sum("n").alias("n")).toArrow()
    out = {k: np.zeros(len(v), dtype=np.int64) for k, v in block.grams.items()}
    k, at, n = (found.column(x).to_numpy() for x in ("k", "at", "n"))
    for size in out:
        out[size][at[k == size]] = n[k == size]
    return out


class _Prefixes(NamedTuple):
    key: np.ndarray
    first: np.ndarray
    window: np.ndarray
    place: np.ndarray
    filt: np.ndarray


def _prefixes(block: Block, counts: dict[int, np.ndarray]) -> dict[int, _Prefixes]:
    """For each shingle size: the sorted prefix shingles and, for each, the windows it stands for."""
    found: dict[int, list] = {}
    for size, of in _by_length(block.length):
        k = _shingle_size(size)
        g = _row_grams(block.words[of, :size], k)
        often = counts[k][np.searchsorted(block.grams[k], g)]
        # the rarest of a window; of those the least, and where it stands first
        least = np.where(often == often.min(axis=1)[:, None], g, U64(2**64 - 1))
        place = least.argmin(axis=1)
        found.setdefault(k, []).append((g[np.arange(len(of)), place], of, place))
    out = {}
    for k, parts in found.items():
        key, of, place = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(key, kind="stable")
        unique, first = np.unique(key[order], return_index=True)
        out[k] = _Prefixes(unique, np.append(first, len(order)), of[order], place[order], _maybe(unique))
    return out


def contained(h: np.ndarray, off: np.ndarray, block: Block, prefixes: dict[int, _Prefixes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, first word, window) of every occurrence, verified word by word."""
    starts, windows = [], []
    for k, p in prefixes.items():
        g = gram_hash(h, k)
        near = np.flatnonzero(p.filt[(g & U64((1 << 20) - 1)).astype(np.int64)])
        hit, at = _find(p.key, g[near])
        where = near[hit]
        n = p.first[at + 1] - p.first[at]
        entry = ranges(p.first[at], n)
        start, window = np.repeat(where, n) - p.place[entry], p.window[entry]
        ok = start >= 0
        starts.append(start[ok])
        windows.append(window[ok])
    if not starts:
        return (np.zeros(0, dtype=np.int64),) * 3
    start, window = np.concatenate(starts), np.concatenate(windows)
    length = block.length[window]
    text = np.searchsorted(off, start, side="right") - 1
    ok = start + length <= off[np.minimum(text + 1, len(off) - 1)]
    start, window, length, text = start[ok], window[ok], length[ok], text[ok]
    for j in range(WINDOW):
        ok = (j >= length) | (h[np.minimum(start + j, max(0, len(h) - 1))] == block.words[window, j])
        start, window, length, text = start[ok], window[ok], length[ok], text[ok]
    return text, start, window


def _digest(ids) -> str:
    return hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()


RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def _join(docs: DataFrame, block: Block, prefixes: dict[int, _Prefixes], keep: list[str], schema: str, spans: bool) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast((block, prefixes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, prefixes = shared.value
        for batch in batches:
            for c in chunks(batch.column("text")):
                w = words(c)
                n = c.hi - c.lo
                text, start, window = contained(w.hash, w.off, block, prefixes)
                edge = np.zeros(len(w.hash) + 1, dtype=np.int64)
                np.add.at(edge, start, 1)
                np.add.at(edge, start + block.length[window], -1)
                under = np.cumsum(edge[:-1]) > 0
                total = np.concatenate([[0], np.cumsum(under)])
                hits = total[w.off[1:]] - total[w.off[:-1]]
                items: list[list[int]] = [[] for _ in range(n)]
                if len(text):
                    m = block.item_off[window + 1] - block.item_off[window]
                    pair = np.unique(np.column_stack([np.repeat(text, m), block.items[ranges(block.item_off[window], m)]]), axis=0)
                    cut = np.searchsorted(pair[:, 0], np.arange(n + 1))
                    for i in np.unique(pair[:, 0]).tolist():
                        items[i] = pair[cut[i] : cut[i + 1], 1].tolist()
                own = [batch.column(x).slice(c.lo, n) for x in keep]
                if spans:
                    begin, end = np.flatnonzero(np.diff(under.astype(np.int8), prepend=0) == 1), np.flatnonzero(np.diff(under.astype(np.int8), append=0) == -1) + 1
                    # hit runs end at text borders as windows do; adjoining texts may share a run, so cut there
                    runs: list[list[dict]] = [[] for _ in range(n)]
                    for a, b in zip(begin.tolist(), end.tolist(), strict=True):
                        i = int(np.searchsorted(w.off, a, side="right")) - 1
                        while a < b:
                            stop = min(b, int(w.off[i + 1]))
                            if stop > a:
                                runs[i].append({"first": a - int(w.off[i]), "count": stop - a})
                            a, i = stop, i + 1
                    extra = [pa.array(np.diff(w.off)), pa.array(items, type=pa.list_(pa.int64())), pa.array(runs, type=pa.list_(pa.struct([("first", pa.int64()), ("count", pa.int64())])))]
                    yield pa.RecordBatch.from_arrays([*own, *extra], names=[*keep, "n_words", "items", "runs"])
                else:
                    extra = [pa.array(np.diff(w.off)), pa.array(hits), pa.array([len(x) for x in items], type=pa.int64()), pa.array([_digest(x) for x in items]), pa.array(hits > 0)]
                    yield pa.RecordBatch.from_arrays([*own, *extra], names=[*keep, "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    return docs.mapInArrow(run, schema)


def overlaps(docs: DataFrame, benchmark: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated: one row per row of docs."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    blocks = _blocks(benchmark, block)
    first, second = next(blocks, None), next(blocks, None)
    if first is None:
        none = Block(np.zeros((0, WINDOW), dtype=U64), np.zeros(0, dtype=np.int64), np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.int64), {})
        return _join(rows, none, {}, ["doc_id"], RESULT, False)
    if second is None:
        return _join(rows, first, _prefixes(first, _counts(rows, first)), ["doc_id"], RESULT, False)
    return _in_blocks(rows, itertools.chain((first, second), blocks))


def _in_blocks(rows: DataFrame, blocks: Iterator[Block]) -> DataFrame:
    """One pass for each block; then hits are united for each (id, text digest).

    Rows alike in both have the same hits, so any one of them stands for all in the union and the
    count of such rows restores them.
    """
    rows = rows.withColumn("text_md5", F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    schema = "doc_id long, text_md5 string, n_words long, items array<long>, runs array<struct<first: long, count: long>>"
    passes = None
    for b in blocks:
        found = _join(rows, b, _prefixes(b, _counts(rows, b)), ["doc_id", "text_md5"], schema, True)
        passes = found if passes is None else passes.unionByName(found)
    same = rows.groupBy("doc_id", "text_md5").agg(F.count(F.lit(1)).alias("rows"))
    per = passes.groupBy("doc_id", "text_md5").agg(F.max("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"), F.flatten(F.collect_set("runs")).alias("runs"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = batch.to_pylist()
            hits = []
            for r in got:
                covered = np.zeros(r["n_words"] + 1, dtype=np.int64)
                for x in r["runs"]:
                    covered[x["first"]] += 1
                    covered[x["first"] + x["count"]] -= 1
                hits.append(int((np.cumsum(covered) > 0).sum()))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_words": batch.column("n_words"), "n_hit": pa.array(hits, type=pa.int64()), "n_items": pa.array([len(r["items"]) for r in got], type=pa.int64()), "items_sha256": pa.array([_digest(r["items"]) for r in got]), "contaminated": pa.array([h > 0 for h in hits])})

    joined = per.join(same.withColumnsRenamed({"doc_id": "_id", "text_md5": "_md5"}), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_md5") == F.col("_md5")))
    return joined.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("rows")))).select("doc_id", "n_words", "items", "runs").mapInArrow(finish, RESULT)


def clean(docs: DataFrame, benchmark: DataFrame, block: int = BLOCK) -> DataFrame:
    """The documents without a benchmark window, all columns kept."""
    keep = list(docs.columns)
    for b in _blocks(benchmark, block):
        prefixes = _prefixes(b, _counts(docs, b))
        shared = docs.sparkSession.sparkContext.broadcast((b, prefixes))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own, prefixes = shared.value
            for batch in batches:
                hit = np.zeros(batch.num_rows, dtype=bool)
                text = batch.column(keep.index("text"))
                for c in chunks(text):
                    w = words(c)
                    hit[contained(w.hash, w.off, own, prefixes)[0] + c.lo] = True
                yield batch.filter(pa.array(~hit))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


ORACLE = r"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
i as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
win as (
  select distinct item_id, 10 as n, array_to_string(w[k:k + 9], ' ') as gram from (select item_id, w, unnest(range(1, len(w) - 8)) as k from i where len(w) >= 10)
  union all select distinct item_id, len(w), array_to_string(w, ' ') from i where len(w) between 1 and 9),
lens as (select distinct n from win),
occ as (select d.doc_id, k, lens.n, array_to_string(w[k:k + lens.n - 1], ' ') as gram from d, lens, unnest(range(1, len(w) - lens.n + 2)) as u(k) where len(w) >= lens.n),
hit as (select occ.doc_id, occ.k, occ.n, win.item_id from occ join win using (n, gram)),
words as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(k, k + n)) as p from hit) group by doc_id),
items as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as names from (select distinct doc_id, cast(item_id as varchar) as item from hit where item_id is not null) group by doc_id)
select d.doc_id, cast(len(d.w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join words using (doc_id) left join items using (doc_id)
"""
