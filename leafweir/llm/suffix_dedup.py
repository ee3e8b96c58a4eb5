"""Removal of repeated passages by distributed rank doubling over suffixes (op 4).

A byte is removed when a string of ``length`` bytes that covers it starts anywhere else too. Whether
a suffix's first ``length`` bytes are unique is settled as in prefix doubling: Spark sorts suffixes by
(rank of a shorter prefix, rank of its extension); a suffix whose short rank is unique leaves, one
whose extension is shared has passed the threshold, and the rest are reranked at the next length.

Ranking every byte's suffix would move some 16 bytes for each byte of text and round. Neighbouring
suffixes share most of their bytes, so a whole run of them is ranked at once: the bytes that all its
windows have in common (the core) are the short prefix, the bytes that any has (the span) the
extension. A unique core means that no window of the run recurs, a shared span that all do.

* Round 1: runs are the windows that share an anchor, the least ``anchor``-byte string in a window
  by hash; an anchor depends on its window alone, so equal windows have equal anchors.
* Round 2: runs of ``run`` windows, cut at fixed distances from the anchor.
* Round 3: single windows; core and span are the window itself, so nothing is left open.

Equal texts are one: they are removed whole from ``length`` bytes on, and one of them takes part
against the others. Ranks are 64-bit polynomial hashes to two bases; a core and span agree falsely
with a chance of 2**-128 for each pair of runs. A text's key is unique: where the leading bits of two
digests agree, the next bits number the texts.

Hot ranks: runs alike in core and span are settled within a batch, and one of each goes on. A core
with very many spans (a phrase in a third of all texts, in ever other surroundings) would meet in one
task; such cores are looked for in one text of ``SAMPLE``, and as two spans were seen there, that there
are others is known: only equal spans still have to meet, so the core's runs are dealt by span. The
sample decides on routes alone, never on results.

Defined results: null counts as empty; texts of fewer than ``length`` bytes lose nothing.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._store import fan_out, materialize, scratch, spread_back
from ._text import BASE_A, BASE_B, CHUNK_BYTES, U64, all_spans, buffers, chunks, mix64, prefix_hash, ranges, sliding, span_hash

LENGTH, ANCHOR, RUN = 200, 100, 16
#: Suffix runs: core and span rank, text key, anchor's place, first window before the anchor, number of windows.
RUNS = "core long, span long, key long, anchor int, back short, count int, done boolean, salt short, more boolean"
#: One text of so many is looked at for hot cores, which are those of at least HOT sampled runs; at most ROUTES of them.
SAMPLE, HOT, ROUTES = 64, 16, 10_000
_NAMES = [f.split()[0] for f in RUNS.split(", ")]


def _runs(core, span, key, anchor, back, count, done, hot) -> pa.RecordBatch:
    dealt = np.isin(core.view(np.int64), hot)
    salt = np.where(dealt, span.view(np.int64) & 0x7FFF, 0).astype(np.int16)
    return pa.RecordBatch.from_arrays(
        [pa.array(core.view(np.int64)), pa.array(span.view(np.int64)), pa.array(key), pa.array(anchor.astype(np.int32)), pa.array(back.astype(np.int16)), pa.array(count.astype(np.int32)), pa.array(done), pa.array(salt), pa.array(dealt)], names=_NAMES
    )


_NONE = np.zeros(0, dtype=np.int64)


def _anchors(data: np.ndarray, off: np.ndarray, length: int, anchor: int) -> tuple[np.ndarray, ...]:
    """Runs of windows by anchor: core rank, text number, anchor's place, first and last window."""
    width = length - anchor + 1
    rank = all_spans(prefix_hash(data), anchor)
    if len(data) < length:
        return (np.zeros(0, dtype=U64), *(np.zeros(0, dtype=np.int64),) * 4)
    least = sliding(rank, width, np.minimum)  # one for each window
    n = len(least)
    text = np.searchsorted(off, np.arange(n), side="right") - 1 if len(off) > 2 else np.zeros(n, dtype=np.int64)
    inside = np.arange(n) + length <= off[text + 1]
    place = _leftmost(rank, least, width)
    at = np.flatnonzero(inside)
    if not len(at):
        return (np.zeros(0, dtype=U64), *(np.zeros(0, dtype=np.int64),) * 4)
    p, t = place[at], text[at]
    new = np.ones(len(at), dtype=bool)
    new[1:] = (p[1:] != p[:-1]) | (t[1:] != t[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    return rank[p[first]], t[first], p[first], at[first], at[last]


def _leftmost(rank: np.ndarray, least: np.ndarray, width: int) -> np.ndarray:
    """For each window the first place that holds its least rank.

    It is the first place at or after the window's start among those that are leftmost for some window.
    """
    n = len(least)
    # a place is least for some window when the greatest of the minima of the windows over it equals it
    pad = np.concatenate([np.zeros(width - 1, dtype=U64), least, np.zeros(width - 1, dtype=U64)])
    over = sliding(pad, width, np.maximum)
    place = np.flatnonzero(over[: len(rank)] == rank)
    at = np.searchsorted(place, np.arange(n))
    found = place[at]
    # a place after the start may be least only for windows further right: step on until the rank agrees
    wrong = np.flatnonzero(rank[found] != least)
    while len(wrong):
        at[wrong] += 1
        found[wrong] = place[at[wrong]]
        wrong = wrong[rank[found[wrong]] != least[wrong]]
    return found


def _first(length: int, anchor: int, hot: np.ndarray):
    """Round 1: runs by anchor. Equal runs of one batch are settled there and sent once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("key").to_numpy()
            parts = []
            for c in chunks(batch.column("text")):
                core, text, place, first, last = _anchors(c.data, c.off, length, anchor)
                if not len(core):
                    continue
                own = prefix_hash(c.data, BASE_B)
                back = place - first
                span = span_hash(own, first, last + length, BASE_B) ^ mix64(back.astype(U64) + U64(11))
                parts.append((core, span, keys[c.lo + text], place - c.off[text], back, last - first + 1))
            yield from _settled(parts, hot)

    return run


def _settled(parts: list[tuple], hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A batch's runs by rank: those that meet their like there are done; the first of each goes on.

    One that goes on and is done is settled for good then.
    """
    if not parts:
        return
    core, span, key, place, back, count = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((span, core))
    core, span, key, place, back, count = (x[order] for x in (core, span, key, place, back, count))
    same = np.zeros(len(core) + 1, dtype=bool)
    same[1:-1] = (core[1:] == core[:-1]) & (span[1:] == span[:-1])
    met = same[:-1] | same[1:]
    head = ~same[:-1]
    yield _runs(core[head], span[head], key[head], place[head], back[head], count[head], met[head], hot)
    off = np.flatnonzero(~head)
    if len(off):  # done and no longer needed for ranking: windows that adjoin go as one run, under any core that spreads them
        first, many = place[off] - back[off], count[off]
        order = np.lexsort((first, key[off]))
        k, first, many = key[off][order], first[order], many[order]
        new = np.flatnonzero(np.append(True, (k[1:] != k[:-1]) | (first[1:] > first[:-1] + many[:-1])))
        end = np.append(new[1:], len(k)) - 1
        k, begin, total = k[new], first[new], first[end] + many[end] - first[new]
        yield _runs(mix64(k.view(U64) + begin.astype(U64)), np.zeros(len(k), dtype=U64), k, begin, np.zeros(len(k), dtype=np.int64), total, np.ones(len(k), dtype=bool), _NONE)


def _rank():
    """Runs sorted by (core, span): emit what is settled (open false) and what has to be reranked (open true).

    Vectorised over batches. Held over from one batch to the next: the last run, and the head of the
    last core's first span until it is known whether another span follows.
    """

    def out(rows: np.ndarray, flag: bool) -> pa.RecordBatch:
        n = len(rows)
        return pa.RecordBatch.from_arrays([pa.array(rows["core"]), pa.array(rows["key"]), pa.array(rows["anchor"]), pa.array(rows["back"]), pa.array(rows["count"]), pa.array(np.full(n, flag))], names=["core", "key", "anchor", "back", "count", "open"])

    kind = np.dtype([("core", "i8"), ("span", "i8"), ("key", "i8"), ("anchor", "i4"), ("back", "i2"), ("count", "i4"), ("done", "?"), ("met", "?"), ("more", "?"), ("sent", "?")])

    def flush(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Whole information on these rows is there: met = shares (core, span); more = core has other spans."""
        settled = rows[rows["met"] | rows["done"]]
        if len(settled):
            yield out(settled, False)
        again = rows[rows["more"] & rows["sent"]]
        if len(again):
            yield out(again, True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(0, dtype=kind)  # at most the head of the open core's first span, and the last row
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.zeros(batch.num_rows, dtype=kind)
            for name in ("core", "span", "key", "anchor", "back", "count", "done", "more"):
                rows[name] = batch.column(name).to_numpy(zero_copy_only=False)
            rows = np.concatenate([held, rows])
            same_core = np.zeros(len(rows) + 1, dtype=bool)
            same_core[1:-1] = rows["core"][1:] == rows["core"][:-1]
            same = same_core.copy()
            same[1:-1] &= rows["span"][1:] == rows["span"][:-1]
            known = len(held)
            rows["met"] |= same[:-1] | same[1:]
            head = ~same[:-1]
            rows["sent"][known:] = head[known:]  # one of each span is reranked
            # a row belongs to a core with other spans: spans change somewhere in its core's stretch
            first = np.flatnonzero(~same_core[:-1])
            group = np.cumsum(~same_core[:-1]) - 1
            change = same_core[:-1] & ~same[:-1]
            changes = np.add.reduceat(change.astype(np.int64), first) > 0
            rows["more"] |= changes[group]
            # the last core may go on: its last row and, while it has one span only, that span's head stay
            last = first[-1]
            keep = np.zeros(len(rows), dtype=bool)
            keep[-1] = True
            if not rows["more"][-1]:
                keep[last] = True
            yield from flush(rows[~keep])
            held = rows[keep]
        yield from flush(held)

    return run


def _ranked(runs: DataFrame, name: str) -> DataFrame:
    sorted_runs = runs.repartition(fan_out(runs), "core", "salt").sortWithinPartitions("core", "span")
    return materialize(sorted_runs.mapInArrow(_rank(), "core long, key long, anchor int, back short, count int, open boolean"), name)


def _hot(runs: DataFrame) -> np.ndarray:
    """Cores of many sampled runs with more than one span among them, the most frequent first: routes, bounded by ROUTES."""
    cores = runs.groupBy("core").agg(F.count(F.lit(1)).alias("n"), F.min("span").alias("lo"), F.max("span").alias("hi")).filter(f"n >= {HOT} and lo <> hi")
    return np.sort(np.array([r["core"] for r in cores.orderBy(F.desc("n"), "core").limit(ROUTES).collect()], dtype=np.int64))


def _rerank(length: int, step: int, salt: int, hot: np.ndarray):
    """Open runs of one text, cut into runs of ``step`` windows at fixed distances from the anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            data, off = buffers(batch.column("text"))
            keys = batch.column("key").to_numpy()
            lists = batch.column("runs")
            starts, flat = lists.offsets.to_numpy(), lists.flatten()
            of = np.repeat(np.arange(batch.num_rows), np.diff(starts))
            parts = []
            core0, anchor, back, count = (flat.field(x).to_numpy(zero_copy_only=False) for x in ("core", "anchor", "back", "count"))
            i = 0
            while i < batch.num_rows:  # texts up to about a chunk at a time
                j = max(i + 1, int(np.searchsorted(off, off[i] + CHUNK_BYTES, side="right")) - 1)
                j = min(j, batch.num_rows)
                sel = slice(*np.searchsorted(of, [i, j]))
                a, b = prefix_hash(data[off[i] : off[j]]), prefix_hash(data[off[i] : off[j]], BASE_B)
                text, place, c0 = of[sel], anchor[sel].astype(np.int64), core0[sel]
                far = back[sel].astype(np.int64)  # distances of windows from the anchor: far, far - 1, ..., near
                near = far - count[sel] + 1
                blocks = far // step - near // step + 1
                own = np.repeat(np.arange(len(far)), blocks)
                block = ranges(near // step, blocks)
                base = (off[text] - off[i])[own] + place[own]
                d_far, d_near = np.minimum(far[own], block * step + step - 1), np.maximum(near[own], block * step)
                # the core is that of the whole block, whichever of its windows this run has
                core = span_hash(a, base - block * step, base - block * step - step + 1 + length)
                core = mix64(core ^ mix64(c0[own].view(U64) + block.astype(U64) * U64(64) + U64(salt)))
                span = span_hash(b, base - d_far, base - d_near + length, BASE_B) ^ mix64((d_far * 1024 + d_near).astype(U64))
                parts.append((core, span, keys[text][own], place[own], d_far, d_far - d_near + 1))
                i = j
            yield from _settled(parts, hot)

    return run


def _remove(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {x: [] for x in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "spans")}
            data, off = buffers(batch.column("text"))
            copies = batch.column("copies").to_numpy()
            lists = batch.column("runs")
            for i in range(batch.num_rows):
                text = data[off[i] : off[i + 1]]
                n = len(text)
                spans = np.zeros((0, 2), dtype=np.int64)
                if copies[i] > 1 and n >= length:
                    spans = np.array([[0, n]])
                elif lists[i].is_valid and len(lists[i]):
                    got = lists[i].values
                    first = got.field("anchor").to_numpy().astype(np.int64) - got.field("back").to_numpy()
                    order = np.argsort(first, kind="stable")
                    first, end = first[order], (first + got.field("count").to_numpy() - 1 + length)[order]
                    end = np.maximum.accumulate(end)
                    new = np.flatnonzero(np.append(True, first[1:] > end[:-1]))
                    spans = np.column_stack([first[new], end[np.append(new[1:], len(end)) - 1]])
                digest, at = hashlib.sha256(), 0
                for a, b in spans.tolist():
                    digest.update(text[at:a])
                    at = b
                digest.update(text[at:])
                out["n_bytes"].append(n)
                out["n_removed"].append(int((spans[:, 1] - spans[:, 0]).sum()))
                out["n_spans"].append(len(spans))
                out["kept_sha256"].append(digest.hexdigest())
                out["spans"].append([{"first": a, "end": b} for a, b in spans.tolist()])
            kind = {"kept_sha256": pa.string(), "spans": pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))}
            own = ["md5", "copies", "one"]
            yield pa.RecordBatch.from_arrays([*map(batch.column, own), *(pa.array(v, type=kind.get(k, pa.int64())) for k, v in out.items())], names=[*own, *out])

    return run


def _fewer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal texts of a batch as one row with their number, so that a hot text is not shuffled row by row."""
    for batch in batches:
        first: dict[str, int] = {}
        copies: list[int] = []
        one: list = []
        take: list[int] = []
        for i, (m, d) in enumerate(zip(batch.column("md5").to_pylist(), batch.column("doc_id").to_pylist(), strict=True)):
            at = first.setdefault(m, len(take))
            if at == len(take):
                take.append(i)
                copies.append(0)
                one.append(d)
            copies[at] += 1
            one[at] = d if one[at] is None else one[at] if d is None else min(d, one[at])
        kept = batch.select(["md5", "text"]).take(pa.array(take, type=pa.int64()))
        yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), pa.array(copies, type=pa.int64()), pa.array(one, type=pa.int64())], names=["md5", "text", "copies", "one"])


def repeated_passages(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, run: int = RUN) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (byte ranges): one row per row of docs."""
    md5 = F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), md5.alias("md5"), F.coalesce("text", F.lit("")).alias("text"))
    # distinct texts, laid out by key once: what is found for a text later meets it without moving the text again
    table, n = f"leafweir_texts_{uuid.uuid4().hex[:12]}", fan_out(docs)
    fewer = rows.mapInArrow(_fewer, "md5 string, text string, copies long, one long").withColumn("lead", _lead(F.col("md5")))
    distinct = fewer.repartition(n, "lead").groupBy("lead", "md5").agg(F.first("text").alias("text"), F.sum("copies").alias("copies"), F.min("one").alias("one"))
    # rows are already dealt by lead and sorted by (lead, md5)
    tie = F.row_number().over(Window.partitionBy("lead").orderBy("md5")) - 1
    key = F.when(tie < 8, F.col("lead") + tie.cast("long") * (1 << 60)).otherwise(F.raise_error(F.lit("more than eight texts share 60 bits of their digests")).cast("long"))
    texts = _Texts(distinct.withColumn("key", key).drop("lead"), table, n)
    long = texts.read().filter(F.octet_length("text") >= length).select("key", "text")
    few = F.pmod(F.xxhash64("key"), F.lit(SAMPLE)) == 0
    hot = _hot(long.filter(few).mapInArrow(_first(length, anchor, _NONE), RUNS))
    ranked = _ranked(long.mapInArrow(_first(length, anchor, hot), RUNS), "ranked")
    settled = [ranked.filter("not open")]
    for salt, step in enumerate((run, 1)):
        open_runs = ranked.filter("open").groupBy("key").agg(F.collect_list(F.struct("core", "anchor", "back", "count")).alias("runs"))
        with_text = texts.read().select("key", "text").join(open_runs, "key").select("key", "text", "runs")
        # single windows have no span beyond their core
        hot = _hot(with_text.filter(few).mapInArrow(_rerank(length, step, salt, _NONE), RUNS)) if step > 1 else _NONE
        ranked = _ranked(with_text.mapInArrow(_rerank(length, step, salt, hot), RUNS), "ranked")
        settled.append(ranked.filter("not open"))
    found = settled[0].unionByName(settled[1]).unionByName(settled[2]).groupBy("key").agg(F.collect_list(F.struct("anchor", "back", "count")).alias("runs"))
    per_text = texts.read().select("key", "md5", "copies", "one", "text").join(found, "key", "left").mapInArrow(_remove(length), "md5 string, copies long, one long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<first: long, end: long>>")
    out = spread_back(rows.select("doc_id", "md5"), per_text, ["md5"], "copies", "one", "doc_id")
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans")


def _lead(md5: Column) -> Column:
    """60 bits of a digest."""
    return F.conv(F.substring(md5, 1, 15), 16, 10).cast("long")


class _Texts:
    """The distinct texts as a bucketed table in the shared folder."""

    def __init__(self, distinct: DataFrame, table: str, n: int):
        self.spark, self.table = distinct.sparkSession, table
        path = scratch(self.spark, "texts", table)
        distinct.write.bucketBy(n, "key").option("path", path).format("parquet").saveAsTable(table)

    def read(self) -> DataFrame:
        return self.spark.table(self.table)
