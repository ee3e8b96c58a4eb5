"""Near-duplicate classes by BagMinHash (op 1).

A text is the multiset of its five-word shingles (a text of one to four words: all of them as one).
Each shingle's weight, its count, is discretised into the unit levels 1, 2, 3, ...; levels are held
in dyadic blocks (0,1], (1,2], (2,4], (4,8], ... and each block runs its own Poisson process of rate
``components * width``. A point has a time, a component and a level, drawn down the block; levels
above the weight are dropped. A component keeps the least time, so two texts agree in one with
exactly the probability of their weighted Jaccard. Processes stop at the text's largest component,
which takes about ``m ln m`` points a text rather than ``m`` for each shingle.

Signatures are cut into bands; texts sharing a band are candidates, and a pair is linked only when
its multiset overlap, computed from the whole texts, reaches the threshold. Classes are connected
components of the links. Nothing is capped, and no bucket's pairs are all compared:

* Within a bucket every text is compared with a centre, the text whose buckets are fullest: among
  edited copies that is the original or next to it. What links is one component.
* Each comparison also tells how much a text shares with the centre and which shingles it has
  besides. Those that no other member of the centre has can be in no partner. With ``u`` of them in
  x, ``|x & y| <= min(|x & c|, |y & c|) + min(other extra of x, of y)`` bounds the overlap exactly,
  so a text with many is out at once and most pairs fall within the join.
* Of the pairs of different components that are left in a bucket, texts outside its largest component
  are compared with the rest: ``centres`` of a bucket's in the first round, twice as many in each
  further one, so rounds are as many as the doublings up to the fullest bucket. Components merge
  between rounds, and pairs of one component need no comparison.

Buckets are dealt over tasks: a join on a bucket takes at most about ``SPREAD`` of its rows in one.
Texts are known by a number of their own, given when the table of distinct texts is written, and are
the same only if 128 bits of their words agree.

Defined results: null text counts as empty. Texts without a word form a class with equal texts only.
Equal word sequences are copies whatever their case or punctuation. Null or repeated ids are rows
like others; a class is named by its least id (null if all are null).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._store import fan_out, few, spread_back, tabled
from ._text import U64, Chunk, Words, chunks, gram_hash, mix64, ranges, words

SHINGLE = 5
BANDS, ROWS = 32, 5
THRESHOLD = 0.8
CENTRES = 512
DEAL = 64
SPREAD = 256
#: Points drawn at once; fixed, so that a point's time has the same bits whatever texts are signed with it.
STEPS = (1, 2, 4, 8, 16, 32, 64, 128, 256, 512)
CELLS = 250_000
_GOLD = U64(0x9E3779B97F4A7C15)
_STEP = U64(0xD6E8FEB86659FD93)


def shingles(w: Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hash of every shingle occurrence, in order of text."""
    n = np.diff(w.off)
    long = np.where(n >= size, n - size + 1, 0)
    at = ranges(w.off[:-1], long)
    text, value = np.repeat(np.arange(len(n)), long), gram_hash(w.hash, size)[at]
    for k in range(1, size):
        few = np.flatnonzero(n == k)
        if len(few):
            text = np.concatenate([text, few])
            value = np.concatenate([value, gram_hash(w.hash, k)[w.off[few]]])
    return text, value


def multiset(text: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, shingle) with counts, ordered by text."""
    order = np.lexsort((value, text))
    text, value = text[order], value[order]
    new = np.ones(len(text), dtype=bool)
    new[1:] = (text[1:] != text[:-1]) | (value[1:] != value[:-1])
    at = np.flatnonzero(new)
    return text[at], value[at], np.diff(np.append(at, len(text)))


def signatures(text: np.ndarray, value: np.ndarray, count: np.ndarray, texts: int, m: int) -> np.ndarray:
    """BagMinHash: least times, texts x m (inf where a text has no shingle)."""
    best = np.full(texts * m, np.inf)
    blocks = np.ceil(np.log2(count)).astype(np.int64) + 1  # (0,1], (1,2], (2,4], ...
    block = ranges(np.zeros(len(count), dtype=np.int64), blocks)
    own = np.repeat(np.arange(len(count)), blocks)
    low = np.where(block > 0, 1 << np.maximum(block - 1, 0), 0)
    width = np.maximum(low, 1)
    seed = mix64(value[own] + block.astype(U64) * _STEP)
    row, weight, time, drawn, turn = text[own], count[own], np.zeros(len(own)), 0, 0
    while len(row):
        step = STEPS[min(turn, len(STEPS) - 1)]
        k = (np.arange(drawn, drawn + step, dtype=U64) + U64(1)) * _GOLD
        for lo in range(0, len(row), max(1, CELLS // step)):
            part = slice(lo, lo + max(1, CELLS // step))
            a = mix64(seed[part, None] + k)
            gap = -np.log(((a >> U64(11)).astype(np.float64) + 0.5) * 2.0**-53) / (m * width[part])[:, None]
            times = time[part, None] + np.cumsum(gap, axis=1)
            b = mix64(a ^ _STEP)
            component = ((b >> U64(40)) * U64(m) >> U64(24)).astype(np.int64)
            level = low[part, None] + 1 + (b & (width[part] - 1).astype(U64)[:, None]).astype(np.int64)  # widths are powers of two: the low bits descend the block
            kept = level <= weight[part, None]
            np.minimum.at(best, (row[part, None] * m + component)[kept], times[kept])
            time[part] = times[:, -1]
        on = time < best.reshape(texts, m).max(axis=1)[row]
        row, weight, time, seed, low, width = row[on], weight[on], time[on], seed[on], low[on], width[on]
        drawn, turn = drawn + step, turn + 1
    return best.reshape(texts, m)


def _fold(h: np.ndarray, off: np.ndarray, salt: int) -> np.ndarray:
    """Order-sensitive hash of each run of word hashes."""
    place = np.arange(len(h)) - np.repeat(off[:-1], np.diff(off))
    total = np.concatenate([[U64(0)], np.cumsum(mix64(h ^ mix64(place.astype(U64) * _GOLD + U64(salt))))])
    return mix64(total[off[1:]] - total[off[:-1]] + np.diff(off).astype(U64) * _STEP + U64(salt))


def _keys(c: Chunk, w: Words) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each text's word sequence, or for its bytes where it has no word."""
    k1, k2 = _fold(w.hash, w.off, 1), _fold(w.hash, w.off, 2)
    none = np.flatnonzero(np.diff(w.off) == 0)
    if len(none):
        raw = mix64(c.data.astype(U64) + U64(3))
        b1, b2 = _fold(raw, c.off, 5), _fold(raw, c.off, 6)
        k1[none], k2[none] = b1[none], b2[none]
    return k1.view(np.int64), k2.view(np.int64)


def _sign(bands: int, rows: int):
    m = bands * rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch.column("text")):
                w = words(c)
                n = c.hi - c.lo
                k1, k2 = _keys(c, w)
                best = signatures(*multiset(*shingles(w)), n, m)
                parts = mix64(best.view(U64)).reshape(n, bands, rows)
                band = np.full((n, bands), U64(0))
                for j in range(rows):
                    band = mix64(band * _STEP + parts[:, :, j] + _GOLD)
                band = mix64(band + np.arange(bands, dtype=U64) * _GOLD).view(np.int64)
                has = np.diff(w.off) > 0
                off = np.concatenate([[0], np.cumsum(np.where(has, bands, 0))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(x).slice(c.lo, n) for x in ("doc_id", "text_md5")), pa.array(k1), pa.array(k2), pa.ListArray.from_arrays(pa.array(off), pa.array(band[has].ravel()))],
                    names=["doc_id", "text_md5", "k1", "k2", "bands"],
                )

    return run


_FOUND = "centre long, member long, similarity double, size long, common long, extra array<long>"


def _verify():
    """Rows sorted by centre: first the centre's text, then each member's; one centre is held at a time.

    Shingles are told apart by occurrence, so multisets are sets. ``extra`` (where wanted) are the
    member's that the centre lacks.
    """

    def bag(text: pa.Scalar) -> np.ndarray:
        c = next(chunks(pa.array([text.as_py() or ""])))
        _, value, count = multiset(*shingles(words(c)))
        return np.sort(mix64(np.repeat(value, count) + ranges(np.zeros(len(count), dtype=np.int64), count).astype(U64) * _STEP))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, centre = None, None
        for batch in batches:
            rows: list[tuple] = []
            text = batch.column("text")
            for i, (a, s, b, want) in enumerate(zip(*(batch.column(x).to_pylist() for x in ("centre", "salt", "member", "want")), strict=True)):
                own = bag(text[i])
                if b is None:
                    held, centre = own, (a, s)
                    continue
                if centre != (a, s):
                    raise ValueError("a member came without its centre")
                at = np.searchsorted(held, own)
                at[at == len(held)] = 0
                same = held[at] == own if len(held) else np.zeros(len(own), dtype=bool)
                common = int(same.sum())
                rows.append((a, b, common / max(1, len(held) + len(own) - common), len(own), common, own[~same].view(np.int64) if want else None))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds, strict=True)], names=["centre", "member", "similarity", "size", "common", "extra"])

    return run


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """A table of pairs (centre, member, want: its extra shingles, n: members of the centre) of text keys with their overlap and sizes.

    A centre's text is sent once for each DEAL of its members, so a centre with very many is dealt out.
    """
    pairs = pairs.withColumn("salts", F.ceil(F.col("n") / DEAL).cast("int"))
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("member"), "salts").cast("int"))
    heads = pairs.select("centre", "salts").distinct().withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    rows = (
        heads.join(texts, heads.centre == texts.key).select("centre", "salt", F.lit(None).cast("long").alias("member"), F.lit(False).alias("want"), "text")
        .unionByName(salted.join(texts, salted.member == texts.key).select("centre", "salt", "member", "want", "text"))
    )
    dealt = rows.repartition(fan_out(pairs), "centre", "salt").sortWithinPartitions("centre", "salt", F.col("member").asc_nulls_first())
    return tabled(dealt, "verified", _verify(), _FOUND)


def reach(found: DataFrame) -> DataFrame:
    """centre, key, size, common, shared: of a member's extra shingles those that another member of the centre has."""
    tokens = found.select("centre", "member", F.explode("extra").alias("token"))
    alone = tokens.groupBy("centre", "token").agg(F.count(F.lit(1)).alias("n"), F.min("member").alias("member")).filter("n = 1").groupBy("centre", "member").agg(F.count(F.lit(1)).alias("alone"))
    rows = found.filter("extra is not null").select("centre", "member", "size", "common").join(alone, ["centre", "member"], "left")
    return rows.select("centre", F.col("member").alias("key"), "size", "common", (F.col("size") - F.col("common") - F.coalesce("alone", F.lit(0))).alias("shared"))


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(key, root): least key of each connected component, by min-label steps with pointer jumping.

    Labels and links are tables in the shared folder; nothing is collected but a count of changes.
    """
    both = tabled(links.select(F.col("centre").alias("a"), F.col("member").alias("b")).unionByName(links.select(F.col("member").alias("a"), F.col("centre").alias("b"))), "links")
    touched = tabled(both.groupBy(F.col("a").alias("key")).agg(F.min("b").alias("least")).select("key", F.least("key", "least").alias("root")), "roots")
    for _ in range(100):
        # own root and the neighbours' in one aggregate, then a jump to the root's own root
        near = both.join(touched, both.b == touched.key).select(F.col("a").alias("key"), "root", F.lit(None).cast("long").alias("own"))
        hooked = near.unionByName(touched.select("key", "root", F.col("root").alias("own"))).groupBy("key").agg(F.max("own").alias("old"), F.min("root").alias("root"))
        jump = touched.select(F.col("key").alias("root"), F.col("root").alias("up"))
        step = tabled(hooked.join(jump, "root", "left").select("key", "old", F.least("root", "up").alias("root")), "roots")
        touched = step.select("key", "root")
        if step.filter("root <> old").isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    return nodes.join(touched, "key", "left").select("key", F.coalesce("root", "key").alias("root"))


def along(rows: DataFrame, per_bucket: DataFrame) -> DataFrame:
    """Joins what is known of each bucket (bucket, fill, ...) to its rows (bucket, fill, key, ...), a full bucket over several tasks."""
    parts = F.ceil(F.col("fill") / SPREAD).cast("int")
    left = rows.withColumn("part", F.pmod(F.xxhash64("key"), parts).cast("int"))
    right = per_bucket.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("fill")
    return left.join(right, ["bucket", "part"]).drop("part")


def near_duplicates(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, threshold: float = THRESHOLD, centres: int = CENTRES) -> DataFrame:
    """One row per document: doc_id, text_md5, class_id, class_size (rows), keep.

    ``keep`` marks the row of least (doc_id, text_md5) in each class; rows alike in both are marked alike.
    """
    md5 = F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", md5.alias("text_md5"))
    signed = tabled(given, "signed", _sign(bands, rows), "doc_id long, text_md5 string, k1 long, k2 long, bands array<long>")
    distinct = signed.groupBy("k1", "k2").agg(F.first("bands").alias("bands"), F.count(F.lit(1)).alias("copies"), F.min(F.struct("doc_id", "text_md5")).alias("least"), F.min("doc_id").alias("least_id"))
    # unique by construction; a task that is run again is committed once, and later steps read what was written
    distinct = tabled(distinct.withColumn("key", F.monotonically_increasing_id()), "distinct")
    buckets = distinct.select("key", F.explode("bands").alias("bucket"))
    sizes = tabled(buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("fill")).filter("fill > 1"), "sizes")
    shared = tabled(buckets.join(sizes, "bucket").select("bucket", "fill", "key"), "shared")
    full = shared.groupBy("key").agg(F.sum("fill").alias("fullness"))
    centre = tabled(shared.join(full, "key").groupBy("bucket", "fill").agg(F.max_by("key", F.struct("fullness", "key")).alias("centre")), "first-centres")
    # whole texts of the keys that share a bucket, once per key
    rows_of = distinct.join(full, "key", "left_semi").select("key", F.col("least.doc_id").alias("one_id"), F.col("least.text_md5").alias("one_md5"))
    own = docs.select(F.col("doc_id").cast("long").alias("id"), "text", md5.alias("text_md5"))
    texts = tabled(own.join(rows_of, F.col("id").eqNullSafe(F.col("one_id")) & (F.col("text_md5") == F.col("one_md5"))).groupBy("key").agg(F.min("text").alias("text")), "texts")

    def counted(pairs: DataFrame) -> DataFrame:
        pairs = tabled(pairs.groupBy("centre", "member").agg(F.max("want").alias("want")), "pairs")
        # only centres of many members are looked up: a table for Spark to broadcast while small, else to split
        many = tabled(pairs.groupBy("centre").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > DEAL), "many")
        return pairs.join(many, "centre", "left").withColumn("n", F.coalesce("n", F.lit(1)))

    def ordered(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.least("centre", "member").alias("centre"), F.greatest("centre", "member").alias("member"))

    members = along(shared, centre)
    first = verified(counted(members.filter("key <> centre").select("centre", F.col("key").alias("member"), (F.col("fill") > 2).alias("want"))), texts)
    links = ordered(first.filter(F.col("similarity") >= threshold)).distinct()
    root = tabled(components(distinct.select("key"), links), "components")
    waiting = tabled(_waiting(members, first, root, threshold), "waiting")
    most = waiting.agg(F.max("n_out").alias("n")).first()["n"] or 0
    tested, begin, width = ordered(first), 0, centres
    while begin < most:
        rooted = waiting.join(root, "key")
        turn = rooted.filter(F.col("out") & (F.col("place") >= begin) & (F.col("place") < begin + width)).join(root.select(F.col("key").alias("head"), F.col("root").alias("head_root")), "head").filter("root <> head_root")
        fresh = counted(_across(turn, rooted, threshold).join(tested, ["centre", "member"], "left_anti"))
        found = verified(fresh, texts)
        tested = tested.unionByName(found.select("centre", "member"))
        begin, width = begin + width, 2 * width
        near = found.filter(F.col("similarity") >= threshold)
        if not near.isEmpty():
            links = links.unionByName(near.select("centre", "member"))
            root = tabled(components(distinct.select("key"), links), "components")
    per_key = distinct.join(root, "key")
    named = per_key.groupBy("root").agg(F.min("least_id").alias("class_id"), F.sum("copies").alias("class_size"), F.min(F.when(F.col("least.doc_id").isNotNull(), F.col("least"))).alias("first"), F.min("least").alias("any_first"))
    classes = per_key.join(named, "root").select("k1", "k2", "copies", F.col("least_id").alias("one"), "class_id", "class_size", F.coalesce("first", "any_first").alias("first"))
    out = spread_back(signed.drop("bands"), classes, ["k1", "k2"], "copies", "one", "doc_id")
    return out.select("doc_id", "text_md5", "class_id", "class_size", F.struct("doc_id", "text_md5").eqNullSafe(F.col("first")).alias("keep"))


def _waiting(members: DataFrame, first: DataFrame, root: DataFrame, threshold: float) -> DataFrame:
    """Rows of buckets that still hold unseen pairs of different components: bucket, fill, key, size, common, shared, out, n_out, head, place.

    Only buckets of more than two texts can; a centre has been compared with all. A row is ``out`` if it
    is not in the bucket's largest component, of which ``head`` is one; ``place`` is its turn, by hash,
    among the ``n_out`` that are. Components only grow: a row that joins the head's stays there.
    """
    more = members.filter("fill > 2")
    mixed = more.join(root, "key").groupBy("bucket", "fill").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("bucket", "fill")
    bound = reach(first).filter(F.col("common") + F.col("shared") >= threshold * F.col("size"))
    open_rows = along(more.filter("key <> centre"), mixed).join(bound, ["centre", "key"]).select("bucket", "fill", "key", "size", "common", "shared")
    rooted = tabled(open_rows.join(root, "key"), "open")
    parts = rooted.groupBy("bucket", "fill", "root").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("head"))
    main = parts.groupBy("bucket", "fill").agg(F.sum("n").alias("n"), F.max(F.struct("n", "root", "head")).alias("main")).filter("n > main.n")
    known = along(rooted, main.select("bucket", "fill", (F.col("n") - F.col("main.n")).alias("n_out"), F.col("main.root").alias("main"), F.col("main.head").alias("head")))
    return known.select("bucket", "fill", "key", "size", "common", "shared", (F.col("root") != F.col("main")).alias("out"), "n_out", "head", F.pmod(F.xxhash64("key"), "n_out").alias("place"))


def _across(turn: DataFrame, rooted: DataFrame, threshold: float) -> DataFrame:
    """Pairs of a row of ``turn`` and one of its bucket in another component that the bounds don't rule out."""
    parts = F.ceil(F.col("fill") / SPREAD).cast("int")
    c = turn.select("bucket", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.col("key").alias("c"), F.col("root").alias("c_root"), F.col("size").alias("c_size"), F.col("common").alias("c_common"), F.col("shared").alias("c_shared"))
    rows = rooted.withColumn("part", F.pmod(F.xxhash64("key"), parts).cast("int"))
    most = F.least("common", "c_common") + F.least("shared", "c_shared")
    able = (F.col("root") != F.col("c_root")) & (most >= threshold * (F.col("size") + F.col("c_size") - most))
    return c.join(rows, ["bucket", "part"]).filter(able).select(F.least("c", "key").alias("centre"), F.greatest("c", "key").alias("member"), F.lit(False).alias("want"))


def keep_one(docs: DataFrame, **params) -> DataFrame:
    """The documents with one row of each near-duplicate class left, all columns kept.

    Rows alike in id and text are one document: any one of them stays.
    """
    names = docs.columns
    found = near_duplicates(docs, **params).filter("keep").groupBy(F.col("doc_id").alias("_lw_id"), F.col("text_md5").alias("_lw_md5")).agg(F.count(F.lit(1)).alias("_lw_same"))
    found = tabled(found, "kept")
    md5 = F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    rows = docs.withColumn("_lw_m", md5)
    kept = rows.join(found, F.col("doc_id").cast("long").eqNullSafe(F.col("_lw_id")) & (F.col("_lw_m") == F.col("_lw_md5")))
    once = kept.filter("_lw_same = 1").select(*names)
    again = kept.filter("_lw_same > 1").dropDuplicates(["_lw_id", "_lw_md5"]).select(*names)
    return few(once.unionByName(again))
