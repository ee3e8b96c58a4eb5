"""Every dealt operator against a plain version on small tables with the odd cases in them."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from leafweir.llm import bag_minhash, chat, decontam, langid, mixing, quality, sharding, suffix_dedup, syncmers, warc
from leafweir.llm._text import chunks, mix64, prefix_hash, span_hash, words

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
RNG = random.Random(5)
VOCAB = ["".join(RNG.choice("abcdefghijklmnopé") for _ in range(RNG.randint(2, 8))) for _ in range(400)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCAB) for _ in range(n)).capitalize() + "."


def edited(text, seed, share):
    r = random.Random(seed)
    return " ".join(r.choice(VOCAB) if r.random() < share else w for w in text.split(" "))


def rows():
    base = [prose(120, i) for i in range(6)]
    passage = prose(60, 99)
    texts = [
        None, "", "  ", "!!! ...", "one", "one", "Two words", base[0], base[0], base[0].upper(), base[1], edited(base[1], 1, 0.02), edited(base[1], 2, 0.3), edited(base[1], 3, 0.02),
        base[2] + " " + passage, passage + " " + base[3], "a" * 450, "ab" * 400, "x" * 199, "x" * 200, base[4] * 40, edited(base[4], 7, 0.04) * 40, "é" * 210, "日本語テキスト。" * 30, base[5] + "\n" + base[5], "😀 " + base[5],
        *[edited(prose(90, 55), 100 + i, 0.03) for i in range(12)], *[edited(prose(90, 55), 200 + i, 0.12) for i in range(12)],
    ]
    out = [(i, t, "en" if i % 4 else None, f"src{i % 3}" if i % 7 else None, len(t or "")) for i, t in enumerate(texts)]
    return [*out, out[10], out[0], (None, base[0], "en", "src1", 1), (None, "null id", None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    # columns that an operator may use inside clash with nothing
    return spark.createDataFrame(rows(), DOCS).withColumns({"key": F.lit("k"), "size": F.lit(1), "bucket": F.lit(None).cast("string"), "shard": F.lit("s")}).repartition(3).cache()


@pytest.mark.parametrize("size", [30, 40, 51, 52, 63, 64, 80, 100, 250, 257, 300])
def test_short_texts_that_share_a_half_are_near(size):
    for i in range(60):
        t, other = prose(120, 700 + i).encode()[:size].decode(errors="ignore"), prose(120, 800 + i)
        changed = t[: len(t) // 2] + "#" + t[len(t) // 2 + 1 :]
        a, half, one, far, none = syncmers.fingerprint_texts([t, syncmers.edited(t, other), changed, other, ""])
        assert 0.25 < syncmers.likeness(a, half) < 0.75 and syncmers.likeness(a, one) > 0.4
        assert syncmers.likeness(a, a) == 1 and syncmers.likeness(a, far) < 0.2 and syncmers.likeness(a, none) == 0
        # a text with fine anchors and its longer form without them still meet in their syncmers
        longer = t + t[: max(0, syncmers.FINE + 1 - size)]
        assert size < 200 or syncmers.likeness(a, syncmers.fingerprint_texts([longer])[0]) > 0.8


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_words_are_the_pattern_s():
    texts = ["", "A b-C", "né😀x 9", "\x00\x01a\x7fb", " ", "ÀB"]
    c = next(chunks(pa.array(texts)))
    w = words(c)
    got = [[bytes(c.data[a:b]).decode() for a, b in zip(w.start[x:y], w.end[x:y], strict=True)] for x, y in zip(w.off[:-1], w.off[1:], strict=True)]
    assert [[brute.lower(x) for x in t] for t in got] == [brute.split_words(t) for t in texts]


def test_bag_minhash_estimates_weighted_jaccard():
    a, b = [1] * 8 + list(range(10, 60)), [1] * 2 + list(range(20, 70))
    texts = np.repeat([0, 1], [len(a), len(b)])
    sig = bag_minhash.signatures(*bag_minhash.multiset(texts, np.array([*a, *b], dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)), 2, 4096)
    want = sum((Counter(a) & Counter(b)).values()) / sum((Counter(a) | Counter(b)).values())
    assert abs((sig[0] == sig[1]).mean() - want) < 0.04


def test_near_duplicate_classes(docs, empty):
    got = bag_minhash.near_duplicates(docs).toPandas()
    data = rows()
    classes = brute.near_classes([r[1] for r in data])
    members = defaultdict(list)
    for i, c in enumerate(classes):
        members[c].append(i)
    want = Counter()
    for own in members.values():
        ids = [data[i][0] for i in own if data[i][0] is not None]
        for i in own:
            want[(data[i][0], min(ids) if ids else None)] += 1
    na = lambda v: None if pd.isna(v) else int(v)
    assert Counter((na(r.doc_id), na(r.class_id)) for r in got.itertuples()) == want
    sizes = Counter(classes)
    by_class = defaultdict(set)
    for r in got.itertuples():
        by_class[na(r.class_id)].add(r.class_size)
    assert all(by_class[c] <= {sizes[k] for k, own in members.items() if c in [data[i][0] for i in own]} for c in by_class)
    kept = bag_minhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len(members)
    assert bag_minhash.near_duplicates(empty).count() == 0 and bag_minhash.keep_one(empty).count() == 0


def test_near_duplicates_through_further_centres(docs):
    """With one centre in the first round the same classes come out."""
    key = lambda d: sorted((str(r.doc_id), str(r.class_id)) for r in d.collect())
    assert key(bag_minhash.near_duplicates(docs, centres=1)) == key(bag_minhash.near_duplicates(docs))


def test_a_full_bucket_of_many_classes(spark, monkeypatch):
    """Texts that all share bands with one another, of which only few pairs are near: rounds and dealt buckets find them."""
    monkeypatch.setattr(bag_minhash, "SPREAD", 8)
    base = prose(100, 61)
    texts = [edited(base, 300 + i, 0.028) for i in range(100)] + [base]
    near = brute.near_classes(texts)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.class_id for r in bag_minhash.near_duplicates(rows, bands=64, rows=1, centres=2).collect()}
    least = {c: near.index(c) for c in set(near)}
    assert len(set(near)) > 5 and got == {i: least[c] for i, c in enumerate(near)}


def test_signatures_do_not_depend_on_the_other_texts(monkeypatch):
    texts, value = np.repeat(np.arange(300), 40), bag_minhash.mix64(np.arange(12_000, dtype=np.uint64))
    whole = bag_minhash.signatures(*bag_minhash.multiset(texts, value), 300, 160)
    alone = bag_minhash.signatures(*bag_minhash.multiset(texts[:40], value[:40]), 1, 160)
    assert (whole[0] == alone[0]).all()
    monkeypatch.setattr(bag_minhash, "CELLS", 500)
    assert (bag_minhash.signatures(*bag_minhash.multiset(texts, value), 300, 160) == whole).all()


def test_recall_by_similarity(spark):
    """Of the pairs of different words that brute force finds, all from 0.8 on are in one class; below, none need be."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    r = random.Random(8)
    # the table has few pairs between 0.8 and 1
    planted = [(t, edited(t, 9000 + i, r.uniform(0.005, 0.04))) for i in range(200) for t in [prose(r.randint(30, 160), 5000 + i)]]
    data = [(r.doc_id, r.text) for r in docs.collect()] + [(10**6 * (k + 1) + i, t) for i, two in enumerate(planted) for k, t in enumerate(two)]
    cls = {r.doc_id: r.class_id for r in bag_minhash.near_duplicates(spark.createDataFrame(data, docs.schema).repartition(6)).collect()}
    bags = [brute.bag(t) for _, t in data]
    where = defaultdict(list)
    for i, b in enumerate(bags):
        for s in b:
            where[s].append(i)
    seen, found = Counter(), Counter()
    for i, b in enumerate(bags):
        for j, n in Counter(j for s in b for j in where[s] if j < i).items():
            if n * 2 >= 0.5 * (sum(b.values()) + sum(bags[j].values())):
                x = brute.similarity(b, bags[j])
                band = "1" if x == 1 else "0.9" if x >= 0.9 else "0.85" if x >= 0.85 else "0.8" if x >= 0.8 else "below"
                seen[band] += 1
                found[band] += cls[data[i][0]] == cls[data[j][0]]
    assert all(seen[b] == found[b] for b in ("1", "0.9", "0.85", "0.8")) and min(seen[b] for b in ("0.9", "0.85", "0.8", "below")) >= 15, (seen, found)


def test_fingerprints(docs, empty):
    data = sorted(rows(), key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    got = syncmers.edited_likeness(docs).toPandas()
    want = Counter()
    for i, r in enumerate(data):
        t, n = r[1] or "", data[(i + 1) % len(data)][1] or ""
        half = len(t) // 2
        want[(r[0], len(t), hashlib.sha256((t[: len(t) - half] + n[:half]).encode()).hexdigest())] += 1
    assert Counter((None if pd.isna(r.doc_id) else int(r.doc_id), r.n_chars, r.edited_sha256) for r in got.itertuples()) == want
    assert got.near_edited.between(0, 1).all() and got.near_next.between(0, 1).all()
    assert (got.near_edited[got.fingerprint == got.edited_fingerprint] == 1).all()
    prints = got.groupby("doc_id").fingerprint.first()
    assert prints[7] == prints[8] != prints[10]
    assert syncmers.edited_likeness(empty).count() == 0


def test_syncmers_are_context_free_and_dense():
    t = prose(300, 3)
    a, b = syncmers.fingerprint_texts([t, "prefix words " + t])
    places, _ = syncmers.decode(a)
    assert max(np.diff(places)) <= syncmers.K - syncmers.S + 1
    shifts = Counter(q - p for p, q in syncmers.matches(a, b))
    assert shifts.most_common(1)[0] == (len("prefix words "), len(places))
    # an anchor is one by its own bytes: its least s-mer stands at an edge
    raw = t.encode()
    from leafweir.llm._text import all_spans, prefix_hash

    for p in places[:50]:
        h = all_spans(prefix_hash(np.frombuffer(raw[p : p + syncmers.K], dtype=np.uint8)), syncmers.S)
        assert h.min() in (h[0], h[-1])


def plain_anchors(raw):
    """24-bit hashes of closed syncmers and, up to FINE bytes, of four-byte strings: every k-mer on its own."""
    value = lambda b: int(span_hash(prefix_hash(np.frombuffer(b, dtype=np.uint8)), np.array([0]), np.array([len(b)]))[0]) >> 40
    k, s = syncmers.K, syncmers.S
    coarse = []
    for p in range(len(raw) - k + 1):
        inner = [value_of(raw[p + j : p + j + s]) for j in range(k - s + 1)]
        if min(inner) in (inner[0], inner[-1]):
            coarse.append(value(raw[p : p + k]))
    fine = [value(raw[i : i + 4]) for i in range(max(1, len(raw) - 3))] if 0 < len(raw) <= syncmers.FINE else []
    return [coarse, fine] if fine else [coarse]


def value_of(b):
    return int(span_hash(prefix_hash(np.frombuffer(b, dtype=np.uint8)), np.array([0]), np.array([len(b)]))[0])


def dice(a, b):
    if not a or not b:
        return float(a == b)
    x, y = plain_anchors(a), plain_anchors(b)
    level = min(len(x), len(y)) - 1
    x, y = Counter(x[level]), Counter(y[level])
    return 2 * sum((x & y).values()) / (x.total() + y.total()) if x and y else 0.0


def test_likenesses_are_those_of_a_plain_scan(spark):
    texts = [prose(60, 70), edited(prose(60, 70), 5, 0.1), "", None, "abc", "abcd", "é" * 40, prose(20, 71), prose(21, 71), "x" * 300, prose(60, 70)]
    rows = spark.createDataFrame([(i * 3, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in syncmers.edited_likeness(rows).collect()}
    down = list(reversed(range(len(texts))))
    for a, b in zip(down, down[1:] + down[:1], strict=True):
        t, n = texts[a] or "", texts[b] or ""
        changed = syncmers.edited(t, n)
        assert abs(got[a * 3].near_edited - dice(t.encode(), changed.encode())) < 1e-12 and abs(got[a * 3].near_next - dice(t.encode(), n.encode())) < 1e-12


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 17, 200])
def test_ranges_of_ids(spark, n):
    cuts = sorted(random.Random(n).sample(range(-500, 500), n), reverse=True)
    values = [None, -501, 501, 0, *cuts, *[c + 1 for c in cuts], *[c - 1 for c in cuts]]
    got = spark.createDataFrame([(v,) for v in values], "v long").select("v", syncmers._cuts_above(F.col("v"), cuts).alias("k")).collect()
    assert all(r.k == (n if r.v is None else sum(c > r.v for c in cuts)) for r in got)


def long_rows():
    """Texts of more than a chunk: a long one, the same with a word changed here and there, one of few words, one without."""
    base = [w for i in range(12) for w in prose(20_000, 40 + i).split(" ")]
    other = list(base)
    for i in range(500, len(other), 9_000):
        other[i] = "changed"
    assert len(" ".join(base)) > 1_200_000
    return [(1, " ".join(base)), (2, " ".join(other)), (3, "same words again and " * 60_000), (4, "." * 1_100_000), (5, prose(50, 3)), (6, None)]


def test_texts_longer_than_a_chunk(spark):
    data = long_rows()
    schema = "doc_id long, text string"
    docs = spark.createDataFrame(data, schema).withColumns({"lang": F.lit("en"), "source": F.lit("s")}).repartition(2).cache()
    got = {r.doc_id: r for r in bag_minhash.near_duplicates(docs).collect()}
    assert [got[i].class_id for i in range(1, 7)] == [1, 1, 3, 4, 5, 6]
    prints = {r.doc_id: r for r in syncmers.edited_likeness(docs).collect()}
    assert prints[2].near_next > 0.95 and all(prints[i].n_chars == len(t or "") for i, t in data)
    items = [(7, " ".join(data[0][1].split(" ")[100_000:100_030])), (8, "words again and same words again and same words again and same")]
    found = {r.doc_id: r for r in decontam.overlaps(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    for i, t in data:
        assert (found[i].n_words, found[i].n_hit, found[i].n_items, found[i].items_sha256) == brute.decontaminated(t, items)
    kept = {r.doc_id: r for r in suffix_dedup.repeated_passages(docs).collect()}
    for i, want in zip((1, 2, 3, 4, 5, 6), brute.without_repeats([t for _, t in data], key=hash), strict=True):
        assert (kept[i].n_bytes, kept[i].n_removed, kept[i].n_spans, kept[i].kept_sha256) == want
    model = langid.fit(docs)
    assert langid.predict(docs, model).filter("lang_pred = 'en'").count() == 4
    flat = quality.fit(docs, quality.grades(spark.createDataFrame([(1, 1, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")), bits=12)
    assert quality.score(docs, flat).filter("p_select between 0 and 1").count() == 6
    assert sharding.assign(docs).agg(F.sum("size")).first()[0] == sum(len((t or "").encode()) + 16 for _, t in data)
    assert mixing.mix(docs).filter("taken <= 3 * size").count() == 6
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("http://a").alias("url"), F.col("text").alias("html"))
    assert {r.page_id: r.payload_bytes for r in warc.round_trip(pages).collect()} == {i: len((t or "").encode()) for i, t in data}
    turns = docs.select(F.lit(1).cast("long").alias("conv_id"), F.col("doc_id").alias("turn"), F.lit("assistant").alias("role"), "text")
    assert chat.digests(chat.render(chat.fold(chat.log_of_turns(turns)))).first().loss_chars == sum(len(t or "") for _, t in data)


def bench(spark):
    base = rows()
    return spark.createDataFrame(
        [(1, " ".join(base[14][1].split()[5:30])), (2, base[7][1].split()[3] + " " + base[7][1].split()[4]), (3, "never there at all"), (4, None), (5, "..."), (6, base[10][1].upper()), (10, "One"), (None, base[10][1]), (None, base[4][1]), (6, "extra row of an item")],
        "item_id long, text string",
    )


@pytest.mark.parametrize("block", [200_000, 7])
def test_decontamination(spark, docs, empty, block):
    items = [(r[0], r[1] or "") for r in bench(spark).collect()]
    want = Counter((r[0], *brute.decontaminated(r[1], items)) for r in rows())
    got = decontam.overlaps(docs, bench(spark), block).toPandas()
    assert Counter((None if pd.isna(r.doc_id) else int(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in got.itertuples()) == want
    assert (got.contaminated == (got.n_hit > 0)).all()
    clean = decontam.clean(docs, bench(spark), block)
    assert clean.columns == docs.columns and clean.count() == sum(n for r, n in want.items() if r[2] == 0)
    assert decontam.overlaps(empty, bench(spark), block).count() == 0
    assert decontam.overlaps(docs, bench(spark).limit(0), block).filter("n_hit > 0").count() == 0


def test_repeated_passages(docs, empty):
    data = rows()
    want = Counter((r[0], *w) for r, w in zip(data, brute.without_repeats([r[1] for r in data]), strict=True))
    got = suffix_dedup.repeated_passages(docs).toPandas()
    assert Counter((None if pd.isna(r.doc_id) else int(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.itertuples()) == want
    assert suffix_dedup.repeated_passages(empty).count() == 0


@pytest.mark.parametrize(("length", "anchor", "run"), [(40, 16, 8), (25, 25, 1), (60, 5, 16)])
def test_repeats_of_other_lengths(spark, length, anchor, run):
    r = random.Random(length)
    texts = ["".join(r.choice("ab") for _ in range(r.randint(0, 300))) for _ in range(60)] + ["".join(r.choice("abcdefg ") for _ in range(200)) for _ in range(20)]
    texts += [texts[-1][50:150] + texts[-2][10:120], texts[3] + texts[4]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in suffix_dedup.repeated_passages(df, length, anchor, run).collect()}
    assert got == dict(enumerate(brute.without_repeats(texts, length)))


def test_hot_cores_and_equal_leads(spark, monkeypatch):
    """Every text is sampled, cores of two runs are hot, and texts share leading bits: the result is the same."""
    r = random.Random(21)
    phrase, words = prose(8, 5)[:50], [prose(1, i) for i in range(50)]
    texts = [" ".join(r.choice(words) for _ in range(r.randint(0, 30))) + phrase + " ".join(r.choice(words) for _ in range(r.randint(0, 30))) for _ in range(120)]
    texts += [texts[3], texts[4] + texts[5], phrase * 4, "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    routes = []
    hot = suffix_dedup._hot
    monkeypatch.setattr(suffix_dedup, "SAMPLE", 1)
    monkeypatch.setattr(suffix_dedup, "HOT", 2)
    monkeypatch.setattr(suffix_dedup, "_hot", lambda runs: routes.append(hot(runs)) or routes[-1])
    monkeypatch.setattr(suffix_dedup, "_lead", lambda md5: F.pmod(F.xxhash64(md5), F.lit(60)))
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in suffix_dedup.repeated_passages(df, 40, 16, 8).collect()}
    assert got == dict(enumerate(brute.without_repeats(texts, 40))) and min(map(len, routes)) > 0


def test_quality_is_ordered_and_learns(spark, empty):
    r = random.Random(2)
    data, labels = [], []
    for i in range(900):
        g = i % 3
        t = prose(r.randint(20, 80), 1000 + i)
        t = t + " vile stupid" if g == 0 else " | ".join(t.split()) if g == 1 else t
        data.append((i, t))
        labels.append((i, int(g == 2), int(g == 0)))
    docs = spark.createDataFrame(data, "doc_id long, text string")
    model = quality.fit(docs.filter("doc_id < 600"), quality.grades(spark.createDataFrame(labels, "doc_id long, quality int, toxic int")), bits=14)
    assert (np.diff(model.thresholds) > 0).all()
    got = quality.score(docs, model).toPandas().set_index("doc_id").sort_index()
    held = got.loc[600:]
    assert (held.keep == [i % 3 == 2 for i in held.index]).mean() > 0.97
    e = held.expected_grade.groupby(held.index % 3).mean()
    assert e[0] < e[1] < e[2]
    assert quality.score(empty, model).count() == 0
    odd = spark.createDataFrame([(1, None), (2, ""), (None, "x")], "doc_id long, text string")
    assert quality.score(odd, model).filter("p_select between 0 and 1").count() == 3
    flat = quality.fit(odd, quality.grades(spark.createDataFrame([(9, None, None)], "doc_id long, quality int, toxic int")), bits=14)
    assert quality.score(odd, flat).count() == 3


def plain_quality(model, text):
    """(expected grade, tail) of one text: its set of words and punctuation runs and its shape, one by one."""
    raw = (text or "").encode()
    own = lambda b: span_hash(prefix_hash(np.frombuffer(b, dtype=np.uint8)), np.array([0]), np.array([len(b)]))
    kind = [int(k) for k in quality._CLASS[np.frombuffer(raw, dtype=np.uint8)]]
    ws = [w.encode() for w in brute.split_words(text)]
    runs, at = [], 0
    while at < len(raw):
        end = at
        while end < len(raw) and (kind[end] == 0) == (kind[at] == 0):
            end += 1
        if kind[at] == 0:
            runs.append(raw[at:end])
        at = end
    shift = np.uint64(64 - model.bits)
    seen = {int((own(w) >> shift)[0]) for w in ws} | {int((mix64(own(r) + np.uint64(1)) >> shift)[0]) for r in runs}
    n, nw = max(1, len(raw)), max(1, len(ws))
    part = [kind.count(k) for k in range(5)]
    letters, lines = max(1, part[1] + part[2]), raw.count(b"\n") + 1
    alike = sum(a == b for a, b in zip(ws, ws[1:], strict=False))
    root = lambda x: math.sqrt(x) * 12
    shape = [*(root(p / n) for p in part), root(part[1] / letters), root(alike / nw), len(seen) / nw * 12, letters / nw, math.log2(n), math.log2(1 + len(ws) / lines), root(part[0] / (part[0] + nw))]
    score = sum(model.known[f] * model.weights[f] for f in seen) + sum(model.weights[(1 << model.bits) + 12 * k + int(min(max(x, 0), 11))] for k, x in enumerate(shape)) / math.sqrt(12)
    tails = [1 / (1 + math.exp(-(score - t))) for t in model.thresholds]
    return sum(tails), tails[-1]


def test_quality_scores_are_those_of_a_plain_version(spark):
    r = random.Random(12)
    texts = [prose(r.randint(1, 60), 400 + i) + r.choice(["", " vile!!", " 12 34\n\nA  B"]) for i in range(120)]
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(100)]
    train = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = quality.fit(train, quality.grades(spark.createDataFrame(labels, "doc_id long, quality int, toxic int")), bits=12)
    data = rows()
    odd = spark.createDataFrame([(i, x[1]) for i, x in enumerate(data)], "doc_id long, text string").repartition(3)
    for got in (quality.score(train, model).collect(), quality.score(odd, model).collect()):
        own = texts if len(got) == len(texts) else [x[1] for x in data]
        for x in got:
            expected, tail = plain_quality(model, own[x.doc_id])
            assert math.isclose(x.expected_grade, expected, abs_tol=1e-7) and math.isclose(x.p_select, tail, abs_tol=1e-7) and x.keep == (x.p_select >= 0.5)


def plain_language(model, text):
    """(language, cosine, rejected) of one text: its 1- to 3-grams counted in a table."""
    raw, low = (text or "").encode(), []
    for i, b in enumerate(raw):
        c = b + 32 if 65 <= b <= 90 or (i and raw[i - 1] == 0xC3 and 0x80 <= b <= 0x9E) else b
        c = c if 97 <= c <= 122 or c >= 128 else 32
        if not (c == 32 and low and low[-1] == 32):
            low.append(c)
    count = np.zeros(len(model.idf))
    for k in (1, 2, 3):
        for i in range(len(low) - k + 1):
            if k > 1 or low[i] != 32:
                code = int.from_bytes(bytes(low[i : i + k]), "big")
                count[int(mix64(np.array([code + (k << 32)], dtype=np.uint64))[0] % np.uint64(len(count)))] += 1
    v = count * model.idf
    cos = model.centroids @ (v / max(1e-12, math.sqrt((v * v).sum())))
    k = int(cos.argmax())
    at = min(max(math.log2(max(1, count.sum() / 3)) - math.log2(langid.SIZES[0]), 0), len(langid.SIZES) - 1)
    j = min(int(at), len(langid.SIZES) - 2)
    reach = model.reach[k, j] * (1 - at + j) + model.reach[k, j + 1] * (at - j)
    return model.languages[model.owner[k]], cos[k], 1 - cos[k] - reach


def test_languages_are_those_of_a_plain_version(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    model = langid.fit(docs)
    data = [(r.doc_id, r.text) for r in docs.limit(60).collect()] + [(10_000 + i, x[1]) for i, x in enumerate(rows())]
    for r in langid.predict(spark.createDataFrame(data, "doc_id long, text string"), model).collect():
        text = dict(data)[r.doc_id]
        if not any(c.isalpha() for c in text or ""):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
            continue
        lang, cos, over = plain_language(model, text)
        assert abs(r.score - min(1, max(0, cos))) < 1e-4
        # where two centroids or the reach are as near as single precision can tell, either is right
        assert r.lang_pred == lang or abs(r.score - cos) < 1e-5
        assert r.rejected == (over > 0) or abs(over) < 1e-4


def test_language_sample_is_bounded_over_many_languages(spark):
    r = random.Random(3)
    docs = spark.createDataFrame([(i, prose(r.randint(5, 20), 2000 + i), f"l{i % 50}") for i in range(400)], "doc_id long, text string, lang string")
    model = langid.fit(docs, total=100)
    assert len(model.languages) == 50 and len(model.centroids) <= 100


def test_cumulative_link_gradient():
    """The fitted tails are those of the best constant model where features say nothing."""
    n = 4000
    grade = np.array([0] * 400 + [1] * 1200 + [2] * 2400)
    off, feature, shape = np.zeros(n + 1, dtype=np.int64), np.zeros(0, dtype=np.int64), np.full((n, 12), (1 << 8) + 0)
    m = quality._descend(off, feature, shape, grade, 8, 40, 1)
    tail = quality._tails(quality._scores(m, off, feature, shape), m.thresholds)[0]
    assert tail[0] > tail[1] and abs(tail[0] - 0.9) < 0.12 and abs(tail[1] - 0.6) < 0.12


def test_language(spark, empty):
    r = random.Random(4)
    says = {"aa": "the and of to in that was with", "bb": "der die und das nicht mit von ein", "cc": "los las que por con una para como"}
    data = [(i, " ".join(r.choice(says[k].split()) for _ in range(r.randint(3, 40))).capitalize(), k) for i, k in enumerate(sorted(says) * 80)]
    docs = spark.createDataFrame([*data, (900, "99 %%", "aa"), (901, None, "aa"), (902, "the", None)], "doc_id long, text string, lang string")
    held = langid.held_out(F.col("doc_id"))
    model = langid.fit(docs.filter(~held))
    got = langid.predict(docs, model).join(docs.select("doc_id", "lang", held.alias("held")), "doc_id").toPandas().set_index("doc_id")
    assert all(h == (zlib.crc32(str(i).encode()) % 3 == 1) for i, h in got.held.items())
    seen = got[got.held & (got.index < 900)]
    assert (seen.lang_pred == seen.lang).mean() > 0.98 and got.score.between(0, 1).all()
    assert got.loc[900, "lang_pred"] == got.loc[901, "lang_pred"] == "und" and got.loc[902, "lang_pred"] == "aa"
    far = langid.predict(spark.createDataFrame([(1, "Щукин жил был у моря"), (2, "日本語のテキスト")], "doc_id long, text string"), model)
    assert far.filter("rejected").count() == 2
    kept = langid.accepted(docs, model)
    assert kept.columns == docs.columns and kept.filter("doc_id in (900, 901)").count() == 0 and kept.count() >= 238
    none = langid.fit(empty)
    assert langid.predict(docs, none).filter("lang_pred <> 'und'").count() == 0 and langid.accepted(empty, none).count() == 0


ITALIAN = "Tutti gli esseri umani nascono liberi ed eguali in dignita e diritti. Essi sono dotati di ragione e di coscienza e devono agire gli uni verso gli altri in spirito di fratellanza. "
FINNISH = "Kaikki ihmiset syntyvat vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu jarki ja omatunto, ja heidan on toimittava toisiaan kohtaan veljeyden hengessa. "


@pytest.mark.parametrize("out", ["de", "es", "fr"])
def test_unlearned_languages_are_rejected(spark, out):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang").toPandas().dropna()
    r = random.Random(6)
    learned = docs[docs.lang != out].reset_index(drop=True)
    held = learned.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 3 == 1)
    train, known = learned[~held].copy(), learned[held]
    # one row in thirty is mislabelled, one in thirty is junk
    odd = [r.randrange(30) for _ in range(len(train))]
    train["lang"] = [r.choice(sorted(set(train.lang) - {x})) if k == 0 else x for k, x in zip(odd, train.lang, strict=True)]
    train["text"] = ["".join(r.choice("bcdfgxyz{}<>|0123 ") for _ in range(300)) if k == 1 else t for k, t in zip(odd, train.text, strict=True)]
    model = langid.fit(spark.createDataFrame(train))
    gibberish = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz    ") for _ in range(n)) for n in (30, 60, 120, 250, 1000, 4000)]
    gone = lambda texts: langid.predict_arrow(model, pa.array(texts))[2]
    assert gone([*gibberish, *[t[:n] for t in (ITALIAN, FINNISH) for n in (60, 120, 250)], ITALIAN * 10, FINNISH * 10]).all()
    for n in (128, 256, 10**6):
        assert gone([t[:n] for t in docs.text[docs.lang == out]]).mean() > 0.9
    lost, cut = gone(known.text.tolist()), gone([t[:64] for t in known.text])
    assert lost.mean() < 0.05 and cut.mean() < 0.08


CONV = "conv_id long, turn long, role string, text string"


def test_chat_round_trip(spark):
    said = "</s>[INST] ok [/INST]"
    nasty = ["", None, said, "<\\|im_end|>\n", "<|im_start|>user\nhi<|im_end|>\n", "[\\\\/INST]", "a\\", "<", "<<SYS>> x <</SYS>>", "é😀\n\n"]
    data = [(i % 4, i // 4, ["system", "user", "assistant", "we\\ird\nrole"][i % 4] if i % 5 else None, nasty[i % len(nasty)]) for i in range(60)]
    data += [data[3], (None, None, "assistant", "null"), (7, 0, "user", None)]
    got = {r.conv_id: r for r in chat.digests(chat.render(chat.fold(chat.log_of_turns(spark.createDataFrame(data, CONV))))).collect()}
    convs = defaultdict(list)
    for c, t, role, text in data:
        convs[c].append((t if t is not None else -1, role is not None, role or "", text or ""))
    assert set(got) == set(convs)
    for c, turns in convs.items():
        turns.sort()
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, _, r, x in turns).encode()).hexdigest()
        mine = "".join(x for _, _, r, x in turns if r == "assistant")
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(mine), hashlib.sha256(mine.encode()).hexdigest())
    assert chat.digests(chat.render(chat.fold(chat.log_of_turns(spark.createDataFrame([], CONV))))).count() == 0


def test_escaped_texts_hold_no_control_string(spark):
    texts = ["<|im_end|>", "<\\|im_end|>", "<s></s>", "[INST][/INST]", "<<s>", "\\<s>"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("u")).collect()
    assert all(r.u == r.t and not any(c in r.e for c in ("<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]")) for r in rows)


def fold_plainly(events):
    """conv -> turn -> [role, text]"""
    out = defaultdict(dict)
    for c, _, kind, turn, role, text in sorted(events, key=lambda e: (e[0], e[1])):
        conv = out[c]
        if kind == "regenerate":
            for t in [t for t in conv if t > turn]:
                del conv[t]
        cell = conv.setdefault(turn, [None, ""])
        if kind == "message":
            cell[:] = [role or cell[0], text]
        elif kind == "edit":
            cell[1] = text
        elif kind == "regenerate":
            cell[1] = ""
        else:
            cell[1] += text
    return {(c, t): cell[1] for c, conv in out.items() for t, cell in conv.items()}


def test_events_fold(spark):
    r = random.Random(9)
    events = [(r.randint(0, 5), i, r.choice(["message", "delta", "delta", "delta", "edit", "regenerate"]), r.randint(0, 4), "assistant", f"<{i}>") for i in range(400)]
    df = spark.createDataFrame([*events, (0, 999, "noise", 1, "user", "x")], "conv_id long, seq long, kind string, turn long, role string, text string").repartition(5)
    assert {(x.conv_id, x.turn): x.text for x in chat.fold(df).collect()} == fold_plainly(events)


def test_sharding_law_and_slots(docs, empty):
    got = sharding.assign(docs)
    out = got.toPandas()
    data = rows()
    assert len(out) == len(data) and set(out.law) == {"key"} and out.shard.between(0, 39).all()
    assert all(sorted(x) == list(range(len(x))) for _, x in out.groupby("shard").slot)
    moved = out[out.grown_shard != out.shard]
    assert (moved.grown_shard == 40).all()
    want = Counter((r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in data)
    assert Counter((None if pd.isna(r.doc_id) else int(r.doc_id), r._2 if hasattr(r, "_2") else r.size, r.text_crc32) for r in out.rename(columns={"size": "bytes_"}).rename(columns={"bytes_": "size"}).itertuples()) == want
    assert sharding.assign(empty).count() == 0


def xx64(value, start):
    """Spark's xxhash64 of a long with a running seed."""
    m, p = 2**64 - 1, [11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261]
    rot = lambda x, n: ((x << n) | (x >> (64 - n))) & m
    h = (start + p[4] + 8) & m
    h ^= (rot(((value & m) * p[1]) & m, 31) * p[0]) & m
    h = (rot(h, 27) * p[0] + p[3]) & m
    h = ((h ^ (h >> 33)) * p[1]) & m
    h = ((h ^ (h >> 29)) * p[2]) & m
    return h ^ (h >> 32)


def descend(key, shards, path=()):
    """(draw, shard) by the rule, level by level."""
    kids = defaultdict(list)
    for s in shards:
        kids[s[len(path)]].append(s)
    first = 42 if key is None else xx64(key, 42)

    def draw(child):
        h = xx64(sharding.seed(*path, child), first)
        return -math.log(((h >> 11) + 0.5) * 2.0**-53) / sum(s.weight for s in kids[child])

    best = min(kids, key=draw)
    return draw(best), best if len(path) == 2 else descend(key, kids[best], (*path, best))[1]


UNEVEN = [sharding.Shard(s // 4, s // 2, s, 1.0 + s % 3) for s in range(8)]


@pytest.mark.parametrize("tree", [sharding.tree(40), UNEVEN, [sharding.Shard(7, 1, 3, 2.5)], [sharding.Shard(0, 0, 1), sharding.Shard(0, 1, 1), sharding.Shard(1, 0, 2, 0.1)]])
def test_places_are_those_of_a_plain_descent(spark, tree):
    keys = [None, 0, -1, 2**62, *range(1, 400)]
    added = sharding.more(tree, 3.0)
    rows = spark.createDataFrame([(k, "x") for k in keys], "doc_id long, text string")
    got = sharding.assign(rows, tree, added=added).collect()
    for r in got:
        assert r.shard == descend(r.doc_id, tree)[1]
        assert r.grown_shard == min(descend(r.doc_id, tree), descend(r.doc_id, added))[1] == descend(r.doc_id, [*tree, *added])[1]


def test_hash_tree_is_weighted_and_confined(spark):
    keys = spark.range(40_000).select(F.col("id").alias("doc_id"))
    heavier = [s._replace(weight=s.weight * 2) if s.shard == 5 else s for s in UNEVEN]
    lighter = [s._replace(weight=s.weight / 2) if s.shard == 5 else s for s in UNEVEN]
    grown = [*UNEVEN, *sharding.more(UNEVEN)]
    again = [*UNEVEN, sharding.Shard(9, 9, 5, 2.0)]
    key = F.col("doc_id")
    out = keys.select("doc_id", *[sharding.place(key, t).alias(n) for n, t in dict(a=UNEVEN, b=heavier, c=grown, d=again, e=lighter).items()]).toPandas()
    share = out.a.value_counts(normalize=True)
    total = sum(s.weight for s in UNEVEN)
    assert all(abs(share[s.shard] - s.weight / total) < 0.01 for s in UNEVEN)
    # a change of weight moves keys into (out of) region 1 alone and, within it, into (out of) rack 2 alone, within that into (out of) shard 5
    for new, old in (("b", "a"), ("a", "e")):
        moved = out[out[new] != out[old]]
        assert len(moved) and (moved[new] >= 4).all()
        inside = moved[moved[old] >= 4]
        assert inside[new].isin([4, 5]).all() and (inside[new][inside[old].isin([4, 5])] == 5).all()
    # what is added takes keys only into itself
    assert (out.c[out.c != out.a] == 8).all() and (out.d[out.d != out.a] == 5).all()
    assert abs((out.c != out.a).mean() - 1 / (total + 1)) < 0.01
    with pytest.raises(ValueError):
        sharding.place(F.col("doc_id"), [sharding.Shard(0, 0, 0, 0.0)])
    with pytest.raises(ValueError):
        sharding.assign(keys.withColumn("text", F.lit("")), UNEVEN, added=[sharding.Shard(1, 9, 9)])


def test_warc_round_trip(spark, tmp_path):
    page = ["<p>a</p>", "<p>a</p>", "", None, "é" * 5000, "<p>a</p>", "\r\n\r\n", "big" * 100_000]
    data = [(i, f"http://h/{i}?q=é x" if i % 3 else None, t) for i, t in enumerate(page)] + [(None, "u\r\nX: 1", "<p>null</p>"), (6, "http://h/6", "\r\n\r\n")]
    pages = spark.createDataFrame(data, "page_id long, url string, html string")
    got = warc.round_trip(pages).toPandas()
    top = {}
    for i, _, t in data:
        b = (t or "").encode()
        if i is not None:
            top[b] = max(top.get(b, i), i)
    want = Counter()
    for i, _, t in data:
        b = (t or "").encode()
        revisit = b in top and i != top[b]
        want[(i, len(b), warc.digest(b), "revisit" if revisit else "response", top[b] if revisit else None)] += 1
    na = lambda v: None if pd.isna(v) else int(v)
    assert Counter((na(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, na(r.refers_to)) for r in got.itertuples()) == want
    files = warc.save_files(warc.archives(pages, roll=100_000), str(tmp_path / "w"))
    assert files.count() >= 1
    back = warc.read_files(spark, str(tmp_path / "w")).toPandas()
    assert Counter(back.payload_digest) == Counter(got.payload_digest)
    url = {na(r.page_id): r.url for r in back.itertuples()}
    assert url[1] == "http://h/1?q=é x" and url[None] == "u\r\nX: 1"
    assert warc.round_trip(pages.limit(0)).count() == 0
    assert warc.round_trip(pages, least=4).filter("payload_bytes < 4 and record_type = 'revisit'").count() == 0


def test_damaged_archives_are_refused():
    good = warc.record(1, "u", b"hello", None, False) + warc.record(2, "u", b"hello", 1, True)
    cut = lambda data, n: list(warc.records(data[i : i + n] for i in range(0, len(data), n)))
    assert [r.page_id for r in cut(good, 7)] == [1, 2] == [r.page_id for r in cut(good, 10_000)]
    assert cut(good, 1)[1].refers_to == 1
    for bad in (good[:-3], good[:20] + b"\xff\xff" + good[22:], good + b"tail"):
        with pytest.raises(ValueError):
            cut(bad, 64)
    raw = zlib.compressobj(6, zlib.DEFLATED, 31)
    lie = raw.compress(b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 9\r\n\r\nshort\r\n\r\n") + raw.flush()
    with pytest.raises(ValueError):
        cut(lie, 64)


def water_fill(sizes, weights, most):
    """The rule step by step: clamp, reshare, again."""
    total, target, open_ = sum(sizes.values()), {}, sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(open_)}
    while open_:
        left = total - sum(target.values())
        level = left / sum(w[s] for s in open_)
        over = [s for s in open_ if level * w[s] > most * sizes[s]]
        if not over:
            return target | {s: level * w[s] for s in open_}
        target |= {s: most * sizes[s] for s in over}
        open_ = [s for s in open_ if s not in over]
    return target


def test_what_each_document_gives(docs):
    """Whole repetitions and, in order of draws, the rest of the target: document by document."""
    data = [(r.doc_id, r.source, r.n, r.d) for r in docs.select("doc_id", "source", mixing.size_of(F.col("text")).alias("n"), F.xxhash64(F.lit(mixing.SEED), F.col("doc_id"), F.col("text")).alias("d")).collect()]
    sizes = Counter()
    for _, s, n, _ in data:
        sizes[s] += n
    want = Counter()
    for s, target in water_fill(sizes, mixing.WEIGHTS, 3).items():
        words = math.floor(target + 0.5)
        whole, left = divmod(words, sizes[s]) if sizes[s] else (0, 0)
        for i, _, n, _ in sorted((x for x in data if x[1] == s), key=lambda x: (x[3] % 2**64, x[2])):
            more = max(0, min(n, left))
            left -= more
            want[(i, n, whole * n + more)] += 1
    got = Counter((r.doc_id, r["size"], r.taken) for r in mixing.mix(docs).collect())
    assert got == want
    times = Counter(r.doc_id for r in mixing.repeated(docs).collect())
    assert times == Counter({i: k for i, k in sum((Counter({i: int(t / n + 0.5) * c}) for (i, n, t), c in want.items() if n), Counter()).items()})


def test_mixing(docs, empty):
    out = mixing.mix(docs).toPandas()
    data = rows()
    size = lambda t: len(__import__("re").findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = Counter()
    for r in data:
        sizes[r[3]] += size(r[1])
    want = water_fill(sizes, mixing.WEIGHTS, 3)
    assert len(out) == len(data)
    for (source,), g in out.assign(source=out.source.where(out.source.notna(), None)).groupby(["source"], dropna=False):
        source = None if pd.isna(source) else source
        assert g.source_size.iloc[0] == sizes[source] and math.isclose(g.target.iloc[0], want[source])
        assert g.taken.sum() == math.floor(want[source] + 0.5)
    assert (out.taken <= 3 * out["size"]).all()
    again = mixing.mix(docs.repartition(7)).toPandas()
    key = lambda d: sorted(map(str, zip(d.doc_id.fillna(-1), d["size"], d.taken, strict=True)))
    assert key(out) == key(again)
    rep = mixing.repeated(docs)
    assert rep.columns == docs.columns and rep.count() > 0
    assert mixing.mix(empty).count() == 0 and mixing.repeated(empty).count() == 0


@pytest.mark.parametrize("sizes", [{"a": 5, "b": 500, "c": 40, None: 3}, {"z": 0, "b": 7}, {"only": 9}, {"a": 0}])
def test_targets_fill_like_water(spark, sizes):
    df = spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    want = water_fill(sizes, mixing.WEIGHTS, 3)
    assert all(math.isclose(got[k], want[k], abs_tol=1e-9) for k in sizes)
