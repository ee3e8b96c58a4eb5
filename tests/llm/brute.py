"""Plain versions of the operators, quadratic where need be, for small tables."""

import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def split_words(text):
    return WORD.findall(lower(text))


def bag(text, size=5):
    w = split_words(text)
    if not w:
        return Counter()
    n = min(size, len(w))
    return Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))


def similarity(a, b):
    both = sum((a & b).values())
    either = sum((a | b).values())
    return both / either if either else 0.0


def near_classes(texts, threshold=0.8):
    """Class number of each text: components of similar pairs and equal texts."""
    root = list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    bags = [bag(t) for t in texts]
    words = [split_words(t) for t in texts]
    where = {}
    for i, b in enumerate(bags):
        for s in b:
            where.setdefault(s, []).append(i)
    for i in range(len(texts)):
        near = Counter(j for s in bags[i] for j in where[s] if j < i)
        for j in near:
            if similarity(bags[i], bags[j]) >= threshold:
                root[max(top(i), top(j))] = min(top(i), top(j))
        if not words[i]:
            for j in range(i):
                if not words[j] and (texts[i] or "") == (texts[j] or ""):
                    root[max(top(i), top(j))] = min(top(i), top(j))
    return [top(i) for i in range(len(texts))]


def decontaminated(text, items):
    """n_words, n_hit, n_items, items_sha256."""
    w = split_words(text)
    hit, found = set(), set()
    places = {}
    for i, x in enumerate(w):
        places.setdefault(x, []).append(i)
    for item_id, item in items:
        v = split_words(item)
        windows = [v[i : i + 10] for i in range(len(v) - 9)] if len(v) >= 10 else [v] if v else []
        for x in windows:
            for i in places.get(x[0], []):
                if w[i : i + len(x)] == x:
                    hit.update(range(i, i + len(x)))
                    found |= {item_id} - {None}
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()


def without_repeats(texts, length=200, key=bytes):
    """n_bytes, n_removed, n_spans, kept_sha256 of each text; strings are told apart by ``key``."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(key(b[i : i + length]) for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[key(b[i : i + length])] > 1:
                gone[i : i + length] = b"\x01" * length
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out
