"""Sharding by a hierarchical weighted hash tree (op 8).

Shards hang under racks, racks under regions; a node weighs what the shards below it weigh. A key
descends: among the regions, then among the racks of the one it chose, then among that rack's shards,
it takes the child of least draw ``-ln(u) / weight``, u from a hash of key and child. That is one draw
for each child of a node on the way, not one for each shard. A child's draw falls only if its own
weight grows, so at each level keys move only into a child whose weight grew (or out of one whose
weight fell): all movement stays within the subtrees whose weights change.

Growth that takes keys only into what is new: ``added`` shards stand in regions of their own beside
the old ones (a shard that grows may stand there once more, with the weight it gains). A key leaves its
place only if an added region's draw is the least, and finds only added shards there.

The law is ``key``: id and tree decide. Slots number a shard's rows without gaps from 0: rows are
dealt to ``buckets`` per shard by a hash of the id, counted, and numbered within their bucket after
the counts of the buckets before it, so no task sorts a whole shard. The count reads ids only.

Defined results: null ids draw like a key of their own; null text has no bytes (size 16, crc32 0).
Columns of the input named size, text_crc32, law, shard, slot or grown_shard are replaced.
"""

from __future__ import annotations

import hashlib
import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SHARDS = 40
BUCKETS = 1024
RESULT = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
_STEPS = 2.0**-53


class Shard(NamedTuple):
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def tree(shards: int, per_rack: int = 4, racks: int = 5) -> list[Shard]:
    """Shards filled into racks and racks into regions in order."""
    return [Shard(s // per_rack // racks, s // per_rack, s) for s in range(shards)]


def more(shards: list[Shard], weight: float = 1.0) -> list[Shard]:
    """One further shard, as what is added to these: it stands in a region of its own."""
    return [Shard(1 + max(s.region for s in shards), 1 + max(s.rack for s in shards), 1 + max(s.shard for s in shards), weight)]


def seed(*path: int) -> int:
    """A node's number in hashes: 64 bits of its path from the root."""
    return int.from_bytes(hashlib.blake2b(repr(path).encode(), digest_size=8).digest(), "big", signed=True)


def walk(key: Column, shards: list[Shard]) -> Column:
    """Struct of the chosen region's draw and the shard that the descent ends in.

    The tree is one literal of nested arrays, so generated code does not grow with it.
    """
    if not shards or any(not s.weight > 0 or not math.isfinite(s.weight) for s in shards):
        raise ValueError("a tree needs shards of positive finite weight")
    below: dict[int, dict[int, list[Shard]]] = {}
    for s in shards:
        below.setdefault(s.region, {}).setdefault(s.rack, []).append(s)
    node = lambda path, within, kids: F.struct(F.lit(seed(*path)).alias("seed"), F.lit(float(math.fsum(s.weight for s in within))).alias("weight"), kids.alias("below"))
    leaf = lambda s: node((s.region, s.rack, s.shard), [s], F.lit(s.shard))
    rack = lambda g, r, own: node((g, r), own, F.array(*map(leaf, own)))
    region = lambda g, own: node((g,), [s for r in own.values() for s in r], F.array(*[rack(g, r, x) for r, x in own.items()]))

    def least(nodes: Column) -> Column:
        u = lambda n: (F.shiftrightunsigned(F.xxhash64(key, n["seed"]), 11).cast("double") + 0.5) * _STEPS
        return F.array_min(F.transform(nodes, lambda n: F.struct((-F.log(u(n)) / n["weight"]).alias("draw"), n["below"].alias("below"))))

    top = least(F.array(*[region(g, own) for g, own in below.items()]))
    return F.struct(top["draw"].alias("draw"), least(least(top["below"])["below"])["below"].alias("shard"))


def place(key: Column, shards: list[Shard]) -> Column:
    """Shard number of a key."""
    return walk(key, shards)["shard"]


def assign(docs: DataFrame, shards: list[Shard] | None = None, buckets: int = BUCKETS, added: list[Shard] | None = None) -> DataFrame:
    """All columns of docs and size, text_crc32, law, shard, slot, grown_shard (the shard once ``added`` is there)."""
    shards = shards or tree(SHARDS)
    added = added or more(shards)
    if {s.region for s in shards} & {s.region for s in added}:
        raise ValueError("what is added stands in regions of its own")
    names = [c for c in docs.columns if c.lower() not in RESULT]
    key = F.col("doc_id").cast("long")
    raw = F.coalesce(F.col("text"), F.lit(""))
    bucket = F.pmod(F.xxhash64(key, F.lit("slot")), F.lit(buckets)).cast("int").alias("_lw_bucket")
    rows = docs.select(*names, (F.octet_length(raw).cast("long") + 16).alias("size"), F.crc32(raw.cast("binary")).alias("text_crc32"), walk(key, shards).alias("_lw_old"), walk(key, added).alias("_lw_new"), bucket)
    rows = rows.select(*names, "size", "text_crc32", F.lit("key").alias("law"), F.col("_lw_old.shard").alias("shard"), F.least("_lw_old", "_lw_new")["shard"].alias("grown_shard"), "_lw_bucket")
    counts = docs.select(place(key, shards).alias("shard"), bucket).groupBy("shard", "_lw_bucket").agg(F.count(F.lit(1)).alias("n"))
    return with_slots(rows, counts).select(*names, *RESULT)


def with_slots(rows: DataFrame, counts: DataFrame) -> DataFrame:
    before = Window.partitionBy("shard").orderBy("_lw_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "_lw_bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_lw_before"))
    within = Window.partitionBy("shard", "_lw_bucket").orderBy(F.col("doc_id").asc_nulls_first(), "text_crc32", "size")
    numbered = rows.withColumn("_lw_row", F.row_number().over(within))
    # at most shards x buckets rows, of three numbers each
    return numbered.join(F.broadcast(offsets), ["shard", "_lw_bucket"]).withColumn("slot", (F.col("_lw_before") + F.col("_lw_row") - 1).cast("long"))
