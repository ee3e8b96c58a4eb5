"""Mixing sources to target weights by capped water-filling (op 10).

Sources by code point, null last, have weights; together they share all words. A source's target is
``min(epochs * size, level * weight)`` with the one level at which targets add up to the words there
are: sources clamped at their most epochs leave their excess to the rest in proportion to weight,
until none is above. With sources in order of ``cap / weight`` the clamped ones come first, so
running sums give the level without iteration.

Each text is taken a whole number of times, and the rest of the target goes round the source's texts
in an order drawn from a seeded hash: those before the cut once more, the one at the cut for the words
that are left. Every source meets its rounded target exactly. Running sums are taken in two steps,
over hash buckets and within them, so no task sorts a source; a source may hold any share of the rows.

Defined results: null or blank texts have size 0 and are taken 0 times; sources without words have
target 0. Rows alike in id and text are interchangeable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._store import materialize

WEIGHTS = (5, 2, 1)
EPOCHS = 3
SEED = 20240229
#: A source is dealt to 2 ** 12 buckets by its draws' leading bits; the order of draws is the same for any number.
BUCKET_BITS = 12
_WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """source, source_size, target of a table with one row per source (source, source_size)."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sizes.withColumn("w", weight.cast("long")).withColumn("cap", F.col("source_size") * epochs)
    ratio = [F.col("cap") / F.col("w"), F.col("source").asc_nulls_last()]
    all_rows = Window.orderBy(*ratio).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    from_here = Window.orderBy(*ratio).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    clamped_before = F.coalesce(F.sum("cap").over(Window.orderBy(*ratio).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("level", (F.sum("source_size").over(all_rows) - clamped_before) / F.sum("w").over(from_here)).withColumn("place", F.row_number().over(Window.orderBy(*ratio)))
    rows = rows.withColumn("open", F.min(F.when(F.col("cap") >= F.col("level") * F.col("w"), F.struct("place", "level"))).over(all_rows))
    target = F.when(F.col("open").isNull() | (F.col("place") < F.col("open.place")), F.col("cap").cast("double")).otherwise(F.col("open.level") * F.col("w"))
    return rows.select("source", "source_size", target.alias("target"))


def _taken(docs: DataFrame, keep: list[str], weights: tuple[int, ...], epochs: int, seed: int) -> DataFrame:
    """``keep`` and _lw_size, _lw_source_size, _lw_target, _lw_taken."""
    draw = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text"))
    # never null, so that running sums and join have one partitioning: a document is shuffled once
    named = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    rows = docs.select(*keep, F.col("source").alias("_lw_source"), named.alias("_lw_key"), size_of(F.col("text")).alias("_lw_size"), draw.alias("_lw_draw")).withColumn("_lw_bucket", F.shiftrightunsigned("_lw_draw", 64 - BUCKET_BITS))
    small = materialize(rows.groupBy(F.col("_lw_source").alias("source"), F.col("_lw_bucket").alias("bucket")).agg(F.sum("_lw_size").alias("n")), "bucket-sizes")
    per_source = targets(small.groupBy("source").agg(F.sum("n").alias("source_size")), weights, epochs)
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = small.select("source", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    # a table, so that Spark sees its size: broadcast when small, else a join whose hot keys are split
    plan = materialize(offsets.alias("o").join(per_source.alias("p"), F.col("o.source").eqNullSafe(F.col("p.source"))).select(F.coalesce(F.concat(F.lit("="), F.col("o.source")), F.lit("")).alias("_lw_key"), F.col("o.bucket").alias("_lw_bucket"), F.col("before").alias("_lw_before"), F.col("source_size").alias("_lw_source_size"), F.col("target").alias("_lw_target")), "plan")
    within = Window.partitionBy("_lw_key", "_lw_bucket").orderBy("_lw_draw", "_lw_size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_lw_own", F.coalesce(F.sum("_lw_size").over(within), F.lit(0)))
    rows = rows.join(plan, ["_lw_key", "_lw_bucket"])
    words = F.expr("cast(round(_lw_target) as bigint)")
    rows = rows.withColumn("_lw_whole", F.when(F.col("_lw_source_size") > 0, F.expr("cast(round(_lw_target) as bigint) div _lw_source_size")).otherwise(F.lit(0)))
    rest = words - F.col("_lw_whole") * F.col("_lw_source_size")
    extra = F.greatest(F.lit(0), F.least(F.col("_lw_size"), rest - F.col("_lw_before") - F.col("_lw_own")))
    return rows.withColumn("_lw_taken", (F.col("_lw_whole") * F.col("_lw_size") + extra).cast("long")).select(*keep, "_lw_size", "_lw_source_size", "_lw_target", "_lw_taken")


_RESULT = ("size", "source_size", "target", "taken")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, seed: int = SEED, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of every document (default: all but such of those names) and size, source_size, target, taken."""
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in _RESULT]
    return _taken(docs, keep, weights, epochs, seed).withColumnsRenamed({f"_lw_{c}": c for c in _RESULT})


def repeated(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """The mix as documents: each as often as it is taken, the one at the cut when half of it or more is."""
    times = F.when(F.col("_lw_size") > 0, F.floor(F.col("_lw_taken") / F.col("_lw_size") + 0.5).cast("int")).otherwise(F.lit(0))
    rows = _taken(docs, docs.columns, weights, epochs, seed).withColumn("_lw_times", times).filter("_lw_times > 0")
    return rows.withColumn("_lw_copy", F.explode(F.sequence(F.lit(1), F.col("_lw_times")))).select(*docs.columns)
