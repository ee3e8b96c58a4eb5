"""Where operators keep intermediate tables (``sources.store``), and how rows of a hot key meet what is known of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.store import bounded, clear, few, materialize, scratch, shared_folder, tabled

__all__ = ["bounded", "clear", "fan_out", "few", "materialize", "scratch", "shared_folder", "spread_back", "tabled", "text_bytes"]


def fan_out(df: DataFrame) -> int:
    """As many partitions as a shuffle has."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def spread_back(rows: DataFrame, per_key: DataFrame, keys: list[str], copies: str, one: str, row_id: str, salts: int = 16) -> DataFrame:
    """Left-join what was found for each key back to the rows, where one key may hold a third of them.

    A key with one row meets it under the salt of that row's id (column ``one``); a key with more
    is repeated under every salt, so its rows are dealt over ``salts`` tasks. Null ids salt alike.
    """
    salt = lambda c: F.pmod(F.xxhash64(c), F.lit(salts)).cast("int")
    many = F.when(F.col(copies) > 1, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(salt(F.col(one))))
    return rows.withColumn("_salt", salt(F.col(row_id))).join(per_key.withColumn("_salt", F.explode(many)).drop(copies, one), [*keys, "_salt"], "left").drop("_salt")


def text_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
