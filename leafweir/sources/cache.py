"""Results kept by content fingerprint and options, as partitions of one Parquet table."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SECRET = ("password",)


def cache_key(options: dict, defaults: dict | None = None) -> str:
    """Hash of the options that differ from the defaults, in any order; secrets enter as hashes."""
    said = {k: hashlib.sha256(str(v).encode()).hexdigest() if k in _SECRET else v for k, v in options.items() if v is not None and (defaults or {}).get(k) != v}
    return hashlib.sha256(json.dumps(said, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:32]


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def put(rows: DataFrame, root: str, key: str) -> None:
    """Rows (with fingerprint) under this key, replacing what was there; Spark's committer makes it whole or not at all."""
    rows.withColumn("cache_key", F.lit(key)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("cache_key", "fingerprint").parquet(root)


def get(spark: SparkSession, root: str, key: str) -> DataFrame | None:
    """The rows of a key, pruned to its partitions; null where there are none."""
    p, fs = _path(spark, f"{root}/cache_key={key}")
    return spark.read.parquet(root).filter(F.col("cache_key") == key).drop("cache_key") if fs.exists(p) else None


def drop(spark: SparkSession, root: str, key: str, fingerprint: str | None = None) -> bool:
    p, fs = _path(spark, f"{root}/cache_key={key}" + (f"/fingerprint={fingerprint}" if fingerprint else ""))
    return bool(fs.delete(p, True)) if fs.exists(p) else False


def clear(spark: SparkSession, root: str) -> bool:
    p, fs = _path(spark, root)
    return bool(fs.delete(p, True)) if fs.exists(p) else False
