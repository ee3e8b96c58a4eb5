"""A training corpus out of ``documents`` in five stages, each one of the operators of leafweir.llm.

Each stage gets what its predecessor kept and returns the columns of documents; the last adds where
each row goes. ``run`` writes every stage's rows to the shared folder and reads them again, in few files.
Stages with Python workers bound the bytes of a batch (``store.bounded``), for the rest of the session.

* language: texts further from every language's centroids than its reach go; learned from the rows'
  own text and lang.
* near_dedup: of each near-duplicate class (five words, 0.8) one document stays.
* decontaminate: documents with a window of ten words of a benchmark item go.
* mix: sources are repeated or thinned to their target weights.
* shard: shard, slot and size are added.

Null texts, and texts without a letter, go in the first stage; empty input gives empty output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leafweir.llm import bag_minhash, decontam, langid, mixing, sharding
from leafweir.llm._store import bounded, few, materialize


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded(spark)
    return few(langid.accepted(docs, langid.fit(docs)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded(spark)
    return bag_minhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded(spark)
    return few(decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return few(mixing.repeated(docs))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return few(sharding.assign(docs))


STAGES = [("language", language), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix", mix), ("shard", shard)]

#: Hashes, signatures and centroids are not SQL: every stage is tested against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
