"""The dealt operators as registered queries, with production parameters on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bag_minhash, chat, decontam, langid, mixing, quality, sharding, suffix_dedup, syncmers, warc
from ._store import tabled


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bag_minhash.near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size", "keep")
    # narrow rows: read again they are split by bytes, so whoever writes them writes few files
    return tabled(found, "classes")


def op2_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.edited_likeness(_table(spark, sf_dir, "documents"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.overlaps(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_passages(_table(spark, sf_dir, "documents")).drop("spans")


def op5_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality.fit(docs, quality.grades(_table(spark, sf_dir, "labels")))
    return quality.score(docs, model)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = langid.fit(docs.filter(~langid.held_out(F.col("doc_id"))))
    found = langid.predict(docs, model)
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    said = "</s>[INST] ok [/INST]"
    probe = spark.sql("select col1 as conv_id, col2 as turn, col3 as role, col4 as text from values (-1L, 0L, 'user', :said), (-1L, 1L, 'assistant', :said)", args={"said": said})
    return chat.digests(chat.render(chat.fold(chat.log_of_turns(turns.unionByName(probe)))))


def op8_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = sharding.assign(docs, sharding.tree(sharding.SHARDS))
    return found.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"), keep=["doc_id"])


QUERIES = {
    "op1_bag_minhash": op1_bag_minhash,
    "op2_syncmers": op2_syncmers,
    "op3_decontaminate": op3_decontaminate,
    "op4_repeated_passages": op4_repeated_passages,
    "op5_ordinal_quality": op5_ordinal_quality,
    "op6_language": op6_language,
    "op7_chat_format": op7_chat_format,
    "op8_hash_tree_shards": op8_hash_tree_shards,
    "op9_warc": op9_warc,
    "op10_mix_sources": op10_mix_sources,
}
ORACLE_SQL: dict[str, str] = {"op3_decontaminate": decontam.ORACLE, "op7_chat_format": chat.ORACLE, "op9_warc": warc.ORACLE}
