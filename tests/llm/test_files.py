"""How many files the intermediate tables and stages are, each of which costs processes on the executors."""

import os
import shutil
import subprocess
import sys
import zlib
from collections import Counter
from contextlib import contextmanager

import brute
import corpus_pipeline as cp
import pyarrow as pa
import pytest
from test_ops import DOCS, edited, prose

from leafweir.llm import bag_minhash, queries
from leafweir.sources import store

TEXTS = [edited(prose(90, 55), 100 + i, share) for share in (0.03, 0.12) for i in range(12)] + [prose(80, i % 60) for i in range(120)] + [None, "", "one"]


@contextmanager
def dealt(spark, partitions):
    """As many partitions as are asked for."""
    conf = {"spark.sql.shuffle.partitions": str(partitions), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def files(spark):
    folder = store.shared_folder(spark).removeprefix("file:")
    return Counter(at for at, _, names in os.walk(folder) if "leafweir-" in at for x in names if x.startswith("part-"))


@pytest.mark.parametrize("partitions", [32, 64])
def test_near_duplicates_write_few_files_and_miss_nothing(spark, partitions):
    before, most = files(spark), 4 * (partitions // 32)
    with dealt(spark, partitions):
        docs = spark.createDataFrame([(i, t, "en", "a", len(t or "")) for i, t in enumerate(TEXTS)], DOCS).repartition(partitions)
        kept = cp.near_dedup(spark, docs, "")
        found = {r.doc_id for r in kept.collect()}
        assert kept.rdd.getNumPartitions() <= most
    first = {}
    for i, c in enumerate(brute.near_classes(TEXTS)):
        first.setdefault(c, i)
    assert found == set(first.values())
    written = files(spark) - before
    assert len(written) > 5 and max(written.values()) <= most


def test_few_loses_no_rows_and_keeps_every_core_busy(spark):
    for partitions, want in ((4, 4), (32, 4), (33, 8), (211, 28)):
        with dealt(spark, partitions):
            rows = spark.range(1000).repartition(partitions + 30)
            assert store.few(rows).rdd.getNumPartitions() == want and sorted(r.id for r in store.few(rows).collect()) == list(range(1000))
            assert store.few(rows.limit(0)).count() == 0 and store.few(spark.range(10).repartition(2)).rdd.getNumPartitions() == 2


def test_near_duplicate_classes_with_fewer_files_are_those_of_any_number(spark):
    docs = spark.createDataFrame([(i, t, "en", "a", len(t or "")) for i, t in enumerate(TEXTS)], DOCS)
    some = sorted(tuple(r) for r in bag_minhash.near_duplicates(docs).select("doc_id", "class_id", "class_size", "keep").collect())
    with dealt(spark, 40):
        assert sorted(tuple(r) for r in bag_minhash.near_duplicates(docs, centres=1).select("doc_id", "class_id", "class_size", "keep").collect()) == some


PROCESSES = """
import os, sys
from pyspark.sql import SparkSession
from leafweir.sources import store

spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://" + sys.argv[1] + "/shared").getOrCreate()
spark.range(1000).repartition(5).write.parquet(sys.argv[1] + "/plain")
print("PLAIN", os.path.getsize(sys.argv[1] + "/chmods"))
open(sys.argv[1] + "/chmods", "w").close()
rows = store.tabled(spark.range(1000).repartition(5), "rows")
print("TABLE", os.path.getsize(sys.argv[1] + "/chmods"), rows.count(), rows.agg({"id": "sum"}).first()[0])
"""


def test_intermediate_tables_start_no_process(tmp_path):
    (tmp_path / "chmods").touch()
    (tmp_path / "bin").mkdir()
    (tmp_path / "bin/chmod").write_text(f'#!/bin/sh\necho "$@" >> {tmp_path}/chmods\nexec {shutil.which("chmod")} "$@"\n')
    (tmp_path / "bin/chmod").chmod(0o755)
    env = os.environ | {"PATH": f"{tmp_path}/bin:{os.environ['PATH']}", "PYTHONPATH": os.path.dirname(os.path.abspath(cp.__file__))}
    for inherited in ("PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET"):
        env.pop(inherited, None)
    said = subprocess.run([sys.executable, "-c", PROCESSES, str(tmp_path)], env=env, capture_output=True, text=True, timeout=120).stdout.split("\n")
    plain, table = (next(x.split()[1:] for x in said if x.startswith(name)) for name in ("PLAIN", "TABLE"))
    assert int(plain[0]) > 0 and table == ["0", "1000", "499500"]


def test_a_damaged_intermediate_table_is_not_read(spark):
    rows = store.tabled(spark.range(4000).coalesce(1).selectExpr("id", "md5(string(id)) as text"), "damaged")
    assert rows.filter("length(text) = 32").count() == 4000
    path = rows.inputFiles()[0].removeprefix("file://")
    with open(path, "r+b") as f:
        f.seek(os.path.getsize(path) // 2)
        byte = f.read(1)
        f.seek(-1, os.SEEK_CUR)
        f.write(bytes([byte[0] ^ 1]))
    with pytest.raises(Exception, match="(?i)checksum|crc"):
        rows.agg({"text": "max"}).collect()


def test_near_duplicate_classes_are_handed_out_in_few_files(spark, tmp_path):
    docs = spark.createDataFrame([(i, t, "en", "a", len(t or "")) for i, t in enumerate(TEXTS)], DOCS)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    with dealt(spark, 64):
        found = queries.op1_bag_minhash(spark, str(tmp_path))
        assert found.rdd.getNumPartitions() <= 8
    want = sorted(tuple(r) for r in bag_minhash.near_duplicates(docs).select("doc_id", "class_id", "class_size", "keep").collect())
    assert sorted(tuple(r) for r in found.collect()) == want


LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.mark.parametrize("stage", ["language", "near_dedup", "decontaminate"])
def test_stages_send_whole_texts_in_bounded_batches(spark, stage):
    """Fewer than 10,000 rows of long texts came as one batch, however many bytes that were."""

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"rows": [b.num_rows], "bytes": [b.nbytes], "before_last": [b.slice(0, b.num_rows - 1).nbytes], "crc": [sum(zlib.crc32(t.encode()) for t in b.column("text").to_pylist())]})

    texts = [f"{i} " + prose(80, i % 60) * 40 for i in range(600)] + [prose(90, 7) * 9000]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], DOCS).coalesce(1)
    own = spark.conf.get(LIMIT, None)
    try:
        spark.conf.unset(LIMIT)
        dict(cp.STAGES)[stage](spark, docs, "/root/testdata/sf0.001")
        got = docs.select("text").mapInArrow(sizes, "rows long, bytes long, before_last long, crc long").collect()
        assert sum(r.rows for r in got) == len(texts) and sum(r.crc for r in got) == sum(zlib.crc32(t.encode()) for t in texts)
        assert sum(r.bytes for r in got) > 4 * store.BATCH_BYTES and max(r.before_last for r in got) <= store.BATCH_BYTES
        spark.conf.set(LIMIT, "5m")
        dict(cp.STAGES)[stage](spark, docs.limit(3), "/root/testdata/sf0.001")
        assert spark.conf.get(LIMIT) == "5m"
    finally:
        spark.conf.unset(LIMIT) if own is None else spark.conf.set(LIMIT, own)
