"""Intermediate tables in the folder that driver and executors share.

``materialize`` cuts lineage by writing Parquet under ``spark.checkpoint.dir`` and reading it back:
Spark's commit protocol makes it safe against lost executors, what several steps read is computed once,
and a later join on it has a plain exchange on either side, which adaptive execution can split when a key
is hot. The folder is the cluster's own when the setting is there; only where it is unset and Spark is
local (tests, a laptop) a local one is set. Tables go when Python ends, or earlier with ``clear``.

Files cost more than their bytes. Hadoop's local file system starts ``chmod`` three times for each, and until
such a process runs its own program it counts with all the memory of the JVM that started it. ``few`` keeps a
task for every core but writes what up to FILE_PARTITIONS partitions hold in one file. ``tabled``, for operators
of many tables, starts no process at all where the folder is a local path: Python workers write the files.

Spark sends rows to Python workers 10,000 at a time, up to 64 MB, and what it makes room for in the executor
doubles as a batch grows. ``bounded`` sets a lower limit in bytes, so batches of whole texts stay small.
"""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

FILE_PARTITIONS = 8
#: Bytes of a row group that a Python worker gathers before it writes them.
GROUP_BYTES = 8 << 20
#: Bytes of rows that go to a Python worker at once; with one doubling still within a chunk (4 MB) that Arrow's allocator keeps and reuses.
BATCH_BYTES = 2 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
Batches = Iterator[pa.RecordBatch]
_WRITTEN: list[tuple[SparkSession, str, str | None]] = []


def shared_folder(spark: SparkSession) -> str:
    kept = spark.sparkContext.getCheckpointDir() if spark.sparkContext._jsc.sc().getCheckpointDir().isDefined() else None
    folder = spark.conf.get("spark.checkpoint.dir", None) or kept
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="leafweir-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch(spark: SparkSession, name: str, table: str | None = None) -> str:
    """A path for an intermediate table, and its name where it is one of the catalogue's."""
    path = f"{shared_folder(spark).rstrip('/')}/leafweir-{uuid.uuid4().hex[:12]}-{name}"
    _WRITTEN.append((spark, path, table))
    return path


def few(df: DataFrame) -> DataFrame:
    """The same rows in fewer partitions, one or more whole rounds of all cores: no shuffle, each is still read by itself."""
    cores = max(1, df.sparkSession.sparkContext.defaultParallelism)
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.coalesce(cores * -(-partitions // (FILE_PARTITIONS * cores)))


def bounded(spark: SparkSession) -> None:
    """From now on a batch ends with the row that reaches BATCH_BYTES; a limit that the session has already stays."""
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def materialize(df: DataFrame, name: str) -> DataFrame:
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, dealt: bool = False) -> DataFrame:
    """``materialize`` in buckets of doc_id and page, so that what is grouped, ordered or joined by page is dealt out this once.

    dealt: the rows lie so already, as they come from such a table. Joins on the rows sort: by the size of its
    file, which says little of its rows, Spark would send a table to all.
    """
    n, table = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), f"leafweir_{name.replace('-', '_')}_{uuid.uuid4().hex[:12]}"
    path = scratch(df.sparkSession, name, table)
    rows = df if dealt else df.repartition(n, "doc_id", "page")
    rows.write.bucketBy(n, "doc_id", "page").option("path", path).format("parquet").saveAsTable(table)
    return df.sparkSession.table(table).hint("merge")


def _write_part(folder: str, make: Callable[[Batches], Batches] | None):
    """Write what ``make`` makes of a task's rows to a file that readers pass over; its name is the one row that comes back."""

    def run(batches: Batches) -> Batches:
        name, writer, held = f"part-{uuid.uuid4().hex}.parquet", None, []
        for batch in batches if make is None else make(batches):
            if not batch.num_rows:
                continue
            writer = writer or pq.ParquetWriter(f"{folder}/_{name}", batch.schema, compression="snappy", write_page_checksum=True)
            held.append(batch)
            if sum(b.nbytes for b in held) >= GROUP_BYTES:
                writer.write_table(pa.Table.from_batches(held))
                held = []
        if writer is not None:
            if held:
                writer.write_table(pa.Table.from_batches(held))
            writer.close()
            yield pa.RecordBatch.from_pydict({"name": [name]})

    return run


def tabled(df: DataFrame, name: str, make: Callable[[Batches], Batches] | None = None, schema: str | None = None) -> DataFrame:
    """``materialize`` of ``few`` files, of the rows or of what ``make`` (as for mapInArrow) makes of them.

    A file counts once the driver has its name from the task that Spark took as done and renames it: what a
    lost or repeated task left is never read. Checksums of pages, verified on reading, stand for Hadoop's.
    """
    spark, rows = df.sparkSession, few(df)
    where = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).getUri().getScheme() != "file":
        return materialize(rows if make is None else rows.mapInArrow(make, schema), name)
    path = scratch(spark, name)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path).toUri().getPath()
    os.makedirs(folder)
    for part in rows.mapInArrow(_write_part(folder, make), "name string").collect():
        os.rename(f"{folder}/_{part.name}", f"{folder}/{part.name}")
    kind = df.schema if make is None else StructType.fromDDL(schema)
    return spark.read.option("parquet.page.verify-checksum.enabled", "true").schema(kind).parquet(path)


def clear() -> None:
    """Delete every intermediate table that this process wrote; frames that still read one are void.

    Files go even when Spark has been stopped, as long as its process lives; catalogue entries only before.
    """
    while _WRITTEN:
        spark, path, table = _WRITTEN.pop()
        with contextlib.suppress(Py4JError, OSError):
            if table and spark.sparkContext._jsc is not None:
                spark.sql(f"drop table if exists {table}")
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


atexit.register(clear)
