"""Tables that cut lineage, in the shared folder that spark.checkpoint.dir names."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellgrove.llm.arrow import release

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes and rows that are sent to a Python worker at once: a bound of memory, as long texts make rows large.
BATCH = {"spark.sql.execution.arrow.maxBytesPerBatch": str(2 << 20), "spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}

#: Tables of keys and counts go to few files.
FEW = {"spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32m"}
#: Tasks, and so files, of one table for each core of the cluster; fewer for tables of keys and counts. A task goes through the partitions it is given one by one.
FILES, FEW_FILES = 16, 4
#: Bytes that a task holds of a table before it writes them out.
ROW_GROUP = 16 << 20
#: A shared folder that is mounted (file:) gets files as they are. With checksum files beside them, each would take one more process of the JVM's.
PLAIN = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Session settings for the time of a block."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names; one of our own only where none is named, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = "file://" + tempfile.mkdtemp(prefix="cellgrove-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


class Store:
    """Intermediate tables of one run of an operator.

    A table is written once to the shared folder and read back, so later steps
    don't depend on the executors that made it. Shuffle files of the job that
    wrote it are removed as soon as it is written.

    direct: where the folder is mounted (file:), Python workers write its files.
    Without Hadoop's native library the JVM starts a process for each file and
    task folder that it makes; until that one runs, it counts as large as the JVM.
    """

    def __init__(self, spark: SparkSession, name: str, *, direct: bool = False):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0
        self.direct = direct and self.root.startswith("file:")

    def put(self, df: DataFrame, *, small: bool = False, mapped: tuple[Callable, str] | None = None) -> DataFrame:
        """small: a table of keys and counts, written in few files.

        mapped: a function and schema for mapInArrow, through which the rows go
        first. Where files are written directly, the worker that maps writes
        too: two in one task would both stay for later tasks, and all that stay
        get those in turn, so each would come to hold what the tasks keep.
        """
        f = None
        schema = df.mapInArrow(*mapped).schema if mapped else df.schema
        if mapped and self.direct:
            f = mapped[0]
        elif mapped:
            df = df.mapInArrow(*mapped)
        self.n += 1
        path = f"{self.root}/{self.n}"
        with settings(self.spark, {CLEANUP: "true"} | BATCH | (FEW if small else {})):
            df = df.coalesce((FEW_FILES if small else FILES) * self.spark.sparkContext.defaultParallelism)
            if self.direct:
                local = "/" + path.removeprefix("file:").lstrip("/")
                os.makedirs(local)
                with settings(self.spark, {} if f else {"spark.sql.execution.arrow.maxRecordsPerBatch": "10000"}):
                    df.mapInArrow(_written(local, f), "n long").agg(F.sum("n")).collect()
            else:
                df.write.option("compression", "zstd").option("parquet.block.size", str(ROW_GROUP)).options(**PLAIN).parquet(path)
        out = self.spark.read.schema(schema).parquet(path)
        out._stored_at = path
        return out

    def keep(self, df: DataFrame) -> DataFrame:
        """The same rows on the executors' disks; what is lost is made anew. For rows that come without a shuffle, so no shuffle files are held."""
        with settings(self.spark, BATCH | {"spark.sql.inMemoryColumnarStorage.batchSize": "500"}):
            df = df.persist(StorageLevel.DISK_ONLY)
            df.count()
        return df

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing lazy still reads."""
        for t in tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(t._stored_at)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def _written(folder: str, f: Callable | None = None):
    """A function for mapInArrow that writes a partition's rows, after f, as a file, which gets its name when it is whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        at = f"part-{task.partitionId():05}.parquet"
        part, writer, held, rows = f"{folder}/_{task.taskAttemptId()}-{at}", None, [], 0

        def flush() -> None:
            writer.write_table(pa.Table.from_batches(held))
            held.clear()

        for batch in f(batches) if f else batches:
            writer = writer or pq.ParquetWriter(part, batch.schema, compression="zstd")
            held.append(batch)
            rows += batch.num_rows
            if sum(x.nbytes for x in held) > ROW_GROUP // 2:
                flush()
        if writer:
            if held:
                flush()
            writer.close()
            os.replace(part, f"{folder}/{at}")
        release()
        yield pa.RecordBatch.from_arrays([pa.array([rows], pa.int64())], ["n"])

    return run


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, in whatever case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_key(*columns: str):
    """A 64-bit key of a row by its id and text, so that rows that share an id but not a text stay apart."""
    return F.xxhash64(*[F.col(f"`{c}`") for c in columns])
