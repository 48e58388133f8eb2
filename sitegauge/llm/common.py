"""Helpers of the training-data operators: shared folder, gapless numbering, Arrow batches."""

from __future__ import annotations

import ctypes
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters that one numpy step works on at most, unless a single text is longer.
SLICE_CHARS = 250_000

#: Bytes of an Arrow batch where the session leaves Spark's default, which gives a worker and its executor 10,000 texts at once.
BATCH_BYTES = "2m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir`` of the session.

    A temporary folder is set only where that is unset and Spark runs in this one process, as in
    tests; on a cluster it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoints-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """The rows as a reliable checkpoint in the shared folder, without the plan that made them."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table in the shared folder, read back.

    For loops: unlike a checkpoint, a file carries no constraints of the plan that made it. Those
    of equi-joins multiply from round to round and fill the driver.
    """
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.written_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables made by :func:`written`, once nothing refers to them any more."""
    for df in tables:
        remove(df.sparkSession, df.written_path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the frame does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table that this job wrote to the shared folder and no longer needs."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


def numbered(df: DataFrame, name: str, group: list[str], bucket_of: Column, order: list[Column]) -> DataFrame:
    """Adds ``name``: 0, 1, 2, ... without gaps in each group, with no group in a single task.

    ``bucket_of``, never null, deals a group to a fixed number of buckets; rows are numbered in
    their bucket, and the counts of the buckets before it in the group are added. ``order`` should
    settle ties; rows that tie in all of it are interchangeable.
    """
    bucket = f"__{name}_bucket"
    dealt = df.withColumn(bucket, F.coalesce(bucket_of.cast("int"), F.lit(0)))
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy(*group, bucket).agg(F.count("*").alias("__n"))
    starts = counts.select(*group, bucket, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy(*group, bucket).orderBy(*order)
    ranked = dealt.withColumn(name, F.row_number().over(inside).cast("long") - 1)
    return (
        ranked.join(starts, [*group, bucket])
        .withColumn(name, F.col(name) + F.col("__start"))
        .drop(bucket, "__start")
    )


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the texts of ``column`` in each have at most ``most`` bytes, or one row."""
    for batch in batches:
        array = batch.column(column)
        sizes = pc.fill_null(pc.binary_length(array), 0).to_pylist()
        start = held = 0
        for i, n in enumerate(sizes):
            if held and held + n > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < batch.num_rows:
            yield batch.slice(start)


def in_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """Rows of ``run`` on the Arrow batches of each task, which hold about ``BATCH_BYTES`` or what the session sets."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(name) == "67108864b":
        conf.set(name, BATCH_BYTES)
    return df.mapInArrow(run, schema)


def release() -> None:
    """Hand freed memory back to the system at the end of a task: the worker stays beside those of the next stage."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def by_slices(df: DataFrame, column: str, work: Callable[[pa.RecordBatch], pa.RecordBatch], schema: T.StructType | str) -> DataFrame:
    """Rows of ``work`` on every slice of the rows, in Arrow batches inside the tasks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, column):
            yield work(batch)
        release()

    return in_batches(df, run, schema)


def texts_of(batch: pa.RecordBatch, column: str) -> list[str]:
    """Texts of a batch, null as empty."""
    return [x or "" for x in batch.column(column).to_pylist()]
