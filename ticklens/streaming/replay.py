"""Replay a table as a file stream: rows are written in event-time chunks
(one append per chunk, so file modification times follow event time) of the
same number of files, and read back with that as `maxFilesPerTrigger`, giving
one bounded micro-batch per chunk."""
from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import epoch_micros_ntz
from ..session import checkpoint_dir

# Bounds of a micro-batch (a slice) and of a file, which is a task's when it is written and when it is read.
ROWS_PER_SLICE = 2_000_000
ROWS_PER_FILE = 100_000

Form = Callable[[DataFrame], DataFrame]


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the session's (shared) checkpoint directory."""
    return os.path.join(checkpoint_dir(spark), "ticklens", f"{name}-{uuid.uuid4().hex[:12]}")


def slice_sizes(rows: int, chunks: int = 3) -> tuple[int, int]:
    """Chunks and files of each, for a table of so many rows: at least `chunks` micro-batches, none of
    many more than `ROWS_PER_SLICE` rows (what its state and its tasks must hold), read by a task a file."""
    chunks = max(chunks, -(-rows // ROWS_PER_SLICE))
    return chunks, max(1, -(-rows // (chunks * ROWS_PER_FILE)))


def time_slices(df: DataFrame, ts_col: str, chunks: int = 3, staged: str | None = None) -> list[DataFrame]:
    """`df` as consecutive time slices (bounds from approx quantiles); rows without a time are in the last.

    Each slice filters `df`, or, with a folder `staged`, reads its own part of it: `df` is dealt out
    there in one pass, so many slices don't read it many times."""
    qs = [i / chunks for i in range(1, chunks)]
    col = F.col(ts_col)
    us = epoch_micros_ntz(col) if isinstance(df.schema[ts_col].dataType, T.TimestampNTZType) else F.unix_micros(col)
    edges = df.select(us.alias("_us")).stat.approxQuantile("_us", qs, 0.001)
    # the number of bounds that a row's time has reached; of equal bounds all are
    passed = sum((F.when(us >= F.lit(e), F.lit(1)).otherwise(F.lit(0)) for e in edges), F.lit(0))
    dealt = df.withColumn("_slice", F.when(us.isNull(), F.lit(len(edges))).otherwise(passed))
    if staged is not None:
        dealt.write.partitionBy("_slice").parquet(staged)
        dealt = df.sparkSession.read.schema(dealt.schema).parquet(staged)
    return [dealt.filter(F.col("_slice") == i).drop("_slice") for i in range(len(edges) + 1)]


def append_slices(slices: Sequence[DataFrame], dest: str, files: int = 1, form: Form | None = None) -> str:
    """So many files for each slice, in turn, written (and put into their `form`) by as many tasks.

    A stream that takes `files` files a trigger gets a slice in a micro-batch, so a slice of fewer
    rows than that has files without rows."""
    for part in slices:
        spark = part.sparkSession
        part = part.coalesce(1) if files == 1 else part.repartition(files)
        part = part if form is None else form(part)
        have = _files(spark, dest) if files > 1 else 0

        def write(rows: DataFrame) -> None:
            rows.write.mode("append").option("maxRecordsPerFile", 0).parquet(dest)

        write(part)
        if files > 1:
            for _ in range(have + files - _files(spark, dest)):
                write(spark.createDataFrame([], part.schema).coalesce(1))
    return dest


def _files(spark: SparkSession, dest: str) -> int:
    """Data files in a folder (none when it isn't there)."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(dest)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sum(f.getPath().getName().startswith("part-") for f in fs.listStatus(path)) if fs.exists(path) else 0


def write_chunks(df: DataFrame, ts_col: str, dest: str, chunks: int = 3) -> str:
    """Write `df` as `chunks` consecutive time slices, a file each."""
    return append_slices(time_slices(df, ts_col, chunks), dest)


def file_stream(spark: SparkSession, schema: T.StructType, src: str, files: int = 1) -> DataFrame:
    """What :func:`append_slices` wrote or will write there, a slice in each micro-batch."""
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", files)
            .option("maxCachedFiles", 0).parquet(src))


def replay(spark: SparkSession, df: DataFrame, ts_col: str, name: str, chunks: int = 3, form: Form | None = None) -> DataFrame:
    """Streaming DataFrame over `df`, put into a `form` (its messages) by the tasks that write it, one
    micro-batch per time chunk: at least `chunks`, more for a large table (:func:`slice_sizes`)."""
    chunks, files = slice_sizes(df.count(), chunks)
    staged = scratch(spark, name + "-slices") if files > 1 else None
    dest = append_slices(time_slices(df, ts_col, chunks, staged), scratch(spark, name + "-in"), files, form)
    return file_stream(spark, df.schema if form is None else form(df).schema, dest, files)


def run_once(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Run a streaming query in append mode over what there is now (availableNow) into parquet."""
    q = (stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))


def run_to_parquet(stream: DataFrame, spark: SparkSession, name: str, mode: str = "append",
                   keys: Sequence[str] = ()) -> DataFrame:
    """Run a streaming query to completion (availableNow) into parquet; read it back.  In update mode
    each batch brings the rows of the `keys` that changed; a key's last row counts."""
    out, ck = scratch(spark, name + "-out"), scratch(spark, name + "-ck")
    if mode == "append":
        run_once(stream, out, ck)
        return spark.read.parquet(out)
    if mode == "update" and not keys:
        raise ValueError("update mode needs the key columns")

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch}" if mode == "update" else out)

    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", ck).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    if mode == "update":
        last = Window.partitionBy(*keys).orderBy(F.desc("epoch"))
        rows = spark.read.parquet(out).withColumn("_n", F.row_number().over(last))
        return rows.filter("_n = 1").drop("_n", "epoch")
    return spark.read.parquet(out)
