"""Small helpers that several operators share: inputs, shared-folder tables, batches."""
from __future__ import annotations

import ctypes
import functools
import itertools
import uuid
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticklens.session import ensure_checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, whole."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the folder that driver and executors share (``spark.checkpoint.dir``)."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, so a lost executor
    costs a reread of files and never a second run of what made them."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of a batch that goes to a Python worker, about.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the batches between executors and Python workers by bytes, unless the session does it: ten
    thousand texts are tens of MB, which each task would hold in the executor and again in its worker."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(BATCH_BYTES))


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id`` as long, ``text`` with null as empty, and the columns in ``more``."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more)


def give_back() -> None:
    """Return this worker's free memory to the system: allocators keep it, and workers live on from task
    to task and from stage to stage."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim is not None:
        trim(0)


def tidy(run: Callable[[Iterable], Iterator]) -> Callable[[Iterable], Iterator]:
    """A task's generator that begins and ends with no memory kept for nothing."""
    @functools.wraps(run)
    def tidied(batches):
        give_back()
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def strings(column: pa.Array) -> Iterator[str]:
    """The texts of an Arrow column one after the other, null as empty; no other copy of them is made."""
    for x in column:
        yield x.as_py() or ""


def slices(frames: Iterable[pd.DataFrame], most: int = 8 << 20, column: str = "text") -> Iterator[pd.DataFrame]:
    """The same rows in pieces of about ``most`` characters, so that a task's memory follows the
    longest text and not the number of rows in a batch."""
    for frame in frames:
        if not len(frame):
            continue
        cuts = (frame[column].str.len().cumsum() // most).to_numpy()
        edges = [0, *(i for i in range(1, len(cuts)) if cuts[i] != cuts[i - 1]), len(cuts)]
        for a, b in itertools.pairwise(edges):
            yield frame.iloc[a:b]


#: A key with at least this share of the rows is hot: there are no more of them than its inverse.
HOT_SHARE = 0.001


def join_by_counts(rows: DataFrame, table: DataFrame, key: str, count: str) -> DataFrame:
    """Inner join of ``rows`` with a stored ``table`` that has one row for each key (null is one too)
    and how many rows the key has in ``count``.  The few hot keys are broadcast and their rows aren't
    moved; all others are joined by key."""
    least = (table.agg(F.sum(count)).first()[0] or 0) * HOT_SHARE
    named = table.withColumnRenamed(key, "_llm_key")
    hot, same = F.broadcast(named.filter(F.col(count) >= least)), F.col(key).eqNullSafe(F.col("_llm_key"))
    here = rows.join(hot, same)
    rest = rows.join(hot, same, "left_anti").join(named.filter(F.col(count) < least), same)
    return here.unionByName(rest).drop("_llm_key")
