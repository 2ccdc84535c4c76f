"""Stored quantile sketches beside the rollups: V4 and A8 for any timeframe without a second scan.

A value's KLL sketch of each hour is kept with its count.  Sketches merge: a later batch of the same
hour is merged into it (only that date's folder is replaced), and a timeframe's quantiles come from
merging the hours in it, some kilobytes each, however many rows they stand for.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import trunc_ntz
from ..functions.timeframe import window_start
from .snapshots import SnapshotTable, _key

#: Size of a sketch; the error of a rank is below RANK_ERROR (for 99 % of them, by the sketch's bound).
K = 1000
RANK_ERROR = 0.005
SKETCHES = T.StructType([T.StructField("hour", T.TimestampNTZType()), T.StructField("n", T.LongType()), T.StructField("total", T.DoubleType()),
                         T.StructField("squares", T.DoubleType()), T.StructField("sketch", T.BinaryType()), T.StructField("date", T.DateType())])


def sketch_table(spark: SparkSession, path: str) -> SnapshotTable:
    return SnapshotTable(spark, path, SKETCHES, ["date"])


def hour_sketches(df: DataFrame, value: str, time: str = "timestamp") -> DataFrame:
    """A sketch, count, sum and sum of squares of the finite values of each hour."""
    v = F.col(value).cast("double")
    return (df.filter(F.abs(v) < float("inf")).groupBy(trunc_ntz("hour", time).alias("hour"))
            .agg(F.count(F.lit(1)).alias("n"), F.sum(v).alias("total"), F.sum(v * v).alias("squares"), F.kll_sketch_agg_double(v, K).alias("sketch"))
            .withColumn("date", F.to_date("hour")).select(*SKETCHES.names))


def write_sketches(df: DataFrame, value: str, path: str, time: str = "timestamp", writer: str | None = None, batch: int | None = None) -> int:
    """Merge a batch's values into the sketches stored below ``path``; returns the table's version.  A
    writer's batch that is in the table already is skipped; NULL and non-finite values take no part."""
    spark = df.sparkSession
    table = sketch_table(spark, path)
    base = table.manifest()
    if table.has(writer, batch, base):
        return base.version
    new = hour_sketches(df, value, time).persist()
    try:
        touched = {_key(r, ["date"]) for r in new.select("date").distinct().collect()}
        both = table.read(base, touched.__contains__).unionByName(new)
        merged = both.groupBy("hour", "date").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("squares").alias("squares"),
                                                  F.kll_merge_agg_double("sketch", K).alias("sketch"))
        rows = merged.repartition("date").sortWithinPartitions("date", "hour")
        return table.write(rows, base=base, replace=True, keys=touched, writer=writer, batch=batch).version
    finally:
        new.unpersist()


def sketch_quantiles(spark: SparkSession, path: str, quantiles: Sequence[float], timeframe=None, as_of=None) -> DataFrame:
    """One row: n, mean, stddev and q_<percent> for each quantile of the hours from the one in which
    the timeframe begins; NULLs without values.

    A quantile is a value of the data whose rank is off by at most RANK_ERROR (see K).
    """
    start = window_start(as_of, timeframe)
    rows = sketch_table(spark, path).read()
    if start is not None:
        rows = rows.filter((F.col("date") >= start.cast("date")) & (F.col("hour") >= trunc_ntz("hour", start)))
    one = rows.agg(F.sum("n").alias("n"), F.sum("total").alias("t"), F.sum("squares").alias("s"), F.kll_merge_agg_double("sketch", K).alias("k"))
    some = F.col("n") > 0
    spread = F.try_divide(F.col("s") - F.col("t") * F.col("t") / F.col("n"), F.col("n") - 1)
    found = [F.when(some, F.kll_sketch_get_quantile_double("k", F.lit(float(q)))).alias(f"q_{100 * q:g}") for q in quantiles]
    return one.select(F.coalesce("n", F.lit(0)).alias("n"), F.when(some, F.col("t") / F.col("n")).alias("mean"),
                      F.when(F.col("n") > 1, F.sqrt(F.greatest(spread, F.lit(0.0)))).alias("stddev"), *found)
