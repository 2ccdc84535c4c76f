"""Order-dependent windows without moving all rows into one task.

The reference evaluates LAG / moving frames with ``OVER (ORDER BY timestamp)``
and no PARTITION BY.  In Spark such a window puts every row into a single
partition.  Here the same result comes from ONE shuffle of the rows:

1. **Split points.**  The sort keys with the least key hashes, a sample of some
   keys for each range that is the same in every run, are sorted by Spark's own
   comparator (NULLs last, NaN above infinity, decimals exact) and picked at
   even ranks; only the picks reach the driver.  The tie-breaking keys are part
   of them, so a hot timestamp is still split.
2. **Counts.**  One narrow aggregate counts the rows between split points.  The
   driver, which holds one number for each, joins neighbours to buckets of even
   size that are never shorter than the look-back.  A row finds its range by a
   binary search unrolled into projections, so it costs some array reads and
   comparisons in generated code, whatever the number of ranges.
3. **One shuffle.**  Bucket k goes to partition k (`repartitionById`); the rows of
   its last ranges, together at least the look-back, go to bucket k + 1 as well.
   The window runs inside the bucket, after those copies, and they are dropped.
   A frame that looks back at most that far sees exactly the rows that a global
   window would see.  The rows come out in order, so no sort follows.

The same counts give exact order statistics (:func:`exact_quantiles`): only the
range that holds a wanted rank is ranked.
"""
from __future__ import annotations

import bisect
import itertools
import math
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

INDEX_COL = "_i"
RANGE_COL = "_range"
BUCKET_COL = "_bucket"
HALO_COL = "_halo"

# Tuning defaults (rows, not bytes: rows here are narrow trade records).
ROWS_PER_BUCKET = 2_000_000
MIN_ROWS_PER_BUCKET = 128        # never split data into buckets smaller than this
RANGES_PER_BUCKET = 8
KEYS_PER_RANGE = 16              # sampled to place a split point
# Split points that the driver may hold; beyond a sixteenth of it times
# ROWS_PER_BUCKET rows (10^11) buckets grow with the data.
MAX_RANGES = 400_000


def parallelism(spark) -> int:
    """Task slots of the cluster (not the shuffle-partition setting)."""
    return max(1, int(spark.sparkContext.defaultParallelism))


def _order_columns(order_by: Sequence[str]) -> list[Column]:
    return [F.col(c).asc_nulls_last() for c in order_by]


def _key_columns(pcols: Sequence[str], order_by: Sequence[str]) -> list[Column]:
    """The columns of the total order: hash and values of the partition columns, then the order columns."""
    return [*([F.xxhash64(*pcols)] if pcols else []), *[F.col(c) for c in (*pcols, *order_by)]]


def _sort_key(columns: Sequence[Column]) -> Column:
    """The total order as one struct: for each column whether it is NULL and its value.  Structs
    compare as ORDER BY does, but for NULLs."""
    return F.struct(*[c for j, k in enumerate(columns) for c in (k.isNull().alias(f"_n{j}"), k.alias(f"_k{j}"))])


def split_points(keys: DataFrame, n: int, ranges: int) -> DataFrame:
    """One row of arrays ``_k0``, ``_k1``, ...: the key columns of at most ``ranges - 1`` split points."""
    names = [f"_k{j}" for j in range(len(keys.columns))]
    key = _sort_key([F.col(c) for c in names])
    keys = keys.toDF(*names).select(key.alias("key"))
    wanted = ranges * KEYS_PER_RANGE
    if wanted < n:
        parts = 1 << 40
        keys = keys.filter(F.pmod(F.xxhash64("key"), F.lit(parts)) < math.ceil(parts * wanted / n))
    sample = keys.agg(F.sort_array(F.collect_set("key")).alias("s"))  # a set: a repeated key counts once
    places = F.transform(F.sequence(F.lit(1), F.lit(max(1, ranges - 1))), lambda j: F.floor(j * F.size("s") / ranges).cast("int"))
    picked = sample.select(F.transform(F.array_distinct(places), lambda j: F.get("s", j)).alias("p"))
    picked = picked.select(F.array_compact("p").alias("p"))
    return picked.select(*[F.col(f"p.{c}").alias(c) for c in names])


def _with_range(df: DataFrame, points: DataFrame, n_points: int, columns: Sequence[Column]) -> DataFrame:
    """Add ``_range``, the number of split points <= the row's key.

    A binary search, one step for each projection: a step's range is read more than once by the
    next, so the optimizer keeps the steps apart and generated code runs them in turn.  The arrays
    come with one broadcast row.
    """
    if not n_points:
        return df.withColumn(RANGE_COL, F.lit(0))
    own = [f"_c{j}" for j in range(len(columns))]
    out = df.select("*", *[c.alias(name) for c, name in zip(columns, own)]).join(F.broadcast(points))

    def at_or_after(place: Column, j: int = 0) -> Column:
        bound, value = F.get(f"_k{j}", place), F.col(own[j])
        after = bound.isNotNull() & (value.isNull() | (value > bound))
        same = value.eqNullSafe(bound)
        return after | (same & at_or_after(place, j + 1) if j + 1 < len(own) else same)

    out = out.withColumn(RANGE_COL, F.lit(0))
    step = 1 << (n_points.bit_length() - 1)
    while step:
        here = F.col(RANGE_COL)
        out = out.withColumn(RANGE_COL, F.when((here + step <= n_points) & at_or_after(here + (step - 1)), here + step).otherwise(here))
        step >>= 1
    # out of a generator: a later filter on the range would else be pushed down, with all steps written out in it
    return out.select(*df.columns, F.explode(F.array(RANGE_COL)).alias(RANGE_COL))


def assign_ranges(df: DataFrame, order_by: Sequence[str], *, partition_by: Sequence[str] | None = None,
                  rows_per_bucket: int | None = None, n: int | None = None) -> tuple[DataFrame, list[int], int]:
    """Tag rows with ``_range``, contiguous ranges of the (partition, order_by) total order; returns
    the tagged frame, the rows in each range and how many buckets they should make (runs up to three
    jobs over the key columns now: the number of rows, unless it is given, split points and counts)."""
    columns = _key_columns(list(partition_by or []), order_by)
    n = df.count() if n is None else n
    per = rows_per_bucket or ROWS_PER_BUCKET
    buckets = max(min(parallelism(df.sparkSession), math.ceil(n / min(MIN_ROWS_PER_BUCKET, per))), math.ceil(n / per))
    if buckets <= 1:
        return df.withColumn(RANGE_COL, F.lit(0)), [n], 1
    ranges = min(buckets * RANGES_PER_BUCKET, n, MAX_RANGES)
    found = split_points(df.select(*columns), n, ranges)
    row = found.first()
    points = df.sparkSession.createDataFrame([row], found.schema)
    tagged = _with_range(df, points, len(row[0]), columns)
    counts = {r[0]: r[1] for r in tagged.groupBy(RANGE_COL).count().collect()}
    return tagged, [counts.get(k, 0) for k in range(len(row[0]) + 1)], buckets


def make_buckets(counts: Sequence[int], buckets: int, halo: int) -> tuple[list[int], list[bool], list[int], list[int]]:
    """Join ranges to about ``buckets`` buckets of at least ``halo`` rows.

    Returns each range's bucket, whether its rows go to the next bucket too, and each bucket's first
    position and how many copies it gets.
    """
    target, total = max(1, math.ceil(sum(counts) / max(1, buckets))), sum(counts)
    own, sizes, held, left = [], [], 0, total
    for c in counts:
        own.append(len(sizes))
        held, left = held + c, left - c
        if held >= max(target, halo, 1) and left >= max(halo, 1):  # what is left must make a bucket too
            sizes.append(held)
            held = 0
    sizes.append(held)
    copied, copies = [False] * len(counts), [0] * len(sizes)
    for k in range(len(counts) - 1, -1, -1):
        after = own[k] + 1
        if halo and after < len(sizes) and copies[after] < halo:
            copied[k] = True
            copies[after] += counts[k]
    return own, copied, _starts(sizes), copies


def _starts(sizes: Sequence[int]) -> list[int]:
    """Where each of consecutive runs begins."""
    return [0, *itertools.accumulate(sizes)][: len(sizes)]


def _longs(values: Sequence[int]) -> Column:
    """A constant array, folded by the optimizer."""
    return F.split(F.lit(",".join(str(int(v)) for v in values)), ",").cast("array<bigint>")


def ordered_window(df: DataFrame, order_by: Sequence[str],
                   build: Callable[[WindowSpec], dict[str, Column]], *,
                   halo: int,
                   partition_by: Sequence[str] | None = None,
                   rows_per_bucket: int | None = None,
                   keep_index: bool = False,
                   n: int | None = None) -> DataFrame:
    """Evaluate row-frame window columns over a global (per key) order.

    ``build(w)`` returns ``{name: expression}`` (or a list of such dicts,
    applied in order) where ``w`` is a WindowSpec ordered by the total order;
    frames may reach at most ``halo`` rows back and none forward — counting
    the look-back of earlier stages that later stages depend on.  Equivalent to
    ``Window.partitionBy(*partition_by).orderBy(*order_by)`` but spread over
    buckets; without ``partition_by`` the rows come out in order, and ``_i``,
    the position in it, may be used by ``build``.  ``order_by`` must be a total
    order (end it with a unique column).
    """
    if halo < 0:
        raise ValueError("halo must be >= 0")
    pcols = list(partition_by or [])
    tagged, counts, buckets = assign_ranges(df, order_by, partition_by=pcols, rows_per_bucket=rows_per_bucket, n=n)
    own, copied, starts, copies = make_buckets(counts, buckets, halo)
    bucket = F.get(_longs(own), F.col(RANGE_COL)).cast("int")
    goes_on = F.get(_longs(copied), F.col(RANGE_COL)) == 1
    targets = F.when(goes_on, F.array(bucket, bucket + 1)).otherwise(F.array(bucket)) if any(copied) else F.array(bucket)
    spread = (tagged.select("*", F.explode(targets).alias(BUCKET_COL))
              .withColumn(HALO_COL, F.col(BUCKET_COL) != bucket))
    placed = spread.repartitionById(len(starts), F.col(BUCKET_COL)) if len(starts) > 1 else spread.coalesce(1)
    w = Window.partitionBy(*pcols, BUCKET_COL).orderBy(F.col(HALO_COL).desc(), *_order_columns(order_by))
    number = F.row_number().over(w)
    if not pcols:
        first = F.get(_longs([a - b for a, b in zip(starts, copies)]), F.col(BUCKET_COL))
        out = placed.withColumn(INDEX_COL, (first + number - 1).cast("long"))
    elif keep_index:
        # rows of the same key in earlier buckets: of each bucket, only its first key can have any
        per_key = tagged.withColumn(BUCKET_COL, bucket).groupBy(*pcols, BUCKET_COL).agg(F.count(F.lit(1)).alias("_n"))
        earlier = Window.partitionBy(*pcols).orderBy(BUCKET_COL).rowsBetween(Window.unboundedPreceding, -1)
        off = per_key.select(*[F.col(c).alias(f"_p_{c}") for c in pcols], F.col(BUCKET_COL).alias("_b"), F.sum("_n").over(earlier).alias("_off")).filter("_off > 0")
        same = [F.col(c).eqNullSafe(F.col(f"_p_{c}")) for c in pcols]
        copies_here = F.sum(F.col(HALO_COL).cast("long")).over(Window.partitionBy(*pcols, BUCKET_COL))
        numbered = placed.withColumn("_rn", number).withColumn("_copies", copies_here)
        cond = F.col(BUCKET_COL) == F.col("_b")
        for c in same:
            cond = cond & c
        out = (numbered.join(F.broadcast(off), cond, "left")  # at most a row for each bucket
               .withColumn(INDEX_COL, F.coalesce(F.col("_off"), F.lit(0)) + F.col("_rn") - 1 - F.col("_copies"))
               .drop("_rn", "_copies", "_off", "_b", *[f"_p_{c}" for c in pcols]))
    else:
        out = placed
    stages = build(w)
    # a list of dicts is applied stage by stage (later stages may use earlier
    # columns, e.g. LAG then a frame over the derived change); consecutive
    # windows share the partitioning and sort, so no extra shuffle
    for cols in (stages if isinstance(stages, list) else [stages]):
        out = out.select("*", *[c.alias(name) for name, c in cols.items()])
    out = out.filter(~F.col(HALO_COL)).drop(BUCKET_COL, HALO_COL, RANGE_COL)
    return out if keep_index else out.drop(INDEX_COL)


def global_index(df: DataFrame, order_by: Sequence[str], *, partition_by: Sequence[str] | None = None,
                 rows_per_bucket: int | None = None) -> DataFrame:
    """Add ``_i``: 0-based position of each row in ``order_by`` order (restarting for every key)."""
    return ordered_window(df, order_by, lambda w: {}, halo=0, partition_by=partition_by,
                          rows_per_bucket=rows_per_bucket, keep_index=True)


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage before a second ordered pass: the intermediate is written
    once to the session's checkpoint folder (shared storage on a cluster) and
    the following count / sample / window jobs read it instead of recomputing
    the first pass's shuffles.  Reliable: survives executor loss."""
    from ..session import ensure_checkpoint_dir
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def values_at_ranks(df: DataFrame, value: str, tie: str, ranks: Callable[[int], Iterable[int]],
                    rows_per_bucket: int | None = None, n: int | None = None) -> tuple[dict[int, object], int]:
    """The values at some 0-based ranks (a function of the number of rows) of ``value`` in ascending
    order, NULLs left out, without sorting the data: the ranges of the (value, tie) order are counted,
    the driver finds those holding the wanted ranks, and only their rows are ranked.  Returns
    ({rank: value}, number of rows)."""
    vals = df.filter(F.col(value).isNotNull()).select(value, tie)
    tagged, counts, _ = assign_ranges(vals, [value, tie], rows_per_bucket=rows_per_bucket, n=n)
    n, starts = sum(counts), _starts(counts)
    wanted: dict[int, set[int]] = {}
    for rank in ranks(n) if n else ():
        k = bisect.bisect_right(starts, rank) - 1  # of ranges that begin there, the last, which has rows
        wanted.setdefault(k, set()).add(rank - starts[k])
    if not wanted:
        return {}, n
    rn = F.row_number().over(Window.partitionBy(RANGE_COL).orderBy(*_order_columns([value, tie]))) - 1
    cond = F.lit(False)
    for k, places in wanted.items():
        cond = cond | ((F.col(RANGE_COL) == k) & F.col("_rn").isin(*sorted(places)))
    picked = (tagged.filter(F.col(RANGE_COL).isin(*wanted))
              .withColumn("_rn", rn).filter(cond).select(RANGE_COL, "_rn", value).collect())
    return {starts[r[0]] + r[1]: r[2] for r in picked}, n


def exact_quantiles(df: DataFrame, value: str, tie: str, quantiles: dict[str, float],
                    rows_per_bucket: int | None = None, n: int | None = None) -> tuple[dict[str, float | None], int]:
    """PERCENTILE_CONT values of ``value`` (NULLs ignored), exact (see :func:`values_at_ranks`).
    ``n`` is the number of values if it is known.  Returns ({name: value}, n)."""
    def ranks(n: int) -> set[int]:
        return {r for q in quantiles.values() for r in (math.floor(q * (n - 1)), math.ceil(q * (n - 1)))}

    numbers = df.select(F.col(value).cast("double").alias(value), tie)
    at, n = values_at_ranks(numbers, value, tie, ranks, rows_per_bucket, n)
    out: dict[str, float | None] = {}
    for name, q in quantiles.items():
        pos = q * (n - 1)
        lo, hi = math.floor(pos), math.ceil(pos)
        out[name] = at[lo] + (at[hi] - at[lo]) * (pos - lo) if n else None
    return out, n
