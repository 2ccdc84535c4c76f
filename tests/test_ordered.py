"""The blocked ordered window equals a plain global window, also under heavy
timestamp ties and a hot partition key; exact quantiles equal numpy's."""
import datetime as dt

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ticklens.plans.ordered import INDEX_COL, exact_quantiles, global_index, ordered_window
from ticklens.schema import TRADES


def _skewed(spark, n=3000, seed=7):
    rng = np.random.default_rng(seed)
    base = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(n):
        # a third of all rows share ONE timestamp; the rest spread over a day
        sec = 3600 if i % 3 == 0 else int(rng.integers(0, 86400))
        price = None if i % 97 == 0 else (0.0 if i % 89 == 0 else float(rng.uniform(1, 100)))
        ex = "hot" if i % 3 != 1 else ["a", "b", "c"][i % 7 % 3]
        rows.append((int(rng.permutation([i])[0]) * 10 + 1, base + dt.timedelta(seconds=sec), price, 1.0, "buy", ex,
                     "BTC-USD"))
    return spark.createDataFrame(rows, TRADES)


@pytest.mark.parametrize("rows_per_bucket", [30, 100, 700, None])
def test_global_window_equivalence(spark, rows_per_bucket):
    df = _skewed(spark)
    build = lambda w: {
        "prev": F.lag("price").over(w),
        "ma": F.avg("price").over(w.rowsBetween(-19, 0)),
        "sd": F.stddev_samp("price").over(w.rowsBetween(-19, 0)),
        "cnt": F.count(F.lit(1)).over(w.rowsBetween(-10, -1)),
    }
    got = ordered_window(df, ["timestamp", "id"], build, halo=19,
                         rows_per_bucket=rows_per_bucket)
    g = Window.orderBy("timestamp", "id")
    exp = df.select("id", *[c.alias(k + "_e") for k, c in build(g).items()])
    j = got.join(exp, "id", "full")
    assert j.count() == df.count() == got.count()
    bad = j.filter(~F.col("prev").eqNullSafe(F.col("prev_e")) | ~F.col("cnt").eqNullSafe(F.col("cnt_e"))
                   | (F.abs(F.col("ma") - F.col("ma_e")) > 1e-9)
                   | ~(F.col("sd").isNull() == F.col("sd_e").isNull())
                   | (F.abs(F.col("sd") - F.col("sd_e")) > 1e-9))
    assert bad.count() == 0


def test_partitioned_equivalence_with_hot_key(spark):
    df = _skewed(spark)
    got = ordered_window(df, ["timestamp", "id"], lambda w: {"prev": F.lag("price").over(w),
                                                             "ma": F.avg("price").over(w.rowsBetween(-5, 0))},
                         halo=5, partition_by=["exchange"], rows_per_bucket=80)
    w = Window.partitionBy("exchange").orderBy("timestamp", "id")
    exp = df.select("id", F.lag("price").over(w).alias("p2"), F.avg("price").over(w.rowsBetween(-5, 0)).alias("m2"))
    j = got.join(exp, "id")
    assert j.count() == df.count()
    assert j.filter(~F.col("prev").eqNullSafe(F.col("p2")) | (F.abs(F.col("ma") - F.col("m2")) > 1e-9)).count() == 0


def test_global_index_dense_and_ordered(spark):
    df = _skewed(spark)
    idx = global_index(df, ["timestamp", "id"], rows_per_bucket=150)
    n = df.count()
    stats = idx.agg(F.min(INDEX_COL), F.max(INDEX_COL), F.countDistinct(INDEX_COL)).first()
    assert tuple(stats) == (0, n - 1, n)
    exp = df.select("id", (F.row_number().over(Window.orderBy("timestamp", "id")) - 1).alias("e"))
    assert idx.join(exp, "id").filter(F.col(INDEX_COL) != F.col("e")).count() == 0


@pytest.mark.parametrize("q", [0.0, 0.05, 0.5, 0.95, 1.0])
def test_exact_quantiles(spark, q):
    df = _skewed(spark)            # a third of the rows share one timestamp; some prices repeat
    got, n = exact_quantiles(df, "price", "id", {"v": q}, rows_per_bucket=200)
    vals = np.array([r.price for r in df.filter(F.col("price").isNotNull()).select("price").collect()])
    assert n == len(vals)
    assert got["v"] == pytest.approx(float(np.percentile(vals, q * 100, method="linear")), rel=1e-12)


def test_exact_quantiles_hot_value(spark):
    # one value holds a third of all rows: buckets still split it (ties by id)
    rows = [(i, 7.0 if i % 3 == 0 else float(i)) for i in range(900)]
    df = spark.createDataFrame(rows, "id long, price double")
    got, n = exact_quantiles(df, "price", "id", {"a": 0.1, "b": 0.5, "c": 0.9}, rows_per_bucket=50)
    vals = np.array([p for _, p in rows])
    for k, q in {"a": 0.1, "b": 0.5, "c": 0.9}.items():
        assert got[k] == pytest.approx(float(np.percentile(vals, q * 100, method="linear")))


def test_empty_input(spark):
    df = spark.createDataFrame([], TRADES)
    got = ordered_window(df, ["timestamp", "id"], lambda w: {"prev": F.lag("price").over(w)}, halo=1)
    assert got.count() == 0


@pytest.mark.parametrize("kind", ["double", "decimal(18,8)", "date"])
def test_rank_by_spark_order_of_null_nan_infinity_and_decimals(spark, kind):
    from ticklens.operators import windows
    rng = np.random.default_rng(3)
    rows = [(i, [None, float("nan"), float("inf"), float("-inf"), 0.0, -0.0, float(rng.normal())][i % 7 if i % 2 else 6]) for i in range(4000)]
    df = spark.createDataFrame(rows, "id long, p double")
    price = {"double": F.col("p"), "decimal(18,8)": F.col("p").try_cast("decimal(18,8)") + F.lit(0.00000001).cast("decimal(18,8)") * (F.col("id") % 3).cast("decimal(1,0)"),
             "date": F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 5).cast("int"))}[kind]
    if kind == "decimal(18,8)":
        df = df.filter(~F.isnan("p") & (F.abs("p") < 10) | F.col("p").isNull())
    df = df.select("id", price.alias("price"))
    got = windows.price_rank(df, rows_per_bucket=150)
    exp = df.select("id", F.row_number().over(Window.orderBy(F.col("price").asc_nulls_last(), "id")).alias("e"))
    assert got.join(exp, "id").filter(F.col("rank") != F.col("e")).count() == 0 and got.count() == df.count()


def test_rows_are_shuffled_once_evenly_and_come_out_in_order(spark):
    from ticklens.operators import windows
    df = _skewed(spark)
    out = windows.moving_averages(df, (5, 20), rows_per_bucket=50)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.replace("BroadcastExchange", "").count("Exchange") == 1 and "shufflepartitionidpassthrough" in plan and "Python" not in plan
    assert "lambda" not in plan  # the range search is plain projections
    got = [(r.timestamp, r.id) for r in out.collect()]
    assert got == sorted(got)
    sizes = [r[1] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) >= 40 and max(sizes) <= 2 * sum(sizes) / len(sizes)


@pytest.mark.parametrize("with_nulls", [False, True])
def test_rolling_volatility_both_paths_equal_global_window(spark, with_nulls):
    from ticklens.operators import windows
    df = _skewed(spark)
    if not with_nulls:
        df = df.fillna({"price": 1.5})
    got = windows.rolling_volatility(df, 20, rows_per_bucket=120)
    g = Window.orderBy("timestamp", "id")
    ch = (df.select("*", F.lag("price").over(g).alias("prev")).filter(F.col("prev").isNotNull())
          .withColumn("pct", F.try_divide(F.col("price") - F.col("prev"), F.col("prev")) * 100))
    exp = (ch.select("id", F.stddev_samp("pct").over(g.rowsBetween(-19, 0)).alias("rv"),
                     F.avg(F.abs("pct")).over(g.rowsBetween(-19, 0)).alias("ra"))
           .filter(F.col("rv").isNotNull()))
    j = got.join(exp, "id", "full")
    assert got.count() == exp.count() == j.count()
    assert j.filter((F.abs(F.col("rolling_volatility") - F.col("rv")) > 1e-9)
                    | (F.abs(F.col("rolling_avg_change") - F.col("ra")) > 1e-9)).count() == 0


def test_many_buckets_and_blocks_on_events(spark):
    """sf0.01 events with ~500 buckets (numpy search path, > 255 split points)
    and ~200 blocks equal the global window."""
    from ticklens.sources.tables import load_trades
    t = load_trades(spark, "/root/testdata/sf0.01")
    got = ordered_window(t, ["timestamp", "id"], lambda w: {
        "prev": F.lag("price").over(w), "ma": F.avg("price").over(w.rowsBetween(-49, 0))},
        halo=49, rows_per_bucket=20)
    g = Window.orderBy("timestamp", "id")
    exp = t.select("id", F.lag("price").over(g).alias("p2"), F.avg("price").over(g.rowsBetween(-49, 0)).alias("m2"))
    j = got.join(exp, "id")
    assert j.count() == t.count() == 10_000
    assert j.filter(~F.col("prev").eqNullSafe(F.col("p2")) | (F.abs(F.col("ma") - F.col("m2")) > 1e-9)).count() == 0
