"""Approximate nearest neighbours by cross-polytope hashing.

A pseudo-rotation (three rounds of random signs and a fast Hadamard transform) turns a unit vector,
and the hash is the signed axis nearest to it; ``hashes`` of them make a bucket.  Queries probe in
each table the buckets of their best signed axes.  Candidates are ranked by exact distance.

Equal vectors are one class, so copies cost one row; a class keeps as many ids as an answer can use.
A bucket's vectors are dealt to tasks in lots and its queries in parts, and a query that its buckets
gave too few neighbours meets all vectors in blocks, so no bucket is cut short.
"""
from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Vectors up to which one hash makes a bucket; beyond, two.
ONE_HASH = 1 << 18
#: (tables, probes in each) for one and for two hashes.
TABLES = {1: (12, 9), 2: (18, 320)}
#: Vectors of a bucket in a lot, and of all vectors in a block, about; queries that meet them in one task.
LOT, ASKED = 8192, 4096
SEED = 20_240_607


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row (a power of two wide), orthonormal."""
    n, h = x.shape[1], 1
    while h < n:
        x = x.reshape(len(x), -1, 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x / n**0.5


@lru_cache(maxsize=4096)
def signs(dim: int, table: int, part: int) -> np.ndarray:
    return np.random.default_rng([SEED, dim, table, part]).choice([-1.0, 1.0], (3, dim))


def rotate(x: np.ndarray, table: int, part: int) -> np.ndarray:
    dim = 1 << max(0, (x.shape[1] - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, dim - x.shape[1])))
    for s in signs(dim, table, part):
        x = hadamard(x * s)
    return x


def buckets(units: np.ndarray, table: int, hashes: int, probes: int) -> np.ndarray:
    """The ``probes`` best buckets of each unit vector, best first (fewer where there are fewer)."""
    best = np.zeros((len(units), 1), np.int64)
    loss = np.zeros((len(units), 1))
    for part in range(hashes):
        y = rotate(units, table, part)
        most = min(probes, y.shape[1])
        axis = np.argsort(-np.abs(y), axis=1, kind="stable")[:, :most]
        value = np.take_along_axis(y, axis, 1)
        size = np.abs(value)
        code = 2 * axis + (value < 0)
        gap = (size[:, :1] - size) ** 2
        loss = (loss[:, :, None] + gap[:, None, :]).reshape(len(units), -1)
        best = (best[:, :, None] * (2 * y.shape[1]) + code[:, None, :]).reshape(len(units), -1)
        order = np.argsort(loss, axis=1, kind="stable")[:, :probes]
        best, loss = np.take_along_axis(best, order, 1), np.take_along_axis(loss, order, 1)
    return best


def hashed(tables: int, hashes: int, probes: int):
    """A column function: (table, bucket) of each vector; every table's ``probes`` best."""
    @F.pandas_udf("array<struct<table: int, bucket: long>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for vectors in batches:
            out: list = [None] * len(vectors)
            dims = vectors.map(len).to_numpy()
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                x = np.stack(vectors.iloc[at].to_list()).astype(float)
                x /= np.abs(x).max(axis=1, keepdims=True)  # first, so that the norm neither overflows nor vanishes
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                found = [buckets(x, t, hashes, probes) for t in range(tables)]
                for row, k in enumerate(at):
                    out[k] = [{"table": t, "bucket": int(b)} for t in range(tables) for b in found[t][row]]
            yield pd.Series(out, index=vectors.index)

    return run


def valid(vector: Column) -> Column:
    """Neither null nor zero, and no component null or not finite."""
    odd = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(odd, F.lit(True)) & F.exists(vector, lambda v: v != 0)


def nearest_in(k: int):
    """For a group of rows, the nearest ``k`` (id by id) of its vectors to each of its queries."""
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        parts = []
        dims = frame["vector"].map(len)
        for _, own in frame.groupby(dims):
            asked = own["ids"].map(len).to_numpy() == 0
            if not asked.any() or asked.all():
                continue
            queries, rows = own[asked].drop_duplicates("class"), own[~asked]
            x = np.stack(rows["vector"].to_list()).astype(float)
            first = rows["class"].to_numpy()
            ids = rows["ids"].to_list()
            for name, vector in zip(queries["class"], queries["vector"], strict=True):
                d = np.sqrt(((x - np.asarray(vector, float)) ** 2).sum(axis=1))
                bound = np.partition(d, k - 1)[k - 1] if len(d) > k else np.inf
                near = np.flatnonzero(d <= bound)  # classes tied with the last are all looked at
                found = sorted((d[i], v) for i in near[np.lexsort((first[near], d[near]))][: k] for v in ids[i])[:k]
                parts += [(name, v, s) for s, v in found]
        return pd.DataFrame(parts, columns=["class", "vec_id", "score"])

    return run


def nearest(vectors: DataFrame, every: int = 100, k: int = 10, plan: tuple[int, int, int] | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of each query's ``k`` nearest other rows.

    Queries are the rows whose vec_id is divisible by ``every``; nearness is the Euclidean distance
    of the original vectors, ties go to the smaller vec_id.  Vectors that are null, zero or hold a
    component that is null or not finite, and rows without a vec_id, take no part; vectors of
    another length are no candidates.  A repeated vec_id counts once for each distinct vector, and
    never as a neighbour of itself.  A query has fewer rows only if there are fewer candidates.
    ``plan`` sets (hashes, tables, probes) instead of the choice by the number of vectors.
    """
    spark = vectors.sparkSession
    keep = k + 1  # a query's own id may be among its class's
    plain = (vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
             .filter(F.col("vec_id").isNotNull() & valid(F.col("vector")))
             .withColumn("vector", F.transform("vector", lambda v: v + F.lit(0.0))))  # -0.0 as 0.0
    # a class's first ids; Spark limits the rows of each class before it shuffles them
    order = Window.partitionBy("vector").orderBy("vec_id")
    few = plain.dropDuplicates(["vec_id", "vector"]).withColumn("n", F.row_number().over(order)).filter(F.col("n") <= keep)
    classes = materialize(few.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
                          .withColumn("class", F.col("ids")[0]).withColumn("class", F.struct("class", F.xxhash64("vector"))), "classes")
    n = classes.count()
    hashes, tables, probes = plan or (h := 1 if n <= ONE_HASH else 2, *TABLES[h])
    asked = materialize(plain.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "vector").distinct(), "queries")
    asked_classes = classes.join(asked.select("vector").distinct(), "vector", "left_semi").withColumn("ids", F.array().cast("array<long>"))

    # the buckets are computed once and kept without the vectors
    keys = materialize(classes.select(F.to_json("class").alias("class"), F.explode(hashed(tables, hashes, 1)("vector")).alias("at"))
                       .select("at.*", "class"), "buckets")
    named_classes = classes.select(F.to_json("class").alias("class"), "vector", "ids")
    probe = asked_classes.withColumn("at", F.explode(hashed(tables, hashes, probes)("vector"))).select("at.*", F.to_json("class").alias("class"), "vector", "ids")
    # a bucket's vectors are dealt in lots, its queries in parts, and each lot meets each part in a task of its own
    sizes = (keys.groupBy("table", "bucket").count()
             .join(probe.groupBy("table", "bucket").agg(F.count("*").alias("asked")), ["table", "bucket"])  # buckets that nobody asks for stay out
             .select("table", "bucket", F.ceil(F.col("count") / LOT).cast("int").alias("lots"), F.ceil(F.col("asked") / ASKED).cast("int").alias("parts")))
    sizes = materialize(sizes, "bucket-sizes")
    number = lambda count: F.pmod(F.xxhash64("class"), F.col(count)).cast("int")
    each = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    rows = keys.join(sizes, ["table", "bucket"]).join(named_classes, "class")
    dealt = (rows.select("table", "bucket", number("lots").alias("lot"), each("parts").alias("part"), "class", "vector", "ids")
             .unionByName(probe.join(sizes, ["table", "bucket"])
                          .select("table", "bucket", each("lots").alias("lot"), number("parts").alias("part"), "class", "vector", "ids")))
    shape = "class string, vec_id long, score double"
    found = dealt.groupBy("table", "bucket", "lot", "part").applyInPandas(nearest_in(keep), shape)

    best = Window.partitionBy("class").orderBy("score", "vec_id")
    first = lambda df: df.distinct().withColumn("n", F.row_number().over(best)).filter(F.col("n") <= keep).drop("n")
    stored = materialize(first(found), "found")
    # whoever has too few meets all vectors, in blocks
    enough = stored.groupBy("class").count().filter(F.col("count") >= keep).select("class")
    poor = materialize(asked_classes.withColumn("class", F.to_json("class")).join(enough, "class", "left_anti"), "poor")
    answers = stored
    if not poor.isEmpty():
        blocks, parts = max(1, -(-n // LOT)), max(1, -(-poor.count() // ASKED))
        dealt_poor = poor.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("part", F.pmod(F.xxhash64("class"), F.lit(parts)))
        all_rows = (named_classes.withColumn("block", F.pmod(F.xxhash64("class"), F.lit(blocks)).cast("int"))
                    .withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")))))
        columns = ["block", "part", "class", "vector", "ids"]
        rest = all_rows.select(*columns).unionByName(dealt_poor.select(*columns)).groupBy("block", "part").applyInPandas(nearest_in(keep), shape)
        answers = first(stored.unionByName(materialize(rest, "rest")))

    named = asked.join(classes.select("vector", F.to_json("class").alias("class")), "vector").select("query_id", "class")
    ranked = (named.join(answers, "class").filter("query_id <> vec_id").groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
              .withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))))
    return ranked.filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
