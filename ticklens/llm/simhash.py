"""SimHash near-duplicates by vantage-point trees over fingerprints.

Distances to a vantage point are taken on disjoint groups of the 64 bits.  On each group the triangle
bound holds: two fingerprints whose distances to that group's vantage point differ by k differ in k
of its bits at least.  Groups share no bits, so these differences add up, and a branch is pruned as
soon as their sum exceeds the radius.  The first groups make the shards: a fingerprint lives in the
shard of its distances and also visits each shard that a fingerprint within the radius may live in.
Inside a shard the other groups make the tree; what is left at its leaves is compared exactly.
"""
from __future__ import annotations

import functools
import math
import operator
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_by_counts, materialize, small_batches, strings, tidy
from .components import components

SHINGLE = 4
DISTANCE = 4
SEED = 42
#: Widths in bits of the groups that make the shards; the rest of the 64 bits makes the tree, in bytes.
SHARD_WIDTHS = ((16, 16), (16, 16, 16), (16, 16, 16, 16), (8,) * 8)
#: The vantage point; groups of it serve as theirs.  Any value gives the same pairs.
VANTAGE = 0x9E3779B97F4A7C15
#: Leaves of at most so many comparisons.
LEAF = 1 << 18
#: Fingerprints that live in a shard are dealt to tasks in lots of about so many, its visitors in parts.
LOT, PART = 1 << 15, 1 << 18


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """SimHash of the text's word shingles, repeats included; zero without words."""
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    digest, joined = xxhash.xxh64_intdigest, b" ".join
    ones = np.zeros(64, np.int64)
    for a in range(0, n, 1 << 16):
        hashes = np.fromiter((digest(joined(words[i : i + shingle]), SEED) for i in range(a, min(n, a + (1 << 16)))), np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprint_of(shingle: int = SHINGLE):
    """A column function: the fingerprint of a text column as a signed long."""
    @F.arrow_udf("long")
    @tidy
    def fp(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(np.array([fingerprint(t, shingle) for t in strings(texts)], np.uint64).view(np.int64))

    return fp


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long) of every row; null texts are empty."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), fingerprint_of(shingle)(F.col("text").cast("string")).alias("fp"))


def bit_groups(widths: tuple[int, ...]) -> tuple[list[int], list[int]]:
    """Masks of the shards' groups from the lowest bit on, and of the tree's."""
    used = sum(widths)
    starts = [sum(widths[:k]) for k in range(len(widths))]
    return [((1 << w) - 1) << a for w, a in zip(widths, starts, strict=True)], [0xFF << a for a in range(used, 64, 8)]


def shard_widths(n: int) -> tuple[int, ...]:
    """The fewest groups whose fullest shard, of ``n`` fingerprints with even bits, is one lot."""
    def fullest(widths: tuple[int, ...]) -> float:
        return n * math.prod(math.comb(w, w // 2) / 2**w for w in widths)

    return next((w for w in SHARD_WIDTHS if fullest(w) <= LOT), SHARD_WIDTHS[-1])


def group_distance(fps: np.ndarray, group: int) -> np.ndarray:
    return np.bitwise_count((fps ^ np.uint64(VANTAGE)) & np.uint64(group)).astype(np.int16)


def near(own: np.ndarray, others: np.ndarray, spent: np.ndarray, radius: int, groups: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of fingerprints within ``radius``; ``spent`` is what each of ``others`` has used up
    in other groups than the tree's."""
    def walk(a: np.ndarray, b: np.ndarray, used: np.ndarray, level: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if not len(a) or not len(b):
            return
        if len(a) * len(b) <= LEAF or level == len(groups):
            step = max(1, (1 << 21) // len(b))
            for k in range(0, len(a), step):
                i, j = np.nonzero(np.bitwise_count(own[a[k : k + step], None] ^ others[b]) <= radius)
                if len(i):
                    yield a[k + i], b[j]
            return
        da, db = group_distance(own[a], groups[level]), group_distance(others[b], groups[level])
        for shell in np.unique(da):
            now = used + np.abs(db - shell)
            go = now <= radius
            yield from walk(a[da == shell], b[go], now[go], level + 1)

    yield from walk(np.arange(len(own)), np.arange(len(others)), spent, 0)


def steps(groups: int, radius: int) -> list[tuple[int, ...]]:
    """Every vector of changes of the groups' distances whose sizes add up to ``radius`` at most."""
    if not groups:
        return [()]
    return [(d, *rest) for d in range(-radius, radius + 1) for rest in steps(groups - 1, radius - abs(d))]


class Forest:
    """Merges pairs of values as they come and keeps one edge for each value that isn't a root."""

    def __init__(self, values: np.ndarray) -> None:
        self.values = np.unique(values)
        self.root = np.arange(len(self.values))

    def add(self, x: np.ndarray, y: np.ndarray) -> None:
        i, j = np.searchsorted(self.values, x), np.searchsorted(self.values, y)
        while True:
            ri, rj = self.root[i], self.root[j]
            open_ = ri != rj
            if not open_.any():
                return
            i, j, ri, rj = i[open_], j[open_], ri[open_], rj[open_]
            np.minimum.at(self.root, np.maximum(ri, rj), np.minimum(ri, rj))
            while (up := self.root[self.root] != self.root).any():
                self.root[up] = self.root[self.root[up]]

    def edges(self) -> pd.DataFrame:
        child = np.flatnonzero(self.root != np.arange(len(self.root)))
        return pd.DataFrame({"a": self.values[child].view(np.int64), "b": self.values[self.root[child]].view(np.int64)})


def links(distinct: DataFrame, radius: int = DISTANCE, widths: tuple[int, ...] | None = None) -> DataFrame:
    """Edges (a, b) that connect exactly the fingerprints (column fp, distinct, stored) within ``radius``.

    A pair is found in one shard: of the two, the one with the lesser shard visits the other's.  A
    shard's fingerprints are dealt out in lots and its visitors in parts, and each lot meets each part
    in a task of its own.  ``widths`` sets the shards' groups instead of the choice by their number.
    """
    spark = distinct.sparkSession
    widths = widths or shard_widths(distinct.count())
    shard_groups, tree_groups = bit_groups(widths)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    own = [f"d{k}" for k in range(len(widths))]
    places = [(max(widths) + 1) ** k for k in reversed(range(len(widths)))]
    shard = lambda at: sum((c * p for c, p in zip(at, places)), F.lit(0).cast("long"))
    homes = distinct.select("fp", *[F.bit_count(F.col("fp").bitwiseXOR(F.lit(signed(VANTAGE))).bitwiseAND(F.lit(signed(g)))).alias(c)
                                    for c, g in zip(own, shard_groups)])
    at = [F.col(c) for c in own]

    # the ways to the same or a greater shard that a partner may be in: a fixed table
    ways = [(*d, sum(map(abs, d))) for d in steps(len(widths), radius) if d >= (0,) * len(widths)]
    ways = spark.createDataFrame(ways, ", ".join(f"c{k} int" for k in range(len(widths))) + ", spent int")

    def reach(df: DataFrame) -> DataFrame:
        reached = [c + F.col(f"c{k}") for k, c in enumerate(at)]
        inside = [c.between(0, w) for c, w in zip(reached, widths)]
        return df.join(F.broadcast(ways)).filter(functools.reduce(operator.and_, inside)).withColumn("to", shard(reached))

    filled = materialize(homes.groupBy(*own).agg(F.count("*").alias("n")), "shards")
    visitors = reach(filled).groupBy("to").agg(F.sum("n").alias("visitors"))
    plan = materialize(filled.select(shard(at).alias("to"), "n").join(visitors, "to")
                       .select("to", F.ceil(F.col("n") / LOT).alias("lots"), F.ceil(F.col("visitors") / PART).alias("parts")), "plan")
    dealt = lambda count: F.pmod(F.xxhash64("fp"), F.col(count)).cast("int")
    each = lambda count: F.explode(F.sequence(F.lit(0), F.col(count).cast("int") - 1))
    home_rows = (homes.withColumn("to", shard(at)).join(plan, "to")
                 .select("to", dealt("lots").alias("lot"), each("parts").alias("part"), F.lit(-1).alias("spent"), "fp"))
    visitor_rows = (reach(homes).join(plan, "to")  # nobody visits an empty shard
                    .select("to", each("lots").alias("lot"), dealt("parts").alias("part"), "spent", "fp"))

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        fps, spent = frame["fp"].to_numpy(np.int64).view(np.uint64), frame["spent"].to_numpy(np.int16)
        own, others, used = fps[spent < 0], fps[spent >= 0], spent[spent >= 0]
        forest = Forest(fps)
        for i, j in near(own, others, used, radius, tree_groups):
            forest.add(own[i], others[j])
        return forest.edges()

    return home_rows.unionByName(visitor_rows).groupBy("to", "lot", "part").applyInPandas(compare, "a long, b long")


def clusters(prints: DataFrame, radius: int = DISTANCE) -> DataFrame:
    """fp, component_id (least doc_id that links reach), root (least linked fp) and copies (rows) of every
    distinct fp of ``prints``.

    ``prints`` must be stored rows of doc_id and fp.  Equal fingerprints are one class, so any
    number of copies costs one fingerprint.
    """
    classes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")), "classes")
    roots = components(links(classes, radius), "simhash")
    linked = roots.join(classes, roots["node"] == classes["fp"]).select("fp", "root", "least")
    whole = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    merged = linked.join(whole, "root").select("fp", "component_id", "root")
    return (classes.join(merged, "fp", "left")
            .select("fp", F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"),
                    F.coalesce("root", "fp").alias("root"), "copies"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = DISTANCE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row of ``docs``.

    Fingerprints link at ``radius`` or fewer differing bits, transitively.  Texts without words,
    null texts among them, have fingerprint zero and link like any other.  A null doc_id keeps its
    row; it names no component unless all of that component's ids are null.  Repeated rows stay.
    """
    prints = materialize(fingerprints(docs, shingle), "prints")
    return (join_by_counts(prints, materialize(clusters(prints, radius), "clusters"), "fp", "copies")
            .select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"))


def keep_one(docs: DataFrame, shingle: int = SHINGLE, radius: int = DISTANCE) -> DataFrame:
    """``docs`` with one row of each component: the one with the least doc_id, of equal ids the first text.

    All columns pass through.  A component whose ids are all null keeps its first text.
    """
    found = materialize(clusters(materialize(fingerprints(docs, shingle), "prints"), radius), "clusters")
    ids = found.filter(F.col("component_id").isNotNull()).select(F.col("component_id").alias("_llm_keep")).distinct()
    kept = docs.filter(F.col("doc_id").isNotNull()).join(ids, F.col("doc_id").cast("long") == F.col("_llm_keep"), "left_semi")
    unnamed = found.filter(F.col("component_id").isNull()).select(F.col("fp").alias("_llm_fp"), F.col("root").alias("_llm_root"))
    rest = docs.filter(F.col("doc_id").isNull()).withColumn("_llm_fp", fingerprint_of(shingle)(F.col("text").cast("string")))
    rest = rest.join(unnamed, "_llm_fp").drop("_llm_fp")
    first = lambda df, key: (df.withColumn("_llm_row", F.row_number().over(Window.partitionBy(key).orderBy("text")))
                             .filter("_llm_row = 1").select(*docs.columns))
    return first(kept, "doc_id").unionByName(first(rest, "_llm_root"))
