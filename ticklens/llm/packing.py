"""Packing of documents' tokens into sequences by length patterns.

Only lengths matter to a packing, and there are at most ``capacity`` of them, so the plan is made
from the histogram alone: patterns of few documents that fill a sequence are enumerated over
rounded lengths, non-negative least squares fits how often each is used, the counts are rounded
down and realised with exact lengths, and what remains goes into the fullest sequence that still
has room (best fit, longest first), counts at a time.  A plan is a list of (lengths, how many
sequences); its size follows ``capacity`` and not the corpus.  Spark then ranks the pieces of each
length and every piece finds its sequence from its rank.
"""
from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, slices, texts, tidy
from .word_ids import word_ids

CAPACITY = 2048
SEPARATOR_ID = 0
#: Lengths are rounded up to this many steps of a sequence when patterns are fitted.
STEPS = 128
#: Documents in a pattern at most.
PATTERN_DOCS = 3
#: Each length is ranked in so many independent parts, so a length that a third of all pieces
#: share is ranked by many tasks.
RANK_PARTS = 256

Plan = list[tuple[tuple[int, ...], int]]


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 2000) -> np.ndarray:
    """x >= 0 with least ||a x - b||: active sets, one column enters at a time."""
    n = a.shape[1]
    x, chosen = np.zeros(n), np.zeros(n, bool)
    tolerance = 1e-9 * max(1.0, float(np.abs(a.T @ b).max(initial=0)))
    for _ in range(rounds):
        slope = a.T @ (b - a @ x)
        slope[chosen] = -np.inf
        best = int(slope.argmax())
        if slope[best] <= tolerance:
            break
        chosen[best] = True
        while True:
            own = np.flatnonzero(chosen)
            z = np.linalg.lstsq(a[:, own], b, rcond=None)[0]
            if (z > 0).all():
                x[:] = 0
                x[own] = z
                break
            old, low = x[own], z <= 0
            step = (old[low] / np.maximum(old[low] - z[low], 1e-300)).min()
            x[own] = old + step * (z - old)
            drop = own[low & (x[own] <= 1e-12)]
            if not len(drop):
                drop = own[low][[int(x[own][low].argmin())]]
            x[drop], chosen[drop] = 0, False
    return x


def patterns(steps: int, docs: int) -> list[tuple[int, ...]]:
    """Every descending tuple of at most ``docs`` rounded lengths that add up to ``steps``."""
    def grow(rest: int, top: int, left: int) -> Iterator[tuple[int, ...]]:
        if rest == 0:
            yield ()
        elif left:
            for k in range(min(rest, top), 0, -1):
                if k * left >= rest:
                    yield from ((k, *more) for more in grow(rest - k, k, left - 1))
    return list(grow(steps, steps, docs))


def make_plan(histogram: dict[int, int], capacity: int = CAPACITY, steps: int = STEPS,
              docs: int = PATTERN_DOCS) -> Plan:
    """Sequences for so many pieces of each length (1 to ``capacity``)."""
    left = {k: int(v) for k, v in histogram.items() if v > 0}
    if not left:
        return []
    if min(left) < 1 or max(left) > capacity:
        raise ValueError("a length is outside 1 to the capacity")
    steps = min(steps, capacity)
    rounded = lambda length: -(-length * steps // capacity)
    shapes = patterns(steps, docs)
    a = np.zeros((steps, len(shapes)))
    for j, shape in enumerate(shapes):
        for k in shape:
            a[k - 1, j] += 1
    target = np.zeros(steps)
    for length, n in left.items():
        target[rounded(length) - 1] += n
    # long pieces are hard to place later, so a miss there weighs more
    weight = np.sqrt(np.arange(1, steps + 1) / steps)[:, None]
    scale = max(1.0, float(target.max()))
    repeats = nnls(a * weight, target * weight[:, 0] / scale) * scale

    by_step: dict[int, list[int]] = defaultdict(list)  # lengths, ascending
    for length in sorted(left):
        by_step[rounded(length)].append(length)

    def take(step: int, most: int, room: int) -> tuple[int, int]:
        """The step's longest length that fits and how many of at most ``most`` pieces it gives."""
        own = by_step[step]
        length = max(k for k in own if k <= room)
        n = min(most, left[length])
        left[length] -= n
        if not left[length]:
            own.remove(length)
        return length, n

    def give(length: int, n: int) -> None:
        if not left[length]:
            own = by_step[rounded(length)]
            own.append(length)
            own.sort()
        left[length] += n

    open_: dict[int, list[list]] = defaultdict(list)  # free room: [lengths, count]
    for j in np.argsort(-repeats):
        want = int(repeats[j] + 1e-6)
        while want > 0:
            got, n = [], want
            for i, step in enumerate(shapes[j]):
                if i + 1 == len(shapes[j]):  # of the last step or, as the others fell short, a little above
                    room = capacity - sum(got)
                    step = next((k for k in range(rounded(room), step - 1, -1) if by_step[k] and by_step[k][0] <= room), 0)
                else:
                    room = capacity
                if not by_step[step]:
                    break
                length, m = take(step, n, room)
                if m < n:  # fewer of this length: the pieces before it give some back
                    for other in got:
                        give(other, n - m)
                    n = m
                got.append(length)
            if len(got) < len(shapes[j]):
                for other in got:
                    give(other, n)
                break
            open_[capacity - sum(got)].append([tuple(got), n])
            want -= n

    rooms = np.zeros(capacity + 1, bool)
    for room in open_:
        rooms[room] = True
    for length in sorted((k for k, v in left.items() if v), reverse=True):
        n = left[length]
        while n:
            fitting = np.flatnonzero(rooms[length:])
            if not len(fitting):  # new sequences, each with as many as go in
                per = capacity // length
                for count, k in ((n // per, per), (1 if n % per else 0, n % per)):
                    if count:
                        room = capacity - k * length
                        open_[room].append([(length,) * k, count])
                        rooms[room] = True
                break
            room = length + int(fitting[0])
            lengths, count = open_[room][-1]
            k = min(room // length, n)  # as many as go in, while there are
            used = min(count, n // k)
            if used == count:
                open_[room].pop()
                rooms[room] = bool(open_[room])
            else:
                open_[room][-1][1] -= used
            rest = room - k * length
            open_[rest].append([lengths + (length,) * k, used])
            rooms[rest] = True
            n -= used * k
    return [(lengths, count) for room in sorted(open_) for lengths, count in open_[room]]


def plan_ranges(plan: Plan) -> pd.DataFrame:
    """For each length, runs of ranks: the run's first rank, first sequence and offset in it."""
    rows, next_rank, sequence = [], defaultdict(int), 0
    for lengths, count in plan:
        offset = 0
        for length in lengths:
            rows.append((length, next_rank[length], sequence, offset))
            next_rank[length] += count
            offset += length
        sequence += count
    return pd.DataFrame(rows, columns=["length", "rank", "sequence", "offset"]).sort_values(["length", "rank"])


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's ids and the separator, cut at ``capacity``."""
    @tidy
    def cut(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = word_ids(vocabulary)
        end = np.array([SEPARATOR_ID], "<u4").tobytes()
        try:
            for frame in slices(frames):
                rows = []
                for doc_id, text in zip(frame["doc_id"].array, frame["text"].array, strict=True):
                    raw = words.encode(text) + end
                    for piece, at in enumerate(range(0, len(raw), 4 * capacity)):
                        own = raw[at : at + 4 * capacity]
                        rows.append((doc_id, piece, at // 4, len(own) // 4, zlib.crc32(own)))
                out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
                yield out.astype({"doc_id": "Int64"})
        finally:
            words.clear()  # the worker lives on, and what comes next needs its memory

    return texts(docs).mapInPandas(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to stored rows with a ``length`` of 1 to ``capacity``.

    The driver gets one count for each length.  Equal rows each get a place of their own, ties in
    any order; the other columns pass through and rows without pieces stay none.
    """
    spark = pieces.sparkSession
    names = pieces.columns
    key = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("doc_id", "piece")]
    parted = pieces.withColumn("_part", F.pmod(F.xxhash64(*key), F.lit(RANK_PARTS)).cast("int"))
    counts = parted.groupBy("length", "_part").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.withColumn("_base", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    ranges = plan_ranges(make_plan(histogram, capacity))
    # the number of runs is bounded by the number of lengths, not of pieces
    starts = (ranges["length"].to_numpy("int64") << 44) | ranges["rank"].to_numpy("int64")
    table = spark.sparkContext.broadcast((starts, ranges["rank"].to_numpy("int64"),
                                          ranges["sequence"].to_numpy("int64"), ranges["offset"].to_numpy("int64")))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        first, own, sequence, offset = table.value
        run = np.searchsorted(first, (length.to_numpy("int64") << 44) | rank.to_numpy("int64"), "right") - 1
        return pd.DataFrame({"sequence_id": sequence[run] + rank.to_numpy("int64") - own[run], "offset": offset[run]})

    # rows that are alike in all of these may change places in a second run of a task, and nobody can tell
    order = [c for c in ("doc_id", "piece", "start", "ids_crc32") if c in names]
    own = Window.partitionBy("length", "_part").orderBy(*(F.asc_nulls_first(c) for c in order))
    ranked = parted.withColumn("_rank", F.row_number().over(own) - 1)
    joined = ranked.join(bases, ["length", "_part"]).withColumn("_at", place("length", F.col("_rank") + F.col("_base")))
    return joined.select(*names, "_at.sequence_id", "_at.offset")


def pattern_packing(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """Pack the ids of every whole document, each followed by id 0, into sequences of ``capacity``.

    Null and empty texts are one piece that holds the separator alone; only documents longer than
    a sequence are cut; null doc_ids and repeated rows are packed like any other row.
    """
    return pack(materialize(token_pieces(docs, vocabulary, capacity), "pieces"), capacity)
