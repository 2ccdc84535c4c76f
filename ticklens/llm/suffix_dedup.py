"""Exact removal of repeated passages by sorted suffixes.

A passage of ``LENGTH`` bytes is removed where it also starts earlier in the corpus.  Sorting every
suffix would move each byte a hundred times, so suffixes stand at anchors: of the ``GRAM``-byte
strings in a passage's window the one of least hash, leftmost of equals.  The anchor depends on the
passage alone, so equal passages have equal anchors at equal places, and each passage belongs to
exactly one.

1. Tasks find the anchors, with a hash of the anchor's bytes and one of all bytes that its passages
   cover.  Where the latter occurred earlier, all the anchor's passages did.  A task settles its own
   repeats before the shuffle, so a string that is everywhere costs each task one row.
2. Anchors with equal bytes and different surroundings are left.  Their suffixes are range-partitioned
   by leading bytes at sampled splitters.  Equal leading bytes are never split, so no equal passages
   lie on two sides of a boundary.  Each range sorts its passages by multikey quicksort, eight bytes a
   key, going on with ties alone; of equal passages the earliest stays.
3. The spans found are joined to the documents.
"""
from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, small_batches, strings, tidy

LENGTH = 100
GRAM = 24
#: Anchors that a task holds before it settles its own repeats, and bytes of texts whose anchors it finds at once.
HELD, SLICE = 1 << 18, 1 << 18
#: Bytes of surroundings that are sorted at once, about; a set of equal leading bytes stays whole.
SORTED = 1 << 20

U64 = np.uint64


# --- anchors -------------------------------------------------------------------------------------

@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.random.default_rng(8).integers(1, 1 << 63, (2, 256), np.uint64) | U64(1))


MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


@lru_cache(maxsize=2)
def _powers(which: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a multiplier and of its inverse modulo 2**64."""
    m = MULTIPLIERS[which]
    return tuple(np.multiply.accumulate(np.concatenate([np.ones(1, U64), np.full(size, x, U64)])) for x in (m, pow(m, -1, 1 << 64)))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U64(32))) * U64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> U64(29))) * U64(0xBF58476D1CE4E5B9)
    return h ^ (h >> U64(32))


class RangeHash:
    """Hash of any range of bytes in constant time."""

    def __init__(self, data: np.ndarray, which: int) -> None:
        size = -(-len(data) // (1 << 18)) << 18
        self.power, self.inverse = _powers(which, size)
        self.sums = np.zeros(len(data) + 1, U64)
        np.cumsum(_tables()[which][data] * self.power[: len(data)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return _mix((self.sums[stop] - self.sums[start]) * self.inverse[start])

    def grams(self, n: int) -> np.ndarray:
        got = self.sums[n:] - self.sums[:-n]
        return _mix(got * self.inverse[: len(got)])


def leftmost_least(values: np.ndarray, window: int) -> np.ndarray:
    """Place of the least value, leftmost of equals, in each window."""
    place, size = np.arange(len(values), dtype=np.int32), 1
    least = values

    def both(a: np.ndarray, b: np.ndarray, pa: np.ndarray, pb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.minimum(a, b), np.where(b < a, pb, pa)

    while 2 * size <= window:
        least, place = both(least[:-size], least[size:], place[:-size], place[size:])
        size *= 2
    if size < window:
        step = window - size
        least, place = both(least[:-step], least[step:], place[:-step], place[step:])
    return place


def anchors(raws: list[bytes]) -> dict[str, np.ndarray]:
    """Anchors of each text: text number, place, first and last passage start (within the text),
    hash of the anchor's bytes and of all bytes of its passages."""
    lengths = np.array([len(r) for r in raws], np.int64)
    data = np.frombuffer(b"".join(raws), np.uint8)
    begin = np.cumsum(lengths) - lengths
    many = np.maximum(lengths - LENGTH + 1, 0)
    if not many.sum():
        return {k: np.zeros(0, t) for k, t in (("text", np.int64), ("at", np.int64), ("lo", np.int64), ("hi", np.int64), ("gram", U64), ("whole", U64))}
    one = RangeHash(data, 0)
    grams = one.grams(GRAM)
    place = leftmost_least(grams, LENGTH - GRAM + 1)
    # passages that lie inside a text
    start = np.arange(many.sum()) + np.repeat(begin - (np.cumsum(many) - many), many)
    own = place[start].astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    at, lo, hi = own[first], start[first], start[np.concatenate([first[1:], [len(own)]]) - 1]
    two = RangeHash(data, 1)
    whole = _mix(one(lo, hi + LENGTH) ^ (two(lo, hi + LENGTH) * U64(3)) ^ ((at - lo) << 8 | (hi - lo)).astype(U64))
    text = np.searchsorted(begin, lo, "right") - 1
    # empty texts share their begin with the next one; the last of them holds the bytes
    return {"text": text, "at": at - begin[text], "lo": lo - begin[text], "hi": hi - begin[text], "gram": grams[at], "whole": whole}


@tidy
def find_anchors(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows gram, whole, doc, tie, loc, again: ``again`` marks what occurred earlier in this task;
    such rows need no partner and are dealt by a hash of their own."""
    held: list[tuple[np.ndarray, ...]] = []

    def settled() -> pa.RecordBatch:
        gram, whole, doc, tie, loc = (np.concatenate(c) for c in zip(*held, strict=True))
        held.clear()
        order = np.lexsort((loc, tie, doc, whole, gram))
        gram, whole, doc, tie, loc = (c[order] for c in (gram, whole, doc, tie, loc))
        same = lambda c: np.concatenate([[False], c[1:] == c[:-1]])
        again = same(gram) & same(whole)
        # an equal row (a repeated row of the table) is the same place and no repeat
        new = ~(again & same(doc) & same(tie) & same(loc))
        gram[again] = _mix(doc.view(U64)[again] * U64(31) + loc.view(U64)[again]).view(np.int64)
        return pa.RecordBatch.from_pydict({"gram": gram[new], "whole": whole[new], "doc": doc[new], "tie": tie[new], "loc": loc[new], "again": again[new]})

    for batch in batches:
        if not len(batch):
            continue
        raws = batch.column("text").cast(pa.binary())
        docs, ties = (batch.column(c).to_numpy() for c in ("doc", "tie"))
        part = np.cumsum(pc.binary_length(raws).to_numpy().astype(np.int64)) // SLICE
        edges = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(batch)]
        for first, last in itertools.pairwise(edges):  # some texts at a time
            a = anchors(raws.slice(first, last - first).to_pylist())
            if len(a["at"]):
                held.append((a["gram"].view(np.int64), a["whole"].view(np.int64), docs[first:last][a["text"]], ties[first:last][a["text"]],
                             a["at"] << 16 | (a["at"] - a["lo"]) << 8 | (a["at"] - a["hi"])))
            if sum(len(h[0]) for h in held) > HELD:
                yield settled()
    if held:
        yield settled()


# --- suffixes ------------------------------------------------------------------------------------

def equal_passages(contexts: list[bytes], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sets of equal passages: for each member its set, context and offset.  Each context holds
    ``counts`` passages, at offsets 0, 1, ...; the passages are sorted by multikey quicksort."""
    data = np.frombuffer(b"".join(contexts) + b"\0" * 8, np.uint8)
    words = np.zeros(len(data) - 7, U64)
    for k in range(8):
        words = words << U64(8) | data[k : len(words) + k]
    size = np.array([len(c) for c in contexts], np.int64)
    context = np.repeat(np.arange(len(contexts)), counts)
    offset = np.arange(len(context)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = (np.cumsum(size) - size)[context] + offset
    left, group = np.arange(len(at)), np.zeros(len(at), np.int64)
    for depth in (*range(0, LENGTH - 7, 8), LENGTH - 8):
        key = words[at[left] + depth]
        order = np.lexsort((key, group))
        left, group, key = left[order], group[order], key[order]
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (key[1:] != key[:-1])])[: len(left)]
        group = np.cumsum(new) - 1
        tied = np.bincount(group, minlength=1)[group] > 1  # the rest have no equal
        left, group = left[tied], group[tied]
        if not len(left):
            break
    return group, context[left], offset[left]


def repeated_spans(rows: pd.DataFrame) -> pd.DataFrame:
    """Spans of the passages of ``rows`` (doc, tie, lo, hi, context) that are not the earliest equal."""
    counts = (rows["hi"] - rows["lo"]).to_numpy(np.int64) + 1
    group, context, offset = equal_passages(rows["context"].to_list(), counts)
    doc, tie = rows["doc"].to_numpy(np.int64)[context], rows["tie"].to_numpy(np.int64)[context]
    start = rows["lo"].to_numpy(np.int64)[context] + offset
    order = np.lexsort((start, tie, doc, group))
    group = group[order]
    again = np.concatenate([[False], group[1:] == group[:-1]])[: len(order)]
    # a repeated row of the table is the same place and no repeat
    head = order[np.maximum.accumulate(np.where(again, 0, np.arange(len(order))))]
    again &= (doc[order] != doc[head]) | (tie[order] != tie[head]) | (start[order] != start[head])
    later = order[again]
    later = later[np.lexsort((start[later], context[later]))]
    context, doc, tie, start = context[later], doc[later], tie[later], start[later]
    new = np.concatenate([[True], (context[1:] != context[:-1]) | (start[1:] != start[:-1] + 1)])[: len(start)]
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(start)]])[: len(first)] - 1
    return pd.DataFrame({"doc": doc[first], "tie": tie[first], "start": start[first], "stop": start[last] + LENGTH})


@tidy
def sort_suffixes(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by their leading bytes; as many whole sets of them as go in are sorted at once."""
    held: list[pd.DataFrame] = []
    size = 0
    for frame in frames:
        if not len(frame):
            continue
        held.append(frame)
        size += frame["context"].str.len().sum()
        if size < SORTED:
            continue
        rows = pd.concat(held, ignore_index=True)
        lead = rows["lead"]
        cut = int((lead == lead.iloc[-1]).to_numpy().argmax())  # the last set may go on
        if cut:
            yield repeated_spans(rows.iloc[:cut])
        held = [rows.iloc[cut:]]
        size = held[0]["context"].str.len().sum()
    if held:
        yield repeated_spans(pd.concat(held, ignore_index=True))


@tidy
def cut_contexts(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Anchors with their leading bytes and surroundings, some hundred thousand bytes at a time."""
    unpack = zstandard.ZstdDecompressor().decompress
    columns = ["lead", "context", "doc", "tie", "lo", "hi"]
    for frame in frames:
        rows, size = [], 0
        for doc, tie, packed, locs in zip(frame["doc"], frame["tie"], frame["packed"], frame["locs"], strict=True):
            raw = unpack(packed)
            for loc in locs:
                at = int(loc) >> 16
                lo, hi = at - (int(loc) >> 8 & 255), at - (int(loc) & 255)
                rows.append((raw[at : at + GRAM], raw[lo : hi + LENGTH], doc, tie, lo, hi))
                size += hi - lo + LENGTH
                if size > SORTED:
                    yield pd.DataFrame(rows, columns=columns)
                    rows, size = [], 0
        yield pd.DataFrame(rows, columns=columns)


# --- the operator --------------------------------------------------------------------------------

def packed(text: Column) -> Column:
    """Compressed UTF-8 bytes: texts are shuffled so."""
    @F.arrow_udf("binary")
    @tidy
    def pack(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        compress = zstandard.ZstdCompressor(level=3).compress
        for texts in batches:
            yield pa.array([compress(t.encode()) for t in strings(texts)], pa.binary())

    return pack(text)


def keys(docs: DataFrame) -> tuple[Column, Column]:
    """Order of the rows: doc_id (null first), then a hash of the text where any doc_id is repeated."""
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    repeated = docs.select(doc.alias("doc")).groupBy("doc").count().filter("count > 1").limit(1).count() > 0
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return doc, (F.xxhash64(text) if repeated else F.lit(0).cast("long"))


def spans(docs: DataFrame) -> DataFrame:
    """doc, tie (see ``keys``) and spans, an array of (start, stop) that may overlap, of the rows with any."""
    small_batches(docs.sparkSession)
    doc, tie = keys(docs)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(doc.alias("doc"), tie.alias("tie"), text.alias("text"))
    found = own.mapInArrow(find_anchors, "gram long, whole long, doc long, tie long, loc long, again boolean")
    order = ("doc", "tie", "loc")
    same = Window.partitionBy("gram", "again", "whole").orderBy(*order)
    alike = Window.partitionBy("gram", "again")
    settled = (found.repartition("gram")
               .withColumn("first", F.dense_rank().over(same) == 1)
               .withColumn("mixed", F.min("whole").over(alike) != F.max("whole").over(alike))
               .select(*order, F.when(F.col("again") | ~F.col("first"), F.lit(True)).when(F.col("mixed"), F.lit(False)).alias("whole_gone"))
               .filter("whole_gone IS NOT NULL"))
    settled = materialize(settled, "anchors")
    open_ = settled.filter(~F.col("whole_gone")).distinct().groupBy("doc", "tie").agg(F.collect_list("loc").alias("locs"))
    bytes_ = docs.select(doc.alias("doc"), tie.alias("tie"), packed(text).alias("packed")).join(open_, ["doc", "tie"])
    contexts = bytes_.mapInPandas(cut_contexts, "lead binary, context binary, doc long, tie long, lo long, hi long")
    sorted_ = contexts.repartitionByRange("lead").sortWithinPartitions("lead")
    fine = materialize(sorted_.mapInPandas(sort_suffixes, "doc long, tie long, start long, stop long"), "spans")
    at = F.shiftright("loc", 16)
    coarse = settled.filter("whole_gone").select("doc", "tie", (at - F.shiftright("loc", 8).bitwiseAND(255)).alias("start"),
                                                 (at - F.col("loc").bitwiseAND(255) + LENGTH).alias("stop"))
    return coarse.unionByName(fine).groupBy("doc", "tie").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))


def merged(found: Iterable[dict] | None) -> list[tuple[int, int]]:
    """Maximal runs, ascending."""
    out: list[tuple[int, int]] = []
    for start, stop in sorted((int(s["start"]), int(s["stop"])) for s in (found if found is not None else ())):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(stop, out[-1][1]))
        else:
            out.append((start, stop))
    return out


def kept_bytes(raw: bytes, gone: list[tuple[int, int]]) -> bytes:
    parts, at = [], 0
    for start, stop in gone:
        parts.append(raw[at:start])
        at = stop
    return b"".join([*parts, raw[at:]])


def with_spans(docs: DataFrame, *columns: str) -> DataFrame:
    """Rows of ``docs``: the columns asked for, packed text, spans and which copy of equal rows it is."""
    small_batches(docs.sparkSession)
    doc, tie = keys(docs)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(*columns, doc.alias("_llm_doc"), tie.alias("_llm_tie"), packed(text).alias("_llm_packed"))
    found = spans(docs).select(F.col("doc").alias("_llm_doc"), F.col("tie").alias("_llm_tie"), F.col("spans").alias("_llm_spans"))
    joined = own.join(found, ["_llm_doc", "_llm_tie"], "left")
    copy = F.row_number().over(Window.partitionBy("_llm_doc", "_llm_tie").orderBy(F.lit(0)))
    return joined.withColumn("_llm_copy", copy)


def gone_of(raw: bytes, found: Iterable[dict] | None, copy: int) -> list[tuple[int, int]]:
    """The runs to remove; a row's further copies go whole if they hold a passage at all."""
    if copy > 1:
        return [(0, len(raw))] if len(raw) >= LENGTH else []
    return merged(found)


def repeated_bytes(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row of ``docs``.

    Texts are UTF-8 bytes, null is empty, and passages never cross documents.  Null doc_ids come
    before all others.  Rows with equal doc_id are ordered by a hash of their texts; of wholly equal
    rows the first stays and the others count as later documents.
    """
    @tidy
    def report(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unpack = zstandard.ZstdDecompressor().decompress
        for frame in frames:
            rows = []
            for doc_id, p, found, copy in frame[["doc_id", "_llm_packed", "_llm_spans", "_llm_copy"]].itertuples(index=False):
                raw = unpack(p)
                gone = gone_of(raw, found, copy)
                rows.append((doc_id, len(raw), sum(b - a for a, b in gone), len(gone), hashlib.sha256(kept_bytes(raw, gone)).hexdigest()))
            yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]).astype({"doc_id": "Int64"})

    rows = with_spans(docs.withColumn("doc_id", F.col("doc_id").cast("long")), "doc_id")
    return rows.mapInPandas(report, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated passages cut out of ``text``; a character of which bytes go, goes whole.

    All rows and columns stay; ``n_chars``, if there, is counted again.
    """
    @F.arrow_udf("string")
    @tidy
    def kept(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        unpack = zstandard.ZstdDecompressor().decompress

        def text(packed: pa.Scalar, found: pa.Scalar, copy: pa.Scalar) -> str:
            raw = unpack(packed.as_py())
            return kept_bytes(raw, gone_of(raw, found.as_py(), copy.as_py())).decode("utf-8", "ignore")

        for batch in batches:
            yield pa.array((text(*row) for row in zip(*batch, strict=True)), pa.string())  # one at a time

    others = [c for c in docs.columns if c != "text"]
    rows = with_spans(docs, *others).withColumn("text", kept("_llm_packed", "_llm_spans", "_llm_copy"))
    if "n_chars" in others:
        rows = rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return rows.select(*docs.columns)
