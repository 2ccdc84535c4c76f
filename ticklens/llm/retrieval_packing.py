"""Packing of documents by lexical retrieval.

Documents that share words are put into one sequence.  Every document goes to a shard by its most
characteristic token, and each shard has an inverted index with BM25 weights, whose document
frequencies and mean length are those of the whole corpus.  A seed document opens a sequence and the
index returns the unused documents most like it; they fill the rest in that order, where they fit
whole, and the best of those that don't is cut to fill the sequence and is the next one's seed.

All sequences of a shard are full but the last, which is cut into powers of two, so nothing is padded.
"""
from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, slices, texts
from .word_ids import word_ids

CAPACITY = 2048
END_ID = 1
#: Tokens of a shard, about; a longer document has one to itself.
SHARD_TOKENS = 1 << 20
K1, B = 1.2, 0.75
#: A term in this share of a shard's documents is frequent.
FREQUENT = 0.25

Piece = tuple[int, int, int]  # document, first id, ids


# --- tokens --------------------------------------------------------------------------------------

def tokens(docs: DataFrame, vocabulary: str, end_id: int = END_ID) -> DataFrame:
    """One row for each document: row (its place), doc (the doc_id, 0 if null), no_id, n (ids with the
    end id), mark (see ``mark``) and the compressed ids; and, with a ``token`` of 0 or more, for each
    task and token in how many of the task's documents it is (``n``)."""
    def encode(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, pack = word_ids(vocabulary), zstandard.ZstdCompressor(level=1).compress
        end = np.array([end_id], "<u4").tobytes()
        found = np.zeros(words.tokenizer.get_vocab_size(with_added_tokens=True), np.int64)
        narrow = "<u2" if len(found) <= 1 << 16 and end_id < 1 << 16 else "<u4"
        for frame in slices(frames):
            sizes, marks, packed = [], [], []
            for text in frame["text"]:
                ids = np.frombuffer(words.encode(text) + end, "<u4").astype(narrow)
                token, often = terms(ids)
                found[token] += 1
                sizes.append(len(ids))
                marks.append(mark(token, often, end_id))
                packed.append(pack(ids))
            yield frame[["row", "doc", "no_id"]].assign(n=sizes, mark=marks, packed=packed, token=-1)
        used = np.flatnonzero(found)
        yield pd.DataFrame({"row": -1, "doc": 0, "no_id": False, "n": found[used], "mark": -1, "packed": b"", "token": used})

    doc = F.col("doc_id")
    numbered = texts(docs).select(F.monotonically_increasing_id().alias("row"), F.coalesce(doc, F.lit(0)).alias("doc"), doc.isNull().alias("no_id"), "text")
    return materialize(numbered.mapInPandas(encode, "row long, doc long, no_id boolean, n long, mark long, packed binary, token long"), "tokens")


def unpacked(packed: Iterable[bytes], sizes: Iterable[int]) -> Iterator[np.ndarray]:
    """The ids of compressed documents of so many ids."""
    unpack = zstandard.ZstdDecompressor().decompress
    for p, n in zip(packed, sizes, strict=True):
        raw = unpack(p)
        yield np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4")


def terms(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids of a document, ascending, without its end id, and how often each occurs."""
    own = ids[:-1].copy()
    own.sort(kind="stable" if own.itemsize == 2 else None)  # a radix sort
    new = np.empty(len(own), bool)
    new[:1] = True
    np.not_equal(own[1:], own[:-1], out=new[1:])
    first = np.flatnonzero(new)
    often = np.empty_like(first)
    np.subtract(first[1:], first[:-1], out=often[:-1])
    often[-1:] = len(own) - first[-1:]
    return own[first].astype(np.int64), often


def mark(token: np.ndarray, often: np.ndarray, end_id: int) -> int:
    """The token that characterises a document: often in it and rare in text at large, which the order
    of a BPE vocabulary tells; the lowest of equals, the end id if it has none."""
    if not len(token):
        return end_id
    return int(token[(np.log1p(token) * (often / (often + K1))).argmax()])


class Weights:
    """BM25 weights of terms in documents, by statistics of all documents."""

    def __init__(self, frequencies: dict[int, int], n_docs: int, mean: float) -> None:
        n = np.zeros(max(frequencies, default=0) + 1)
        n[list(frequencies)] = list(frequencies.values())
        self.idf = np.log1p((n_docs - n + 0.5) / (n + 0.5))
        self.mean = mean

    def __call__(self, token: np.ndarray, often: np.ndarray, length: int | np.ndarray) -> np.ndarray:
        return self.idf[token] * often * (K1 + 1) / (often + K1 * (1 - B + B * length / self.mean))


def shard_table(totals: dict[int, int], shard_tokens: int) -> tuple[np.ndarray, np.ndarray]:
    """First shard and number of shards of each token's documents: tokens with few ids share one,
    those with many have as many as they need."""
    first, many = np.zeros(max(totals, default=0) + 1, np.int64), np.ones(max(totals, default=0) + 1, np.int64)
    shard, held = 0, 0
    for token in sorted(totals):
        if totals[token] > shard_tokens:
            shard += held > 0
            first[token], many[token] = shard, -(-totals[token] // shard_tokens)
            shard, held = shard + int(many[token]), 0
            continue
        if held + totals[token] > shard_tokens:
            shard, held = shard + 1, 0
        first[token] = shard
        held += totals[token]
    return first, many


# --- a shard -------------------------------------------------------------------------------------

class Index:
    """Inverted index of a shard: for each term the documents that hold it and its weight in each; terms
    that a good part of the documents hold have a row of all their weights instead."""

    def __init__(self, docs: list[np.ndarray], weights: Weights) -> None:
        found = [terms(ids) for ids in docs]
        size = np.array([len(t) for t, _ in found], np.int64)
        doc = np.repeat(np.arange(len(docs)), size)
        token = np.concatenate([np.zeros(0, np.int64), *(t for t, _ in found)])
        often = np.concatenate([np.zeros(0, np.int64), *(n for _, n in found)])
        weight = weights(token, often, np.array([len(d) for d in docs])[doc])
        order = np.argsort(token.astype(np.uint16) if token.max(initial=0) < 1 << 16 else token, kind="stable")
        term = np.cumsum(np.diff(token[order], prepend=-1) > 0) - 1
        self.term = np.empty(len(token), np.int64)  # by document
        self.term[order] = term
        self.own = np.concatenate([[0], np.cumsum(size)])
        self.used = np.zeros(len(docs), bool)
        self.left = len(docs)
        held = np.bincount(term)
        self.row = np.where(held >= FREQUENT * len(docs), 0, -1)  # of a frequent term
        self.row[self.row == 0] = np.arange(np.count_nonzero(self.row == 0))
        self.rows = np.zeros((int(self.row.max(initial=-1)) + 1, len(docs)))
        rare = self.row[term] < 0
        self.rows[self.row[term[~rare]], doc[order][~rare]] = weight[order][~rare]
        self._postings(term[rare], doc[order][rare], weight[order][rare])

    def _postings(self, term: np.ndarray, doc: np.ndarray, weight: np.ndarray) -> None:
        self.of, self.doc, self.weight = term, doc, weight
        self.start = np.searchsorted(term, np.arange(len(self.row) + 1))
        self.kept = self.left

    def use(self, doc: int) -> None:
        self.used[doc] = True
        self.left -= 1
        if 2 * self.left < self.kept:  # used documents leave the index
            unused = ~self.used[self.doc]
            self._postings(self.of[unused], self.doc[unused], self.weight[unused])

    def scores(self, seed: int) -> np.ndarray:
        """BM25 score of every document for the seed's terms; 0 for used ones and without a common term."""
        term = self.term[self.own[seed] : self.own[seed + 1]]
        row = self.row[term]
        first, many = self.start[term], self.start[term + 1] - self.start[term]
        at = np.repeat(first - (np.cumsum(many) - many), many) + np.arange(many.sum())
        score = self.rows[row[row >= 0]].sum(axis=0) + np.bincount(self.doc[at], self.weight[at], minlength=len(self.used))
        score[self.used] = 0
        return score


def fill(lengths: np.ndarray, index: Index, capacity: int) -> list[list[Piece]]:
    """Windows of ``capacity`` ids, the last one of what is left."""
    windows: list[list[Piece]] = []
    window: list[Piece] = []
    room, after = capacity, 0

    def place(doc: int, start: int) -> int:
        """Put as much of the document as goes in; where it goes on, 0 at its end."""
        nonlocal room, window
        n = min(room, int(lengths[doc]) - start)
        window.append((doc, start, n))
        room -= n
        if not room:
            windows.append(window)
            window, room = [], capacity
        return start + n if start + n < lengths[doc] else 0

    def unused() -> int | None:
        nonlocal after
        while after < len(lengths) and index.used[after]:
            after += 1
        return after if after < len(lengths) else None

    seed, start = unused(), 0
    while seed is not None:
        if not index.used[seed]:
            index.use(seed)
        while (start := place(seed, start)):
            pass
        if room == capacity or not index.left:
            seed = unused()
            continue
        score, opened = index.scores(seed), len(windows)
        while len(windows) == opened:
            fitting = np.where(lengths <= room, score, 0)
            best = int(fitting.argmax())
            if not fitting[best]:
                break
            index.use(best)
            score[best] = 0
            place(best, 0)
        if len(windows) > opened:
            seed = unused()
            continue
        # no more fit: the best of the rest is cut, or, if none shares a term, the next in order is taken
        best = int(score.argmax())
        seed = best if score[best] else unused()
    return [*windows, window] if window else windows


def in_powers(window: list[Piece]) -> list[list[Piece]]:
    """A window cut into sequences whose lengths are descending powers of two."""
    left, out = sum(n for _, _, n in window), []
    pieces = list(reversed(window))
    while left:
        room = 1 << (left.bit_length() - 1)
        left -= room
        own: list[Piece] = []
        while room:
            doc, start, n = pieces.pop()
            k = min(n, room)
            own.append((doc, start, k))
            if k < n:
                pieces.append((doc, start + k, n - k))
            room -= k
        out.append(own)
    return out


def pack_shard(docs: list[np.ndarray], weights: Weights, capacity: int = CAPACITY) -> list[list[Piece]]:
    """Sequences of the pieces of a shard's documents: full ones, then powers of two."""
    windows = fill(np.array([len(d) for d in docs], np.int64), Index(docs, weights), capacity)
    full = sum(n for _, _, n in windows[-1]) == capacity if windows else True
    return windows if full else windows[:-1] + in_powers(windows[-1])


# --- the operator --------------------------------------------------------------------------------

def retrieval_packing(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID,
                      shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset of every piece of every
    document of ``docs``; each document is its ids and the end id.

    Null and empty texts are the end id alone; null doc_ids and repeated rows are documents like any
    other; within a shard documents are in order of doc_id (nulls first) and place in the table; no
    documents give no pieces.  Sequences hold ``capacity`` ids or, the last of a shard, a power of two.

    Through the driver go one number for each token of the vocabulary (in how many documents it is)
    and one for each that marks a shard.  A shard is a bounded number of ids: a token that marks too
    many documents has them dealt to several shards by their places in the table.
    """
    made = tokens(docs, vocabulary, end_id)
    spark = made.sparkSession
    rows = made.filter("token < 0").drop("token")
    frequencies = {r["token"]: r["n"] for r in made.filter("token >= 0").groupBy("token").agg(F.sum("n").alias("n")).collect()}
    n_docs, n_ids = rows.agg(F.count("*"), F.sum("n")).first()
    held = spark.sparkContext.broadcast(Weights(frequencies, n_docs, (n_ids or 1) / max(1, n_docs)))
    totals = {r["mark"]: r["n"] for r in rows.groupBy("mark").agg(F.sum("n").alias("n")).collect()}
    first, many = shard_table(totals, shard_tokens)
    shards = spark.createDataFrame([(k, int(first[k]), int(many[k])) for k in totals], "mark long, first long, many long")
    dealt = rows.join(F.broadcast(shards), "mark")  # at most a row for each token of the vocabulary
    dealt = dealt.select("row", "doc", "no_id", "n", "packed", (F.col("first") + F.pmod(F.xxhash64("row"), F.col("many"))).alias("shard"))

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["no_id", "doc", "row"], ascending=[False, True, True], ignore_index=True)
        ids = list(unpacked(frame["packed"], frame["n"]))
        number = int(frame["shard"].iloc[0]) << 32
        out = []
        for k, sequence in enumerate(pack_shard(ids, held.value, capacity)):
            offset = 0
            for doc, start, n in sequence:
                out.append((doc, start, n, zlib.crc32(ids[doc][start : start + n].astype("<u4")), len(ids[doc]), number + k, offset))
                offset += n
        made = pd.DataFrame(out, columns=["place", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
        own = frame.loc[made.pop("place"), ["doc", "no_id"]].reset_index(drop=True)
        return pd.concat([own, made], axis=1)

    pieces = (dealt.groupBy("shard")
              .applyInPandas(pack, "doc long, no_id boolean, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"))
    return pieces.select(F.when(~F.col("no_id"), F.col("doc")).alias("doc_id"), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
