"""Language-model scores from an Elias-Fano bigram trie.

The corpus is counted in sorted runs: tasks count what they read, cut their counts by shard and
compress them; a shard merges its runs and writes one file for each of its two levels to the shared
folder.  Level 1 has the words' hashes in order (a word's id is its place) and counts.  Level 2 has,
for each context, an Elias-Fano coded pointer to its successors and the successors themselves as one
Elias-Fano coded sequence, ids counted from the context's own start so that it never falls, and an
8-bit logarithm of each discounted probability.  Scoring tasks map the files into memory.

Probabilities: a known word has (1 - U) c / N, the unknown word, one type, has U, the share of the
training tokens that occur once (what the next token is new with, by Good and Turing).  After a
context u: max(c(uv) - D, 0) / c(u) + D * successors(u) / c(u) * P(v), D = n1 / (n1 + 2 n2).
"""
from __future__ import annotations

import json
import mmap
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain
from urllib.parse import urlparse

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, shared_path, slices, texts, tidy

#: The end of a text, which also stands before its first word; no word holds white space.
END = b"\n"
#: Distinct words, or bigrams, that a task counts before it hands on a run.
RUN_WORDS, RUN_PAIRS = 1 << 20, 1 << 23
#: Steps of a quantised logarithm: 255 of them reach down to 1e-10.
STEP = 10 / 255

U64 = np.uint64


# --- arrays in files -----------------------------------------------------------------------------

def write_arrays(path: str, arrays: dict[str, np.ndarray], **numbers: float) -> None:
    """Arrays in one file, each at a multiple of 8 bytes, behind a JSON header."""
    from pyarrow import fs as pafs

    files, name = pafs.FileSystem.from_uri(path)
    files.create_dir(name.rpartition("/")[0], recursive=True)
    head = json.dumps({"arrays": [(k, a.dtype.str, len(a)) for k, a in arrays.items()], "numbers": numbers}).encode()
    head += b" " * (-(len(head) + 8) % 8)
    with files.open_output_stream(name) as out:
        out.write(len(head).to_bytes(8, "little") + head)
        for a in arrays.values():
            out.write(a.tobytes() + b"\0" * (-a.nbytes % 8))


def map_arrays(path: str) -> dict[str, np.ndarray | float]:
    """What ``write_arrays`` wrote: mapped where the shared folder is mounted, else read."""
    if urlparse(path).scheme in ("", "file"):
        with open(urlparse(path).path, "rb") as f:
            raw = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
    else:
        from pyarrow import fs as pafs

        files, name = pafs.FileSystem.from_uri(path)
        with files.open_input_file(name) as f:
            raw = f.read()
    at = 8 + int.from_bytes(raw[:8], "little")
    head = json.loads(raw[8:at])
    out: dict[str, np.ndarray | float] = dict(head["numbers"])
    for k, kind, n in head["arrays"]:
        out[k] = np.frombuffer(raw, kind, n, at)
        at += -(-out[k].nbytes // 8) * 8
    return out


# --- Elias-Fano sequences ------------------------------------------------------------------------

def pack_low(values: np.ndarray, width: int) -> np.ndarray:
    """The low ``width`` bits of each value, without gaps, and a spare word."""
    out = np.zeros(len(values) * width // 64 + 2, U64)
    if width:
        at = np.arange(len(values), dtype=np.int64) * width
        low, shift = values & U64((1 << width) - 1), (at & 63).astype(U64)
        # the bits of values that share a word don't overlap: sums are unions
        np.add.at(out, at >> 6, low << shift)
        over = (at & 63) + width > 64
        np.add.at(out, (at[over] >> 6) + 1, low[over] >> (U64(64) - shift[over]))
    return out


def get_low(packed: np.ndarray, index: np.ndarray, width: int) -> np.ndarray:
    if not width:
        return np.zeros(len(index), U64)
    at = index * width
    word, shift = at >> 6, (at & 63).astype(U64)
    high = np.where(shift > 0, packed[word + 1] << ((U64(64) - shift) & U64(63)), U64(0))
    return (packed[word] >> shift | high) & U64((1 << width) - 1)


def encode_sequence(values: np.ndarray, universe: int, name: str) -> tuple[dict[str, np.ndarray], dict[str, int]]:
    """A sequence that never falls, of values below ``universe``: low bits, high bits in unary (a one for
    each value, a zero at the end of each high part) and the zeros before each word of those."""
    n = len(values)
    width = max(0, int(universe // max(1, n)).bit_length() - 1)
    tops = (values >> U64(width)).astype(np.int64)
    bits = n + (int(universe) >> width) + 1
    high = np.zeros(bits // 64 + 1, U64)
    at = tops + np.arange(n)
    np.bitwise_or.at(high, at >> 6, U64(1) << (at & 63).astype(U64))
    zeros = np.concatenate([[0], np.cumsum(64 - np.bitwise_count(high).astype(np.int64))])[:-1]
    return ({f"{name}_low": pack_low(values, width), f"{name}_high": high, f"{name}_zeros": zeros.astype(np.uint32 if bits < 1 << 32 else np.uint64)},
            {f"{name}_n": n, f"{name}_width": width})


def select_in_word(words: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Place of the one bit number ``rank`` in each word."""
    place, rank, words = np.zeros(len(words), np.int64), rank.copy(), words.copy()
    for s in (32, 16, 8, 4, 2, 1):
        ones = np.bitwise_count(words & U64((1 << s) - 1)).astype(np.int64)
        go = rank >= ones
        rank -= np.where(go, ones, 0)
        place += np.where(go, s, 0)
        words = np.where(go, words >> U64(s), words)
    return place


class Sequence:
    """Reads ``encode_sequence``'s arrays, for many queries at once."""

    def __init__(self, arrays: dict, name: str) -> None:
        self.low, self.high, self.zeros = (arrays[f"{name}_{k}"] for k in ("low", "high", "zeros"))
        self.n, self.width = int(arrays[f"{name}_n"]), int(arrays[f"{name}_width"])
        # the ones before each word; the zeros stay in the file
        self.ones = np.arange(0, 64 * len(self.zeros), 64, dtype=self.zeros.dtype) - self.zeros

    def _zero(self, k: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.zeros, k.astype(self.zeros.dtype), "right") - 1
        return word * 64 + select_in_word(~self.high[word], k - self.zeros[word].astype(np.int64))

    def get(self, k: np.ndarray) -> np.ndarray:
        """Value number k."""
        word = np.searchsorted(self.ones, k.astype(self.ones.dtype), "right") - 1
        at = word * 64 + select_in_word(self.high[word], k - self.ones[word].astype(np.int64))
        return (at - k) << self.width | get_low(self.low, k, self.width).astype(np.int64)

    def find(self, values: np.ndarray) -> np.ndarray:
        """Place of each value, -1 where there is none: the run of its high part, then its low bits."""
        out = np.full(len(values), -1, np.int64)
        if not self.n:
            return out
        tops = (values >> U64(self.width)).astype(np.int64)
        stop = self._zero(tops) - tops
        at = np.where(tops > 0, self._zero(np.maximum(tops - 1, 0)) - tops + 1, 0)
        # a run is sorted by its low bits, and a frequent context's runs are long: halve them
        low, end, left = values & U64((1 << self.width) - 1), stop.copy(), np.flatnonzero(at < stop)
        while len(left):
            middle = (at[left] + end[left]) // 2
            less = get_low(self.low, middle, self.width) < low[left]
            at[left[less]] = middle[less] + 1
            end[left[~less]] = middle[~less]
            left = left[at[left] < end[left]]
        ask = np.flatnonzero(at < stop)
        hit = ask[get_low(self.low, at[ask], self.width) == low[ask]]
        out[hit] = at[hit]
        return out


# --- sorted runs ---------------------------------------------------------------------------------

def squeeze(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """A sorted run: differences and counts by byte planes, most of them zero, compressed."""
    planes = [np.diff(keys, prepend=U64(0)).view(np.uint8).reshape(-1, 8).T, counts.astype(np.uint64).view(np.uint8).reshape(-1, 8).T]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(p.tobytes() for p in planes))


def unsqueeze(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(2, 8, -1)
    keys, counts = (np.ascontiguousarray(p.T).view(U64).reshape(-1) for p in raw)
    return np.cumsum(keys, dtype=U64), counts


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(keys) else counts


def runs(keys: np.ndarray, counts: np.ndarray, shards: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """A sorted run cut where its (also sorted) shard changes."""
    cuts = np.flatnonzero(np.concatenate([[True], shards[1:] != shards[:-1], [True]]))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield int(shards[a]), squeeze(keys[a:b], counts[a:b])


# --- the model -----------------------------------------------------------------------------------

def hashes(words: Iterable[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), U64)


def distinct_words(frame: pd.DataFrame) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct words of a frame's texts, each token's index among them and each text's token
    count; an end follows every text, and number 0 is the end."""
    split = [t.encode("utf-8", "replace").lower().split() for t in frame["text"]]
    number: dict[bytes, int] = {END: 0}
    for words in split:
        for w in words:
            if w not in number:
                number[w] = len(number)
    lengths = np.array([len(w) + 1 for w in split])
    index = np.fromiter(chain.from_iterable(chain(map(number.__getitem__, w), (0,)) for w in split), np.int64, int(lengths.sum()))
    return list(number), index, lengths


@dataclass
class Model:
    """Where the files are and what holds for all of them; the files hold the rest."""

    shard_bits: int
    words: int
    tokens: int
    unknown: float
    discount: float
    paths: tuple[str, ...]  # level 1 by shard; empty: no word
    firsts: tuple[int, ...]  # first id by shard
    pair_paths: tuple[str, ...] = ()

    def shard(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> U64(64 - self.shard_bits)).astype(np.int64)

    def lookup(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Id (-1: unknown) and training count of each word."""
        order = np.argsort(hashes)
        ids, counts = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        own = hashes[order]
        cuts = np.searchsorted(self.shard(own), np.arange((1 << self.shard_bits) + 1))
        for k, path in enumerate(self.paths):
            a, b = cuts[k], cuts[k + 1]
            if a == b or not path:
                continue
            level = mapped(path)
            at = np.minimum(np.searchsorted(level["hashes"], own[a:b]), len(level["hashes"]) - 1)
            hit = level["hashes"][at] == own[a:b]
            to = order[a:b][hit]
            ids[to], counts[to] = self.firsts[k] + at[hit], level["counts"][at[hit]]
        return ids, counts

    def unigram(self, counts: np.ndarray) -> np.ndarray:
        known = (1 - self.unknown) * counts / max(1, self.tokens)
        return np.where(counts > 0, known, self.unknown)

    def pair_scores(self, context: np.ndarray, context_count: np.ndarray, word: np.ndarray, word_count: np.ndarray) -> np.ndarray:
        """log10 P(word | context) for ids sorted by context."""
        back = self.unigram(word_count)
        seen = np.zeros(len(context))
        share = np.ones(len(context))
        cuts = np.searchsorted(context, [*self.firsts, self.words])
        for k, path in enumerate(self.pair_paths):
            a, b = cuts[k], cuts[k + 1]
            if a == b or not path:
                continue
            level, successors, pointers = mapped_pairs(path)
            rel, own = context[a:b] - self.firsts[k], word[a:b]
            start, stop = pointers.get(rel), pointers.get(rel + 1)
            share[a:b] = np.where(stop > start, self.discount * (stop - start) / context_count[a:b], 1)
            ask = np.flatnonzero((own >= 0) & (stop > start))
            at = successors.find((rel[ask] * self.words + own[ask]).astype(U64))
            hit = at >= 0
            seen[a + ask[hit]] = 10 ** (-STEP * level["codes"][at[hit]].astype(float))
        return np.log10(seen + share * back)


@lru_cache(maxsize=512)
def mapped(path: str) -> dict:
    return map_arrays(path)


@lru_cache(maxsize=512)
def mapped_pairs(path: str) -> tuple[dict, Sequence, Sequence]:
    level = map_arrays(path)
    return level, Sequence(level, "successors"), Sequence(level, "pointers")


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))


def train(docs: DataFrame) -> Model:
    """Count ``docs`` (doc_id, text: every row is counted) and write the trie.

    What reaches the driver is a row of totals for each shard; there are about as many shards as
    shuffle partitions.
    """
    spark = docs.sparkSession
    folder = shared_path(spark, "lm")
    bits = max(2, (int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())
    count = 1 << bits

    @tidy
    def count_words(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()

        def run() -> pd.DataFrame:
            keys, counts = summed(hashes(seen), np.fromiter(seen.values(), U64))
            return pd.DataFrame(list(runs(keys, counts, keys >> U64(64 - bits))), columns=["shard", "run"])

        for frame in slices(frames):
            for t in frame["text"]:
                seen.update(t.encode("utf-8", "replace").lower().split())
            seen[END] += len(frame)
            if len(seen) > RUN_WORDS:
                yield run()
                seen.clear()
        if seen:
            yield run()

    def merge_words(frame: pd.DataFrame) -> pd.DataFrame:
        parts = [unsqueeze(r) for r in frame["run"]]
        keys, counts = summed(*map(np.concatenate, zip(*parts, strict=True)))
        path = f"{folder}/words-{frame['shard'].iloc[0]:06d}-{uuid.uuid4().hex}"
        write_arrays(path, {"hashes": keys, "counts": counts})
        return pd.DataFrame({"shard": frame["shard"].iloc[:1], "path": path, "n": len(keys), "tokens": counts.sum(),
                             "once": (counts == 1).sum()})

    plain = docs.select("text")
    words = materialize(plain.mapInPandas(count_words, "shard int, run binary").groupBy("shard")
                        .applyInPandas(merge_words, "shard int, path string, n long, tokens long, once long"), "lm-words")
    found = {r["shard"]: r for r in words.collect()}
    sizes = [found[k]["n"] if k in found else 0 for k in range(count)]
    tokens, once = (sum(r[c] for r in found.values()) for c in ("tokens", "once"))
    model = Model(bits, sum(sizes), tokens, max(once, 1) / (tokens + 1) if tokens else 1.0, 0.5,
                  tuple(found[k]["path"] if k in found else "" for k in range(count)),
                  tuple(int(x) for x in np.cumsum([0, *sizes])[:-1]))

    @tidy
    def count_pairs(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        firsts = np.array(model.firsts[1:])

        def run(keys: np.ndarray, counts: np.ndarray) -> pd.DataFrame:
            shards = np.searchsorted(firsts, (keys // U64(model.words)).astype(np.int64), "right")
            return pd.DataFrame(list(runs(keys, counts, shards)), columns=["shard", "run"])

        def merged() -> tuple[np.ndarray, np.ndarray]:
            return summed(*map(np.concatenate, zip(*held, strict=True)))

        for frame in slices(frames):
            own, index, _ = distinct_words(frame)
            ids = model.lookup(hashes(own))[0][index]
            keys = np.concatenate([ids[-1:], ids[:-1]]).astype(U64) * U64(model.words) + ids.astype(U64)
            held.append(np.unique(keys, return_counts=True))
            held[-1] = (held[-1][0], held[-1][1].astype(U64))
            if sum(len(k) for k, _ in held) > RUN_PAIRS:
                held = [merged()]
                if len(held[0][0]) > RUN_PAIRS // 2:
                    yield run(*held[0])
                    held = []
        if held:
            yield run(*merged())

    def merge_pairs(frame: pd.DataFrame) -> pd.DataFrame:
        parts = [unsqueeze(r) for r in frame["run"]]
        keys, counts = summed(*map(np.concatenate, zip(*parts, strict=True)))
        shard = int(frame["shard"].iloc[0])
        path = f"{folder}/counts-{shard:06d}-{uuid.uuid4().hex}"
        write_arrays(path, {"keys": keys, "counts": counts})
        return pd.DataFrame({"shard": [shard], "path": [path], "once": [(counts == 1).sum()], "twice": [(counts == 2).sum()]})

    @tidy
    def build(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for shard, counted in zip(frame["shard"], frame["path"], strict=True):
                got, level, first = map_arrays(counted), mapped(model.paths[shard]), model.firsts[shard]
                contexts = (got["keys"] // U64(model.words)).astype(np.int64) - first
                n = len(level["counts"])
                starts = np.searchsorted(contexts, np.arange(n + 1)).astype(U64)
                p = np.maximum(got["counts"] - model.discount, 1e-12) / level["counts"][contexts]
                codes = np.clip(np.rint(-np.log10(p) / STEP), 0, 255).astype(np.uint8)
                arrays, numbers = encode_sequence(got["keys"] - U64(first * model.words), n * model.words, "successors")
                more, sizes = encode_sequence(starts, len(codes) + 1, "pointers")
                path = f"{folder}/pairs-{shard:06d}-{uuid.uuid4().hex}"
                write_arrays(path, arrays | more | {"codes": codes}, **numbers, **sizes)
                yield pd.DataFrame({"shard": [shard], "path": [path]})

    if not model.words:
        return model
    if model.words**2 >= 1 << 63:
        raise OverflowError(f"{model.words} distinct words: a pair of ids no longer fits 63 bits")
    counted = materialize(plain.mapInPandas(count_pairs, "shard int, run binary").groupBy("shard")
                          .applyInPandas(merge_pairs, "shard int, path string, once long, twice long"), "lm-counts")
    once, twice = counted.agg(F.sum("once"), F.sum("twice")).first()
    model.discount = min(0.99, max(0.05, once / max(1, once + 2 * twice)))
    built = materialize(counted.select("shard", "path").repartition(count, "shard")
                        .mapInPandas(build, "shard int, path string"), "lm-pairs")
    paths = {r["shard"]: r["path"] for r in built.collect()}
    model.pair_paths = tuple(paths.get(k, "") for k in range(count))
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Scores of every whole text: n_tokens, n_known, base_score (add-one unigrams), score (the trie)."""
    @tidy
    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = model.tokens + model.words + 1
        for frame in slices(frames):
            words, index, lengths = distinct_words(frame)
            ids, counts = model.lookup(hashes(words))
            base = np.log10((counts + 1) / total)
            before = np.concatenate([index[-1:], index[:-1]])
            # distinct pairs, by the context's id
            pairs, back = np.unique((ids[before] + 1) * (len(words)) + index, return_inverse=True)
            context, word = pairs // len(words) - 1, pairs % len(words)
            rank = np.argsort(ids, kind="stable")
            context_count = np.ones(len(pairs), np.int64)
            known = context >= 0
            context_count[known] = counts[rank][np.searchsorted(ids[rank], context[known])]
            logs = model.pair_scores(context, context_count, ids[word], counts[word])
            at = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            yield pd.DataFrame({
                "doc_id": frame["doc_id"].astype("Int64").array, "held_out": frame["held_out"].to_numpy(),
                "n_tokens": lengths, "n_known": np.add.reduceat((counts > 0)[index].astype(np.int64), at),
                "train_tokens": model.tokens, "base_score": np.add.reduceat(base[index], at), "score": np.add.reduceat(logs[back], at)})

    return docs.mapInPandas(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def language_model_scores(docs: DataFrame) -> DataFrame:
    """Train on the rows of ``docs`` outside the held-out seventh, score all of them.

    Null texts are empty: one end token.  Rows without a doc_id train.  Repeated rows count each time.
    With no row to train on every token is unknown and scores 0.
    """
    own = texts(docs, held_out().alias("held_out"))
    return score(own, train(own.filter(~F.col("held_out"))))
