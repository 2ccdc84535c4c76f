"""Byte-level BPE in numpy: encoding by ranks, and decoding.

Distinct pieces of about the same length form one padded matrix of token ids.  In every round each
row merges its leftmost pair of least rank; ranks come from a hash table over pairs of ids, and rows
without a pair to merge leave the matrix.  A task encodes only the words that it has not met lately.
"""
from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame

from .common import slices, texts

#: White space as the Unicode property has it; other libraries' \s differs in control characters.
SPACE = r"\t-\r \x85\xa0  -     　"
NONE = np.int32(2**31 - 1)
#: Longer pieces merge by a heap: a matrix row that long would take as many rounds as it has bytes.
LONG = 256


def read_ranks(path: str) -> list[bytes]:
    """Token bytes by id."""
    with open(path, "rb") as f:
        found = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, f)}
    return [found[i] for i in range(len(found))]


class PairTable:
    """Open addressing over (left id, right id): the id, which is the rank, of what they make."""

    def __init__(self, tokens: list[bytes]) -> None:
        ids = {t: i for i, t in enumerate(tokens)}
        pairs = [(ids[t[:k]], ids[t[k:]], i) for i, t in enumerate(tokens) for k in range(1, len(t)) if t[:k] in ids and t[k:] in ids]
        rows = np.array(pairs, np.uint64).reshape(-1, 3)
        self.bits = max(4, int(2 * len(rows)).bit_length())
        self.keys = np.full(1 << self.bits, np.uint64(2**64 - 1))
        self.values = np.full(1 << self.bits, NONE, np.int32)
        keys, values = rows[:, 0] << np.uint64(32) | rows[:, 1], rows[:, 2].astype(np.int32)
        slot = self._slot(keys)
        while len(keys):  # of those that want a free slot one gets it, the rest go on
            free = self.keys[slot] == np.uint64(2**64 - 1)
            self.keys[slot[free]] = keys[free]
            won = self.keys[slot] == keys
            self.values[slot[won]] = values[won]
            keys, values, slot = keys[~won], values[~won], (slot[~won] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE where it makes no token; a negative id is padding."""
        keys = left.astype(np.uint64) << np.uint64(32) | (right.astype(np.uint64) & np.uint64(0xFFFFFFFF))
        shape, keys = keys.shape, keys.reshape(-1)
        out = np.full(len(keys), NONE, np.int32)
        at = np.flatnonzero((left.reshape(-1) >= 0) & (right.reshape(-1) >= 0))
        slot = self._slot(keys[at])
        while len(at):
            held = self.keys[slot]
            hit = held == keys[at]
            out[at[hit]] = self.values[slot[hit]]
            go = ~hit & (held != np.uint64(2**64 - 1))
            at, slot = at[go], (slot[go] + 1) & ((1 << self.bits) - 1)
        return out.reshape(shape)


class ByteBPE(dict):
    """Maps a word (with the space before it) to its ids as bytes; up to ``most`` words are kept."""

    def __init__(self, path: str, pattern: str, most: int = 1_000_000) -> None:
        super().__init__()
        self.tokens = read_ranks(path)
        self.ids = {t: i for i, t in enumerate(self.tokens)}
        self.pairs = PairTable(self.tokens)
        self.single = np.array([self.ids[bytes([b])] for b in range(256)], np.int32)
        self.decimal = [b"%d" % i for i in range(len(self.tokens))]
        self.most = most
        outside = re.sub(r"\\S", lambda _: f"[^{SPACE}]", re.sub(r"(\[\^?)\\s", lambda m: m[1] + SPACE, pattern))
        self.pieces = regex.compile(re.sub(r"\\s", lambda _: f"[{SPACE}]", outside))
        # whatever precedes it, a space before anything but white space begins a match
        self.cut = re.compile(f"(?= [^{SPACE}])")
        self.uncut = re.compile(f" (?:[{SPACE}]|\\Z)")

    def words(self, text: str) -> list[str]:
        """The text in parts that are split and merged alone."""
        if self.uncut.search(text):
            return self.cut.split(text)
        first, *more = text.split(" ")
        return [first, *(" " + w for w in more)]

    def learn(self, words: Iterable[str]) -> None:
        """Encode what is not there yet; every match of the pattern separately."""
        own = set(words)
        new = own - self.keys()
        if not new:
            return
        if len(self) + len(new) > self.most:
            self.clear()
            new = own  # the known ones went too
        new = sorted(new)
        split = [[p.encode() for p in self.pieces.findall(w)] for w in new]
        got = self.encode_pieces({p for parts in split for p in parts})
        for w, parts in zip(new, split, strict=True):
            self[w] = b"".join(got[p] for p in parts)

    def encode_pieces(self, pieces: Iterable[bytes]) -> dict[bytes, bytes]:
        out, buckets = {}, {}
        for p in pieces:
            if p in self.ids:
                out[p] = np.int32(self.ids[p]).tobytes()
            elif len(p) > LONG:
                out[p] = self.merge_long(p)
            else:
                buckets.setdefault(-(-len(p) // 4) * 4, []).append(p)  # lengths by fours
        for width, own in buckets.items():
            rows = max(1, (1 << 20) // width)
            for a in range(0, len(own), rows):
                part = own[a : a + rows]
                out.update(zip(part, self.merge(part, width), strict=True))
        return out

    def merge(self, pieces: list[bytes], width: int) -> list[bytes]:
        """Ids of pieces of at most ``width`` bytes, all at once."""
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(-1, width)
        length = np.array([len(p) for p in pieces])
        ids = np.where(np.arange(width) < length[:, None], self.single[raw], -1).astype(np.int32)
        ranks = self.pairs.ranks(ids[:, :-1], ids[:, 1:])
        row, out = np.arange(len(pieces)), [b""] * len(pieces)
        while len(row):
            at = ranks.argmin(axis=1)  # the first of the least
            n = np.arange(len(row))
            best = ranks[n, at]
            done = best == NONE
            if done.any():  # compaction
                for k in np.flatnonzero(done):
                    out[row[k]] = ids[k, : length[k]].tobytes()
                go = ~done
                row, ids, ranks, length, at, best = row[go], ids[go], ranks[go], length[go], at[go], best[go]
                n = np.arange(len(row))
                if not len(row):
                    break
            ids[n, at] = best
            keep = np.arange(ids.shape[1] - 1)
            ids = np.take_along_axis(ids, keep + (keep > at[:, None]), axis=1)
            length = length - 1
            ids[keep >= length[:, None]] = -1
            if ids.shape[1] < 2:
                ranks = np.full((len(row), 1), NONE, np.int32)
                continue
            keep = keep[:-1]
            ranks = np.take_along_axis(ranks, keep + (keep > at[:, None]), axis=1)
            ranks[keep >= length[:, None] - 1] = NONE
            for side in (at - 1, at):  # the pairs that the new id is part of
                ok = (side >= 0) & (side < ranks.shape[1])
                ranks[n[ok], side[ok]] = self.pairs.ranks(ids[n[ok], side[ok]], ids[n[ok], side[ok] + 1])
        return out

    def merge_long(self, piece: bytes) -> bytes:
        """The same for one long piece: a heap of (rank, place) over linked ids."""
        ids = self.single[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        token = [self.tokens[i] for i in ids]
        heap = [(r, k) for k in range(n - 1) if (r := self.ids.get(token[k] + token[k + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, k = heapq.heappop(heap)
            right = after[k]
            if not token[k] or right >= n or self.ids.get(token[k] + token[right]) != rank:
                continue
            token[k], ids[k], token[right] = token[k] + token[right], rank, b""
            after[k] = after[right]
            if after[k] < n:
                before[after[k]] = k
            for left in (before[k], k):
                if left >= 0 and after[left] < n and (r := self.ids.get(token[left] + token[after[left]])) is not None:
                    heapq.heappush(heap, (r, left))
        return np.array([i for i, t in zip(ids, token, strict=True) if t], np.int32).tobytes()

    def encode(self, words: list[str]) -> np.ndarray:
        """Ids of learnt words in turn."""
        return np.frombuffer(b"".join(map(self.__getitem__, words)), np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def byte_bpe(path: str, pattern: str) -> ByteBPE:
    """One per file of ranks and Python worker."""
    return ByteBPE(path, pattern)


def byte_bpe_round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encode every whole text and decode the ids again.

    doc_id, n_tokens, ids_sha256 (decimal ids joined by one space), decoded_sha256 (decoded bytes), a
    row for each row.  Null and empty texts have no ids; null doc_ids stay null.
    """
    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = byte_bpe(path, pattern)
        for frame in slices(frames, 3 << 20):
            split = [bpe.words(t) if t else [] for t in frame["text"]]
            bpe.learn(w for words in split for w in words)
            rows = []
            for words in split:
                ids = bpe.encode(words)
                shown = b" ".join(map(bpe.decimal.__getitem__, ids.tolist()))
                rows.append((len(ids), hashlib.sha256(shown).hexdigest(), hashlib.sha256(bpe.decode(ids)).hexdigest()))
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            out.insert(0, "doc_id", frame["doc_id"].astype("Int64").array)
            yield out

    return texts(docs).mapInPandas(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
