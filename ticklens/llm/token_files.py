"""Token ids in bit-packed files.

A file holds the ids of consecutive documents.  Every id takes the least number of bits that any id
of the vocabulary needs; 64 ids fill exactly ``bits`` words of 64 bits, so packing and unpacking are
a few numpy operations for each of 64 columns.  Ids are cut into blocks and the header holds every
block's byte offset, so that any range of ids is read without the rest.

Layout, little-endian: ``MAGIC``, then int64 bits, block_ids, n_docs, n_ids, n_blocks; int64 doc_id
[n_docs]; uint8 doc_id-is-null [n_docs]; int64 first id of each document [n_docs + 1]; int64 byte
offset of each block [n_blocks + 1]; the blocks.
"""
from __future__ import annotations

import io
import uuid
import zlib
from collections.abc import Iterable, Iterator
from typing import BinaryIO

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, shared_path, slices, texts
from .word_ids import word_ids

MAGIC = b"TLIDS1\0\0"
BLOCK_IDS = 8192
END_ID = 2


def bits_for(vocabulary: int) -> int:
    """Bits that the largest of ``vocabulary`` ids needs."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> np.ndarray:
    """Ids to 64-bit words, the first id in the lowest bits; padded with id 0 to a multiple of 64."""
    padded = np.zeros(-(-len(ids) // 64) * 64, np.uint64)
    padded[: len(ids)] = ids
    columns = np.ascontiguousarray(padded.reshape(-1, 64).T)
    out = np.zeros((bits, columns.shape[1]), np.uint64)
    for j in range(64):
        word, shift = divmod(j * bits, 64)
        out[word] |= columns[j] << np.uint64(shift)
        if shift + bits > 64:
            out[word + 1] |= columns[j] >> np.uint64(64 - shift)
    return np.ascontiguousarray(out.T).reshape(-1)


def unpack(words: np.ndarray, bits: int, n: int) -> np.ndarray:
    """The first ``n`` ids of what ``pack`` gave."""
    columns = np.ascontiguousarray(words.reshape(-1, bits).T)
    out = np.empty((64, columns.shape[1]), np.uint32)
    mask = np.uint64((1 << bits) - 1)
    for j in range(64):
        word, shift = divmod(j * bits, 64)
        got = columns[word] >> np.uint64(shift)
        if shift + bits > 64:
            got |= columns[word + 1] << np.uint64(64 - shift)
        out[j] = got & mask
    return np.ascontiguousarray(out.T).reshape(-1)[:n]


def write_file(out: BinaryIO, doc_ids: list[int | None], lengths: list[int], ids: np.ndarray, bits: int) -> None:
    """One file of whole documents; ``ids`` are theirs in turn."""
    if len(ids) and int(ids.max()) >= 1 << bits:
        raise ValueError(f"id {int(ids.max())} needs more than {bits} bits")
    blocks = [pack(ids[a : a + BLOCK_IDS], bits) for a in range(0, len(ids), BLOCK_IDS)]
    ends = np.cumsum([0, *(b.nbytes for b in blocks)], dtype="<i8")
    out.write(MAGIC)
    out.write(np.array([bits, BLOCK_IDS, len(doc_ids), len(ids), len(blocks)], "<i8").tobytes())
    out.write(np.array([d or 0 for d in doc_ids], "<i8").tobytes())
    out.write(np.array([d is None for d in doc_ids], "u1").tobytes())
    out.write(np.cumsum([0, *lengths], dtype="<i8").tobytes())
    out.write(ends.tobytes())
    for b in blocks:
        out.write(b.astype("<u8").tobytes())


class TokenFile:
    """Reads a file of ``write_file``: documents and any range of ids."""

    def __init__(self, f: BinaryIO) -> None:
        self.f = f
        if f.read(8) != MAGIC:
            raise ValueError("not a token file")
        self.bits, self.block_ids, n_docs, self.n_ids, n_blocks = map(int, self._ints(5))
        doc_ids, null = self._ints(n_docs), np.frombuffer(f.read(n_docs), "u1")
        self.doc_ids = [None if no else int(d) for d, no in zip(doc_ids, null, strict=True)]
        self.starts = self._ints(n_docs + 1)
        self.blocks = self._ints(n_blocks + 1)
        self.data = 8 + 40 + 9 * n_docs + 8 * (n_docs + 1) + 8 * (n_blocks + 1)

    def _ints(self, n: int) -> np.ndarray:
        return np.frombuffer(self.f.read(8 * n), "<i8")

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` of the file, reading only the blocks that hold them."""
        if start >= stop:
            return np.empty(0, np.uint32)
        a, b = start // self.block_ids, -(-stop // self.block_ids)
        self.f.seek(self.data + int(self.blocks[a]))
        raw = self.f.read(int(self.blocks[b] - self.blocks[a]))
        words, first, parts = np.frombuffer(raw, "<u8"), int(self.blocks[a]), []
        for k in range(a, b):
            own = words[(int(self.blocks[k]) - first) // 8 : (int(self.blocks[k + 1]) - first) // 8]
            parts.append(unpack(own, self.bits, min(self.block_ids, self.n_ids - k * self.block_ids)))
        return np.concatenate(parts)[start - a * self.block_ids : stop - a * self.block_ids]

    def document(self, k: int) -> np.ndarray:
        """Ids of the file's document number ``k``."""
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))


def write_token_files(docs: DataFrame, vocabulary: str, end_id: int = END_ID, file_ids: int = 4 << 20) -> DataFrame:
    """Encode every whole text, append ``end_id`` and write files in ascending doc_id order.

    Documents are range-partitioned by doc_id and each task writes its range as files of about
    ``file_ids`` ids (a longer document has a file of its own).  A file's name is new for each
    attempt and only the rows that finished tasks return name files, so a lost or repeated task
    leaves nothing that counts.  Returns the list of files, itself stored: part (order of the
    ranges), seq (order within one), path, n_docs, n_ids.

    Null text is empty (the end id alone); null doc_ids come first; repeated doc_ids are ordered by
    text and equal rows each keep a place; no documents give no files.
    """
    spark = docs.sparkSession
    folder = shared_path(spark, "ids")

    def write(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs as pafs

        words = word_ids(vocabulary)
        bits = bits_for(max(words.tokenizer.get_vocab_size(with_added_tokens=True), end_id + 1))
        end = np.array([end_id], "<u4").tobytes()
        files, base = pafs.FileSystem.from_uri(folder)
        files.create_dir(base, recursive=True)
        task = TaskContext.get()
        part, seq = task.partitionId(), 0
        doc_ids: list[int | None] = []
        buffers: list[bytes] = []
        held = 0

        def flush() -> pd.DataFrame:
            name = f"{part:06d}-{seq:06d}-{task.taskAttemptId()}-{uuid.uuid4().hex}.ids"
            ids = np.frombuffer(b"".join(buffers), "<u4")
            with files.open_output_stream(f"{base}/{name}") as out:
                write_file(out, doc_ids, [len(b) // 4 for b in buffers], ids, bits)
            return pd.DataFrame({"part": [part], "seq": [seq], "path": [f"{folder}/{name}"],
                                 "n_docs": [len(doc_ids)], "n_ids": [len(ids)]})

        for frame in slices(frames):
            for doc_id, text in zip(frame["doc_id"].array, frame["text"].array, strict=True):
                doc_ids.append(None if pd.isna(doc_id) else int(doc_id))
                buffers.append(words.encode(text) + end)
                held += len(buffers[-1]) // 4
                if held >= file_ids:
                    yield flush()
                    seq, held, doc_ids, buffers = seq + 1, 0, [], []
        if doc_ids:
            yield flush()

    ranged = texts(docs).repartitionByRange(F.asc_nulls_first("doc_id")).sortWithinPartitions(
        F.asc_nulls_first("doc_id"), "text")
    # part numbers follow the ranges: tasks read the shuffle's partitions in order
    return materialize(ranged.mapInPandas(write, "part long, seq long, path string, n_docs long, n_ids long"), "files")


def read_token_files(files: DataFrame) -> DataFrame:
    """Rows of the documents in ``files``: doc_id, start (ids of all documents before it), n_tokens,
    ids_crc32 of the ids as little-endian unsigned 32-bit integers.  Every file is one row of work.

    The only thing that passes through the driver is one number for each range of the writer.
    """
    spark = files.sparkSession
    totals = files.groupBy("part").agg(F.sum("n_ids").alias("n"), F.count("*").alias("files")).orderBy("part").collect()
    tasks = max(1, sum(r["files"] for r in totals))  # a given number isn't coalesced by the rows' small size
    before, bases = 0, []
    for r in totals:
        bases.append((r["part"], before))
        before += r["n"]
    base = spark.createDataFrame(bases, "part long, base long")
    own = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    placed = (files.withColumn("inside", F.coalesce(F.sum("n_ids").over(own), F.lit(0)))
              .join(base, "part").select("path", (F.col("base") + F.col("inside")).alias("base"))
              .repartition(tasks, "path"))

    def read(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs as pafs

        for frame in frames:
            for path, first in zip(frame["path"], frame["base"], strict=True):
                source, name = pafs.FileSystem.from_uri(path)
                with source.open_input_file(name) as f:
                    got = TokenFile(io.BufferedReader(f, 1 << 20))
                    ids = got.ids(0, got.n_ids).astype("<u4")
                view, starts = memoryview(ids).cast("B"), got.starts
                yield pd.DataFrame({
                    "doc_id": pd.array(got.doc_ids, "Int64"),
                    "start": first + starts[:-1],
                    "n_tokens": np.diff(starts),
                    "ids_crc32": [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)],
                })

    return placed.mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Write ``docs`` as token files, then return what reading them back gives (see both above)."""
    return read_token_files(write_token_files(docs, vocabulary))
