"""Toxicity by compression distance.

One zstandard dictionary is trained on toxic and one on ordinary text, both by zstandard's own trainer.
Most of what either class is made of is in the other as well and would only compress alike with both,
so each class' training text is first rid of the words that the other class has about as often.  Both
dictionaries begin with the same lead, which is also put before every window: a short window would
otherwise be stored uncompressed and show nothing.  A document is cut into windows of words, each window
is compressed with both, and what the toxic dictionary saves, summed up for the document, is turned into
a probability by a calibration fitted on labelled documents that its dictionaries have not seen.
"""
from __future__ import annotations

import random
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, strings, tidy

#: Training uses at most so many documents of each class, of at most so many characters each; the
#: model is fitted on the driver from these alone.
SAMPLE_DOCS = 1400
SAMPLE_CHARS = 32_768
WINDOW_WORDS = 5
#: Bytes that no text holds.
LEAD = bytes(random.Random(1).choices(range(1, 9), k=48))
#: The trainer's limits: bytes of a dictionary, of a segment and of the strings that it counts.
DICTIONARY_BYTES, SEGMENT, COUNTED = 4096, 32, 6
LEVEL, MATCH = 7, 5
#: The calibration's scores come from models fitted without the scored part, of so many.
FOLDS = 4
#: A document is rejected from this score on; of the sample's ordinary documents at most this share may be.
THRESHOLD, REJECTED = 0.7, 0.03
#: Lengths of the word beginnings that are counted to tell which words a class has more often.
BEGINNINGS = (5, 6, 7, 8, 10, 12, 16)


def windows(text: str) -> list[bytes]:
    words = text.encode("utf-8", "replace").lower().split()
    return [LEAD + b" " + b" ".join(words[i : i + WINDOW_WORDS]) + b" " for i in range(0, len(words), WINDOW_WORDS)]


def beginnings(text: str) -> set[bytes]:
    """Words, and their beginnings, with the space before."""
    found = set()
    for word in set(text.encode("utf-8", "replace").lower().split()):
        word = b" " + word + b" "
        found.update(word[:k] for k in BEGINNINGS if len(word) >= k)
    return found


def contrast(of: Counter, other: Counter) -> dict[bytes, float]:
    """How far each string's document count exceeds the other class's, in standard deviations."""
    return {s: (n - other[s]) / (n + other[s] + 1) ** 0.5 for s, n in of.items() if n > other[s]}


def marks(own: list[str], others: list[str]) -> set[bytes]:
    """Beginnings of words that more documents of the first class have than of the other, by more than
    chance shows in the other direction; as many documents of either are counted."""
    n = min(len(own), len(others))
    of, other = Counter(), Counter()
    for t in own[:n]:
        of.update(beginnings(t))
    for t in others[:n]:
        other.update(beginnings(t))
    found, chance = contrast(of, other), max(contrast(other, of).values(), default=0.0)
    return {s for s, x in found.items() if x >= 1.15 * chance}


def marked_text(text: str, own: set[bytes]) -> bytes:
    """The words of a text that begin so."""
    words = [b" " + w + b" " for w in text.encode("utf-8", "replace").lower().split()]
    return b"".join(w[:-1] for w in words if any(w[:k] in own for k in BEGINNINGS if len(w) >= k))


def trained(own: list[str], others: list[str]) -> bytes:
    """A dictionary trained on the first class' text; the text itself if that is too little to train on."""
    import zstandard

    found = marks(own, others)
    samples = [x for t in own if len(x := marked_text(t, found)) >= 8] if found else []
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=SEGMENT, d=COUNTED, level=3).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:]


@dataclass
class Model:
    """Both dictionaries and the calibration; small enough to travel with each task."""

    toxic: bytes = b""
    ordinary: bytes = b""
    weights: tuple[float, ...] = ()

    def compressors(self) -> tuple:
        import zstandard

        made = []
        for raw in (self.toxic, self.ordinary):
            p = zstandard.ZstdCompressionParameters.from_level(
                LEVEL, dict_size=len(raw), source_size=400, min_match=MATCH, write_checksum=False,
                write_content_size=False, write_dict_id=False)
            # as plain content: trained entropy tables would tell apart letters and not words
            d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=p)
            made.append(zstandard.ZstdCompressor(dict_data=d, compression_params=p).compress)
        return tuple(made)

    def features(self, compressors: tuple, text: str) -> tuple[float, ...]:
        """Saved bytes for 100 bytes of text, share of windows that save, mean of the best quarter, best."""
        toxic, ordinary = compressors
        found = windows(text)
        if not found:
            return 0.0, 0.0, 0.0, 0.0
        saved = np.maximum([len(ordinary(w)) - len(toxic(w)) for w in found], 0)
        best = np.sort(saved)[-max(1, len(saved) // 4) :]
        return 100 * saved.sum() / max(100, sum(len(w) - len(LEAD) for w in found)), (saved > 0).mean(), best.mean(), float(best[-1])

    def scores(self, texts: Iterable[str]) -> np.ndarray:
        """One text and its windows are held at a time."""
        if not self.weights:
            return np.zeros(sum(1 for _ in texts))
        compressors = self.compressors()
        rows = np.array([self.features(compressors, t) for t in texts], float).reshape(-1, 4)
        return 1 / (1 + np.exp(-np.clip(design(rows) @ np.array(self.weights), -30, 30)))


def design(rows: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(rows)), np.minimum(rows[:, 0], 4), np.sqrt(np.minimum(rows[:, 0], 4)),
                            rows[:, 1], np.minimum(rows[:, 2], 8)])


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Weighted logistic regression by Newton's steps with a small ridge."""
    beta = np.zeros(x.shape[1])
    penalty = ridge * np.eye(x.shape[1])
    penalty[0, 0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        w = weight * np.maximum(p * (1 - p), 1e-6)
        step = np.linalg.solve(x.T @ (w[:, None] * x) + penalty, x.T @ (weight * (y - p)) - penalty @ beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def dictionaries(toxic: list[str], ordinary: list[str]) -> Model:
    both = [trained(toxic, ordinary), trained(ordinary, toxic)]
    size = max(map(len, both))  # equally long, so that the lead is as far away in either
    fill = bytes(random.Random(5).choices(range(1, 9), k=size))
    return Model(*(LEAD + fill[len(x) :] + x for x in both))


def fit(toxic: list[str], ordinary: list[str], toxic_share: float) -> Model:
    """Dictionaries from all the sample; the calibration from each part seen by the other parts'
    dictionaries.  No model without two documents of each class."""
    if min(len(toxic), len(ordinary)) < 2:
        return Model()
    folds = min(FOLDS, len(toxic), len(ordinary))
    model, rows, y = dictionaries(toxic, ordinary), [], []
    for k in range(folds):
        parts = [([t for i, t in enumerate(c) if i % folds != k], c[k::folds]) for c in (toxic, ordinary)]
        own = dictionaries(parts[0][0], parts[1][0])
        compressors = own.compressors()
        for label, (_, unseen) in zip((1.0, 0.0), parts, strict=True):
            rows += [model.features(compressors, t) for t in unseen]
            y += [label] * len(unseen)
    y = np.array(y)
    weight = np.where(y == 1, toxic_share / len(toxic), (1 - toxic_share) / len(ordinary)) * len(y)
    x = design(np.array(rows, float))
    beta = logistic(x, y, weight)
    beta[0] += np.log(THRESHOLD / (1 - THRESHOLD)) - best_cut(x @ beta, y, weight)
    model.weights = tuple(beta.tolist())
    return model


def best_cut(value: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The value from which on rejecting gives the best F1, halfway to the next lower one, among those
    that reject no more than the allowed share of ordinary documents."""
    order = np.argsort(-value, kind="stable")
    v, hit, miss = value[order], np.cumsum((weight * y)[order]), np.cumsum((weight * (1 - y))[order])
    f1 = 2 * hit / (hit + miss + hit[-1])
    last = np.append(v[1:] < v[:-1], True)  # equal values go together
    allowed = last & (miss <= REJECTED * miss[-1])
    if not allowed.any():
        return float(v[0]) + 1.0
    k = int(np.argmax(np.where(allowed, f1, -1)))
    return float((v[k] + v[k + 1]) / 2) if k + 1 < len(v) else float(v[k]) - 1.0


def held_out(column: str = "doc_id"):
    """Rows that training never sees: crc32 of the id's text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> Model:
    """Fit a model on labelled documents outside the held-out third.

    The sample is bounded by its two parameters and is the same in every run (lowest hashes of the
    ids).  Null ids, labels and texts take no part; an id with several labels counts as toxic if one
    says so, and with several texts it gives the first in order.
    """
    own = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
           .dropna().filter(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    share = own.agg(F.avg("toxic")).first()[0] or 0.0
    lengths = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.length("text").alias("n")).filter(F.col("n") <= sample_chars)
    usable = own.join(lengths, "doc_id", "left_semi")
    by_hash = (F.xxhash64("doc_id"), F.col("doc_id"))
    ids = [usable.filter(F.col("toxic") == k).orderBy(*by_hash).limit(sample_docs) for k in (1, 0)]
    chosen = ids[0].unionByName(ids[1])  # at most 2 * sample_docs ids
    found = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
             .filter(F.length("text") <= sample_chars)
             .groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).orderBy(*by_hash).collect())
    return fit([r["text"] for r in found if r["toxic"] == 1], [r["text"] for r in found if r["toxic"] == 0],
               min(max(share, 1e-3), 1 - 1e-3))


def score(model: Model):
    """A column function: the score, 0 to 1, of a text column; null and empty texts score as no window."""
    @F.arrow_udf("double")
    @tidy
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(model.scores(strings(texts)))

    return scored


def keep_ordinary(docs: DataFrame, labels: DataFrame, **sample: int) -> DataFrame:
    """``docs``, all columns, without the rows whose score reaches the threshold; null and empty texts stay."""
    small_batches(docs.sparkSession)
    model = train(docs, labels, **sample)
    scored = docs.withColumn("_llm_score", score(model)(F.col("text").cast("string")))
    return scored.filter(F.col("_llm_score") < THRESHOLD).select(*docs.columns)


def toxicity(docs: DataFrame, labels: DataFrame, **sample: int) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``, from its whole text alone."""
    small_batches(docs.sparkSession)
    model = train(docs, labels, **sample)
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"),
                         score(model)(F.col("text").cast("string")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
