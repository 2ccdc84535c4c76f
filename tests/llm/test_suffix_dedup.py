import hashlib
import random

import numpy as np
import pytest
from llm_edges import EDGES

from ticklens.llm import common
from ticklens.llm import suffix_dedup as sd


def brute(rows):
    """Rows in order: by doc_id (null first); rows of one id by a hash, which the callers avoid."""
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for s in range(len(raw) - sd.LENGTH + 1):
            p = raw[s:s + sd.LENGTH]
            if p in seen:
                gone[s:s + sd.LENGTH] = True
            seen.add(p)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int), [0]])) == 1)
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone])
        out.append((i, len(raw), int(gone.sum()), len(edges), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()), key=repr)


def corpus(seed, n=60):
    """Texts cut and pasted from each other, with periodic parts and other alphabets."""
    rng = random.Random(seed)
    pool = ["".join(rng.choices("abcdefgh é", k=rng.randint(50, 400))) for _ in range(8)] + ["ab" * 90, "x" * 150, "日本語テキスト" * 12]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randint(0, 5)):
            p = rng.choice(pool)
            a = rng.randrange(len(p))
            parts.append(p[a:a + rng.randint(60, 300)])
            if rng.random() < 0.5:
                parts.append("".join(rng.choices("abcdefgh", k=rng.randint(0, 80))))
        rows.append((i, "".join(parts)))
    return rows


@pytest.mark.parametrize("window", [1, 2, 3, 7, 8, 77])
def test_leftmost_least(window):
    v = np.random.default_rng(window).integers(0, 5, 300).astype(np.uint64)
    assert sd.leftmost_least(v, window).tolist() == [i + int(v[i:i + window].argmin()) for i in range(300 - window + 1)]


def test_every_passage_has_one_anchor():
    raws = [t.encode() for _, t in corpus(1)] + [b"", b"q" * 99, b"q" * 100]
    a = sd.anchors(raws)
    assert sorted((t, s) for t, lo, hi in zip(a["text"], a["lo"], a["hi"]) for s in range(lo, hi + 1)) == \
        [(t, s) for t, r in enumerate(raws) for s in range(len(r) - sd.LENGTH + 1)]


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("sizes", [(sd.HELD, sd.SORTED), (20, 300)])
def test_as_brute_force(docs_of, monkeypatch, seed, sizes):
    monkeypatch.setattr(sd, "HELD", sizes[0])
    monkeypatch.setattr(sd, "SORTED", sizes[1])
    rows = corpus(seed)
    docs = docs_of(rows).repartition(5)
    assert rows_of(sd.repeated_bytes(docs)) == brute(rows)


def test_edges(edges):
    rows = [r for r in EDGES if r != (2, "one")] + [(2, "one")] * 2
    got = rows_of(sd.repeated_bytes(edges))
    assert [r[:2] for r in got] == [r[:2] for r in brute(rows)]
    assert got == brute(rows)


def test_repeated_rows_and_ids(docs_of):
    text = "".join(random.Random(1).choices("abcdef ", k=500))
    got = rows_of(sd.repeated_bytes(docs_of([(4, text), (4, text), (4, text + "!"), (9, text), (None, text)])))
    assert [r[0] for r in got] == [4, 4, 4, 9, None]
    removed = {(r[0], r[1]): [] for r in got}
    for r in got:
        removed[r[0], r[1]].append(r[2])
    assert removed == {(None, 500): [0], (4, 500): [500, 500], (4, 501): [500], (9, 500): [500]}


def test_texts_and_empty(docs_of, nothing):
    text = "".join(random.Random(2).choices("abcdefé ", k=300))
    docs = docs_of([(1, text), (2, "<" + text + ">"), (3, None)])
    got = {r.doc_id: r.text for r in sd.remove_repeats(docs).collect()}
    assert got == {1: text, 2: "<>", 3: ""}
    assert sd.remove_repeats(docs).columns == docs.columns
    assert sd.repeated_bytes(nothing).collect() == [] and sd.remove_repeats(nothing).collect() == []


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    expected = brute(rows)
    assert rows_of(sd.repeated_bytes(docs)) == expected
    assert sum(r[2] for r in expected) > 0


def test_batches_are_bounded_by_bytes(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = spark.conf.get(name, None)
    docs = spark.range(0, 4000, 1, 1).selectExpr("id AS doc_id", "concat(id, repeat(' x', 2000)) AS text")
    try:
        spark.conf.unset(name)
        sd.remove_repeats(docs.limit(1))
        sizes = docs.mapInPandas(lambda frames: (f.text.str.len().agg(["sum"]).to_frame("n") for f in frames), "n long")
        assert sizes.agg({"n": "max"}).first()[0] <= common.BATCH_BYTES + 5000  # all 16 MB of them before
        spark.conf.set(name, "8m")
        sd.remove_repeats(docs.limit(1))
        assert spark.conf.get(name) == "8m"  # what the session says holds
    finally:
        spark.conf.set(name, held) if held else spark.conf.unset(name)
