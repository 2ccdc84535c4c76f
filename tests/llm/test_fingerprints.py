import hashlib
import re

import pytest
from llm_edges import EDGES

from ticklens.llm import fingerprints as fp


def paragraphs(t):
    return {p for p in re.split(fp.BOUNDARY, t) if p}


def alike(a, b):
    a, b = paragraphs(a), paragraphs(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def brute(rows):
    rows = [(i, t or "") for i, t in rows]
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()), reverse=True)
    out = []
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        h = len(t) // 2
        e = t[:len(t) - h] + after[:h]
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), round(alike(t, e), 9), round(alike(t, after), 9)))
    return sorted(out, key=repr)


def rows_of(df):
    rows = df.collect()
    return rows, sorted(((r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in rows), key=repr)


def test_edges(edges, monkeypatch):
    monkeypatch.setattr(fp, "RANGE", 3)
    rows, got = rows_of(fp.fingerprints(edges))
    assert got == brute(EDGES)


def test_one_row_and_none(docs_of, nothing):
    assert rows_of(fp.fingerprints(docs_of([(3, "abc\ndef")])))[1] == brute([(3, "abc\ndef")])
    assert fp.fingerprints(nothing).collect() == []


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows, got = rows_of(fp.fingerprints(docs))
    assert got == brute(list(texts.items()))
    by_text, by_print = {}, {}
    for r in rows:
        assert by_text.setdefault(texts[r.doc_id], r.fingerprint) == r.fingerprint
        by_print.setdefault(r.fingerprint, set()).add(frozenset(paragraphs(texts[r.doc_id])))
    assert all(len(s) == 1 for s in by_print.values())


@pytest.mark.parametrize("scale", [0.05, 0.4])
def test_small_sketches_are_built_larger(spark, scale):
    rows = [(i, list(range(i, 3 * i)), list(range(2 * i, 4 * i + 7))) for i in range(0, 120, 7)]
    got = {r.pair: (set(r.mine), set(r.others)) for r in fp.differences(spark.createDataFrame(rows, "pair long, own array<long>, other array<long>"), scale=scale).collect()}
    assert got == {i: (set(a) - set(b), set(b) - set(a)) for i, a, b in rows}


def test_native(spark):
    plan = fp.fingerprints(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
