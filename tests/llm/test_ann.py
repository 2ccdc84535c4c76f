import math

import numpy as np
import pytest

from ticklens.llm import ann

DDL = "vec_id long, embedding array<float>, rank int, score double, class string, table int, ids string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 0.5, "c", 2, "x") for i, v in rows], DDL)


def brute(rows, every, k):
    ok = {(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = {}
    for q, v in ok:
        if q % every == 0:
            d = [(float(np.sqrt(((np.float32(w).astype(float) - np.float32(v).astype(float)) ** 2).sum())), i)
                 for i, w in ok if i != q and len(w) == len(v)]
            out[q] = sorted(d)[:k]
    return out


def got(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert len(out[r.query_id]) == r["rank"]
    return out


def test_hadamard_is_orthonormal():
    h = ann.hadamard(np.eye(16))
    assert np.allclose(h @ h.T, np.eye(16))


def test_buckets_start_with_the_own():
    x = np.random.default_rng(1).normal(size=(50, 24))
    for hashes in (1, 2):
        own, more = ann.buckets(x, 3, hashes, 1), ann.buckets(x, 3, hashes, 20)
        assert (own[:, 0] == more[:, 0]).all()
        assert all(len(set(r)) == 20 for r in more.tolist())


def test_edges(spark):
    rows = [(0, [1.0, 0.0]), (10, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, -1.0]), (3, None), (4, [0.0, 0.0]), (5, [math.nan, 1.0]),
            (6, [math.inf, 1.0]), (7, [None, 1.0]), (None, [1.0, 1.0]), (20, [2.0, 2.0]), (20, [2.0, 2.0]), (30, None), (40, [1.0, 2.0, 3.0]),
            (8, [-0.0, 3.0]), (9, [0.0, 3.0])]
    have, want = got(ann.nearest(frame(spark, rows), 10, 4)), brute(rows, 10, 4)
    assert have == {q: v for q, v in want.items() if v}


def test_empty(spark):
    assert ann.nearest(frame(spark, [])).collect() == []


def test_hot_vector_and_lots(spark, monkeypatch):
    monkeypatch.setattr(ann, "LOT", 16)
    monkeypatch.setattr(ann, "ASKED", 3)
    rng = np.random.default_rng(2)
    rows = [(i, [1.0] * 8 if i % 3 else rng.normal(size=8).astype(np.float32).tolist()) for i in range(400)]
    have, want = got(ann.nearest(frame(spark, rows), 20, 10)), brute(rows, 20, 10)
    assert set(have) == set(want) and all(len(v) == 10 for v in have.values())
    for q in have:
        if q % 3:  # its copies come first, smaller ids first
            assert have[q] == want[q]


@pytest.mark.parametrize("plan", [None, (2, *ann.TABLES[2])])
def test_recall(spark, plan):
    t = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in t.select("vec_id", "embedding").collect()]
    have, want = got(ann.nearest(t, 20, 10, plan)), brute(rows, 20, 10)
    assert set(have) == set(want) and all(len(v) == 10 for v in have.values())
    hits = sum(len({i for _, i in have[q]} & {i for _, i in want[q]}) for q in want)
    assert hits >= 0.92 * 10 * len(want)
    exact = {(q, i): s for q in want for s, i in want[q]}
    assert all(exact.get((q, i), s) == s for q in have for s, i in have[q])
