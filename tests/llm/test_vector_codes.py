import hashlib
import math
import random
from collections import Counter

import duckdb
import pytest

from ticklens.llm import common
from ticklens.llm import vector_codes as vc

DDL = "vec_id long, embedding array<float>, label int, code string, error string, part int, n int, ints string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, label, "a", "b", 1, 2, "c") for i, v, label in rows], DDL)


def brute(rows, entries=256, rounds=4):
    kept = [(i, [math.floor(1024 * x) for x in v], label) for i, v, label in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    if not kept:
        return []
    edges = vc.part_edges(len(kept[0][1]))
    spans = [slice(a, b) for a, b in zip(edges, edges[1:])]
    books = [[v[s] for _, v, _ in kept[:entries]] for s in spans]

    def near(v, book):
        return min((sum((a - b) ** 2 for a, b in zip(v, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for s, book in zip(spans, books):
            own = {}
            for _, v, _ in kept:
                own.setdefault(near(v[s], book)[1], []).append(v[s])
            for k, parts in own.items():
                book[k] = [sum(c) // len(parts) for c in zip(*parts)]
    digest = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    out = [(i, [near(v[s], book) for s, book in zip(spans, books)], label) for i, v, label in kept]
    errors = Counter()
    for _, found, label in out:
        errors[label] += sum(d for d, _ in found)
    return sorted([(i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), errors[label], digest) for i, found, label in out], key=repr)


def got(df):
    return sorted([(r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in df.collect()], key=repr)


def invented(n, width, seed, spread=8):
    rng = random.Random(seed)
    return [(i, [rng.randint(-spread, spread) / 64 for _ in range(width)], rng.choice([None, 1, 1, 1, 2, 3])) for i in range(n)]


@pytest.mark.parametrize("rows, width", [(3, 4), (60, 8), (90, 10), (40, 3)])
def test_invented(spark, monkeypatch, rows, width):
    monkeypatch.setattr(vc, "ROWS", 7)
    monkeypatch.setattr(common, "HOT_SHARE", 0.3)  # some labels are joined either way
    own = invented(rows, width, rows)
    own[0] = (own[0][0], [-x for x in own[0][1]], own[0][2])
    assert got(vc.vector_codes(frame(spark, own), 8, 3)) == brute(own, 8, 3)


def test_edges(spark):
    rows = invented(30, 8, 5, 2) + [(7, None, 1), (8, [], 1), (9, [math.nan] * 8, 1), (10, [math.inf] * 8, 2), (11, [None] + [0.5] * 7, 2), (12, [0.25] * 7, 3),
                                    (None, [0.5] * 8, None), (3, [0.5] * 8, None), (3, [0.5] * 8, None), (40, [-0.0] * 8, 9), (41, [1e-9, -1e-9] * 4, 9)]
    assert got(vc.vector_codes(frame(spark, rows))) == brute(rows)


def test_none_left(spark):
    assert vc.vector_codes(frame(spark, [])).collect() == []
    assert vc.vector_codes(frame(spark, [(1, None, 1)])).collect() == []
    assert got(vc.vector_codes(frame(spark, [(1, [], 1)]))) == brute([(1, [], 1)])


def test_far_apart(spark):
    with pytest.raises(Exception, match="too far apart"):
        vc.vector_codes(frame(spark, [(1, [3e38] * 4, 1), (2, [-3e38] * 4, 1)])).collect()


def test_given_vectors(spark):
    path = "/root/testdata/sf0.01/embeddings.parquet"
    have = got(vc.vector_codes(spark.read.parquet(path)))
    assert have == sorted(duckdb.sql(vc.oracle_sql().replace("FROM embeddings", f"FROM '{path}'")).fetchall(), key=repr)
    assert have == brute([(r.vec_id, list(r.embedding), r.label) for r in spark.read.parquet(path).collect()])
