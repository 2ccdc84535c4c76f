import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_edges import EDGES

from ticklens.llm import ngram_lm as lm


def out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def tokens(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())) + [None]


def brute(rows):
    uni, bi = Counter(), Counter()
    for i, t in rows:
        if not out(i):
            ws = tokens(t)
            uni.update(ws)
            bi.update(zip([None, *ws], ws))
    n, v = sum(uni.values()), len(uni)
    unknown = max(sum(c == 1 for c in uni.values()), 1) / (n + 1) if n else 1.0
    n1, n2 = (sum(c == k for c in bi.values()) for k in (1, 2))
    d = min(0.99, max(0.05, n1 / max(1, n1 + 2 * n2)))
    after = Counter(u for u, _ in bi)
    result = []
    for i, t in rows:
        ws = tokens(t)
        base = sum(math.log10((uni[w] + 1) / (n + v + 1)) for w in ws)
        score = 0.0
        for u, w in zip([None, *ws], ws):
            p = (1 - unknown) * uni[w] / n if uni[w] else unknown
            if uni[u]:
                p = max(bi[u, w] - d, 0) / uni[u] + d * after[u] / uni[u] * p
            score += math.log10(p)
        result.append((i, out(i), len(ws), sum(uni[w] > 0 for w in ws), n, base, score))
    return sorted(result, key=repr)


def same(df, rows):
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in df.collect()), key=repr)
    expected = brute(rows)
    key = lambda r: (repr(r[0]), r[2], r[3])
    got.sort(key=key)
    expected.sort(key=key)
    assert len(got) == len(expected)
    for g, e in zip(got, expected):
        assert g[:5] == e[:5]
        assert g[5] == pytest.approx(e[5], rel=1e-9, abs=1e-9)
        assert g[6] == pytest.approx(e[6], abs=0.021 * e[2] + 1e-6)  # half a step for each token


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 5000), max_size=300), st.integers(1, 4))
def test_sequences(values, spread):
    values = np.unique(np.array(values, np.uint64) * np.uint64(spread))
    arrays, numbers = lm.encode_sequence(values, 5001 * spread, "s")
    s = lm.Sequence(arrays | numbers, "s")
    assert s.get(np.arange(len(values))).tolist() == values.tolist()
    asked = np.arange(0, 5000 * spread, 3).astype(np.uint64)
    place = {int(v): i for i, v in enumerate(values)}
    assert s.find(asked).tolist() == [place.get(int(a), -1) for a in asked]


def test_sequence_with_repeats_is_read_in_order():
    values = np.array([0, 0, 3, 3, 3, 64, 64, 900], np.uint64)
    arrays, numbers = lm.encode_sequence(values, 901, "p")
    assert lm.Sequence(arrays | numbers, "p").get(np.arange(8)).tolist() == values.tolist()


@settings(max_examples=50, deadline=None)
@given(st.dictionaries(st.integers(0, 2**64 - 1), st.integers(1, 2**40), max_size=50))
def test_runs_round_trip(d):
    keys = np.array(sorted(d), np.uint64)
    got = lm.unsqueeze(lm.squeeze(keys, np.array([d[int(k)] for k in keys], np.uint64)))
    assert dict(zip(got[0].tolist(), got[1].tolist())) == d


def test_edges(edges):
    same(lm.language_model_scores(edges), EDGES)


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    same(lm.language_model_scores(docs), rows)


def test_empty_and_all_held_out(nothing, docs_of):
    assert lm.language_model_scores(nothing).collect() == []
    i = next(i for i in range(100) if out(i))
    got = lm.language_model_scores(docs_of([(i, "no words learnt")])).collect()[0]
    assert (got.n_known, got.train_tokens, got.score, got.base_score) == (0, 0, 0.0, 0.0)


def test_better_than_the_base_on_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [r for r in lm.language_model_scores(docs).collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)
    assert sum(r.score > r.base_score for r in rows) > 0.9 * len(rows)
