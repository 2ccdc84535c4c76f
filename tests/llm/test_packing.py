import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_edges import EDGES
from tokenizers import Tokenizer

from ticklens.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def count(plan):
    return sum(n for _, n in plan)


def best_fit(lengths, capacity):
    rooms = []
    for x in sorted(lengths, reverse=True):
        fits = [(r, i) for i, r in enumerate(rooms) if r >= x]
        if fits:
            rooms[min(fits)[1]] -= x
        else:
            rooms.append(capacity - x)
    return len(rooms)


def check_plan(histogram, plan, capacity):
    used = Counter()
    for lengths, n in plan:
        assert sum(lengths) <= capacity and n > 0
        for k in lengths:
            used[k] += n
    assert used == Counter({k: v for k, v in histogram.items() if v})


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(0, 50), max_size=30))
def test_plans_use_each_piece_once(histogram):
    check_plan(histogram, packing.make_plan(histogram, 64, 16), 64)


def test_nnls_finds_exact_and_clips():
    a = np.array([[1.0, 0, 1], [0, 1, 1]])
    assert np.allclose(a @ packing.nnls(a, np.array([3.0, 2.0])), [3, 2])
    assert np.allclose(packing.nnls(a[:, :2], np.array([-1.0, 2.0])), [0, 2])


@pytest.mark.parametrize("seed", range(4))
def test_close_to_best_fit(seed):
    rng = random.Random(seed)
    lengths = [min(2048, max(1, int(rng.lognormvariate(6, 1)))) for _ in range(3000)]
    plan = packing.make_plan(Counter(lengths))
    check_plan(Counter(lengths), plan, 2048)
    assert count(plan) <= best_fit(lengths, 2048) * 1.01 + 1
    assert count(plan) >= -(-sum(lengths) // 2048)


def check_rows(rows, texts, capacity):
    library = Tokenizer.from_file(PATH)
    expected = Counter()
    for i, t in texts:
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        for piece, at in enumerate(range(0, len(ids), capacity)):
            own = ids[at:at + capacity]
            expected[i, piece, at, len(own), zlib.crc32(np.array(own, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == expected
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity


def test_edges(edges):
    check_rows(packing.pattern_packing(edges, PATH).collect(), EDGES, 2048)


def test_empty(nothing):
    assert packing.pattern_packing(nothing, PATH).collect() == []


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = packing.pattern_packing(docs, PATH).collect()
    check_rows(rows, [(r.doc_id, r.text) for r in docs.collect()], 2048)
    assert len({r.sequence_id for r in rows}) <= best_fit([r.length for r in rows], 2048) + 1
