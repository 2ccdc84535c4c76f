import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from llm_edges import EDGES
from tokenizers import Tokenizer

from ticklens.llm import retrieval_packing as rp

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


def ids_of(text):
    return [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 1]


def check(rows, texts, capacity=2048):
    """The pieces are those of the texts, each id once, in full sequences or powers of two."""
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append(r)
    for own in sequences.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == np.cumsum([0, *(r.length for r in own)])[:-1].tolist()
        total = sum(r.length for r in own)
        assert total <= capacity and (total == capacity or total & (total - 1) == 0) and all(r.length > 0 for r in own)
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32, r.doc_tokens))
    wanted = {}
    for i, t in texts:
        wanted.setdefault(i, []).append(ids_of(t))
    assert set(by_doc) == set(wanted)
    for i, docs in wanted.items():
        pieces = Counter(by_doc[i])
        assert sum(n * k[1] for k, n in pieces.items()) == sum(map(len, docs))
        for ids in docs:  # pieces of one of the id's texts follow each other
            own, at = [], 0
            while at < len(ids):
                fits = [p for p in pieces if p[0] == at and p[3] == len(ids) and pieces[p]
                        and p[2] == zlib.crc32(np.array(ids[at : at + p[1]], "<u4").tobytes())]
                assert fits, (i, at)
                best = max(fits, key=lambda p: p[1])
                pieces[best] -= 1
                own.append(best)
                at += best[1]
        assert not +pieces
    return sequences


@pytest.mark.parametrize("capacity, shard_tokens", [(2048, 1 << 20), (64, 500), (8, 20)])
def test_edges(edges, capacity, shard_tokens):
    rows = rp.retrieval_packing(edges, PATH, capacity, shard_tokens=shard_tokens).collect()
    check(rows, EDGES, capacity)


def test_empty(nothing, docs_of):
    assert rp.retrieval_packing(nothing, PATH).collect() == []
    check(rp.retrieval_packing(docs_of([(1, None), (None, "")]), PATH).collect(), [(1, None), (None, "")])


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = rp.retrieval_packing(docs, PATH, shard_tokens=200_000).collect()
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    sequences = check(rows, texts)
    tokens = sum(r.length for r in rows)
    assert sum(1 << max(0, s - 1).bit_length() if s != 2048 else s for s in (sum(r.length for r in own) for own in sequences.values())) == tokens
    cut = Counter(r.doc_id for r in rows)
    assert sum(n - 1 for n in cut.values()) < 2 * len(sequences)


def corpus(n, seed, kinds=5):
    """Documents that draw their words from one topic's and a common vocabulary."""
    rng = random.Random(seed)
    return [(k % kinds, np.array([rng.randrange(10, 30) if rng.random() < 0.5 else 100 * (k % kinds + 1) + rng.randrange(40)
                                  for _ in range(rng.randint(1, 60))] + [1], "<u4")) for k in range(n)]


def weights_of(docs):
    df = Counter(int(t) for d in docs for t in set(d[:-1].tolist()))
    return df, rp.Weights(dict(df), len(docs), sum(map(len, docs)) / len(docs))


def test_neighbours_as_by_definition():
    docs = [d for _, d in corpus(60, 1)] + [np.array([1], "<u4")]
    df, weights = weights_of(docs)
    mean = sum(map(len, docs)) / len(docs)

    def score(q, d):
        n = Counter(docs[d][:-1].tolist())
        return sum(math.log(1 + (len(docs) - df[t] + 0.5) / (df[t] + 0.5)) * n[t] * 2.2 / (n[t] + 1.2 * (0.25 + 0.75 * len(docs[d]) / mean))
                   for t in set(docs[q][:-1].tolist()) if t in n)

    index, rng = rp.Index(docs, weights), random.Random(2)
    order = list(range(len(docs)))
    rng.shuffle(order)
    for seed in order:
        index.use(seed)
        assert index.scores(seed).tolist() == pytest.approx([0 if index.used[d] else score(seed, d) for d in range(len(docs))])


def test_like_with_like():
    made = corpus(400, 3)
    docs = [d for _, d in made]
    sequences = rp.pack_shard(docs, weights_of(docs)[1], 128)
    topics = [[made[d][0] for d, _, _ in s] for s in sequences]
    alike = sum(a == b for t in topics for a, b in zip(t, t[1:]))
    assert alike > 0.85 * sum(len(t) - 1 for t in topics)  # a fifth by chance


def test_hot_mark_is_split():
    first, many = rp.shard_table({3: 10, 5: 95, 6: 5, 7: 3, 9: 20}, 20)
    assert many[[3, 5, 6, 7, 9]].tolist() == [1, 5, 1, 1, 1]
    assert first[[3, 5, 6, 7, 9]].tolist() == [0, 1, 6, 6, 7]


def test_powers():
    out = rp.in_powers([(0, 5, 6), (1, 0, 7)])
    assert [sum(n for _, _, n in s) for s in out] == [8, 4, 1]
    assert [p for s in out for p in s] == [(0, 5, 6), (1, 0, 2), (1, 2, 4), (1, 6, 1)]
