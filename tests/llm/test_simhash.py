import random
import re

import numpy as np
import pytest
import xxhash
from llm_edges import EDGES

from ticklens.llm import simhash as sh
from ticklens.llm.components import components


def slow_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), text.encode()))
    if not words:
        return 0
    parts = [b" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hs = [xxhash.xxh64(p, seed=42).intdigest() for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute(rows, radius=4):
    fps = [slow_fingerprint(t or "") for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, f"{fps[i]:016x}", least.get(find(i))) for i, (d, _) in enumerate(rows)), key=repr)


def rows_of(df):
    return sorted(((r.doc_id, r.fingerprint, r.component_id) for r in df.collect()), key=repr)


@pytest.mark.parametrize("leaf", [4, 1 << 18])
@pytest.mark.parametrize("radius", [0, 1, 4])
def test_tree_finds_every_pair(monkeypatch, leaf, radius):
    monkeypatch.setattr(sh, "LEAF", leaf)
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 6), replace=False)) for _ in range(600)], np.uint64)
    fps = rng.choice(base, 600) ^ flips
    a, b = fps[:300], fps[300:]
    found = {(int(i), int(j)) for x, y in sh.near(a, b, np.zeros(300, np.int16), radius, sh.bit_groups((16, 16))[1]) for i, j in zip(x, y)}
    assert found == {(i, j) for i in range(300) for j in range(300) if int(a[i] ^ b[j]).bit_count() <= radius}


@pytest.mark.parametrize("lot, part, widths", [(7, 11, (16, 16)), (1 << 15, 1 << 18, None), (1 << 15, 1 << 18, (16, 16, 16)), (3, 5, (16, 16, 16, 16)), (5, 1 << 18, (8,) * 8)])
def test_links_connect_what_is_near(spark, monkeypatch, lot, part, widths):
    monkeypatch.setattr(sh, "LOT", lot)
    monkeypatch.setattr(sh, "PART", part)
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = sorted({b ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 7))) & (1 << 64) - 1 for b in base for _ in range(12)})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(s,) for s in signed], "fp long")
    roots = {r.node: r.root for r in components(sh.links(df, widths=widths), "t").collect()}
    forest = sh.Forest(np.array(fps, np.uint64))
    for i, x in enumerate(fps):
        y = np.array([z for z in fps[:i] if (x ^ z).bit_count() <= 4], np.uint64)
        forest.add(np.full(len(y), x, np.uint64), y)
    groups = {}
    for k, f in enumerate(signed):
        groups.setdefault(int(forest.root[np.searchsorted(forest.values, np.uint64(fps[k]))]), set()).add(f)
    expected = {f: min(g) for g in groups.values() if len(g) > 1 for f in g}
    assert roots == expected


def test_shards_follow_the_number():
    assert [sh.shard_widths(n) for n in (0, 800_000, 4_000_000, 20_000_000, 10**9)] == [(16, 16), (16, 16), (16,) * 3, (16,) * 4, (8,) * 8]
    for widths in sh.SHARD_WIDTHS:
        shards, tree = sh.bit_groups(widths)
        assert sum(shards) + sum(tree) == (1 << 64) - 1 and len(sh.steps(len(widths), 4)) == len(set(sh.steps(len(widths), 4)))


def test_components_of_paths_and_stars(spark):
    rows = [(i, i + 1) for i in range(0, 200)] + [(1000, 1000 + i) for i in range(300)] + [(5000, 5000)]
    got = {r.node: r.root for r in components(spark.createDataFrame(rows, "a long, b long"), "t").collect()}
    assert got == {i: 0 for i in range(201)} | {1000 + i: 1000 for i in range(300)}


def test_edges(edges):
    assert rows_of(sh.near_duplicates(edges)) == brute(EDGES)
    kept = sh.keep_one(edges)
    assert kept.columns == edges.columns
    want = sorted({c for _, _, c in brute(EDGES) if c is not None})
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == want
    assert len([1 for r in kept.collect() if r.doc_id is None]) == len({f for _, f, c in brute(EDGES) if c is None})


def test_empty(nothing):
    assert sh.near_duplicates(nothing).collect() == [] and sh.keep_one(nothing).collect() == []


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    expected = brute(rows)
    assert rows_of(sh.near_duplicates(docs)) == expected
    assert len({c for _, _, c in expected}) < len(rows)
    kept = sh.keep_one(docs)
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted({c for _, _, c in expected})
