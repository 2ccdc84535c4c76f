import re
from collections import Counter

import duckdb
import pytest
from llm_edges import EDGES

from ticklens.llm import divergence as dv

DDL = "doc_id long, text string, lang string, source string, part string, item string, value string, rank string, term string, n string"


def frame(spark, rows):
    return spark.createDataFrame([(k, t, lang, s, "a", "b", "c", "d", "e", "f") for k, (t, lang, s) in enumerate(rows)], DDL)


def brute(rows, least, top=50):
    word = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    low = str.maketrans({chr(65 + k): chr(97 + k) for k in range(26)})
    rows = [(word.findall((t or "").translate(low)), lang or "", s or "") for t, lang, s in rows]
    out = []
    for lang in {r[1] for r in rows}:
        own = [(w, s) for w, x, s in rows if x == lang]
        docs = Counter(t for w, _ in own for t in set(w))
        kept = [t for t, n in docs.items() if n >= least]
        counts = {s: Counter() for _, s in own}
        for w, s in own:
            counts[s].update(t for t in w if t in set(kept))

        def shares(c):
            n = sum(c.values())
            return {t: 1 + 10**9 * (c[t] + 5) // (n + 5 * len(kept)) for t in kept}

        p, q = {s: shares(c) for s, c in counts.items()}, shares(sum(counts.values(), Counter()))
        for s in counts:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in counts if o != s]
            terms = [(q[t] - p[s][t], t.encode()) for t in kept if counts[s][t] and p[s][t] > q[t]]
            out += [(lang, s, "pair", o.decode(), -v, k) for k, (v, o) in enumerate(sorted(pairs), 1)]
            out += [(lang, s, "term", t.decode(), -v, k) for k, (v, t) in enumerate(sorted(terms)[:top], 1)]
    return sorted(out)


def got(df):
    return sorted((r.lang, r.source, r.part, r["item"], r.value, r["rank"]) for r in df.collect())


ROWS = [(t, lang, s) for k, (_, t) in enumerate(EDGES) for lang, s in (("en", "a"), (None, f"s{k % 3}"), ("xx", None))]
ROWS += [("The the cat CAT dog-house é É x" * (1 + k % 4), "en", f"s{k % 7}") for k in range(20)] + [("", "none", "p"), (None, "none", "q"), ("zip", "lone", "")]


@pytest.mark.parametrize("least", [1, 3])
def test_edges(spark, monkeypatch, least):
    monkeypatch.setattr(dv, "SOURCES", 2)
    monkeypatch.setattr(dv, "TERMS", 3)
    monkeypatch.setattr(dv, "HELD", 5)
    assert got(dv.divergence(frame(spark, ROWS), least, 2)) == brute(ROWS, least, 2)


def test_empty(spark):
    assert dv.divergence(frame(spark, [])).collect() == []


@pytest.mark.parametrize("sources", [3, 64])
def test_documents(spark, monkeypatch, sources):
    monkeypatch.setattr(dv, "SOURCES", sources)
    path = "/root/testdata/sf0.01/documents.parquet"
    want = sorted(duckdb.sql(dv.oracle_sql().replace("FROM documents", f"FROM '{path}'")).fetchall())
    have = got(dv.divergence(spark.read.parquet(path)))
    assert have == want
    if sources == 3:
        assert have == brute([(r.text, r.lang, r.source) for r in spark.read.parquet(path).collect()], 30)
