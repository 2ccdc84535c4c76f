"""The pipeline against brute-force versions of its stages, each on what the stage before kept."""
import corpus_pipeline as cp
import numpy as np
import pytest
from test_packing import check_rows
from test_simhash import brute as near_brute

from ticklens.llm import suffix_dedup as sd
from ticklens.llm import toxicity as tox

SF = "/root/testdata/sf0.01"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def cut(rows):
    seen, out = set(), {}
    for i, t in sorted(rows.items()):
        raw = t.encode()
        gone = np.zeros(len(raw), bool)
        for s in range(len(raw) - sd.LENGTH + 1):
            p = raw[s:s + sd.LENGTH]
            if p in seen:
                gone[s:s + sd.LENGTH] = True
            seen.add(p)
        out[i] = bytes(np.frombuffer(raw, np.uint8)[~gone]).decode("utf-8", "ignore")
    return out


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = [docs]
    for name, stage in cp.STAGES:
        found.append(cp.materialize(stage(spark, found[-1], SF), name))
    return found


def test_stage_order_and_columns(steps):
    assert [n for n, _ in cp.STAGES] == ["toxicity", "simhash_near_dedup", "suffix_array_dedup", "best_fit_packing"]
    assert all(s.columns == COLUMNS and s.dtypes == steps[0].dtypes for s in steps[1:4])


def test_every_stage(spark, steps):
    texts = [{r.doc_id: r.text for r in s.select("doc_id", "text").collect()} for s in steps[:4]]
    rejected = {r.doc_id for r in tox.toxicity(steps[0], spark.read.parquet(f"{SF}/labels.parquet")).collect() if r.predicted}
    assert texts[1] == {i: t for i, t in texts[0].items() if i not in rejected}
    kept = {c for _, _, c in near_brute(list(texts[1].items()))}
    assert texts[2] == {i: t for i, t in texts[1].items() if i in kept}
    assert texts[3] == cut(texts[2])
    assert all(r.n_chars == len(r.text) for r in steps[3].collect())
    check_rows(steps[4].collect(), list(texts[3].items()), 2048)


def test_run_and_edges(spark, steps, edges):
    same = lambda df: sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in df.collect())
    assert same(cp.run(spark, SF)) == same(steps[4])
    own = edges.selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "cast(1 AS long) AS n_chars", "score")
    found = [own]
    for name, stage in cp.STAGES:
        found.append(cp.materialize(stage(spark, found[-1], SF), name))
    assert all(f.columns == own.columns for f in found[:4])
    texts = [[(r.doc_id, r.text) for r in f.select("doc_id", "text").collect()] for f in found[:4]]
    rejected = {(r.doc_id, r.score) for r in tox.toxicity(own, spark.read.parquet(f"{SF}/labels.parquet")).collect() if r.predicted}
    assert len(texts[1]) == len(texts[0]) - len(rejected)
    ids = sorted(i for i, _ in texts[1] if i is not None)
    assert sorted(i for i, _ in texts[2] if i is not None) == sorted({c for _, _, c in near_brute(texts[1]) if c is not None}) and set(ids) >= {i for i, _ in texts[2] if i is not None}
    assert len(texts[3]) == len(texts[2])  # texts are cut, rows stay
    check_rows(found[4].collect(), texts[3], 2048)
    rows = own.limit(0)
    for _, stage in cp.STAGES:
        rows = stage(spark, rows, SF)
    assert rows.collect() == []
