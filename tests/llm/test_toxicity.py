import random
import zlib

import pytest
from llm_edges import EDGES

from ticklens.llm import toxicity as tox

LABELS = "doc_id long, toxic int, quality int, text string, score double"


def invented(n, seed):
    rng = random.Random(seed)
    syllables = "an be co du el fi go hi ja ko lu me no pa ri so tu va wo zu".split()
    bad = ["vilemuck", "drosser", "clodpit"]
    rows = []
    for i in range(n):
        words = ["".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(rng.randint(20, 200))]
        toxic = rng.random() < 0.2
        if toxic:
            for k in range(0, len(words), 25):
                words[k] = rng.choice(bad)
        rows.append((i, " ".join(words), int(toxic)))
    return rows


@pytest.fixture(scope="module")
def found(spark):
    rows = invented(1500, 3)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, x, 0, "no", 0.5) for i, _, x in rows], LABELS)
    return rows, {r.doc_id: r for r in tox.toxicity(docs, labels, sample_docs=200).collect()}


def test_held_out_accuracy(found):
    rows, got = found
    out = [(x, got[i]) for i, _, x in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(r.held_out for _, r in out) and sum(r.held_out for r in got.values()) == len(out)
    assert sum(r.predicted == x for x, r in out) >= 0.97 * len(out)
    assert all(r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for r in got.values())


def test_given_labels(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    out = [(truth[r.doc_id], r.score) for r in tox.toxicity(docs, labels).collect() if r.held_out and r.doc_id in truth]
    toxic, ordinary = ([s for x, s in out if x == k] for k in (1, 0))
    auc = sum((a > b) + 0.5 * (a == b) for a in toxic for b in ordinary) / len(toxic) / len(ordinary)
    assert auc > 0.8  # 300 toxic documents in four languages to learn from
    assert sum(s >= 0.7 for s in ordinary) <= 0.06 * len(ordinary)


def by_definition(model, text):
    """The score from plain compressions of every window, one compressor and dictionary for each."""
    import math

    import zstandard

    def length(raw, window):
        d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        p = zstandard.ZstdCompressionParameters.from_level(tox.LEVEL, dict_size=len(raw), source_size=400, min_match=tox.MATCH, write_checksum=False,
                                                           write_content_size=False, write_dict_id=False)
        return len(zstandard.ZstdCompressor(dict_data=d, compression_params=p).compress(window))

    words = (text or "").encode().lower().split()
    saved, size = [], 0
    for i in range(0, len(words), tox.WINDOW_WORDS):
        own = b" " + b" ".join(words[i : i + tox.WINDOW_WORDS]) + b" "
        saved.append(max(0, length(model.ordinary, tox.LEAD + own) - length(model.toxic, tox.LEAD + own)))
        size += len(own)
    best = sorted(saved)[-max(1, len(saved) // 4) :]
    x = (100 * sum(saved) / max(100, size), sum(v > 0 for v in saved) / len(saved), sum(best) / len(best)) if saved else (0, 0, 0)
    terms = (1, min(x[0], 4), math.sqrt(min(x[0], 4)), x[1], min(x[2], 8))
    return 1 / (1 + math.exp(-sum(a * b for a, b in zip(terms, model.weights))))


def test_scores_as_by_definition(spark, edges):
    rows = invented(400, 8)
    model = tox.fit([t for _, t, x in rows if x], [t for _, t, x in rows if not x], 0.2)
    assert model.weights and len(model.toxic) == len(model.ordinary)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows[:60]], "doc_id long, text string").unionByName(
        edges.select("doc_id", "text").filter("length(text) < 5000 OR text IS NULL"))
    got = docs.withColumn("score", tox.score(model)("text")).collect()
    assert len(got) > 65
    for r in got:
        assert r.score == pytest.approx(by_definition(model, r.text), abs=1e-9)


def test_dictionaries_are_of_their_class():
    rows = invented(600, 9)
    toxic, ordinary = [t for _, t, x in rows if x], [t for _, t, x in rows if not x]
    model = tox.dictionaries(toxic, ordinary)
    for word in (b"vilemuck", b"drosser", b"clodpit"):
        assert word in model.toxic and word not in model.ordinary
    assert tox.dictionaries(toxic, ordinary) == model  # the same in every run


def test_edges(spark, edges):
    labels = spark.createDataFrame([(1, 0, 0, "x", 0.0), (2, 1, 0, "x", 0.0), (2, None, 0, "x", 0.0), (None, 1, 0, "x", 0.0),
                                    (8, 0, 0, "x", 0.0), (7, 1, 0, "x", 0.0), (9, 0, 0, "x", 0.0)], LABELS)
    rows = tox.toxicity(edges, labels).collect()
    assert len(rows) == len(EDGES) and all(0 <= r.score <= 1 for r in rows)
    by_id = {}
    for r in rows:
        by_id.setdefault(r.doc_id, []).append(r)
    assert by_id[5][0].score == by_id[1][0].score  # null and empty
    assert sorted(len(v) for v in by_id.values()) == [1] * 7 + [3] and len({r.score for r in by_id[2]}) <= 2  # repeated rows alike
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, v in by_id.items() if i is not None for r in v)
    assert not by_id[None][0].held_out and all(r.predicted == int(r.score >= 0.7) for r in rows)
    kept = tox.keep_ordinary(edges, labels)
    assert kept.columns == edges.columns and kept.count() == sum(r.predicted == 0 for r in rows)


def test_no_labels_or_documents(spark, edges, nothing):
    none = spark.createDataFrame([], LABELS)
    assert {r.score for r in tox.toxicity(edges, none).collect()} == {0.0}
    assert tox.toxicity(nothing, none).collect() == []
