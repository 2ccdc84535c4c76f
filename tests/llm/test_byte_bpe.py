import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_edges import EDGES

from ticklens.llm import byte_bpe as bb

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
BPE = bb.byte_bpe(PATH, PATTERN)
LIBRARY = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=BPE.ids, special_tokens={})


def encoded(text):
    words = BPE.words(text) if text else []
    BPE.learn(words)
    return BPE.encode(words)


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" \n\t'sdre  \x1c\x85\xa0　éß1²½"), st.characters(codec="utf-8")), max_size=60))
def test_any_text_as_the_library(text):
    ids = encoded(text)
    assert ids.tolist() == LIBRARY.encode_ordinary(text)
    assert BPE.decode(ids) == text.encode()


@pytest.mark.parametrize("text", ["ab" * 700, "antidisestablishmentarianism" * 20, " " * 999 + "x", "é" * 400, "\n" * 5 + " a  b "])
def test_long_pieces(text):
    assert encoded(text).tolist() == LIBRARY.encode_ordinary(text)
    raw = text.encode()[:200]
    assert BPE.merge([raw], 200)[0] == BPE.merge_long(raw)


def test_words_met_again_when_the_memory_is_full():
    bpe = bb.ByteBPE(PATH, PATTERN, most=3)
    bpe.learn(["No.", " one"])
    bpe.learn(["No.", " two", " three"])  # the others make room, one of them is needed
    assert bpe.encode(["No.", " two", " three"]).tolist() == LIBRARY.encode_ordinary("No. two three")


def expected(rows):
    out = []
    for i, t in rows:
        ids = LIBRARY.encode_ordinary(t or "")
        out.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                    hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in df.collect()), key=repr)


def test_edges(edges):
    assert rows_of(bb.byte_bpe_round_trip(edges, PATH, PATTERN)) == expected(EDGES)


def test_empty(nothing):
    assert bb.byte_bpe_round_trip(nothing, PATH, PATTERN).collect() == []


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert rows_of(bb.byte_bpe_round_trip(docs, PATH, PATTERN)) == expected([(r.doc_id, r.text) for r in docs.collect()])


def test_pairs():
    left = np.array([BPE.ids[b"t"], BPE.ids[b"t"], -1], np.int32)
    right = np.array([BPE.ids[b"h"], BPE.ids[b"\x00"], BPE.ids[b"h"]], np.int32)
    assert BPE.pairs.ranks(left, right).tolist() == [BPE.ids[b"th"], bb.NONE, bb.NONE]
