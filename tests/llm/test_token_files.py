import io
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_edges import EDGES
from tokenizers import Tokenizer

from ticklens.llm import token_files as tf
from ticklens.llm.word_ids import MARKS, WordIds, word_ids


PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def brute(library, rows):
    out, start = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = library.encode(t or "", add_special_tokens=False).ids + [tf.END_ID]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def rows_of(df):
    return sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in df.collect()), key=lambda r: r[1])


@pytest.mark.parametrize("bits", [1, 3, 16, 17, 31])
@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 1000])
def test_pack_round_trip(bits, n):
    ids = np.random.default_rng(n).integers(0, 1 << bits, n).astype(np.uint32)
    assert (tf.unpack(tf.pack(ids, bits), bits, n) == ids).all()


def test_file_random_access():
    rng = np.random.default_rng(1)
    lengths = [0, 5, 20_000, 1, 9000]
    ids = rng.integers(0, 50_000, sum(lengths)).astype(np.uint32)
    f = io.BytesIO()
    tf.write_file(f, [None, 3, 4, 5, 6], lengths, ids, 16)
    f.seek(0)
    got = tf.TokenFile(f)
    assert got.doc_ids == [None, 3, 4, 5, 6]
    ends = np.cumsum([0, *lengths])
    for k in (4, 2, 0, 1, 3):
        assert (got.document(k) == ids[ends[k]:ends[k + 1]]).all()
    assert (got.ids(8190, 8195) == ids[8190:8195]).all()
    with pytest.raises(ValueError, match="bits"):
        tf.write_file(io.BytesIO(), [1], [1], np.array([70_000], np.uint32), 16)


def test_words_are_the_librarys(library):
    words = word_ids(PATH)
    for _, t in EDGES:
        assert words.encode(t or "") == np.array(library.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes()


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" aSé'’"), st.sampled_from(MARKS), st.characters(codec="utf-8")), max_size=40))
def test_any_words_are_the_librarys(library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    assert word_ids(PATH).encode(text) == np.array(ids, "<u4").tobytes()


def test_letters_and_marks_are_looked_up_apart(monkeypatch):
    words, met = WordIds(PATH, most=1000), []
    monkeypatch.setattr(words, "whole", lambda text: met.append(text) or WordIds.whole(words, text))
    for text in ("onthwhtion### Ouanéai%%%", "leouçreç### inthhean%%%"):
        words.encode(text)
    assert met == ["###", "%%%"]  # words with marks went through the library one by one


def test_edges(edges, library):
    assert rows_of(tf.token_files(edges, PATH)) == brute(library, EDGES)


def test_several_files_for_a_task(edges, library):
    files = tf.write_token_files(edges, PATH, file_ids=3)
    assert files.count() > 5
    assert rows_of(tf.read_token_files(files)) == brute(library, EDGES)


def test_empty(nothing):
    assert tf.token_files(nothing, PATH).count() == 0


def test_documents(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert rows_of(tf.token_files(docs, PATH)) == brute(library, [(r.doc_id, r.text) for r in docs.collect()])
