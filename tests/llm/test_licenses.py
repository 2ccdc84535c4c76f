import hashlib

import duckdb
import pytest
from llm_edges import EDGES

from ticklens.llm import licenses as li
from ticklens.llm import queries

MIT = li.KNOWN[0][1]
SAME = [MIT, MIT.upper(), MIT.replace("<year> <copyright holders>", "1999-2004 Ann Other <ann@example.org>"), MIT.replace("\n", " \r\n  * "),
        MIT.replace("copyright holders", "copyright owners").replace("COPYRIGHT HOLDERS", "Copyright Owners"), MIT.replace('"', "”"),
        MIT.replace("sublicense", "sub-license"), MIT.replace("MIT License", "MIT Licence"), MIT.replace("(c)", "©"),
        MIT + "\nAll rights reserved.\n", "Copyright 2020 Somebody\n" + MIT]
OTHER = [MIT + " And more.", MIT.replace("free of charge", "for a fee"), "MIT", "", None]


def rows_of(df):
    return sorted(((r.doc_id, r.canonical_sha256, r.licence) for r in df.collect()), key=repr)


def oracle(rows):
    con = duckdb.connect()
    con.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [list(r) for r in rows])
    return sorted(con.sql(queries.oracle_sql()["op3_license_digests"]).fetchall(), key=repr)


def test_variants(spark, docs_of):
    rows = list(enumerate([*SAME, *OTHER]))
    got = rows_of(li.license_scan(docs_of(rows), li.known_digests(spark)))
    assert {i: x for i, _, x in got} == {i: "MIT" if i < len(SAME) else None for i, _ in rows}
    assert got == oracle(rows)
    assert dict((i, d) for i, d, _ in got)[len(rows) - 1] == hashlib.sha256(b"").hexdigest()


@pytest.mark.parametrize("spellings", [("authorised organisations favour colour", "authorized organizations favor color"), ("acknowledgement", "acknowledgment"),
                                       ("non-commercial offences", "noncommercial offenses"), ("cancelled modelling", "canceled modeling"),
                                       ("catalogue whilst wilful", "catalog while willful"), ("fulfil ten per cent", "fulfill ten percent")])
def test_equivalent_spellings(docs_of, spark, spellings):
    got = li.license_scan(docs_of(list(enumerate(spellings))), li.known_digests(spark)).collect()
    assert len({r.canonical_sha256 for r in got}) == 1


@pytest.mark.parametrize("one, other", [("our rights", "or rights"), ("four copies", "for copies"), ("filled", "filed"), ("your hours", "yor hors"), ("rise", "rize"),
                                        ("promise", "promize"), ("called", "caled"), ("fence", "fense"), ("element", "elment"), ("programmed", "programd"),
                                        ("centred", "centerd"), ("polled", "poled"), ("dialogue", "dialog"), ("perfect per centre", "perfect percentre")])
def test_other_words_differ(docs_of, spark, one, other):
    rows = [(0, one), (1, other)]
    got = rows_of(li.license_scan(docs_of(rows), li.known_digests(spark)))
    assert len({d for _, d, _ in got}) == 2 and got == oracle(rows)


def test_changed_words_are_no_licence(docs_of, spark):
    rows = list(enumerate([MIT.replace("or sell", "our sell"), MIT.replace("FOR ANY", "FOUR ANY"), MIT.replace("the rights", "rights")]))
    assert {x for _, _, x in rows_of(li.license_scan(docs_of(rows), li.known_digests(spark)))} == {None}


def test_every_known_text_is_found(docs_of, spark):
    rows = [(i, t.upper().replace("\n", "\n// ") + "\n") for i, (_, t) in enumerate(li.KNOWN)]
    got = rows_of(li.license_scan(docs_of(rows), li.known_digests(spark)))
    assert {i: x for i, _, x in got} == dict(enumerate(k for k, _ in li.KNOWN)) and got == oracle(rows)


def test_edges(spark, edges, nothing):
    assert rows_of(li.license_scan(edges, li.known_digests(spark))) == oracle(EDGES)
    assert li.license_scan(nothing, li.known_digests(spark)).collect() == []
    none = spark.createDataFrame([("X", None), ("Y", " . "), (None, "z")], "licence string, text string")
    assert {r.licence for r in li.license_scan(edges, none).collect()} == {None}


def test_documents(spark):
    got = queries.queries()["op3_license_digests"](spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    assert rows_of(got) == oracle([(r.doc_id, r.text) for r in docs])
    plan = got._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
