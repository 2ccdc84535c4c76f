"""Source divergence audit: how far each source's use of words is from its language's other sources.

A document's UTF-8 bytes go through one translate table, which lowers A-Z and blanks every separator,
are split, and counted by a Counter of their own.  A task adds the counters up for each (lang, source)
and the rest is sparse: only terms that occur are rows.  A term that a source lacks has the same share
as all others that it lacks, so the distance of two sources needs the terms that either has and one
product for all the rest.
"""
from __future__ import annotations

import string
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, slices

LEAST_DOCS = 30
TOP_TERMS = 50
#: Bytes that end a term: ASCII but for letters.
SEPARATORS = bytes(b for b in range(128) if chr(b) not in string.ascii_letters)
TABLE = bytes.maketrans(SEPARATORS + string.ascii_uppercase.encode(), b" " * len(SEPARATORS) + string.ascii_lowercase.encode())
#: Counts that a task holds before it hands them on.
HELD = 1 << 19
#: Sources are compared in blocks of about so many, over about so many terms at a time.
SOURCES, TERMS = 64, 2048

COUNTS = "lang string, source string, term string, n long, docs long"


def terms(text: str) -> list[bytes]:
    return text.encode().translate(TABLE).split()


def count_terms(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Occurrences and documents of each term for each (lang, source) of a task; the null term shows
    that a source occurs."""
    found: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    held = 0

    def rows() -> Iterator[pd.DataFrame]:
        for (lang, source), (n, docs) in found.items():
            yield pd.DataFrame({"lang": lang, "source": source, "term": [None, *(t.decode() for t in n)],
                                "n": [0, *n.values()], "docs": [0, *(docs[t] for t in n)]})

    for frame in slices(frames):
        for lang, source, text in zip(frame["lang"], frame["source"], frame["text"], strict=True):
            own = Counter(terms(text))
            n, docs = found.setdefault((lang, source), (Counter(), Counter()))
            before = len(n)
            n.update(own)
            docs.update(own.keys())
            held += len(n) - before
        if held + len(found) > HELD:
            yield from rows()
            found, held = {}, 0
    yield from rows()


def share(count: str, total: str, kinds: str) -> Column:
    """1 + floor(10^9 (count + 5) / (total + 5 kinds)) in exact decimals; null without kept terms."""
    return F.expr(f"CAST(1 + ((CAST({count} AS DECIMAL(20,0)) + 5) * 1000000000)"
                  f" div nullif(CAST({total} AS DECIMAL(20,0)) + 5 * {kinds}, 0) AS BIGINT)")


def block_distances(frame: pd.DataFrame) -> pd.DataFrame:
    """Parts of the distances between the sources of two blocks (or within one) over some terms.

    Rows with a null term carry each source's share of absent terms.  Absent terms count in full
    where ``shard`` is 0; elsewhere a part is only what present terms change.
    """
    own = frame[frame["term"].isna()].sort_values("source")
    cells = frame[frame["term"].notna()]
    lang, low, high, shard = (frame[c].iloc[0] for c in ("lang", "low", "high", "shard"))
    names, block, base, kinds = (own[c].to_numpy() for c in ("source", "block", "base", "kinds"))
    column, distinct = pd.factorize(cells["term"])
    matrix = np.repeat(base[:, None], len(distinct), axis=1)
    matrix[pd.Index(names).get_indexer(cells["source"]), column] = cells["p"].to_numpy()
    out = []
    for i in np.flatnonzero(block == low):
        others = np.flatnonzero(block == high)
        others = others[others > i] if low == high else others
        absent = np.abs(base[others] - base[i])
        value = np.abs(matrix[others] - matrix[i]).sum(axis=1) + absent * ((kinds[i] if shard == 0 else 0) - len(distinct))
        out.append(pd.DataFrame({"lang": lang, "source": names[i], "item": names[others], "value": value}))
    return pd.concat(out, ignore_index=True) if out else pd.DataFrame(columns=["lang", "source", "item", "value"])


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: see the parts.

    ``pair``: for each (lang, source), every other source of the lang and the sum of the absolute
    differences of the shares of all kept terms (0 if the lang keeps none).  ``term``: the ``top``
    kept terms whose share there exceeds the lang's most.  A lang keeps the terms in at least
    ``least_docs`` of its rows; shares are in 10^9ths, smoothed by 5, in exact integers.

    Null text, lang and source are ''; every row is a document, repeated rows too; ties go by the
    item's UTF-8 bytes; a source without terms still has pairs; no rows give none.
    """
    own = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counts = materialize(own.mapInPandas(count_terms, COUNTS).groupBy("lang", "source", "term")
                         .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "term-counts")
    found = counts.filter("term IS NOT NULL")
    kept = materialize(found.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n"))
                       .filter(F.col("docs") >= least_docs).drop("docs"), "kept-terms")
    entries = materialize(found.drop("docs").join(kept, ["lang", "term"]), "kept-counts")

    langs = kept.groupBy("lang").agg(F.count("*").alias("kinds"), F.sum("lang_n").alias("lang_total"))
    sources = counts.filter("term IS NULL").select("lang", "source")
    many = sources.groupBy("lang").agg(F.ceil(F.count("*") / SOURCES).alias("blocks"))
    totals = entries.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    zero = {"kinds": 0, "lang_total": 0, "total": 0}
    groups = (sources.join(many, "lang").join(langs, "lang", "left").join(totals, ["lang", "source"], "left").fillna(zero)
              .withColumn("base", F.coalesce(share("0", "total", "kinds"), F.lit(0)))
              .withColumn("block", F.pmod(F.xxhash64("source"), F.col("blocks")))
              .withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("kinds") / TERMS))))
    groups = materialize(groups, "sources")
    shares = entries.join(groups, ["lang", "source"]).withColumn("p", share("n", "total", "kinds"))

    gain = F.col("p") - share("lang_n", "lang_total", "kinds")
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    by_term = (shares.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), gain.alias("value"))
               .filter("value > 0").withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top))

    # every source's row of absent terms goes to each cell that its block is in
    columns = ["lang", "source", "term", "p", "base", "kinds", "block", "blocks", "shard"]
    present = shares.withColumn("shard", F.pmod(F.xxhash64("term"), F.col("shards"))).select(*columns)
    absent = (groups.withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
              .withColumn("term", F.lit(None).cast("string")).withColumn("p", F.col("base")).select(*columns))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    cells = (present.unionByName(absent).select("*", other)
             .withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other")))
    parts = (cells.groupBy("lang", "low", "high", "shard")
             .applyInPandas(block_distances, "lang string, source string, item string, value long"))
    one_way = materialize(parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")), "distances")
    both = one_way.unionByName(one_way.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    by_pair = both.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(best))
    return by_pair.unionByName(by_term)


def oracle_sql() -> str:
    """The same from dense tables: every source with every kept term of its lang."""
    upper, lower = string.ascii_uppercase, string.ascii_lowercase
    return rf"""
WITH docs AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
words AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, '{upper}', '{lower}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
counts AS (SELECT lang, source, term, count(*) AS n FROM words GROUP BY ALL),
kept AS (SELECT lang, term, count(*) AS lang_n FROM words GROUP BY ALL HAVING count(DISTINCT r) >= {LEAST_DOCS}),
sources AS (SELECT DISTINCT lang, source FROM docs),
dense AS (SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n, k.lang_n
          FROM sources s JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
shares AS (SELECT lang, source, term, n, 1 + 1000000000::HUGEINT * (n + 5) // (sum(n) OVER own + 5 * count(*) OVER own) AS p,
                  1 + 1000000000::HUGEINT * (lang_n + 5) // (sum(lang_n) OVER own + 5 * count(*) OVER own) AS q
           FROM dense WINDOW own AS (PARTITION BY lang, source)),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item,
                 coalesce((SELECT sum(abs(x.p - y.p)) FROM shares x JOIN shares y USING (lang, term)
                           WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0) AS value
          FROM sources a JOIN sources b ON a.lang = b.lang AND a.source <> b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM shares WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
           FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= {TOP_TERMS}"""
