"""Vector code compression: parts of integer vectors as indexes into learnt codebooks.

Components are integers, so a dimension holds few distinct ones.  Those are its dictionary, and a
table has the squared differences of each of them to that dimension of every codebook entry.  The
distances of a part to all entries are then rows of such tables, gathered by the dictionary codes and
added up, in exact integers.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_by_counts, materialize

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Rows whose distances are held at once.
ROWS = 4096

Books = list[np.ndarray]  # one for each part: entries by dimensions, int64


def part_edges(dimensions: int) -> list[int]:
    """Where the parts begin and end; the first parts are one longer where four doesn't divide."""
    return [0, *np.cumsum([dimensions // PARTS + (k < dimensions % PARTS) for k in range(PARTS)]).tolist()]


def nearest(values: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each row's nearest entry, the lowest of equals, and its squared distance."""
    if not values.shape[1]:
        return np.zeros(len(values), np.int64), np.zeros(len(values), np.int64)
    spread = max(int(values.max()), int(book.max())) - min(int(values.min()), int(book.min()))
    if spread**2 * values.shape[1] >= 1 << 63:
        raise OverflowError("components are too far apart for exact 64-bit distances")
    kind = np.int32 if spread**2 * values.shape[1] < 1 << 31 else np.int64
    distance = np.zeros((len(values), len(book)), kind)
    for j in range(values.shape[1]):
        distinct, code = np.unique(values[:, j], return_inverse=True)
        table = ((distinct[:, None] - book[:, j]) ** 2).astype(kind)
        distance += table[code]
    index = distance.argmin(axis=1)
    return index, distance[np.arange(len(values)), index].astype(np.int64)


def matrices(columns: Iterable[pd.Series]) -> Iterator[np.ndarray]:
    """The components of a bounded number of rows at a time."""
    for column in columns:
        for a in range(0, len(column), ROWS):
            own = column.iloc[a : a + ROWS]
            yield np.stack(own.to_list()).astype(np.int64).reshape(len(own), -1)


def part_sums(books: Books, edges: list[int]):
    """For each entry of each part: the sum and the number of a task's parts nearest to it, as rows of
    one component each."""
    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, counts = [np.zeros_like(b) for b in books], [np.zeros(len(b), np.int64) for b in books]
        for values in matrices(f["ints"] for f in frames):
            for k, book in enumerate(books):
                own = values[:, edges[k] : edges[k + 1]]
                index, _ = nearest(own, book)
                order = np.argsort(index, kind="stable")
                used, first, n = np.unique(index[order], return_index=True, return_counts=True)
                sums[k][used] += np.add.reduceat(own[order], first, axis=0)
                counts[k][used] += n
        for k, n in enumerate(counts):
            used = np.flatnonzero(n)
            width = sums[k].shape[1]
            yield pd.DataFrame({"part": k, "entry": np.repeat(used, width), "place": np.tile(np.arange(width), len(used)),
                                "total": sums[k][used].reshape(-1), "n": np.repeat(n[used], width)})

    return run


def codes(books: Books, edges: list[int]):
    """A column function: the code and the error of a column of integers."""
    @F.pandas_udf("code string, error long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for column in batches:
            made = []
            for values in matrices([column]):
                found = [nearest(values[:, edges[k] : edges[k + 1]], book) for k, book in enumerate(books)]
                indexes = np.column_stack([index for index, _ in found]).astype(np.uint8)
                made.append(pd.DataFrame({"code": [bytes(r).hex() for r in indexes], "error": sum(distance for _, distance in found)}))
            yield pd.concat(made, ignore_index=True) if made else pd.DataFrame({"code": [], "error": []})

    return run


def integers(vector: str) -> Column:
    return F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * SCALE))


def vector_codes(vectors: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every usable row of ``vectors``
    (vec_id, embedding, label).

    Rows whose vector is null or holds a null or non-finite component are dropped.  The first row in
    order of vec_id (nulls last, equal ids by components) sets the number of dimensions; vectors of
    another length have no such parts and are dropped too.  Each part's codebook starts as that part
    of the first ``entries`` rows, of all rows if they are fewer; ties go to the lower index.  Equal
    and repeated rows each count, null labels count as one label, no rows give none.  Components too
    far apart for exact 64-bit distances raise OverflowError.

    Only codebooks, of a fixed size, pass through the driver; a task hands on one sum for each
    component of the entries it met.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has one byte for each part")
    x = F.col("ints")
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    label = F.col("label") if "label" in vectors.columns else F.lit(None).cast("int")
    all_ = materialize(vectors.filter(F.col("embedding").isNotNull() & finite)
                       .select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), integers("embedding").alias("ints")), "integers")
    order = (F.asc_nulls_last("vec_id"), x)
    one = all_.orderBy(*order).first()
    dimensions = len(one["ints"]) if one else 0
    rows = all_.filter(F.size(x) == dimensions)
    first = [r["ints"] for r in rows.orderBy(*order).limit(entries).collect()]
    start = np.array(first, np.int64).reshape(len(first), dimensions)
    edges = part_edges(dimensions)
    books = [np.ascontiguousarray(start[:, a:b]) for a, b in zip(edges, edges[1:])]
    for _ in range(rounds if first else 0):
        sums = (rows.select("ints").mapInPandas(part_sums(books, edges), "part int, entry int, place int, total long, n long")
                .groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")))
        books = [b.copy() for b in books]
        for r in sums.collect():  # at most one row for each component of the codebooks
            books[r["part"]][r["entry"], r["place"]] = r["total"] // r["n"]
    digest = hashlib.sha256(",".join(str(c) for b in books for c in b.reshape(-1).tolist()).encode()).hexdigest()
    coded = materialize(rows.select("vec_id", "label", codes(books, edges)("ints").alias("c")).select("vec_id", "label", "c.*"), "codes")
    totals = materialize(coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")), "label-errors")
    return (join_by_counts(coded, totals, "label", "n").select("vec_id", "code", "error", "label_error")
            .withColumn("codebooks_sha256", F.lit(digest)))


def oracle_sql() -> str:
    """The same rounds over one row for each component; equal distances go to the lower index."""
    steps = [f"""
kept AS MATERIALIZED (SELECT vec_id, label, [CAST(floor({SCALE} * x::DOUBLE) AS BIGINT) FOR x IN embedding] AS ints FROM embeddings
         WHERE embedding IS NOT NULL AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
cells AS MATERIALIZED (SELECT vec_id, label, j, j * {PARTS} // len(ints) AS part, ints[j + 1] AS v FROM kept, range(len(ints)) r(j)),
ranked AS (SELECT *, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept),
book0 AS MATERIALIZED (SELECT j * {PARTS} // len(ints) AS part, entry, j, ints[j + 1] AS v FROM ranked, range(len(ints)) r(j) WHERE entry < {ENTRIES})"""]
    for k in range(ROUNDS + 1):
        steps.append(f"""
far{k} AS (SELECT vec_id, c.part, b.entry, sum((c.v - b.v) * (c.v - b.v)) AS d FROM cells c JOIN book{k} b USING (j) GROUP BY ALL),
near{k} AS MATERIALIZED (SELECT vec_id, part, CAST(min(d * {ENTRIES} + entry) AS BIGINT) AS best FROM far{k} GROUP BY ALL)""")
        if k < ROUNDS:
            steps.append(f"""
mean{k} AS (SELECT part, best % {ENTRIES} AS entry, j, CAST(sum(v) AS BIGINT) AS s, count(*) AS n FROM cells JOIN near{k} USING (vec_id, part) GROUP BY ALL),
book{k + 1} AS MATERIALIZED (SELECT part, entry, j, CASE WHEN n IS NULL THEN v ELSE (s - ((s % n) + n) % n) // n END AS v FROM book{k} LEFT JOIN mean{k} USING (part, entry, j))""")
    return "WITH" + ",".join(steps) + f""",
coded AS (SELECT vec_id, string_agg(printf('%02x', best % {ENTRIES}), '' ORDER BY part) AS code, CAST(sum(best // {ENTRIES}) AS BIGINT) AS error FROM near{ROUNDS} GROUP BY vec_id),
digest AS (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY part, entry, j)) AS codebooks_sha256 FROM book{ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded JOIN kept USING (vec_id), digest"""
