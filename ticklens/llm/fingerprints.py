"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A sketch has three subtables; a digest adds itself to one cell of each (count, xor of digests, xor
of their checks).  Subtracting one version's sketch from another's cancels what both have; cells
that hold one digest alone are then peeled off, which frees others, until all differing digests are
recovered.  If some are left, both sketches are built larger and subtracted again.

All of it is DataFrame operations.  Peeling goes by subtables in turn, so that no digest is met
twice in a round; each turn is an explode and an aggregation over rows that one shuffle by document
has put together.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, texts

#: A paragraph ends at line feeds or, so that a text of one line has several too, after a sentence
#: whose last letter is one of these.
BOUNDARY = r"\n+|(?<=[aeou][.!?]) +"
SUBTABLES = 3
#: Cells of a fingerprint's subtables.
CELLS = 8
#: Turns of peeling before a sketch counts as too small.
TURNS = 12
#: Neighbours are found in ranges of about so many documents, of which there are so many at most.
RANGE, RANGES = 256, 1 << 16


def digests(text: Column) -> Column:
    """The set of the text's paragraph digests."""
    parts = F.filter(F.split(text, BOUNDARY), lambda p: p != "")
    return F.array_distinct(F.transform(parts, lambda p: F.xxhash64(p)))


def cell(digest: Column, table: Column | int, size: Column, seed: int) -> Column:
    table = table if isinstance(table, Column) else F.lit(table)
    return (table * size + F.pmod(F.xxhash64(digest, table, F.lit(seed)), size)).cast("int")


def check(digest: Column) -> Column:
    return F.xxhash64(digest, F.lit("check"))


def fingerprint(found: Column, size: int = CELLS) -> Column:
    """A sketch of fixed size as text: for each cell in use its number, count, digests and checks.

    The digests' cells are sorted, and one pass adds up each cell's run.
    """
    places = F.array_sort(F.flatten(F.transform(found, lambda d: F.array(*(
        F.struct(cell(d, t, F.lit(size), 0).alias("c"), d.alias("d"), check(d).alias("k")) for t in range(SUBTABLES))))))
    state = lambda c, n, d, k, out: F.struct(c.alias("c"), n.alias("n"), d.alias("d"), k.alias("k"), out.alias("out"))
    zero = F.lit(0).cast("long")

    def written(a: Column) -> Column:
        own = F.concat_ws(".", F.hex(a["c"]), F.hex(a["n"]), F.hex(a["d"]), F.hex(a["k"]))
        return F.when(a["c"] < 0, F.lit("")).when(a["out"] == "", own).otherwise(F.concat_ws("-", a["out"], own))

    def add(a: Column, x: Column) -> Column:
        same = state(a["c"], a["n"] + 1, a["d"].bitwiseXOR(x["d"]), a["k"].bitwiseXOR(x["k"]), a["out"])
        return F.when(a["c"] == x["c"], same).otherwise(state(x["c"], F.lit(1), x["d"], x["k"], written(a)))

    return F.aggregate(places, state(F.lit(-1), F.lit(0), zero, zero, F.lit("")), add, written)


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text and next (text): the next row by descending doc_id, null ids last; after the last
    the first.  Rows with equal ids are ordered by text, descending.

    Rows are dealt into ranges of ids, each a window of its own, and a range's last row meets the
    first of the range below, of which it is given a copy.  The driver holds a row for each range.
    """
    spark = docs.sparkSession
    own = texts(docs).withColumn("key", F.coalesce("doc_id", F.lit(-(1 << 63))))
    n = own.count()
    want = max(1, min(RANGES, -(-n // RANGE)))
    shares = [k / want for k in range(1, want)]
    cuts = sorted(set(own.agg(F.percentile_approx("key", shares, 1_000_000)).first()[0] or [])) if n and shares else []
    # two steps of a search: first among every 256th cut, then among the 256 from there
    tops, parts = cuts[::256], [cuts[k : k + 256] for k in range(0, len(cuts), 256)]
    under = lambda xs, key: F.size(F.filter(xs, lambda c: c <= key))
    if cuts:
        table = spark.createDataFrame([(tops, parts)], "tops array<long>, parts array<array<long>>")
        top = under(F.col("tops"), F.col("key"))
        inside = F.when(top > 0, (top - 1) * 256 + under(F.element_at("parts", F.greatest(top, F.lit(1))), F.col("key"))).otherwise(0)
        ranged = own.join(F.broadcast(table)).withColumn("range", inside.cast("int")).drop("tops", "parts")  # one row
    else:
        ranged = own.withColumn("range", F.lit(0))
    heads = ranged.groupBy("range").agg(F.max("key").alias("key")).orderBy(F.desc("range")).collect()  # at most RANGES rows
    halo = [(heads[k]["key"], heads[k - 1]["range"]) for k in range(len(heads))]  # the first goes to the last
    copies = spark.createDataFrame(halo, "key long, to int").groupBy("key").agg(F.collect_list("to").alias("to"))
    spread = ranged.join(F.broadcast(copies), "key", "left").withColumn("place", F.explode(F.concat(
        F.array(F.struct(F.col("range").alias("range"), F.lit(0).alias("copy"))),
        F.coalesce(F.transform("to", lambda t: F.struct(t.alias("range"), F.lit(1).alias("copy"))), F.array()))))
    rows = spread.select("place.range", "place.copy", "key", "doc_id", "text")
    order = Window.partitionBy("range").orderBy("copy", F.desc("key"), F.desc("text"))
    return rows.withColumn("next", F.lead("text").over(order)).filter("copy = 0").select("doc_id", "text", "next")


def peel(pairs: DataFrame, scale: float, seed: int) -> DataFrame:
    """Rows of ``pairs`` (pair, own, other: digest arrays) with the digests that differ, as recovered from
    sketches of ``scale`` cells for each digest that may differ: mine, others; done says whether all were."""
    sized = (pairs.repartition("pair")
             .withColumn("size", F.ceil((F.size("own") + F.size("other")) * scale / SUBTABLES).cast("int") + 3))
    both = F.concat(F.transform("own", lambda d: F.struct(d.alias("d"), F.lit(1).alias("n"))),
                    F.transform("other", lambda d: F.struct(d.alias("d"), F.lit(-1).alias("n"))))
    tables = F.sequence(F.lit(0), F.lit(SUBTABLES - 1))
    added = (sized.select("pair", "size", F.explode(both).alias("x")).select("pair", "size", "x.d", "x.n", F.explode(tables).alias("t"))
             .select("pair", "size", cell(F.col("d"), F.col("t"), F.col("size"), seed).alias("cell"), F.lit(None).cast("long").alias("got"),
                     "n", F.col("d").alias("key"), check(F.col("d")).alias("chk")))

    def cells(rows: DataFrame) -> DataFrame:
        summed = rows.groupBy("pair", "size", "cell", "got").agg(F.sum("n").alias("n"), F.bit_xor("key").alias("key"), F.bit_xor("chk").alias("chk"))
        return summed.filter("n <> 0 OR key <> 0 OR chk <> 0").withColumn("n", F.col("n").cast("int"))

    table = cells(added)
    entry = lambda c, got, n, key, chk: F.struct(c.alias("cell"), got.alias("got"), n.alias("n"), key.alias("key"), chk.alias("chk"))
    for turn in range(TURNS):
        t, none, zero = turn % SUBTABLES, F.lit(None).cast("long"), F.lit(0).cast("long")
        n, key, chk = F.col("n"), F.col("key"), F.col("chk")
        # a cell of this subtable that holds one digest: note it, take it out of the other two
        pure = (F.col("cell") >= 0) & ((F.col("cell") / F.col("size")).cast("int") == t) & (F.abs(n) == 1) & (chk == check(key))
        out = [entry(F.lit(-1), key, n, zero, zero)]
        out += [entry(cell(key, u, F.col("size"), seed), none, -n, key, chk) for u in range(SUBTABLES) if u != t]
        stay = F.array(entry(F.col("cell"), F.col("got"), n, key, chk))
        table = cells(table.select("pair", "size", F.explode(F.when(pure, F.array(*out)).otherwise(stay)).alias("x")).select("pair", "size", "x.*"))
    side = lambda s: F.collect_list(F.when((F.col("cell") < 0) & (F.col("n") * s > 0), F.col("got")))
    return table.groupBy("pair").agg(side(1).alias("mine"), side(-1).alias("others"), (F.max("cell") < 0).alias("done"))


def differences(pairs: DataFrame, name: str = "iblt", scale: float = 1.0) -> DataFrame:
    """For each row of ``pairs`` (pair, a unique long; own, other: sets of digests) the digests on one side
    only, mine and others, by subtracting sketches; those that peeling leaves stuck are built larger.

    After four sizes what is left, if anything is, is compared set by set.  Empty sets are fine.
    """
    left, solved = pairs, []
    for attempt in range(4):
        found = materialize(left.join(peel(left, scale * 2**attempt, attempt), "pair", "left")
                            .withColumn("done", F.coalesce("done", F.lit(True))), f"{name}-{attempt}")
        none = F.array().cast("array<long>")
        solved.append(found.filter("done").select("pair", F.coalesce("mine", none).alias("mine"), F.coalesce("others", none).alias("others")))
        left = found.filter(~F.col("done")).select("pair", "own", "other")
        if left.isEmpty():
            break
    solved.append(left.select("pair", F.array_except("own", "other").alias("mine"), F.array_except("other", "own").alias("others")))
    return reduce(DataFrame.unionByName, solved)


def likeness(own: Column, other: Column, differing: Column) -> Column:
    """Share of the digests of either that both have; two texts without paragraphs are alike."""
    total = own + other
    return F.when(total == 0, F.lit(1.0)).otherwise((total - differing) / (total + differing))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every whole text and of its edited text, and how alike they and the next one's are.

    The edited text has its last floor(n / 2) code points replaced by the first as many of the next
    document, by descending doc_id.  Null texts are empty, null doc_ids come last, repeated rows
    stay; a single row is its own next.  Returns doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next.
    """
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.col("text").substr(F.lit(1), F.length("text") - half), F.col("next").substr(F.lit(1), half))
    rows = (with_next(docs).withColumn("edited", edited)
            .select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
                    digests(F.col("text")).alias("own"), digests(F.col("edited")).alias("changed"), digests(F.col("next")).alias("following"))
            .withColumn("row", F.monotonically_increasing_id()))
    rows = materialize(rows, "digests")  # row numbers are settled by this table
    pairs = rows.select(F.explode(F.array(
        F.struct((F.col("row") * 2).alias("pair"), "own", F.col("changed").alias("other")),
        F.struct((F.col("row") * 2 + 1).alias("pair"), "own", F.col("following").alias("other")))).alias("p")).select("p.*")
    found = differences(pairs).select(F.floor(F.col("pair") / 2).alias("row"), (F.col("pair") % 2).alias("which"),
                                      (F.size("mine") + F.size("others")).alias("d"))
    near = found.groupBy("row").agg(F.max(F.when(F.col("which") == 0, F.col("d"))).alias("edited_d"), F.max(F.when(F.col("which") == 1, F.col("d"))).alias("next_d"))
    return rows.join(near, "row").select(
        "doc_id", "n_chars", "edited_sha256", fingerprint(F.col("own")).alias("fingerprint"), fingerprint(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.size("own"), F.size("changed"), F.col("edited_d")).alias("near_edited"),
        likeness(F.size("own"), F.size("following"), F.col("next_d")).alias("near_next"))
