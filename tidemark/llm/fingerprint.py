"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A cell holds a count, the XOR of the digests that fall into it and the XOR of their checks; a digest falls into one
cell of each of three parts. The cells of two versions are subtracted and peeled: a cell with one digest left gives it
away, it is taken out of its other cells, and so on. The fingerprint is a sketch of 12 cells. Where its difference
doesn't peel, larger sketches are tried: the digests are dealt by hash into groups, a sketch of 30 cells a group, then
of 60, 120 and 240; a group that still fails (two digests in the same three cells each time) is compared digest by
digest, and ``exact_groups`` counts those. Built-in functions only; a text is sketched once, and it is shuffled once
with its digests to meet the document before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.llm.common import n_partitions, table, text_or_empty

BASE, STEP = 4, 10  # cells of each of the three parts: of the fingerprint, of a group's first larger sketch
GROUP = 12  # digests of both versions in a group, on average
TRIES = 4  # larger sketches of a group, each twice the last
ROUNDS = 12
_CHECK = 99


def paragraphs(text: Column) -> Column:
    """Distinct digests of a text's paragraphs: the pieces between line feeds and sentence ends; empty ones don't count.

    The rule is the same at every length, so equal passages give equal digests in any two texts.
    """
    pieces = F.split(text, r"[.!?]+\s+|\n")
    return F.array_distinct(F.transform(F.filter(pieces, lambda p: p != ""), lambda p: F.xxhash64(p)))


def _check(key: Column) -> Column:
    return F.xxhash64(key, F.lit(_CHECK))


def _place(key: Column, part: int, width: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(part)), F.lit(width)).cast("int")


def sketch(digests: Column, width: int) -> Column:
    """The 3 * width cells (c, k, h) of an array of digests."""
    entries = F.transform(digests, lambda d: F.struct(d.alias("k"), _check(d).alias("h"), *[_place(d, i, width).alias(f"p{i}") for i in range(3)]))
    empty = F.struct(F.lit(0).alias("c"), F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("h"))

    def cells(e: Column) -> Column:
        def one(part: int) -> Column:
            return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda j: F.aggregate(F.filter(e, lambda x: x[f"p{part}"] == j), empty, lambda a, x: F.struct((a.c + 1).alias("c"), a.k.bitwiseXOR(x.k).alias("k"), a.h.bitwiseXOR(x.h).alias("h"))))

        return F.concat(one(0), one(1), one(2))

    return _let(entries, cells)


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.struct((x.c - y.c).alias("c"), x.k.bitwiseXOR(y.k).alias("k"), x.h.bitwiseXOR(y.h).alias("h")))


def peel(difference: Column, width: int) -> Column:
    """The signed digests (s, k) that two versions don't share, or null where peeling gets stuck."""
    return _peeled(difference, width, lambda found: found)


def _peeled(difference: Column, width: int, of) -> Column:
    """``of`` the digests that ``peel`` finds, or null."""
    kind = "struct<cells:array<struct<c:int,k:bigint,h:bigint>>,found:array<struct<s:int,k:bigint>>,on:boolean>"
    start = F.struct(difference.alias("cells"), F.array().cast("array<struct<s:int,k:bigint>>").alias("found"), F.lit(True).alias("on")).cast(kind)

    def step(a: Column, _r: Column) -> Column:
        pure = F.array_distinct(F.transform(F.filter(a.cells, lambda c: (F.abs(c.c) == 1) & (c.h == _check(c.k))), lambda c: F.struct(c.c.alias("s"), c.k.alias("k"))))

        def without(p: Column) -> Column:
            placed = F.transform(p, lambda x: F.struct(x.s.alias("s"), x.k.alias("k"), _check(x.k).alias("h"), *[(_place(x.k, i, width) + i * width).alias(f"p{i}") for i in range(3)]))
            cells = _let(
                placed,
                lambda q: F.transform(
                    a.cells,
                    lambda c, i: F.aggregate(
                        F.filter(q, lambda x: (x.p0 == i) | (x.p1 == i) | (x.p2 == i)), c, lambda b, x: F.struct((b.c - x.s).alias("c"), b.k.bitwiseXOR(x.k).alias("k"), b.h.bitwiseXOR(x.h).alias("h"))
                    ),
                ),
            )
            return F.struct(cells.alias("cells"), F.concat(a.found, p).alias("found"), (F.size(p) > 0).alias("on")).cast(kind)

        return F.when(~a.on, a).otherwise(_let(pure, without))

    done = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step)
    return _let(done, lambda d: F.when(F.forall(d.cells, lambda c: (c.c == 0) & (c.k == 0)), of(d.found)))


def _by_group(a: Column, b: Column) -> Column:
    """(differ, exact): how many digests differ, by larger sketches a group, and the groups compared digest by digest.

    Two levels of groups keep very long texts sub-quadratic.
    """
    kind = "struct<differ:int,exact:int>"
    total = F.size(a) + F.size(b)
    side = F.greatest(F.lit(1), F.ceil(F.sqrt(total / GROUP)).cast("int"))

    def part(x: Column, salt: int, g: Column, n: Column) -> Column:
        return F.filter(x, lambda d: F.pmod(F.xxhash64(d, F.lit(salt)), n) == g)

    def of(differ: Column, exact: int) -> Column:
        return F.struct(differ.cast("int").alias("differ"), F.lit(exact).alias("exact")).cast(kind)

    def group(t: Column) -> Column:
        tries = [_peeled(subtract(sketch(t.x, w), sketch(t.y, w)), w, lambda found: of(F.size(found), 0)) for w in (STEP << i for i in range(TRIES))]
        return F.coalesce(*tries, of(F.size(F.array_except(t.x, t.y)) + F.size(F.array_except(t.y, t.x)), 1))

    def add(n: Column, m: Column) -> Column:
        return _let(m, lambda x: F.struct((n.differ + x.differ).alias("differ"), (n.exact + x.exact).alias("exact")).cast(kind))

    def inner(s: Column, j: Column) -> Column:
        both = F.struct(part(s.x, 6, j, side).alias("x"), part(s.y, 6, j, side).alias("y"))
        return _let(both, lambda t: F.when((F.size(t.x) == 0) | (F.size(t.y) == 0), of(F.size(t.x) + F.size(t.y), 0)).otherwise(group(t)))

    none = F.struct(F.lit(0).alias("differ"), F.lit(0).alias("exact")).cast(kind)

    def outer(g: Column) -> Column:
        both = F.struct(part(a, 5, g, side).alias("x"), part(b, 5, g, side).alias("y"))
        return _let(both, lambda s: F.aggregate(F.sequence(F.lit(0), side - 1), none, lambda n, j: add(n, inner(s, j))))

    return F.aggregate(F.sequence(F.lit(0), side - 1), none, lambda n, g: add(n, outer(g)))


def likeness(a: Column, b: Column, cells_a: Column, cells_b: Column) -> Column:
    """(near, exact): 1 - differing / all digests, from the sketches' difference, and ``_by_group``'s exact ones.

    Two texts without paragraphs are alike.
    """
    total = F.size(a) + F.size(b)
    small = _peeled(subtract(cells_a, cells_b), BASE, lambda found: F.struct(F.size(found).alias("differ"), F.lit(0).alias("exact")))
    return _let(F.coalesce(small.cast("struct<differ:int,exact:int>"), _by_group(a, b)), lambda d: F.struct(F.when(total == 0, F.lit(1.0)).otherwise(1.0 - d.differ / total).alias("near"), d.exact.alias("exact")))


def as_text(cells: Column) -> Column:
    return F.array_join(F.transform(cells, lambda c: F.concat_ws(":", c.c.cast("string"), F.lower(F.hex(c.k)), F.lower(F.hex(c.h)))), ",")


def with_next(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text and others) with ``next``: the row of the next document, doc_id descending; after the last
    comes the first.

    Ids are cut into ranges at their quantiles, and an id that fills several ranges by a hash of its texts; each range
    also gets the greatest row below it (for the lowest range: the greatest of all), so that a window within ranges is
    enough. A null doc_id is the least; ties go by the hash. Only as many rows as there are ranges reach the driver, and
    only their ids and hashes.
    """
    spark = docs.sparkSession
    at = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    n = 2 * n_partitions(spark)
    ends = docs.select(F.percentile_approx(at, [(i + 1) / n for i in range(n - 1)] or [1.0], 10_000)).first()[0] or []
    d = docs.withColumns({"__at": at, "__tie": F.xxhash64("text")})
    below, same = F.lit(0), F.lit(0)
    if ends:
        known = F.array(*[F.lit(e).cast("long") for e in sorted(ends)])
        below, same = F.size(F.filter(known, lambda e: e < F.col("__at"))), F.size(F.filter(known, lambda e: e == F.col("__at")))
    part = F.shiftrightunsigned(F.col("__tie").bitwiseXOR(F.lit(-(2**63))), 33).cast("double") / float(1 << 31)
    d = d.withColumn("__span", below + F.floor(part * (same + 1)).cast("int"))
    tops = {r["__span"]: (r.top["__at"], r.top["__tie"]) for r in d.groupBy("__span").agg(F.max(F.struct("__at", "__tie")).alias("top")).collect()}  # one row a range
    order = sorted(tops)
    rows = d.withColumn("__ghost", F.lit(False))
    if order:
        under = [(*tops[order[i - 1]], s) for i, s in enumerate(order)]
        wanted = spark.createDataFrame(under, "__at long, __tie long, __span int")
        ghosts = d.where(F.col("__at").isin(sorted({x[0] for x in under}))).drop("__span").join(F.broadcast(wanted), ["__at", "__tie"]).withColumn("__ghost", F.lit(True))
        rows = rows.unionByName(ghosts.select(*rows.columns))
    before = F.lag(F.struct(*docs.columns)).over(W.partitionBy("__span").orderBy(F.desc("__ghost"), "__at", "__tie"))
    return rows.withColumn("next", before).where("not __ghost").select(*docs.columns, "next")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, exact_groups of each row.

    The edited text has its last third replaced by the start of the next document. Null text is empty; a text without
    paragraphs has a fingerprint of empty cells; rows that share a doc_id are documents of their own. Other columns
    are not read.
    """
    d = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).withColumn("a", paragraphs(F.col("text")))
    d = with_next(d.withColumn("ca", sketch(F.col("a"), BASE)))
    n = F.length("text")
    r = F.floor(n / 3).cast("int")
    d = d.withColumn("edited", F.concat(F.substr("text", F.lit(1), n - r), F.substr(F.col("next.text"), F.lit(1), r)))
    d = d.select("doc_id", n.cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "a", "ca", paragraphs(F.col("edited")).alias("e"), F.col("next.a").alias("x"), F.col("next.ca").alias("cx"))
    d = d.withColumn("ce", sketch(F.col("e"), BASE))
    d = d.withColumns({"le": likeness(F.col("a"), F.col("e"), F.col("ca"), F.col("ce")), "lx": likeness(F.col("a"), F.col("x"), F.col("ca"), F.col("cx"))})
    return d.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text(F.col("ca")).alias("fingerprint"),
        as_text(F.col("ce")).alias("edited_fingerprint"),
        F.col("le.near").alias("near_edited"),
        F.col("lx.near").alias("near_next"),
        (F.col("le.exact") + F.col("lx.exact")).alias("exact_groups"),
    )


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))
