"""Which of many sets are alike: candidates by shared keys, each confirmed on the whole sets.

In the bucket of each key every member is compared with one centre, the member that meets most others over all
buckets. Members that are not linked with their centre are then compared with every member of their bucket, in blocks of
bounded size that are spread over tasks; a block returns at most as many links as it has members. No pair of members is listed twice and no bucket's pairs are
listed at all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import durable, in_batches, release

#: Elements, and members, in one side of a block: 4 MB of hashes.
BLOCK, MEMBERS = 500_000, 500

#: Whether two sets are alike, from the size of their intersection and their own sizes: columns or arrays of numbers.
Alike = Callable


def forest(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, alike: Alike) -> list[tuple[int, int]]:
    """Links between members of ``left`` and of ``right`` that join what was apart."""
    size = np.array([len(s) for s in sets], np.int64)
    starts = np.cumsum(size) - size
    vocabulary, coded = np.unique(np.concatenate(sets), return_inverse=True)
    mark, up, out = np.zeros(len(vocabulary), np.int64), list(range(len(sets))), []

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    for x in np.flatnonzero(left):
        own = coded[starts[x] : starts[x] + size[x]]
        mark[own] = 1
        both = np.add.reduceat(mark[coded], starts)
        mark[own] = 0
        for y in np.flatnonzero(right & alike(both, size, size[x])):
            if (a := root(x)) != (b := root(y)):
                up[a] = b
                out.append((int(x), int(y)))
    return out


def _blocks(alike: Alike, kind: pa.DataType):
    """Over rows sorted by key, p and q: the links of each group of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None

        def out() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            ids, rest = t.column("rep").to_pylist(), t.column("rest").to_numpy()
            links = forest([x.values.to_numpy(zero_copy_only=False) for x in t.column("grams")], rest, ~rest, alike)
            return pa.RecordBatch.from_arrays([pa.array([ids[i] for i, _ in links], kind), pa.array([ids[j] for _, j in links], kind)], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(n).to_numpy() for n in ("key", "p", "q")]
            change = np.zeros(batch.num_rows, bool)
            for c in cols:
                change[1:] |= c[1:] != c[:-1]
            cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                now = tuple(c[a] for c in cols)
                if held and now != last:
                    yield out()
                    held = []
                last = now
                held.append(batch.slice(a, b - a))
        if held:
            yield out()

    return run


def links(spread: DataFrame, sets_of: Callable[[DataFrame], DataFrame], alike: Alike) -> DataFrame:
    """Links (a, b) that connect the reps of all sets that are alike, as far as they share a key.

    spread: cid, rep, n, key. cid tells a set, rep is what links are spelled in (several sets may have the same), n is the set's size, and there is a row for each
    of its keys. sets_of: from involved sets (cid, rep) to their elements (cid, grams), 64-bit hashes without repeats; it may return a set more than once.
    """
    crowded = spread.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    members = durable(spread.join(crowded, "key"), "members")
    met = members.groupBy("cid").agg(F.sum("c").alias("w"))
    centres = members.join(met, "cid").groupBy("key").agg(F.max(F.struct("w", (-F.col("cid")).alias("m"), "rep", "n")).alias("x"))
    centres = centres.select("key", (-F.col("x.m")).alias("centre"), F.col("x.rep").alias("crep"), F.col("x.n").alias("cn"))
    placed = durable(members.join(centres, "key"), "placed")
    sets = durable(sets_of(placed.select("cid", "rep").distinct()).select("cid", "grams"), "sets")
    if not sets.groupBy("cid").count().where("count > 1").isEmpty():
        sets = durable(sets.dropDuplicates(["cid"]), "sets")
    pairs = placed.where("cid <> centre").where(alike(F.least("n", "cn"), F.col("n"), F.col("cn"))).select("cid", "centre", "rep", "crep", "n", "cn").distinct()
    pairs = pairs.join(sets.select("cid", F.col("grams").alias("g1")), "cid").join(sets.select(F.col("cid").alias("centre"), F.col("grams").alias("g2")), "centre")
    close = pairs.withColumn("both", F.size(F.array_intersect("g1", "g2"))).where(alike(F.col("both"), F.col("n"), F.col("cn")))
    close = durable(close.select("cid", "centre", "rep", "crep"), "links")
    # Buckets where more than one member is linked with no centre, or one is and others are; of buckets with the same members, one.
    at = placed.join(close.select("cid", "centre", F.lit(True).alias("ok")), ["cid", "centre"], "left").withColumn("rest", F.expr("ok is null and cid <> centre"))
    stats = at.groupBy("key").agg(
        F.count("*").alias("c"), F.count_if("rest").alias("left"), F.sum("n").alias("total"), F.sum(F.when(F.col("rest"), F.col("n"))).alias("unlinked"),
        F.bit_xor(F.xxhash64("cid")).alias("s1"), F.bit_xor(F.xxhash64("cid", F.lit(7))).alias("s2"), F.bit_xor(F.xxhash64("cid", "rest")).alias("s3"),
    )
    mixed = stats.where("c > 2 and left > 0").groupBy("s1", "s2", "s3", "c", "left", "total", "unlinked").agg(F.min("key").alias("key"))
    # A block holds a chunk of the unlinked members (rest) and one of all members: who is linked already goes there once for each chunk of unlinked ones.
    parts = lambda elements, count: F.greatest(F.ceil(F.col(elements) / BLOCK), F.ceil(F.col(count) / MEMBERS)).cast("int")
    mixed = mixed.select("key", parts("total", "c").alias("nq"), parts("unlinked", "left").alias("np"))
    inside = at.join(mixed, "key").select("key", "cid", "rep", "rest", "np", "nq")
    chunk = lambda n: F.pmod(F.xxhash64("cid", F.lit(3)), F.col(n)).cast("int")
    blocks = inside.where("rest").withColumns({"p": chunk("np"), "q": F.explode(F.sequence(F.lit(0), F.col("nq") - 1))}).unionByName(
        inside.withColumns({"rest": F.lit(False), "q": chunk("nq"), "p": F.explode(F.sequence(F.lit(0), F.col("np") - 1))})
    )
    blocks = blocks.select("key", "cid", "rep", "rest", "p", "q").join(sets, "cid").repartition("key", "p", "q").sortWithinPartitions("key", "p", "q")
    kind = dict(spread.dtypes)["rep"]
    more = blocks.transform(in_batches, _blocks(alike, pa.string() if kind == "string" else pa.int64()), f"a {kind}, b {kind}")
    out = durable(close.select(F.col("rep").alias("a"), F.col("crep").alias("b")).unionAll(more), "edges")
    release(members, placed, sets, close)
    return out
