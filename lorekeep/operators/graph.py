"""Connected components by alternating large and small stars, on executors only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import durable, release


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b of one type) to (node, component): the smallest node reachable, for each node but the smallest of its component.

    Nulls and loops are dropped. Each round is written to the shared folder, so lineage stays one round long; the number of
    rounds grows with the logarithm of the longest path. Hubs are pre-aggregated for their minimum and the join that brings
    it back can be split by the adaptive skew join.
    """
    e = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    e, before = durable(e, "edges"), None
    while True:
        now = tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo"))).first())
        if now == before or not now[0]:
            return e.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
        before = now
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(e.select("lo", "hi"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), "m"), F.struct(F.col("v").alias("u"), "m"))).alias("x"))
        new = durable(small.select(F.col("x.u").alias("hi"), F.col("x.m").alias("lo")).where("hi <> lo").distinct(), "edges")
        release(e)
        e = new
