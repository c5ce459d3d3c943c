"""Sharding by jump consistent hashing: stable keys, no ring table, minimal movement when shards are appended."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, has_columns, in_batches, mix

#: Counts of rows by task and shard that may be broadcast, of 20 bytes each.
BROADCAST_COUNTS = 500_000


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each 64-bit key, by the published jump recurrence, for all keys at once."""
    key = keys.astype(np.uint64).copy()
    b, j = np.full(len(key), -1, np.int64), np.zeros(len(key), np.int64)
    live = np.arange(len(key))
    with np.errstate(over="ignore"):
        while len(live):
            b[live] = j[live]
            key[live] = key[live] * np.uint64(2862933555777941757) + np.uint64(1)
            j[live] = ((b[live] + 1) * (float(1 << 31) / ((key[live] >> np.uint64(33)).astype(np.float64) + 1.0))).astype(np.int64)
            live = live[j[live] < shards]
    return b


def _place(shards: int):
    """shard, grown_shard, the task and the row's place among the task's rows of its shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(shards, np.int64)
        task = TaskContext.get().partitionId()
        for batch in batches:
            key = mix(batch.column("key").to_numpy().astype(np.uint64))
            at = jump(key, shards)
            order = np.argsort(at, kind="stable")
            count = np.bincount(at, minlength=shards)
            place = np.empty(len(at), np.int64)
            place[order] = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count) + held[at[order]]
            held += count
            new = [pa.array(at.astype(np.int32)), pa.array(jump(key, shards + 1).astype(np.int32)), pa.array(np.full(len(at), task, np.int32)), pa.array(place)]
            yield pa.RecordBatch.from_arrays([*map(batch.column, ("doc_id", "size", "text_crc32")), *new], names=["doc_id", "size", "text_crc32", "shard", "grown_shard", "task", "place"])

    return run


def shard(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Places each row of ``docs`` (doc_id, text) in one of ``shards`` shards, by its doc_id alone.

    Returns doc_id, size, text_crc32, law ('key'), shard, slot and grown_shard, the shard with one shard more. A null text
    has the size 1 and the checksum 0; a null doc_id counts as 0. Rows with the same doc_id share a shard and get slots of their own.
    Slots follow the order in which tasks read the table: each task numbers its rows of a shard, and the counts of the tasks before it are
    added, so no shard and no key is ever gathered. An empty table gives an empty result.
    """
    has_columns(docs, "doc_id", "text")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc_id = F.col("doc_id").cast("long")
    # Null ids become 0 before they reach Python, which would turn a batch with a null into doubles.
    rows = docs.select(doc_id.alias("doc_id"), F.coalesce(doc_id, F.lit(0)).alias("key"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = durable(rows.transform(in_batches, _place(shards), "doc_id long, size long, text_crc32 long, shard int, grown_shard int, task int, place long"), "placed")
    counts = durable(placed.groupBy("shard", "task").count(), "counts")
    before = Window.partitionBy("shard").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("shard", "task", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    if counts.count() <= BROADCAST_COUNTS:
        base = F.broadcast(base)
    return placed.join(base, ["shard", "task"]).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("base") + F.col("place")).alias("slot"), "grown_shard")
