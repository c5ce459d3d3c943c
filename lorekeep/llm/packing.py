"""Packing token sequences into fixed windows by best-fit decreasing.

Each document is tokenized once; overlong ones are cut into full windows and a rest. Only piece lengths are packed: dealt by their rows into groups
of bounded size, each group packed on its own by a segment tree over remaining capacities, so no task sees all pieces, equal ones among them,
and the loss is at most a few open windows per group.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, has_columns, in_batches, slices
from .tokens import WordTokenizer

#: Pieces that one task packs.
GROUP = 20_000


class CapacityTree:
    """Open windows by remaining capacity: a segment tree over 0..capacity whose nodes count the windows below them."""

    def __init__(self, capacity: int) -> None:
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _add(self, left: int, change: int) -> None:
        i = left + self.leaves
        while i:
            self.count[i] += change
            i >>= 1

    def put(self, left: int, window: int) -> None:
        self.open[left].append(window)
        self._add(left, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """Removes and returns (remaining capacity, window) of the tightest window with room for ``need``."""
        count, i = self.count, need + self.leaves
        if not count[i]:
            while i > 1 and (i & 1 or not count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if count[2 * i] else 2 * i + 1
        left = i - self.leaves
        self._add(left, -1)
        return left, self.open[left].pop()


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The window and the offset of each piece; no length may exceed ``capacity``."""
    window, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    tree, opened = CapacityTree(capacity), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        found = tree.take(n)
        if found is None:
            left, w = capacity, opened
            opened += 1
        else:
            left, w = found
        window[i], offset[i] = w, capacity - left
        if left > n:
            tree.put(left - n, w)
    return window, offset


def _pieces(path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = WordTokenizer.at(path)
        for part in slices(batches, "text", 4 << 20):
            ids, at = tokenizer.encode(part.column("text"), end_id)
            ids = ids.astype("<u4")
            row, start, length, crc = [], [], [], []
            for i, (a, b) in enumerate(zip(at.tolist(), at[1:].tolist())):
                for s in range(a, b, capacity):
                    e = min(s + capacity, b)
                    row.append(i)
                    start.append(s - a)
                    length.append(e - s)
                    crc.append(zlib.crc32(ids[s:e].tobytes()))
            size = np.diff(at)[row]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, size))],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"],
            )

    return run


def _pack(capacity: int):
    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks().sort_by([("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        window, offset = best_fit_decreasing(group.column("length").to_numpy(), capacity)
        first = group.column("part").to_numpy().astype(np.int64) << 32
        return group.drop_columns(["part"]).append_column("sequence_id", pa.array(first + window)).append_column("offset", pa.array(offset))

    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 2) -> DataFrame:
    """Packs each row of ``docs`` (doc_id, text), tokenized by the file ``tokenizer`` and ended by ``end_id``, into windows of ``capacity``.

    Returns one row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. A null or empty text is the end id
    alone. Repeated rows and null doc_ids are packed like others. Ids are those of ``tokenizer``, whatever its rules (``tokens.by_words`` tells which are fast). sequence_id is unique, not gapless: the group's number in the high 32 bits.
    An empty table gives an empty result.
    """
    has_columns(docs, "doc_id", "text")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = docs.transform(in_batches, _pieces(tokenizer, capacity, end_id), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")
    # A number of the row's own, written with it, deals equal pieces out like any others.
    pieces = durable(pieces.withColumn("row", F.monotonically_increasing_id()), "pieces")
    groups = max(1, -(-pieces.count() // GROUP))
    part = F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int")
    out = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return pieces.withColumn("part", part).drop("row").groupBy("part").applyInArrow(_pack(capacity), out)
