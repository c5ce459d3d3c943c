"""Helpers that several operators share: durable tables, text slices, 64-bit mixing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import durable, in_batches, only, release, shared_dir

__all__ = ["durable", "grouped", "has_columns", "in_batches", "labelled", "mix", "only", "release", "seed", "shared_dir", "slices", "words"]
def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer; every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seed(i: int) -> np.uint64:
    return np.uint64((i + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 2 << 20, most: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Joins and cuts batches into runs of at most ``limit`` bytes of text and ``most`` rows; a longer text stands alone."""
    held: list[pa.RecordBatch] = []
    full = rows = 0
    for batch in batches:
        start = 0
        for i, n in enumerate(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()):
            if rows and (full + n > limit or rows == most):
                if i > start:
                    held.append(batch.slice(start, i - start))
                yield _joined(held)
                held, full, rows, start = [], 0, 0, i
            full += n
            rows += 1
        if batch.num_rows > start:
            held.append(batch.slice(start))
    if held:
        yield _joined(held)


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.concat_batches(parts)


def words(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words between the six ASCII white-space characters, and each text's first index into them (and the end)."""
    lists = pc.ascii_split_whitespace(pc.fill_null(text, ""))
    flat, offsets = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    if not full.all():
        flat = flat.filter(pa.array(full))
        offsets = np.concatenate([[0], np.cumsum(full)])[offsets]
    return flat, offsets


def grouped(df: DataFrame, keys: list[str], run: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """``run`` over the rows of each key, which the caller keeps bounded; many small groups share a task and a batch."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None

        def flush(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from run(pa.Table.from_batches(parts)).to_batches()

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
            change = np.zeros(batch.num_rows, bool)
            for c in cols:
                change[1:] |= c[1:] != c[:-1]
            cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                key = tuple(c[a] for c in cols)
                if held and key != last:
                    yield from flush(held)
                    held = []
                last = key
                held.append(batch.slice(a, b - a))
        if held:
            yield from flush(held)

    return df.repartition(*keys).sortWithinPartitions(*keys).transform(in_batches, each, schema)


def labelled(rows: DataFrame, of: DataFrame, **otherwise: Column) -> DataFrame:
    """``rows`` (d1, d2, known, ...) with the columns of ``otherwise``: those of their digest in ``of`` (d1, d2, weight, ...), or the given ones for rows that aren't ``known``.

    Digests of many rows are few, so they are broadcast and their rows stay where they are; the others bring few rows together.
    """
    # So many rows or more make a digest a large one; there are 500,000 such at most, whatever the number of rows.
    large = max(1000, rows.count() // 500_000)
    of = durable(of, "labels")
    many, few = (of.where(w).select("d1", "d2", *otherwise) for w in (F.col("weight") >= large, F.col("weight") < large))
    asking = rows.where("known")
    big = asking.join(F.broadcast(many), ["d1", "d2"])
    rest = asking.join(F.broadcast(many.select("d1", "d2")), ["d1", "d2"], "left_anti").join(few, ["d1", "d2"])
    return big.unionByName(rest).unionByName(rows.where("not known").withColumns(otherwise))


def has_columns(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
