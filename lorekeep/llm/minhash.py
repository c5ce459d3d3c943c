"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

Method. A document is the set of its distinct word shingles. Equal sets are one class, found by a 128-bit digest, and only
the class's smallest doc_id goes on. A sketch has t coordinates: in round i each element is thrown into one of t bins by a
hash of its own, a bin keeps the smallest value of the first round that reaches it, and rounds go on until every bin is full
(after t rounds each bin left is filled with the minimum over the whole set, so a sketch is always complete). Long
sets fill all bins in one round, which is why sketching costs a few operations per shingle, not t. Bands of r coordinates
are bucket keys; r and the number of bands are derived from the threshold so that a pair right at it is
missed with a probability below 2e-6 (and of two lists of links only what connects further documents matters).

Links. Members of a bucket are compared with one centre, and those that it doesn't hold with all others, in blocks of bounded size (see
``operators.linking``). All comparisons are exact, on the whole sets of 64-bit shingle hashes. No pair of ids is listed twice and no group's pairs are listed at all.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import linking
from ..operators.graph import components
from .common import durable, has_columns, in_batches, labelled, mix, only, seed, slices, words

MISS = 2e-6
#: Sets to be fetched, of 32 bytes each, that may be broadcast.
INVOLVED = 500_000
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def bands(percent: int) -> tuple[int, int]:
    """Number of bands and coordinates in each, for a threshold in percent."""
    s = min(percent, 99) / 100
    r = max(1, round(math.log(0.36) / math.log(s)))
    return math.ceil(math.log(MISS) / math.log(1 - s**r)), r


def shingle_sets(text: pa.Array, k: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's k-word shingles (A-Z in lower case); shorter texts have one, empty ones none."""
    flat, at = words(pc.ascii_lower(pc.fill_null(text, "")))
    coded = flat.dictionary_encode()
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, coded.dictionary.cast(pa.binary()).to_pylist()), np.uint64, len(coded.dictionary))
    h = hashes[coded.indices.to_numpy(zero_copy_only=False)] if len(flat) else np.empty(0, np.uint64)
    n = len(h) - k + 1
    grams = np.full(max(n, 0), seed(k))
    for j in range(k):
        if n > 0:
            grams = mix(grams + h[j : j + n] * seed(100 + j))
    out = []
    for a, b in zip(at.tolist(), at[1:].tolist()):
        if b - a >= k:
            out.append(np.unique(grams[a : b - k + 1]))
        elif b > a:
            whole = np.full(1, seed(b - a))
            for j in range(a, b):
                whole = mix(whole + h[j : j + 1] * seed(100 + j - a))
            out.append(whole)
        else:
            out.append(np.empty(0, np.uint64))
    return out


def sketch(sets: list[np.ndarray], t: int) -> np.ndarray:
    """One row of t full coordinates for each non-empty set."""
    size = np.array([len(s) for s in sets], np.int64)
    out = np.full(len(sets) * t, EMPTY)
    vals, doc = np.concatenate([*sets, np.empty(0, np.uint64)]), np.repeat(np.arange(len(sets)), size)
    for i in range(2 * t):
        if not len(vals):
            break
        h = mix(vals + seed(1000 + i))
        turned = (h << np.uint64(32)) | (h >> np.uint64(32))
        if i < t:
            idx = doc * t + (((h >> np.uint64(32)) * np.uint64(t)) >> np.uint64(32)).astype(np.int64)
        else:
            idx = doc * t + (i - t)
        free = out[idx] == EMPTY
        np.minimum.at(out, idx[free], turned[free])
        if i < 8 or i % 8 == 0 or i >= t:
            ids = np.unique(doc)
            open_ = np.zeros(len(sets), bool)
            open_[ids] = (out.reshape(-1, t)[ids] == EMPTY).any(axis=1)
            keep = open_[doc]
            vals, doc = vals[keep], doc[keep]
    return out.reshape(-1, t)


def band_keys(sk: np.ndarray, b: int, r: int) -> np.ndarray:
    parts = sk.reshape(-1, b, r)
    key = np.broadcast_to(mix(np.array([seed(5000 + j) for j in range(b)])), parts.shape[:2])
    for j in range(r):
        key = mix(key + parts[:, :, j] * seed(j))
    return key.astype(np.int64)


def _digests(sets: list[np.ndarray]) -> np.ndarray:
    """The two halves of each set's 128-bit digest."""
    return np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), np.int64).reshape(-1, 2)


def _summaries(k: int, b: int, r: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            sets = shingle_sets(part.column("text"), k)
            size = np.array([len(s) for s in sets], np.int64)
            big = np.flatnonzero(size >= least)
            keys = np.empty((len(sets), 0), np.int64)
            if len(big):
                keys = band_keys(sketch([sets[i] for i in big], b * r), b, r)
            ends = np.zeros(len(sets) + 1, np.int32)
            ends[1:] = np.cumsum(np.where(size >= least, b, 0))
            d = _digests(sets)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(size), pa.array(d[:, 0]), pa.array(d[:, 1]), pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel()))],
                names=["doc_id", "n_shingles", "d1", "d2", "keys"],
            )

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            sets = shingle_sets(part.column("text"), k)
            ends = np.zeros(len(sets) + 1, np.int32)
            ends[1:] = np.cumsum([len(s) for s in sets])
            flat = np.concatenate([*sets, np.empty(0, np.uint64)]).astype(np.int64)
            d = _digests(sets)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(d[:, 0]), pa.array(d[:, 1]), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["rep", "d1", "d2", "grams"])

    return run


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Returns doc_id, n_shingles, component_id and kept for each row of ``docs`` (doc_id, text; other columns are ignored).

    Documents are linked if 100 * intersection >= percent * union of their sets of k-word shingles, and component_id is the
    smallest doc_id reachable. A null, empty or blank text has no shingles and is linked with nothing, not even
    another one. A text of fewer than k words has one shingle, the whole. Repeated rows are
    copies of each other: each is returned, with the same component. Rows that share a doc_id but not their text are one document in several
    versions: what any of them is linked with, all are. A row with a null doc_id is linked with nothing, gets a null
    component_id and is kept. An empty table gives an empty result.
    """
    has_columns(docs, "doc_id", "text")
    b, r = bands(percent)
    # A set of n elements and a different one have a similarity of n / (n + 1) at most.
    least = next(n for n in range(1, 200) if 100 * n >= percent * (n + 1)) if percent < 100 else 1 << 62
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketched = docs.transform(in_batches, _summaries(k, b, r, least), "doc_id long, n_shingles long, d1 long, d2 long, keys array<long>")
    all_ = durable(sketched.withColumn("row", F.monotonically_increasing_id()), "sketches")
    named = all_.where("doc_id is not null and n_shingles > 0")
    # A class of equal sets is told by a row of its own (cid): no join of many rows meets in its digest.
    classes = named.groupBy("d1", "d2").agg(F.min(F.struct("doc_id", "row")).alias("f"), F.count("*").alias("weight"))
    classes = durable(classes.select("d1", "d2", F.col("f.doc_id").alias("rep"), F.col("f.row").alias("cid"), "weight"), "classes")
    reps = named.where(F.size("keys") > 0).select(F.col("row").alias("cid"), F.col("doc_id").alias("rep"), F.col("n_shingles").alias("n"), "keys").join(classes.select("cid"), "cid", "left_semi")
    spread = reps.select("cid", "rep", "n", F.explode("keys").alias("key"))

    def sets_of(involved: DataFrame) -> DataFrame:
        involved = durable(involved.join(classes.select("cid", "d1", "d2"), "cid"), "involved")
        there = only(docs.withColumnRenamed("doc_id", "rep"), involved.select("rep").distinct(), "rep").withColumnRenamed("rep", "doc_id")
        # The set that belongs to the class's digest, whatever else goes by the same doc_id.
        return only(there.transform(in_batches, _sets(k), "rep long, d1 long, d2 long, grams array<long>"), involved, ["rep", "d1", "d2"], "inner", INVOLVED)

    low = components(linking.links(spread, sets_of, lambda both, n, m: 100 * both >= percent * (n + m - both)))
    of = classes.join(low.withColumnRenamed("node", "rep"), "rep", "left").select("d1", "d2", "weight", F.coalesce("component", "rep").alias("low"))
    # An empty set's digest is never in classes: its row stands for itself.
    out = labelled(all_.select("doc_id", "n_shingles", "d1", "d2", F.expr("doc_id is not null and n_shingles > 0").alias("known")), of, low=F.col("doc_id"))
    return out.select("doc_id", "n_shingles", F.col("low").alias("component_id")).withColumn("kept", F.coalesce(F.expr("doc_id = component_id"), F.lit(True)))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each group of near-duplicates, the one with the smallest doc_id; same columns.

    Of rows repeated whole, one stays. Blank texts and rows with a null doc_id stay.
    """
    result = durable(near_duplicates(docs, k, percent), "kept")
    named = docs.withColumn("__kept_id", F.col("doc_id").cast("long"))
    gone = result.where("not kept").select(F.col("doc_id").alias("__kept_id")).distinct()
    twice = durable(result.where("kept and n_shingles > 0 and doc_id is not null").groupBy(F.col("doc_id").alias("__kept_id")).count().where("count > 1").select("__kept_id"), "twice")
    left = only(named, gone, "__kept_id", "left_anti")
    if not twice.isEmpty():
        left = only(left, twice, "__kept_id", "left_anti").unionByName(only(left, twice, "__kept_id").dropDuplicates(["__kept_id", "text"]))
    return left.select(*docs.columns)
