"""Near-duplicate embeddings by cross-polytope hashing.

A hash rotates a vector by three rounds of random signs and a fast Hadamard transform and takes the closest signed axis. Each
table joins several of them, HASHES or so many more that the table has as many buckets as there are vectors; a vector is stored under its own code and under
the PROBES codes next in line (those whose axes lose least), and two vectors meet in a bucket that is the own code of at least one. So many
tables are made that two vectors in random directions right at the threshold fail to meet with a probability below MISS, closer ones far less: how
often they meet in one table is measured for the threshold and each width. For 64 dimensions and a cosine of 0.9 these are 24.
A threshold that asks for more than MOST tables is refused.

Equal vectors are one class with a weight. A vector is hashed once; its codes go with it into the buckets. Of buckets with the same members, only the one with
the smallest key is looked at. Buckets are cut into blocks of bounded size, and each block computes exact cosines in double precision. A pair that meets in
several buckets counts in the one with the smallest key, which the codes tell without any exchange; so links are counted, not listed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from .common import durable, has_columns, in_batches, labelled

HASHES, TABLES, PROBES = 3, 24, 4
#: Probability that a pair at the threshold never meets, and the most tables made for it; TABLES are the least.
MISS, MOST = 2e-5, 256
#: Vectors in one side of a block, and their components.
BLOCK, COMPONENTS = 4096, 1 << 20
#: Axes of each hash that a probe may take.
NEXT = 3
#: Members of a bucket up to which pairs are formed together with those of other buckets, rows that are looked at together, and pairs compared at once.
SMALL, ROWS, PAIRS = 32, 4000, 100_000
#: Vectors that take part: not empty, all components there and finite, not all of them zero.
USABLE = "coalesce(size(embedding) > 0 and forall(embedding, x -> x is not null and abs(x) < double('infinity')) and exists(embedding, x -> x <> 0), false)"


def hadamard(x: np.ndarray) -> np.ndarray:
    """Along the first axis, whose length is a power of two."""
    n, h = len(x), 1
    spare = np.empty_like(x)
    while h < n:
        a, b = x.reshape(n // (2 * h), 2, h, *x.shape[1:]), spare.reshape(n // (2 * h), 2, h, *x.shape[1:])
        np.add(a[:, 0], a[:, 1], out=b[:, 0])
        np.subtract(a[:, 0], a[:, 1], out=b[:, 1])
        x, spare = spare, x
        h *= 2
    return x


@lru_cache(maxsize=4)
def signs(dim: int, tables: int, hashes: int) -> np.ndarray:
    """(tables, rounds, dim, hashes, 1) random signs."""
    return np.random.default_rng(20).choice(np.array([-1, 1], np.float32), size=(tables, 3, dim, hashes, 1))


def padded(width: int) -> int:
    return 1 << max(2, (width - 1).bit_length())


def hashes_for(rows: int, dim: int) -> int:
    """So many hashes that a table has a bucket for each row."""
    return max(HASHES, math.ceil(math.log(max(rows, 2)) / math.log(2 * dim)))


def meet(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(rows, tables): whether the vectors of two code arrays meet."""
    return (b == a[:, :, :1]).any(axis=2) | (a == b[:, :, :1]).any(axis=2)


def pairs_at(cosine: float, dim: int, n: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """``n`` pairs of unit vectors in random directions at a cosine."""
    a, b = unit(rng.normal(size=(n, dim))), rng.normal(size=(n, dim))
    b = unit(b - (a * b).sum(axis=1)[:, None] * a)
    return a, cosine * a + math.sqrt(1 - cosine * cosine) * b


@lru_cache(maxsize=64)
def tables_for(cosine: float, dim: int, hashes: int = HASHES) -> int:
    """Tables that let a pair at the threshold miss with a probability below MISS."""
    a, b = pairs_at(max(-1.0, min(1.0, cosine)), dim, max(200, 2000 * 64 // max(dim, 64)), np.random.default_rng(22))
    met = meet(codes(a, TABLES, hashes), codes(b, TABLES, hashes))
    # Three deviations less than measured.
    rate = met.mean() - 3 * math.sqrt(met.mean() * (1 - met.mean()) / met.size)
    needed = TABLES if rate >= 1 else math.ceil(math.log(MISS) / math.log1p(-rate)) if rate > 0 else math.inf
    if needed > MOST:
        raise ValueError(f"a cosine of {cosine} at {dim} dimensions asks for more than {MOST} tables for a miss below {MISS}")
    return max(TABLES, needed)


@lru_cache(maxsize=8)
def choices(hashes: int) -> np.ndarray:
    """Which axis (0 is the closest) each hash of a code may take: the own code, then all that fewer than PROBES others are sure to lose less than."""
    all_ = sorted(product(range(NEXT), repeat=hashes), key=lambda c: (sum(c), c))
    surely_better = [sum(all(x <= y for x, y in zip(o, c)) for o in all_ if any(o) and o != c) for c in all_]
    return np.array([c for c, n in zip(all_, surely_better) if n < PROBES])


def codes(x: np.ndarray, tables: int, hashes: int = HASHES) -> np.ndarray:
    """(rows, tables, 1 + PROBES) bucket keys; the first of each table is the vector's own, and tables with higher numbers have larger keys."""
    n, width = x.shape
    dim = padded(width)
    wide = np.zeros((dim, 1, n), np.float32)
    wide[:width, 0] = x.T
    out = np.empty((n, tables, 1 + PROBES), np.int64)
    choice, row = choices(hashes), np.arange(n)
    place = (2 * dim) ** np.arange(hashes, dtype=np.int64)
    for t in range(tables):
        y = wide
        for s in signs(dim, tables, hashes)[t]:
            y = hadamard(y * s)
        loss, key = np.zeros((n, len(choice)), np.float32), np.zeros((n, len(choice)), np.int64)
        for k in range(hashes):
            turned = np.ascontiguousarray(y[:, k].T)
            size = np.abs(turned)
            value, axis = np.empty((n, NEXT), np.float32), np.empty((n, NEXT), np.int64)
            for j in range(NEXT):
                best = size.argmax(axis=1)
                value[:, j] = size[row, best]
                axis[:, j] = 2 * best + (turned[row, best] < 0)
                size[row, best] = -1
            lost = (value[:, :1] - value) ** 2
            loss += lost[:, choice[:, k]]
            key += place[k] * axis[:, choice[:, k]]
        loss[:, 0] = -1
        top = np.argsort(loss, axis=1, kind="stable")[:, : 1 + PROBES]
        out[:, t] = t * (2 * dim) ** hashes + np.take_along_axis(key, top, 1)
    return out


def read_vectors(column: pa.Array) -> tuple[list[np.ndarray | None], np.ndarray]:
    """Each row's vector in double precision, or None if it is null, empty or zero or has a null or non-finite component."""
    out = []
    for v in column.to_pylist():
        x = None
        if v and None not in v:
            x = np.array(v, np.float64)
            if not np.isfinite(x).all() or not x.any():
                x = None
        out.append(x)
    return out, np.array([x is not None for x in out], bool)


def by_width(column: pa.Array, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The rows of each length and their vectors in double precision; no row may be null or hold a null."""
    width = column.value_lengths().to_numpy(zero_copy_only=False)
    for w in np.unique(width[rows]).tolist():
        at = rows[width[rows] == w]
        yield at, column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), int(w))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled first, as squares may overflow."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _hash_all(settings: dict[int, tuple[int, int]]):
    """settings: tables and hashes of each padded width."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, n = batch.column("embedding"), batch.num_rows
            digest, keys = np.zeros((n, 2), np.int64), [None] * n
            for rows, x in by_width(column, np.flatnonzero(batch.column("ok").to_numpy(zero_copy_only=False))):
                for i, v, c in zip(rows.tolist(), x, codes(unit(x), *settings[padded(x.shape[1])])):
                    digest[i] = np.frombuffer(xxhash.xxh3_128_digest(v.tobytes()), np.int64)
                    keys[i] = c.ravel()
            new = [pa.array(digest[:, 0]), pa.array(digest[:, 1]), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("ok"), *new, column], names=["vec_id", "ok", "d1", "d2", "keys", "embedding"])

    return run


def first_meeting(i: np.ndarray, j: np.ndarray, code: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Whether ``key`` is the smallest that each pair (i, j) meets in. code: (rows, tables, 1 + PROBES)."""
    mine, open_, none = np.zeros(len(i), bool), np.arange(len(i)), np.iinfo(np.int64).max
    for t in range(code.shape[1]):
        ka, kb = code[i[open_], t], code[j[open_], t]
        first = np.minimum(np.where((kb == ka[:, :1]).any(axis=1), ka[:, 0], none), np.where((ka == kb[:, :1]).any(axis=1), kb[:, 0], none))
        mine[open_[first == key[open_]]] = True
        open_ = open_[first == none]
        if not len(open_):
            break
    return mine


def _near_pairs(x, own, group, side, cosine) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one group (groups are runs of rows) at or above the cosine, one of them with its own code. side: 1 and 2 are compared with each other, 0 with all."""
    start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    size = np.diff(np.r_[start, len(group)])
    small = np.repeat(size <= SMALL, size)
    for d in range(1, SMALL):
        i = np.flatnonzero(small[:-d] & (group[:-d] == group[d:]))
        if not len(i):
            break
        i = i[(own[i] | own[i + d]) & ((side[i] == 0) | (side[i] != side[i + d]))]
        near = np.einsum("ij,ij->i", x[i], x[i + d]) >= cosine
        yield i[near], i[near] + d
    for a, n in zip(start[size > SMALL].tolist(), size[size > SMALL].tolist()):
        rows = np.arange(a, a + n)
        left, right = (rows, rows) if side[a] == 0 else (rows[side[a : a + n] == 1], rows[side[a : a + n] == 2])
        if not len(right):
            continue
        step = max(1, PAIRS // len(right))
        for b in range(0, len(left), step):
            part = left[b : b + step]
            near = (x[part] @ x[right].T >= cosine) & (own[part][:, None] | own[right])
            if side[a] == 0:
                near &= part[:, None] < right
            i, j = np.nonzero(near)
            yield part[i], right[j]


def _looked_at(group: pa.Table, cosine: float, tables: dict[int, int]) -> pa.Table:
    """Of whole groups (key, p, q): (class, null, links) counts, and (id, id, 0) edges that connect what is linked, for the pairs that count here."""
    group = group.combine_chunks()
    column = group.column("embedding").chunk(0)
    width = column.value_lengths().to_numpy(zero_copy_only=False)
    if (width != width[0]).any():  # vectors of different lengths never meet; their codes collide at most by chance
        return pa.concat_tables([_looked_at(group.filter(pa.array(width == w)), cosine, tables) for w in np.unique(width)])
    n = len(width)
    x = unit(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1))
    cid, rep, key, weight, own, chunk, p, q = (group.column(c).to_numpy() for c in ("cid", "rep", "key", "weight", "own", "chunk", "p", "q"))
    # Keys of later tables are larger, so codes end with the bucket's own table. Shorter ones are padded by what no key is.
    held = group.column("keys").chunk(0)
    long_ = held.value_lengths().to_numpy(zero_copy_only=False)
    most = tables[padded(int(width[0]))]
    code = np.full((n, most * (1 + PROBES)), -1, np.int64)
    code[np.arange(most * (1 + PROBES)) < long_[:, None]] = held.flatten().to_numpy()
    code = code.reshape(n, most, 1 + PROBES)
    code[:, :, 0][code[:, :, 0] < 0] = -2
    change = np.r_[False, (key[1:] != key[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])]
    side = np.where(p == q, 0, np.where(chunk == p, 1, 2))
    count, low = np.zeros(n), np.arange(n)
    for i, j in _near_pairs(x, own, np.cumsum(change), side, cosine):
        mine = first_meeting(i, j, code, key[i])
        i, j = i[mine], j[mine]
        count += np.bincount(i, weight[j], n) + np.bincount(j, weight[i], n)
        while True:
            new = low.copy()
            np.minimum.at(new, i, low[j])
            np.minimum.at(new, j, low[i])
            new = new[new]
            if (new == low).all():
                break
            low = new
    # Labels of pairs looked at earlier may have moved on.
    while (low[low] != low).any():
        low = low[low]
    rows, tied = np.flatnonzero(count), np.flatnonzero(low != np.arange(n))
    b = pa.array(np.concatenate([np.zeros(len(rows), np.int64), rep[low[tied]]]), mask=np.arange(len(rows) + len(tied)) < len(rows))
    return pa.table({"a": pa.array(np.concatenate([cid[rows], rep[tied]]).astype(np.int64)), "b": b, "n": pa.array(np.concatenate([count[rows], np.zeros(len(tied))]).astype(np.int64))})


def _blocks(cosine: float, tables: dict[int, int]):
    """Over rows sorted by key, p and q: many small groups are looked at together, a group never in parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(c).to_numpy() for c in ("key", "p", "q")]
            if rows >= ROWS:
                first = tuple(k[0] for k in keys)
                same = np.ones(batch.num_rows, bool)
                for k, v in zip(keys, last):
                    same &= k == v
                cut = int(same.sum()) if first == last else 0  # the rest of the group that is open
                if cut < batch.num_rows:
                    if cut:
                        held.append(batch.slice(0, cut))
                    yield from _looked_at(pa.Table.from_batches(held), cosine, tables).to_batches()
                    held, rows, batch = [], 0, batch.slice(cut)
            held.append(batch)
            rows += batch.num_rows
            last = tuple(k[-1] for k in keys)
        if held:
            yield from _looked_at(pa.Table.from_batches(held), cosine, tables).to_batches()

    return run


def near_vectors(vectors: DataFrame, cosine: float = 0.9) -> DataFrame:
    """Links of the rows of ``vectors`` (vec_id, embedding) at a cosine of at least ``cosine``: vec_id, n_links, component_id, kept.

    Vectors that are null, empty or zero or hold a null or non-finite component link with nothing, nor do vectors of different lengths.
    Repeated rows are vectors of their own that link with each other; rows that share a vec_id but not their vector are counted each for itself, and what one
    of them reaches, the id reaches. A row with a null vec_id links with nothing,
    gets a null component_id and is kept. An empty table gives an empty result. A threshold too low for MOST tables at a width is a ValueError.
    """
    has_columns(vectors, "vec_id", "embedding")
    given = dict(vectors.dtypes)["embedding"]
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(given if given == "array<float>" else "array<double>").alias("embedding")).withColumn("ok", F.expr(USABLE))
    # As padded() has them: 32 rows at most.
    counts = rows.where("ok").groupBy(F.length(F.bin(F.size("embedding") - 1)).alias("bits")).count().collect()
    dims = {1 << max(2, r["bits"]): 0 for r in counts}
    for r in counts:
        dims[1 << max(2, r["bits"])] += r["count"]
    hashes = {dim: hashes_for(n, dim) for dim, n in dims.items()}
    tables = {dim: tables_for(cosine, dim, hashes[dim]) for dim in dims}
    block = min(BLOCK, max(256, COMPONENTS // max([1, *dims])))
    schema = f"vec_id long, ok boolean, d1 long, d2 long, keys array<long>, embedding {dict(rows.dtypes)['embedding']}"
    hashed = rows.transform(in_batches, _hash_all({d: (tables[d], hashes[d]) for d in dims}), schema)
    all_ = durable(hashed.withColumn("row", F.monotonically_increasing_id()), "codes")
    named = all_.where("ok and vec_id is not null")
    # A class of equal vectors is told by a row of its own (cid).
    classes = named.groupBy("d1", "d2").agg(F.min(F.struct("vec_id", "row")).alias("f"), F.count("*").alias("weight"))
    classes = durable(classes.select("d1", "d2", F.col("f.vec_id").alias("rep"), F.col("f.row").alias("cid"), "weight"), "classes")
    reps = named.withColumnRenamed("row", "cid").join(classes.select("cid", "rep", "weight"), "cid")
    spread = reps.select("cid", F.posexplode("keys").alias("at", "key")).select("cid", "key", (F.col("at") % (1 + PROBES) == 0).alias("own"), F.floor(F.col("at") / (1 + PROBES)).cast("int").alias("table"))
    members = spread.groupBy("key").agg(
        F.count("*").alias("c"), F.count_if("own").alias("owns"), F.bit_xor(F.xxhash64("cid", "own")).alias("s1"), F.bit_xor(F.xxhash64(F.lit(7), "cid", "own")).alias("s2")
    )
    # Where buckets have the same members, all their pairs meet first in the smallest key.
    crowded = members.where("c > 1 and owns > 0").groupBy("s1", "s2", "c", "owns").agg(F.min("key").alias("key")).select("key", F.ceil(F.col("c") / block).cast("int").alias("nb"))
    placed = spread.join(crowded, "key").withColumn("chunk", F.pmod(F.xxhash64("cid", F.lit(5)), "nb").cast("int"))
    placed = placed.select("key", "cid", "own", "table", "chunk", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("other"))
    placed = placed.select("key", "cid", "own", "table", "chunk", F.least("chunk", "other").alias("p"), F.greatest("chunk", "other").alias("q"))
    upto = F.slice("keys", F.lit(1), (F.col("table") + 1) * (1 + PROBES))
    work = placed.join(reps.select("cid", "rep", "weight", "keys", "embedding"), "cid").select("key", "p", "q", "chunk", "own", "cid", "rep", "weight", upto.alias("keys"), "embedding")
    sorted_ = work.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q")
    found = durable(sorted_.transform(in_batches, _blocks(cosine, tables), "a long, b long, n long"), "found")
    links = found.where("b is null").groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("n"))
    lows = components(found.where("b is not null").select("a", "b")).withColumnRenamed("node", "rep")
    of = classes.join(links, "cid", "left").join(lows, "rep", "left")
    of = of.select("d1", "d2", "weight", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("links"), F.coalesce("component", "rep").alias("low"))
    out = labelled(all_.select("vec_id", "d1", "d2", F.expr("ok and vec_id is not null").alias("known")), of, links=F.lit(0), low=F.col("vec_id"))
    return out.select("vec_id", F.col("links").cast("long").alias("n_links"), F.col("low").alias("component_id")).withColumn("kept", F.coalesce(F.expr("vec_id = component_id"), F.lit(True)))
