"""Nearest neighbours by an inverted file of coarse centroids with product-quantised residuals.

Centroids and code books are fitted on the driver from a bounded sample of distinct vectors (FIT_ROWS); every row is indexed. A query first reads the lists nearest to it,
until they hold a share of all rows that is measured: the least that found RECALL of the sample's own nearest neighbours (clustered vectors need
few lists, vectors without structure most of them), and as many rows as it must return. The distance of the k-th row found there is a bound: every other list is then read
too, unless its centroid's distance less its radius exceeds the bound. So what a query finds doesn't depend on how well the sample stands for it. Lists and the queries that read them are cut into chunks of bounded size that meet
in one task: asymmetric distance tables rank a chunk's codes, the best RERANK rows of it and all that tie with the last of them are
measured exactly on the original vectors, then all others whose code, less the distance between code and vector, doesn't put them beyond the k-th of these. The k nearest rows of each chunk go on to the query's final ranking.

Equal vectors are one class: it is indexed once, and carries the smallest of its ids, as many as any query can return. So copies
neither fill a list nor are torn apart by a cut or by rounding.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, grouped, has_columns, in_batches
from .polytope import read_vectors

#: Distinct vectors that centroids and code books are fitted on: those whose hashed ids are smallest.
FIT_ROWS = 20_000
MAX_LISTS = 4096
#: Share of the sample's nearest neighbours that the lists read must hold, rows of the sample that ask for theirs, and rows of a chunk that a query measures exactly at first.
RECALL, ASKING, RERANK = 0.97, 500, 128
#: Vectors that take part: not empty, all components there and finite, not all of them zero.
USABLE = "size(embedding) > 0 and forall(embedding, x -> x is not null and abs(x) < double('infinity')) and exists(embedding, x -> x <> 0)"
SUBSPACES, CODES = 16, 256
#: Classes of a list, and queries, in one task's chunk.
CHUNK, QUERIES = 4096, 1024


def kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    k = min(k, len(x))
    centre = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        at = nearest(x, centre)
        count = np.bincount(at, minlength=k)
        total = np.zeros_like(centre)
        np.add.at(total, at, x)
        full = count > 0
        centre[full] = total[full] / count[full, None]
    return centre


#: What rounding may add to or take from a squared distance, as a share of the squared lengths in it.
ROUNDING = 1e-11


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances, from vectors moved to the rows' mean, as far ones would lose their differences to rounding."""
    middle = y.mean(axis=0)
    x, y = x - middle, y - middle
    return (x * x).sum(axis=1)[:, None] - 2 * x @ y.T + (y * y).sum(axis=1)


def nearest(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.concatenate([distances(x[a : a + 4096], centre).argmin(axis=1) for a in range(0, len(x), 4096)] or [np.empty(0, np.int64)])


@dataclass
class Index:
    centre: np.ndarray  # lists x dim
    books: list[np.ndarray]  # per subspace: codes x its dims
    cuts: list[int]  # bounds of the subspaces

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = nearest(x, self.centre)
        rest = x - self.centre[at]
        return at, np.stack([nearest(rest[:, a:b], book) for a, b, book in zip(self.cuts, self.cuts[1:], self.books)], 1).astype(np.uint8)

    def decoded(self, at: np.ndarray, code: np.ndarray) -> np.ndarray:
        return self.centre[at] + np.concatenate([book[code[:, s]] for s, book in enumerate(self.books)], axis=1)

    def tables(self, rest: np.ndarray) -> np.ndarray:
        """queries x subspaces x codes: squared distances of the queries' residuals to the code words."""
        out = np.full((len(rest), len(self.books), CODES), np.inf)
        for s, (a, b, book) in enumerate(zip(self.cuts, self.cuts[1:], self.books)):
            out[:, s, : len(book)] = distances(rest[:, a:b], book)
        return out


def build(sample: np.ndarray, lists: int) -> Index:
    rng = np.random.default_rng(11)
    centre = kmeans(sample, lists, 8, rng)
    rest = sample - centre[nearest(sample, centre)]
    dim = sample.shape[1]
    cuts = np.unique(np.linspace(0, dim, min(SUBSPACES, dim) + 1).astype(int)).tolist()
    return Index(centre, [kmeans(rest[:, a:b], CODES, 8, rng) for a, b in zip(cuts, cuts[1:])], cuts)


def probe_share(index: Index, sample: np.ndarray, k: int) -> float:
    """The share of all rows in the nearest lists that holds RECALL of the k nearest neighbours, over some of the sample's rows."""
    at = nearest(sample, index.centre)
    sizes = np.bincount(at, minlength=len(index.centre))
    asking = np.random.default_rng(13).permutation(len(sample))[:ASKING]
    needed = []
    for i in asking:
        d = distances(sample[i : i + 1], sample)[0]
        d[i] = np.inf
        near = np.argpartition(d, min(k, len(d) - 1))[:k]
        order = np.argsort(distances(sample[i : i + 1], index.centre)[0], kind="stable")
        before = np.empty(len(order))
        before[order] = np.cumsum(sizes[order]) - sizes[order]
        needed.append(before[at[near]] / len(sample))
    # Lists are read as long as those before them hold less than the share.
    return float(np.nextafter(np.quantile(np.concatenate(needed), RECALL, method="higher"), 2))


def _valid(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    vectors, ok = read_vectors(column)
    rows = [i for i in np.flatnonzero(ok).tolist() if len(vectors[i]) == dim]
    return np.array(rows, np.int64), np.stack([vectors[i] for i in rows]) if rows else np.empty((0, dim))


def classes(vectors: DataFrame, k: int) -> DataFrame:
    """embedding, vec_id (the smallest) and ids of each class of equal vectors: its k + 1 smallest ids (one may be the query's own), each as often as it stands there, up to k times."""
    one = vectors.groupBy("embedding", "vec_id").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("n"))
    place = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    # The limit of a window holds before its shuffle as well, so a large class is no large group.
    few = one.withColumn("place", place).where(F.col("place") <= k + 1).groupBy("embedding").agg(F.array_sort(F.collect_list(F.struct("vec_id", "n"))).alias("t"))
    return few.select("embedding", F.col("t")[0]["vec_id"].alias("vec_id"), F.flatten(F.transform("t", lambda r: F.array_repeat(r["vec_id"], r["n"]))).alias("ids"))


def _assign(index: Index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                rows, x = _valid(part.column("embedding"), index.centre.shape[1])
                at, code = index.encode(x) if len(rows) else (rows, np.empty((0, len(index.books)), np.uint8))
                yield pa.RecordBatch.from_arrays(
                    [part.column("vec_id").take(pa.array(rows)), part.column("ids").take(pa.array(rows)), pa.array(at.astype(np.int32)), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(list(x), pa.list_(pa.float64()))]
                    + [pa.array(lengths(x - index.centre[at]) if len(rows) else np.empty(0))],
                    names=["vec_id", "ids", "list", "code", "x", "far"],
                )

    return run


def lengths(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(axis=1))


def _probe(index: Index, sizes: np.ndarray, least: float, radii: np.ndarray):
    """The lists that a query reads: without a bound those that hold ``least`` rows, with one those of the others that it doesn't rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                x = np.array(part.column("x").to_pylist(), np.float64).reshape(part.num_rows, -1)
                order = np.argsort(distances(x, index.centre), axis=1, kind="stable")
                before = np.cumsum(sizes[order], axis=1) - sizes[order]
                bound = part.column("bound").to_numpy(zero_copy_only=False)
                near = np.stack([lengths(index.centre - q) for q in x])
                near = np.take_along_axis(near - ROUNDING * (near + radii) - radii, order, axis=1)
                # What can't be compared isn't ruled out.
                more = (before >= least) & ~(near > bound[:, None])
                row, at = np.nonzero(np.where(part.column("first").to_numpy(zero_copy_only=False)[:, None], before < least, more) & (sizes[order] > 0))
                yield pa.RecordBatch.from_arrays([part.column(n).take(pa.array(row)) for n in ("vec_id", "x", "bound")] + [pa.array(order[row, at].astype(np.int32))], names=["vec_id", "x", "bound", "list"])

    return run


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Euclidean distances of one vector to rows."""
    d = x - q
    return np.sqrt((d * d).sum(axis=1))


def _search(index: Index, k: int):
    def run(group: pa.Table) -> pa.Table:
        asked = group.column("asked").to_numpy()
        ids = group.column("vec_id").to_numpy()
        x = np.array(group.column("x").combine_chunks().values.to_numpy(zero_copy_only=False)).reshape(len(ids), -1)
        qs, ms = np.flatnonzero(asked), np.flatnonzero(~asked)
        out: list[tuple[np.ndarray, ...]] = []
        if len(qs) and len(ms):
            code = np.frombuffer(b"".join(group.column("code").take(pa.array(ms)).to_pylist()), np.uint8).reshape(len(ms), -1).astype(np.int64)
            held = group.column("ids").take(pa.array(ms)).combine_chunks()
            named, owner = held.flatten().to_numpy(), np.repeat(np.arange(len(ms)), held.value_lengths().to_numpy())
            member, centre = x[ms], index.centre[group.column("list")[0].as_py()]
            off = lengths(member - index.decoded(np.full(len(ms), group.column("list")[0].as_py()), code)) * (1 + ROUNDING)
            bounds = group.column("bound").to_numpy() if "bound" in group.column_names else np.full(len(ids), np.inf)
            longest = sum((book * book).sum(axis=1).max() for book in index.books)
            # One more than asked for: the query itself may be among them.
            many = min(len(ms), max(4 * k, RERANK) + 1)
            column = np.arange(code.shape[1])
            far = lengths(member - centre)

            def nearest_named(measured: np.ndarray, d: np.ndarray, own: int) -> np.ndarray:
                rows = np.flatnonzero(measured[owner] & (named != own))
                return rows[np.lexsort((named[rows], d[owner[rows]]))[:k]]

            for a in range(0, len(qs), 64):
                part = qs[a : a + 64]
                rests, whole = x[part] - centre, None
                for i, (q, table) in enumerate(zip(part, index.tables(rests))):
                    near = table[column, code].sum(axis=1)
                    best = near <= np.partition(near, many - 1)[many - 1]
                    d = np.full(len(ms), np.inf)
                    d[best] = exact(x[q], member[best])
                    top = nearest_named(best, d, ids[q])
                    bound = min(bounds[q], d[owner[top[-1]]] if len(top) == k else np.inf)
                    rest = (rests[i] * rests[i]).sum()
                    more = ~best & ~(np.sqrt(np.maximum(near - ROUNDING * (rest + longest), 0)) - off > bound)
                    if more.any():
                        if whole is None:
                            whole = distances(rests, member - centre)
                        slack = ROUNDING * (rest + (far * far).max() + bound * bound)
                        more &= ~(whole[i] - slack > bound * bound)
                        d[more] = exact(x[q], member[more])
                        top = nearest_named(best | more, d, ids[q])
                    out.append((np.full(len(top), ids[q]), named[top], d[owner[top]]))
        cat = [np.concatenate(c) for c in zip(*out)] if out else [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        return pa.table({"query_id": pa.array(cat[0], pa.int64()), "vec_id": pa.array(cat[1], pa.int64()), "score": pa.array(cat[2], pa.float64())})

    return run


def search(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` nearest rows of ``vectors`` for each row of ``queries`` (both vec_id, embedding): query_id, rank, vec_id, score.

    Vectors that are null, empty or zero, hold a null or non-finite component or differ in length from most
    of the sample take no part, nor do rows with a null vec_id. A query never finds rows with its own id; ties go to the smaller
    vec_id. Repeated rows are candidates of their own, and repeated queries count once. Empty tables give an empty result.
    """
    has_columns(vectors, "vec_id", "embedding")
    # Unusable vectors go before anything is sampled.
    clean = lambda df: df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id is not null").where(USABLE)
    vectors, queries = durable(classes(clean(vectors), k), "classes"), clean(queries)
    sample, _ = read_vectors(vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(FIT_ROWS).select("embedding").toArrow().column("embedding"))
    schema = "query_id long, rank int, vec_id long, score double"
    if not sample:
        return vectors.sparkSession.createDataFrame([], schema)
    widths = np.bincount([len(x) for x in sample])
    sample = np.stack([x for x in sample if len(x) == widths.argmax()])
    index = build(sample, min(MAX_LISTS, max(1, round(vectors.count() ** 0.5))))
    share = probe_share(index, sample, k) if len(sample) > 1 else 1.0
    assigned = "vec_id long, ids array<long>, list int, code binary, x array<double>, far double"
    members = durable(vectors.transform(in_batches, _assign(index), assigned), "members")
    sizes, radii = np.zeros(len(index.centre)), np.zeros(len(index.centre))
    for r in members.groupBy("list").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect():  # at most MAX_LISTS rows
        sizes[r["list"]], radii[r["list"]] = r["n"], r["far"]
    asking = queries.dropDuplicates(["vec_id"]).withColumn("ids", F.lit(None).cast("array<long>")).transform(in_batches, _assign(index), assigned)
    asking = durable(asking.select("vec_id", "x"), "asking")
    # Its own row may stand in the lists, so one more than k; each class has a row at least.
    probe = _probe(index, sizes, max(share * sizes.sum(), k + 1), radii)
    hashed = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")

    def meet(asking: DataFrame) -> DataFrame:
        """query_id, vec_id and score of the k nearest rows in each chunk that ``asking`` (vec_id, x, bound, first) reads."""
        probes = durable(asking.select("vec_id", "x", "bound", "first").transform(in_batches, probe, "vec_id long, x array<double>, bound double, list int"), "probes")
        asked = probes.groupBy("list").count().collect()  # at most MAX_LISTS rows
        cut = [(r["list"], max(1, -(-int(sizes[r["list"]]) // CHUNK)), -(-r["count"] // QUERIES)) for r in asked]
        # Into how many chunks each list that is read, and the queries that read it, are cut.
        cut = F.broadcast(vectors.sparkSession.createDataFrame(cut, "list int, parts int, turns int"))
        left = members.join(cut, "list").withColumns({"chunk": hashed("parts"), "turn": F.explode(F.sequence(F.lit(0), F.col("turns") - 1))})
        right = probes.join(cut, "list").withColumns({"turn": hashed("turns"), "chunk": F.explode(F.sequence(F.lit(0), F.col("parts") - 1))})
        names = ["list", "chunk", "turn", "vec_id", "x"]
        only = lambda name, kind: F.lit(None).cast(kind).alias(name)
        both = left.select(*names, "code", "ids", F.lit(0.0).alias("bound"), F.lit(False).alias("asked")).unionAll(right.select(*names, only("code", "binary"), only("ids", "array<long>"), "bound", F.lit(True).alias("asked")))
        return grouped(both, ["list", "chunk", "turn"], _search(index, k), "query_id long, vec_id long, score double")

    found = durable(meet(asking.withColumns({"bound": F.lit(float("inf")), "first": F.lit(True)})), "found")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    bound = found.withColumn("p", place).where(F.col("p") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("bound"))
    again = asking.join(bound, "vec_id", "left").withColumns({"bound": F.coalesce("bound", F.lit(float("inf"))), "first": F.lit(False)})
    found = found.unionAll(meet(again))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
