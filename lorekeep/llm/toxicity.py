"""Toxicity scores by a factorization machine over hashed terms.

A document is the set of its hashed terms: runs of letters in lower case, and the first four, five and six letters of longer ones. The machine adds a weight for each term and, for
each pair of its terms, the inner product of two learnt vectors, so that a pair can weigh more, or less, than its
parts do. It is fitted on the driver from a bounded sample of labelled rows (FIT_ROWS), whose texts are turned into term sets on the executors;
terms take part if a likelihood-ratio test on that sample finds them telling, alone or, for terms that tell nothing alone, as one of a pair, so a term's weight never rests on a handful of
rows. Scoring reads every text whole, in one pass, with no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import has_columns, in_batches, slices, words

#: Labelled rows that a fit reads at most: those whose hashed ids are smallest.
FIT_ROWS = 8_000
#: Hashed terms: 2**SPACE.
SPACE = 26
TERMS, FACTORS, TELLING, STEPS = 4096, 8, 25.0, 300
#: Terms that tell nothing alone but are seen in LEAST rows or more are looked at in pairs, the PAIRED most frequent of them; there are many pairs, so more is asked of one.
PAIRED, LEAST, TELLING_PAIR = 1500, 20, 50.0
#: Share of its terms that a row shows in each step of the fit, so that no term leans on others that mostly come with it.
SEEN = 0.5
#: Decay of the pairs' vectors: ten times the words' own, so that a word that is telling alone gets its weight itself.
PAIRS = 1e-4
#: Lengths of the beginnings that are terms of longer words.
BEGINNINGS = (4, 5, 6)


def term_sets(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, hashed term) of the words of each text and of their beginnings, so that a word's inflected forms have terms in common."""
    letters = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(text, "")), r"[^\pL]+", " ")
    flat, at = words(letters)
    coded = flat.dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False) if len(flat) else np.empty(0, np.int64)
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    hashes = [_hashed(coded.dictionary)]
    rows, known = [row], [hashes[0][code] if len(code) else np.empty(0, np.int64)]
    size = pc.utf8_length(coded.dictionary).to_numpy(zero_copy_only=False)
    for n in BEGINNINGS:
        longer = size > n
        if not longer.any():
            continue
        starts = pc.binary_join_element_wise(pc.utf8_slice_codeunits(coded.dictionary, 0, n), "", "-").dictionary_encode()
        h = _hashed(starts.dictionary)[starts.indices.to_numpy(zero_copy_only=False)]
        has = longer[code]
        rows.append(row[has])
        known.append(h[code[has]])
    return np.concatenate(rows), np.concatenate(known)


def _hashed(terms: pa.Array) -> np.ndarray:
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, terms.cast(pa.binary()).to_pylist()), np.uint64, len(terms))
    return (h >> np.uint64(64 - SPACE)).astype(np.int64)


@dataclass
class Machine:
    terms: np.ndarray  # sorted
    bias: float
    weight: np.ndarray
    factor: np.ndarray

    def score(self, row: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
        """Probability for each of n rows; a row without known terms gets the bias's."""
        at = np.searchsorted(self.terms, term)
        known = at < len(self.terms)
        known[known] = self.terms[at[known]] == term[known]
        pairs = np.unique(row[known] * max(len(self.terms), 1) + at[known])
        r, t = np.divmod(pairs, max(len(self.terms), 1))
        return _sigmoid(_logit(r, t, n, self.bias, self.weight, self.factor)[0])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _sums(r: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of ``x`` by ``r``, which is in order."""
    out = np.zeros((n, *x.shape[1:]))
    if len(r):
        first = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
        out[r[first]] = np.add.reduceat(x, first, axis=0)
    return out


def _logit(r, t, n, bias, weight, factor):
    total, square = _sums(r, factor[t], n), _sums(r, factor[t] ** 2, n)
    return bias + _sums(r, weight[t], n) + 0.5 * (total**2 - square).sum(axis=1), total


def _ratio(seen, hit, n: float, positive: float) -> np.ndarray:
    """The likelihood-ratio statistic of what is in ``seen`` rows, ``hit`` of them positive, of ``n`` rows with ``positive`` positive ones."""

    def g(observed, expected):
        return np.where(observed > 0, observed * np.log(np.maximum(observed, 1e-12) / np.maximum(expected, 1e-12)), 0)

    p = positive / n
    return 2 * (g(hit, seen * p) + g(seen - hit, seen * (1 - p)) + g(positive - hit, (n - seen) * p) + g(n - seen - positive + hit, (n - seen) * (1 - p)))


def _in_pairs(row, term, label, share, seen, test) -> np.ndarray:
    """Terms that aren't telling alone but are part of a telling pair of such terms, TERMS at most."""
    able = np.flatnonzero((test < TELLING) & (seen >= LEAST))
    able = np.sort(able[np.argsort(-seen[able], kind="stable")[:PAIRED]])
    if len(able) < 2:
        return able[:0]
    place = np.full(len(seen), -1)
    place[able] = np.arange(len(able))
    keep = place[term] >= 0
    row, at = row[keep], place[term[keep]]
    both, hit = np.zeros((2, len(able), len(able)), np.float32)
    for a in range(0, len(label), 500):
        of = (row >= a) & (row < a + 500)
        x = np.zeros((min(500, len(label) - a), len(able)), np.float32)
        x[row[of] - a, at[of]] = 1
        y = x * share[a : a + 500, None].astype(np.float32)
        both += y.T @ x
        hit += (y * label[a : a + 500, None].astype(np.float32)).T @ x
    n, positive = share.sum(), float((share * label).sum())
    np.fill_diagonal(both, 0)
    best = np.zeros(len(able))
    for a in range(0, len(able), 100):  # a few rows of the square at a time
        seen2, hit2 = both[a : a + 100].astype(np.float64), hit[a : a + 100].astype(np.float64)
        ratio = _ratio(seen2, hit2, n, positive)
        best[a : a + 100] = np.where((ratio >= TELLING_PAIR) & (seen2 >= LEAST), ratio, 0).max(axis=1)
    return able[np.argsort(-best, kind="stable")[: min(TERMS, int((best > 0).sum()))]]


def fit(rows: list[np.ndarray], label: np.ndarray, share: np.ndarray | None = None) -> Machine:
    """``rows``: term sets; ``share``: weight of each row."""
    share = np.ones(len(rows)) if share is None else share
    n, positive = share.sum(), float((share * label).sum())
    prior = (positive + 0.5) / (n + 1)
    empty = Machine(np.empty(0, np.int64), float(np.log(prior / (1 - prior))), np.zeros(1), np.zeros((1, FACTORS)))
    if not len(rows) or not 0 < positive < n:
        return empty
    row, term = np.repeat(np.arange(len(rows)), [len(x) for x in rows]), np.concatenate(rows)
    terms, coded = np.unique(term, return_inverse=True)
    seen = np.bincount(coded, share[row], len(terms))
    hit = np.bincount(coded, (share * label)[row], len(terms))

    test = _ratio(seen, hit, n, positive)
    chosen = np.flatnonzero(test >= TELLING)
    chosen = chosen[np.argsort(-test[chosen], kind="stable")[:TERMS]]
    chosen = np.sort(np.concatenate([chosen, _in_pairs(row, coded, label, share, seen, test)]))
    if not len(chosen):
        return empty
    place = np.full(len(terms), -1)
    place[chosen] = np.arange(len(chosen))
    keep = place[coded] >= 0
    r, t = row[keep], place[coded][keep]
    by_term = np.argsort(t, kind="stable")
    in_order = t[by_term]
    rng = np.random.default_rng(7)
    w = {"b": np.array(np.log(prior / (1 - prior))), "w": np.zeros(len(chosen)), "v": rng.normal(0, 0.05, (len(chosen), FACTORS))}
    m, s = {k: np.zeros_like(x) for k, x in w.items()}, {k: np.zeros_like(x) for k, x in w.items()}
    for step in range(1, STEPS + 1):
        on = rng.random(len(r)) < SEEN
        z, total = _logit(r[on], t[on], len(rows), w["b"], w["w"], w["v"])
        d = share * (_sigmoid(z) - label) / n
        of = np.where(on[:, None], d[r][:, None] * (total[r] - w["v"][t]), 0)[by_term]
        grad = {"b": d.sum(), "w": np.bincount(t[on], d[r[on]], len(chosen)) + 1e-5 * w["w"], "v": _sums(in_order, of, len(chosen)) + PAIRS * w["v"]}
        for k in w:  # Adam
            m[k] = 0.9 * m[k] + 0.1 * grad[k]
            s[k] = 0.99 * s[k] + 0.01 * grad[k] ** 2
            w[k] = w[k] - 0.05 * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-8)
    return Machine(terms[chosen], float(w["b"]), w["w"], w["v"])


def held_out(doc_id: Column) -> Column:
    """True where the id's checksum, modulo 5, is 0; a null id is as ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _collect_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text"):
        row, term = term_sets(part.column("text"))
        pairs = np.unique((row << SPACE) | term)
        ends = np.searchsorted(pairs, np.arange(part.num_rows + 1) << SPACE).astype(np.int32)
        yield pa.RecordBatch.from_arrays([part.column("toxic").cast(pa.int32()), pa.ListArray.from_arrays(pa.array(ends), pa.array((pairs & ((1 << SPACE) - 1)).astype(np.int32)))], names=["toxic", "terms"])


def train(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Machine:
    """Fits on at most ``rows`` labelled rows (label 0 or 1) that aren't held out; copies count once, with their mean label, and of texts with the same id the smallest."""
    has_columns(labels, "doc_id", "toxic")
    some = labels.where("doc_id is not null and toxic in (0, 1)").where(~held_out(F.col("doc_id"))).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    some = some.distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(rows)  # so many rows may be broadcast
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # One text for each labelled id, however many rows repeat it, so what reaches the driver is bounded too.
    texts = texts.join(F.broadcast(some), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    got = texts.transform(in_batches, _collect_terms, "toxic int, terms array<int>").toArrow()
    by: dict[bytes, list] = {}
    for terms, y in zip(got.column("terms"), got.column("toxic").to_pylist()):
        x = terms.values.to_numpy(zero_copy_only=False)
        entry = by.setdefault(x.tobytes(), [x, 0, 0])
        entry[1] += y
        entry[2] += 1
    kept = [by[k] for k in sorted(by)]
    return fit([x for x, _, _ in kept], np.array([y / c for _, y, c in kept]))


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """Each row of ``docs`` (doc_id, text): doc_id, held_out, score and predicted.

    A null or empty text is scored by the bias alone. Copies get equal scores, and a null doc_id counts as ''. An empty table gives
    an empty result, and without labels every score is one half.
    """
    has_columns(docs, "doc_id", "text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    out = rows.transform(in_batches, _score_only(machine), "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def _score_only(machine: Machine):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            found = machine.score(*term_sets(part.column("text")), part.num_rows)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(found)], names=["doc_id", "held_out", "score"])

    return run


def _keep_all(machine: Machine):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            found = machine.score(*term_sets(part.column("text").cast(pa.string())), part.num_rows)
            yield part.filter(pa.array(found < 0.5))

    return run


def keep_clean(docs: DataFrame, machine: Machine) -> DataFrame:
    """The rows of ``docs`` that aren't predicted toxic, with the same columns."""
    has_columns(docs, "text")
    return docs.transform(in_batches, _keep_all(machine), docs.schema)
