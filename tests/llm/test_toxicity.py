import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lorekeep.llm import queries, toxicity


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    out = queries.op7_factorization(spark, sf).collect()
    assert len(out) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    test = [(r.score, truth[r.doc_id]) for r in out if r.held_out and r.doc_id in truth]
    right = np.mean([(s >= 0.5) == y for s, y in test])
    pos, neg = [s for s, y in test if y], [s for s, y in test if not y]
    auc = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert right >= 0.97 and auc >= 0.93


def test_score_equals_the_plain_sum_over_pairs():
    rng = np.random.default_rng(1)
    terms = np.sort(rng.choice(1000, 40, replace=False))
    m = toxicity.Machine(terms, -0.3, rng.normal(size=40), rng.normal(size=(40, 3)))
    rows = [rng.choice(1000, n) for n in (0, 1, 5, 60, 200)]
    got = m.score(np.repeat(np.arange(5), [len(r) for r in rows]), np.concatenate(rows), 5)
    for g, r in zip(got, rows):
        on = [i for i, t in enumerate(terms) if t in r]
        z = -0.3 + sum(m.weight[i] for i in on) + sum(m.factor[i] @ m.factor[j] for i in on for j in on if i < j)
        assert np.isclose(g, 1 / (1 + np.exp(-z)))


def sets(texts):
    row, term = toxicity.term_sets(pa.array(texts, pa.string()))
    return [np.unique(term[row == i]) for i in range(len(texts))]


def test_learns_a_pair_that_single_words_do_not_tell():
    texts = ["red here", "blue here", "red blue", "plain words"] * 60
    label = np.array([0, 0, 1, 0] * 60, float)
    seen = toxicity.SEEN
    toxicity.SEEN = 1.0
    try:
        m = toxicity.fit(sets(texts), label)
    finally:
        toxicity.SEEN = seen
    row, term = toxicity.term_sets(pa.array(texts[:4]))
    assert ((m.score(row, term, 4) >= 0.5) == label[:4]).all()


def test_learns_a_pair_of_balanced_words():
    """At production settings: each word is as often in toxic texts as in clean ones, and only the pair tells."""
    texts = ["red here", "blue here", "red blue", "plain words"] * 100
    label = np.array([0, 0, 1, 1] * 100, float)
    m = toxicity.fit(sets(texts), label)
    row, term = toxicity.term_sets(pa.array(texts[:3]))
    assert ((m.score(row, term, 3) >= 0.5) == label[:3]).all()
    rng = np.random.default_rng(2)
    noise = [" ".join(rng.choice([f"w{i}" for i in "abcdefghijklmnop"], 8)) for _ in range(600)]
    assert len(toxicity.fit(sets(noise), (rng.random(600) < 0.4).astype(float)).terms) == 0


def test_terms_are_words_and_beginnings():
    a, b, c = sets(["Running, RUNNING!", "run", None])
    assert len(a) == 4 and len(b) == 1 and len(c) == 0  # running and its first four, five and six letters
    assert len(np.intersect1d(*sets(["running", "runners"]))) == 1  # runn-
    assert len(np.intersect1d(*sets(["runn", "running"]))) == 0  # a whole word is no beginning


def test_no_label_leaks(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.train(docs, labels), toxicity.train(docs, turned)
    assert (a.terms == b.terms).all() and (a.weight == b.weight).all() and a.bias == b.bias


def test_edge_cases(spark):
    docs = spark.createDataFrame([(None, "bad words"), (1, None), (2, ""), (3, "x " * 100_000), (3, "x " * 100_000)], "doc_id long, text string").selectExpr("*", "1 as score", "'a' as toxic")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    m = toxicity.train(docs, none)
    out = toxicity.score(docs, m).collect()
    assert len(out) == 5 and all(r.score == 0.5 and r.predicted == 1 for r in out) and all(r.held_out is not None for r in out)
    assert toxicity.score(docs.limit(0), m).collect() == []
    odd = spark.createDataFrame([(None, 1), (3, None), (3, 7)], "doc_id long, toxic int")
    assert len(toxicity.train(docs, odd).terms) == 0
    assert toxicity.keep_clean(docs, toxicity.Machine(m.terms, -1.0, m.weight, m.factor)).columns == docs.columns
