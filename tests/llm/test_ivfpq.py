import numpy as np

from lorekeep.llm import ivfpq


def brute(x, ids, q, k):
    d = np.sqrt(((x - x[ids.index(q)]) ** 2).sum(1))
    order = sorted((d[i], ids[i]) for i in range(len(ids)) if ids[i] != q)
    return order[:k]


def test_recall_and_exact_scores(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = df.collect()
    ids, x = [r.vec_id for r in rows], np.array([r.embedding for r in rows], np.float64)
    got = ivfpq.search(df, df.where("vec_id % 100 = 0"), 10).collect()
    hits = 0
    for q in [i for i in ids if i % 100 == 0]:
        mine = sorted((r.rank, r.score, r.vec_id) for r in got if r.query_id == q)
        assert [m[0] for m in mine] == list(range(1, 11)) and [(s, v) for _, s, v in mine] == sorted((s, v) for _, s, v in mine)
        want = brute(x, ids, q, 10)
        hits += len({v for _, _, v in mine} & {v for _, v in want})
        for _, s, v in mine:
            assert abs(s - np.sqrt(((x[ids.index(v)] - x[ids.index(q)]) ** 2).sum())) < 1e-12
    assert hits >= 0.9 * len(got)


def test_chunks_and_turns(spark, monkeypatch):
    monkeypatch.setattr(ivfpq, "CHUNK", 30)
    monkeypatch.setattr(ivfpq, "QUERIES", 7)
    monkeypatch.setattr(ivfpq, "RECALL", 1.0)
    monkeypatch.setattr(ivfpq, "RERANK", 10_000)
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = df.collect()
    ids, x = [r.vec_id for r in rows], np.array([r.embedding for r in rows], np.float64)
    got = ivfpq.search(df, df.where("vec_id % 10 = 0"), 10).collect()
    for q in [i for i in ids if i % 10 == 0]:
        assert [(r.score, r.vec_id) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == brute(x, ids, q, 10)


def test_edge_cases(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [1.0, -1.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [1.0]), (None, [1.0, 0.0]), (100, None), (2, [1.0, -1.0]), (0, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as rank", "2 as list")
    got = [tuple(r) for r in ivfpq.search(df, df.where("vec_id % 100 = 0"), 10).collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 2, 1.0)]
    assert ivfpq.search(df.limit(0), df, 10).collect() == []
    assert ivfpq.search(df, df.limit(0), 10).collect() == []


def answers(got):
    out = {}
    for r in sorted(got, key=lambda r: r.rank):
        out.setdefault(r.query_id, []).append((r.score, r.vec_id))
    return out


def test_copies_keep_the_smallest_ids(spark):
    """A third of all rows are one vector: who lies in or next to it gets the copies with the smallest ids."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 16))
    copies = np.arange(0, 1500, 3)
    x[copies] = x[0]
    near = x[0] + 1e-3 * rng.normal(size=(3, 16))
    x[[1, 4, 7]] = near
    ids = rng.permutation(1500).tolist()
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>").repartition(7)
    asked = [ids[j] for j in (0, 3, 300, 1497, 1, 4, 7)]
    got = answers(ivfpq.search(df, df.where(f"vec_id in ({', '.join(map(str, asked))})"), 10).collect())
    for q in asked:
        assert got[q] == brute(x, ids, q, 10)


def test_ties_at_the_cut_are_measured():
    """Different vectors with one code tie at the cut; the nearest of them must not depend on their order."""
    rng = np.random.default_rng(6)
    x = np.concatenate([1 + 1e-6 * rng.normal(size=(400, 8)), [[1.0] * 8]])
    index = ivfpq.Index(np.zeros((1, 8)), [np.array([[1.0] * 4, [5.0] * 4])] * 2, [0, 4, 8])
    code = index.encode(x)[1]
    want = np.argsort(ivfpq.exact(x[400], x[:400]))[:10]
    for order in (np.arange(400), np.arange(400)[::-1]):
        rows = [*order.tolist(), 400]
        group = {"list": [0] * 401, "vec_id": rows, "x": x[rows].tolist(), "code": [code[i].tobytes() for i in order] + [None], "asked": [False] * 400 + [True], "ids": [[i] for i in order.tolist()] + [None]}
        group["x"] = ivfpq.pa.array(group["x"], ivfpq.pa.list_(ivfpq.pa.float64()))
        found = ivfpq._search(index, 10)(ivfpq.pa.table(group))
        assert found.column("vec_id").to_pylist() == want.tolist()


def test_bad_vectors_do_not_fill_the_sample(spark, monkeypatch):
    """Zero, null and infinite vectors by the hundred: the sample holds usable ones only, so all of those are found."""
    monkeypatch.setattr(ivfpq, "FIT_ROWS", 20)
    rng = np.random.default_rng(3)
    bad = [[0.0] * 8, None, [float("inf")] * 8, [None] + [1.0] * 7, []]
    good = [(1000 + i, rng.normal(size=8).tolist()) for i in range(20)]
    rows = [(i, bad[i % 5]) for i in range(600)] + good
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ivfpq.search(df, df.where("vec_id = 1000 or vec_id = 0"), 5).collect()
    x, ids = np.array([v for _, v in good]), [i for i, _ in good]
    assert answers(got) == {1000: brute(x, ids, 1000, 5)}


def test_recall_on_clustered_vectors_from_few_lists(spark):
    """Vectors in clusters: the share of rows read is small, the exact measures are a constant number a chunk, and recall holds."""
    rng = np.random.default_rng(12)
    x = (rng.normal(size=(40, 32))[rng.integers(0, 40, 6000)] + 0.15 * rng.normal(size=(6000, 32))).astype(np.float64)
    index = ivfpq.build(x, 77)
    assert ivfpq.probe_share(index, x, 10) < 0.15
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = answers(ivfpq.search(df, df.where("vec_id % 100 = 0"), 10).collect())
    hits = sum(len({v for _, v in got[q]} & {v for _, v in brute(x, list(range(6000)), q, 10)}) for q in range(0, 6000, 100))
    assert hits >= 0.9 * 600


def test_queries_unlike_the_sample_find_their_nearest(spark):
    """Rows in tight clusters far from the queries, which the sample hardly holds, and vectors far from the origin: all of the truly nearest are found, in order."""
    rng = np.random.default_rng(21)
    x = 3 * rng.normal(size=(20, 32))[rng.integers(0, 20, 2000)] + 0.1 * rng.normal(size=(2000, 32))
    x[::100] = 3 * rng.normal(size=(20, 32))
    for moved in (x, 1e8 + x):
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(moved)], "vec_id long, embedding array<double>")
        got = answers(ivfpq.search(df, df.where("vec_id % 100 = 0"), 10).collect())
        for q in range(0, 2000, 100):
            assert got[q] == brute(moved, list(range(2000)), q, 10)
