from itertools import product

import numpy as np
import pytest

from lorekeep.llm import polytope


def brute(rows, cosine):
    ids = [i for i, _ in rows]
    x = np.array([v for _, v in rows], np.float64)
    s = (x @ x.T) / np.sqrt((x * x).sum(1))[:, None] / np.sqrt((x * x).sum(1))
    near = s >= cosine
    np.fill_diagonal(near, False)
    low = np.arange(len(ids))
    order = np.argsort(ids)
    near = near[np.ix_(order, order)]
    while True:
        new = np.array([min(low[i], *(low[near[i]].tolist() or [low[i]])) for i in range(len(ids))])
        if (new == low).all():
            break
        low = new
    return {ids[order[i]]: (int(near[i].sum()), ids[order[low[i]]]) for i in range(len(ids))}


def result(df):
    return {r.vec_id: (r.n_links, r.component_id) for r in df.collect()}


def test_equals_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = polytope.near_vectors(df, 0.9).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == brute([(r.vec_id, r.embedding) for r in df.collect()], 0.9)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_links_near_the_threshold_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(polytope, "BLOCK", 40)
    rng = np.random.default_rng(2)
    centre = rng.normal(size=(6, 64))
    rows = [(int(i), (centre[i % 6] + rng.normal(size=64) * 0.3).astype(np.float32).tolist()) for i in rng.permutation(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    want = brute(rows, 0.9)
    got = result(polytope.near_vectors(df, 0.9))
    assert sum(n for n, _ in want.values()) > 1000
    assert {i: c for i, (_, c) in got.items()} == {i: c for i, (_, c) in want.items()}
    assert all(got[i][0] <= want[i][0] for i in want) and sum(n for n, _ in got.values()) >= 0.999 * sum(n for n, _ in want.values())


def test_edge_cases(spark):
    one = [1.0, 2.0, 3.0, 4.0]
    rows = [(1, one), (2, one), (2, one), (3, None), (4, []), (5, [0.0] * 4), (6, [None, 1.0, 1.0, 1.0]), (7, [float("nan"), 1.0, 1.0, 1.0]), (8, [float("inf"), 1.0, 1.0, 1.0]), (9, [2.0, 4.0, 6.0, 8.0]), (None, one), (10, [1.0, 2.0, 3.0]), (11, [-1.0, -2.0, -3.0, -4.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as key", "2 as rep")
    got = polytope.near_vectors(df, 0.9).collect()
    assert len(got) == len(rows)
    by = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got}
    assert by[1] == (3, 1, True) and by[2] == (3, 1, False) and by[9] == (3, 1, False) and by[None] == (0, None, True)
    assert all(by[i] == (0, i, True) for i in (3, 4, 5, 6, 7, 8, 10, 11))
    assert polytope.near_vectors(df.limit(0), 0.9).collect() == []


def test_fast_transform_is_orthogonal():
    x = np.random.default_rng(1).normal(size=(64, 5))
    y = polytope.hadamard(x.copy())
    assert np.allclose((y * y).sum(0), 64 * (x * x).sum(0)) and np.allclose(polytope.hadamard(y), 64 * x)
    assert np.allclose(polytope.hadamard(np.eye(4)), [[1, 1, 1, 1], [1, -1, 1, -1], [1, 1, -1, -1], [1, -1, -1, 1]])


def test_tables_follow_threshold_and_width():
    """Pairs right at the threshold meet at other settings as well; 24 tables are too few there."""
    assert polytope.tables_for(0.9, 64) == 24
    for cosine, dim, n in ((0.8, 64, 1000), (0.9, 1024, 300)):
        tables = polytope.tables_for(cosine, dim)
        a, b = polytope.pairs_at(cosine, dim, n, np.random.default_rng(4))
        assert polytope.meet(polytope.codes(a, tables), polytope.codes(b, tables)).any(axis=1).all()
    with pytest.raises(ValueError):
        polytope.tables_for(0.3, 64)


def plain_codes(x, tables, hashes):
    """Every code of NEXT axes a hash, all of them compared: the definition."""
    n, dim = len(x), polytope.padded(x.shape[1])
    x = np.pad(x, ((0, 0), (0, dim - x.shape[1])))
    h = np.array([[(-1.0) ** bin(i & j).count("1") for j in range(dim)] for i in range(dim)])
    out = []
    for t in range(tables):
        s = polytope.signs(dim, tables, hashes)[t].astype(float)
        for v in x:
            ranked = []
            for k in range(hashes):
                y = h @ (s[2, :, k, 0] * (h @ (s[1, :, k, 0] * (h @ (s[0, :, k, 0] * v)))))
                best = np.argsort(-np.abs(y), kind="stable")[: polytope.NEXT]
                ranked.append([(abs(y[b]), 2 * b + int(y[b] < 0)) for b in best])
            every = [(sum((ranked[k][0][0] - ranked[k][c[k]][0]) ** 2 for k in range(hashes)), sum(ranked[k][c[k]][1] * (2 * dim) ** k for k in range(hashes))) for c in product(range(polytope.NEXT), repeat=hashes)]
            out.append([t * (2 * dim) ** hashes + key for _, key in sorted(every)[: 1 + polytope.PROBES]])
    return np.array(out).reshape(tables, n, -1).transpose(1, 0, 2)


def test_codes_equal_the_definition():
    x = polytope.unit(np.random.default_rng(6).normal(size=(20, 30)))
    for hashes in (3, 4):
        assert (polytope.codes(x, 3, hashes) == plain_codes(x, 3, hashes)).all()
    assert polytope.hashes_for(10**5, 64) == 3 and polytope.hashes_for(10**8, 64) == 4


def test_large_group_of_near_copies(spark, monkeypatch):
    """A third of all vectors lie close together: all links among them are counted, over several blocks and many small buckets."""
    monkeypatch.setattr(polytope, "BLOCK", 150)
    monkeypatch.setattr(polytope, "PAIRS", 3000)
    monkeypatch.setattr(polytope, "ROWS", 200)
    rng = np.random.default_rng(14)
    x = rng.normal(size=(1200, 16))
    x[::3] = x[0] + 0.02 * rng.normal(size=(400, 16))
    rows = [(int(i), v.tolist()) for i, v in zip(rng.permutation(5000)[:1200], x)]
    want = brute(rows, 0.9)
    got = result(polytope.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5), 0.9))
    assert got == want and max(n for n, _ in want.values()) >= 399


def test_one_id_with_several_vectors(spark):
    a, b = [1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0]
    rows = [(1, a), (1, b), (2, [0.01, 1.0, 0.0, 0.0]), (3, [0.0, 0.0, 1.0, 0.0]), (0, [1.0, 0.01, 0.0, 0.0])]
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in polytope.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 0.9).collect())
    assert got == [(0, 1, 0), (1, 1, 0), (1, 1, 0), (2, 1, 0), (3, 0, 3)]
