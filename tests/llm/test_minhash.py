import re
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest

from lorekeep.llm import minhash
from lorekeep.operators import linking
from lorekeep.operators.graph import components

SCHEMA = "doc_id long, text string"


def brute(rows, k, percent):
    """doc_id -> (n_shingles, component) by an inverted index over whole sets and union-find."""
    sets = {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    where = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            where[x].append(i)
    pairs = {p for ids in where.values() for p in combinations(sorted(ids), 2)}
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((root(a), root(b)))
            up[y] = x
    return {i: (len(s), root(i)) for i, s in sets.items()}


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_equals_brute_force_on_documents(spark, k, percent):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = minhash.near_duplicates(docs, k, percent)
    rows = out.collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute([(r.doc_id, r.text) for r in docs.collect()], k, percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows) and len(rows) == docs.count()


def test_hub_and_chain_groups_lose_no_link(spark):
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in rng.integers(0, 5000, 200)]
    rows = [(1000, " ".join(base))]
    for i in range(120):  # copies with more and more edits: most are far from each other, many are near the base
        w = list(base)
        for j in rng.integers(0, len(w), 1 + i // 8):
            w[j] = f"x{rng.integers(1e9)}"
        rows.append((i, " ".join(w)))
    chain = [f"c{i}" for i in range(100)]
    for i in range(60):
        chain = [*chain[2:], f"d{i}", f"e{i}"]
        rows.append((2000 + i, " ".join(chain)))
    assert result(minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA), 3, 85)) == brute(rows, 3, 85)


def test_blocks_of_bounded_size_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(linking, "BLOCK", 700)
    test_hub_and_chain_groups_lose_no_link(spark)


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One"), (5, "one"), (6, "one two"), (7, "a b c"), (8, "A  B\tC"), (9, "É b c"), (10, "é b c"), (None, "a b c"), (7, "a b c"), (11, "z " * 30000), (12, "Z " * 20000)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("doc_id", "text", "1 as component_id", "2 as rep", "3 as n")
    got = minhash.near_duplicates(df, 3, 85).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert [by[i].n_shingles for i in (1, 2, 3, 4, 6, 7, 11)] == [0, 0, 0, 1, 1, 1, 1]
    assert [by[i].component_id for i in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, None)] == [1, 2, 3, 4, 4, 6, 7, 7, 9, 10, 11, 11, None]
    assert by[None].kept and not by[8].kept and sum(r.doc_id == 7 for r in got) == 2
    assert minhash.near_duplicates(df.limit(0), 3, 85).collect() == []


def test_sketches_estimate_similarity_and_are_full():
    rng = np.random.default_rng(1)
    common, t = rng.integers(0, 2**63, 600).astype(np.uint64), 168
    sets = [np.unique(np.concatenate([common, rng.integers(0, 2**63, 100).astype(np.uint64)])) for _ in range(40)] + [common[:7]]
    sk = minhash.sketch(sets, t)
    assert not (sk == minhash.EMPTY).any()
    same = [(sk[i] == sk[j]).mean() for i, j in combinations(range(40), 2)]
    assert abs(np.mean(same) - 600 / 800) < 0.02


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 90), (90, 95), (7, 7), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(2, 41)}, 95: 90, 100: 90}


def test_versions_of_one_document_keep_their_links(spark):
    """Rows that share an id but not their text: each text is compared, and the document has the links of all."""
    rng = np.random.default_rng(8)
    a, b = ([f"{x}{i}" for i in rng.integers(0, 9999, 80)] for x in "ab")
    near = [*b[:79], "other"]
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, " ".join(near)), (3, "quite another text"), (1, " ".join(b)), (4, " ".join([*a[:79], "more"]))]
    got = minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA), 3, 85).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (1, 1), (1, 1), (2, 1), (3, 3), (4, 1)]


def test_one_text_on_most_rows(spark, monkeypatch):
    """Copies beyond the limit of a large digest, empty texts and null ids beside other groups."""
    rng = np.random.default_rng(9)
    base = [f"w{i}" for i in rng.integers(0, 9999, 60)]
    rows = [(i, " ".join(base)) for i in range(10, 1300)] + [(i, None) for i in range(2000, 2400)] + [(5000, " ".join([*base[:59], "x"])), (5001, "a b c d"), (5002, "A b c d")]
    df = spark.createDataFrame(rows + [(None, " ".join(base))] * 300, SCHEMA).repartition(5)
    got = minhash.near_duplicates(df, 3, 85).collect()
    assert len(got) == len(rows) + 300 and sum(r.doc_id is None and r.component_id is None and r.kept for r in got) == 300
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == brute(rows, 3, 85)
