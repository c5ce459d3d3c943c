"""The pipeline on a small fixture against a brute-force version of each stage."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from lorekeep.llm import secrets, toxicity


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """A fixture of all kinds of rows: short and long texts, nulls, repeated rows, copies, secrets, toxic texts."""
    d = tmp_path_factory.mktemp("sf")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id < 400")
    odd = [(9001, None, "en", "src1", 0), (9002, "", "en", "src1", 0), (9003, "two words", "en", "src1", 9), (9004, "two words", "de", "src2", 9), (9004, "two words", "de", "src2", 9), (None, "no id", "en", "src3", 5), (9005, "token = Zx81kQm2Lp9Rt4Vw7Yb3Nc6Hd", "en", "src4", 33)]
    docs.unionByName(spark.createDataFrame(odd, docs.schema)).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.01/labels.parquet").write.parquet(f"{d}/labels.parquet")
    return str(d)


def sets(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\v", " ").replace("\f", " ").split(" ") if w]
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def key(r):
    return (r.doc_id is None, r.doc_id or 0, r.text or "")


def test_stages_equal_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = docs.collect()

    machine = toxicity.train(docs, spark.read.parquet(f"{small}/labels.parquet"))
    clean = []
    for r in rows:
        row, term = toxicity.term_sets(pa.array([r.text], pa.string()))
        on = np.isin(machine.terms, term)
        v = machine.factor[: len(machine.terms)][on]
        z = machine.bias + machine.weight[: len(machine.terms)][on].sum() + sum(v[i] @ v[j] for i in range(len(v)) for j in range(i))
        if z < 0:
            clean.append(r)
    got = corpus_pipeline.reject_toxic(spark, docs, small)
    assert got.columns == docs.columns and sorted(map(key, got.collect())) == sorted(map(key, clean))
    assert len(clean) < len(rows)

    clean.sort(key=key)
    s, group = [sets(r.text) for r in clean], list(range(len(clean)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(clean)):
        for j in range(i):
            if clean[i].doc_id is not None and clean[j].doc_id is not None and s[i] and s[j] and 100 * len(s[i] & s[j]) >= 80 * len(s[i] | s[j]):
                a, b = sorted((root(i), root(j)))
                group[b] = a
    kept = [r for i, r in enumerate(clean) if root(i) == i]
    got = corpus_pipeline.drop_copies(spark, spark.createDataFrame(clean, docs.schema), small)
    assert got.columns == docs.columns and sorted(map(key, got.collect())) == sorted(map(key, kept))
    assert len(kept) < len(clean)

    owners, cands = defaultdict(set), {}
    for i, r in enumerate(kept):
        cands[i] = secrets.scan(r.text or "")[1]
        for _, _, _, h, _ in cands[i]:
            owners[h].add(r.source)
    masked = [r.text if r.text is None else secrets.masked(r.text, [(a, b) for a, k, b, h, x in cands[i] if len(owners[h]) <= 2 and (k < 3 or x)], "[secret]") for i, r in enumerate(kept)]
    got = corpus_pipeline.mask_secrets(spark, spark.createDataFrame(kept, docs.schema), small)
    assert got.columns == docs.columns
    assert sorted((key(r), r.n_chars) for r in got.collect() if r.text) == sorted(((r.doc_id is None, r.doc_id or 0, t), len(t)) for r, t in zip(kept, masked) if t)
    assert any(t and "[secret]" in t for t in masked)

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for r, t in zip(kept, masked):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        want += [(r.doc_id or 0, a, len(ids[a : a + 4096]), zlib.crc32(np.array(ids[a : a + 4096], "<u4").tobytes()), len(ids)) for a in range(0, len(ids), 4096)]
    out = corpus_pipeline.run(spark, small).collect()
    assert sorted((r.doc_id or 0, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in out) == sorted(want)
    windows = defaultdict(list)
    for r in out:
        windows[r.sequence_id].append((r.offset, r.length))
    for w in windows.values():
        at = 0
        for offset, length in sorted(w):
            assert offset == at
            at += length
        assert at <= 4096


def test_empty_table(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.001/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_stages_keep_further_columns(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").withColumn("score", F.lit(1)).withColumn("_id", F.lit("x")).withColumn("_a", F.lit("y")).withColumn("row", F.lit(2)).withColumn("cut", F.lit(3))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, small)
        assert out.columns == docs.columns, name
        assert {(r.score, r._id, r.row, r.cut) for r in out.collect()} == {(1, "x", 2, 3)}, name
