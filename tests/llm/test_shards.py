import zlib
from collections import Counter, defaultdict

import numpy as np

from lorekeep.llm import shards


def plain_jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & (2**64 - 1)
        j = int((b + 1) * (2.0**31 / ((key >> 33) + 1)))
    return b


def test_jump_equals_the_published_loop():
    keys = np.random.default_rng(1).integers(0, 2**64, 500, dtype=np.uint64)
    for n in (1, 2, 16, 17, 1000):
        assert shards.jump(keys, n).tolist() == [plain_jump(int(k), n) for k in keys]


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = shards.shard(docs).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    slots = defaultdict(list)
    for r in rows:
        data = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law) == (len(data) + 1, zlib.crc32(data), "key")
        assert r.grown_shard in (r.shard, 16)
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values()) and set(slots) == set(range(16))
    assert 20 < sum(r.grown_shard == 16 for r in rows) < 110
    assert max(Counter(r.shard for r in rows).values()) < 100
    fewer = {r.doc_id: r.shard for r in shards.shard(docs, 15).collect()}
    assert all(r.shard in (fewer[r.doc_id], 15) for r in rows)


def test_edge_cases(spark):
    rows = [(None, None), (1, None), (1, None), (2, ""), (3, "é"), (None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as shard", "2 as run")
    got = shards.shard(df).collect()
    assert len(got) == 6 and len({(r.shard, r.slot) for r in got}) == 6
    assert {(r.doc_id, r.size, r.text_crc32) for r in got} == {(None, 1, 0), (1, 1, 0), (2, 1, 0), (3, 3, zlib.crc32("é".encode())), (None, 2, zlib.crc32(b"x"))}
    assert shards.shard(df.limit(0)).collect() == []


def test_large_ids_beside_a_null(spark):
    """A null in a batch must not round the others: ids near 2**62 keep their shard, with 16 shards and with 17."""
    mask = 2**64 - 1

    def mixed(x):
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & mask
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & mask
        return x ^ (x >> 31)

    ids = [2**62 + 7919 * i for i in range(60)] + [-(2**62) - i for i in range(20)] + [2**63 - 1, -(2**63), 0]
    rows = [(i, f"t{i}") for i in ids] + [(None, "no id"), (None, None)]
    got = shards.shard(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert len(got) == len(rows)
    for r in got:
        key = mixed((r.doc_id or 0) & mask)
        assert (r.shard, r.grown_shard) == (plain_jump(key, 16), plain_jump(key, 17))


def test_one_id_on_most_rows(spark, monkeypatch):
    """Repeated rows and nulls are numbered where they are read, also when counts are too many to broadcast."""
    monkeypatch.setattr(shards, "BROADCAST_COUNTS", 0)
    df = spark.range(3000).selectExpr("if(id % 3 = 0, 7, if(id % 3 = 1, null, id)) as doc_id", "if(id % 2 = 0, 'same', null) as text").repartition(7)
    got = shards.shard(df).collect()
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert len(got) == 3000 and all(sorted(x) == list(range(len(x))) for x in slots.values())
