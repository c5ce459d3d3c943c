import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from lorekeep.llm import packing
from lorekeep.llm.tokens import WordTokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", "  ", "it's we'll X'RE don'T", "a<|endoftext|>b <|startoftext|>", "İstanbul ſ K Å é ½ ²³ ٣٤", "a b c　d", "ÀÉ×÷ß…—“q” 12345 1,2", "日本語 текст ΣΑΣ", "x" * 5000, "\x00 \x1c \x85 ��", "'s 'T ''s it''s", "naïve coöp é", "a" + "̀" * 50, "ⅷ Ⅷ ǅ"]


def test_ids_equal_the_tokenizers(spark):
    full = Tokenizer.from_file(PATH)
    texts = ODD + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    ids, at = WordTokenizer.at(PATH).encode(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == full.encode(t or "", add_special_tokens=False).ids, t


def test_best_fit_decreasing_equals_a_plain_search():
    rng = random.Random(3)
    for capacity in (1, 7, 64, 100):
        sizes = np.array([rng.randint(1, capacity) for _ in range(200)])
        window, offset = packing.best_fit_decreasing(sizes, capacity)
        left = []
        for i in np.argsort(-sizes, kind="stable"):
            fits = [w for w in range(len(left)) if left[w] >= sizes[i]]
            best = min((left[w] for w in fits), default=None)
            if best is None:
                left.append(capacity)
                best = capacity
                assert window[i] == len(left) - 1
            else:
                assert left[window[i]] == best
            assert offset[i] == capacity - best
            left[window[i]] -= sizes[i]


def check(rows, texts, capacity):
    full = Tokenizer.from_file(PATH)
    by, windows = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        windows[r.sequence_id].append(r)
    assert set(by) == set(texts)
    for i, pieces in by.items():
        ids = [*full.encode(texts[i] or "", add_special_tokens=False).ids, 2]
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and 0 < r.length <= capacity
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for pieces in windows.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return 1 - sum(r.length for r in rows) / (capacity * len(windows))


def test_every_id_lies_in_one_piece_and_padding_is_low(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert check(packing.pack(docs, PATH).collect(), texts, 4096) < 0.02


def test_edge_cases(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 5)
    rows = list(enumerate(ODD))
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as start", "2 as length", "3 as part")
    check(packing.pack(df, PATH, 16).collect(), dict(rows), 16)
    twice = packing.pack(df.union(df).selectExpr("cast(null as long) doc_id", "text"), PATH, 16).collect()
    assert all(r.doc_id is None for r in twice) and len({(r.sequence_id, r.offset) for r in twice}) == len(twice)
    assert packing.pack(df.limit(0), PATH).collect() == []


def test_other_tokenizers_give_their_own_ids():
    """A file with other rules is not taken for one that may be encoded word by word."""
    other = public_tokenizers.path("byte_bpe_50k.json")
    assert WordTokenizer.at(PATH).by_words and not WordTokenizer.at(other).by_words
    full = Tokenizer.from_file(other)
    ids, at = WordTokenizer.at(other).encode(pa.array(ODD, pa.string()), 2)
    for i, t in enumerate(ODD):
        assert ids[at[i] : at[i + 1]].tolist() == [*full.encode(t or "", add_special_tokens=False).ids, 2]


def test_equal_rows_are_dealt_out(spark, monkeypatch):
    """500 equal rows share no group of more than a few times its size."""
    monkeypatch.setattr(packing, "GROUP", 10)
    df = spark.range(500).selectExpr("cast(7 as long) as doc_id", "'the same text' as text")
    groups = defaultdict(int)
    for r in packing.pack(df, PATH, 16).collect():
        groups[r.sequence_id >> 32] += 1
    assert sum(groups.values()) == 500 and max(groups.values()) <= 40 and len(groups) >= 40
