import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from lorekeep.llm.common import mix, slices, words

TEXTS = st.lists(st.lists(st.sampled_from([None, "", "a", "abc", "x" * 10, "y" * 60]), max_size=6), max_size=8)


@settings(deadline=None)
@given(TEXTS)
def test_slices_keep_all_rows_in_order_and_are_bounded(groups):
    rows = [t for g in groups for t in g]
    at, batches = 0, []
    for g in groups:
        batches.append(pa.RecordBatch.from_arrays([pa.array(range(at, at + len(g)), pa.int64()), pa.array(g, pa.string())], names=["i", "text"]))
        at += len(g)
    out = list(slices(iter(batches), "text", 20, 5))
    assert [i for b in out for i in b.column("i").to_pylist()] == list(range(len(rows))) and [t for b in out for t in b.column("text").to_pylist()] == rows
    for b in out:
        size = [len(t or "") for t in b.column("text").to_pylist()]
        assert 0 < len(size) <= 5 and (sum(size) <= 20 or len(size) == 1)


@settings(deadline=None)
@given(st.lists(st.text(" \t\n\x0b\x0c\r\x1c\x85abé\u3000", max_size=12) | st.none(), max_size=20))
def test_words_split_at_the_six_ascii_spaces_only(texts):
    import re

    flat, at = words(pa.array(texts, pa.string()))
    assert [flat[a:b].to_pylist() for a, b in zip(at, at[1:])] == [[w for w in re.split("[\x20\x09-\x0d]+", t or "") if w] for t in texts]


def test_mixing_loses_nothing():
    x = np.arange(100_000, dtype=np.uint64)
    assert len(np.unique(mix(x))) == len(x)
