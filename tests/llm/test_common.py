import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from factloom.llm.common import KeyTable, byte_view, pieces, prefix_hash, span_hash, words
from factloom.llm.sketch import Sketch, level

from .helpers import arrow


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab é\t\n\x0b\x85\xa0\x1c", max_size=12)), max_size=8))
def test_words_are_those_of_bytes_split(texts):
    data, off = byte_view(arrow(texts))
    starts, ends, row = words(data, off)
    raw = data.tobytes()
    got = [[] for _ in texts]
    for s, e, r in zip(starts, ends, row, strict=True):
        got[r].append(raw[s:e])
    assert got == [(t or "").encode().split() for t in texts]


def test_hash_does_not_depend_on_place():
    data = np.frombuffer(b"abcde--abcde", np.uint8)
    h = span_hash(prefix_hash(data), np.array([0, 7, 0]), np.array([5, 12, 4]))
    assert h[0] == h[1] != h[2]


def test_pieces_cut_by_bytes_and_keep_all_rows():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"text": arrow(["a" * 10, None, "b" * 100, "", "c"])})
    cut = list(pieces([batch], "text", 12))
    assert [x for b in cut for x in b.column("text").to_pylist()] == batch.column("text").to_pylist()
    assert max(b.num_rows for b in cut) == 2


def test_key_table_finds_what_it_holds():
    keys = np.unique(np.random.default_rng(0).integers(0, 2**63, 5000).astype(np.uint64))
    t = KeyTable(keys, np.arange(len(keys)))
    assert (t.find(keys) == np.arange(len(keys))).all()
    assert (t.find(keys + np.uint64(1)) == -1).sum() > len(keys) - 5


def test_sketch_never_counts_less():
    keys = np.random.default_rng(0).integers(0, 2**63, 1000).astype(np.uint64)
    s = Sketch()
    s.add(np.concatenate([keys, keys[:100]]))
    assert (s.counts[(keys[:100] >> np.uint64(40)).astype(int)] >= 2).all()
    assert level(0) == 0 and level(10**12) == 255
