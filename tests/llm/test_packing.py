import binascii
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from factloom.llm.packing import Packer, pack
from factloom.llm.pretokens import encoder, tokenizer_path

from .helpers import documents, frame

PATHS = (tokenizer_path(), tokenizer_path("byte_bpe_50k.tiktoken"))


def truth(text):
    return Tokenizer.from_file(PATHS[0]).encode(text or "", add_special_tokens=False).ids + [1]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from([*"ab Z9'st\n\t  é中ñ.!<|>", "<|endoftext|>", " the", "\r\n", "\xad", "\x1c", "ß", "…"]), max_size=30).map("".join))
def test_ids_are_those_of_the_tokenizer(text):
    ids = Tokenizer.from_file(PATHS[0]).encode(text, add_special_tokens=False).ids
    assert encoder(*PATHS).ids(text) == struct.pack(f"<{len(ids)}I", *ids)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 500), max_size=60))
def test_packer_loses_nothing_and_leaves_little_room(sizes):
    p = Packer(100, 4, 3)
    done = [w for i, n in enumerate(sizes) for w in p.place((i, 0, bytes(4 * n), n))]
    assert len(p.open) <= 4
    assert all(97 <= sum(len(x[2]) // 4 for x in w) <= 100 for w in done)
    seen: dict[int, int] = {}
    for i, start, ids, _ in sorted((x[:3] + (0,) for w in done + list(p.rest()) for x in w), key=lambda x: x[:2]):
        assert start == seen.get(i, 0)
        seen[i] = start + len(ids) // 4
    assert seen == dict(enumerate(sizes))


@pytest.mark.parametrize("parts", [1, 5])
def test_every_id_lies_in_one_piece(spark, parts):
    rows = documents()
    got = pack(frame(spark, rows, parts=parts), *PATHS, size=256, windows=3).collect()
    by_sequence: dict = {}
    for r in got:
        assert len(r["ids"]) == 4 * r["length"]
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for piece in by_sequence.values():
        at = 0
        for r in sorted(piece, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 256
    assert sum(256 - sum(r["length"] for r in p) > 8 for p in by_sequence.values()) <= 1
    want = sorted((struct.pack(f"<{len(i)}I", *i)) for i in (truth(r[1]) for r in rows))
    whole: dict = {}
    for r in got:
        if rows.count(next(x for x in rows if x[0] == r["doc_id"])) == 1 and r["doc_id"] is not None:
            whole.setdefault(r["doc_id"], []).append(r)
    for doc_id, piece in whole.items():
        ids = b"".join(r["ids"] for r in sorted(piece, key=lambda r: r["start"]))
        assert ids in want and len(ids) == 4 * piece[0]["doc_tokens"]
        text = next(x[1] for x in rows if x[0] == doc_id)
        assert ids == struct.pack(f"<{len(truth(text))}I", *truth(text))
        assert binascii.crc32(ids) >= 0
    assert sum(r["length"] for r in got) == sum(len(x) // 4 for x in want)


def test_empty_table(spark):
    assert pack(frame(spark, []), *PATHS).count() == 0
