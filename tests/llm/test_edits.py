import random

from hypothesis import given, settings
from hypothesis import strategies as st

from factloom.llm.edits import Tree, edited_trees, revision_edits, token_trees, with_edits
from factloom.llm.pretokens import encoder, tokenizer_path

from .helpers import documents, frame, prose

PATHS = (tokenizer_path(), tokenizer_path("byte_bpe_50k.tiktoken"))
PIECES = st.sampled_from([" a", "the  ", "\n", "'s", "  \n x", "12", "é", "!!", " ", "\t\t", "<|endo", "ftext|>", "中", "\u00a0", " ά", "\u2028", "\u0085", "😀", "'l", "l'", "\u0301", "٣", "\u200b"])
TEXT = st.lists(PIECES, max_size=80).map("".join)


@settings(max_examples=150, deadline=None)
@given(TEXT, st.lists(st.tuples(st.integers(0, 300), st.integers(0, 60), st.lists(PIECES, max_size=4).map("".join)), max_size=6))
def test_counts_follow_edits(text, edits):
    enc = encoder(*PATHS)
    tree, now = Tree(text, enc), text
    for start, length, new in edits:
        tree.edit(start, length, new)
        start = min(start, len(now))
        now = now[:start] + new + now[start + length :]
        assert tree.text == now and tree.tokens == len(enc.slow(now)) and tree.sums[1, 0] == len(now)


def test_only_the_surroundings_are_encoded_again():
    r = random.Random(1)
    text = prose(r, 20_000)
    tree = Tree(text, encoder(*PATHS))
    tree.encoded = 0
    for _ in range(20):
        tree.edit(r.randrange(len(tree.text)), r.randrange(10), "new words ")
    assert tree.encoded < 20 * 600 and tree.tokens == len(encoder(*PATHS).slow(tree.text))


def test_texts_of_any_script_are_encoded_around_the_edit_only():
    r = random.Random(2)
    enc = encoder(*PATHS)
    text = "".join(r.choice(["中文字", " слово", "\u00a0", " ή", " 😀", "\n", " plain", "  ", " ١٢", "'ll"]) for _ in range(20_000))
    tree = Tree(text, enc)
    assert tree.tokens == len(enc.slow(text)) and tree.leaves > 100
    tree.encoded = 0
    for _ in range(20):
        tree.edit(r.randrange(len(tree.text)), r.randrange(10), " né\u00a0中 ")
    assert tree.encoded < 20 * 600 and tree.tokens == len(enc.slow(tree.text))
    plain = Tree(prose(r, 5_000), enc)
    plain.encoded = 0
    plain.edit(9_000, 3, "\u00a0中")
    assert plain.encoded < 600 and plain.tokens == len(enc.slow(plain.text))


def test_a_leaf_that_grows_is_cut_without_encoding_the_rest():
    r = random.Random(3)
    enc = encoder(*PATHS)
    tree = Tree(prose(r, 20_000), enc)
    tree.encoded = 0
    tree.edit(50_000, 5, prose(r, 2_000))
    assert 4096 < tree.encoded < 40_000 and tree.tokens == len(enc.slow(tree.text)) and tree.sums[1, 0] == len(tree.text)
    tree.encoded = 0
    tree.edit(51_000, 5, "x")
    assert tree.encoded < 600 and tree.tokens == len(enc.slow(tree.text))


def test_operators(spark):
    rows = documents()
    trees = token_trees(frame(spark, rows), *PATHS)
    assert sorted(x["n_tokens"] for x in trees.collect()) == sorted(len(encoder(*PATHS).slow(r[1] or "")) for r in rows)
    for x in edited_trees(trees.withColumn("edits", revision_edits()), *PATHS).collect():
        assert x["n_tokens"] == len(encoder(*PATHS).slow(x["text"])) == sum(x["leaf_tokens"]) and sum(x["leaf_chars"]) == len(x["text"])
    edits = spark.createDataFrame([(3, 2, 0, 0, "b"), (3, 1, 0, 1, "a"), (4, 1, None, None, None)], "doc_id long, seq int, start int, length int, new string")
    got = {x["doc_id"]: x for x in edited_trees(with_edits(trees, edits), *PATHS).collect()}
    before = {r[0]: r[1] for r in rows}
    assert got[3]["text"] == "ba" + before[3][1:] and got[4]["text"] == before[4] and got[4]["n_encoded"] < 400
    assert token_trees(frame(spark, []), *PATHS).count() == 0
