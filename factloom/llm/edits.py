"""Token counts that follow edits: a segment tree over the pre-tokens of each document, re-encoded only around each edit."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import frugal, pieces, table
from .pretokens import SPECIAL, SPLIT, Encoder, encoder, tokenizer_path

#: Pre-tokens of a new leaf; a leaf that grows past so many characters is cut into new ones.
LEAF, LONG_LEAF = 32, 4096
#: Pre-tokens whose counts a worker remembers.
MEMORY = 300_000
#: How far past its end a pre-token's match can look.
CONTEXT = 2


class _Counts(dict):
    def __init__(self, enc: Encoder):
        super().__init__()
        self.core = enc.core

    def __missing__(self, piece: str) -> int:
        if len(self) >= MEMORY:
            self.clear()
        n = self[piece] = len(self.core.encode_single_piece(piece.encode()))
        return n


_counts: dict[int, _Counts] = {}


def counts_of(enc: Encoder) -> _Counts:
    if id(enc) not in _counts:
        _counts[id(enc)] = _Counts(enc)
    return _counts[id(enc)]


class Tree:
    """Characters and tokens of each leaf and, above them, of each pair of nodes; node 1 is the root.

    A text that the libraries may split unlike (not ``plain``) is split by the one that defines the ids, around an edit as well. Only a text
    with the special token's letters (``opaque``) is one leaf and always re-encoded as a whole.
    """

    def __init__(self, text: str, enc: Encoder, leaves: tuple[list[int], list[int]] | None = None):
        self.text, self.enc, self.piece, self.encoded = text, enc, counts_of(enc), 0
        self.look()
        self.build(leaves)

    def look(self) -> None:
        self.plain, self.opaque = self.enc.plain(self.text), SPECIAL in self.text

    def build(self, leaves: tuple[list[int], list[int]] | None = None) -> None:
        if leaves is not None:
            chars, tokens = (np.asarray(x, np.int64) for x in leaves)
        elif self.opaque:
            chars, tokens = np.array([len(self.text)]), np.array([len(self.enc.slow(self.text))])
            self.encoded += len(self.text)
        else:
            found = SPLIT.findall(self.text) if self.plain else [piece for piece, _ in self.enc.cuts(self.text)]
            chars, tokens = self.cut(found)
            self.encoded += len(self.text)
        self.leaves = max(1, len(chars))
        self.size = 1 << (self.leaves - 1).bit_length()
        self.sums = np.zeros((2 * self.size, 2), np.int64)
        self.sums[self.size : self.size + len(chars), 0] = chars
        self.sums[self.size : self.size + len(tokens), 1] = tokens
        n = self.size
        while n > 1:
            n >>= 1
            self.sums[n : 2 * n] = self.sums[2 * n : 4 * n : 2] + self.sums[2 * n + 1 : 4 * n : 2]

    def cut(self, found: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Characters and tokens of new leaves for these pre-tokens."""
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.arange(0, len(found), LEAF)
        return tuple(np.add.reduceat(np.fromiter(map(of, found), np.int64, len(found)), at) for of in (len, self.piece.__getitem__))

    def pretokens(self, begin: int) -> Iterator[tuple[str, int]]:
        if self.plain:
            return ((m.group(), m.end()) for m in SPLIT.finditer(self.text, begin))
        return self.enc.cuts(self.text, begin)

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds the character ``at`` (the last leaf that holds any, past the end) and the leaf's first character."""
        node, start = 1, 0
        at = min(at, int(self.sums[1, 0]) - 1)
        while node < self.size:
            node *= 2
            left = int(self.sums[node, 0])
            if at >= start + left:
                start, node = start + left, node + 1
        return node - self.size, start

    def set(self, leaf: int, chars: int, tokens: int) -> None:
        node = leaf + self.size
        change = np.array([chars, tokens]) - self.sums[node]
        if change.any():
            while node:
                self.sums[node] += change
                node >>= 1

    def edit(self, start: int, length: int, new: str) -> None:
        """Replace ``length`` characters from ``start`` by ``new``; what lies outside the text is ignored."""
        old_size = len(self.text)
        start = min(max(0, start), old_size)
        end = min(start + max(0, length), old_size)
        self.text = self.text[:start] + new + self.text[end:]
        stop, moved = start + len(new), len(new) - (end - start)
        near = self.text[max(0, start - len(SPECIAL)) : stop + len(SPECIAL)]
        if self.opaque or SPECIAL in near or not old_size:
            self.look()
            self.build()
            return
        self.plain = self.plain and self.enc.plain(near)
        first, begin = self.find(max(0, start - CONTEXT))
        # the next leaf that begins at or after the end of the edit, in characters of the old text
        if end >= old_size:
            after, edge = self.leaves, old_size
        else:
            after, edge = self.find(end)
            if edge < end or after == first:
                edge += int(self.sums[self.size + after, 0])
                after += 1
        found, at = [], begin
        for piece, to in self.pretokens(begin):
            if at >= stop:
                while edge < at - moved and after < self.leaves:
                    edge += int(self.sums[self.size + after, 0])
                    after += 1
                if edge == at - moved and after <= self.leaves and edge < old_size:
                    break
            found.append(piece)
            at = to
        if at >= len(self.text):
            after = self.leaves
        self.encoded += at - begin
        chars, tokens = self.cut(found)
        if at - begin > LONG_LEAF:  # more leaves, in place of the old ones; the others keep their counts
            old = self.sums[self.size : self.size + self.leaves]
            self.build(tuple(np.concatenate([old[:first, i], new, old[after:, i]]) for i, new in enumerate((chars, tokens))))
            return
        self.set(first, at - begin, int(tokens.sum()))
        for leaf in range(first + 1, after):
            self.set(leaf, 0, 0)

    def state(self) -> tuple[list[int], list[int]]:
        part = self.sums[self.size : self.size + self.leaves]
        return part[:, 0].tolist(), part[:, 1].tolist()


FIELDS = "leaf_chars array<int>, leaf_tokens array<int>, n_tokens long, n_encoded long"


def _mapped(docs: DataFrame, path: str, ranks_path: str, edited: bool) -> DataFrame:
    @frugal
    def run(batches):
        enc = encoder(path, ranks_path)
        for b in pieces(batches, "text"):
            rows = []
            for r in b.to_pylist():
                tree = Tree(r["text"] or "", enc, (r["leaf_chars"], r["leaf_tokens"]) if edited and r["leaf_chars"] is not None else None)
                if edited:
                    before = tree.encoded
                    for e in r["edits"] or []:
                        if e is not None:
                            tree.edit(e["start"] or 0, e["length"] or 0, e["new"] or "")
                    tree.encoded -= before if r["leaf_chars"] is not None else 0
                chars, tokens = tree.state()
                rows.append((tree.text, chars, tokens, tree.tokens, tree.encoded))
            cols = list(zip(*rows, strict=True))
            types = [pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int64(), pa.int64()]
            given = [b.column("doc_id"), b.column("extra")]
            yield pa.RecordBatch.from_arrays([*given, *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=["doc_id", "extra", "text", "leaf_chars", "leaf_tokens", "n_tokens", "n_encoded"])

    return docs.mapInArrow(run, f"doc_id long, extra long, text string, {FIELDS}")


def token_trees(docs: DataFrame, path: str, ranks_path: str) -> DataFrame:
    """(doc_id, text, leaf_chars, leaf_tokens, n_tokens, n_encoded) of every document: its tree's leaves and its token count.

    Null text is empty and has no tokens; rows are told apart by nothing but their place, so repeated rows are counted one by one;
    no documents give no rows; other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(None).cast("long").alias("extra"), F.col("text"))
    return _mapped(rows, path, ranks_path, False).drop("extra")


def edited_trees(trees: DataFrame, path: str, ranks_path: str) -> DataFrame:
    """The same columns after the edits in ``edits`` (array of start, length, new: characters of the text as the edits before it left it), and
    n_before, the count before. n_encoded: characters re-encoded. Edits of null have no effect; parts outside the text are ignored."""
    rows = trees.select("doc_id", F.col("n_tokens").alias("extra"), "text", "leaf_chars", "leaf_tokens", "edits")
    return _mapped(rows, path, ranks_path, True).withColumnRenamed("extra", "n_before")


def with_edits(trees: DataFrame, edits: DataFrame) -> DataFrame:
    """Trees with the edits of a table (doc_id, seq, start, length, new), in the order of seq. Documents without edits keep null."""
    by_doc = edits.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("seq", "start", "length", "new"))).alias("x"))
    by_doc = by_doc.select("doc_id", F.transform("x", lambda e: F.struct(e["start"].alias("start"), e["length"].alias("length"), e["new"].alias("new"))).alias("edits"))
    return trees.join(by_doc, "doc_id", "left")


def revision_edits() -> Column:
    """Three edits of a document that follow from its id: a word put in, some characters cut out, some replaced."""
    size = F.char_length(F.coalesce("text", F.lit("")))

    def spot(k: int) -> Column:
        return F.pmod(F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f":{k}")).cast("binary")), size + 1).cast("int")

    def one(k: int, length: int, new: str) -> Column:
        return F.struct(spot(k).alias("start"), F.lit(length).alias("length"), F.lit(new).alias("new"))

    return F.array(one(1, 0, " revised"), one(2, 17, ""), one(3, 5, "\n  It's 42%. "))


def op10_token_counts(spark: SparkSession, sf_dir: str, path: str | None = None, ranks_path: str | None = None) -> DataFrame:
    """Token counts of all documents before and after the edits of revision_edits()."""
    path, ranks_path = path or tokenizer_path(), ranks_path or tokenizer_path("byte_bpe_50k.tiktoken")
    trees = token_trees(table(spark, sf_dir, "documents"), path, ranks_path)
    after = edited_trees(trees.withColumn("edits", revision_edits()), path, ranks_path)
    return after.select("doc_id", F.col("n_before").alias("n_tokens"), F.col("n_tokens").alias("n_tokens_edited"), F.char_length("text").cast("long").alias("n_chars_edited"), F.col("n_encoded").alias("n_chars_encoded"), F.size("leaf_chars").cast("long").alias("n_leaves"))
