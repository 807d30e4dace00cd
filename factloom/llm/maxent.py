"""LM scoring: a hashed maximum-entropy model with n-gram and skip features and a class-factored softmax.

P(token | context) = P(class | context) * P(token | class, token before)

The class depends, by a softmax over hashed features, on the token before (bigram), the token before that (skip) and both (trigram). Within a
class words depend on the token before by hashed features too. The frequent words (the lexicon) are told apart; all others are hashed into
buckets, whose number follows the counted vocabulary up to ``BUCKETS``. A bucket has features and an id as context like a word of the lexicon,
and its words share its probability by their counts; all buckets are one class. The other classes are made from all training documents:
words are clustered by the documents they stand in, and each cluster is cut by frequency.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import KeyTable, byte_view, frugal, mix, pieces, store, table, word_hashes
from .sums import SCHEMA, blocks, summed

#: Words with parameters of their own; words whose counts are broadcast (the counts of all others are joined).
LEXICON, HEAD = 1 << 15, 1 << 20
#: Other words that share a bucket on average, until there are so many buckets.
BUCKET_WORDS, BUCKETS = 64, 1 << 13
#: Classes of the lexicon, clusters of words, marker words that tell documents apart.
CLASSES, CLUSTERS, MARKERS = 32, 8, 32
#: Rows of each hashed feature table, contexts (the first OWN are one token each, all other tokens are hashed) and slots of the word features,
#: rounds of training.
FEATURES, CONTEXTS, OWN, SLOTS, ROUNDS = 1 << 13, 512, 256, 1 << 19, 2
#: All rows of class features: three tables, and four for the kinds of the two tokens before.
ROWS = 3 * FEATURES + 4
BATCH, RATE = 1 << 14, 0.3
#: The hash that stands for the end of a text.
END = np.uint64(0x1D8AF066F5C9E1B3)


@dataclass
class Vocabulary:
    """Sizes of the training data, counts of the head, and the lexicon: the first words of the head (id = place); after it come the buckets."""

    total: int
    distinct: int
    head: KeyTable  # values: counts
    lexicon: int
    end: int

    @property
    def base(self) -> float:
        return float(np.log10(self.total + 0.1 * (self.distinct + 1)))

    @property
    def buckets(self) -> int:
        return min(BUCKETS, max(1, (self.distinct - self.lexicon) // BUCKET_WORDS))


def bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(h ^ END) % np.uint64(buckets)).astype(np.int64)


def ids_of(h: np.ndarray, words: KeyTable, buckets: int) -> np.ndarray:
    """The id of each token: its place in the lexicon, or that of its bucket."""
    ids = words.find(h).astype(np.int64)
    other = ids < 0
    ids[other] = len(words.keys) + bucket(h[other], buckets)
    return ids


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each token of a batch: the words of each row, A-Z lower-cased, and its end."""
    h, row, first = word_hashes(*byte_view(column))
    n = len(column)
    out, rows = np.empty(len(h) + n, np.uint64), np.empty(len(h) + n, np.int64)
    at = np.arange(len(h)) + row
    out[at], rows[at] = h, row
    ends = first[1:] + np.arange(n)
    out[ends], rows[ends] = END, np.arange(n)
    return out, rows


def _counts(texts: DataFrame) -> DataFrame:
    """(h, c) of every training token: counted within tasks, then by the shuffle."""

    @frugal
    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def fold():
            h, inverse = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
            c = np.bincount(inverse, weights=np.concatenate([c for _, c in held])).astype(np.int64)
            return h, c

        for b in pieces(batches, "text"):
            held.append(np.unique(tokens(b.column("text"))[0], return_counts=True))
            if sum(len(h) for h, _ in held) > 1 << 21:
                held = [fold()]
                if len(held[0][0]) > 1 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(held[0][0].view(np.int64)), pa.array(held[0][1])], names=["h", "c"])
                    held = []
        if held:
            h, c = fold()
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c)], names=["h", "c"])

    return store(texts.mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")), "counts")


def vocabulary(counts: DataFrame, head: int = HEAD, lexicon: int = LEXICON) -> Vocabulary:
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    # a count that about ``head`` words reach, from the histogram of counts by size
    sizes = counts.groupBy(F.floor(F.log2("c") * 8).cast("int").alias("size")).count().orderBy(F.desc("size")).collect()
    least, n = 0, 0
    for r in sizes:
        n += r["count"]
        if n > head:
            least = r["size"] + 1
            break
    top = counts.where((F.floor(F.log2("c") * 8) >= least) | (F.col("h") == int(END.view(np.int64)))).toArrow()
    h, c = top.column("h").to_numpy().view(np.uint64), top.column("c").to_numpy()
    order = np.lexsort((h, -c))
    h, c = h[order], c[order]
    at = np.flatnonzero(h == END)
    if len(at):  # the end has parameters of its own, however rare
        order = np.concatenate([at, np.delete(np.arange(len(h)), at)])
        h, c = h[order], c[order]
    return Vocabulary(int(total), int(distinct), KeyTable(h, c), min(lexicon, len(h)), 0)


def _small(vocab: Vocabulary) -> KeyTable:
    return KeyTable(vocab.head.keys[: vocab.lexicon], vocab.head.values[: vocab.lexicon])


def _bucket_sizes(counts: DataFrame, vocab: Vocabulary) -> np.ndarray:
    """Tokens and distinct words of each bucket: two rows."""
    spread, n = counts.sparkSession.sparkContext.broadcast(_small(vocab)), vocab.buckets

    @frugal
    def run(batches):
        total = np.zeros(2 * n)
        for b in batches:
            h, c = b.column("h").to_numpy().view(np.uint64), b.column("c").to_numpy()
            other = spread.value.find(h) < 0
            at = bucket(h[other], n)
            total += np.concatenate([np.bincount(at, weights=c[other], minlength=n), np.bincount(at, minlength=n)])
        yield from blocks(total)

    return summed(counts.mapInArrow(run, SCHEMA), 2 * n).reshape(2, n).astype(float)


def _classes(texts: DataFrame, vocab: Vocabulary) -> tuple[np.ndarray, int]:
    """The class of each lexicon word, and the number of classes without that of all other words."""
    spread, size = texts.sparkSession.sparkContext.broadcast(_small(vocab)), vocab.lexicon * (MARKERS + 1)

    @frugal
    def run(batches):
        total = np.zeros(size, np.float32)
        for b in pieces(batches, "text"):
            h, row = tokens(b.column("text"))
            ids, n = spread.value.find(h), b.num_rows
            known = ids >= 0
            ids, row = ids[known], row[known]
            mark = (ids > 0) & (ids <= MARKERS)
            seen = np.bincount(row[mark] * MARKERS + ids[mark] - 1, minlength=n * MARKERS).reshape(n, MARKERS)
            topic = np.where(seen.any(axis=1), seen.argmax(axis=1), MARKERS)
            total += np.bincount(ids * (MARKERS + 1) + topic[row], minlength=size)
        yield from blocks(total)

    m = summed(texts.mapInArrow(run, SCHEMA), size).reshape(vocab.lexicon, MARKERS + 1).astype(float)
    mass = m.sum(axis=1) + 1e-9
    x = np.sqrt(m / mass[:, None])
    centre = x[np.linspace(0, min(len(x) - 1, 4 * CLUSTERS), CLUSTERS).astype(int)] if len(x) else x
    for _ in range(20):
        near = (x @ centre.T).argmax(axis=1)
        for k in range(len(centre)):
            if (near == k).any():
                c = (x[near == k] * np.sqrt(mass[near == k])[:, None]).sum(axis=0)
                centre[k] = c / max(np.linalg.norm(c), 1e-9)
    out, n = np.zeros(vocab.lexicon, np.int64), 0
    for k in range(len(centre)):
        mine = np.flatnonzero(near == k)
        if len(mine):
            bins = max(1, round(CLASSES * mass[mine].sum() / mass.sum()))
            share = np.cumsum(mass[mine]) / mass[mine].sum()
            cut = np.minimum((share * bins - 1e-9).astype(int), bins - 1)
            cut = np.unique(cut, return_inverse=True)[1]
            out[mine] = n + cut
            n += cut.max() + 1
    return out, n


class Model:
    """Parameters and what follows from them; ``u``: (ROWS, classes), ``v``: SLOTS; ``sizes``: tokens and words of each bucket, by
    default those of a single one."""

    def __init__(self, vocab: Vocabulary, word_class: np.ndarray, classes: int, sizes: np.ndarray | None = None):
        c = vocab.head.values[: vocab.lexicon].astype(float)
        if sizes is None:
            sizes = np.array([[max(0, vocab.total - c.sum())], [vocab.distinct - vocab.lexicon]], float)
        self.lexicon, self.buckets = vocab.lexicon, sizes.shape[1]
        self.size, self.classes = self.lexicon + self.buckets, classes + 1
        self.word_class = np.concatenate([word_class, np.full(self.buckets, classes)])
        c = np.concatenate([c, sizes[0] + 0.5 / self.buckets])
        per_class = np.bincount(self.word_class, weights=c, minlength=self.classes)
        self.bias = np.log((per_class + 0.5) / (per_class + 0.5).sum()).astype(np.float32)
        self.within = np.log(c / per_class[self.word_class])
        self.inside = self.within[: self.lexicon]
        # each bucket has room for one unseen word
        self.rest_base = np.log10(sizes[0] + 0.1 * (sizes[1] + 1))
        self.u = np.zeros((ROWS, self.classes), np.float32)
        self.v = np.zeros(SLOTS)
        self.normalize()

    def features(self, p1: np.ndarray, p2: np.ndarray) -> np.ndarray:
        """Rows of ``u`` for the tokens before: ids below FEATURES // 2 have a row of their own, others share; and which of them are buckets."""
        half = FEATURES // 2
        own = lambda i: np.where(i < half, i, half + (mix(i.astype(np.uint64)) % np.uint64(half)).astype(np.int64))
        both = (mix(p1.astype(np.uint64) * np.uint64(0x100000001B3) + p2.astype(np.uint64)) % np.uint64(FEATURES)).astype(np.int64)
        kind = 2 * (p1 >= self.lexicon) + (p2 >= self.lexicon)
        return np.stack([own(p1), FEATURES + own(p2), 2 * FEATURES + both, 3 * FEATURES + kind])

    def context(self, p1: np.ndarray) -> np.ndarray:
        """Context of the word features for each token before."""
        return np.where(p1 < OWN, p1, OWN + (mix(p1.astype(np.uint64)) % np.uint64(CONTEXTS - OWN)).astype(np.int64))

    def slot(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        spread = mix(word.astype(np.uint64) + np.uint64(1)) * (mix(context.astype(np.uint64) + np.uint64(1)) | np.uint64(1))
        return (spread >> np.uint64(64 - (SLOTS.bit_length() - 1))).astype(np.int64)

    def class_logits(self, f: np.ndarray) -> np.ndarray:
        x = self.u[f[0]] + self.u[f[1]] + self.u[f[2]] + self.u[f[3]] + self.bias
        x -= x.max(axis=1, keepdims=True)
        return x

    def _slots(self) -> Iterator[tuple[int, np.ndarray]]:
        """Each context with the slots of all words."""
        w = mix(np.arange(self.size).astype(np.uint64) + np.uint64(1))
        for g in range(CONTEXTS):
            yield g, ((w * (mix(np.array([g + 1], np.uint64)) | np.uint64(1))) >> np.uint64(64 - (SLOTS.bit_length() - 1))).astype(np.int64)

    def normalize(self, pairs: np.ndarray | None = None) -> np.ndarray:
        """Logarithm of the sum within each class, for each context; what is expected of each slot, where pairs (context, class) are given."""
        self.log_z = np.zeros((CONTEXTS, self.classes), np.float32)
        within, v, want = self.within.astype(np.float32), self.v.astype(np.float32), np.zeros(SLOTS)
        for g, s in self._slots():
            e = np.exp(within + v[s])
            z = np.bincount(self.word_class, weights=e, minlength=self.classes)
            z[z == 0] = 1
            self.log_z[g] = np.log(z)
            if pairs is not None and pairs[g].any():
                np.add.at(want, s, e * (pairs[g] / z)[self.word_class])
        return want

    def fit_words(self, seen: np.ndarray, pairs: np.ndarray, steps: int = 12) -> None:
        """Word features by scaled gradient steps from the sums over all training tokens: of each slot (seen) and of each context and class."""
        pairs = pairs.reshape(CONTEXTS, self.classes)
        for _ in range(steps):
            want = self.normalize(pairs)
            # two tokens more at the rate without the feature: what was seen once or twice moves little
            self.v += np.clip(0.7 * np.log((seen + 2) / (want + 2 * np.exp(self.v))), -1, 1)
            self.v = np.clip(self.v, -6, 6)
        self.normalize()


def _contexts(ids: np.ndarray, row: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the token before and of the one before that; before a text stands its end."""
    p1, p2 = np.full(len(ids), end), np.full(len(ids), end)
    same = row[1:] == row[:-1]
    p1[1:][same] = ids[:-1][same]
    if len(ids) > 2:
        same = row[2:] == row[:-2]
        p2[2:][same] = ids[:-2][same]
    return p1, p2


def _train(texts: DataFrame, vocab: Vocabulary, model: Model) -> Model:
    sc, C = texts.sparkSession.sparkContext, model.classes
    words, buckets = sc.broadcast(_small(vocab)), model.buckets
    split = F.pmod(F.xxhash64("text"), F.lit(ROUNDS))
    n_u, size = ROWS, ROWS * (C + 1) + SLOTS + CONTEXTS * C
    stats = np.zeros(SLOTS + CONTEXTS * C, np.float64)
    for r in range(ROUNDS):
        spread = sc.broadcast(model)

        @frugal
        def run(batches, spread=spread):
            start = spread.value
            u, speed = start.u.copy(), np.full((n_u, C), 1e-2, np.float32)
            local = Model.__new__(Model)
            local.__dict__.update(start.__dict__)
            local.u = u
            used, seen, pairs = np.zeros(n_u, np.float32), np.zeros(SLOTS, np.float32), np.zeros(CONTEXTS * C, np.float32)
            for b in pieces(batches, "text"):
                h, row = tokens(b.column("text"))
                ids = ids_of(h, words.value, buckets)
                p1, p2 = _contexts(ids, row, vocab_end)
                cls, g = start.word_class[ids], start.context(p1)
                seen += np.bincount(start.slot(g, ids), minlength=SLOTS)
                pairs += np.bincount(g * C + cls, minlength=CONTEXTS * C)
                for i in range(0, len(ids), BATCH):
                    at = slice(i, i + BATCH)
                    f = start.features(p1[at], p2[at])
                    p = np.exp(local.class_logits(f))
                    p /= p.sum(axis=1, keepdims=True)
                    p[np.arange(len(p)), cls[at]] -= 1
                    for one in f:
                        order = np.argsort(one, kind="stable")
                        ones = one[order]
                        first = np.flatnonzero(np.concatenate([[True], ones[1:] != ones[:-1]]))
                        rows = ones[first]
                        grad = np.add.reduceat(p[order], first, axis=0)
                        speed[rows] += grad * grad
                        u[rows] -= RATE * grad / np.sqrt(speed[rows])
                        used[rows] += np.diff(np.append(first, len(ones)))
            # each row's change counts by how often the task saw the row
            yield from blocks(np.concatenate([((u - start.u) * used[:, None]).reshape(-1), used, seen, pairs]))

        vocab_end = vocab.end
        got = summed(texts.where(split == r).mapInArrow(run, SCHEMA), size).astype(float)
        used = got[n_u * C : n_u * (C + 1)]
        model.u = (model.u + got[: n_u * C].reshape(n_u, C) / np.maximum(used, 1)[:, None]).astype(np.float32)
        stats += got[n_u * (C + 1) :]
        spread.unpersist()
    model.fit_words(stats[:SLOTS], stats[SLOTS:])
    return model


def score_texts(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document, learning from those not held out.

    base_score: smoothed unigram log10 probability from the counts of all training tokens. score: log10 probability of the whole text under
    the model. Null or empty text is its end alone. Repeated rows are counted and scored one by one. Without training documents every token is
    unseen and the model is the unigram one. No documents give no rows. Other columns are not read. Words are told apart by 64-bit hashes.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    texts = rows.where(~F.col("held_out")).select(F.coalesce("text", F.lit("")).alias("text"))
    counts = _counts(texts)
    vocab = vocabulary(counts)
    model = None
    if vocab.lexicon:
        model = _train(texts, vocab, Model(vocab, *_classes(texts, vocab), _bucket_sizes(counts, vocab)))
    head, held = spark.sparkContext.broadcast(vocab.head), spark.sparkContext.broadcast(model)
    base, end, lexicon = vocab.base, vocab.end, vocab.lexicon
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, rare array<struct<h:long,n:int>>"

    @frugal
    def run(batches):
        m = held.value
        for b in pieces(batches, "text", 1 << 20):
            h, row = tokens(b.column("text"))
            n = b.num_rows
            ids = head.value.find(h)
            known, total = ids >= 0, np.bincount(row, minlength=n)
            weight = np.where(known, np.log10(head.value.values[ids] + 0.1), 0.0) if len(head.value.values) else np.zeros(len(h))
            base_score = np.bincount(row, weights=weight - base, minlength=n)
            if m is not None:
                other = (ids < 0) | (ids >= lexicon)
                lex = np.where(other, lexicon + bucket(h, m.buckets), ids)
                p1, p2 = _contexts(lex, row, end)
                out = np.zeros(len(h))
                for i in range(0, len(h), BATCH):
                    at = slice(i, i + BATCH)
                    x = m.class_logits(m.features(p1[at], p2[at]))
                    cls = m.word_class[lex[at]]
                    out[at] = (x[np.arange(len(x)), cls] - np.log(np.exp(x).sum(axis=1))) / np.log(10)
                g = m.context(p1)
                out += (m.within[lex] + m.v[m.slot(g, lex)] - m.log_z[g, m.word_class[lex]]) / np.log(10)
                out[other] += weight[other] - m.rest_base[lex[other] - lexicon]
                score = np.bincount(row, weights=out, minlength=n)
            else:
                score = base_score
            far = np.flatnonzero(~known)
            key = np.lexsort((h[far], row[far]))
            r, k = row[far][key], h[far][key]
            new = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (k[1:] != k[:-1])])) if len(r) else np.zeros(0, int)
            times = np.diff(np.append(new, len(r)))
            offsets = np.searchsorted(r[new], np.arange(n + 1))
            rare = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(k[new].view(np.int64)), pa.array(times, pa.int32())], names=["h", "n"]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(total), pa.array(np.bincount(row[known], minlength=n)), pa.array(base_score), pa.array(score), rare], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "rare"])

    scored = store(rows.mapInArrow(run, schema).withColumn("row_id", F.monotonically_increasing_id()), "scored")
    # the words that are not in the head: their counts come by a join
    rare = scored.select("row_id", F.explode("rare").alias("x")).select("row_id", "x.h", "x.n").join(counts, "h", "left")
    more = rare.groupBy("row_id").agg(F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("more_known"), F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(0.1))).alias("more"))
    out = scored.drop("rare").join(more, "row_id", "left")
    add = lambda a, b: (F.col(a) + F.coalesce(F.col(b), F.lit(0))).alias(a)
    return out.select("doc_id", "held_out", "n_tokens", add("n_known", "more_known").cast("long").alias("n_known"), F.lit(vocab.total).cast("long").alias("train_tokens"), add("base_score", "more"), add("score", "more"))


def op9_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 == 0
    return score_texts(table(spark, sf_dir, "documents"), held_out)
