"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucketed, byte_view, discard, frugal, mix, pieces, store, table, word_hashes
from .components import components
from .sketch import BITS, Sketch, level, merged, present, spread

#: Words of a shingle; similarity in hundredths.
WORDS, PERCENT = 5, 75
#: Shingles that two linked sets share in their prefixes, at least.
SHARED = 4
#: A shingle with a larger estimated count is hot: its postings are dealt out evenly instead of by shingle.
HOT = 2000
#: Rounds, at most, in which the members of a posting list are compared with one of them only, as long as each halves what is left.
STAR_ROUNDS = 6
#: What is left is compared in full as soon as that takes at most so many comparisons of places for each posting.
EFFORT = 2
#: A set with more pairs than this is copied, once for each so many, so that its pairs are dealt out.
DEALT = 64
_C = np.random.default_rng(7).integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)


def shingle_sets(data: np.ndarray, off: np.ndarray, n_words: int = WORDS) -> list[np.ndarray]:
    """For each row its distinct shingles as sorted 64-bit hashes."""
    h, row, first = word_hashes(data, off)
    count = np.diff(first)
    sums = np.zeros(len(h), np.uint64)
    for j in range(min(n_words, len(h))):
        sums[: len(h) - j] += h[j:] * _C[j]
    sums = mix(sums)
    out = []
    for i in range(len(off) - 1):
        s, n = first[i], count[i]
        if n >= n_words:
            out.append(np.unique(sums[s : s + n - n_words + 1]))
        elif n:
            out.append(mix(np.array([(h[s : s + n] * _C[:n]).sum(dtype=np.uint64) + np.uint64(n)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def node_of(shingles: np.ndarray) -> int:
    """A 64-bit name of the set."""
    x = int(mix(shingles ^ np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64)) + len(shingles) * 0xE7037ED1A0B428DB
    return int(mix(np.array([x % 2**64], np.uint64)).view(np.int64)[0])


def prefix_length(n: int, percent: int = PERCENT) -> int:
    """Linked sets share SHARED shingles (or all they need, if that is less) in prefixes of this length."""
    need = -(-n * percent // 100)
    return n - need + min(SHARED, need)


def verify(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether 100 * intersection >= percent * union, after the length and suffix filters."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    need = -(-percent * (len(a) + len(b)) // (100 + percent))  # least intersection
    if len(small) < need or not need:
        return False
    # suffix filter: between pivots of the one set, the overlap is at most the shorter stretch
    if len(small) > 32:
        pivots = np.arange(0, len(small), max(1, len(small) // 16))[1:]
        cut = np.concatenate([[0], np.searchsorted(large, small[pivots]), [len(large)]])
        if np.minimum(np.diff(cut), np.diff(np.concatenate([[0], pivots, [len(small)]]))).sum() < need:
            return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int((large[at] == small).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _table(cols: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(cols)


def _members(docs: DataFrame, n_words: int) -> DataFrame:
    """Each row with its set's size and name; and the blocks of the counting sketch."""

    @frugal
    def run(batches):
        sketch, seen = Sketch(), set()
        for b in pieces(batches, "text"):
            sets = shingle_sets(*byte_view(b.column("text")), n_words)
            nodes = [node_of(s) if len(s) else None for s in sets]
            fresh = []
            for s, node in zip(sets, nodes, strict=True):
                if node is not None and node not in seen:
                    seen.add(node)
                    fresh.append(s)
            if fresh:
                sketch.add(np.concatenate(fresh))
            yield _table({"row_id": b.column("row_id"), "doc_id": b.column("doc_id"), "n": pa.array([len(s) for s in sets], pa.int64()), "node": pa.array(nodes, pa.int64()), "block": pa.nulls(b.num_rows, pa.int32()), "blob": pa.nulls(b.num_rows, pa.binary())})
        for block, blob in sketch.blocks():
            yield _table({"row_id": pa.nulls(1, pa.int64()), "doc_id": pa.nulls(1, pa.int64()), "n": pa.nulls(1, pa.int64()), "node": pa.nulls(1, pa.int64()), "block": pa.array([block], pa.int32()), "blob": pa.array([blob], pa.binary())})

    return store(docs.mapInArrow(run, "row_id long, doc_id long, n long, node long, block int, blob binary"), "members")


def _postings(docs: DataFrame, counts: np.ndarray, n_words: int, percent: int) -> DataFrame:
    """(shingle, node, n, pos) of the prefixes, rarest shingles first, of those shingles that two sets or more have in their prefixes; without
    the sets that have too few of them and the places from which too little follows."""
    spread_counts, hot = docs.sparkSession.sparkContext.broadcast(counts), int(level(HOT))

    @frugal
    def run(batches):
        seen, counts = set(), spread_counts.value
        for b in pieces(batches, "text"):
            hs, nodes, ns, ps, levels = [], [], [], [], []
            for s in shingle_sets(*byte_view(b.column("text")), n_words):
                if not len(s) or (node := node_of(s)) in seen:
                    continue
                seen.add(node)
                q = counts[s >> np.uint64(64 - BITS)]
                p = prefix_length(len(s), percent)
                order = np.argsort(q, kind="stable")[:p]
                hs.append(s[order])
                levels.append(q[order])
                nodes.append(np.full(p, node))
                ns.append(np.full(p, len(s)))
                ps.append(np.arange(p))
            if hs:
                place = np.concatenate(ns) << 31 | np.concatenate(ps)
                yield _table({"shingle": np.concatenate(hs).view(np.int64), "node": np.concatenate(nodes), "place": np.where(np.concatenate(levels) > hot, ~place, place)})

    @frugal
    def shared(batches):
        carry = None
        for b in _then_none(batches):
            if b is not None:
                now = [b.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
                if carry is not None:
                    now = [np.concatenate([x, y]) for x, y in zip(carry, now, strict=True)]
                if not len(now[0]):
                    continue
                last = _tail(now[0])
                carry, now = [x[last:] for x in now], [x[:last] for x in now]
            else:
                if carry is None:
                    return
                now = carry
            if not len(now[0]):
                continue
            h, node, place = now
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (node[1:] != node[:-1])
            h, node, place = (x[new] for x in now)
            group = np.cumsum(np.concatenate([[True], h[1:] != h[:-1]])) - 1
            hot = place < 0
            keep = (np.bincount(group)[group] > 1) | hot
            if keep.any():
                h, node, place, group, hot = h[keep], node[keep], np.where(hot, ~place, place)[keep], group[keep], hot[keep]
                n, pos = place >> 31, place & (2**31 - 1)
                # positional filter: no member links at a shingle that leaves it too few others for the smallest set of the list;
                # a hot list is not all here, so there it is for the smallest set that can link at all
                first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
                fewest = np.repeat(np.minimum.reduceat(n, first), np.diff(np.append(first, len(n))))
                partner = np.maximum(np.where(hot, 0, fewest), -(-n * percent // 100))
                near = n - pos >= -(-percent * (n + partner) // (100 + percent))
                yield _table({"shingle": h, "node": node, "n": n.astype(np.int32), "pos": pos.astype(np.int32), "near": near})

    # a negative place marks a hot shingle, whose postings are dealt out by node
    rows = docs.select("text").mapInArrow(run, "shingle long, node long, place long")
    dealt = rows.repartition(F.when(F.col("place") < 0, F.xxhash64("shingle", "node")).otherwise(F.col("shingle"))).sortWithinPartitions("shingle", "node")
    lists = store(dealt.mapInArrow(shared, "shingle long, node long, n int, pos int, near boolean"), "postings")
    enough = lists.groupBy("node").agg(F.count(F.lit(1)).alias("k"), F.first("n").alias("n")).where(F.col("k") >= F.least(F.lit(SHARED), F.ceil(F.col("n") * percent / 100)))
    held = docs.sparkSession.sparkContext.broadcast(present(enough, "node"))

    @frugal
    def with_enough(batches):
        for b in batches:
            keep = held.value[(spread(b.column("node").to_numpy(zero_copy_only=False).view(np.uint64)) >> np.uint64(64 - BITS)).astype(np.int64)] > 0
            yield b.filter(pa.array(keep))

    # the sketch may let some through that share too little: they cost comparisons, no links
    out = store(lists.where("near").drop("near").mapInArrow(with_enough, "shingle long, node long, n int, pos int"), "postings")
    discard(lists)
    return out


def _then_none(batches):
    yield from batches
    yield None


def _tail(sorted_values: np.ndarray) -> int:
    """Where the last run of equal values begins."""
    different = np.flatnonzero(sorted_values[1:] != sorted_values[:-1])
    return int(different[-1]) + 1 if len(different) else 0


def _sets(docs: DataFrame, wanted: np.ndarray, n_words: int) -> DataFrame:
    """(node, shingles) of the sets whose names may be wanted."""
    held = docs.sparkSession.sparkContext.broadcast(wanted)

    @frugal
    def run(batches):
        seen = set()
        for b in pieces(batches, "text"):
            nodes, blobs = [], []
            for s in shingle_sets(*byte_view(b.column("text")), n_words):
                if len(s) and (node := node_of(s)) not in seen:
                    if held.value[int(spread(np.array([node], np.int64).view(np.uint64))[0]) >> (64 - BITS)]:
                        seen.add(node)
                        nodes.append(node)
                        blobs.append(s.tobytes())
            if nodes:
                yield _table({"node": pa.array(nodes, pa.int64()), "shingles": pa.array(blobs, pa.binary())})

    return docs.select("text").mapInArrow(run, "node long, shingles binary").dropDuplicates(["node"])


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, linked): each pair judged once on its whole sets."""

    @frugal
    def run(batches):
        for b in batches:
            a, c = b.column("sa").to_pylist(), b.column("sb").to_pylist()
            ok = [verify(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(a, c, strict=True)]
            yield _table({"a": b.column("a"), "b": b.column("b"), "linked": pa.array(ok, pa.bool_())})

    sa, sb = sets.toDF("a", "sa"), sets.toDF("b", "sb")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.ceil(F.count(F.lit(1)) / DEALT).cast("int").alias("copies"))
    frequent = store(ends.where("copies > 1"), "frequent")
    if frequent.isEmpty():
        rows = pairs.join(sa, "a").join(sb, "b")
    else:
        # pairs of sets with few pairs stay with the buckets; the others meet a copy of each of their sets
        pairs = pairs.join(frequent.toDF("a", "copies_a"), "a", "left").join(frequent.toDF("b", "copies_b"), "b", "left")
        few = F.col("copies_a").isNull() & F.col("copies_b").isNull()
        rows = pairs.where(few).select("a", "b").join(sa, "a").join(sb, "b").select("a", "b", "sa", "sb")
        dealt = pairs.where(~few).select("a", "b", F.coalesce("copies_a", F.lit(1)).alias("copies_a"), F.coalesce("copies_b", F.lit(1)).alias("copies_b"))
        copied = {}
        for end, side in (("a", sa), ("b", sb)):
            asked = dealt.select(end, f"copies_{end}").distinct().join(side, end)
            copied[end] = asked.select(end, f"s{end}", F.explode(F.sequence(F.lit(0), F.col(f"copies_{end}") - 1)).alias(f"copy_{end}"))
        dealt = dealt.select("a", "b", F.pmod(F.xxhash64("a", "b"), "copies_a").cast("int").alias("copy_a"), F.pmod(F.xxhash64("b", "a"), "copies_b").cast("int").alias("copy_b"))
        rows = rows.unionByName(dealt.join(copied["a"], ["a", "copy_a"]).join(copied["b"], ["b", "copy_b"]).select("a", "b", "sa", "sb"))
    out = store(rows.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long, linked boolean"), "verified")
    discard(frequent)
    return out


def similarity_groups(docs: DataFrame, n_words: int = WORDS, percent: int = PERCENT, row_id: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row_id, doc_id, n_shingles, component_id, component) of every row: groups of documents connected by similar shingle sets.

    Equal sets are one node, collapsed within each task and again in the shuffle, so copies are never paired. A posting list is first compared
    with one of its members (first the one with the fewest rarer shingles, then others); members already connected need no comparison. What
    then remains between different groups of a list is compared in full, pair by pair: no link is lost, and no pair of connected documents is
    made. Length and positional filters cut the pairs, the suffix filter the verification.

    Null or empty text: no shingles, alone in its group. Null ids: the group's smallest id that is not null. Repeated rows link to each other.
    component names the group itself (null without shingles). No documents give no rows. Other columns are not read. Sets are
    built from, and compared by, 64-bit hashes of their shingles.
    """
    docs = docs.select((F.col(row_id).cast("long") if row_id else F.lit(None).cast("long")).alias("row_id"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    members = _members(docs, n_words)
    counts = merged(members.where("block is not null"))
    members = members.where("block is null").drop("block", "blob")
    lists = _postings(docs, counts, n_words, percent)
    open_, labels, judged, before, verdicts = lists.withColumn("comp", F.col("node")), None, None, None, []
    for star in range(STAR_ROUNDS + 1):
        if star:
            # a list whose members are all connected is settled for good
            moved = open_.drop("comp").join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
            mixed = moved.groupBy("shingle").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("shingle")
            # stored, so that Spark can split a list that is long
            mixed = store(mixed, "mixed")
            still = store(moved.join(mixed, "shingle", "left_semi"), "open")
            discard(open_, mixed)
            open_ = still
        # the member with the fewest rarer shingles is nearest to all others
        hub = F.min(F.struct(F.col("pos") if star == 0 else F.xxhash64("node", F.lit(star)).alias("draw"), F.xxhash64("node").alias("tie"), "node", "n", F.col("pos").alias("at"), "comp")).alias("hub")
        if star:
            by_comp = open_.groupBy("shingle", "comp").agg(F.count(F.lit(1)).alias("k"), hub)
            by_list = by_comp.groupBy("shingle").agg(F.sum("k").alias("k"), F.max_by("comp", F.struct("k", "comp")).alias("main"), F.max("k").alias("most"), F.min("hub").alias("hub"))
        else:
            by_list = open_.groupBy("shingle").agg(F.count(F.lit(1)).alias("k"), F.max("comp").alias("main"), F.lit(1).cast("long").alias("most"), hub).where("k > 1")
        by_list = store(by_list, "lists")
        effort, postings = by_list.agg(F.sum((F.col("k") - F.col("most")) * F.col("k")), F.sum("k")).first()
        if not effort:
            discard(by_list)
            break
        full = star == STAR_ROUNDS or effort <= EFFORT * postings or (before is not None and 2 * effort > before)
        before = effort
        if full:
            # every pair of different groups has a member outside the list's main group
            left = open_.join(by_list.select("shingle", "main"), "shingle").where("comp <> main").drop("main")
        else:
            left = by_list.select("shingle", "hub.node", "hub.n", F.col("hub.at").alias("pos"), "hub.comp")
        left = left.select("shingle", *(F.col(c).alias(f"{c}_") for c in ("node", "n", "pos", "comp")))
        # a linked pair passes the positional filter at the first shingle it shares
        need = F.ceil(percent * (F.col("n") + F.col("n_")) / (100 + percent))
        pairs = (
            open_.join(left, "shingle").where("comp <> comp_")
            .where((F.least("n", "n_") * 100 >= F.greatest("n", "n_") * percent) & (F.least(F.col("n") - F.col("pos"), F.col("n_") - F.col("pos_")) >= need))
            .select(F.least("node", "node_").alias("a"), F.greatest("node", "node_").alias("b")).distinct()
        )
        if judged is not None:
            pairs = pairs.join(judged.select("a", "b"), ["a", "b"], "left_anti")
        pairs = store(pairs, "pairs")
        # the sets of this round's pairs only: a pass over the texts costs less than moving sets that no pair asks for
        with bucketed(_sets(docs, present(pairs.select("a").unionAll(pairs.select("b")).toDF("node"), "node"), n_words), "node", "sets") as sets:
            now = _verified(pairs, sets, percent)
        verdicts.append(now)
        judged = now if judged is None else judged.unionByName(now)
        labels, old = components(judged.where("linked")), labels
        discard(by_list, pairs, old)
        if full:
            break
    discard(lists, open_, *verdicts)
    out = _placed(members, labels)
    return out.select("row_id", "doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"), F.col("comp").alias("component"))


def _placed(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Members with their group (comp) and its smallest id. Ids are reduced by node, then by group; tables are joined as they are stored, so
    that Spark can split what belongs to one frequent node or one large group."""
    nodes = members.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"))
    if labels is None:
        nodes = nodes.withColumn("comp", F.col("node"))
    else:
        linked = store(nodes.join(labels, "node"), "linked")
        least = store(linked.groupBy("comp").agg(F.min("least").alias("of_all")), "least")
        both = store(linked.join(least, "comp").select("node", "comp", "of_all"), "linked")
        discard(linked, least)
        nodes = nodes.join(both, "node", "left").select("node", F.coalesce("comp", "node").alias("comp"), F.when(F.col("comp").isNull(), F.col("least")).otherwise(F.col("of_all")).alias("least"))
    placed = store(nodes, "nodes")
    if labels is not None:
        discard(both, labels)
    return members.join(placed, "node", "left")


def op2_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_groups(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), sh AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END)) AS s FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id
), inter AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id
), links AS (
  SELECT a, b FROM inter JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b
), comp AS (
  SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a
)
SELECT comp.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id FROM comp LEFT JOIN n USING (doc_id)
"""
