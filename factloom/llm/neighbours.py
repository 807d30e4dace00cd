"""Approximate nearest neighbours: a hierarchical navigable small-world graph for each shard, shard results merged."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import frugal, store, table

#: Links of a node in the upper layers (twice as many in the lowest), and beam widths of building and searching.
LINKS, BUILD_BEAM, SEARCH_BEAM = 12, 64, 96
#: Rows of a shard at most, and shards at least.
SHARD_ROWS, MIN_SHARDS = 50_000, 12
#: Queries that walk the graph in step.
BATCH = 64


class Graph:
    """Flat neighbour arrays: one row of links for each node, -1 where there are fewer; layer 0 holds all nodes.

    Vectors are lengthened by one coordinate so that all have the same norm; then the largest inner product is the smallest distance.
    Building and searching walk in batches: each step expands the best open candidate of every query at once.
    """

    def __init__(self, vectors: np.ndarray, links: int = LINKS, beam: int = BUILD_BEAM, seed: int = 1):
        square = (vectors**2).sum(axis=1)
        top = square.max(initial=0.0)
        self.x = np.concatenate([vectors, np.sqrt(np.maximum(top - square, 0))[:, None]], axis=1).astype(np.float32)
        n, self.links = len(vectors), links
        draw = np.random.default_rng(seed).random(n)
        self.level = np.minimum((-np.log(np.maximum(draw, 1e-12)) / np.log(links)).astype(int), 8)
        # nodes of upper layers come first, so each batch finds the layers above built
        self.layers = [np.full((n, 2 * links if i == 0 else links), -1, np.int32) for i in range(self.level.max(initial=0) + 1)]
        order = np.lexsort((draw, -self.level))
        self.entry = int(order[0]) if n else -1
        done = 1
        while done < n:
            batch = order[done : done + min(BATCH, max(1, done // 2))]
            self._insert(batch, beam)
            done += len(batch)

    def _insert(self, batch: np.ndarray, beam: int) -> None:
        q = self.x[batch]
        near = np.full((len(batch), 1), self.entry, np.int32)
        for layer in range(len(self.layers) - 1, -1, -1):
            here = np.flatnonzero(self.level[batch] >= layer)
            found, score = self._walk(q, near, layer, beam if len(here) else 1)
            near = found[:, :1] if layer and not len(here) else found[:, : max(1, beam // 8)]
            if len(here):
                self._link(batch[here], found[here], score[here], layer)

    def _choose(self, ids: np.ndarray, score: np.ndarray, many: int) -> list[np.ndarray]:
        """Of each row of candidates (best first) those nearer to the node than to any chosen before, filled up with the best of the rest."""
        out = []
        for c, s in zip(ids, score, strict=True):
            ok = c >= 0
            c, s = c[ok], s[ok]
            between = self.x[c] @ self.x[c].T
            taken: list[int] = []
            for i in range(len(c)):
                if len(taken) == many:
                    break
                if not taken or s[i] >= between[i, taken].max():
                    taken.append(i)
            rest = [i for i in range(len(c)) if i not in taken][: many - len(taken)]
            out.append(c[taken + rest])
        return out

    def _link(self, nodes: np.ndarray, found: np.ndarray, score: np.ndarray, layer: int) -> None:
        links, many = self.layers[layer], self.layers[layer].shape[1]
        # the batch's own nodes are candidates too
        own = self.x[nodes] @ self.x[nodes].T
        np.fill_diagonal(own, -np.inf)
        ids = np.concatenate([found, np.broadcast_to(nodes, own.shape)], axis=1)
        s = np.where(ids >= 0, np.concatenate([score, own], axis=1), -np.inf)
        best = np.argsort(-s, axis=1, kind="stable")[:, : 3 * self.links]
        ids, s = np.take_along_axis(ids, best, 1), np.take_along_axis(s, best, 1)
        chosen = self._choose(np.where(np.isfinite(s), ids, -1), s, self.links)
        back: dict[int, list[int]] = {}
        for node, c in zip(nodes.tolist(), chosen, strict=True):
            links[node, : len(c)] = c
            for other in c.tolist():
                back.setdefault(other, []).append(node)
        full_ids, full_of = [], []
        for other, new in back.items():
            have = links[other][links[other] >= 0]
            all_ = np.unique(np.concatenate([have, np.array(new, np.int32)]))
            if len(all_) <= many:
                links[other, : len(all_)] = all_
            else:
                full_of.append(other)
                full_ids.append(all_)
        for other, all_ in zip(full_of, full_ids, strict=True):
            sc = self.x[all_] @ self.x[other]
            o = np.argsort(-sc, kind="stable")
            c = self._choose(all_[o][None, :], sc[o][None, :], many)[0]
            links[other] = -1
            links[other, : len(c)] = c

    def _walk(self, q: np.ndarray, near: np.ndarray, layer: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Best ``beam`` nodes of the layer for each query, best first, with their inner products; -1 where there are fewer."""
        m, links = len(q), self.layers[layer]
        seen = np.zeros((m, len(self.x)), bool)
        ids, score = np.full((m, beam), -1, np.int32), np.full((m, beam), -np.inf, np.float32)
        closed = np.ones((m, beam), bool)
        k = min(beam, near.shape[1])
        rows = np.arange(m)
        s = np.einsum("mkd,md->mk", self.x[near[:, :k]], q)
        s[near[:, :k] < 0] = -np.inf
        o = np.argsort(-s, axis=1)
        ids[:, :k], score[:, :k] = np.take_along_axis(near[:, :k], o, 1), np.take_along_axis(s, o, 1)
        closed[:, :k] = ~np.isfinite(score[:, :k])
        r, c = np.nonzero(near[:, :k] >= 0)
        seen[r, near[r, c]] = True
        live = rows
        while len(live):
            at = np.argmin(closed[live], axis=1)
            open_ = ~closed[live, at]
            live, at = live[open_], at[open_]
            if not len(live):
                break
            closed[live, at] = True
            next_ = links[ids[live, at]]
            fresh = (next_ >= 0) & ~seen[live[:, None], next_]
            r, c = np.nonzero(fresh)
            if not len(r):
                continue
            flat = next_[r, c]
            seen[live[r], flat] = True
            s = np.full(next_.shape, -np.inf, np.float32)
            s[r, c] = np.einsum("kd,kd->k", self.x[flat], q[live[r]])
            all_s = np.concatenate([score[live], s], axis=1)
            o = np.argsort(-all_s, axis=1, kind="stable")[:, :beam]
            score[live] = np.take_along_axis(all_s, o, 1)
            ids[live] = np.take_along_axis(np.concatenate([ids[live], next_], axis=1), o, 1)
            new_closed = np.take_along_axis(np.concatenate([closed[live], ~fresh], axis=1), o, 1)
            closed[live] = new_closed | ~np.isfinite(score[live])
        ids[~np.isfinite(score)] = -1
        return ids, score

    def search(self, q: np.ndarray, k: int, beam: int = SEARCH_BEAM) -> np.ndarray:
        """Up to k nodes for each query, -1 where there are fewer."""
        out = np.full((len(q), k), -1, np.int64)
        if self.entry < 0:
            return out
        q = np.concatenate([q, np.zeros((len(q), 1))], axis=1).astype(np.float32)
        for i in range(0, len(q), BATCH):
            part = q[i : i + BATCH]
            near = np.full((len(part), 1), self.entry, np.int32)
            for layer in range(len(self.layers) - 1, 0, -1):
                near = self._walk(part, near, layer, 4)[0]
            found = self._walk(part, near, 0, max(beam, k))[0][:, :k]
            out[i : i + len(part), : found.shape[1]] = found
        return out


def valid_vectors(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v) of the rows that take part: id and vector there, every component finite, not all zero."""
    v = F.col(vec_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & fine)


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", beam: int = SEARCH_BEAM) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows with the largest inner products for each row whose id is divisible by ``every``.

    Equal vectors are indexed once, with the k + 1 rows of the smallest ids, which hold every answer they can give, and are searched for once.
    Each shard answers every query from its own graph; the answers meet in a top k + 1 for each query, scored anew in double precision, from
    which each query row takes k without itself. Shards grow with the data up to ``SHARD_ROWS`` vectors, then their number does; queries
    reach a shard in blocks.

    Vectors that are null, zero, or have null or non-finite components take no part, nor do null ids; vectors of another length than the
    query's are never near. Ties go to the smaller id; repeated rows are candidates one by one, and each asks for itself; an empty table
    gives no rows.
    """
    spark = vectors.sparkSession
    rows = store(valid_vectors(vectors, id_col, vec_col).withColumn("dim", F.size("v")).withColumn("h", F.xxhash64("v")).withColumn("row", F.monotonically_increasing_id()), "vectors")
    few = rows.withColumn("n", F.row_number().over(W.partitionBy("h", "v").orderBy("vec_id", "row"))).where(F.col("n") <= k + 1)
    points = few.groupBy("h", "v").agg(F.sort_array(F.collect_list(F.struct("vec_id", "row"))).alias("ids"), F.first("dim").alias("dim"))
    points = store(points.withColumn("point", F.monotonically_increasing_id()), "points")
    shards = max(MIN_SHARDS, -(-points.count() // SHARD_ROWS))
    asking = store(rows.where(F.col("vec_id") % every == 0).join(points.select("h", "v", "point"), ["h", "v"]).select("vec_id", "row", F.col("point").alias("query")), "asking")
    queries = store(asking.select("query").distinct().join(points.select(F.col("point").alias("query"), "v", "dim"), "query"), "queries")
    if queries.isEmpty():
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # every query is sent to every shard: a stated query set against all rows, block by block
    sent = queries.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "query", "v", "dim", F.lit(None).cast("long").alias("point"))
    held = points.select(F.pmod(F.xxhash64("point"), F.lit(shards)).cast("int").alias("shard"), F.lit(None).cast("long").alias("query"), "v", "dim", "point")

    @frugal
    def run(batches):
        def answer(points_, graphs, q):
            for dim, part in graphs.items():
                mine = [i for i, v in enumerate(q[1]) if len(v) == dim]
                if mine:
                    vectors_ = np.array([q[1][i] for i in mine], float)
                    found = part.search(vectors_, k + 1, beam)
                    r, c = np.nonzero(found >= 0)
                    yield pa.RecordBatch.from_arrays([pa.array(np.array(q[0])[mine][r], pa.int64()), pa.array(np.array(points_[dim][0])[found[r, c]], pa.int64())], names=["query", "point"])

        shard, store_, graphs, q = None, {}, None, ([], [])
        for b in batches:
            for s, query, v, dim, point in zip(*(b.column(i).to_pylist() for i in (0, 1)), b.column("v").to_numpy(zero_copy_only=False), b.column("dim").to_pylist(), b.column("point").to_pylist(), strict=True):
                if s != shard:
                    if q[0]:
                        yield from answer(store_, graphs, q)
                    shard, store_, graphs, q = s, {}, None, ([], [])
                if query is None:
                    mine = store_.setdefault(dim, ([], []))
                    mine[0].append(point)
                    mine[1].append(np.asarray(v, np.float32))
                    continue
                if graphs is None:
                    graphs = {d: Graph(np.array(x[1])) for d, x in store_.items()}
                q[0].append(query)
                q[1].append(v)
                if len(q[0]) >= 4096:
                    yield from answer(store_, graphs, q)
                    q = ([], [])
        if q[0]:
            yield from answer(store_, graphs, q)

    dealt = held.unionByName(sent).repartitionById(shards, "shard").sortWithinPartitions("shard", F.col("query").asc_nulls_first())
    found = store(dealt.mapInArrow(run, "query long, point long"), "found")
    found = found.join(points.select("point", "ids", F.col("v").alias("pv")), "point").join(queries.select("query", F.col("v").alias("qv")), "query")
    dot = F.aggregate(F.zip_with("pv", "qv", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    best = W.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row")
    near = found.select("query", dot.alias("score"), F.explode("ids").alias("x")).select("query", "score", "x.vec_id", "x.row").withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1)
    near = near.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("n", "vec_id", "row", "score"))).alias("near"))
    others = F.slice(F.filter("near", lambda x: x["row"] != F.col("row")), 1, k)
    out = asking.join(near, "query").select(F.col("vec_id").alias("query_id"), F.posexplode(others).alias("at", "x"))
    return out.select("query_id", (F.col("at") + 1).alias("rank"), "x.vec_id", "x.score")


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
