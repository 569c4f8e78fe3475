"""Exact top-k by inner product: ball-tree branch and bound in every shard.

Vectors are quantised to integers and dealt to shards by a hash of their id. A
shard's tree is built once and written; queries travel to the trees in three
rounds: each first meets one shard alone (its home), then an eighth of the
others, then the rest. Between rounds the k best of all shards so far are put
together, and a query's k-th score, a lower bound of its final one, goes with it
to all shards of the next round. There whole subtrees whose inner-product upper
bound (q.c + |q| r) stays below it are never opened. In a shard nodes are opened
in the order of that bound, and the k-th score found so far tightens it further.
A task reads its shard's tree and then the queries as a stream, so it holds one
tree and one batch of queries, however many there are; the vectors are moved
once to build the trees, and the trees once a round.

Equal vectors share one entry of the tree with their smallest ids (at most
k + 1: no more can be in one query's result), so a vector that a third of all
rows hold costs one entry a shard.

Defined results: vectors that are null, or hold null, NaN or infinite
components, take no part, nor does a row without vec_id; ties go to the smaller
vec_id; fewer than k candidates give fewer rows; an empty table gives none. A
vec_id that occurs on several rows is one candidate a row for others, and none
of its rows is a candidate for itself; as a query it counts once, by its
smallest vector. Vectors of different lengths don't meet: only those as long as
the query are its candidates; vectors of any length are taken whole. Scores are
exact while they and their parts stay below 2^53; components of more than
2^45 are beyond that. Further columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridsmith.llm.common import cut, shuffle_width

K = 5
#: Vectors of a shard: its tree (8 bytes a component) is what a task holds.
SHARD_ROWS = 65_536
LEAF = 128


def quantised(vectors: DataFrame) -> DataFrame:
    """vec_id and v, the components times 256 and rounded down; rows that take no part are gone."""
    x = F.col("embedding")
    sound = F.col("vec_id").isNotNull() & x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return vectors.where(F.coalesce(sound, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c.cast("double") * 256).cast("double")).alias("v"))


@dataclass
class Node:
    centre: np.ndarray
    radius: float
    low: int
    high: int
    children: tuple


class BallTree:
    """Distinct vectors in leaf order, a centre and a radius for every node."""

    def __init__(self, points: np.ndarray):
        self.order = np.arange(len(points))
        self.points = points
        self.nodes: list[Node] = []
        if len(points):
            self._build(0, len(points))
        self.points = points[self.order]
        self.centres = np.array([n.centre for n in self.nodes]).reshape(len(self.nodes), -1)
        self.radii = np.array([n.radius for n in self.nodes])

    def _build(self, low: int, high: int) -> int:
        own = self.points[self.order[low:high]]
        centre = own.mean(0)
        radius = float(np.sqrt(((own - centre) ** 2).sum(1).max()))
        at = len(self.nodes)
        self.nodes.append(Node(centre, radius * (1 + 1e-9) + 1e-9, low, high, ()))
        if high - low > LEAF:
            axis = int(own.var(0).argmax())
            middle = (high - low) // 2
            self.order[low:high] = self.order[low:high][np.argpartition(own[:, axis], middle)]
            self.nodes[at].children = (self._build(low, low + middle), self._build(low + middle, high))
        return at


class Shard:
    """One shard's tree, with up to keep ids (the smallest) of each distinct vector."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, keep: int):
        order = np.lexsort((ids, *vectors.T[::-1])) if vectors.size else np.argsort(ids)
        ids, vectors = ids[order], vectors[order]
        first = np.ones(len(ids), bool)
        first[1:] = (vectors[1:] != vectors[:-1]).any(1) if len(ids) > 1 else first[1:]
        starts = np.flatnonzero(first)
        ends = np.append(starts[1:], len(ids))
        self.tree = BallTree(vectors[starts].astype(float))
        self.holders = [ids[starts[i] : min(ends[i], starts[i] + keep)] for i in self.tree.order]

    def search(self, queries: np.ndarray, own: np.ndarray, bounds: np.ndarray, k: int) -> list[list[tuple[int, int]]]:
        """Each query's k best (score, -vec_id) here whose score is at least its bound, best first."""
        tree = self.tree
        best: list[list[tuple[int, int]]] = [[] for _ in queries]
        if not len(tree.points):
            return best
        bounds = bounds.copy()
        # A bound is rounded up a little: doubles hold the integer scores exactly, but not these.
        norms = np.sqrt((queries**2).sum(1))
        upper = queries @ tree.centres.T + norms[:, None] * tree.radii[None, :]
        upper += 1e-9 * np.abs(upper) + 1e-6
        frontier = [(float(upper[:, 0].max()), 0, np.arange(len(queries)))]
        while frontier:
            # The node with the highest bound of any query is opened next.
            frontier.sort(key=lambda f: f[0])
            _, at, who = frontier.pop()
            who = who[upper[who, at] >= bounds[who]]
            if not len(who):
                continue
            node = tree.nodes[at]
            if node.children:
                frontier += [(float(upper[who, c].max()), c, who) for c in node.children]
                continue
            scores = queries[who] @ tree.points[node.low : node.high].T
            for row, q in enumerate(who):
                for j in np.flatnonzero(scores[row] >= bounds[q]):
                    s = int(scores[row, j])
                    best[q] += [(s, -int(i)) for i in self.holders[node.low + j] if i != own[q]]
                best[q].sort(reverse=True)
                del best[q][k:]
                if len(best[q]) == k:
                    bounds[q] = max(bounds[q], best[q][-1][0])
        return best


FOUND = "query_id long, score long, minus_id long"
_NAMES = ["size", "shard", "tree", "query_id", "bound", "v"]


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    rows = len(flat)
    return flat.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(rows, -1) if rows else np.zeros((0, 0))


def _build(k: int):
    def run(vectors: pa.Table) -> pa.Table:
        shard = Shard(vectors.column("vec_id").to_numpy(), _matrix(vectors.column("v")), k + 1)
        place = [vectors.column(c)[0].as_py() for c in ("size", "shard")]
        return pa.table({"size": pa.array(place[:1], pa.int32()), "shard": pa.array(place[1:], pa.int32()), "tree": pa.array([pickle.dumps(shard, 5)], pa.binary())})

    return run


def _search(k: int):
    """A stream of trees, each followed by the queries that meet it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, at = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            size, number = batch.column("size").to_numpy(), batch.column("shard").to_numpy()
            trees = batch.column("tree")
            begins = trees.is_valid().to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(np.concatenate([[True], (size[1:] != size[:-1]) | (number[1:] != number[:-1]) | begins[1:] | begins[:-1]]))
            rows: list[tuple[int, int, int]] = []
            for a, b in zip(edges.tolist(), [*edges[1:].tolist(), batch.num_rows], strict=True):
                if begins[a]:
                    shard, at = pickle.loads(trees[a].as_py()), (size[a], number[a])
                elif at == (size[a], number[a]):
                    some = batch.slice(a, b - a)
                    ids = some.column("query_id").to_numpy()
                    found = shard.search(_matrix(some.column("v")), ids, some.column("bound").to_numpy(), k)
                    rows += [(q, s, i) for q, best in zip(ids.tolist(), found, strict=True) for s, i in best]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(3)], ["query_id", "score", "minus_id"])

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank, vec_id and score: the k best of vectors (vec_id, embedding) for every row of queries (the same columns). A query never meets rows of its own id."""
    spark = vectors.sparkSession
    rows = quantised(vectors).withColumn("size", F.size("v"))
    # Enough shards to keep the cluster busy, and as many as their size asks for.
    shards = max(shuffle_width(spark), -(-rows.count() // shard_rows))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))
    trees = cut(dealt.groupBy("size", "shard").applyInArrow(_build(k), "size int, shard int, tree binary"))
    asked = quantised(queries).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("v"))
    asked = cut(asked.withColumns({"size": F.size("v"), "home": F.pmod(F.xxhash64("query_id", F.lit(5)), F.lit(shards)).cast("int")}))
    empty = {c: F.lit(None).cast(t) for c, t in (("tree", "binary"), ("query_id", "long"), ("bound", "double"), ("v", "array<double>"))}
    few = 1 + (shards - 1) // 8
    best = None
    for first, last in ((0, 1), (1, few), (few, shards)):
        if first == last:
            continue
        bounds = None if best is None else best.groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).alias("bound"))
        bounded = asked.withColumn("bound", F.lit(None).cast("double")) if bounds is None else asked.join(bounds, "query_id", "left")
        sent = bounded.withColumn("step", F.explode(F.sequence(F.lit(first), F.lit(last - 1)))).withColumn("shard", F.pmod(F.col("home") + F.col("step"), F.lit(shards)).cast("int"))
        sent = sent.withColumns({"tree": empty["tree"], "bound": F.coalesce(F.col("bound").cast("double"), F.lit(float("-inf")))}).select(*_NAMES)
        stream = trees.withColumns({c: empty[c] for c in ("query_id", "bound", "v")}).select(*_NAMES).unionByName(sent)
        ordered = stream.repartition(shards, "size", "shard").sortWithinPartitions("size", "shard", F.col("tree").isNull())
        found = ordered.mapInArrow(_search(k), FOUND)
        every = found if best is None else best.select("query_id", "score", "minus_id").unionByName(found)
        ranked = every.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("minus_id").desc())))
        best = cut(ranked.where(F.col("rank") <= k))
    return best.select("query_id", "rank", (-F.col("minus_id")).alias("vec_id"), "score")


def top_k_sql(k: int = K, every: int = 50) -> str:
    sound = "embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0"
    return (
        f"WITH v AS (SELECT vec_id, list_transform(embedding, lambda c: CAST(floor(CAST(c AS DOUBLE) * 256) AS BIGINT)) AS v FROM embeddings WHERE {sound}), "
        f"s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % {every} = 0 AND q.vec_id <> c.vec_id), "
        f"r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s) SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {k}"
    )
