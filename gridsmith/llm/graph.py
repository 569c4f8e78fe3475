"""Connected components of an edge table, without collecting it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridsmith.llm.common import cut


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every vertex but a component's smallest, with that smallest."""
    vertices, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inverse[: len(a)], inverse[len(a) :]
    label = np.arange(len(vertices))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while (new[new] != new).any():
            new = new[new]
        new = new[label]
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(vertices)))
    return vertices[moved], vertices[label[moved]]


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each task's edges made a forest: no more rows than it has vertices."""
    a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        if batch.num_rows:
            a, b = forest(np.concatenate([a, batch.column("a").to_numpy()]), np.concatenate([b, batch.column("b").to_numpy()]))
    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _is_done(edges: DataFrame) -> bool:
    """Whether every vertex has one edge at most, to a vertex without any: then all point at their component's smallest."""
    ends = edges.select(F.col("a").alias("v"), F.lit(1).alias("up")).unionByName(edges.select(F.col("b").alias("v"), F.lit(0).alias("up")))
    seen = ends.groupBy("v").agg(F.sum("up").alias("up"), F.min("up").alias("least"))
    return seen.where((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("least") == 0))).isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """v and label, the smallest vertex of its component, for every vertex of edges (a, b) that is not that smallest itself.

    Large-star and small-star steps in turn, each a grouped minimum and a join;
    between rounds the edges are written and read again. Tasks first reduce
    their own edges to forests, so few rounds are left. A minimum is combined
    before its shuffle; it is written before the large step's join, so that both
    sides of it are plain shuffles, of which a hub's partition is split by AQE.
    """
    edges = cut(edges.where(F.col("a") != F.col("b")).select("a", "b").mapInArrow(_local, "a long, b long").distinct())
    while not _is_done(edges):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = cut(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")))
        large = both.join(low, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.unionByName(low.where(F.col("a") != F.col("m")).select("a", F.col("m").alias("b"))).where(F.col("a") != F.col("b")).distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = cut(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
    return edges.select(F.col("a").alias("v"), F.col("b").alias("label"))
