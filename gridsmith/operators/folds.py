"""Spatial folds by k-means, and what is reported about them."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ITERATIONS = 100


def nearest_centre(x: Column, y: Column, centres: Sequence[Sequence[float]]) -> Column:
    """The number of the nearest of a few fixed centres, the lowest of equals: plain arithmetic, no join."""
    each = F.array(*[F.struct(((x - float(cx)) ** 2 + (y - float(cy)) ** 2).alias("d"), F.lit(i).alias("i")) for i, (cx, cy) in enumerate(centres)])
    return F.array_min(each)["i"]


def _drawn(weighted: DataFrame, weight: Column, seed: int, step: int) -> tuple[float, float] | None:
    """A point drawn with a probability in proportion to its weight, None where all are 0: the least of exponential variates of these rates.

    They are made of md5 digests, so neither order nor partitions matter, and any
    engine draws the same.
    """
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(str(step)), F.col("x").cast("string"), F.col("y").cast("string")).cast("binary"))
    uniform = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)
    positive = weighted.select("x", "y", uniform.alias("u"), weight.alias("w")).where("w > 0")
    least = positive.agg(F.min(F.struct((-F.log("u") / F.col("w")).alias("key"), "x", "y")).alias("p")).first()["p"]
    return None if least is None else (least["x"], least["y"])


def distributed_kmeans(points: DataFrame, k: int, seed: int) -> list[tuple[float, float]]:
    """Centres over all rows of a table of (x, y), by x and y: one way at every size.

    Equal points become one row with their number as its weight. Weighted
    k-means++ draws the centres from all of them, then Lloyd's steps run as
    aggregates of k rows each. Points without x or y are left out.
    """
    weighted = points.where("x IS NOT NULL AND y IS NOT NULL").groupBy(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).agg(F.count("*").alias("n")).persist()
    try:
        rows = weighted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        if rows < k:
            raise ValueError(f"{rows} points can't be dealt to {k} folds")
        n = F.col("n").cast("double")
        chosen = [_drawn(weighted, n, seed, 0)]
        for step in range(1, k):
            near = F.array_min(F.array(*[(F.col("x") - float(cx)) ** 2 + (F.col("y") - float(cy)) ** 2 for cx, cy in chosen]))
            chosen.append(_drawn(weighted, n * near, seed, step) or _drawn(weighted, n, seed, step))
        centres = np.array(chosen, float)
        for _ in range(ITERATIONS):
            label = nearest_centre(F.col("x"), F.col("y"), centres)
            moved = centres.copy()
            for r in weighted.groupBy(label.alias("i")).agg((F.sum(F.col("x") * n) / F.sum(n)).alias("x"), (F.sum(F.col("y") * n) / F.sum(n)).alias("y")).collect():
                moved[r["i"]] = r["x"], r["y"]
            if np.allclose(moved, centres, rtol=1e-12):
                break
            centres = moved
    finally:
        weighted.unpersist()
    return [tuple(c) for c in centres[np.lexsort((centres[:, 1], centres[:, 0]))]]


def assign_folds(patches: DataFrame, k: int, seed: int, key: str = "patch_id", order: Sequence[str] = ("row", "col")) -> DataFrame:
    """patches (key, order, x, y) with a fold, by the same k-means at every size; the result depends on neither key nor order."""
    return patches.drop("fold").withColumn("fold", nearest_centre(F.col("x"), F.col("y"), distributed_kmeans(patches.select("x", "y"), k, seed)))


def fold_report(patches: DataFrame, k: int, ratio: str = "coffee_ratio") -> DataFrame:
    """fold, n, mean_ratio and the mean centroid of all k folds; an empty fold has n 0 and nulls."""
    found = patches.groupBy(F.col("fold").cast("long").alias("fold")).agg(F.count("*").alias("n"), F.avg(ratio).alias("mean_ratio"), F.avg("x").alias("mean_x"), F.avg("y").alias("mean_y"))
    folds = patches.sparkSession.range(k).withColumnRenamed("id", "fold")
    return folds.join(found, "fold", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def split(patches: DataFrame, fold: int) -> tuple[DataFrame, DataFrame]:
    """(training, validation); an error when validation is empty."""
    held = patches.where(F.col("fold") == fold)
    if held.isEmpty():
        raise ValueError(f"fold {fold} holds no patches")
    return patches.where(F.col("fold") != fold), held


def batches(rows: DataFrame, size: int, seed: int, key: str, by: Sequence[str]) -> DataFrame:
    """A batch number in a seeded shuffle, within each group of `by` (a fold and epoch, say)."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary")), key))
    return rows.withColumn("batch", F.floor((place - 1) / size).cast("long"))


def count_by(rows: DataFrame, column: str) -> DataFrame:
    return rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).orderBy(column)
