"""Evaluation of segmentation: accumulated confusion counts, losses and the best epoch."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridsmith.functions.scalar import ratio_or, ratio_or_null, sigmoid

SMOOTH, ALPHA, GAMMA, EPS = 1.0, 0.25, 2.0, 1e-6


def counts(pixels: DataFrame, predicted: Column, target: Column, by: Sequence[str] = ()) -> DataFrame:
    """tp, fp and fn. Counts of batches add up, so any split of the pixels gives the same sums."""
    aggs = [F.count_if(predicted & target).alias("tp"), F.count_if(predicted & ~target).alias("fp"), F.count_if(~predicted & target).alias("fn")]
    return pixels.groupBy(*by).agg(*aggs) if by else pixels.agg(*aggs)


def added(batches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    aggs = [F.sum(c).alias(c) for c in ("tp", "fp", "fn")]
    return batches.groupBy(*by).agg(*aggs) if by else batches.agg(*aggs)


def with_scores(rows: DataFrame) -> DataFrame:
    """IoU, precision, recall and F1; 1 where there is nothing to find and nothing found."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return rows.withColumns({"iou": ratio_or(tp, tp + fp + fn), "precision": ratio_or(tp, tp + fp), "recall": ratio_or(tp, tp + fn), "f1": ratio_or(2 * tp, 2 * tp + fp + fn)})


def epoch_means(losses: DataFrame, by: Sequence[str], batch: str, loss: Column) -> DataFrame:
    """The mean of the batches' means, not weighted by their sizes."""
    return losses.groupBy(*by, batch).agg(F.avg(loss).alias("__loss")).groupBy(*by).agg(F.avg("__loss").alias("loss"))


def best_epochs(history: DataFrame, by: Sequence[str], score: str = "val_iou", epoch: str = "epoch") -> DataFrame:
    """The row with the best score of each group, the earliest of equals."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.col(score).desc(), F.col(epoch)))
    return history.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def dice_loss(logit: Column, target: Column) -> Column:
    """An aggregate over the whole batch."""
    p, t = sigmoid(logit), target.cast("double")
    return 1 - (2 * F.sum(p * t) + SMOOTH) / (F.sum(p) + F.sum(t) + SMOOTH)


def focal_loss(logit: Column, target: Column) -> Column:
    p = F.greatest(F.lit(EPS), F.least(F.lit(1 - EPS), sigmoid(logit)))
    t = target.cast("double")
    right = F.when(t == 1, p).otherwise(1 - p)
    weight = F.when(t == 1, ALPHA).otherwise(1 - ALPHA)
    return F.avg(weight * F.pow(1 - right, F.lit(GAMMA)) * -F.log(right))


#: Numbers that one step of a distance map holds.
SLICE = 2_000_000


def _parabolas(f: np.ndarray) -> np.ndarray:
    """The least of (x - y)^2 + f(y) over y along the last axis, for as many rows at once as SLICE allows."""
    n = f.shape[-1]
    d = (np.arange(n)[:, None] - np.arange(n)[None, :]) ** 2
    out = np.empty_like(f)
    step = max(1, SLICE // (n * n))
    for i in range(0, len(f), step):
        out[i : i + step] = (f[i : i + step, None, :] + d[None]).min(-1)
    return out


def signed_distance(mask: np.ndarray) -> np.ndarray:
    """Exact Euclidean distance to the nearest pixel of the other kind: negative inside, positive outside, 0 everywhere in a uniform mask."""
    if mask.all() or not mask.any():
        return np.zeros(mask.shape)

    def to(kind: np.ndarray) -> np.ndarray:
        far = float(mask.shape[0] ** 2 + mask.shape[1] ** 2 + 1)
        f = np.where(kind, 0.0, far)
        return np.sqrt(_parabolas(_parabolas(f.T).T))

    return np.where(mask, -to(~mask), to(mask))


def distance_maps(pixels: DataFrame, key: str, mask: str = "m", carried: Sequence[str] = ()) -> DataFrame:
    """key, row, col, mask, distance and carried columns; a patch is one group, bounded by the patch size."""
    columns = [key, "row", "col", mask, *carried]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        r, c = group["row"].to_numpy(), group["col"].to_numpy()
        grid = np.zeros((r.max() + 1, c.max() + 1), bool)
        grid[r, c] = group[mask].to_numpy(bool)
        return group.assign(distance=signed_distance(grid)[r, c])[[*columns, "distance"]]

    kind = dict(pixels.dtypes)
    return pixels.select(*columns).groupBy(key).applyInPandas(run, ", ".join(f"{c} {kind[c]}" for c in columns) + ", distance double")


def boundary_loss(logit: Column, distance: Column) -> Column:
    """0 where all distances are 0."""
    return F.coalesce(ratio_or_null(F.sum(distance * sigmoid(logit)), F.sum(F.abs(distance))), F.lit(0.0))


def total_loss(dice: Column, focal: Column, boundary: Column, weights: Sequence[float]) -> Column:
    """Weighted mean; a term of weight 0 is not computed at all."""
    total = sum(weights)
    if total <= 0:
        raise ValueError("the loss weights must sum to more than 0")
    terms = [w * term for w, term in zip(weights, (dice, focal, boundary), strict=True) if w]
    out = terms[0]
    for term in terms[1:]:
        out = out + term
    return out / total
