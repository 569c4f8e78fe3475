"""Agreement of masks on one grid."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridsmith.functions.scalar import ratio_or_null

CELLS = ("both", "only_first", "only_other", "neither")


def _cells(a: Column, b: Column) -> list[Column]:
    return [a & b, a & ~b, ~a & b, ~a & ~b]


def with_metrics(cells: DataFrame) -> DataFrame:
    """Adds overall agreement, IoU, F1, precision, recall and Cohen's kappa to both/only_first/only_other/neither; null where undefined."""
    both, first, other, none = (F.col(c).cast("double") for c in CELLS)
    n = both + first + other + none
    overall = ratio_or_null(both + none, n)
    chance = ratio_or_null((both + first) * (both + other) + (other + none) * (first + none), n * n)
    return cells.withColumns(
        {
            "overall_agreement": overall,
            "iou": ratio_or_null(both, both + first + other),
            "f1": ratio_or_null(2 * both, 2 * both + first + other),
            "precision": ratio_or_null(both, both + first),
            "recall": ratio_or_null(both, both + other),
            "kappa": ratio_or_null(overall - chance, 1 - chance),
        }
    )


def pair_agreement(pixels: DataFrame, first: Column, other: Column) -> DataFrame:
    """One row: the confusion table and its metrics, from four conditional sums in one scan."""
    return with_metrics(pixels.agg(*[F.count_if(c).alias(n) for n, c in zip(CELLS, _cells(first, other), strict=True)]))


def all_pairs(pixels: DataFrame, masks: dict[str, Column]) -> DataFrame:
    """A row for every unordered pair, in the masks' order. Masks are columns of one pixel row, so all pairs share one scan and no join."""
    pairs = list(combinations(masks, 2))
    sums = [F.count_if(c).alias(f"{n}_{k}") for k, (a, b) in enumerate(pairs) for n, c in zip(CELLS, _cells(masks[a], masks[b]), strict=True)]
    if not pairs:
        raise ValueError("agreement needs two masks at least")
    rows = F.array(*[F.struct(F.lit(k).alias("pair"), F.lit(a).alias("first"), F.lit(b).alias("other"), *[F.col(f"{n}_{k}").alias(n) for n in CELLS]) for k, (a, b) in enumerate(pairs)])
    return with_metrics(pixels.agg(*sums).select(F.inline(rows)))


def to_columns(mask_pixels: DataFrame, sources: Sequence[str], keys: Sequence[str] = ("row", "col")) -> DataFrame:
    """Long masks (source, keys, m) as one row a pixel with a column a source; where a source has no pixel it is false. One shuffle by pixel."""
    return mask_pixels.groupBy(*keys).agg(*[F.coalesce(F.bool_or(F.when(F.col("source") == s, F.col("m"))), F.lit(False)).alias(s) for s in sources])


def pair_key(first: str, other: str) -> str:
    return f"{first}_vs_{other}"


def decision(pairs: DataFrame, chosen: str) -> DataFrame:
    """The pairs that hold the chosen source."""
    return pairs.where((F.col("first") == chosen) | (F.col("other") == chosen))
