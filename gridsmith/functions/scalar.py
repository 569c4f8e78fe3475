"""Scalar functions. All are Column expressions, so they stay in whole-stage code; none raises under ANSI mode."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_finite(x: Column) -> Column:
    """Not null, NaN or infinite."""
    x = x.cast("double")
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def finite(x: Column) -> Column:
    """The value, or null where it isn't finite."""
    return F.when(is_finite(x), x)


def ratio_or_null(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def ratio_or(a: Column, b: Column, fallback: float = 1.0) -> Column:
    return F.coalesce(ratio_or_null(a, b), F.lit(float(fallback)))


def reflectance(x: Column, scale: float = 1e-4) -> Column:
    """Scaled and clipped to 0..1; NaN stays NaN and null null."""
    x = x.cast("double")
    return F.when(F.isnan(x), x).when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x * scale)))


def z_score(x: Column, mean: Column, std: Column) -> Column:
    """Values that aren't finite count as the mean; a band without mean, std or spread gives 0."""
    flat = mean.isNull() | std.isNull() | (std == 0)
    return F.when(flat, F.lit(0.0)).otherwise(F.try_divide(F.coalesce(finite(x), mean) - mean, std))


def patch_id(tile: Column, row: Column, col: Column) -> Column:
    return F.format_string("%s_r%04d_c%04d", tile, row.cast("int"), col.cast("int"))


def patch_bounds(t: Mapping[str, float], row: Column, col: Column, size: int) -> Column:
    """Bounds of a square of pixels whose first one is at pixel (row, col), under the affine transform a..f, shear included."""
    at = lambda r, c: (c * t["a"] + r * t["b"] + t["c"], c * t["d"] + r * t["e"] + t["f"])
    x0, y0 = at(row, col)
    x1, y1 = at(row + size, col + size)
    return F.struct(*[v.cast("double").alias(n) for n, v in (("left", F.least(x0, x1)), ("bottom", F.least(y0, y1)), ("right", F.greatest(x0, x1)), ("top", F.greatest(y0, y1)))])


def bounds_text(b: Column) -> Column:
    return F.format_string("%.2f,%.2f,%.2f,%.2f", b["left"], b["bottom"], b["right"], b["top"])


def text_centroid(text: Column) -> Column:
    part = F.split(text, ",")
    n = lambda i: part[i].cast("double")
    return F.struct(((n(0) + n(2)) / 2).alias("x"), ((n(1) + n(3)) / 2).alias("y"))


def bounds_centroid(b: Column) -> Column:
    return F.struct(((b["left"] + b["right"]) / 2).alias("x"), ((b["bottom"] + b["top"]) / 2).alias("y"))


def grid_dims(height: int, width: int, size: int) -> tuple[int, int]:
    """Whole patches only: partial edges are dropped."""
    return height // size, width // size


def snap(low: Column, high: Column, scale: float) -> tuple[Column, Column]:
    """Bounds moved out to multiples of the scale."""
    return F.floor(low / scale) * scale, F.ceil(high / scale) * scale


def agreement_label(first: Column, other: Column) -> Column:
    """0 neither, 1 both, 2 first only, 3 other only."""
    return F.when(first & other, 1).when(first, 2).when(other, 3).otherwise(0)


def stretch(x: Column, low: Column, high: Column) -> Column:
    """low..high to 0..255, cut off at both ends and truncated; what isn't finite gives 0, and equal ends are drawn apart by 1e-6."""
    top = F.when(high <= low, low + 1e-6).otherwise(high)
    share = F.try_divide(finite(x) - low, top - low)
    # greatest and least skip nulls, so these are kept out first.
    return F.when(share.isNull(), 0).otherwise((F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)) * 255).cast("int"))


def bin_of(x: Column, low: Column, high: Column, bins: int) -> Column:
    """0-based bin; the last bin holds the maximum, and without spread everything is in the first. Null where x isn't finite."""
    share = F.coalesce(F.try_divide((finite(x) - low) * bins, high - low), F.lit(0.0))
    return F.when(is_finite(x), F.least(F.floor(share), F.lit(bins - 1)).cast("int"))


def source_year(year: Column, start_date: Column) -> Column:
    return F.coalesce(year.cast("int"), F.substring(start_date, 1, 4).cast("int"))


def year_dates(year: Column) -> tuple[Column, Column]:
    return F.make_date(year, F.lit(1), F.lit(1)), F.make_date(year, F.lit(12), F.lit(31))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def positive(logit: Column, threshold: float = 0.5) -> Column:
    return sigmoid(logit) >= threshold


def mask_name(source: str, region: str, year: int, threshold: float | None = None) -> str:
    """The threshold's suffix is rounded, so neighbouring thresholds keep different names."""
    return f"mask_{source}_{region}_{year}" + ("" if threshold is None else f"_t{round(threshold * 100):03d}")


def mosaic_name(region: str, start: str, end: str) -> str:
    return f"sentinel2_{region}_{start}_{end}.tif"


def composite_name(region: str, year: int) -> str:
    return f"composite_{region}_{year}"


def relative_path(root: Column, path: Column) -> Column:
    prefix = F.concat(F.rtrim(root, F.lit("/")), F.lit("/"))
    return F.when(F.startswith(path, prefix), F.substr(path, F.length(prefix) + 1)).otherwise(path)


def absolute_path(root: Column, path: Column) -> Column:
    return F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat_ws("/", F.rtrim(root, F.lit("/")), path))


def fingerprint(payload: Mapping) -> str:
    """12 hexadecimal digits over the payload's canonical JSON."""
    return hashlib.sha256(json.dumps(payload, sort_keys=True).encode()).hexdigest()[:12]
