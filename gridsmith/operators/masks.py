"""Scene filters, composites and masks."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridsmith.functions.scalar import ratio_or_null
from gridsmith.schemas import Source


def in_dates(ts: Column, start: str, end: str) -> Column:
    """Both end days included; two plain comparisons, so they reach the scan."""
    return (ts >= F.lit(start).cast("timestamp")) & (ts < F.date_add(F.lit(end).cast("date"), 1).cast("timestamp"))


def overlaps(left: Column, bottom: Column, right: Column, top: Column, bounds: Sequence[float]) -> Column:
    return (left <= bounds[2]) & (right >= bounds[0]) & (bottom <= bounds[3]) & (top >= bounds[1])


def clear(qa: Column, bits: int) -> Column:
    """None of the bits is set."""
    return qa.bitwiseAND(F.lit(bits)) == 0


def mask_clouds(scenes: DataFrame, bands: Sequence[str], bits: int, qa: str = "qa") -> DataFrame:
    """Cloudy observations keep their row and lose their values: aggregates skip nulls."""
    return scenes.withColumns({b: F.when(clear(F.col(qa), bits), F.col(b)) for b in bands})


def median_composite(scenes: DataFrame, keys: Sequence[str], bands: Sequence[str]) -> DataFrame:
    """The median over time of every band, the mean of the two middle ones for even counts; null where no observation is clear. One shuffle by pixel."""
    return scenes.groupBy(*keys).agg(*[F.median(b).alias(b) for b in bands])


def latest_mosaic(scenes: DataFrame, keys: Sequence[str], bands: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last value that isn't null, by the order columns; partial maxima are made before the shuffle."""
    at = F.struct(*order)
    return scenes.groupBy(*keys).agg(*[F.max_by(F.col(b), F.when(F.col(b).isNotNull(), at)).alias(b) for b in bands])


def class_mask(x: Column, value: float) -> Column:
    return F.coalesce(x == value, F.lit(False))


def threshold_mask(x: Column, least: float) -> Column:
    return F.coalesce(x >= F.lit(float(least)), F.lit(False))


def binary(x: Column) -> Column:
    return F.coalesce(x > 0, F.lit(False))


#: Mask builders by kind of source: (value column, source) -> mask.
BUILDERS: dict[str, Callable[[Column, Source], Column]] = {
    "class": lambda x, s: class_mask(x, s.value),
    "threshold": lambda x, s: threshold_mask(x, s.value),
    "vector": lambda x, s: binary(x),
}


def source_mask(x: Column, source: Source) -> Column:
    if source.kind not in BUILDERS:
        raise ValueError(f"no mask builder for {source.kind!r}")
    return BUILDERS[source.kind](x, source)


def clip(pixels: DataFrame, area: DataFrame, keys: Sequence[str], mask: str = "m") -> DataFrame:
    """Masks outside the area are false; area is a table of its pixels' keys."""
    inside = area.select(*keys).distinct().withColumn("__in", F.lit(True))
    return pixels.join(inside, list(keys), "left").withColumn(mask, F.col(mask) & F.coalesce("__in", F.lit(False))).drop("__in")


def area_share(pixels: DataFrame, masks: dict[str, Column], pixel_m: float, in_area: Column | None = None) -> DataFrame:
    """source, pixels, area_km2, share_of_grid and share_of_aoi of every mask: one scan, one aggregate, no shuffle by source."""
    inside = F.lit(True) if in_area is None else in_area
    sums = [F.count_if(m).alias(f"n{i}") for i, m in enumerate(masks.values())]
    one = pixels.agg(F.count("*").alias("total"), F.count_if(inside).alias("aoi"), *sums)
    rows = F.array(*[F.struct(F.lit(name).alias("source"), F.col(f"n{i}").alias("pixels")) for i, name in enumerate(masks)])
    out = one.select("total", "aoi", F.inline(rows))
    return out.select("source", "pixels", (F.col("pixels") * (pixel_m**2) / 1e6).alias("area_km2"), ratio_or_null(F.col("pixels"), F.col("total")).alias("share_of_grid"), ratio_or_null(F.col("pixels"), F.col("aoi")).alias("share_of_aoi"))


def threshold_sweep(pixels: DataFrame, x: Column, thresholds: Sequence[float], pixel_m: float) -> DataFrame:
    """threshold, share and area_km2 (to 2 digits) for every threshold: conditional sums in one scan, whatever the number of thresholds."""
    one = pixels.agg(F.count(x).alias("n"), *[F.count_if(x >= F.lit(float(t))).alias(f"t{i}") for i, t in enumerate(thresholds)])
    rows = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"t{i}").alias("pixels")) for i, t in enumerate(thresholds)])
    out = one.select("n", F.inline(rows))
    return out.select("threshold", ratio_or_null(F.col("pixels"), F.col("n")).alias("share"), F.round(F.col("pixels") * (pixel_m**2) / 1e6, 2).alias("area_km2"))


def non_binary(x: Column) -> Column:
    """How many values are neither 0 nor 1."""
    return F.count_if(~x.isin(0, 1))
