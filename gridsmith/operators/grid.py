"""Grids: equality, alignment and resampling by joins on pixel keys."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Grid:
    """Height and width in pixels, the affine transform a..f, and a coordinate system."""

    height: int
    width: int
    a: float
    b: float
    c: float
    d: float
    e: float
    f: float
    crs: str = "EPSG:31983"

    @property
    def pixel_m(self) -> float:
        return abs(self.a)

    def centre(self, row: Column, col: Column) -> tuple[Column, Column]:
        r, k = row + 0.5, col + 0.5
        return k * self.a + r * self.b + self.c, k * self.d + r * self.e + self.f

    def place(self, x: Column, y: Column) -> tuple[Column, Column]:
        """Fractional (row, col) of a point: the inverse transform."""
        det = self.a * self.e - self.b * self.d
        if det == 0:
            raise ValueError("the transform has no inverse")
        dx, dy = x - self.c, y - self.f
        return (dy * self.a - dx * self.d) / det, (dx * self.e - dy * self.b) / det


def require_same(a: Grid, b: Grid) -> None:
    if a != b:
        raise ValueError("distinct grids: align one to the other first")


def target_pixels(target: Grid, spark, partitions: int | None = None) -> DataFrame:
    """All (row, col) of a grid, made on the executors."""
    cells = spark.range(0, target.height * target.width, 1, partitions) if partitions else spark.range(target.height * target.width)
    return cells.select(F.expr(f"CAST(id div {target.width} AS INT)").alias("row"), (F.col("id") % target.width).cast("int").alias("col"))


def nearest(pixels: DataFrame, source: Grid, target: Grid, cells: DataFrame, value: str, outside=0, keys: Sequence[str] = ()) -> DataFrame:
    """The target's cells with the value of the source pixel that holds their centre: one equi join; outside the source the fill value.

    keys are further columns of both tables (a raster's or patch's id). Within
    one grid no join is made.
    """
    if source == target:
        return pixels.select(*keys, "row", "col", value)
    r, c = source.place(*target.centre(F.col("row"), F.col("col")))
    wanted = cells.select(*keys, "row", "col", F.floor(r).cast("int").alias("__r"), F.floor(c).cast("int").alias("__c"))
    own = pixels.select(*keys, F.col("row").alias("__r"), F.col("col").alias("__c"), value)
    return wanted.join(own, [*keys, "__r", "__c"], "left").select(*keys, "row", "col", F.coalesce(value, F.lit(outside)).alias(value))


def reprojected(pixels: DataFrame, source: Grid, target: Grid, cells: DataFrame, value: str, to_source: Callable[[Column, Column], tuple[Column, Column]], outside=0) -> DataFrame:
    """The target's cells with the value of the source pixel that holds their centre, whose coordinates to_source turns into the source's system; outside the source the fill value. One equi join."""
    r, c = source.place(*to_source(*target.centre(F.col("row"), F.col("col"))))
    wanted = cells.select("row", "col", F.floor(r).cast("int").alias("__r"), F.floor(c).cast("int").alias("__c"))
    own = pixels.select(F.col("row").alias("__r"), F.col("col").alias("__c"), value)
    return wanted.join(own, ["__r", "__c"], "left").select("row", "col", F.coalesce(value, F.lit(outside)).alias(value))


def bilinear(pixels: DataFrame, source: Grid, target: Grid, cells: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """The weighted mean of the four source pixels around each target centre. Only the source's interior is defined; elsewhere, and beside missing or NaN pixels, the result is NaN.

    The four neighbours are four rows of one equi join and one aggregate with a
    map-side part, so four joins aren't needed.
    """
    if source == target:
        return pixels.select(*keys, "row", "col", value)
    r, c = source.place(*target.centre(F.col("row"), F.col("col")))
    based = cells.select(*keys, "row", "col", (r - 0.5).alias("__fr"), (c - 0.5).alias("__fc"))
    based = based.withColumns({"__r0": F.floor("__fr").cast("int"), "__c0": F.floor("__fc").cast("int")})
    wr, wc = F.col("__fr") - F.col("__r0"), F.col("__fc") - F.col("__c0")
    corners = F.array(*[F.struct((F.col("__r0") + i).alias("__r"), (F.col("__c0") + j).alias("__c"), ((wr if i else 1 - wr) * (wc if j else 1 - wc)).alias("__w")) for i in (0, 1) for j in (0, 1)])
    wanted = based.select(*keys, "row", "col", F.inline(corners)).where(F.col("__w") > 0)
    own = pixels.select(*keys, F.col("row").alias("__r"), F.col("col").alias("__c"), F.col(value).cast("double").alias(value))
    met = wanted.join(own, [*keys, "__r", "__c"], "left")
    return met.groupBy(*keys, "row", "col").agg(F.sum(F.coalesce(F.col(value), F.lit(float("nan"))) * F.col("__w")).alias(value))


def strided(pixels: DataFrame, height: int, width: int, most: int = 4096) -> DataFrame:
    """Every s-th row and column, so that neither side shows more than `most`."""
    s = max(1, max(height, width) // most)
    return pixels.where((F.col("row") % s == 0) & (F.col("col") % s == 0))


def tiles(pixels: DataFrame, size: int, height: int, width: int) -> DataFrame:
    """tile_r and tile_c of every pixel in a whole tile; a filter on them prunes files partitioned by them."""
    out = pixels.withColumns({"tile_r": F.expr(f"row div {size}").cast("int"), "tile_c": F.expr(f"col div {size}").cast("int")})
    return out.where((F.col("tile_r") < height // size) & (F.col("tile_c") < width // size))
