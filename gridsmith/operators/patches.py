"""Patches and their manifest."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridsmith.functions.scalar import bounds_text, patch_bounds, patch_id
from gridsmith.operators.grid import tiles
from gridsmith.schemas import MANIFEST


def patch_ratios(mask: DataFrame, size: int, height: int, width: int, least: float = 0.0, value: str = "m") -> DataFrame:
    """row, col and coffee_ratio of every whole patch that reaches the least ratio (equality stays): one aggregate with a map-side part."""
    share = F.avg(F.coalesce((F.col(value).cast("double") > 0).cast("double"), F.lit(0.0)))
    return tiles(mask, size, height, width).groupBy(F.col("tile_r").alias("row"), F.col("tile_c").alias("col")).agg(share.alias("coffee_ratio")).where(F.col("coffee_ratio") >= least)


def patch_pixels(pixels: DataFrame, kept: DataFrame, size: int, height: int, width: int) -> DataFrame:
    """The pixels of kept patches only: masks are aggregated first, so the image is scanned for those alone."""
    return tiles(pixels, size, height, width).join(kept.select(F.col("row").alias("tile_r"), F.col("col").alias("tile_c")), ["tile_r", "tile_c"], "left_semi")


def manifest(ratios: DataFrame, tile_id: str, source: str, transform: Mapping[str, float], size: int, root: str = "patches") -> DataFrame:
    """The manifest relation. Bounds come from pixel offsets, so neighbouring patches touch; bbox_index_offset has them from patch indices as offsets."""
    name = patch_id(F.lit(tile_id), F.col("row"), F.col("col"))
    at = lambda r, c: bounds_text(patch_bounds(transform, r, c, size))
    columns = {
        "patch_id": name,
        "tile_id": F.lit(tile_id),
        "fold": F.lit(None).cast("int"),
        "row": F.col("row").cast("int"),
        "col": F.col("col").cast("int"),
        "bbox": at(F.col("row") * size, F.col("col") * size),
        "coffee_ratio": F.col("coffee_ratio"),
        "mask_source": F.lit(source),
        "image_path": F.concat(F.lit(f"{root}/{source}/images/"), name, F.lit(".npy")),
        "mask_path": F.concat(F.lit(f"{root}/{source}/masks/"), name, F.lit(".npy")),
    }
    out = ratios.select(*[v.alias(k) for k, v in columns.items()], at(F.col("row"), F.col("col")).alias("bbox_index_offset"))
    assert [c.split()[0] for c in MANIFEST.split(", ")] == out.columns[:-1]
    return out


def manifest_summary(rows: DataFrame, ratio: str = "coffee_ratio", sets: Sequence[str] = ()) -> DataFrame:
    """Counts, and the ratio's least, mean and greatest; for each of sets its distinct values in order (nulls left out) and their number."""
    extra = [e for c in sets for e in (F.sort_array(F.collect_set(c)).alias(f"{c}_values"), F.countDistinct(c).alias(f"n_{c}"))]
    return rows.agg(F.count("*").alias("n_patches"), F.count_if(F.col(ratio) > 0).alias("n_positive"), F.min(ratio).alias("min_ratio"), F.avg(ratio).alias("mean_ratio"), F.max(ratio).alias("max_ratio"), *extra)


def top_patches(rows: DataFrame, n: int = 3, ratio: str = "coffee_ratio", key: str = "patch_id") -> DataFrame:
    """The n greatest ratios, ties by key: each task keeps n rows."""
    return rows.orderBy(F.col(ratio).desc(), key).limit(n)


def row_major(rows: DataFrame) -> DataFrame:
    """Patches in the order of their rows and columns: one range shuffle, a number from 0 for each."""
    place = F.row_number().over(Window.partitionBy("row").orderBy("col")) - 1
    before = rows.groupBy("row").agg(F.count("*").alias("__n"))
    started = before.withColumn("__start", F.sum("__n").over(Window.orderBy("row").rowsBetween(Window.unboundedPreceding, -1)))
    numbered = rows.withColumn("__place", place).join(started.select("row", "__start"), "row")
    return numbered.withColumn("place", (F.coalesce("__start", F.lit(0)) + F.col("__place")).cast("long")).drop("__place", "__start")


def hashed_sample(rows: DataFrame, n: int, key: str) -> DataFrame:
    """n rows by the md5 of their key: the same rows on every run and in every engine."""
    return rows.orderBy(F.md5(F.col(key).cast("string").cast("binary")), key).limit(n)


def local_paths(rows: DataFrame) -> DataFrame:
    """The distinct image and mask paths, in order."""
    return rows.select(F.col("image_path").alias("path")).union(rows.select("mask_path")).where("path IS NOT NULL").distinct().orderBy("path")


def agreement_cells(first: Column, other: Column) -> Column:
    return F.struct((first & other).alias("both"), (first & ~other).alias("only_first"), (~first & other).alias("only_other"))


def moved(height: int, width: int, how: str) -> tuple[Column, Column]:
    """New (row, col) of a pixel under hflip, vflip, or a counter-clockwise quarter turn (rot90, rot180, rot270)."""
    r, c = F.col("row"), F.col("col")
    moves = {"hflip": (r, width - 1 - c), "vflip": (height - 1 - r, c), "rot90": (width - 1 - c, r), "rot180": (height - 1 - r, width - 1 - c), "rot270": (c, height - 1 - r)}
    if how not in moves:
        raise ValueError(f"unknown move {how!r}; known are {sorted(moves)}")
    return moves[how]


def augment(pixels: DataFrame, height: int, width: int, how: str) -> DataFrame:
    row, col = moved(height, width, how)
    return pixels.select(*[c for c in pixels.columns if c not in ("row", "col")], row.alias("row"), col.alias("col"))
