"""Readers. Schemas are given, never inferred; filters and columns reach the scan."""

from __future__ import annotations

import io
import json
from collections.abc import Iterator, Sequence
from pathlib import PurePosixPath

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridsmith.schemas import FEATURES, MANIFEST, MASK_PIXELS, PIXELS, SCENES


def require_rows(frame: DataFrame, what: str) -> DataFrame:
    """The frame, or an error when it has no rows; one row at most is looked for."""
    if frame.isEmpty():
        raise ValueError(f"{what} has no rows")
    return frame


def read_pixels(spark: SparkSession, path: str, window: tuple[int, int] | None = None, bands: Sequence[str] | None = None) -> DataFrame:
    """A raster's pixels; window is (tile_r, tile_c), whose filter prunes files and row groups."""
    out = spark.read.schema(PIXELS).parquet(path)
    if window is not None:
        out = out.where((F.col("tile_r") == window[0]) & (F.col("tile_c") == window[1]))
    return out if bands is None else out.select("raster_id", "tile_r", "tile_c", "row", "col", *bands)


def read_masks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MASK_PIXELS).parquet(path)


def read_scenes(spark: SparkSession, path: str, start: str | None = None, end: str | None = None, cloud_below: float | None = None) -> DataFrame:
    from gridsmith.operators.masks import in_dates

    out = spark.read.schema(SCENES).parquet(path)
    if start is not None:
        out = out.where(in_dates(F.col("ts"), start, end or start))
    if cloud_below is not None:
        out = out.where(F.col("cloud_pct") < cloud_below)
    return require_rows(out, "the scene catalogue after filtering")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return require_rows(spark.read.schema(MANIFEST).parquet(path), "the manifest")


def read_features(spark: SparkSession, paths: str | Sequence[str], sep: str = " - ") -> DataFrame:
    """Polygon and multipolygon features of GeoJSON files, with the part of the file name after sep as municipio."""
    shape = "features array<struct<properties:struct<variedade:string,area:double>,geometry:struct<type:string,coordinates:string>>>"
    read = spark.read.schema(shape).option("multiLine", True).json(paths if isinstance(paths, str) else sorted(set(paths)))
    # The name comes as in a URL.
    name = F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))
    named = read.select(F.explode("features").alias("f"), F.element_at(F.split(F.regexp_replace(name, r"\.(geo)?json$", ""), sep), -1).alias("municipio"))
    one = F.from_json("f.geometry.coordinates", "array<array<array<double>>>")
    many = F.from_json("f.geometry.coordinates", "array<array<array<array<double>>>>")
    rings = F.when(F.col("f.geometry.type") == "Polygon", one).when(F.col("f.geometry.type") == "MultiPolygon", F.flatten(many))
    points = F.transform(rings, lambda ring: F.transform(ring, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))))
    out = named.select("municipio", F.col("f.properties.variedade").alias("variedade"), F.col("f.properties.area").alias("area"), points.alias("rings"))
    assert [c.split()[0] for c in FEATURES.split(", ")] == out.columns
    return out


def read_arrays(spark: SparkSession, path: str) -> DataFrame:
    """path, shape, dtype and values (in C order) of .npy files, decoded on the executors a file at a time."""

    def decode(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            arrays = [np.load(io.BytesIO(b), allow_pickle=False) for b in part["content"]]
            yield pd.DataFrame({"path": part["path"], "shape": [list(a.shape) for a in arrays], "dtype": [str(a.dtype) for a in arrays], "values": [a.astype("float64").ravel() for a in arrays]})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").option("recursiveFileLookup", True).load(path)
    return files.select("path", "content").mapInPandas(decode, "path string, shape array<long>, dtype string, values array<double>")


def read_json_report(spark: SparkSession, path: str) -> dict | None:
    """A small JSON report through Spark's file systems; None where it is missing or corrupt."""
    try:
        rows = spark.read.format("binaryFile").load(path).select("content").limit(1).collect()
        return json.loads(bytes(rows[0]["content"])) if rows else None
    except Exception as error:
        if isinstance(error, ValueError) or "PATH_NOT_FOUND" in str(error):
            return None
        raise


def file_facts(spark: SparkSession, path: str) -> DataFrame:
    """name, length and content hash of files: what fingerprints rest on."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.sha2("content", 256).alias("sha256"))


def stem(path: str) -> str:
    return PurePosixPath(path).stem
