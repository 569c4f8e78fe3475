"""Verification and reports: small tables made by aggregates, and the records assembled from them."""

from __future__ import annotations

import importlib.metadata
import math
import random
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridsmith.functions.scalar import composite_name, finite, mask_name, ratio_or_null
from gridsmith.operators import agreement, grid, masks
from gridsmith.schemas import Settings

RESAMPLING = ("nearest", "bilinear", "bicubic")


def align_or_pass(pixels: DataFrame, source: grid.Grid, target: grid.Grid, cells: DataFrame, value: str, keys: Sequence[str] = ()) -> tuple[DataFrame, bool]:
    """The pixels on the target grid, and whether they were on it already; others are resampled bilinearly."""
    return grid.bilinear(pixels, source, target, cells, value, keys), source == target


def verify_composite(pixels: DataFrame, own: grid.Grid, mask: grid.Grid, bands: Sequence[str]) -> DataFrame:
    """One row: shape, system, number of bands, whether the grid is the mask's, and the range of finite values (null without any)."""
    values = [finite(F.col(b).cast("double")) for b in bands]
    low, high = (F.array_min, F.min), (F.array_max, F.max)
    both = pixels.agg(*[outer(inner(F.array(*values))).alias(name) for name, (inner, outer) in (("min_value", low), ("max_value", high))])
    facts = {"height": own.height, "width": own.width, "crs": own.crs, "bands": len(bands), "aligned_to_mask": own == mask}
    return both.select(*[F.lit(v).alias(k) for k, v in facts.items()], "min_value", "max_value")


def verify_mask(pixels: DataFrame, value: str, own: grid.Grid) -> DataFrame:
    """One row: shape, system, positive pixels and their area. A value that is neither 0 nor 1 is an error of the query."""
    bad, positive = masks.non_binary(F.col(value)), F.count_if(F.col(value) > 0)
    one = pixels.agg(bad.alias("bad"), positive.alias("pixels"))
    checked = F.when(F.col("bad") > 0, F.raise_error(F.concat(F.lit("the mask is not binary: "), F.col("bad").cast("string"), F.lit(" values"))).cast("long")).otherwise(F.col("pixels"))
    facts = {"height": own.height, "width": own.width, "crs": own.crs}
    return one.select(*[F.lit(v).alias(k) for k, v in facts.items()], checked.alias("pixels")).withColumn("area_km2", F.col("pixels") * (own.pixel_m**2) / 1e6)


def comparison(pixels: DataFrame, columns: dict[str, Column], settings: Settings) -> tuple[DataFrame, DataFrame]:
    """(sources, pairs): every source's year, native resolution, area and share, and every pair's key, counts and metrics."""
    known = {s.name: s for s in settings.sources}
    areas = masks.area_share(pixels, columns, settings.scale_m)
    year = lambda s: s.year if s is not None and s.year is not None else int(settings.start_date[:4])
    look = lambda make: F.element_at(F.create_map(*[x for n in columns for x in (F.lit(n), F.lit(make(known.get(n))))]), F.col("source"))
    sources = areas.select("source", look(year).alias("year"), look(lambda s: 10 if s is None else s.native_resolution_m).alias("native_resolution_m"), "pixels", "area_km2", "share_of_grid")
    pairs = agreement.all_pairs(pixels, columns)
    return sources, pairs.withColumn("key", F.concat("first", F.lit("_vs_"), "other"))


def comparison_report(sources: DataFrame, pairs: DataFrame, own: grid.Grid) -> dict:
    """The record of a comparison; its rows are as many as the sources and their pairs."""
    total = own.height * own.width
    rows, met = sources.collect(), pairs.orderBy("pair").collect()
    return {
        "sources": [r["source"] for r in rows],
        "years": {r["source"]: r["year"] for r in rows},
        "native_resolution_m": {r["source"]: r["native_resolution_m"] for r in rows},
        "grid": {"shape": [own.height, own.width], "crs": own.crs, "pixel_size_m": own.pixel_m, "total_pixels": total, "total_area_km2": total * own.pixel_m**2 / 1e6},
        "area_km2": {r["source"]: r["area_km2"] for r in rows},
        "share": {r["source"]: r["share_of_grid"] for r in rows},
        "pairs": {r["key"]: {"pixels": {c: r[c] for c in agreement.CELLS}, "metrics": {c: r[c] for c in ("overall_agreement", "iou", "f1", "precision", "recall", "kappa")}} for r in met},
    }


def decision_record(report: Mapping, chosen: str, settings: Settings) -> dict:
    """What a manual choice rests on: the chosen source's figures and those of the pairs that it is one of."""
    mine = {key: {"metrics": pair["metrics"]} for key, pair in report["pairs"].items() if chosen in key.split("_vs_")}
    if chosen not in report["sources"]:
        raise ValueError(f"{chosen!r} is none of the compared sources")
    basis = {"chosen_source": chosen, "year": report["years"][chosen], "area_km2": report["area_km2"][chosen], "share": report["share"][chosen], "pairs": mine}
    return {"chosen_source": chosen, "region": settings.region, "decision": "manual", "pair_key": next(iter(mine), None), "basis": basis, **{k: report[k] for k in ("sources", "years", "area_km2", "share", "pairs")}}


def composite_and_mask(settings: Settings, year: int) -> tuple[str, str, str]:
    """The composite of a year, and the mask and name of the first enabled source of that year; an error where there is none."""
    for s in settings.enabled():
        if (s.year if s.year is not None else int(settings.start_date[:4])) == year:
            return composite_name(settings.region, year), mask_name(s.name, settings.region, year, s.value if s.kind == "threshold" else None), s.name
    raise ValueError(f"no enabled source has the year {year}")


def sanity_report(manifest: DataFrame, arrays: DataFrame, shape: Sequence[int]) -> DataFrame:
    """One row over a manifest (patch_id, tile_id, mask_source, fold, coffee_ratio) and sampled arrays (patch_id, dtype, shape, values, mask): what is there, and the issues found."""
    m = manifest.agg(
        F.count("*").alias("n_patches"),
        F.countDistinct("tile_id").alias("n_tiles"),
        F.countDistinct("patch_id").alias("unique_patch_ids"),
        F.sort_array(F.collect_set("mask_source")).alias("mask_sources"),
        F.min("coffee_ratio").alias("min_ratio"),
        F.avg("coffee_ratio").alias("mean_ratio"),
        F.max("coffee_ratio").alias("max_ratio"),
        F.count_if(F.col("fold").isNull()).alias("without_fold"),
    )
    folds = manifest.where("fold IS NOT NULL").groupBy("fold").agg(F.count("*").alias("n")).agg(F.sort_array(F.collect_list(F.concat_ws(":", "fold", "n"))).alias("fold_distribution"))
    wanted = F.array(*[F.lit(int(n)).cast("long") for n in shape])
    other = F.when(F.col("shape") != wanted, F.concat("patch_id", F.lit(": "), F.concat_ws("x", F.col("shape").cast("array<string>"))))
    x = F.transform("values", lambda v: finite(v))
    a = arrays.agg(
        F.count("*").alias("sample_size"),
        F.sort_array(F.collect_set("dtype")).alias("dtypes"),
        F.sort_array(F.collect_list(other)).alias("shape_issues"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set(F.array_distinct("mask"))))).alias("mask_values"),
        F.min(F.array_min(x)).alias("min_value"),
        F.max(F.array_max(x)).alias("max_value"),
        ratio_or_null(F.sum(F.size(F.filter("values", lambda v: F.isnan(v)))), F.sum(F.size("values"))).alias("nan_fraction"),
    )
    say = lambda condition, text: F.when(condition, F.lit(text))
    issues = F.array_compact(F.array(say(F.col("without_fold") > 0, "rows without fold"), say(F.size("shape_issues") > 0, "unexpected shapes"), say(F.size(F.array_except("mask_values", F.array(F.lit(0), F.lit(1)))) > 0, "mask is not binary")))
    return m.crossJoin(folds).crossJoin(a).withColumn("issues", issues)  # three tables of one row each


def contained(values: Column, allowed: Sequence[int]) -> Column:
    """Whether an array holds none but the allowed values."""
    return F.size(F.array_except(values, F.array(*[F.lit(v) for v in allowed]))) == 0


def preview_grid(left: float, bottom: float, right: float, top: float, most: int = 1024, crs: str = "EPSG:4326") -> grid.Grid:
    """A grid over bounds that is `most` pixels wide, its height rounded up."""
    height = max(1, math.ceil((top - bottom) / (right - left) * most))
    return grid.Grid(height, most, (right - left) / most, 0.0, left, 0.0, -(top - bottom) / height, top, crs)


def export_resampling(method: str, folder: str) -> str | None:
    """The resampling that an export has to ask for: none for the nearest pixel, which is what it does anyway. A folder is one name."""
    if method not in RESAMPLING:
        raise ValueError(f"unknown resampling {method!r}; known are {RESAMPLING}")
    if not folder or "/" in folder or "\\" in folder:
        raise ValueError(f"a folder is one name without separators: {folder!r}")
    return None if method == "nearest" else method


def seed_all(seed: int) -> np.random.Generator:
    """Seeds Python's and numpy's random numbers and returns a generator of the same seed."""
    random.seed(seed)
    np.random.seed(seed)
    return np.random.default_rng(seed)


def environment(packages: Sequence[str] = ("pyspark", "numpy", "pandas", "pyarrow")) -> dict[str, str]:
    found = {}
    for name in packages:
        try:
            found[name] = importlib.metadata.version(name)
        except importlib.metadata.PackageNotFoundError:
            found[name] = "not installed"
    return found


def run_metadata(model: str, source: str, settings: Settings, manifest_mark: str, training: Mapping) -> dict:
    """What a training run has to be repeated."""
    year = next((s.year for s in settings.sources if s.name == source and s.year is not None), int(settings.start_date[:4]))
    return {"model": model, "source": source, "year": year, "folds": settings.folds, "seed": settings.seed, **training, "manifest": manifest_mark, "environment": environment()}


def split_meta(source: str, manifest_mark: str, settings: Settings) -> dict:
    """What a division into folds rests on; it is current while these facts and a full fold column are."""
    return {"schema_version": 1, "source": source, "manifest": manifest_mark, "fold_count": settings.folds, "seed": settings.seed}


def split_is_current(manifest: DataFrame, stored: Mapping | None, wanted: Mapping) -> bool:
    if not stored or any(stored.get(k) != v for k, v in wanted.items()) or "fold" not in manifest.columns:
        return False
    return manifest.where(F.col("fold").isNull()).isEmpty()


