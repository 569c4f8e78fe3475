"""Polygons: projection, rasterizing and attribute lookups."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def exactly_one(frame: DataFrame, condition: Column) -> DataFrame:
    """The one row that meets the condition; an error when there are none or several. Two rows at most are looked at."""
    found = frame.where(condition)
    n = len(found.limit(2).collect())
    if n != 1:
        raise ValueError(f"expected exactly one feature, found {'none' if n == 0 else 'several'}")
    return found


def non_empty(features: DataFrame) -> DataFrame:
    return features.where(F.coalesce(F.size("rings"), F.lit(0)) > 0)


def inside(x: Column, y: Column, rings: Column) -> Column:
    """Even-odd rule over all rings' edges; rings need not repeat their first point. Holes and crossings of a ring with itself follow from it."""

    def crossings(ring: Column) -> Column:
        edges = F.zip_with(ring, F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1)), lambda p, q: F.struct(p.alias("p"), q.alias("q")))

        def crosses(e: Column) -> Column:
            p, q = e["p"], e["q"]
            at = p["x"] + F.try_divide((y - p["y"]) * (q["x"] - p["x"]), q["y"] - p["y"])
            return ((p["y"] > y) != (q["y"] > y)) & (x < at)

        return F.size(F.filter(edges, crosses))

    total = F.aggregate(rings, F.lit(0), lambda n, ring: n + crossings(ring))
    return total % 2 == 1


def crossings(y: Column, rings: Column) -> Column:
    """Where a horizontal line meets the rings' edges, in order: by the even-odd rule the first to the second is inside, the third to the fourth, and so on."""

    def of(ring: Column) -> Column:
        edges = F.zip_with(ring, F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1)), lambda p, q: F.struct(p.alias("p"), q.alias("q")))
        met = F.filter(edges, lambda e: (e["p"]["y"] > y) != (e["q"]["y"] > y))
        return F.transform(met, lambda e: e["p"]["x"] + F.try_divide((y - e["p"]["y"]) * (e["q"]["x"] - e["p"]["x"]), e["q"]["y"] - e["p"]["y"]))

    return F.array_sort(F.flatten(F.transform(rings, of)))


def rasterize(features: DataFrame, keys: Sequence[str], left: float, top: float, scale: float, height: int, width: int) -> DataFrame:
    """keys, row and col of every grid cell whose centre is in a feature. Cells come from each feature's own bounds, so the work follows the polygons, not the grid.

    A feature's rows of cells are made first, each with its crossings alone (the
    rings stay behind), and dealt out before its cells are: a large polygon does
    not sit in one task, and a cell looks at one run.
    """
    points = F.flatten("rings")
    ys = F.transform(points, lambda p: p["y"])
    clamp = lambda v, most: F.greatest(F.lit(0), F.least(v, F.lit(most - 1))).cast("int")
    bounded = non_empty(features).withColumns({"__r0": clamp(F.floor((top - F.array_max(ys)) / scale), height), "__r1": clamp(F.floor((top - F.array_min(ys)) / scale), height)})
    by_row = bounded.withColumn("row", F.explode(F.sequence("__r0", "__r1")))
    met = by_row.select(*keys, "row", crossings(top - (F.col("row") + 0.5) * scale, F.col("rings")).alias("__at"))
    pairs = F.transform(F.sequence(F.lit(0), (F.size("__at") / 2).cast("int") - 1), lambda k: F.struct(F.get("__at", 2 * k).alias("a"), F.get("__at", 2 * k + 1).alias("z")))
    runs = met.where(F.size("__at") > 1).select(*keys, "row", F.inline(pairs)).repartition(*keys, "row")
    # A column beyond both ends, of which the comparison takes the right ones.
    ends = F.sequence(clamp(F.floor((F.col("a") - left) / scale) - 1, width), clamp(F.floor((F.col("z") - left) / scale) + 1, width))
    x = left + (F.col("col") + 0.5) * scale
    return runs.withColumn("col", F.explode(ends)).where((x >= F.col("a")) & (x < F.col("z"))).select(*keys, "row", "col")


_A, _INV_F, _K0 = 6378137.0, 298.257222101, 0.9996


def to_utm(lon: Column, lat: Column, zone: int = 23, south: bool = True) -> tuple[Column, Column]:
    """Easting and northing on the GRS80 ellipsoid by the transverse Mercator series in the third flattening (below a millimetre within a zone)."""
    f = 1 / _INV_F
    n = f / (2 - f)
    radius = _A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280)
    e = math.sqrt(f * (2 - f))
    phi, lam = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    sin = F.sin(phi)
    t = F.sinh(F.atanh(sin) - e * F.atanh(e * sin))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, a in enumerate(alpha, 1):
        x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return 500_000 + _K0 * radius * x, (10_000_000 if south else 0) + _K0 * radius * y


def to_degrees(easting: Column, northing: Column, zone: int = 23, south: bool = True) -> tuple[Column, Column]:
    """Longitude and latitude: the inverse series."""
    f = 1 / _INV_F
    n = f / (2 - f)
    radius = _A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280)
    delta = (2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45, 7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45, 56 * n**3 / 15 - 136 * n**4 / 35, 4279 * n**4 / 630)
    xi = (northing - (10_000_000 if south else 0)) / (_K0 * radius)
    eta = (easting - 500_000) / (_K0 * radius)
    x, y = xi, eta
    for j, b in enumerate(beta, 1):
        x = x - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        y = y - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(x) / F.cosh(y))
    phi = chi
    for j, d in enumerate(delta, 1):
        phi = phi + d * F.sin(2 * j * chi)
    return F.degrees(F.atan2(F.sinh(y), F.cos(x))) + (zone * 6 - 183), F.degrees(phi)
