"""Further queries: readers over tables written by the store, guards, reports, and operators that the headline queries don't reach."""

from __future__ import annotations

import io
import json
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridsmith.functions import scalar as S
from gridsmith.operators import agreement, evaluate, folds, grid, masks, patches, report, stats, vector
from gridsmith.plans import queries as Q
from gridsmith.plans.registry import query, rounded
from gridsmith.plans.views import PATCHES_SQL, PER_ROW, PX_SQL, SIDE, px, table
from gridsmith.plans.views import patches as patch_view
from gridsmith.schemas import BANDS, Settings, Source
from gridsmith.sources import geotiff, readers, shapefile
from gridsmith.sources.store import Store, shared_folder
from gridsmith.streaming import metrics

RASTER_SQL = f"{PX_SQL}, raster AS (SELECT vec_id, CAST(vec_id // 32 * 4 + row AS INTEGER) AS row, CAST(vec_id % 32 * 4 + col AS INTEGER) AS col, b2, b3, b4, b8 FROM px), size AS (SELECT (max(vec_id) // 32 + 1) * 4 AS height FROM embeddings)"


def three_masks() -> dict[str, Column]:
    return {"a": F.col("b2") > 0, "b": F.col("b3") > 0, "c": F.col("b4") > 0}


def store(spark: SparkSession, name: str) -> Store:
    return Store(spark, f"{shared_folder(spark)}/{name}")


def rows_of(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    """A few fixed rows without a trip through Python workers."""
    kinds = [c.rsplit(" ", 1) for c in schema.split(", ")]
    structs = [F.struct(*[F.lit(v).cast(kind).alias(name) for (name, kind), v in zip(kinds, row, strict=True)]) for row in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))


def raised(action: Callable[[], object]) -> bool:
    try:
        action()
    except Exception:
        return True
    return False


@query(
    f"WITH {PX_SQL} SELECT '310044' AS raster_id, CAST(vec_id // 32 AS INTEGER) AS tile_r, CAST(vec_id % 32 AS INTEGER) AS tile_c, row, col, b2, b8 FROM px "
    f"WHERE vec_id // 32 = 3 AND vec_id % 32 = 5"
)
def raster_window_read(spark, d):
    """All pixels written by tile row, one window of two bands read."""
    place = {"raster_id": F.lit("310044"), "tile_r": F.floor(F.col("vec_id") / PER_ROW).cast("int"), "tile_c": (F.col("vec_id") % PER_ROW).cast("int")}
    pixels = px(spark, d).select(*[v.alias(k) for k, v in place.items()], "row", "col", *[F.col(b).cast("float").alias(b) for b in BANDS])
    path = store(spark, "raster_window_read").write_table("pixels", pixels, {"tables": d}, ("tile_r",))
    out = readers.read_pixels(spark, path, (3, 5), ["b2", "b8"])
    return out.withColumns({b: F.col(b).cast("double") for b in ("b2", "b8")})


@query(f"WITH {PX_SQL} SELECT count(*) AS n, count(*) FILTER (b2 > 0) AS a, count(*) FILTER (b3 > 0) AS b, CAST(0 AS BIGINT) AS missing FROM px")
def mask_read(spark, d):
    """Masks written long, read and laid side by side; where a source has no pixel, or no pixels at all, it is false."""
    whole, _ = Q.raster(spark, d)
    one = lambda name, m: whole.select(F.lit(name).alias("source"), F.lit(2018).alias("year"), "row", "col", m.alias("m"))
    long = one("a", F.col("b2") > 0).unionByName(one("b", F.col("b3") > 0).where("m"))
    path = store(spark, "mask_read").write_table("masks", long, {"tables": d})
    wide = agreement.to_columns(readers.read_masks(spark, path), ["a", "b", "missing"])
    return wide.agg(F.count("*").alias("n"), *[F.count_if(c).alias(c) for c in ("a", "b", "missing")])


@query(
    f"WITH {PATCHES_SQL}, b AS (SELECT *, 300000 + col * 5120 AS x, 7780000 - row * 5120 AS y FROM patches) "
    "SELECT format('t_r{:04d}_c{:04d}', row, col) AS patch_id, 'emater' AS mask_source, CAST((row + col) % 5 AS INTEGER) AS fold, format('{}.00,{}.00,{}.00,{}.00', x, y - 5120, x + 5120, y) AS bbox, coffee_ratio, format('patches/emater/images/t_r{:04d}_c{:04d}.npy', row, col) AS image_path FROM b"
)
def manifest_rewrite(spark, d):
    """A manifest is written without folds, read, and written again with them: a new version, while the old one is being read."""
    kept = store(spark, "manifest_rewrite")
    made = patches.manifest(patch_view(spark, d), "t", "emater", Q.AFFINE, Q.SETTINGS.patch_size).drop("bbox_index_offset")
    path = kept.write_table("manifest", made, {"tables": d, "folds": False})
    dealt = readers.read_manifest(spark, path).withColumn("fold", ((F.col("row") + F.col("col")) % 5).cast("int"))
    kept.write_table("manifest", dealt, {"tables": d, "folds": True})
    return kept.read_table("manifest").select("patch_id", "mask_source", "fold", "bbox", "coffee_ratio", "image_path")


@query("SELECT r_name AS municipio, 'arabica' AS variedade, r_regionkey + 0.5::DOUBLE AS area, CAST(1 + r_regionkey % 2 AS INTEGER) AS rings FROM region")
def features_read(spark, d):
    """A GeoJSON file a region, its name in the file's name; polygons, multipolygons, and features without geometry, which go."""
    kept = store(spark, "features_read")
    paths = []
    for r in table(spark, d, "region").collect():  # five rows at every size
        ring = [[0, 0], [10, 0], [10, 10], [0, 10], [0, 0]]
        shape = {"type": "MultiPolygon", "coordinates": [[ring], [ring]]} if r["r_regionkey"] % 2 else {"type": "Polygon", "coordinates": [ring]}
        one = lambda area, geometry: {"type": "Feature", "properties": {"variedade": "arabica", "area": area}, "geometry": geometry}
        found = [one(r["r_regionkey"] + 0.5, shape), one(99.0, {"type": "Polygon", "coordinates": []})]
        paths.append(f"{kept.root}/parcels - {r['r_name']}.json")
        kept.put(paths[-1], json.dumps({"type": "FeatureCollection", "features": found}))
    return vector.non_empty(readers.read_features(spark, paths + paths[:1])).select("municipio", "variedade", "area", F.size("rings").alias("rings"))


@query(
    "SELECT event_id AS scene_id, user_id % 100 + 0.0::DOUBLE AS cloud_pct FROM events WHERE ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-02-11' "
    "AND user_id % 100 < 20"
)
def scenes_read(spark, d):
    e = table(spark, d, "events")
    band = F.col("value").alias
    scenes = e.select(F.col("event_id").alias("scene_id"), "ts", (F.col("user_id") % 100).cast("double").alias("cloud_pct"), F.lit(0).alias("row"), F.lit(0).alias("col"), F.col("event_id").alias("qa"), *[band(b) for b in BANDS])
    path = store(spark, "scenes_read").write_table("scenes", scenes, {"tables": d})
    return readers.read_scenes(spark, path, "2024-01-03", "2024-02-10", 20.0).select("scene_id", "cloud_pct")


@query("SELECT * FROM (VALUES ('a.json', CAST(8 AS BIGINT), sha256('{\"a\": 1}')), ('b.json', 2, sha256('[]'))) AS t(name, length, sha256)")
def file_facts(spark, d):
    kept = store(spark, "file_facts")
    for name, text in (("a", '{"a": 1}'), ("b", "[]")):
        kept.put(f"{kept.root}/facts/{name}.json", text)
    return readers.file_facts(spark, f"{kept.root}/facts/*.json")


@query(
    "SELECT * "
    "FROM (VALUES ('before', false, false), ('after', true, true), ('other facts', false, true), ('missing', false, false)) AS t(moment, current, "
    "readable)"
)
def staleness_gates(spark, d):
    """A table is current for the very facts it was made of; a pointer that is broken or missing is none."""
    kept = store(spark, "staleness_gates")
    kept.put(f"{kept.root}/regions/current.json", "{broken")
    readable = lambda name: not raised(lambda: kept.require(name))
    rows = [("before", kept.current("regions", {"k": 1}), readable("regions"))]
    kept.ensure("regions", {"k": 1}, lambda: table(spark, d, "region"))
    rows.append(("after", kept.current("regions", {"k": 1}), readable("regions")))
    rows.append(("other facts", kept.current("regions", {"k": 2}), readable("regions")))
    rows.append(("missing", kept.current("nowhere", {}), readable("nowhere")))
    return rows_of(spark, "moment string, current boolean, readable boolean", rows)


@query(
    "SELECT vec_id FROM embeddings WHERE vec_id % 32 * 512 <= 4000 AND vec_id % 32 * 512 + 512 >= 1000 AND vec_id // 32 * 512 <= 2500 "
    "AND vec_id // 32 * 512 + 512 >= 600"
)
def bounds_filter(spark, d):
    left, bottom = F.col("col") * 512, F.col("row") * 512
    return patch_view(spark, d).where(masks.overlaps(left, bottom, left + 512, bottom + 512, (1000, 600, 4000, 2500))).select("vec_id")


@query(f"WITH {PX_SQL} SELECT vec_id, count(*) AS pixels, count(*) FILTER (b2 > 0 AND b8 > -0.1) AS inside FROM px GROUP BY 1")
def aoi_clip(spark, d):
    pixels = px(spark, d).withColumn("m", F.col("b2") > 0)
    out = masks.clip(pixels.select("vec_id", "row", "col", "m"), pixels.where("b8 > -0.1"), ["vec_id", "row", "col"])
    return out.groupBy("vec_id").agg(F.count("*").alias("pixels"), F.count_if("m").alias("inside"))


@query(
    f"WITH {RASTER_SQL}, t AS (SELECT *, row // 8 AS tile_r, col // 8 AS tile_c FROM raster, size "
    f"WHERE row // 8 < height // 8), k AS (SELECT tile_r, tile_c FROM t GROUP BY 1, 2 HAVING avg(CASE WHEN b2 > 0 THEN 1.0 ELSE 0.0 END) >= 0.5) "
    "SELECT CAST(tile_r AS INTEGER) AS tile_r, CAST(tile_c AS INTEGER) AS tile_c, count(*) AS n, round(sum(b3), 6) + 0.0 AS total FROM t "
    "JOIN k USING (tile_r, tile_c) GROUP BY 1, 2"
)
def kept_patch_pixels(spark, d):
    """The image's pixels of the patches that the mask keeps."""
    whole, height = Q.raster(spark, d)
    kept = patches.patch_ratios(whole.withColumn("m", F.col("b2")), 8, height, PER_ROW * SIDE, 0.5)
    out = patches.patch_pixels(whole, kept, 8, height, PER_ROW * SIDE)
    return rounded(out.groupBy("tile_r", "tile_c").agg(F.count("*").alias("n"), F.sum("b3").alias("total")))


@query(
    f"WITH {RASTER_SQL}, s AS (SELECT greatest(1, greatest(height, 128) // 16) AS s FROM size) SELECT row, col, b2 FROM raster, s WHERE row % s = 0 "
    f"AND col % s = 0"
)
def strided_preview(spark, d):
    whole, height = Q.raster(spark, d)
    return grid.strided(whole, height, PER_ROW * SIDE, 16).select("row", "col", "b2")


@query(
    f"WITH {PX_SQL}, n AS (SELECT sum(b2) AS v, count(*) AS n FROM px) SELECT 'same' AS grid, true AS aligned, n, CAST(0 AS BIGINT) AS n_nan, "
    f"round(v, 6) + 0.0 AS total FROM n UNION ALL "
    "SELECT 'moved', false, n, n * 7 // 16, (SELECT "
    "round(sum(0.28::DOUBLE * a.b2 + 0.42::DOUBLE * b.b2 + 0.12::DOUBLE * c.b2 + 0.18::DOUBLE * e.b2), 6) + 0.0 FROM px a "
    "JOIN px b ON b.vec_id = a.vec_id AND b.row = a.row AND b.col = a.col + 1 JOIN px c ON c.vec_id = a.vec_id AND c.row = a.row + 1 AND c.col = a.col "
    "JOIN px e ON e.vec_id = a.vec_id AND e.row = a.row + 1 AND e.col = a.col + 1) FROM n"
)
def align_or_pass(spark, d):
    """One grid passes, a moved one is resampled; what has no four neighbours is NaN."""
    own, moved = grid.Grid(4, 4, 10, 0, 0, 0, -10, 40), grid.Grid(4, 4, 10, 0, 6, 0, -10, 37)
    pixels = px(spark, d)
    out = []
    for at, target in (("same", own), ("moved", moved)):
        drawn, aligned = report.align_or_pass(pixels, own, target, pixels.select("vec_id", "row", "col"), "b2", ["vec_id"])
        out.append(drawn.agg(F.count("*").alias("n"), F.count_if(F.isnan("b2")).alias("n_nan"), F.sum(F.when(~F.isnan("b2"), F.col("b2"))).alias("total")).select(F.lit(at).alias("grid"), F.lit(aligned).alias("aligned"), "n", "n_nan", "total"))
    return rounded(out[0].unionByName(out[1]))


@query(
    "SELECT s_suppkey AS feature, round(-47 + s_suppkey % 300 * 0.01::DOUBLE, 7) + 0.0 AS lon, "
    "round(-24 + s_suppkey % 170 * 0.02::DOUBLE, 7) + 0.0 AS lat, CASE WHEN s_suppkey % 300 = 200 THEN 500000.0::DOUBLE END AS on_meridian FROM supplier"
)
def projection_round_trip(spark, d):
    """Degrees to metres and back; on the zone's central meridian the easting is 500 km."""
    key = F.col("s_suppkey")
    lon, lat = -47 + key % 300 * 0.01, -24 + key % 170 * 0.02
    e, n = vector.to_utm(lon, lat)
    placed = table(spark, d, "supplier").select(key.alias("feature"), e.alias("e"), n.alias("n"))
    back = vector.to_degrees(F.col("e"), F.col("n"))
    return rounded(placed.select("feature", back[0].alias("lon"), back[1].alias("lat"), F.when(F.col("feature") % 300 == 200, F.round("e", 4)).alias("on_meridian")), 7)


@query(
    "WITH h AS (SELECT s_suppkey AS feature, s_suppkey * 37 % 900 // 10 * 10 AS x, s_suppkey * 53 % 900 // 10 * 10 AS y FROM supplier) SELECT feature, "
    "CAST(100 - 16 + 4 AS BIGINT) AS pixels, CAST(x // 10 AS INTEGER) AS first_col, CAST((900 - y) // 10 AS INTEGER) AS first_row FROM h"
)
def rasterize_holes(spark, d):
    """A square of 10 x 10 cells with a hole of 4 x 4 in which an island of 2 x 2 lies (the second polygon of a multipolygon)."""
    key = F.col("s_suppkey")
    x, y = F.floor(key * 37 % 900 / 10) * 10, F.floor(key * 53 % 900 / 10) * 10
    corner = lambda dx, dy: F.struct((x + dx).cast("double").alias("x"), (y + dy).cast("double").alias("y"))
    square = lambda a, b: F.array(corner(a, a), corner(b, a), corner(b, b), corner(a, b))
    shapes = table(spark, d, "supplier").select(key.alias("feature"), F.array(square(0, 100), square(30, 70), square(40, 60)).alias("rings"))
    cells = vector.rasterize(shapes, ["feature"], 0.0, 1000.0, 10.0, 100, 100)
    return cells.groupBy("feature").agg(F.count("*").alias("pixels"), F.min("col").alias("first_col"), F.min("row").alias("first_row"))


_LOSSES = "WITH {px}, p AS (SELECT 1 / (1 + exp(-b2 * 10)) AS p, greatest(1e-6::DOUBLE, least(1 - 1e-6::DOUBLE, 1 / (1 + exp(-b2 * 10)))) AS q, b3 > 0 AS t FROM px), l AS (SELECT 1 - (2 * sum(CASE WHEN t THEN p ELSE 0 END) + 1) / (sum(p) + count(*) FILTER (t) + 1) AS dice, avg((CASE WHEN t THEN 0.25::DOUBLE ELSE 0.75::DOUBLE END) * power(1 - (CASE WHEN t THEN q ELSE 1 - q END), 2) * -ln(CASE WHEN t THEN q ELSE 1 - q END)) AS focal FROM p)"


@query(_LOSSES.format(px=PX_SQL) + " SELECT round((dice + 2 * focal) / 3, 6) + 0.0 AS weighted, round(focal, 6) + 0.0 AS one FROM l")
def total_loss(spark, d):
    dice, focal = evaluate.dice_loss(F.col("b2") * 10, F.col("b3") > 0), evaluate.focal_loss(F.col("b2") * 10, F.col("b3") > 0)
    boundary = evaluate.boundary_loss(F.col("b2") * 10, F.lit(0.0))
    return rounded(px(spark, d).agg(evaluate.total_loss(dice, focal, boundary, (1, 2, 0)).alias("weighted"), evaluate.total_loss(dice, focal, boundary, (0, 1, 0)).alias("one")))


@query(
    "SELECT n_nationkey AS k, CAST(CASE WHEN n_nationkey % 3 = 0 THEN 2018 ELSE 2018 + n_nationkey % 5 END AS INTEGER) AS year, "
    "CAST(make_date(2018 + n_nationkey % 5, 1, 1) AS VARCHAR) AS first_day, "
    "CAST(make_date(2018 + n_nationkey % 5, 12, 31) AS VARCHAR) AS last_day, 'mask_x_310044_2018_t028' AS mask, "
    "'sentinel2_310044_2018-01-01_2018-12-31.tif' AS mosaic, 'composite_310044_2018' AS composite FROM nation"
)
def names_and_years(spark, d):
    key = F.col("n_nationkey")
    own = (F.lit(2018) + key % 5).cast("int")
    first, last = S.year_dates(own)
    names = [F.lit(S.mask_name("x", "310044", 2018, 0.28)).alias("mask"), F.lit(S.mosaic_name("310044", "2018-01-01", "2018-12-31")).alias("mosaic"), F.lit(S.composite_name("310044", 2018)).alias("composite")]
    year = S.source_year(F.when(key % 3 != 0, own), F.lit("2018-01-01"))
    return table(spark, d, "nation").select(key.cast("long").alias("k"), year.alias("year"), first.cast("string").alias("first_day"), last.cast("string").alias("last_day"), *names).withColumn("k", F.col("k").cast("int"))


@query("SELECT CAST(2018 + n % 4 AS INTEGER) AS year, 'mapbiomas,alphaearth' AS enabled, 'alphaearth' AS chosen FROM (SELECT unnest([0, 2]) AS n)")
def settings_years(spark, d):
    """Settings from text: the enabled sources in their order, the chosen one, and the distinct years, the default's among them."""
    text = json.dumps({"region": "310044", "chosen": "alphaearth", "sources": [{"name": "mapbiomas", "kind": "class", "value": 46, "year": 2020}, {"name": "alphaearth", "kind": "threshold", "value": 0.28, "year": None}, {"name": "emater", "kind": "vector", "value": None, "year": 2031, "enabled": False}]})
    s = Settings.load(text)
    return rows_of(spark, "year int, enabled string, chosen string", [(y, ",".join(x.name for x in s.enabled()), s.chosen_source().name) for y in s.years()])


@query("SELECT toxic, count(*) AS n FROM labels WHERE toxic IS NOT NULL GROUP BY 1")
def count_by_value(spark, d):
    return folds.count_by(table(spark, d, "labels"), "toxic")


@query("SELECT n_nationkey AS k, substr(sha256('{\"a\": [1, 2], \"b\": \"x\"}'), 1, 12) AS mark FROM nation")
def fingerprints(spark, d):
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.lit(S.fingerprint({"b": "x", "a": [1, 2]})).alias("mark"))


@query(
    f"WITH {PATCHES_SQL} SELECT vec_id, CAST((row_number() OVER (PARTITION BY fold ORDER BY md5('42:' || vec_id), vec_id) - 1) // 16 AS BIGINT) AS batch "
    f"FROM patches"
)
def batch_numbers(spark, d):
    """A seeded shuffle dealt to batches of 16 within each fold."""
    return folds.batches(patch_view(spark, d), 16, Q.SETTINGS.seed, "vec_id", ["fold"]).select("vec_id", "batch")


@query("SELECT n_name AS name, 'a/' || n_name AS relative, '/data/a/' || n_name AS absolute, '/other/' || n_name AS kept FROM nation")
def path_forms(spark, d):
    name, root = F.col("n_name"), F.lit("/data/")
    full = S.absolute_path(root, F.concat(F.lit("a/"), name))
    return table(spark, d, "nation").select(name.alias("name"), S.relative_path(root, full).alias("relative"), full.alias("absolute"), S.absolute_path(root, S.relative_path(root, F.concat(F.lit("/other/"), name))).alias("kept"))


@query(f"WITH {PX_SQL} SELECT vec_id, CAST(sum(CASE WHEN b2 > 0 THEN 1 ELSE 0 END) AS BIGINT) AS ones, count(*) AS pixels FROM px GROUP BY 1")
def binary_casts(spark, d):
    """A mask as booleans, as 0/1 bytes and as numbers; null counts as false."""
    hole = F.when(F.col("b2") > 0, F.col("b2"))
    return px(spark, d).groupBy("vec_id").agg(F.sum(masks.binary(hole).cast("tinyint").cast("double")).cast("long").alias("ones"), F.count(masks.binary(hole)).alias("pixels"))


@query(f"WITH {PX_SQL} " + " UNION ALL ".join(f"SELECT '{how}' AS how, {r} AS row, {c} AS col, round(sum(b2), 6) + 0.0 AS total FROM px GROUP BY 2, 3" for how, r, c in (("vflip", "3 - row", "col"), ("rot180", "3 - row", "3 - col"), ("rot270", "col", "3 - row"))))
def further_remaps(spark, d):
    out = None
    for how in ("vflip", "rot180", "rot270"):
        one = patches.augment(px(spark, d), SIDE, SIDE, how).groupBy("row", "col").agg(F.sum("b2").alias("total")).select(F.lit(how).alias("how"), "row", "col", "total")
        out = one if out is None else out.unionByName(one)
    return rounded(out)


@query(
    "WITH v AS ("
    + " UNION ALL ".join(f"SELECT '{b}' AS band, {c} AS x FROM lineitem" for b, c in Q.LI.items())
    + "), e AS (SELECT band, min(x) AS a, max(x) AS z FROM v GROUP BY 1), h AS (SELECT band, "
    "CAST(least(floor((x - a) * 32 / (z - a)), 31) AS INTEGER) AS bin, count(*) AS n FROM v JOIN e USING (band) GROUP BY 1, 2) "
    "SELECT e.band AS band, CAST(b AS INTEGER) AS bin, coalesce(n, 0) AS n FROM e CROSS JOIN (SELECT unnest(range(32)) AS b) LEFT "
    "JOIN h ON h.band = e.band AND h.bin = b"
)
def band_histograms(spark, d):
    li = table(spark, d, "lineitem").select(*[F.col(c).alias(b) for b, c in Q.LI.items()])
    return stats.band_histograms(li, BANDS, Q.SETTINGS.bins)


@query(
    f"WITH {RASTER_SQL} SELECT CAST(height AS INTEGER) AS height, CAST(128 AS INTEGER) AS width, 'EPSG:31983' AS crs, "
    f"CAST(4 AS INTEGER) AS bands, true AS aligned_to_mask, round(least(min(b2), min(b3), min(b4), min(b8)), 6) + 0.0 AS min_value, "
    f"round(greatest(max(b2), max(b3), max(b4), max(b8)), 6) + 0.0 AS max_value FROM raster, size GROUP BY height"
)
def composite_verification(spark, d):
    whole, height = Q.raster(spark, d)
    own = grid.Grid(height, PER_ROW * SIDE, 10, 0, 300000, 0, -10, 7780000)
    return rounded(report.verify_composite(whole, own, own, BANDS))


@query(
    f"WITH {RASTER_SQL} SELECT CAST(height AS INTEGER) AS height, CAST(128 AS INTEGER) AS width, 'EPSG:31983' AS crs, count(*) FILTER (b2 > 0) AS pixels, "
    f"round(count(*) FILTER (b2 > 0) * 100 / 1e6, 6) + 0.0 AS area_km2 FROM raster, size GROUP BY height"
)
def mask_verification(spark, d):
    whole, height = Q.raster(spark, d)
    own = grid.Grid(height, PER_ROW * SIDE, 10, 0, 300000, 0, -10, 7780000)
    return rounded(report.verify_mask(whole.withColumn("m", (F.col("b2") > 0).cast("int")), "m", own))


COMPARED = Settings(sources=(Source("a", "class", 46, 2025, native_resolution_m=30), Source("b", "threshold", 0.28, None), Source("c", "vector", None, 2018)))


@query(
    f"WITH {PX_SQL}, n AS (SELECT count(*) AS t, count(*) FILTER (b2 > 0) AS a, count(*) FILTER (b3 > 0) AS b, count(*) FILTER (b4 > 0) AS c FROM px) "
    + " UNION ALL ".join(f"SELECT '{s}' AS source, CAST({y} AS INTEGER) AS year, CAST({m} AS INTEGER) AS native_resolution_m, {s} AS pixels, round({s} * 100 / 1e6, 6) + 0.0 AS area_km2, round({s} / t::DOUBLE, 6) + 0.0 AS share_of_grid FROM n" for s, y, m in (("a", 2025, 30), ("b", 2018, 10), ("c", 2018, 10)))
)
def comparison_sources(spark, d):
    return rounded(report.comparison(px(spark, d), three_masks(), COMPARED)[0])


@query(
    f"WITH {PX_SQL} "
    + " UNION ALL ".join(
        f"SELECT '{k}' AS pair, round(count(*) FILTER ({x} > 0 AND {y} > 0) / count(*) FILTER ({x} > 0 OR {y} > 0)::DOUBLE, 6) + 0.0 AS iou, CAST(2018 AS INTEGER) AS year, 'a_vs_b' AS pair_key FROM px" for k, x, y in (("a_vs_b", "b2", "b3"), ("b_vs_c", "b3", "b4"))
    )
)
def decision_record(spark, d):
    """The comparison's record is written, read again, and projected to the chosen source; a corrupt record is none."""
    kept = store(spark, "decision_record")
    pixels = px(spark, d)
    own = grid.Grid(4, 4, 10, 0, 0, 0, -10, 40)
    kept.write_report("comparison", report.comparison_report(*report.comparison(pixels, three_masks(), COMPARED), own))
    kept.put(f"{kept.root}/reports/broken.json", "{")
    if readers.read_json_report(spark, f"{kept.root}/reports/broken.json") is not None:
        raise ValueError("a corrupt report was read")
    record = report.decision_record(readers.read_json_report(spark, f"{kept.root}/reports/comparison.json"), "b", COMPARED)
    rows = [(k, p["metrics"]["iou"], record["basis"]["year"], record["pair_key"]) for k, p in record["basis"]["pairs"].items()]
    return rounded(rows_of(spark, "pair string, iou double, year int, pair_key string", rows))


@query(
    f"WITH {PATCHES_SQL}, f AS (SELECT fold, count(*) AS n FROM patches WHERE vec_id % 7 <> 0 GROUP BY 1), e AS (SELECT vec_id, embedding AS v "
    f"FROM embeddings), x AS (SELECT min(list_min(v))::DOUBLE AS low, max(list_max(v))::DOUBLE AS high FROM e), b AS (SELECT count(*) AS n "
    f"FROM embeddings WHERE vec_id % 50 = 0) "
    "SELECT (SELECT count(*) FROM patches) AS n_patches, (SELECT count(DISTINCT row) FROM patches) AS n_tiles, (SELECT count(*) "
    "FROM patches) AS unique_patch_ids, 'emater' AS mask_sources, (SELECT string_agg(fold || ':' || n, ',' ORDER BY fold) "
    "FROM f) AS fold_distribution, (SELECT count(*) FROM patches) AS sample_size, "
    "'float32,float64' AS dtypes, (SELECT n FROM b) AS n_shape_issues, '0,1,2' AS mask_values, round(low, 6) + 0.0 AS min_value, "
    "round(high, 6) + 0.0 AS max_value, 'rows without fold;unexpected shapes;mask is not binary' AS issues FROM x"
)
def sanity_report(spark, d):
    """A manifest with holes in its folds, and arrays of two types, some of another shape, with a mask that holds 2."""
    e = table(spark, d, "embeddings")
    name = F.col("vec_id").cast("string")
    manifest = patch_view(spark, d).select(name.alias("patch_id"), F.col("row").alias("tile_id"), F.lit("emater").alias("mask_source"), F.when(F.col("vec_id") % 7 != 0, F.col("fold")).alias("fold"), "coffee_ratio")
    shape = F.when(F.col("vec_id") % 50 == 0, F.array(F.lit(64))).otherwise(F.array(F.lit(4), F.lit(4), F.lit(4))).cast("array<long>")
    mask = F.when(F.col("vec_id") % 50 == 0, F.array(F.lit(2), F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))
    arrays = e.select(name.alias("patch_id"), F.when(F.col("vec_id") % 2 == 0, "float32").otherwise("float64").alias("dtype"), shape.alias("shape"), F.col("embedding").cast("array<double>").alias("values"), mask.alias("mask"))
    out = report.sanity_report(manifest, arrays, (4, 4, 4))
    lists = {c: F.array_join(F.col(c).cast("array<string>"), ",") for c in ("mask_sources", "fold_distribution", "dtypes", "mask_values")}
    named = out.withColumns(lists).withColumns({"n_shape_issues": F.size("shape_issues").cast("long"), "issues": F.array_join("issues", ";")})
    return rounded(named.select("n_patches", "n_tiles", "unique_patch_ids", "mask_sources", "fold_distribution", "sample_size", "dtypes", "n_shape_issues", "mask_values", "min_value", "max_value", "issues"))


@query(f"WITH {PATCHES_SQL} SELECT vec_id, CAST(row_number() OVER (ORDER BY row, col) - 1 AS BIGINT) AS place FROM patches")
def row_major_order(spark, d):
    return patches.row_major(patch_view(spark, d)).select("vec_id", "place")


@query("SELECT r_regionkey AS k, CAST(1024 AS INTEGER) AS width, CAST(ceil((r_regionkey + 1) / 4.0 * 1024) AS INTEGER) AS height FROM region")
def preview_grids(spark, d):
    rows = []
    for r in table(spark, d, "region").collect():  # five rows at every size
        g = report.preview_grid(-47.0, -20.0, -43.0, -20.0 + r["r_regionkey"] + 1)
        rows.append((r["r_regionkey"], g.width, g.height))
    return rows_of(spark, "k int, width int, height int", rows)


@query(f"WITH {PATCHES_SQL} SELECT fold, bool_and(row + col < 3000) AS low, bool_and(vec_id % 5 IN (0, 1)) AS only_two FROM patches GROUP BY 1")
def containment(spark, d):
    rests = patch_view(spark, d).groupBy("fold").agg(F.collect_set((F.col("vec_id") % 5).cast("int")).alias("rests"), F.max(F.col("row") + F.col("col")).alias("most"))
    return rests.select("fold", (F.col("most") < 3000).alias("low"), report.contained(F.col("rests"), (0, 1)).alias("only_two"))


@query(
    "SELECT * FROM (VALUES ('emater', CAST(2018 AS INTEGER), CAST(5 AS INTEGER), CAST(42 AS INTEGER), 'm1', "
    "CAST(16 AS INTEGER), true, true, false)) AS t(source, year, folds, seed, manifest, batch, has_versions, current, stale)"
)
def run_metadata(spark, d):
    """What a run and a division into folds rest on, and the gate that these facts make."""
    meta = report.run_metadata("unet", "emater", Q.SETTINGS, "m1", {"batch": 16})
    facts = report.split_meta("emater", "m1", Q.SETTINGS)
    manifest = patch_view(spark, d)
    current = report.split_is_current(manifest, json.loads(json.dumps(facts)), facts)
    stale = report.split_is_current(manifest, {**facts, "seed": 1}, facts) or report.split_is_current(manifest.withColumn("fold", F.when(F.col("vec_id") > 0, F.col("fold"))), facts, facts)
    row = (meta["source"], meta["year"], meta["folds"], meta["seed"], meta["manifest"], meta["batch"], set(meta["environment"]) >= {"pyspark", "numpy"}, current, stale)
    return rows_of(spark, "source string, year int, folds int, seed int, manifest string, batch int, has_versions boolean, current boolean, stale boolean", [row])


@query(f"WITH {RASTER_SQL} SELECT row, col, round(b2, 6) + 0.0 AS b2, CASE WHEN b3 > 0 THEN round(b3, 6) + 0.0 END AS b3 FROM raster")
def geotiff_round_trip(spark, d):
    """The whole raster written as GeoTIFF files of 64 x 64 pixels and read again on its grid; what was no data comes back as such, also where the last row of patches ends."""
    whole, height = Q.raster(spark, d)
    own = grid.Grid(height, PER_ROW * SIDE, 10.0, 0.0, 300000.0, 0.0, -10.0, 7780000.0)
    files = geotiff.encoded(whole.withColumn("b3", F.when(F.col("b3") > 0, F.col("b3")).otherwise(F.lit(float("nan")))), "r", own, ["b2", "b3"], 64, nodata=-9999.0)
    path = geotiff.write_geotiff(store(spark, "geotiff_round_trip"), str(height), files)
    meta = geotiff.read_geotiff_meta(spark, path)
    placed = meta.select("raster_id", F.round((F.lit(own.f) - F.col("transform.f")) / 10).cast("int").alias("r0"), F.round((F.col("transform.c") - own.c) / 10).cast("int").alias("c0"))
    pixels = geotiff.read_geotiff(spark, path, ["b2", "b3"]).where(~F.isnan("b2")).join(placed, "raster_id")
    return rounded(pixels.select((F.col("row") + F.col("r0")).alias("row"), (F.col("col") + F.col("c0")).alias("col"), "b2", F.when(~F.isnan("b3"), F.col("b3")).alias("b3")))


@query("SELECT format('m_r0000_c{:04d}', c) AS raster_id, 'EPSG:31983' AS crs, 300000.0::DOUBLE + c * 640 AS x, 7780000.0::DOUBLE AS y, CAST(64 AS INTEGER) AS height, CAST(64 AS INTEGER) AS width, 'uint8' AS dtype, CAST(1 AS INTEGER) AS bands FROM (SELECT unnest([0, 1]) AS c)")
def mask_geotiff_meta(spark, d):
    """A mask's files carry their grid, system and type."""
    whole, _ = Q.raster(spark, d)
    own = grid.Grid(64, PER_ROW * SIDE, 10.0, 0.0, 300000.0, 0.0, -10.0, 7780000.0)
    path = geotiff.write_geotiff(store(spark, "mask_geotiff_meta"), "m", geotiff.encoded(whole.select("row", "col", (F.col("b2") > 0).cast("double").alias("m")), "m", own, ["m"], 64, "uint8"))
    return geotiff.read_geotiff_meta(spark, path).select("raster_id", "crs", F.col("transform.c").alias("x"), F.col("transform.f").alias("y"), "height", "width", "dtype", "bands")


@query(
    "SELECT 'a' || r_regionkey || '.npy' AS name, (r_regionkey + 1) || 'x3' AS shape, "
    "CASE WHEN r_regionkey % 2 = 0 THEN 'float32' ELSE 'uint8' END AS dtype, "
    "CAST((r_regionkey + 1) * 3 * ((r_regionkey + 1) * 3 - 1) / 2 AS DOUBLE) AS total FROM region"
)
def arrays_read(spark, d):
    kept = store(spark, "arrays_read")
    for r in table(spark, d, "region").collect():  # five rows at every size
        k, out = r["r_regionkey"], io.BytesIO()
        np.save(out, np.arange((k + 1) * 3).reshape(k + 1, 3).astype("uint8" if k % 2 else "float32"))
        kept.put(f"{kept.root}/arrays/a{k}.npy", out.getvalue())
    rows = readers.read_arrays(spark, f"{kept.root}/arrays")
    total = F.aggregate("values", F.lit(0.0), lambda a, v: a + v)
    return rows.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.concat_ws("x", F.col("shape").cast("array<string>")).alias("shape"), "dtype", total.alias("total"))


@query(
    "SELECT vec_id, CAST(len(embedding) AS INTEGER) AS n, round(list_sum(list_transform(embedding, lambda v: CAST(v AS DOUBLE))), 6) + 0.0 AS total "
    "FROM embeddings"
)
def patch_arrays(spark, d):
    """A row of arrays a patch, written and read."""
    image = F.transform("embedding", lambda v: v.cast("float"))
    path = store(spark, "patch_arrays").write_table("arrays", table(spark, d, "embeddings").select("vec_id", image.alias("image")), {"tables": d})
    return rounded(spark.read.parquet(path).select("vec_id", F.size("image").alias("n"), F.aggregate("image", F.lit(0.0), lambda a, v: a + v.cast("double")).alias("total")))


@query(
    "SELECT * "
    "FROM (VALUES (CAST(2025 AS INTEGER), 'composite_310044_2025', 'mask_mapbiomas_310044_2025', 'mapbiomas'), (2024, 'composite_310044_2024', "
    "'mask_alphaearth_310044_2024_t028', 'alphaearth'), (2018, 'composite_310044_2018', 'mask_emater_310044_2018', 'emater')) AS t(year, composite, mask, "
    "source)"
)
def year_lookup(spark, d):
    return rows_of(spark, "year int, composite string, mask string, source string", [(y, *report.composite_and_mask(Q.SETTINGS, y)) for y in (2025, 2024, 2018)])


def _utm_sql(lon: str, lat: str) -> tuple[str, str]:
    """Easting and northing in zone 23 south by the same series, as SQL."""
    f = 1 / 298.257222101
    n, e = f / (2 - f), (f * (2 - f)) ** 0.5
    radius = 6378137.0 / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280)
    s = f"sin(radians({lat}))"
    t = f"sinh(atanh({s}) - {e!r}::DOUBLE * atanh({e!r}::DOUBLE * {s}))"
    lam = f"radians({lon} + 45)"
    xi, eta = f"atan2({t}, cos({lam}))", f"atanh(sin({lam}) / sqrt(1 + {t} * {t}))"
    x = " + ".join([eta, *[f"{a!r}::DOUBLE * cos({2 * j} * {xi}) * sinh({2 * j} * {eta})" for j, a in enumerate(alpha, 1)]])
    y = " + ".join([xi, *[f"{a!r}::DOUBLE * sin({2 * j} * {xi}) * cosh({2 * j} * {eta})" for j, a in enumerate(alpha, 1)]])
    k = 0.9996 * radius
    return f"(500000 + {k!r}::DOUBLE * ({x}))", f"(10000000 + {k!r}::DOUBLE * ({y}))"


_E, _N = _utm_sql("lon", "lat")


@query(
    f"WITH {RASTER_SQL}, t AS (SELECT CAST(i // 64 AS INTEGER) AS row, CAST(i % 64 AS INTEGER) AS col "
    f"FROM (SELECT unnest(range(4096)) AS i)), p AS (SELECT row, col, -46.9352::DOUBLE + (col + 0.5) * 0.0002::DOUBLE AS lon, "
    f"-20.0650::DOUBLE - (row + 0.5) * 0.0002::DOUBLE AS lat FROM t), "
    f"m AS (SELECT row, col, CAST(floor((7780000 - {_N}) / 10) AS INTEGER) AS r, CAST(floor(({_E} - 297500) / 10) AS INTEGER) AS c FROM p) SELECT m.row, m.col, CASE WHEN coalesce(b2, -1) > 0 THEN 1 ELSE 0 END AS m FROM m LEFT JOIN raster ON raster.row = r AND raster.col = c"
)
def raster_reprojection(spark, d):
    """A mask in metres drawn on a grid of degrees, nearest pixel; outside the raster 0."""
    whole, height = Q.raster(spark, d)
    own = grid.Grid(height, PER_ROW * SIDE, 10.0, 0.0, 297500.0, 0.0, -10.0, 7780000.0)
    target = grid.Grid(64, 64, 0.0002, 0.0, -46.9352, 0.0, -0.0002, -20.0650, "EPSG:4326")
    mask = whole.select("row", "col", (F.col("b2") > 0).cast("int").alias("m"))
    return grid.reprojected(mask, own, target, grid.target_pixels(target, spark), "m", vector.to_utm)


@query("SELECT r_name AS region, r_regionkey + 1 AS side, CAST((r_regionkey + 1) * (r_regionkey + 1) AS BIGINT) AS pixels FROM region WHERE r_name = 'EUROPE'")
def shapefile_area(spark, d):
    """A shapefile of all regions, of which exactly one is taken by an attribute and drawn on a grid."""
    kept = store(spark, "shapefile_area")
    rows = []
    for r in table(spark, d, "region").collect():  # five rows at every size
        n = r["r_regionkey"] + 1.0
        rows.append(({"NAME": r["r_name"], "SIDE": str(r["r_regionkey"] + 1)}, [[(0.0, 0.0), (0.0, n), (n, n), (n, 0.0), (0.0, 0.0)]]))
    shp, dbf = shapefile.encode(rows)
    kept.put(f"{kept.root}/mesh/regions.shp", shp)
    kept.put(f"{kept.root}/mesh/regions.dbf", dbf)
    features = shapefile.read_shapefile(spark, f"{kept.root}/mesh")
    one = vector.exactly_one(features, F.col("attributes")["NAME"] == "EUROPE").select(F.col("attributes")["NAME"].alias("region"), F.col("attributes")["SIDE"].cast("int").alias("side"), "rings")
    return vector.rasterize(one, ["region", "side"], 0.0, 10.0, 1.0, 10, 10).groupBy("region", "side").agg(F.count("*").alias("pixels"))


def _streamed(spark: SparkSession, name: str, rows: DataFrame, scores: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a stream over two files holds when all of them have arrived, a file a trigger."""
    kept = store(spark, name)
    path = kept.write_table("rows", rows.repartition(2), {"columns": rows.columns})
    arriving = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    view = f"{name}_{uuid.uuid4().hex}"
    sink = scores(arriving).writeStream.outputMode("complete").format("memory").queryName(view)
    sink.option("checkpointLocation", f"{kept.root}/{view}").trigger(availableNow=True).start().awaitTermination()
    return spark.table(view)


@query(Q._counts_sql("fold"))
def streaming_scores(spark, d):
    """Scores by fold over predictions that arrive in batches: those of all of them at once."""
    rows = px(spark, d).select("fold", "b2", "b3")
    return rounded(_streamed(spark, "streaming_scores", rows, lambda s: metrics.streaming_scores(s, S.positive(F.col("b2") * 10), F.col("b3") > 0, ("fold",))))


@query(
    "WITH c AS (SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(*) FILTER (value < 20 AND event_type = 'view') AS tp, "
    "count(*) FILTER (value < 20 AND event_type <> 'view') AS fp, count(*) FILTER (value >= 20 AND event_type = 'view') AS fn FROM events GROUP BY 1) "
    "SELECT day, tp, fp, fn, round(coalesce(tp / nullif(tp + fp + fn, 0)::DOUBLE, 1.0), 6) + 0.0 AS iou FROM c"
)
def streaming_windows(spark, d):
    """Scores of tumbling days, with a watermark that keeps all of them."""
    # Whole days since 1970 in whatever time zone the session has.
    seconds = F.expr("timestampdiff(SECOND, timestamp_ntz '1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))")
    rows = table(spark, d, "events").select(F.timestamp_seconds(seconds).alias("ts"), "value", "event_type")
    scores = lambda s: metrics.windowed_scores(s, F.col("value") < 20, F.col("event_type") == "view", "ts", "1 day", "400 days")
    found = _streamed(spark, "streaming_windows", rows, scores)
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.unix_seconds("window.start") / 86_400).cast("int"))
    return rounded(found.select(day.cast("string").alias("day"), "tp", "fp", "fn", "iou"))


GUARDS = (
    "an empty source", "too few points", "no feature", "several features", "an empty fold", "distinct grids", "a singular transform", "no weights", "an unknown mask kind", "an unknown move", "one mask",
    "a mask with a 2", "settings without keys", "a chosen source that is off", "a missing table", "an unknown resampling", "a nested folder", "an unknown chosen source", "a year without source", "no TIFF file", "no shapefile",
)


@query(" UNION ALL ".join(f"SELECT '{g}' AS guard, true AS raised" for g in GUARDS))
def guards(spark, d):
    """What must be an error is one."""
    region = table(spark, d, "region")
    own, other = grid.Grid(4, 4, 10, 0, 0, 0, -10, 40), grid.Grid(4, 4, 10, 0, 5, 0, -10, 40)
    col = F.col("r_regionkey")
    points = region.select(col.cast("double").alias("x"), col.cast("double").alias("y"))
    off = json.dumps({"region": "r", "chosen": "a", "sources": [{"name": "a", "kind": "class", "value": 1, "year": 2018, "enabled": False}]})
    actions = (
        lambda: readers.require_rows(region.where("false"), "region"),
        lambda: folds.distributed_kmeans(points, 9, 1),
        lambda: vector.exactly_one(region, F.col("r_name") == "NOWHERE"),
        lambda: vector.exactly_one(region, col >= 0),
        lambda: folds.split(patch_view(spark, d), 99),
        lambda: grid.require_same(own, other),
        lambda: grid.Grid(4, 4, 0, 0, 0, 0, 0, 0).place(col, col),
        lambda: evaluate.total_loss(col, col, col, (0, 0, 0)),
        lambda: masks.source_mask(col, Source("a", "unheard", None, None)),
        lambda: patches.moved(4, 4, "sideways"),
        lambda: agreement.all_pairs(region, {"a": col > 0}),
        lambda: report.verify_mask(region, "r_regionkey", own).collect(),
        lambda: Settings.load("{}"),
        lambda: Settings.load(off).chosen_source(),
        lambda: store(spark, "guards").read_table("nowhere"),
        lambda: report.export_resampling("cubic-ish", "folder"),
        lambda: report.export_resampling("nearest", "a/b"),
        lambda: report.decision_record({"sources": [], "pairs": {}}, "x", Q.SETTINGS),
        lambda: report.composite_and_mask(Q.SETTINGS, 1999),
        lambda: geotiff.header(b"not a file"),
        lambda: list(shapefile.shapes(b"not a file")),
    )
    return rows_of(spark, "guard string, raised boolean", [(g, raised(a)) for g, a in zip(GUARDS, actions, strict=True)])
