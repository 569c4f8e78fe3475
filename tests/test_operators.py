"""Fixed cases of the operators, with worked results."""

import json
import math
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridsmith.functions import scalar as S
from gridsmith.operators import agreement, evaluate, folds, grid, masks, patches, report, stats, vector
from gridsmith.schemas import MANIFEST, Settings, Source
from gridsmith.sources import geotiff, shapefile

NAN, INF = float("nan"), float("inf")


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def square(spark, first, other, side=4):
    rows = [(r, c, (r, c) in first, (r, c) in other) for r in range(side) for c in range(side)]
    return spark.createDataFrame(rows, "row int, col int, a boolean, b boolean")


def test_agreement_of_two_masks(spark):
    r = agreement.pair_agreement(square(spark, {(0, 0), (0, 1)}, {(0, 1), (1, 0)}), F.col("a"), F.col("b")).first()
    assert (r.both, r.only_first, r.only_other, r.neither) == (1, 1, 1, 13)
    assert (r.overall_agreement, r.f1, r.precision, r.recall) == (0.875, 0.5, 0.5, 0.5)
    assert math.isclose(r.iou, 1 / 3) and math.isclose(r.kappa, 3 / 7)
    assert math.isclose(r.f1, 2 * r.iou / (1 + r.iou))


def test_agreement_is_null_where_undefined(spark):
    r = agreement.pair_agreement(square(spark, set(), set()), F.col("a"), F.col("b")).first()
    assert r.overall_agreement == 1.0 and r.iou is r.f1 is r.precision is r.recall is r.kappa is None
    r = agreement.pair_agreement(square(spark, set(), set()).limit(0), F.col("a"), F.col("b")).first()
    assert r.overall_agreement is None and r.kappa is None


def test_pairs_keep_the_masks_order_and_one_scan(spark):
    frame = square(spark, {(0, 0)}, {(0, 1)}).withColumn("c", F.lit(False))
    pairs = agreement.all_pairs(frame, {"z": F.col("a"), "m": F.col("b"), "a": F.col("c")})
    assert [(r["first"], r["other"]) for r in pairs.orderBy("pair").collect()] == [("z", "m"), ("z", "a"), ("m", "a")]
    assert "Join" not in pairs._jdf.queryExecution().executedPlan().toString()
    assert agreement.decision(pairs, "m").count() == 2
    with pytest.raises(ValueError):
        agreement.all_pairs(frame, {"z": F.col("a")})


def test_long_masks_become_columns(spark):
    long = spark.createDataFrame([("x", 2018, 0, 0, True), ("y", 2018, 0, 0, False), ("x", 2018, 0, 1, False)], "source string, year int, row int, col int, m boolean")
    rows = {(r.row, r.col): (r.x, r.y) for r in agreement.to_columns(long, ["x", "y"]).collect()}
    assert rows == {(0, 0): (True, False), (0, 1): (False, False)}


def test_labels_and_areas(spark):
    frame = square(spark, {(0, 0), (1, 0)}, {(0, 1), (1, 0)}, 2)
    got = {(r.row, r.col): r.v for r in frame.select("row", "col", S.agreement_label(F.col("a"), F.col("b")).alias("v")).collect()}
    assert got == {(0, 0): 2, (0, 1): 3, (1, 0): 1, (1, 1): 0}
    area = masks.area_share(square(spark, {(0, 0), (0, 1)}, set()), {"a": F.col("a")}, 10).first()
    assert (area.pixels, area.area_km2, area.share_of_grid) == (2, 2e-4, 0.125)


def test_reflectance_and_z_scores(spark):
    rows = spark.createDataFrame([(v,) for v in (0.0, 5000.0, 10000.0, 20000.0, -1000.0, NAN, None)], "x double").select(S.reflectance(F.col("x")).alias("y")).collect()
    values = [r.y for r in rows]
    assert values[:5] == [0.0, 0.5, 1.0, 1.0, 0.0] and math.isnan(values[5]) and values[6] is None
    z = lambda x, m, s: one(spark, z=S.z_score(F.lit(x).cast("double"), F.lit(m).cast("double"), F.lit(s).cast("double"))).z
    assert [z(100.0, 100.0, 10.0), z(NAN, 100.0, 10.0), z(120.0, 100.0, 10.0), z(5.0, 10.0, 2.0)] == [0, 0, 2, -2.5]
    assert z(5.0, None, 1.0) == z(5.0, 1.0, None) == z(5.0, 1.0, 0.0) == z(None, 3.0, 1.0) == z(INF, 3.0, 1.0) == 0


def test_ids_bounds_and_names(spark):
    t = {"a": 10.0, "b": 0.0, "c": 300000.0, "d": 0.0, "e": -10.0, "f": 7780000.0}
    r = one(spark, i=S.patch_id(F.lit("tile_310044_2023"), F.lit(3), F.lit(7)), long=S.patch_id(F.lit("t"), F.lit(12345), F.lit(0)), b=S.bounds_text(S.patch_bounds(t, F.lit(1), F.lit(2), 2)), c=S.text_centroid(F.lit("100,200,300,400")))
    assert r.i == "tile_310044_2023_r0003_c0007" and r.long == "t_r12345_c0000"
    assert r.b == "300020.00,7779970.00,300040.00,7779990.00" and tuple(r.c) == (200.0, 300.0)
    assert S.grid_dims(4, 4, 2) == (2, 2) and S.grid_dims(5, 7, 2) == (2, 3)
    assert S.mask_name("mapbiomas", "310044", 2025) == "mask_mapbiomas_310044_2025"
    assert S.mask_name("p", "r", 2024, 0.28) != S.mask_name("p", "r", 2024, 0.29)
    assert S.composite_name("310044", 2018) == "composite_310044_2018"
    assert S.fingerprint({"a": 1, "b": "é"}) == S.fingerprint({"b": "é", "a": 1}) and len(S.fingerprint({})) == 12


def test_paths_and_years(spark):
    r = one(spark, rel=S.relative_path(F.lit("/r/"), F.lit("/r/a/b")), out=S.relative_path(F.lit("/r"), F.lit("/rx/a")), full=S.absolute_path(F.lit("/r"), F.lit("a/b")), y=S.source_year(F.lit(None), F.lit("2018-01-01")), z=S.source_year(F.lit(2024), F.lit("2018-01-01")), s=S.year_dates(F.lit(2020))[1])
    assert (r.rel, r.out, r.full, r.y, r.z, str(r.s)) == ("a/b", "/rx/a", "/r/a/b", 2018, 2024, "2020-12-31")


def test_settings():
    s = Settings()
    assert s.chosen_source().name == "emater" and s.years() == [2018, 2024, 2025]
    with pytest.raises(ValueError):
        Settings(chosen="none").chosen_source()
    with pytest.raises(ValueError):
        Settings(sources=(Source("emater", "vector", None, 2018, False),)).chosen_source()
    with pytest.raises(ValueError):
        Settings(patch_size=0)


def test_masks_builders_and_clouds(spark):
    rows = spark.createDataFrame([(46, 0.28, 1.0, 0), (3, 0.2799, 0.0, 1024), (None, None, None, 4096)], "k int, p double, v double, qa int")
    got = rows.select(masks.source_mask(F.col("k"), Source("a", "class", 46, 1)).alias("a"), masks.source_mask(F.col("p"), Source("b", "threshold", 0.28, 1)).alias("b"), masks.source_mask(F.col("v"), Source("c", "vector", None, 1)).alias("c")).collect()
    assert [tuple(r) for r in got] == [(True, True, True), (False, False, False), (False, False, False)]
    assert [r.p for r in masks.mask_clouds(rows, ["p"], 3072).collect()] == [0.28, None, None]
    with pytest.raises(ValueError):
        masks.source_mask(F.col("k"), Source("d", "other", None, 1))


def test_composites(spark):
    rows = spark.createDataFrame([(1, 1, 1.0), (1, 2, 2.0), (1, 3, 3.0), (1, 4, 10.0), (2, 1, 5.0), (2, 2, None), (3, 1, None)], "px int, t int, v double")
    assert {r.px: r.v for r in masks.median_composite(rows, ["px"], ["v"]).collect()} == {1: 2.5, 2: 5.0, 3: None}
    assert {r.px: r.v for r in masks.latest_mosaic(rows, ["px"], ["v"], ["t"]).collect()} == {1: 10.0, 2: 5.0, 3: None}
    clipped = masks.clip(rows.select("px", F.lit(True).alias("m")), rows.where("px = 1").select("px"), ["px"])
    assert {(r.px, r.m) for r in clipped.collect()} == {(1, True), (2, False), (3, False)}


def test_nearest_fills_outside(spark):
    src, ref = grid.Grid(2, 2, 10, 0, 0, 0, -10, 30), grid.Grid(3, 3, 10, 0, 0, 0, -10, 30)
    own = spark.createDataFrame([(0, 0, 1), (0, 1, 0), (1, 0, 0), (1, 1, 0)], "row int, col int, m int")
    got = {(r.row, r.col): r.m for r in grid.nearest(own, src, ref, grid.target_pixels(ref, spark), "m").collect()}
    assert len(got) == 9 and got[0, 0] == 1 and sum(got.values()) == 1
    assert grid.nearest(own, src, src, own, "m").count() == 4
    with pytest.raises(ValueError):
        grid.require_same(src, ref)


def test_bilinear_is_linear_inside_and_nan_outside(spark):
    src, ref = grid.Grid(4, 4, 10, 0, 0, 0, -10, 40), grid.Grid(4, 4, 10, 0, 2.5, 0, -10, 35)
    own = spark.createDataFrame([(r, c, 100.0 * r + c) for r in range(4) for c in range(4)], "row int, col int, v double")
    got = {(r.row, r.col): r.v for r in grid.bilinear(own, src, ref, grid.target_pixels(ref, spark), "v").collect()}
    for r in range(3):
        for c in range(3):
            assert math.isclose(got[r, c], 100 * (r + 0.5) + c + 0.25)
    assert math.isnan(got[3, 0]) and math.isnan(got[0, 3])


def test_polygons(spark):
    sq = [[(200100.0, 200100.0), (200900.0, 200100.0), (200900.0, 200900.0), (200100.0, 200900.0)]]
    hole = sq + [[(200300.0, 200300.0), (200500.0, 200300.0), (200500.0, 200500.0), (200300.0, 200500.0)]]
    shapes = spark.createDataFrame([("one", sq), ("hole", hole), ("none", [])], "name string, rings array<array<struct<x:double,y:double>>>")
    got = {r["name"]: r["count"] for r in vector.rasterize(shapes, ["name"], 200000.0, 201000.0, 10.0, 100, 100).groupBy("name").count().collect()}
    assert got == {"one": 6400, "hole": 6000}
    assert vector.exactly_one(shapes, F.col("name") == "one").count() == 1
    for wrong in ("x", "%"):
        with pytest.raises(ValueError):
            vector.exactly_one(shapes, F.col("name").like(wrong))


def test_projection(spark):
    e, n = vector.to_utm(F.col("lon"), F.col("lat"))
    rows = spark.createDataFrame([(-45.0, 0.0), (-46.3, -21.5), (-43.0, -20.0)], "lon double, lat double").withColumns({"e": e, "n": n})
    lon, lat = vector.to_degrees(F.col("e"), F.col("n"))
    got = rows.withColumns({"x": lon, "y": lat}).collect()
    assert math.isclose(got[0].e, 500000) and math.isclose(got[0].n, 10000000)
    for r in got:
        assert abs(r.x - r.lon) < 1e-9 and abs(r.y - r.lat) < 1e-9
    # A degree of latitude on the central meridian at the equator is 110574.4 m long, times 0.9996.
    one_degree = spark.range(1).select(vector.to_utm(F.lit(-45.0), F.lit(1.0))[1].alias("n")).first().n - 1e7
    assert abs(one_degree - 110574.3886 * 0.9996) < 0.01


def test_patches(spark):
    mask = square(spark, {(0, 0), (0, 1)}, set()).select("row", "col", F.col("a").cast("int").alias("m"))
    assert patches.patch_ratios(mask, 2, 4, 4).count() == 4
    kept = patches.patch_ratios(mask, 2, 4, 4, 0.5)
    assert [tuple(r) for r in kept.collect()] == [(0, 0, 0.5)]
    assert patches.patch_pixels(mask, kept, 2, 4, 4).count() == 4
    t = {"a": 10.0, "b": 0.0, "c": 0.0, "d": 0.0, "e": -10.0, "f": 4.0}
    rows = {(r.row, r.col): r for r in patches.manifest(patches.patch_ratios(mask, 2, 4, 4), "composite_310044_2018", "emater", t, 2).collect()}
    assert rows[1, 1].bbox == "20.00,-36.00,40.00,-16.00" and rows[1, 1].bbox_index_offset == "10.00,-26.00,30.00,-6.00"
    assert rows[0, 0].bbox == "0.00,-16.00,20.00,4.00" and rows[0, 0].fold is None
    assert list(rows[0, 0].asDict())[:10] == [c.split()[0] for c in MANIFEST.split(", ")]


def test_flips_and_turns_undo(spark):
    frame = square(spark, {(0, 1)}, set())
    for how, times in (("hflip", 2), ("vflip", 2), ("rot90", 4), ("rot180", 2)):
        out = frame
        for _ in range(times):
            out = patches.augment(out, 4, 4, how)
        assert [(r.row, r.col) for r in out.where("a").collect()] == [(0, 1)]
    turned = patches.augment(frame, 4, 4, "rot90").where("a").first()
    grid_ = np.zeros((4, 4))
    grid_[0, 1] = 1
    assert (turned.row, turned.col) == tuple(np.argwhere(np.rot90(grid_))[0])
    with pytest.raises(ValueError):
        patches.augment(frame, 4, 4, "twist")


def test_folds(spark):
    west, east = [(1000, 1000), (1200, 1000), (1100, 1200)], [(90000, 90000), (92000, 90000), (91000, 92000)]
    placed = lambda points: spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(points)], "patch_id int, x double, y double")
    labels = lambda points, k: [r.fold for r in folds.assign_folds(placed(points), k, 42).orderBy("patch_id").collect()]
    assert labels(west + east, 2) == [0, 0, 0, 1, 1, 1]
    assert labels(east + west, 2) == [1, 1, 1, 0, 0, 0]
    with pytest.raises(ValueError):
        labels(west, 5)
    assert len(set(labels([(1, 1)] * 4, 2))) == 1
    rows = spark.createDataFrame([(r * 5 + c, r, c, c * 512.0, r * 512.0, 0.1 + 0.01 * (r + c)) for r in range(8) for c in range(5)], "patch_id long, row int, col int, x double, y double, coffee_ratio double")
    dealt = folds.assign_folds(rows, 5, 42)
    report = folds.fold_report(dealt, 5).collect()
    assert sum(r.n for r in report) == 40 and len(report) == 5 and min(r.n for r in report) > 0
    train, held = folds.split(dealt, 0)
    assert train.count() + held.count() == 40
    with pytest.raises(ValueError):
        folds.split(dealt, 9)
    sizes = [r["count"] for r in folds.batches(dealt, 16, 42, "patch_id", ["tile"] if "tile" in dealt.columns else ["fold"]).groupBy("fold", "batch").count().collect()]
    assert sum(sizes) == 40 and max(sizes) <= 16
    centres = folds.distributed_kmeans(spark.createDataFrame([(float(x), float(y)) for x, y in west + east], "x double, y double"), 2, 42)
    assert centres[0][0] < 2000 < 80000 < centres[1][0]


def test_folds_of_large_tables_with_a_hot_point_are_those_of_all_points(spark):
    points = [(float(512 * i), float(512 * (i % 3))) for i in range(12)]
    frame = spark.createDataFrame([(i, i, 0, *p) for i, p in enumerate(points)], "patch_id long, row int, col int, x double, y double")
    hot = frame.orderBy(F.xxhash64("x", "y")).limit(1)
    more = frame.unionByName(hot.crossJoin(spark.range(200_001)).drop("id"))
    dealt = folds.assign_folds(more, 4, 42)
    by_point = {(r.x, r.y): r.fold for r in dealt.select("x", "y", "fold").distinct().collect()}
    assert len(by_point) == 12 and set(by_point.values()) == {0, 1, 2, 3} and dealt.count() == 200_013
    again = folds.assign_folds(more.repartition(7), 4, 42).select("x", "y", "fold").distinct().collect()
    assert {(r.x, r.y): r.fold for r in again} == by_point


def test_band_statistics(spark):
    rows = spark.createDataFrame([(1.0, None), (3.0, None), (NAN, None), (INF, None)], "p double, q double")
    got = {r.band: r for r in stats.band_stats(rows, ["p", "q"]).collect()}
    assert (got["p"].mean, got["p"].std, got["p"].n_finite, got["p"].nan_fraction) == (2.0, 1.0, 2, 0.5)
    assert (got["q"].mean, got["q"].std, got["q"].nan_fraction) == (None, None, 1.0)
    r = {x.band: x for x in stats.value_ranges(rows, ["p", "q"]).collect()}["p"]
    assert (r.min_value, r.max_value, r.n_nan, r.n_inf) == (1.0, 3.0, 1, 1)


@pytest.mark.parametrize("values", [[5.0], [1.0] * 50 + [2.0] * 50, list(np.random.default_rng(1).normal(size=997)), [7.0] * 300 + list(range(20))])
def test_percentiles_are_exact_even_when_narrowed(spark, values):
    rows = spark.createDataFrame([(float(v),) for v in [*values, NAN, INF]], "x double")
    shares = (0.0, 0.02, 0.5, 0.98, 1.0)
    got = stats.percentiles(rows, F.col("x"), shares, gather=10)
    assert np.allclose(got, np.percentile(values, [100 * s for s in shares]))
    assert stats.percentiles(rows.where("x = 1e9"), F.col("x"), (0.5,)) == [None]


def test_stretch_and_histogram(spark):
    rows = spark.createDataFrame([(0.0,), (5.0,), (10.0,), (20.0,), (-5.0,), (NAN,), (INF,)], "x double")
    assert [r.x for r in stats.stretched(rows, "x", 0, 10).collect()] == [0, 127, 255, 255, 0, 0, 0]
    assert [r.x for r in stats.stretched(rows, "x", 5, 5).collect()][:4] == [0, 0, 255, 255]
    counts, _ = np.histogram([0, 5, 10, 20, -5], 4, (-5, 20))
    got = sorted((r.bin, r.n) for r in stats.histogram(rows, F.col("x"), 4, F.lit(-5.0), F.lit(20.0)).collect())
    assert [n for _, n in got] == counts.tolist()


def test_sanity(spark):
    rows = spark.createDataFrame([(2, None, NAN), (1, 0, 1.0)], "m int, f int, v double")
    assert len(stats.sanity_issues(rows, "m", "f", "v", 5).first().issues) == 4
    assert stats.sanity_issues(rows.limit(0), "m", "f", "v", 0).first().issues == ["no rows"]


def test_scores(spark):
    frame = spark.createDataFrame([(True, True), (True, False), (False, True), (False, False)], "p boolean, t boolean")
    r = evaluate.with_scores(evaluate.counts(frame, F.col("p"), F.col("t"))).first()
    assert (r.tp, r.fp, r.fn) == (1, 1, 1) and math.isclose(r.iou, 1 / 3)
    r = evaluate.with_scores(evaluate.counts(frame.where("NOT p AND NOT t"), F.col("p"), F.col("t"))).first()
    assert (r.iou, r.precision, r.recall, r.f1) == (1.0, 1.0, 1.0, 1.0)
    batches = spark.createDataFrame([(2, 1, 1), (1, 0, 0)], "tp long, fp long, fn long")
    r = evaluate.with_scores(evaluate.added(batches)).first()
    assert (r.iou, r.f1) == (0.6, 0.75)
    logits = spark.createDataFrame([(-1.0, False), (1.0, True), (0.0, True)], "x double, t boolean")
    assert tuple(evaluate.counts(logits, S.positive(F.col("x")), F.col("t")).first()) == (2, 0, 0)


def test_losses(spark):
    good = spark.createDataFrame([(5.0, 1), (-5.0, 0), (5.0, 1), (-5.0, 0)], "x double, t int")
    d, f = good.agg(evaluate.dice_loss(F.col("x"), F.col("t")).alias("d"), evaluate.focal_loss(F.col("x"), F.col("t")).alias("f")).first()
    assert d < 0.01 and f < 0.01
    total = good.agg(evaluate.total_loss(evaluate.dice_loss(F.col("x"), F.col("t")), evaluate.focal_loss(F.col("x"), F.col("t")), F.raise_error(F.lit("never")), (1, 2, 0)).alias("v")).first().v
    assert math.isclose(total, (d + 2 * f) / 3)
    with pytest.raises(ValueError):
        evaluate.total_loss(F.lit(0), F.lit(0), F.lit(0), (0, 0, 0))
    assert good.agg(evaluate.boundary_loss(F.col("x"), F.lit(0.0)).alias("v")).first().v == 0.0


def test_signed_distances():
    m = np.zeros((3, 3), bool)
    m[:2, :2] = True
    s = evaluate.signed_distance(m)
    assert s[1, 1] < 0 < s[2, 2] and not evaluate.signed_distance(np.ones((2, 2), bool)).any()
    m = np.random.default_rng(3).random((13, 9)) > 0.7
    at = np.argwhere(np.ones_like(m))
    for (r, c), v in zip(at, evaluate.signed_distance(m).ravel(), strict=True):
        near = min(math.dist((r, c), p) for p in at if m[tuple(p)] != m[r, c])
        assert math.isclose(abs(v), near) and (v < 0) == m[r, c]


def test_best_epoch_takes_the_earliest(spark):
    rows = spark.createDataFrame([(0, 1, 0.5), (0, 2, 0.7), (0, 3, 0.7), (1, 1, 0.1)], "fold int, epoch int, val_iou double")
    assert {r.fold: r.epoch for r in evaluate.best_epochs(rows, ["fold"]).collect()} == {0: 2, 1: 1}


def test_store_and_readers(spark, tmp_path):
    from gridsmith.sources import readers
    from gridsmith.sources.store import Store

    store = Store(spark, f"file://{tmp_path}")
    rows = spark.createDataFrame([(1, None)], "row int, fold int")
    assert not store.current("manifest", {"v": 1})
    assert store.ensure("manifest", {"v": 1}, lambda: rows).count() == 1
    table = store.read_table("manifest")
    store.write_table("manifest", table.withColumn("fold", F.lit(3)), {"v": 2})
    assert store.read_table("manifest").first().fold == 3 and store.current("manifest", {"v": 2}) and not store.current("manifest", {"v": 1})
    store.put(f"{store.root}/manifest/current.json", "{broken")
    assert store.pointer("manifest") is None
    with pytest.raises(FileNotFoundError):
        store.require("manifest", "stats")
    np.save(tmp_path / "p.npy", np.arange(6, dtype="float32").reshape(1, 2, 3))
    r = readers.read_arrays(spark, str(tmp_path / "p.npy")).first()
    assert (r.shape, r.dtype, r["values"]) == ([1, 2, 3], "float32", [0, 1, 2, 3, 4, 5])
    for name, kind, coordinates in (("Data - Um.json", "Polygon", [[[0, 0], [1, 0], [1, 1]]]), ("Data - Dois.json", "MultiPolygon", [[[[0, 0], [1, 0], [1, 1]]], [[[5, 5], [6, 5], [6, 6]]]])):
        (tmp_path / name).write_text(json.dumps({"features": [{"properties": {"variedade": "x", "area": 1.5}, "geometry": {"type": kind, "coordinates": coordinates}}]}))
    got = {x.municipio: len(x.rings) for x in readers.read_features(spark, str(tmp_path / "Data*.json")).collect()}
    assert got == {"Um": 1, "Dois": 2}
    (tmp_path / "r.json").write_text('{"a": 1}')
    assert readers.read_json_report(spark, str(tmp_path / "r.json")) == {"a": 1} and readers.read_json_report(spark, str(tmp_path / "no.json")) is None
    with pytest.raises(ValueError):
        readers.require_rows(rows.limit(0), "it")


def test_streamed_scores_equal_batch(spark, tmp_path):
    from gridsmith.streaming.metrics import streaming_scores

    rows = spark.createDataFrame([(i % 3 > 0, i % 2 > 0) for i in range(40)], "p boolean, t boolean")
    rows.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = streaming_scores(stream, F.col("p"), F.col("t")).writeStream.outputMode("complete").format("memory").queryName("scores").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("scores").first() == evaluate.with_scores(evaluate.counts(rows, F.col("p"), F.col("t"))).first()


def test_tiff_blocks_of_every_kind():
    rng = np.random.default_rng(3)
    pixels = rng.normal(size=(2, 70, 90)).astype("float32")
    own = grid.Grid(70, 90, 10.0, 0.0, 300000.0, 0.0, -10.0, 7780000.0)
    for block in (16, 64, 256):
        raster = geotiff.header(content := geotiff.encode(pixels, own, -1.0, block))
        out = np.zeros_like(pixels)
        for r, c, part in raster.blocks(content):
            out[:, r : r + part.shape[1], c : c + part.shape[2]] = part
        assert raster.grid == own and raster.nodata == -1.0 and (out == pixels).all()
    chunky = pixels.transpose(1, 2, 0)
    of = lambda kind, **tags: geotiff.Raster(own, 2, kind, None, {geotiff.COMPRESSION: (8,), **{getattr(geotiff, k): (v,) for k, v in tags.items()}}, "<")
    # Predictor 3: byte planes of a row, most significant first, as differences; predictor 2: differences of pixels.
    planes = np.ascontiguousarray(chunky.astype(">f4")).view("u1").reshape(70, 180, 4).transpose(0, 2, 1).reshape(70, -1, 2)
    raw = np.diff(planes, axis=1, prepend=np.zeros((70, 1, 2), "u1")).astype("u1").tobytes()
    assert (of("f4", PREDICTOR=3)._pixels(zlib.compress(raw), 70, 90, 2) == chunky).all()
    whole = rng.integers(0, 250, (70, 90, 2)).astype("u1")
    raw = np.diff(whole, axis=1, prepend=np.zeros((70, 1, 2), "u1")).astype("u1").tobytes()
    assert (of("u1", PREDICTOR=2)._pixels(zlib.compress(raw), 70, 90, 2) == whole).all()
    with pytest.raises(ValueError):
        geotiff.header(b"PNG and so on")
    with pytest.raises(ValueError):
        of("u1", COMPRESSION=5)._pixels(b"", 1, 1, 1)


def test_a_tiff_window_and_big_endian_strips(spark, tmp_path):
    pixels = np.arange(35 * 20, dtype=">u2").reshape(35, 20)
    strips = [pixels[r : r + 10].tobytes() for r in range(0, 35, 10)]
    fields = [(256, 3, [20]), (257, 3, [35]), (258, 3, [16]), (259, 3, [1]), (273, 4, None), (277, 3, [1]), (278, 3, [10]), (279, 4, [len(s) for s in strips]), (33550, 12, [5.0, 5.0, 0.0]), (33922, 12, [0.0, 0.0, 0.0, 100.0, 900.0, 0.0])]
    at = 8 + 2 + 12 * len(fields) + 4
    starts, extra, entries = [], b"", b""
    sizes = sum(len(v or strips) * {3: 2, 4: 4, 12: 8}[t] for _, t, v in fields if len(v or strips) * {3: 2, 4: 4, 12: 8}[t] > 4)
    for s in strips:
        starts.append(at + sizes + sum(map(len, strips[: len(starts)])))
    for tag, t, v in fields:
        v = v or starts
        raw = struct.pack(f">{len(v)}{ {3: 'H', 4: 'I', 12: 'd'}[t]}", *v)
        entries += struct.pack(">HHI", tag, t, len(v)) + (raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack(">I", at + len(extra)))
        extra += raw if len(raw) > 4 else b""
    (tmp_path / "a.tif").write_bytes(b"MM" + struct.pack(">HI", 42, 8) + struct.pack(">H", len(fields)) + entries + struct.pack(">I", 0) + extra + b"".join(strips))
    rows = geotiff.read_geotiff(spark, str(tmp_path), ["v"], (8, 3, 5, 4)).collect()
    assert {(r.row, r.col): r.v for r in rows} == {(r, c): float(pixels[r, c]) for r in range(8, 13) for c in range(3, 7)}
    meta = geotiff.read_geotiff_meta(spark, str(tmp_path)).first()
    assert (meta.height, meta.width, meta.dtype, meta.transform.a, meta.transform.c, meta.transform.f, meta.crs) == (35, 20, "uint16", 5.0, 100.0, 900.0, "")


def test_verification_and_settings(spark):
    own = grid.Grid(2, 2, 10, 0, 0, 0, -10, 20)
    frame = spark.createDataFrame([(0, 0, float("nan"), 1), (0, 1, 3.0, 0), (1, 0, -2.0, 1), (1, 1, None, 1)], "row int, col int, b2 double, m int")
    facts = report.verify_composite(frame, own, grid.Grid(2, 2, 10, 0, 5, 0, -10, 20), ["b2"]).first()
    assert (facts.height, facts.width, facts.bands, facts.aligned_to_mask, facts.min_value, facts.max_value) == (2, 2, 1, False, -2.0, 3.0)
    none = report.verify_composite(frame.where("b2 IS NULL"), own, own, ["b2"]).first()
    assert (none.aligned_to_mask, none.min_value) == (True, None)
    assert report.verify_mask(frame, "m", own).first().area_km2 == 3 * 100 / 1e6
    with pytest.raises(Exception, match="not binary"):
        report.verify_mask(frame.withColumn("m", F.col("m") * 2), "m", own).collect()
    assert report.export_resampling("nearest", "out") is None and report.export_resampling("bilinear", "out") == "bilinear"
    assert report.preview_grid(0, 0, 4, 3, 1024).height == 768 and report.preview_grid(0, 0, 3, 1.0001, 1024).height == 342
    assert report.seed_all(3).integers(100) == np.random.default_rng(3).integers(100)
    with pytest.raises(ValueError, match="missing"):
        Settings.load('{"region": "x"}')


def test_shapes_and_attributes_of_a_shapefile(spark, tmp_path):
    ring = lambda a, b: [(a, a), (a, b), (b, b), (b, a), (a, a)]
    rows = [({"NM": "Três Pontas", "CD": "1"}, [ring(0.0, 9.0), ring(3.0, 4.0)]), ({"NM": "b", "CD": "22"}, []), ({"NM": "", "CD": "3"}, [ring(1.5, 2.0)])]
    shp, dbf = shapefile.encode(rows)
    assert list(shapefile.shapes(shp)) == [r for _, r in rows] and list(shapefile.records(dbf)) == [a for a, _ in rows]
    (tmp_path / "one.shp").write_bytes(shp)
    (tmp_path / "one.dbf").write_bytes(dbf)
    (tmp_path / "bare.shp").write_bytes(shapefile.encode(rows[:1])[0])
    got = shapefile.read_shapefile(spark, str(tmp_path)).collect()
    assert sorted((r.name, r.attributes.get("NM"), len(r.rings)) for r in got if r.name == "one") == [("one", "", 1), ("one", "Três Pontas", 2), ("one", "b", 0)]
    assert [len(r.rings) for r in got if r.name == "bare"] == [2]
    with pytest.raises(ValueError):
        list(shapefile.shapes(b"\0" * 200))
