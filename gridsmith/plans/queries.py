"""The engine's operators over the driver's tables: QUERIES by name, and SQL with the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridsmith.functions import scalar as S
from gridsmith.operators import agreement, evaluate, folds, grid, masks, patches, stats, vector
from gridsmith.plans.registry import QUERIES, SQL, query, rounded
from gridsmith.plans.views import PATCHES_SQL, PER_ROW, PX_SQL, SIDE, px, table
from gridsmith.plans.views import patches as patch_view
from gridsmith.schemas import BANDS, Settings

SETTINGS = Settings()
THRESHOLDS = (0.02, 0.03, 0.04, 0.05, 0.06, 0.08, 0.1)
AFFINE = {"a": 10.0, "b": 0.0, "c": 300000.0, "d": 0.0, "e": -10.0, "f": 7780000.0}
CENTRES = ((2560.0, 1024.0), (5120.0, 4096.0), (8192.0, 2048.0), (11264.0, 5120.0), (14336.0, 1024.0))
LI = {"b2": "l_quantity", "b3": "l_extendedprice", "b4": "l_discount", "b8": "l_tax"}


def _metrics_sql() -> str:
    b, f, o, z = (f'CAST("{c}" AS DOUBLE)' for c in agreement.CELLS)
    total = f"({b} + {f} + {o} + {z})"
    chance = f"((({b} + {f}) * ({b} + {o}) + ({o} + {z}) * ({f} + {z})) / nullif({total} * {total}, 0))"
    overall = f"(({b} + {z}) / nullif({total}, 0))"
    r = lambda x: f"round({x}, 6) + 0.0"
    return (
        f'"both", only_first, only_other, neither, {r(overall)} AS overall_agreement, {r(f"{b} / nullif({b} + {f} + {o}, 0)")} AS iou, {r(f"2 * {b} / nullif(2 * {b} + {f} + {o}, 0)")} AS f1, '
        f"{r(f'{b} / nullif({b} + {f}, 0)')} AS precision, {r(f'{b} / nullif({b} + {o}, 0)')} AS recall, {r(f'({overall} - {chance}) / nullif(1 - {chance}, 0)')} AS kappa"
    )


def _cells_sql(a: str, b: str) -> str:
    return f"count(*) FILTER ({a} AND {b}) AS \"both\", count(*) FILTER ({a} AND NOT {b}) AS only_first, count(*) FILTER (NOT {a} AND {b}) AS only_other, count(*) FILTER (NOT {a} AND NOT {b}) AS neither"


@query(f"SELECT {_metrics_sql()} FROM (SELECT {_cells_sql('quality = 1', 'toxic = 1')} FROM labels)")
def mask_agreement_pair(spark, d):
    return rounded(agreement.pair_agreement(table(spark, d, "labels"), F.col("quality") == 1, F.col("toxic") == 1))


@query(
    f"WITH {PX_SQL}, c AS ("
    + " UNION ALL ".join(f"SELECT CAST({k} AS INTEGER) AS pair, '{n}' AS first, '{m}' AS other, {_cells_sql(f'{x} > 0', f'{y} > 0')} FROM px" for k, (n, x, m, y) in enumerate((("a", "b2", "b", "b3"), ("a", "b2", "c", "b4"), ("b", "b3", "c", "b4"))))
    + f") SELECT pair, first, other, {_metrics_sql()} FROM c"
)
def mask_agreement_all_pairs(spark, d):
    return rounded(agreement.all_pairs(px(spark, d), {"a": F.col("b2") > 0, "b": F.col("b3") > 0, "c": F.col("b4") > 0}))


@query(
    f"WITH {PX_SQL} SELECT CAST(CASE WHEN b2 > 0 AND b3 > 0 THEN 1 WHEN b2 > 0 THEN 2 WHEN b3 > 0 THEN 3 ELSE 0 END AS INTEGER) AS label, count(*) AS n "
    f"FROM px GROUP BY 1"
)
def agreement_label_counts(spark, d):
    return px(spark, d).groupBy(S.agreement_label(F.col("b2") > 0, F.col("b3") > 0).alias("label")).agg(F.count("*").alias("n"))


@query(
    f"WITH {PX_SQL}, t AS (SELECT count(*) AS total, count(*) FILTER (b8 > -0.1) AS aoi, count(*) FILTER (b2 > 0) AS a, count(*) FILTER (b3 > 0) AS b, "
    f"count(*) FILTER (b4 > 0) AS c FROM px), "
    "u AS (SELECT 'a' AS source, a AS pixels, total, aoi FROM t UNION ALL SELECT 'b', b, total, aoi FROM t UNION ALL SELECT 'c', c, total, aoi FROM t) "
    "SELECT source, pixels, round(pixels * 100.0::DOUBLE / 1e6, 6) + 0.0 AS area_km2, "
    "round(pixels / nullif(total, 0)::DOUBLE, 6) + 0.0 AS share_of_grid, round(pixels / nullif(aoi, 0)::DOUBLE, 6) + 0.0 AS share_of_aoi FROM u"
)
def mask_area_share(spark, d):
    return rounded(masks.area_share(px(spark, d), {"a": F.col("b2") > 0, "b": F.col("b3") > 0, "c": F.col("b4") > 0}, SETTINGS.scale_m, F.col("b8") > -0.1))


@query("WITH a AS (SELECT doc_id FROM labels WHERE quality = 1), b AS (SELECT doc_id FROM labels WHERE toxic = 1) SELECT (SELECT count(*) FROM (FROM a INTERSECT FROM b)) AS \"both\", (SELECT count(*) FROM (FROM a EXCEPT FROM b)) AS only_first, (SELECT count(*) FROM (FROM b EXCEPT FROM a)) AS only_other")
def mask_setop_crosscheck(spark, d):
    labels = table(spark, d, "labels")
    a, b = labels.where("quality = 1").select("doc_id"), labels.where("toxic = 1").select("doc_id")
    parts = (("both", a.intersect(b)), ("only_first", a.subtract(b)), ("only_other", b.subtract(a)))
    tagged = [x.agg(F.count("*").alias("n")).withColumn("part", F.lit(name)) for name, x in parts]
    return tagged[0].unionByName(tagged[1]).unionByName(tagged[2]).agg(*[F.max(F.when(F.col("part") == n, F.col("n"))).alias(n) for n, _ in parts])


@query("SELECT l_returnflag AS region, count(*) FILTER (l_linenumber = 4) AS n_class, count(*) AS n_total FROM lineitem GROUP BY 1")
def class_mask(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("region")).agg(F.count_if(masks.class_mask(F.col("l_linenumber"), 4)).alias("n_class"), F.count("*").alias("n_total"))


@query("SELECT l_returnflag AS region, count(*) FILTER (l_discount >= 0.05::DOUBLE) AS n_mask, count(*) AS n_total FROM lineitem GROUP BY 1")
def threshold_mask(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("region")).agg(F.count_if(masks.threshold_mask(F.col("l_discount"), 0.05)).alias("n_mask"), F.count("*").alias("n_total"))


@query("SELECT t AS threshold, round(count(*) FILTER (l_discount >= t) / nullif(count(l_discount), 0)::DOUBLE, 6) + 0.0 AS share, round(count(*) FILTER (l_discount >= t) * 100.0::DOUBLE / 1e6, 2) + 0.0 AS area_km2 FROM lineitem, (SELECT unnest([" + ", ".join(f"{t}::DOUBLE" for t in THRESHOLDS) + "]) AS t) GROUP BY t")
def threshold_sweep(spark, d):
    return rounded(masks.threshold_sweep(table(spark, d, "lineitem"), F.col("l_discount"), THRESHOLDS, SETTINGS.scale_m))


@query(
    "SELECT event_type, count(*) AS n_total, count(*) FILTER (event_id & 3072 = 0) AS n_clear, "
    "round(avg(value) FILTER (event_id & 3072 = 0), 6) + 0.0 AS mean_clear FROM events GROUP BY 1"
)
def qa_bitmask_counts(spark, d):
    clear = masks.mask_clouds(table(spark, d, "events"), ["value"], SETTINGS.qa_bits, "event_id")
    return rounded(clear.groupBy("event_type").agg(F.count("*").alias("n_total"), F.count("value").alias("n_clear"), F.avg("value").alias("mean_clear")))


@query(
    "SELECT CAST(year(ts) AS INTEGER) AS year, CAST(month(ts) AS INTEGER) AS month, count(*) AS n_scenes FROM events WHERE ts >= TIMESTAMP '2024-01-03' "
    "AND ts < TIMESTAMP '2024-02-11' AND value < 20 AND event_type = 'view' GROUP BY 1, 2"
)
def scene_filter_counts(spark, d):
    e = table(spark, d, "events").where(masks.in_dates(F.col("ts"), "2024-01-03", "2024-02-10") & (F.col("value") < SETTINGS.cloud_below) & (F.col("event_type") == "view"))
    return e.groupBy(F.year("ts").alias("year"), F.month("ts").alias("month")).agg(F.count("*").alias("n_scenes"))


@query("SELECT user_id, round(median(value) FILTER (event_id & 3072 = 0), 6) + 0.0 AS value FROM events GROUP BY 1")
def median_composite(spark, d):
    clear = masks.mask_clouds(table(spark, d, "events"), ["value"], SETTINGS.qa_bits, "event_id")
    return rounded(masks.median_composite(clear, ["user_id"], ["value"]))


@query("SELECT user_id, round(arg_max(value, (ts, event_id)), 6) + 0.0 AS value FROM events WHERE value IS NOT NULL GROUP BY 1")
def latest_mosaic(spark, d):
    return rounded(masks.latest_mosaic(table(spark, d, "events"), ["user_id"], ["value"], ["ts", "event_id"]))


@query(
    "SELECT n_name AS municipio, count(c_custkey) AS n_customers FROM region JOIN nation ON n_regionkey = r_regionkey LEFT "
    "JOIN customer ON c_nationkey = n_nationkey WHERE r_name = 'EUROPE' GROUP BY 1"
)
def aoi_lookup(spark, d):
    aoi = vector.exactly_one(table(spark, d, "region"), F.col("r_name") == "EUROPE")
    inside = aoi.join(table(spark, d, "nation"), F.col("n_regionkey") == F.col("r_regionkey"))
    counted = table(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"))
    return inside.join(counted, F.col("c_nationkey") == F.col("n_nationkey"), "left").select(F.col("n_name").alias("municipio"), F.coalesce("n", F.lit(0)).alias("n_customers"))


@query(
    "SELECT c_nationkey AS feature, floor(min(c_acctbal) / 10) * 10 AS low, ceil(max(c_acctbal) / 10) * 10 AS high, "
    "CAST((ceil(max(c_acctbal) / 10) - floor(min(c_acctbal) / 10)) AS BIGINT) AS cells FROM customer GROUP BY 1"
)
def grid_snap(spark, d):
    bounds = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("feature")).agg(F.min("c_acctbal").alias("a"), F.max("c_acctbal").alias("b"))
    low, high = S.snap(F.col("a"), F.col("b"), SETTINGS.scale_m)
    return bounds.select("feature", low.cast("double").alias("low"), high.cast("double").alias("high"), ((high - low) / SETTINGS.scale_m).cast("long").alias("cells"))


@query("SELECT format('composite_310044_2018_r{:04d}_c{:04d}', vec_id // 32, vec_id % 32) AS patch_id FROM embeddings")
def patch_grid_ids(spark, d):
    """A raster as high as the table asks for, with a partial patch beyond its last row and column, which gives no id."""
    last = patch_view(spark, d).agg(F.max("row")).first()[0] or 0
    rows, cols = S.grid_dims((last + 1) * 512 + 100, PER_ROW * 512 + 511, 512)
    inside = patch_view(spark, d).where((F.col("row") < rows) & (F.col("col") < cols))
    return inside.select(S.patch_id(F.lit(S.composite_name(SETTINGS.region, 2018)), F.col("row"), F.col("col")).alias("patch_id"))


@query(f'WITH {PATCHES_SQL}, b AS (SELECT vec_id, 300000.0::DOUBLE + col * 5120 AS "left", 7780000.0::DOUBLE - row * 5120 AS top FROM patches) SELECT vec_id, "left", top - 5120 AS bottom, "left" + 5120 AS "right", top, "left" + 2560 AS x, top - 2560 AS y FROM b')
def patch_bbox(spark, d):
    size = SETTINGS.patch_size
    b = patch_view(spark, d).withColumn("b", S.patch_bounds(AFFINE, F.col("row") * size, F.col("col") * size, size))
    return b.select("vec_id", "b.*", S.bounds_centroid(F.col("b"))["x"].alias("x"), S.bounds_centroid(F.col("b"))["y"].alias("y"))


@query(f"WITH {PATCHES_SQL} SELECT vec_id, coffee_ratio FROM patches WHERE coffee_ratio >= 0.5")
def patch_ratio_filter(spark, d):
    return patch_view(spark, d).where(F.col("coffee_ratio") >= 0.5).select("vec_id", "coffee_ratio")


@query(
    f"WITH {PX_SQL}, w AS (SELECT CAST((vec_id // 32 * 4 + row) // 8 AS INTEGER) AS row, CAST((vec_id % 32 * 4 + col) // 8 AS INTEGER) AS col, b2 "
    f"FROM px), h AS (SELECT ((max(vec_id) // 32 + 1) * 4 - 1) // 8 AS h FROM embeddings) "
    "SELECT row, col, round(avg(CASE WHEN b2 > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) + 0.0 AS coffee_ratio FROM w, h WHERE row < h "
    "GROUP BY 1, 2 HAVING avg(CASE WHEN b2 > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) >= 0.4"
)
def patch_manifest_ratios(spark, d):
    """All patches as one raster, tiled anew in 8 x 8 pixels; its height is one short of the table's, so that a partial edge of tiles is dropped."""
    whole, height = raster(spark, d)
    return rounded(patches.patch_ratios(whole.withColumn("m", F.col("b2")), 8, height - 1, PER_ROW * SIDE, 0.4))


@query(
    f"WITH {PX_SQL} SELECT row, col, round(sum(b2), 6) + 0.0 AS b2, round(sum(b3), 6) + 0.0 AS b3, round(sum(b4), 6) + 0.0 AS b4, "
    f"round(sum(b8), 6) + 0.0 AS b8, count(*) AS n FROM px GROUP BY 1, 2"
)
def patch_pixels_explode(spark, d):
    return rounded(px(spark, d).groupBy("row", "col").agg(*[F.sum(b).alias(b) for b in BANDS], F.count("*").alias("n")))


@query(
    f"WITH {PX_SQL}, t AS (SELECT vec_id, unnest(range(36)) AS i FROM embeddings), c AS (SELECT vec_id, CAST(i // 6 AS INTEGER) AS row, "
    f"CAST(i % 6 AS INTEGER) AS col, CAST(floor((i // 6 + 0.5) * 0.8 - 0.5) AS INTEGER) AS r, CAST(floor((i % 6 + 0.5) * 0.8 - 0.5) AS INTEGER) AS k "
    f"FROM t) "
    "SELECT c.row, c.col, count(b2) AS n_inside, round(sum(coalesce(b2, 0.0::DOUBLE)), 6) + 0.0 AS total FROM c LEFT JOIN px ON px.vec_id = c.vec_id "
    "AND px.row = c.r AND px.col = c.k GROUP BY 1, 2"
)
def nearest_resample(spark, d):
    source, target = grid.Grid(4, 4, 10, 0, 0, 0, -10, 40), grid.Grid(6, 6, 8, 0, -5, 0, -8, 45)
    ids = table(spark, d, "embeddings").select("vec_id")
    cells = ids.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(35)))).select("vec_id", F.floor(F.col("i") / 6).cast("int").alias("row"), (F.col("i") % 6).cast("int").alias("col"))
    out = grid.nearest(px(spark, d), source, target, cells, "b2", None, ["vec_id"])
    return rounded(out.groupBy("row", "col").agg(F.count("b2").alias("n_inside"), F.sum(F.coalesce("b2", F.lit(0.0))).alias("total")))


@query(
    f"WITH {PX_SQL}, t AS (SELECT vec_id, unnest(range(9)) AS i FROM embeddings), c AS (SELECT vec_id, CAST(i // 3 AS INTEGER) AS row, "
    f"CAST(i % 3 AS INTEGER) AS col FROM t), "
    "n AS (SELECT c.*, unnest([0, 0, 1, 1]) AS dr, unnest([0, 1, 0, 1]) AS dk, unnest([0.28::DOUBLE, 0.42::DOUBLE, 0.12::DOUBLE, 0.18::DOUBLE]) AS w FROM c), "
    "v AS (SELECT n.vec_id, n.row, n.col, sum(b2 * w) AS v FROM n JOIN px ON px.vec_id = n.vec_id AND px.row = n.row + dr AND px.col = n.col + dk "
    "GROUP BY 1, 2, 3) SELECT row, col, round(sum(v), 6) + 0.0 AS total, round(max(v), 6) + 0.0 AS most FROM v GROUP BY 1, 2"
)
def bilinear_resample(spark, d):
    """A grid moved by 0.6 of a pixel in x and 0.3 in y: interior pixels."""
    source, target = grid.Grid(4, 4, 10, 0, 0, 0, -10, 40), grid.Grid(3, 3, 10, 0, 6, 0, -10, 37)
    ids = table(spark, d, "embeddings").select("vec_id")
    cells = ids.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(8)))).select("vec_id", F.floor(F.col("i") / 3).cast("int").alias("row"), (F.col("i") % 3).cast("int").alias("col"))
    out = grid.bilinear(px(spark, d), source, target, cells, "b2", ["vec_id"])
    return rounded(out.groupBy("row", "col").agg(F.sum("b2").alias("total"), F.max("b2").alias("most")))


@query(
    "WITH s AS (SELECT s_suppkey AS feature, s_suppkey * 37 % 1000 AS x, s_suppkey * 53 % 1000 AS y "
    "FROM supplier), c AS (SELECT feature, x, y, unnest(range(-4, 5)) AS i FROM s), k AS (SELECT *, unnest(range(-4, 5)) AS j FROM c), "
    "p AS (SELECT feature, x, y, (x // 10 + j) AS col, ((1000 - y) // 10 + i) AS row FROM k) "
    "SELECT feature, count(*) AS pixels, sum(row)::BIGINT AS rows, sum(col)::BIGINT AS cols FROM p WHERE row BETWEEN 0 AND 99 AND col BETWEEN 0 AND 99 "
    "AND abs(col * 10 + 5 - x) + abs(1000 - row * 10 - 5 - y) < 34.5 GROUP BY 1"
)
def rasterize_polygon(spark, d):
    """A diamond around a place for each supplier, on a grid of 100 x 100 cells."""
    x, y = (F.col("s_suppkey") * 37 % 1000).cast("double"), (F.col("s_suppkey") * 53 % 1000).cast("double")
    point = lambda dx, dy: F.struct((x + dx).alias("x"), (y + dy).alias("y"))
    shapes = table(spark, d, "supplier").select(F.col("s_suppkey").alias("feature"), F.array(F.array(point(34.5, 0), point(0, 34.5), point(-34.5, 0), point(0, -34.5))).alias("rings"))
    cells = vector.rasterize(shapes, ["feature"], 0.0, 1000.0, 10.0, 100, 100)
    return cells.groupBy("feature").agg(F.count("*").alias("pixels"), F.sum("row").alias("rows"), F.sum("col").alias("cols"))


@query(
    "SELECT CAST(2018 + n_nationkey % 3 AS INTEGER) AS year, arg_min(n_name, n_nationkey) AS source, count(*) AS n_sources FROM nation "
    "WHERE n_regionkey <> 0 GROUP BY 1"
)
def source_year_lookup(spark, d):
    n = table(spark, d, "nation").where("n_regionkey <> 0")
    return n.groupBy((F.lit(2018) + F.col("n_nationkey") % 3).cast("int").alias("year")).agg(F.min_by("n_name", "n_nationkey").alias("source"), F.count("*").alias("n_sources"))


@query(
    f"WITH {PATCHES_SQL} SELECT count(*) AS n_patches, count(*) FILTER (coffee_ratio > 0) AS n_positive, min(coffee_ratio) AS min_ratio, "
    f"round(avg(coffee_ratio), 6) + 0.0 AS mean_ratio, max(coffee_ratio) AS max_ratio, array_to_string(list_sort(list(DISTINCT fold)), ',') AS fold_values, "
    f"count(DISTINCT fold) AS n_fold FROM patches"
)
def manifest_summary(spark, d):
    return rounded(patches.manifest_summary(patch_view(spark, d), sets=["fold"]).withColumn("fold_values", F.array_join(F.col("fold_values").cast("array<string>"), ",")))


def raster(spark, d) -> tuple[DataFrame, int]:
    """All patches as one raster (vec_id, row, col and bands), and its height."""
    last = table(spark, d, "embeddings").agg(F.max("vec_id")).first()[0] or 0
    row = (F.floor(F.col("vec_id") / PER_ROW) * SIDE + F.col("row")).cast("int")
    col = ((F.col("vec_id") % PER_ROW) * SIDE + F.col("col")).cast("int")
    return px(spark, d).withColumns({"row": row, "col": col}), (last // PER_ROW + 1) * SIDE


def _placed(spark, d) -> DataFrame:
    return patch_view(spark, d).withColumns({"x": (F.col("col") * 512 + 256).cast("double"), "y": (F.col("row") * 512 + 256).cast("double")})


PLACED_SQL = f"{PATCHES_SQL}, placed AS (SELECT *, (col * 512 + 256)::DOUBLE AS x, (row * 512 + 256)::DOUBLE AS y FROM patches)"


@query(
    f"WITH {PLACED_SQL} SELECT f.fold, count(vec_id) AS n, round(avg(coffee_ratio), 6) + 0.0 AS mean_ratio, round(avg(x), 6) + 0.0 AS mean_x, "
    f"round(avg(y), 6) + 0.0 AS mean_y FROM (SELECT unnest(range(7)) AS fold) f LEFT JOIN placed p ON p.fold = f.fold GROUP BY 1"
)
def fold_report(spark, d):
    """Seven folds, two of them empty."""
    return rounded(folds.fold_report(_placed(spark, d), 7))


@query(
    f"WITH {PATCHES_SQL} SELECT CASE WHEN fold = 1 THEN 'validation' ELSE 'training' END AS part, count(*) AS n, "
    f"round(avg(coffee_ratio), 6) + 0.0 AS mean_ratio FROM patches GROUP BY 1"
)
def fold_train_val_split(spark, d):
    train, held = folds.split(patch_view(spark, d), 1)
    both = train.withColumn("part", F.lit("training")).unionByName(held.withColumn("part", F.lit("validation")))
    return rounded(both.groupBy("part").agg(F.count("*").alias("n"), F.avg("coffee_ratio").alias("mean_ratio")))


def _bands(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").select(*[F.col(c).alias(b) for b, c in LI.items()])


def _stats_sql(columns: dict[str, str]) -> str:
    one = " UNION ALL ".join(f"SELECT '{b}' AS band, {c} AS x FROM lineitem" for b, c in columns.items())
    return f"SELECT band, round(avg(x) FILTER (isfinite(x)), 6) + 0.0 AS mean, round(stddev_pop(x) FILTER (isfinite(x)), 6) + 0.0 AS std, count(*) FILTER (isfinite(x)) AS n_finite, count(*) AS n_total, round((count(*) - count(*) FILTER (isfinite(x))) / count(*)::DOUBLE, 6) + 0.0 AS nan_fraction FROM ({one}) GROUP BY 1"


@query(_stats_sql(LI))
def normalization_stats(spark, d):
    return rounded(stats.band_stats(_bands(spark, d), BANDS))


def _broken(spark, d) -> DataFrame:
    li = table(spark, d, "lineitem")
    n = F.col("l_linenumber")
    bad = lambda c: F.when(n == 7, F.lit(float("nan"))).when(n == 6, F.lit(float("inf"))).otherwise(F.col(c))
    return li.select(*[bad(c).alias(b) for b, c in LI.items()])


BROKEN = {b: f"CASE WHEN l_linenumber = 7 THEN 'NaN'::DOUBLE WHEN l_linenumber = 6 THEN 'Infinity'::DOUBLE ELSE {c} END" for b, c in LI.items()}


@query(_stats_sql(BROKEN))
def normalization_stats_nan(spark, d):
    return rounded(stats.band_stats(_broken(spark, d), BANDS))


@query(" UNION ALL ".join(f"SELECT '{b}' AS band, round(min(x) FILTER (isfinite(x)), 6) + 0.0 AS min_value, round(max(x) FILTER (isfinite(x)), 6) + 0.0 AS max_value, count(*) FILTER (isnan(x)) AS n_nan, count(*) FILTER (isinf(x)) AS n_inf FROM (SELECT {c} AS x FROM lineitem)" for b, c in BROKEN.items()))
def value_range_finite(spark, d):
    return rounded(stats.value_ranges(_broken(spark, d), BANDS))


@query(" UNION ALL ".join(f"SELECT '{b}' AS band, round(min(z), 6) + 0.0 AS low, round(max(z), 6) + 0.0 AS high, count(*) AS n FROM (SELECT CASE WHEN s = 0 THEN 0.0::DOUBLE ELSE (CASE WHEN isfinite(x) THEN x ELSE m END - m) / s END AS z FROM (SELECT {c} AS x FROM lineitem), (SELECT avg(x) AS m, stddev_pop(x) AS s FROM (SELECT {c} AS x FROM lineitem) WHERE isfinite(x)))" for b, c in BROKEN.items()))
def zscore_range(spark, d):
    rows = _broken(spark, d)
    z = stats.normalized(rows, stats.band_stats(rows, BANDS), BANDS)
    one = z.agg(*[a for b in BANDS for a in (F.min(b).alias(f"{b}_low"), F.max(b).alias(f"{b}_high"))], F.count("*").alias("n"))
    return rounded(one.select(F.inline(F.array(*[F.struct(F.lit(b).alias("band"), F.col(f"{b}_low").alias("low"), F.col(f"{b}_high").alias("high"), F.col("n")) for b in BANDS]))))


@query(
    "SELECT l_returnflag AS region, round(sum(greatest(0.0::DOUBLE, least(1.0::DOUBLE, l_extendedprice * 1e-4::DOUBLE))), 4) + 0.0 AS total, "
    "count(*) FILTER (l_extendedprice * 1e-4::DOUBLE > 1) AS n_clipped FROM lineitem GROUP BY 1"
)
def reflectance_clip(spark, d):
    li = table(spark, d, "lineitem")
    return rounded(li.groupBy(F.col("l_returnflag").alias("region")).agg(F.sum(S.reflectance(F.col("l_extendedprice"))).alias("total"), F.count_if(F.col("l_extendedprice") * 1e-4 > 1).alias("n_clipped")), 4)


@query("SELECT round(quantile_cont(l_extendedprice, 0.02), 6) + 0.0 AS p02, round(quantile_cont(l_extendedprice, 0.98), 6) + 0.0 AS p98 FROM lineitem")
def percentile_bounds(spark, d):
    low, high = stats.percentiles(table(spark, d, "lineitem"), F.col("l_extendedprice"), (0.02, 0.98))
    return rounded(spark.range(1).select(F.lit(low).cast("double").alias("p02"), F.lit(high).cast("double").alias("p98")))


@query(
    "WITH p AS (SELECT quantile_cont(l_extendedprice, 0.02) AS a, quantile_cont(l_extendedprice, 0.98) AS b FROM lineitem), v AS (SELECT "
    "CAST(trunc(greatest(0.0::DOUBLE, least(1.0::DOUBLE, (l_extendedprice - a) / (b - a))) * 255) AS INTEGER) AS v FROM lineitem, p), "
    "h AS (SELECT CAST(least(floor(v * 20 / 255.0::DOUBLE), 19) AS INTEGER) AS bin, count(*) AS n FROM v GROUP BY 1) SELECT "
    "CAST(b AS INTEGER) AS bin, coalesce(n, 0) AS n FROM (SELECT unnest(range(20)) AS b) LEFT JOIN h ON h.bin = b"
)
def percentile_stretch_hist(spark, d):
    li = table(spark, d, "lineitem").select("l_extendedprice")
    low, high = stats.percentiles(li, F.col("l_extendedprice"), (0.02, 0.98))
    drawn = stats.stretched(li, "l_extendedprice", low, high)
    return stats.histogram(drawn, F.col("l_extendedprice"), 20, F.lit(0.0), F.lit(255.0))


@query(f"WITH {PATCHES_SQL} SELECT vec_id, coffee_ratio FROM patches ORDER BY coffee_ratio DESC, vec_id LIMIT 3")
def top_patches(spark, d):
    return patches.top_patches(patch_view(spark, d), 3, key="vec_id").select("vec_id", "coffee_ratio")


@query(f"WITH {PATCHES_SQL} SELECT vec_id, coffee_ratio FROM patches ORDER BY md5(CAST(vec_id AS VARCHAR)), vec_id LIMIT 10")
def deterministic_sample(spark, d):
    return patches.hashed_sample(patch_view(spark, d), SETTINGS.sample, "vec_id").select("vec_id", "coffee_ratio")


def _counts_sql(by: str = "") -> str:
    r = lambda a, b: f"round(coalesce({a} / nullif({b}, 0)::DOUBLE, 1.0), 6) + 0.0"
    key = f"{by}, " if by else ""
    return (
        f"WITH {PX_SQL}, c AS (SELECT {key}count(*) FILTER (1 / (1 + exp(-b2 * 10)) >= 0.5 AND b3 > 0) AS tp, count(*) FILTER (1 / (1 + exp(-b2 * 10)) >= 0.5 AND NOT b3 > 0) AS fp, count(*) FILTER (NOT 1 / (1 + exp(-b2 * 10)) >= 0.5 AND b3 > 0) AS fn FROM px" + (f" GROUP BY {by}" if by else "") + ") "
        f"SELECT {key}tp, fp, fn, {r('tp', 'tp + fp + fn')} AS iou, {r('tp', 'tp + fp')} AS precision, {r('tp', 'tp + fn')} AS recall, {r('2 * tp', '2 * tp + fp + fn')} AS f1 FROM c"
    )


def _logit():
    return F.col("b2") * 10


@query(_counts_sql())
def pixel_metrics(spark, d):
    batches = evaluate.counts(px(spark, d), S.positive(_logit()), F.col("b3") > 0, ["fold"])
    return rounded(evaluate.with_scores(evaluate.added(batches)))


@query(_counts_sql("fold"))
def metrics_by_fold(spark, d):
    return rounded(evaluate.with_scores(evaluate.counts(px(spark, d), S.positive(_logit()), F.col("b3") > 0, ["fold"])))


@query(
    "WITH h AS (SELECT o_orderpriority AS model, "
    "CAST(o_custkey % 5 AS INTEGER) AS fold, o_orderkey AS epoch, (o_orderkey * 7919 % 101) / 101.0::DOUBLE AS val_iou FROM orders) "
    "SELECT model, fold, epoch, round(val_iou, 6) + 0.0 AS val_iou FROM (SELECT *, row_number() OVER (PARTITION BY model, fold "
    "ORDER BY val_iou DESC, epoch) AS r FROM h) WHERE r = 1"
)
def best_epoch(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("model"), (F.col("o_custkey") % 5).cast("int").alias("fold"), F.col("o_orderkey").alias("epoch"), ((F.col("o_orderkey") * 7919 % 101) / 101.0).alias("val_iou"))
    return rounded(evaluate.best_epochs(o, ["model", "fold"]))


@query(
    "SELECT o_orderpriority AS model, round(avg(b), 4) + 0.0 AS loss FROM (SELECT o_orderpriority, o_custkey % 16 AS batch, avg(o_totalprice) AS b "
    "FROM orders GROUP BY 1, 2) GROUP BY 1"
)
def epoch_mean_loss(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("model"), (F.col("o_custkey") % 16).alias("batch"), "o_totalprice")
    return rounded(evaluate.epoch_means(o, ["model"], "batch", F.col("o_totalprice")), 4)


@query(
    f"WITH {PX_SQL}, p AS (SELECT 1 / (1 + exp(-b2 * 10)) AS p, CASE WHEN b3 > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS t FROM px) SELECT "
    f"round(1 - (2 * sum(p * t) + 1) / (sum(p) + sum(t) + 1), 6) + 0.0 AS loss FROM p"
)
def dice_loss(spark, d):
    return rounded(px(spark, d).agg(evaluate.dice_loss(_logit(), F.col("b3") > 0).alias("loss")))


@query(
    f"WITH {PX_SQL}, p AS (SELECT greatest(1e-6::DOUBLE, least(1 - 1e-6::DOUBLE, 1 / (1 + exp(-b2 * 10)))) AS p, b3 > 0 AS t FROM px) SELECT "
    f"round(avg((CASE WHEN t THEN 0.25::DOUBLE ELSE 0.75::DOUBLE END) * power(1 - (CASE WHEN t THEN p ELSE 1 - p END), "
    f"2) * -ln(CASE WHEN t THEN p ELSE 1 - p END)), 6) + 0.0 AS loss FROM p"
)
def focal_loss(spark, d):
    return rounded(px(spark, d).agg(evaluate.focal_loss(_logit(), F.col("b3") > 0).alias("loss")))


_DISTANCES = ", ".join(f"struct_pack(d := (x - {cx}) ** 2 + (y - {cy}) ** 2, i := {i})" for i, (cx, cy) in enumerate(CENTRES))


@query(f"WITH {PLACED_SQL} SELECT CAST(list_min([{_DISTANCES}]).i AS INTEGER) AS centre, count(*) AS n, round(avg(x), 6) + 0.0 AS mean_x FROM placed GROUP BY 1")
def nearest_center_assign(spark, d):
    return rounded(_placed(spark, d).groupBy(folds.nearest_centre(F.col("x"), F.col("y"), CENTRES).alias("centre")).agg(F.count("*").alias("n"), F.avg("x").alias("mean_x")))


@query(
    "WITH r AS (SELECT l_linenumber % 3 AS m, CASE WHEN l_linenumber < 7 THEN l_linenumber % 5 END AS f, "
    "CASE WHEN l_linenumber = 7 THEN 'NaN'::DOUBLE ELSE l_quantity END AS v FROM lineitem), a AS (SELECT count(*) AS n, "
    "count(*) FILTER (f IS NULL) AS n_without_fold, count(DISTINCT f) AS n_folds, count(*) FILTER (m NOT IN (0, 1)) AS n_not_binary, "
    "count(*) FILTER (NOT isfinite(v)) AS n_not_finite FROM r) "
    "SELECT *, concat_ws(';', CASE WHEN n = 0 THEN 'no rows' END, CASE WHEN n_without_fold > 0 THEN 'rows without fold' END, "
    "CASE WHEN n_folds <> 5 THEN 'unexpected number of folds' END, CASE WHEN n_not_binary > 0 THEN 'mask is not binary' END, "
    "CASE WHEN n_not_finite > 0 THEN 'values that are not finite' END) AS issues FROM a"
)
def sanity_issues(spark, d):
    n = F.col("l_linenumber")
    rows = table(spark, d, "lineitem").select((n % 3).alias("m"), F.when(n < 7, n % 5).alias("f"), F.when(n == 7, F.lit(float("nan"))).otherwise(F.col("l_quantity")).alias("v"))
    return stats.sanity_issues(rows, "m", "f", "v", 5).withColumn("issues", F.array_join("issues", ";"))


@query(f"WITH {PX_SQL} SELECT row, 3 - col AS col, round(sum(b2), 6) + 0.0 AS total FROM px GROUP BY 1, 2")
def hflip_remap(spark, d):
    return rounded(patches.augment(px(spark, d), SIDE, SIDE, "hflip").groupBy("row", "col").agg(F.sum("b2").alias("total")))


@query(f"WITH {PX_SQL} SELECT 3 - col AS row, row AS col, round(sum(b2), 6) + 0.0 AS total FROM px GROUP BY 1, 2")
def rot90_remap(spark, d):
    return rounded(patches.augment(px(spark, d), SIDE, SIDE, "rot90").groupBy("row", "col").agg(F.sum("b2").alias("total")))


@query(
    f"WITH {PX_SQL}, m AS (SELECT a.vec_id, a.row, a.col, a.b2 > 0 AS m, "
    f"min(sqrt((a.row - b.row) ** 2 + (a.col - b.col) ** 2)) FILTER ((a.b2 > 0) <> (b.b2 > 0)) AS d FROM px a JOIN px b ON a.vec_id = b.vec_id "
    f"GROUP BY 1, 2, 3, 4) SELECT vec_id, round(sum(CASE WHEN m THEN -coalesce(d, 0.0::DOUBLE) ELSE coalesce(d, 0.0::DOUBLE) END), 6) + 0.0 AS total, "
    f"round(max(coalesce(d, 0.0::DOUBLE)), 6) + 0.0 AS most FROM m GROUP BY 1"
)
def signed_distance(spark, d):
    maps = evaluate.distance_maps(px(spark, d).withColumn("m", F.col("b2") > 0), "vec_id")
    return rounded(maps.groupBy("vec_id").agg(F.sum("distance").alias("total"), F.max(F.abs("distance")).alias("most")))


@query(
    f"WITH {PX_SQL}, m AS (SELECT a.vec_id, a.row, a.col, a.b3 > 0 AS m, a.b2, "
    f"min(sqrt((a.row - b.row) ** 2 + (a.col - b.col) ** 2)) FILTER ((a.b3 > 0) <> (b.b3 > 0)) AS d FROM px a JOIN px b ON a.vec_id = b.vec_id "
    f"GROUP BY 1, 2, 3, 4, 5), "
    "s AS (SELECT b2, CASE WHEN m THEN -coalesce(d, 0.0::DOUBLE) ELSE coalesce(d, 0.0::DOUBLE) END AS s FROM m) SELECT "
    "round(coalesce(sum(s * (1 / (1 + exp(-b2 * 10)))) / nullif(sum(abs(s)), 0), 0.0), 6) + 0.0 AS loss FROM s"
)
def boundary_loss(spark, d):
    maps = evaluate.distance_maps(px(spark, d).withColumn("m", F.col("b3") > 0), "vec_id", carried=["b2"])
    return rounded(maps.agg(evaluate.boundary_loss(_logit(), F.col("distance")).alias("loss")))


def _kmeans_sql(k: int, seed: int) -> str:
    """The same draws and steps as a recursive query over lists of centres."""
    u = lambda step: f"((('0x' || substr(md5('{seed}:{step}:' || x || ':' || y), 1, 13))::BIGINT + 0.5) / 4503599627370496.0::DOUBLE)"
    seeds = [f"s0 AS (SELECT x AS x0, y AS y0 FROM pts ORDER BY -ln({u(0)}) / n, x, y LIMIT 1)"]
    for j in range(1, k):
        near = "least(" + ", ".join(f"(x - x{i}) ** 2 + (y - y{i}) ** 2" for i in range(j)) + ")"
        seeds.append(f"s{j} AS (SELECT s{j - 1}.*, x AS x{j}, y AS y{j} FROM pts, s{j - 1} WHERE {near} > 0 ORDER BY -ln({u(j)}) / (n * {near}), x, y LIMIT 1)")
    start = ", ".join(f"{{'x': x{j}, 'y': y{j}}}" for j in range(k))
    nearest = "list_min(list_transform(range({k}), lambda j: {{'d': (p.x - c[j + 1].x) ** 2 + (p.y - c[j + 1].y) ** 2, 'j': j}})).j".format(k=k)
    return (
        f"WITH RECURSIVE {PLACED_SQL}, pts AS (SELECT x, y, count(*)::DOUBLE AS n FROM placed GROUP BY 1, 2), {', '.join(seeds)}, "
        f"l(i, c, done) AS (SELECT 0, [{start}], false FROM s{k - 1} UNION ALL SELECT i + 1, m, m = c FROM "
        f"(SELECT i, c, list({{'x': coalesce(mx, c[j + 1].x), 'y': coalesce(my, c[j + 1].y)}} ORDER BY j) AS m FROM (SELECT i, c, unnest(range({k})) AS j FROM l WHERE i < 100 AND NOT done) "
        f"LEFT JOIN (SELECT {nearest} AS g, sum(p.x * p.n) / sum(p.n) AS mx, sum(p.y * p.n) / sum(p.n) AS my FROM l, pts p GROUP BY 1) ON g = j GROUP BY i, c)), "
        f"f AS (SELECT list_sort(c) AS c FROM l ORDER BY i DESC LIMIT 1), a AS (SELECT p.*, {nearest} AS g FROM placed p, f) "
        f"SELECT k AS fold, count(vec_id) AS n, round(avg(coffee_ratio), 6) + 0.0 AS mean_ratio, round(avg(x), 6) + 0.0 AS mean_x, round(avg(y), 6) + 0.0 AS mean_y FROM (SELECT unnest(range({k})) AS k) LEFT JOIN a ON g = k GROUP BY 1"
    )


@query(_kmeans_sql(SETTINGS.folds, SETTINGS.seed))
def kmeans_folds(spark, d):
    assigned = folds.assign_folds(_placed(spark, d), SETTINGS.folds, SETTINGS.seed, "vec_id", ["row", "col"])
    return rounded(folds.fold_report(assigned, SETTINGS.folds))


@query("SELECT path FROM (SELECT format('images/p{:05d}.npy', vec_id) AS path FROM embeddings UNION SELECT format('masks/p{:05d}.npy', vec_id) FROM embeddings)")
def patch_paths(spark, d):
    rows = table(spark, d, "embeddings").select(F.format_string("images/p%05d.npy", "vec_id").alias("image_path"), F.format_string("masks/p%05d.npy", "vec_id").alias("mask_path"))
    return patches.local_paths(rows)


from gridsmith.plans import reports  # noqa: E402, F401  (registers further queries)
