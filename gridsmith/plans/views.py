"""The driver's tables read as the engine's relations.

`px`: every embedding is a patch of 4 x 4 pixels in four bands, and its id gives
its place in a grid of patches, 32 to a row. Pixels are wide rows, made by a
row-local generator: no shuffle, and a query that needs one band reads the one
column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIDE, PER_ROW, FOLDS = 4, 32, 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def px(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, fold, row, col, b2, b3, b4, b8."""
    e = F.col("embedding")
    area = SIDE * SIDE
    at = lambda band, i: F.get(e, i + band * area).cast("double")
    cells = F.transform(F.sequence(F.lit(0), F.lit(area - 1)), lambda i: F.struct(F.floor(i / SIDE).cast("int").alias("row"), (i % SIDE).cast("int").alias("col"), *[at(k, i).alias(b) for k, b in enumerate(("b2", "b3", "b4", "b8"))]))
    return table(spark, sf_dir, "embeddings").select("vec_id", (F.col("label") % FOLDS).cast("int").alias("fold"), F.inline(cells))


PX_SQL = "px AS (SELECT vec_id, CAST(label % 5 AS INTEGER) AS fold, CAST(i // 4 AS INTEGER) AS row, CAST(i % 4 AS INTEGER) AS col, CAST(e[i + 1] AS DOUBLE) AS b2, CAST(e[i + 17] AS DOUBLE) AS b3, CAST(e[i + 33] AS DOUBLE) AS b4, CAST(e[i + 49] AS DOUBLE) AS b8 FROM (SELECT vec_id, label, embedding AS e, unnest(range(16)) AS i FROM embeddings))"


def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, fold, patch row and col, and coffee_ratio: the share of positive pixels in b2, computed within the row."""
    positive = F.size(F.filter(F.slice("embedding", 1, SIDE * SIDE), lambda v: v > 0))
    return table(spark, sf_dir, "embeddings").select(
        "vec_id",
        (F.col("label") % FOLDS).cast("int").alias("fold"),
        F.floor(F.col("vec_id") / PER_ROW).cast("int").alias("row"),
        (F.col("vec_id") % PER_ROW).cast("int").alias("col"),
        (positive / (SIDE * SIDE)).cast("double").alias("coffee_ratio"),
    )


PATCHES_SQL = "patches AS (SELECT vec_id, CAST(label % 5 AS INTEGER) AS fold, CAST(vec_id // 32 AS INTEGER) AS row, CAST(vec_id % 32 AS INTEGER) AS col, len(list_filter(embedding[1:16], lambda v: v > 0)) / 16.0::DOUBLE AS coffee_ratio FROM embeddings)"
