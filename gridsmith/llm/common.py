"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of an Arrow batch: texts may be long, and a Python worker holds a batch's texts at once.
BATCH_ROWS = 1_000


def small_batches(spark: SparkSession) -> None:
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def id_and_text(docs: DataFrame) -> DataFrame:
    """doc_id and text only, a null text as empty: further columns, whatever their names, stay out."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def checkpoint_dir(spark: SparkSession) -> None:
    """The cluster names the shared folder in spark.checkpoint.dir; one of our own only on a single machine that names none, as in tests."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        context.setCheckpointDir(named or f"file:///tmp/checkpoints/{os.getuid()}")


def cut(frame: DataFrame) -> DataFrame:
    """The frame written to the shared folder and read back: lineage ends there and an executor's loss costs nothing."""
    checkpoint_dir(frame.sparkSession)
    return frame.checkpoint()


def bucket_of(column: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo: the folds that the contracts fix."""
    return F.crc32(column.cast("string").cast("binary")) % mod


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def even_keys(spark: SparkSession, rounds: int = 1) -> list[int]:
    """So many times as many numbers as there are shuffle partitions: a shuffle by their int value deals every partition the same number of them."""
    width = shuffle_width(spark)
    dealt = spark.range(width * (24 + 4 * rounds) + 64).select(F.col("id"), F.pmod(F.hash(F.col("id").cast("int")), F.lit(width)).alias("to"))
    ranked = dealt.withColumn("nth", F.row_number().over(Window.partitionBy("to").orderBy("id"))).where(F.col("nth") <= rounds)
    return [r["id"] for r in ranked.orderBy("nth", "to").collect()]


#: Bytes of text that one part, and one bucket's share, may stand for: a task holds a part's texts, or what all parts ask of a bucket.
PART_BYTES = 24 << 20


def buckets_and_parts(frame: DataFrame, part_bytes: int = PART_BYTES, spread: int = 3) -> tuple[list[int], int]:
    """Keys of the buckets and the number of parts, for texts of the measured size: at least `spread` parts for each shuffle partition, to even them out."""
    spark = frame.sparkSession
    size = frame.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    width = shuffle_width(spark)
    return even_keys(spark, max(1, -(-size // (part_bytes * width)))), max(spread * width, -(-size // part_bytes))


def part_of(width: int) -> Column:
    """The part of a row (doc_id, text): rows of one doc_id are in one part, those without are dealt by their text."""
    return F.pmod(F.xxhash64(F.coalesce("doc_id", F.xxhash64("text"))), F.lit(width)).cast("int")
