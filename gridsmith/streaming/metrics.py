"""Confusion counts over arriving predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridsmith.operators.evaluate import counts, with_scores


def streaming_scores(predictions: DataFrame, predicted: Column, target: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """Scores so far, by the given keys: the state is three counters a key. Use output mode complete or update."""
    return with_scores(counts(predictions, predicted, target, by))


def windowed_scores(predictions: DataFrame, predicted: Column, target: Column, ts: str, length: str, late: str) -> DataFrame:
    """Scores of tumbling windows; rows later than `late` are dropped with their window's state."""
    timed = predictions.withWatermark(ts, late).withColumn("window", F.window(ts, length))
    return with_scores(counts(timed, predicted, target, ("window",)))
