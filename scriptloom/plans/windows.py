"""Media windows: planning them, and finding the window of a point in time."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ConfigurationError

LONGEST = 30.0


def check(chunk: float, overlap: float) -> None:
    if not (math.isfinite(chunk) and 0 < chunk <= LONGEST):
        raise ConfigurationError("a chunk lasts more than 0 and at most 30 seconds")
    if not (math.isfinite(overlap) and 0 <= overlap < chunk):
        raise ConfigurationError("an overlap is at least 0 and shorter than the chunk")


def chunk_count(duration: Column, chunk: float, overlap: float = 0.0) -> Column:
    """Number of windows; null where the duration isn't positive and finite."""
    check(chunk, overlap)
    good = (duration > 0) & ~F.isnan(duration) & (duration != F.lit(float("inf")))
    more = F.ceil((duration - chunk) / F.lit(chunk - overlap)).cast("int") + 1
    return F.when(good, F.when(duration <= chunk, F.lit(1)).otherwise(more))


def plan_chunks(media: DataFrame, duration: str = "duration_seconds", chunk: float = 30.0, overlap: float = 2.0) -> DataFrame:
    """media with a row per window: index, start_seconds, chunk_seconds (the last one is cut at the end)."""
    n = chunk_count(F.col(duration), chunk, overlap)
    out = media.withColumn("index", F.explode(F.sequence(F.lit(0), n - 1)))
    start = F.col("index") * F.lit(float(chunk - overlap))
    return out.withColumn("start_seconds", start).withColumn("chunk_seconds", F.least(F.lit(float(chunk)), F.col(duration) - F.col("start_seconds")))


def windows_of(points: DataFrame, seconds: str, chunk: float = 30.0, overlap: float = 2.0, duration: str | None = None) -> DataFrame:
    """points with a row per window that holds them: which windows is arithmetic, so no range join is needed."""
    check(chunk, overlap)
    stride = float(chunk - overlap)
    last = F.floor(F.col(seconds) / stride)
    if duration:
        last = F.least(last, chunk_count(F.col(duration), chunk, overlap) - 1)
    first = F.greatest(F.lit(0), F.floor((F.col(seconds) - chunk) / stride) + 1)
    held = F.when((F.col(seconds) >= 0) & (first <= last), F.sequence(first.cast("int"), last.cast("int")))
    return points.withColumn("index", F.explode(held)).withColumn("start_seconds", F.col("index") * F.lit(stride))
