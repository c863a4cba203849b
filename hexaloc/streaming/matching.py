"""Identifiers on streams. All functions on columns are stateless, so they work there as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hexaloc.operators.matching import Matcher


def matched(stream: DataFrame, matcher: Matcher, identifier: str = "id") -> DataFrame:
    """The rows of a stream (or table) that match, with the numbers of their selectors."""
    numbered = stream.withColumn("matches", matcher.matches(F.col(identifier)))
    return numbered.where(matcher.is_match(F.col(identifier)))


def counted(stream: DataFrame, matcher: Matcher, time: str = "ts", window: str = "1 hour", late: str = "1 hour", identifier: str = "id") -> DataFrame:
    """Rows for each window of time and selector. Rows later than the watermark are left out."""
    kind = stream.schema[time].dataType
    rows = stream.withColumn(time, F.col(time).cast("timestamp"))  # watermarks are on instants
    rows = rows.withWatermark(time, late).withColumn("idx", F.explode(matcher.matches(F.col(identifier))))
    counts = rows.groupBy(F.window(time, window), "idx").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("window.start").cast(kind).alias("window_start"), "idx", "n")
