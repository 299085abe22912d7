"""Structured Streaming forms of the usage operators: responses as they arrive.

Batch keeps the last row of a message; a stream keeps the first within the watermark, as later ones cannot be waited for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def timed(events: DataFrame, ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """events with a timestamp that a watermark can follow; rows later than late may be dropped."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def first_response(events: DataFrame, message: str) -> DataFrame:
    """The first row of each message within the watermark; state is dropped as the watermark passes."""
    return events.dropDuplicatesWithinWatermark([message])


def tallies(events: DataFrame, model: str, tokens: str, ts: str = "ts", width: str = "1 hour") -> DataFrame:
    """Responses and tokens of each model in windows of width, given out once a window is closed."""
    each = events.groupBy(F.window(ts, width), model).agg(F.count("*").alias("responses"), F.sum(tokens).alias("tokens"))
    return each.select(F.col("window.start").alias("start"), model, "responses", "tokens")


def sessions(events: DataFrame, user: str, ts: str = "ts", gap: str = "30 minutes") -> DataFrame:
    """Sessions of each user, closed by a gap."""
    each = events.groupBy(F.session_window(ts, gap), user).agg(F.count("*").alias("events"))
    return each.select(user, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "events")
