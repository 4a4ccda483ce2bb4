"""Streams over run events. The batch engine needs none of these; they give the same answers as events arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_sightings(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each event id once within the watermark: an idempotent intake. ``events`` has happened (timestamp) and event_id."""
    return events.withWatermark("happened", late).dropDuplicatesWithinWatermark(["event_id"])


def counts_by_window(events: DataFrame, late: str = "1 hour", width: str = "1 hour") -> DataFrame:
    """Events and their values by kind and tumbling window; late ones count until the watermark passes."""
    grouped = events.withWatermark("happened", late).groupBy(F.window("happened", width), "kind")
    return grouped.agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("window.start").alias("start"), "kind", "n", "value")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Stretches of a run's events without a longer gap."""
    grouped = events.withWatermark("happened", late).groupBy(F.session_window("happened", gap), "run_id")
    return grouped.agg(F.count("*").alias("n")).select("run_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("stop"), "n")
