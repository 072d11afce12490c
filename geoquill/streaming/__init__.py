"""Compiled pipelines on streams: they are projections, so they hold unchanged; windows and lateness are Spark's."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.pipeline import Pipeline


def _placed(events: DataFrame, pipeline: Pipeline, time: str, lon: str, lat: str, late: str) -> DataFrame:
    placed = pipeline.transform(events, lon, lat).filter("ok")
    return placed.withWatermark(time, late) if events.isStreaming else placed


def centroids(events: DataFrame, pipeline: Pipeline, time: str, lon: str, lat: str, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Mean projected position and number of points by tumbling window; the input may be a stream."""
    placed = _placed(events, pipeline, time, lon, lat, late)
    means = placed.groupBy(F.window(time, width)).agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count("*").alias("n"))
    return means.select(F.col("window.start").alias("start"), "x", "y", "n")


def sliding(events: DataFrame, pipeline: Pipeline, time: str, lon: str, lat: str, width: str = "1 hour", step: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """The same by windows that overlap: a new one begins every `step`."""
    placed = _placed(events, pipeline, time, lon, lat, late)
    means = placed.groupBy(F.window(time, width, step)).agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count("*").alias("n"))
    return means.select(F.col("window.start").alias("start"), "x", "y", "n")


def sessions(events: DataFrame, pipeline: Pipeline, time: str, lon: str, lat: str, key: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Extent of the projected places by key and session; a session ends where nothing follows within `gap`."""
    placed = _placed(events, pipeline, time, lon, lat, late)
    found = placed.groupBy(key, F.session_window(time, gap)).agg(F.min("x").alias("west"), F.max("x").alias("east"), F.min("y").alias("south"), F.max("y").alias("north"), F.count("*").alias("n"))
    return found.select(key, F.col("session_window.start").alias("start"), "west", "east", "south", "north", "n")


def transformed(stream: DataFrame, pipeline: Pipeline, x: str, y: str, **columns) -> DataFrame:
    """A stream of coordinates, transformed; the same call as for tables."""
    return pipeline.transform(stream, x, y, **columns)
