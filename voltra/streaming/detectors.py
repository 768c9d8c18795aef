"""Artifact detection on a stream: watermarked time windows, one range a recording and channel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_minmax(stream: DataFrame, channels: list[str], threshold: float, window: str = "1 second", slide: str | None = None, late: str = "10 seconds") -> DataFrame:
    """_recording, window, _channel, range of windows of ``stream`` (_recording, _ts, channels) whose range reaches the
    threshold; state is dropped once the watermark passes."""
    long = stream.withWatermark("_ts", late).unpivot(["_recording", "_ts"], channels, "_channel", "_value")
    span = F.window("_ts", window, slide) if slide else F.window("_ts", window)
    return long.groupBy(span, "_recording", "_channel").agg((F.max("_value") - F.min("_value")).alias("range")).filter(F.col("range") >= threshold)
