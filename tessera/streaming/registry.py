"""Streams of detections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_seen(detections: DataFrame) -> DataFrame:
    """First frame and box of each label so far, kept up as frames arrive.

    For output mode ``complete`` or ``update``; ids follow from ``class_registry``
    over the sink's rows, so no state is carried from frame to frame.
    """
    return detections.groupBy(F.lower(F.trim("label")).alias("label")).agg(F.min(F.struct("frame_index", "det_index")).alias("first"))


def windowed_counts(detections: DataFrame, time: str, width: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Boxes of each label in tumbling windows; later than ``late`` is left out."""
    return detections.withWatermark(time, late).groupBy(F.window(time, width).alias("window"), "label").agg(F.count("*").alias("n_boxes"))
