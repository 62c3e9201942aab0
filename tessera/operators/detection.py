"""Detection: a detector as a vectorised function, and what happens to its boxes.

``detections(source, frame_index, det_index, x1, y1, x2, y2, score, label)``.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import validate
from ..functions.text import fixed
from .annotations import ranked

SCHEMA = "source string, frame_index bigint, det_index int, x1 double, y1 double, x2 double, y2 double, score double, label string"
Detector = Callable[..., list[tuple[float, float, float, float, float, str]]]


class Model:
    """A detector with its options.

    ``detector(image, prompt, **options)`` gets a frame's ``image`` value and
    returns (x1, y1, x2, y2, score, label) tuples.  It is sent to executors.
    """

    def __init__(self, detector: Detector, **options) -> None:
        self.detector, self.input_options, self.output_options = detector, dict(options), {}

    def set_input_kwargs(self, **options) -> Model:
        self.input_options |= options
        return self

    def set_output_kwargs(self, **options) -> Model:
        self.output_options |= options
        return self

    def predict(self, frames: DataFrame, prompt: str, box_threshold: float = 0.25, text_threshold: float = 0.25, max_area: float = 1.0) -> DataFrame:
        """Detections over the thresholds of ``frames(source, frame_index, width, height, image)``."""
        validate.detection_options(box_threshold, text_threshold, max_area)
        detector, options = self.detector, {**self.input_options, "text_threshold": text_threshold}

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows = []
                for frame in batch.itertuples(index=False):
                    found = detector(frame.image, prompt, **options)
                    rows += [(frame.source, frame.frame_index, k, *map(float, box[:5]), str(box[5]), frame.width, frame.height) for k, box in enumerate(found)]
                yield pd.DataFrame(rows, columns=[*(x.split()[0] for x in SCHEMA.split(", ")), "width", "height"])

        found = frames.select("source", "frame_index", "width", "height", "image").mapInPandas(run, f"{SCHEMA}, width int, height int")
        return filter_area(found.where(F.col("score") >= box_threshold), F.col("width"), F.col("height"), max_area)


def area(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    zero = F.lit(0.0)
    return F.greatest(zero, x2 - x1) * F.greatest(zero, y2 - y1)


def filter_area(boxes: DataFrame, width: Column, height: Column, max_area: float) -> DataFrame:
    """Boxes that cover at most this share of their image."""
    return boxes.where(area(*(F.col(c) for c in ("x1", "y1", "x2", "y2"))) <= F.lit(float(max_area)) * width * height)


def filter_score(boxes: DataFrame, threshold: float) -> DataFrame:
    return boxes.where(F.col("score") >= threshold)


def normalise(boxes: DataFrame, width: Column, height: Column) -> DataFrame:
    """Adds xc, yc, w, h as shares of the image, and the cleaned label."""
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    return boxes.withColumns({"xc": (x1 + x2) / 2 / width, "yc": (y1 + y2) / 2 / height, "w": (x2 - x1) / width, "h": (y2 - y1) / height, "label": F.lower(F.trim("label"))})


def class_registry(detections: DataFrame, order: tuple[str, ...] = ("frame_index", "det_index")) -> DataFrame:
    """(label, class_id): ids by first appearance.

    First places are minima, one row a label; labels are ranked by ranges.
    """
    first = detections.groupBy(F.lower(F.trim("label")).alias("label")).agg(F.min(F.struct(*order)).alias("first"))
    return ranked(first, [F.col(f"first.{c}") for c in order] + [F.col("label")]).select("label", F.col("pos").cast("int").alias("class_id"))


def yolo_lines(detections: DataFrame, width: Column, height: Column) -> DataFrame:
    """(source, frame_index, det_index, line): label lines with six decimals."""
    boxes = normalise(detections, width, height).join(class_registry(detections), "label")  # broadcast if Spark finds it small
    line = F.concat_ws(" ", F.col("class_id").cast("string"), *(fixed(F.col(c), 6) for c in ("xc", "yc", "w", "h")))
    return boxes.select("source", "frame_index", "det_index", line.alias("line"))


def records(detections: DataFrame) -> DataFrame:
    """A row for each frame: boxes, scores and labels in order of ``det_index``."""
    one = F.struct("det_index", F.array("x1", "y1", "x2", "y2").alias("box"), "score", "label")
    grouped = detections.groupBy("source", "frame_index").agg(F.array_sort(F.collect_list(one)).alias("d"))
    return grouped.select("source", "frame_index", F.col("d.box").alias("boxes"), F.col("d.score").alias("scores"), F.col("d.label").alias("labels"))


METADATA = "array<struct<path:string,boxes:array<array<double>>,scores:array<double>,labels:array<string>>>"


def read_metadata(texts: DataFrame) -> DataFrame:
    """Records of JSON lists in ``texts(value)``; lists of unequal length raise."""
    rows = texts.select(F.explode(F.from_json("value", METADATA)).alias("r")).select("r.*")
    same = (F.size("boxes") == F.size("scores")) & (F.size("boxes") == F.size("labels"))
    return rows.where(F.when(same, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("lengths differ: "), "path")).cast("boolean")))


def metadata_json(rows: DataFrame) -> str:
    """Records as the JSON text of a metadata file."""
    return json.dumps([r.asDict(recursive=True) for r in rows.toLocalIterator()], ensure_ascii=False, indent=4)
