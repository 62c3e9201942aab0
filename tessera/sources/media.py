"""Images and frame streams as tables."""

from __future__ import annotations

import posixpath

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import annotations
from . import files

IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png", ".bmp", ".webp", ".tif", ".tiff")
VIDEO_SUFFIXES = (".avi", ".m4v", ".mkv", ".mov", ".mp4", ".webm")


def read_images(spark: SparkSession, source: str, recursive: bool = False) -> DataFrame:
    """(path, image): decoded images of a file or folder, in order of lower-cased path.

    The image struct is Spark's, in BGR.  A file with an image's suffix that cannot be decoded
    raises when it is read; Java decodes JPEG, PNG, BMP, GIF and TIFF, so WebP needs a plug-in of its ImageIO.
    """
    kind = files.kind(source)
    if kind is None:
        raise FileNotFoundError(f"no such source: {source}")
    suffixes = "(" + "|".join(s.replace(".", r"\.") for s in IMAGE_SUFFIXES) + ")$"
    named = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive or kind == "file").lower()).load(str(source)).where(F.lower("path").rlike(suffixes))
    if named.select("path").isEmpty():
        raise ValueError(f"no image files: {source}")
    reader = spark.read.format("image").option("dropInvalid", "false")
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    found = reader.load(str(source)).select(F.col("image.origin").alias("path"), "image").where(F.lower("path").rlike(suffixes))
    unreadable = F.raise_error(F.concat(F.lit("could not read image: "), "path")).cast("int")
    return found.where(F.when(F.col("image.nChannels") > 0, F.lit(1)).otherwise(unreadable) == 1).orderBy(F.lower("path"))


def to_rgb(image: DataFrame) -> DataFrame:
    """Adds ``rgb``: pixels as RGB bytes from grey, BGR or BGRA."""
    @F.pandas_udf("binary")
    def convert(h: pd.Series, w: pd.Series, channels: pd.Series, data: pd.Series) -> pd.Series:
        import numpy as np

        out = []
        for rows, cols, n, raw in zip(h, w, channels, data):
            pixels = np.frombuffer(raw, np.uint8).reshape(rows, cols, n)
            out.append((np.repeat(pixels, 3, 2) if n == 1 else pixels[:, :, 2::-1]).tobytes())
        return pd.Series(out)

    return image.withColumn("rgb", convert("image.height", "image.width", "image.nChannels", "image.data"))


def is_video(path: str) -> bool:
    return files.kind(path) == "file" and posixpath.splitext(str(path))[1].lower() in VIDEO_SUFFIXES


def frames(rows: DataFrame, source: str, *order: str) -> DataFrame:
    """Numbers rows as frames of their source, in order of the columns.

    Rows are ranked by ranges of (source, order), so a stream that holds most rows is no single task.
    """
    placed = annotations.ranked(rows, [F.col(source), *(F.col(c) for c in order)])
    first = placed.groupBy(source).agg(F.min("pos").alias("__first"))
    same = F.col(f"p.`{source}`").eqNullSafe(F.col(f"f.`{source}`"))
    numbered = placed.alias("p").join(first.alias("f"), same).select("p.*", (F.col("pos") - F.col("__first")).alias("frame_index")).drop("pos")
    return numbered.withColumnRenamed(source, "source")


def from_video(spark: SparkSession, path: str) -> DataFrame:
    """Frames of a video; needs OpenCV, which decodes them one after the other in one task."""

    def run(batches):
        import cv2

        for batch in batches:
            for p in batch["path"]:
                video, k = cv2.VideoCapture(p), 0
                while True:
                    ok, frame = video.read()
                    if not ok:
                        break
                    yield pd.DataFrame({"source": [p], "frame_index": [k], "width": [frame.shape[1]], "height": [frame.shape[0]], "image": [frame.tobytes()]})
                    k += 1

    if not is_video(path):
        raise ValueError(f"no video: {path}")
    return spark.createDataFrame([(path,)], "path string").mapInPandas(run, "source string, frame_index bigint, width int, height int, image binary")
