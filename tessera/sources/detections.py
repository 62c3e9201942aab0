"""Detections and crops as folders or archives with ``metadata.json``."""

from __future__ import annotations

import json
import posixpath

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import validate
from ..functions import text
from ..operators import annotations, detection, presentation
from . import datasets, files

IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png", ".bmp", ".webp", ".tif", ".tiff")


def _listing(spark: SparkSession, source: str) -> tuple[DataFrame, list | None]:
    """Files of a folder or archive, below its first metadata.json if there is one, and what that says."""
    kind = files.kind(source)
    if kind is None:
        raise FileNotFoundError(source)
    if kind == "folder":
        at = files.join(source, "metadata.json")
        found, data = datasets.folder_listing(spark, source), files.read(at) if files.kind(at) else None
    else:
        reader = files.Reader()
        names = reader.names(validate.archive_path(source))
        metadata = sorted(x for x in names if posixpath.basename(x) == "metadata.json")
        prefix = metadata[0][: -len("metadata.json")] if metadata else ""
        found, data = datasets.archive_listing(spark, names, source, prefix), reader.get(source, names[metadata[0]]) if metadata else None
    images = found.where(text.suffix(F.col("path")).isin(*IMAGE_SUFFIXES))
    items = None if data is None else json.loads(data)
    if items is not None and not isinstance(items, list):
        raise ValueError("metadata.json must be a list")
    return images, items


def read_detections(spark: SparkSession, source: str) -> DataFrame:
    """(pos, path, boxes, scores, labels, src, member) of each image, in the order of the metadata or of paths.

    Paths that leave the folder, images that are missing and lists of unequal length raise.
    """
    images, items = _listing(spark, source)
    if items is None:
        none = {"boxes": "array<array<double>>", "scores": "array<double>", "labels": "array<string>"}
        if images.isEmpty():
            raise ValueError(f"no images in {source}")
        return annotations.ranked(images, [F.col("path")]).select("pos", "path", *(F.array().cast(k).alias(c) for c, k in none.items()), "src", "member")
    rows = []
    for k, x in enumerate(items):
        if not isinstance(x, dict):
            raise ValueError("items of metadata.json must be objects")
        path = x.get("path")
        if not isinstance(path, str) or not path:
            raise ValueError("an item of metadata.json lacks its path")
        path = posixpath.normpath(path.replace("\\", "/"))
        if path.startswith("/") or ".." in str(x["path"]).replace("\\", "/").split("/"):
            raise ValueError(f"unsafe path: {x['path']}")
        boxes, scores, labels = ([*(x.get(c) or [])] for c in ("boxes", "scores", "labels"))
        if not len(boxes) == len(scores) == len(labels):
            raise ValueError(f"lengths differ: {path}")
        rows.append((k, path, [[float(v) for v in b] for b in boxes], [float(v) for v in scores], [str(v) for v in labels]))
    wanted = spark.createDataFrame(rows, "pos bigint, path string, boxes array<array<double>>, scores array<double>, labels array<string>")
    missing = wanted.join(images, "path", "left_anti").orderBy("pos").first()
    if missing:
        raise FileNotFoundError(f"{source}: {missing['path']}")
    return wanted.join(images, "path").select("pos", "path", "boxes", "scores", "labels", "src", "member")


def read_crops(spark: SparkSession, source: str, label: str | None = None) -> DataFrame:
    """(path, label, score, src, member): labels from the metadata, else the folder, else the name."""
    images, items = _listing(spark, source)
    metadata = None
    if items is not None:
        known = {x["path"]: (x["path"], x.get("label"), x.get("score")) for x in items if isinstance(x, dict) and x.get("path")}
        metadata = spark.createDataFrame(list(known.values()), "path string, label string, score double")
    return presentation.read_crops(images, metadata, label).select("path", "label", "score", "src", "member")


def _empty(folder: str, overwrite: bool) -> None:
    kind = files.kind(folder)
    if kind == "file":
        raise ValueError(f"no folder: {folder}")
    if kind and (files.folders(folder) or files.children(folder)) and not overwrite:
        raise FileExistsError(folder)


def _put(rows: DataFrame, contents: DataFrame | None, extra: dict[str, str], folder: str) -> None:
    """``rows(dst, text)``, ``contents(dst, content)`` and texts, in a folder that replaces the old one at the end."""
    fresh = files.beside(folder)
    schema = F.lit(None).cast("string").alias("src"), F.lit(None).cast("bigint").alias("member")
    datasets.put_files(rows.select("dst", *schema, "text"), fresh)

    def write(batches):
        for batch in batches:
            for dst, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                with files.replacing(files.join(fresh, dst)) as out:
                    out.write(content.as_py())
            yield batch.select([0])

    if contents is not None:
        contents.select("dst", "content").mapInArrow(write, "dst string").count()
    for name, body in extra.items():
        with files.replacing(files.join(fresh, name)) as out:
            out.write(body.encode())
    files.replace(fresh, folder)


def write_dataset(detections: DataFrame, frames: DataFrame, folder: str, overwrite: bool = False) -> None:
    """``images/frame_<k>.jpg``, ``labels/frame_<k>.txt`` and data.yaml; k counts frames by source and index.

    ``frames(source, frame_index, width, height, content)`` has the encoded images.
    """
    _empty(folder, overwrite)
    placed = annotations.ranked(frames, [F.col("source"), F.col("frame_index")])
    key = ["source", "frame_index"]
    sized = detections.join(placed.select(*key, "width", "height"), key)
    lines = detection.yolo_lines(sized, F.col("width"), F.col("height"))
    body = lines.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("det_index", "line"))), lambda x: x["line"]), "\n").alias("text"))
    labels = placed.select(*key, "pos").join(body, key, "left").select(F.format_string("labels/frame_%d.txt", "pos").alias("dst"), F.coalesce("text", F.lit("")).alias("text"))
    names = [r["label"] for r in detection.class_registry(detections).orderBy("class_id").collect()]  # a row for each class
    settings = {"path": files.locate(folder)[1], "train": "images", "nc": len(names), "names": names}
    _put(labels, placed.select(F.format_string("images/frame_%d.jpg", "pos").alias("dst"), "content"), {"data.yaml": yaml.safe_dump(settings, allow_unicode=True, sort_keys=False)}, folder)


def write_annotated(detections: DataFrame, frames: DataFrame, folder: str, overwrite: bool = False) -> None:
    """``frame_<k>.jpg`` and metadata.json; ``frames`` as for ``write_dataset``, drawn on or not.

    The metadata is one file, so its rows go through the driver one after the other.
    """
    _empty(folder, overwrite)
    key = ["source", "frame_index"]
    placed = annotations.ranked(frames, [F.col(c) for c in key])
    name = F.format_string("frame_%d.jpg", "pos")
    found = placed.select(*key, "pos", name.alias("path")).join(detection.records(detections), key, "left").orderBy("pos")
    rows = found.select("path", *(F.coalesce(c, F.array().cast(k)).alias(c) for c, k in (("boxes", "array<array<double>>"), ("scores", "array<double>"), ("labels", "array<string>"))))
    nothing = detections.sparkSession.createDataFrame([], "dst string, text string")
    _put(nothing, placed.select(name.alias("dst"), "content"), {"metadata.json": detection.metadata_json(rows)}, folder)


def write_crops(crops: DataFrame, folder: str, overwrite: bool = False) -> None:
    """``<label>/frame_<k>_crop_<i>.jpg`` and metadata.json of ``crops(image_id, det_index, label, score, content)``; k is ``image_id``."""
    _empty(folder, overwrite)
    named = presentation.crop_names(crops, F.format_string("frame_%d.jpg", F.col("image_id")))
    rows = named.orderBy("image_id", "det_index").select(F.col("crop_path").alias("path"), "score", "label")
    nothing = crops.sparkSession.createDataFrame([], "dst string, text string")
    _put(nothing, named.select(F.col("crop_path").alias("dst"), "content"), {"metadata.json": detection.metadata_json(rows)}, folder)
