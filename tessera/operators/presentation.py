"""Crops, grids and labels to draw, as tables; pixels only where an image is cut."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text

CROP_SUFFIXES = (".jpg", ".jpeg", ".png")


def crop_names(boxes: DataFrame, image: Column, order: str = "det_index") -> DataFrame:
    """Adds ``crop_path``: ``<label>/<stem>_crop_<k>.jpg``, k counting within image and label."""
    named = boxes.withColumn("folder", text.sanitise_label(F.col("label")))
    k = F.row_number().over(Window.partitionBy("image_id", "folder").orderBy(order)) - 1
    return named.withColumn("k", k).withColumn("crop_path", F.concat("folder", F.lit("/"), text.stem(image), F.lit("_crop_"), F.col("k").cast("string"), F.lit(".jpg")))


def crop_stem(rel_path: Column) -> Column:
    """A nested image's parts joined by underscores, without suffix."""
    return F.regexp_replace(F.replace(rel_path, F.lit("/"), F.lit("_")), r"\.[^.]*$", "")


def crop_pixels(boxes: DataFrame) -> DataFrame:
    """Cuts ``image`` (the image source's struct) to each row's x1, y1, x2, y2."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for batch in batches:
            data = []
            for r in batch.itertuples(index=False):
                pixels = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, -1)
                data.append(pixels[r.y1 : r.y2, r.x1 : r.x2].tobytes())
            yield pd.DataFrame({"image_id": batch["image_id"], "det_index": batch["det_index"], "width": batch["x2"] - batch["x1"], "height": batch["y2"] - batch["y1"], "data": data})

    rows = boxes.select("image_id", "det_index", *(F.col(c).cast("int").alias(c) for c in ("x1", "y1", "x2", "y2")), F.col("image.width").alias("width"), F.col("image.height").alias("height"), F.col("image.data").alias("data"))
    return rows.mapInPandas(cut, "image_id bigint, det_index int, width int, height int, data binary")


def grid_layout(images: DataFrame, columns: int, rows: int | None = None, order: str = "pos") -> DataFrame:
    """Place of each image (``width``, ``height``) in a grid of equal cells, centred.

    ``order`` is the image's 0-based place; images beyond the grid are left out, and no images raise.
    """
    if columns <= 0 or (rows is not None and rows <= 0):
        raise ValueError("grid values must be positive")
    if images.isEmpty():
        raise ValueError("a grid needs images")
    chosen = images.where(F.col(order) < columns * rows) if rows else images
    cell = chosen.agg(F.max("width").alias("cell_w"), F.max("height").alias("cell_h"))
    col, row = F.col(order) % columns, F.call_function("div", F.col(order), F.lit(columns))
    placed = chosen.join(F.broadcast(cell)).withColumns({"grid_col": col.cast("bigint"), "grid_row": row.cast("bigint")})  # one row of sizes
    centre = lambda at, size, own: F.col(at) * F.col(size) + F.call_function("div", F.col(size) - F.col(own), F.lit(2))
    return placed.withColumn("x", centre("grid_col", "cell_w", "width")).withColumn("y", centre("grid_row", "cell_h", "height"))


def read_crops(crops: DataFrame, metadata: DataFrame | None = None, label: str | None = None) -> DataFrame:
    """``crops(path)`` with ``label`` and ``score``.

    The label comes from the metadata, else the folder, else what stands
    before ``_crop_``; crops without any are left out.
    """
    found = crops.where(text.suffix(F.col("path")).isin(*CROP_SUFFIXES))
    if metadata is not None:
        found = found.join(metadata.select("path", F.col("label").alias("meta_label"), "score"), "path", "left")
    else:
        found = found.withColumn("meta_label", F.lit(None).cast("string")).withColumn("score", F.lit(None).cast("double"))
    parts = F.split("path", "/")
    folder = F.when(F.size(parts) > 1, F.element_at(parts, F.greatest(F.size(parts) - 1, F.lit(1))))
    name = text.stem(F.col("path"))
    prefix = F.when(F.contains(name, F.lit("_crop_")), F.substring_index(name, "_crop_", 1))
    out = found.withColumn("label", F.coalesce("meta_label", folder, prefix)).drop("meta_label").where("label IS NOT NULL AND label <> ''")
    return out.where(F.col("label") == label) if label is not None else out


def group_crops(crops: DataFrame) -> DataFrame:
    """(label, paths): each label's crops in order of path."""
    return crops.groupBy("label").agg(F.array_sort(F.collect_list("path")).alias("paths"))


def draw_anchors(boxes: DataFrame) -> DataFrame:
    """Adds the box in whole pixels and where and what its text is."""
    whole = boxes.withColumns({c: F.col(c).cast("int") for c in ("x1", "y1", "x2", "y2")})
    y = F.when(F.col("y1") - 5 > 15, F.col("y1") - 5).otherwise(F.col("y1") + 18)
    caption = F.concat("label", F.coalesce(F.concat(F.lit(" "), text.fixed(F.col("score"), 2)), F.lit("")))
    return whole.withColumns({"text_x": F.col("x1"), "text_y": y, "caption": caption})
