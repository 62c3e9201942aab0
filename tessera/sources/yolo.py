"""Labelled image folders: scan, read and write."""

from __future__ import annotations

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import annotations
from . import files


def find_root(folder: str) -> str:
    """The folder with data.yaml: this one, else its first child that has it, else this one."""
    if files.kind(files.join(folder, "data.yaml")):
        return folder
    return next((files.join(folder, x) for x in files.folders(folder) if files.kind(files.join(folder, x, "data.yaml"))), folder)


def class_names(folder: str) -> list[tuple[int, str]]:
    path = files.join(find_root(folder), "data.yaml")
    if not files.kind(path):
        raise ValueError("data.yaml is missing")
    data = yaml.safe_load(files.read(path)) or {}
    return annotations.class_table(data.get("names"))


def classes(spark: SparkSession, folder: str, dataset: str = "") -> DataFrame:
    return spark.createDataFrame([(dataset, i, n) for i, n in class_names(folder)], "dataset string, class_id int, name string")


def _paths(spark: SparkSession, folder: str) -> DataFrame:
    """Paths below a folder; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path")


def images(spark: SparkSession, folder: str) -> DataFrame:
    """Images with their labels' paths, null where there is none."""
    root = find_root(folder)
    found = annotations.scan_images(_paths(spark, files.join(root, "images")))
    labels = files.join(root, "labels")
    if files.kind(labels) != "folder":
        return found.withColumns({"expected": F.regexp_replace("rel_path", r"\.[^./]*$", ".txt"), "label_rel_path": F.lit(None).cast("string")})
    return annotations.pair_labels(found, _paths(spark, labels).select(F.regexp_extract("path", r"(?:^|/)labels/(.*)$", 1).alias("rel_path")))


def label_lines(spark: SparkSession, folder: str) -> DataFrame:
    """(label_rel_path, line_no, line) of all label files."""
    path = files.join(find_root(folder), "labels")
    texts = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").text(path)
    rel = F.regexp_extract(F.input_file_name(), r"(?:^|/)labels/(.*)$", 1)
    return texts.select(rel.alias("label_rel_path"), F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "line")).where("line <> ''")


def boxes(spark: SparkSession, folder: str) -> DataFrame:
    return annotations.parse_labels(label_lines(spark, folder))


def write_labels(lines: DataFrame, folder: str) -> None:
    """``lines(label_rel_path, line_no, line)`` as label files; a file is small and made by one task."""
    root = files.join(folder, "labels")
    texts = lines.groupBy("label_rel_path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("text"))

    def put(rows) -> None:
        for r in rows:
            with files.replacing(files.join(root, r["label_rel_path"])) as out:
                out.write((r["text"] + "\n").encode())

    texts.foreachPartition(put)


def write_yaml(folder: str, names: list[str] | dict[int, str], splits: tuple[str, ...] = ("train", "val")) -> None:
    """data.yaml with the given splits' folders; names as a list where ids are 0 to n-1."""
    table = dict(enumerate(names)) if isinstance(names, list) else names
    listed = [table[i] for i in range(len(table))] if sorted(table) == list(range(len(table))) else table
    tree = {"path": ".", **{s: f"images/{s}" for s in splits}, "nc": max(table, default=-1) + 1, "names": listed}
    with files.replacing(files.join(folder, "data.yaml")) as out:
        out.write(yaml.safe_dump(tree, allow_unicode=True, sort_keys=False).encode())
