"""Archives as files: what can be asked of one, and new archives from old ones.

New archives are planned as tables of (archive, place, name, where the content
is); the task that writes an archive reads the contents itself.
"""

from __future__ import annotations

import posixpath
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import validate
from ..operators import archive as algebra
from . import datasets, files, zip_archive


def check_archive(path: str) -> str:
    """A path of an existing ZIP file."""
    validate.check_type(path, str, "archive")
    kind = files.kind(path)
    if kind is None:
        raise FileNotFoundError(path)
    if kind != "file":
        raise ValueError(f"no file: {path}")
    return validate.archive_path(path)


def check_folder(path: str) -> str:
    validate.check_type(path, str, "folder")
    if files.kind(path) == "file":
        raise ValueError(f"no folder: {path}")
    return path


def check_target(path: str, overwrite: bool) -> str:
    validate.check_type(overwrite, bool, "overwrite")
    validate.archive_path(path)
    if files.kind(path) and not overwrite:
        raise FileExistsError(path)
    return path


def _names(names: str | Sequence[str], what: str) -> list[str]:
    if isinstance(names, str):
        return [names]
    validate.check_type(names, (list, tuple), what)
    for x in names:
        validate.check_type(x, str, what)
    return list(names)


def members(spark: SparkSession, path: str) -> DataFrame:
    """Members without their content, with ``src`` and ``member``, where that is."""
    return zip_archive.read(spark, check_archive(path), content=False).drop("content").withColumns({"src": F.lit(path), "member": F.col("ord")})


def list_files(spark: SparkSession, path: str) -> DataFrame:
    return algebra.list_files(members(spark, path))


def search(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    validate.check_type(pattern, str, "pattern")
    return algebra.search(members(spark, path), pattern)


def get_info(spark: SparkSession, path: str) -> dict:
    row = algebra.info(members(spark, path)).first()
    out = {"path": path, "format": posixpath.splitext(path)[1].lstrip("."), "archive_size": files.size(path)}
    if row is None:
        return out | {"file_count": 0, "uncompressed_size": 0, "compressed_size": 0, "compress_ratio": 0.0}
    return out | {"file_count": row["file_count"], "uncompressed_size": row["total_size"], "compressed_size": row["compressed_size"], "compress_ratio": row["ratio"]}


def test(spark: SparkSession, path: str) -> bool:
    """True; a corrupt member raises."""
    algebra.test(zip_archive.read(spark, check_archive(path)))
    return True


def extract(spark: SparkSession, path: str, folder: str, overwrite: bool = False) -> int:
    return zip_archive.extract(zip_archive.read(spark, check_archive(path)), check_folder(folder), overwrite, names=zip_archive.read(spark, path, content=False))


def extract_file(spark: SparkSession, path: str, name: str, folder: str, overwrite: bool = False) -> int:
    validate.check_type(name, str, "name")
    return zip_archive.extract(algebra.extract_file(zip_archive.read(spark, check_archive(path)), name), check_folder(folder), overwrite, flat=True)


def _put(rows: DataFrame, target: str) -> None:
    folder, _, name = target.rpartition("/")
    plan = rows.select(F.lit(name).alias("archive"), F.col("name").alias("dst"), "src", "member", F.lit(None).cast("string").alias("text"), "ord")
    if not datasets.put_archives(plan, folder or ".", "ord"):
        raise ValueError(f"an archive of nothing: {target}")


def add(spark: SparkSession, path: str, paths: str | Sequence[str]) -> None:
    """Files, and all files of folders under the folder's name, after the archive's members."""
    there, new = members(spark, path), []
    for x in _names(paths, "paths"):
        kind = files.kind(x)
        if kind is None:
            raise FileNotFoundError(x)
        base = posixpath.basename(x.rstrip("/"))
        if kind == "file":
            new.append((base, x))
        else:
            below = datasets.folder_listing(spark, x).orderBy("path").select("path", "src").collect()  # names of files given by hand
            new += [(f"{base}/{r['path']}", r["src"]) for r in below]
    rows = spark.createDataFrame([(posixpath.basename(path), k, name, src, None) for k, (name, src) in enumerate(new)], "archive string, ord bigint, name string, src string, member bigint")
    _put(algebra.add(there.select("archive", "ord", "name", "src", "member"), rows), path)


def remove(spark: SparkSession, path: str, names: str | Sequence[str]) -> None:
    _put(algebra.remove(members(spark, path), _names(names, "names")), path)


def merge(spark: SparkSession, paths: Sequence[str], target: str, overwrite: bool = False) -> None:
    """One archive of several, in the order given; equal names stay."""
    parts = [members(spark, x).withColumn("archive", F.lit(f"{k:09d}")) for k, x in enumerate(validate.merge_sources(paths))]
    check_target(target, overwrite)
    every = parts[0]
    for x in parts[1:]:
        every = every.unionByName(x)
    _put(algebra.merge(every, target), target)


def split(spark: SparkSession, path: str, folder: str, size: int, overwrite: bool = False) -> list[str]:
    """Archives ``<stem>_part_<k>.zip`` of members of ``size`` compressed bytes at most, larger ones alone."""
    validate.check_type(size, (int, float), "size")
    if size <= 0:
        raise ValueError("size must be positive")
    own, stem = members(spark, path), posixpath.splitext(posixpath.basename(path))[0]
    parts = algebra.split_by_size(own, size)
    check_folder(folder)
    plan = parts.select(F.format_string(f"{stem.replace('%', '%%')}_part_%03d.zip", F.col("part")).alias("archive"), F.col("name").alias("dst"), "src", "member", F.lit(None).cast("string").alias("text"), "ord")
    there = {posixpath.basename(x) for x in files.children(folder)} if files.kind(folder) else set()
    clash = sorted(r["archive"] for r in plan.select("archive").distinct().collect() if r["archive"] in there)  # a row for each part
    if clash and not overwrite:
        raise FileExistsError(files.join(folder, clash[0]))
    return datasets.put_archives(plan, folder, "ord")
