"""Archive algebra over ``members(archive, ord, name, file_size, compress_size, crc, content)``.

``ord`` is the place in the archive's directory; names may repeat within an
archive, so members are told apart by ``ord``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text
from .annotations import ranked

KEY = ("archive", "ord")


def list_files(members: DataFrame) -> DataFrame:
    return members.select("archive", "ord", "name").orderBy(*KEY)


def search(members: DataFrame, pattern: str) -> DataFrame:
    return members.where(text.glob(F.col("name"), pattern))


def info(members: DataFrame) -> DataFrame:
    """Counts, sizes and the saved share in percent of each archive; directories count as files."""
    out = members.groupBy("archive").agg(F.count("*").alias("file_count"), F.sum("file_size").alias("total_size"), F.sum("compress_size").alias("compressed_size"))
    saved = (1 - F.col("compressed_size") / F.when(F.col("total_size") > 0, F.col("total_size"))) * 100
    return out.withColumn("ratio", F.coalesce(F.round(saved, 2), F.lit(0.0)))


def first_bad(members: DataFrame) -> DataFrame:
    """The first member of each archive whose content does not match its checksum."""
    bad = members.where(F.crc32("content") != F.col("crc"))
    return bad.groupBy("archive").agg(F.min_by("name", "ord").alias("name"))


def test(members: DataFrame) -> None:
    row = first_bad(members).orderBy("archive").first()
    if row:
        raise ValueError(f"corrupt member: {row['archive']}/{row['name']}")


def extract_file(members: DataFrame, name: str) -> DataFrame:
    """Members of exactly this name, with ``target``, the bare file name."""
    found = members.where(F.col("name") == name)
    if found.isEmpty():
        raise KeyError(name)
    return found.withColumn("target", text.basename(F.col("name")))


def remove(members: DataFrame, names: Sequence[str] | DataFrame) -> DataFrame:
    """All other members.  With a list, names that no archive has raise."""
    if isinstance(names, DataFrame):
        return members.join(names.select("name"), "name", "left_anti").select(*members.columns)
    there = {r["name"] for r in members.where(F.col("name").isin(*names)).select("name").distinct().collect()}
    if missing := sorted(set(names) - there):
        raise KeyError(missing)
    return members.where(~F.col("name").isin(*names))


def add(members: DataFrame, files: DataFrame) -> DataFrame:
    """``files`` after the archive's members; a name that is there becomes ``<stem>_dup<suffix>``.

    Further files of one name get ``_dup2``, ``_dup3`` and so on.
    """
    there = members.select("archive", "name", F.lit(True).alias("taken")).distinct()
    last = members.groupBy("archive").agg((F.max("ord") + 1).alias("next"))
    bare = text.basename(F.col("name"))
    ending = F.regexp_extract(bare, r".(\.[^.]+)$", 1)
    again = F.row_number().over(Window.partitionBy("archive", "name").orderBy("ord"))
    number = F.when(F.col("again") == 1, "").otherwise(F.col("again").cast("string"))
    new = files.join(there, ["archive", "name"], "left").join(last, "archive", "left").withColumn("again", again)
    name = F.when(F.col("taken"), F.concat(text.stem(F.col("name")), F.lit("_dup"), number, ending)).otherwise(F.col("name"))
    added = new.withColumn("name", name).withColumn("ord", F.col("ord") + F.coalesce("next", F.lit(0)))
    return members.unionByName(added.select(*(c for c in members.columns if c in added.columns)), allowMissingColumns=True)


def merge(archives: DataFrame, target: str) -> DataFrame:
    """Members of all archives in one, in order of archive and place; duplicates stay."""
    placed = ranked(archives, [F.col("archive"), F.col("ord")])
    return placed.withColumns({"from_archive": F.col("archive"), "ord": F.col("pos"), "archive": F.lit(target)}).drop("pos")


def split_by_size(members: DataFrame, limit: int) -> DataFrame:
    """Adds ``part`` (from 1): members go to the open part in order until the next does not fit.

    A part that has members is closed when the next does not fit, be they all
    empty; so a member larger than ``limit`` has a part of its own.  The running sum
    depends on every earlier cut, so an archive is folded by one task, which
    reads only places and sizes.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        archive, part, used, count = None, 0, 0, 0
        for batch in batches:
            parts = []
            for a, size in zip(batch["archive"], batch["compress_size"]):
                if a != archive:
                    archive, part, used, count = a, 1, 0, 0
                elif used + size > limit and count:
                    part, used, count = part + 1, 0, 0
                used, count = used + size, count + 1
                parts.append(part)
            yield pd.DataFrame({"archive": batch["archive"], "ord": batch["ord"], "part": parts})

    sizes = members.select("archive", "ord", "compress_size").repartition("archive").sortWithinPartitions(*KEY)
    parts = sizes.mapInPandas(fold, "archive string, ord bigint, part bigint")
    return members.join(parts, list(KEY))


def part_name(archive: Column, part: Column) -> Column:
    return F.concat(text.stem(archive), F.format_string("_part_%03d", part), F.lit(".zip"))
