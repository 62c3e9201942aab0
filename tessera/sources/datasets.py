"""Labelled image datasets from source to target.

A source is a folder or a ZIP archive with ``images/``, ``labels/`` and
``data.yaml``; a target is a folder or archives.  The plan of what goes where is
a table of paths; images never pass through it, but go from storage to storage
in the tasks that write them.  Label texts are small and are rewritten as
expressions.  A target is made beside its place and moved there at the end.

Cases: of files that come to the same name the last in order of path (after a
shuffle: of place) stays; label lines that begin with no number stay where
classes are remapped and go where they are split by class.
"""

from __future__ import annotations

import zipfile
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import pyarrow as pa
import yaml
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import validate
from ..functions import text
from ..operators import annotations
from . import files

#: What ``data.yaml`` of an archive says of its place.
ARCHIVE_ROOT = "/content/data"
ROW = "archive string, dst string, src string, member bigint, text string"


@dataclass
class Dataset:
    """``listing(path, src, member)``: files below the root, and where their content is."""

    spark: SparkSession
    source: str
    listing: DataFrame
    settings: dict

    @property
    def names(self) -> list[str]:
        return [name for _, name in annotations.class_table(self.settings.get("names"))]

    def pairs(self) -> DataFrame:
        """(rel_path, split, stem, expected, label_rel_path) of all images."""
        images = annotations.scan_images(self.listing.where(F.col("path").startswith("images/")).select("path")).drop("path")
        labels = self.listing.where(F.col("path").startswith("labels/")).select(F.expr("substring(path, 8)").alias("rel_path"))
        return annotations.pair_labels(images, labels)

    def texts(self) -> DataFrame:
        """(label_rel_path, text) of all label files; bytes that are no UTF-8 are left out."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            reader = files.Reader()
            for batch in batches:
                found = [reader.get(src, member).decode("utf-8", "ignore") for src, member in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], ["label_rel_path", "text"])

        labels = self.listing.where(F.col("path").startswith("labels/")).select(F.expr("substring(path, 8)").alias("label_rel_path"), "src", "member")
        return labels.mapInArrow(run, "label_rel_path string, text string")


def open_dataset(spark: SparkSession, source: str) -> Dataset:
    kind = files.kind(source)
    if kind is None:
        raise FileNotFoundError(f"no such source: {source}")
    if kind == "file":
        return _open_archive(spark, validate.archive_path(str(source)))
    root = source
    if files.kind(files.join(source, "data.yaml")) is None:
        root = next((files.join(source, x) for x in files.folders(source) if files.kind(files.join(source, x, "data.yaml"))), source)
    if files.kind(files.join(root, "images")) != "folder":
        raise FileNotFoundError(f"no images folder in {root}")
    settings = files.join(root, "data.yaml")
    return Dataset(spark, root, folder_listing(spark, root), (yaml.safe_load(files.read(settings)) or {}) if files.kind(settings) else {})


def folder_listing(spark: SparkSession, root: str) -> DataFrame:
    """(path, src, member) of all files below a folder; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(root)).select(F.col("path").alias("src"))
    at = files.locate(root)[1]
    rel = F.expr("substring(src, instr(src, '{0}/') + {1})".format(at.replace("'", "\\'"), len(at) + 1))
    return found.select(rel.alias("path"), "src", F.lit(None).cast("bigint").alias("member"))


def archive_listing(spark: SparkSession, names: Mapping[str, int], source: str, prefix: str = "") -> DataFrame:
    """(path, src, member) of an archive's files below ``prefix``."""
    own = {x[len(prefix) :]: k for x, k in names.items() if x.startswith(prefix) and not x.endswith("/")}
    rows = pa.table({"path": pa.array(list(own), pa.string()), "member": pa.array(list(own.values()), pa.int64())})
    return spark.createDataFrame(rows).select("path", F.lit(str(source)).alias("src"), "member")


def _open_archive(spark: SparkSession, source: str) -> Dataset:
    reader = files.Reader()
    names = reader.names(source)
    tops = sorted({x.split("/")[0] for x in names if x.count("/") == 1 and x.endswith("/data.yaml")})
    prefix = "" if "data.yaml" in names or not tops else f"{tops[0]}/"
    if not any(x.startswith(f"{prefix}images/") for x in names):
        raise FileNotFoundError(f"no images folder in {source}")
    settings = names.get(f"{prefix}data.yaml")
    return Dataset(spark, source, archive_listing(spark, names, source, prefix), {} if settings is None else yaml.safe_load(reader.get(source, settings)) or {})


# -- writing --------------------------------------------------------------
def _rows(data: Dataset, moves: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """Files to write for ``moves(archive, pos, rel_path, image_dst, label_rel_path, label_dst)``.

    ``texts(archive, label_rel_path, text)`` replaces the labels' content.  A null ``label_dst`` is no file.
    """
    image = moves.select("archive", "pos", F.concat(F.lit("images/"), "rel_path").alias("path"), F.col("image_dst").alias("dst"))
    label = moves.where("label_rel_path is not null and label_dst is not null").select("archive", "pos", "label_rel_path", F.concat(F.lit("labels/"), "label_rel_path").alias("path"), F.col("label_dst").alias("dst"))
    if texts is None:
        label = label.withColumn("text", F.lit(None).cast("string"))
    else:
        label = label.join(texts, ["archive", "label_rel_path"], "left")
    every = image.withColumn("text", F.lit(None).cast("string")).unionByName(label.drop("label_rel_path")).join(data.listing, "path")
    last = every.groupBy("archive", "dst").agg(F.max_by(F.struct("src", "member", "text"), F.struct("pos", "path")).alias("r"))
    return last.select("archive", "dst", "r.*")


def _settings_row(spark: SparkSession, settings: Mapping, archive: str = "") -> DataFrame:
    return spark.createDataFrame([(archive, "data.yaml", None, None, yaml.safe_dump(dict(settings), allow_unicode=True, sort_keys=False))], ROW)


def _content(reader: files.Reader, src, member, body) -> bytes:
    return body.encode() if body is not None else reader.get(src, member)


def put_files(rows: DataFrame, folder: str) -> None:
    """Each file by the task that has its row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, n = files.Reader(), 0
        for batch in batches:
            for dst, src, member, body in zip(*(batch.column(i).to_pylist() for i in range(4))):
                with files.replacing(files.join(folder, dst)) as out:
                    out.write(_content(reader, src, member, body))
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows.select("dst", "src", "member", "text").repartition(width, "dst").mapInArrow(run, "n long").agg(F.sum("n")).collect()


def put_archives(rows: DataFrame, folder: str, order: str = "dst") -> list[str]:
    """An archive for each value of ``archive``, by one task each, its files in order of name or another column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, done, current, stack = files.Reader(), [], None, None

        def close() -> None:
            if stack:
                stack[1].close()
                stack[0].__exit__(None, None, None)
                done.append(current)

        for batch in batches:
            for archive, dst, src, member, body in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if archive != current:
                    close()
                    current = archive
                    writing = files.replacing(files.join(folder, archive))
                    stack = (writing, zipfile.ZipFile(writing.__enter__(), "w", zipfile.ZIP_DEFLATED))
                stack[1].writestr(zipfile.ZipInfo(dst, (1980, 1, 1, 0, 0, 0)), _content(reader, src, member, body), zipfile.ZIP_DEFLATED)
        close()
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], ["archive"])

    dealt = rows.repartition("archive").sortWithinPartitions("archive", order).select("archive", "dst", "src", "member", "text")
    return sorted(r["archive"] for r in dealt.mapInArrow(run, "archive string").collect())


def _commit(data: Dataset, rows: DataFrame, settings: Mapping | None, target: str, overwrite: bool) -> None:
    if files.kind(target) and not overwrite:
        raise FileExistsError(target)
    if settings is not None:
        rows = rows.unionByName(_settings_row(data.spark, settings))
    if str(target).lower().endswith(".zip"):
        folder, _, name = str(target).rpartition("/")
        put_archives(rows.withColumn("archive", F.lit(name)), folder or ".")
        return
    fresh = files.beside(target)
    try:
        put_files(rows, fresh)
    except BaseException:
        files.delete(fresh)
        raise
    files.replace(fresh, target)


def _absolute(target: str) -> str:
    return files.locate(target)[1] if "://" not in str(target) else str(target)


def _moves(pairs: DataFrame, image_dst: Column, label_dst: Column, pos: Column, archive: Column | None = None) -> DataFrame:
    return pairs.select((F.lit("") if archive is None else archive).alias("archive"), pos.alias("pos"), "rel_path", image_dst.alias("image_dst"), "label_rel_path", label_dst.alias("label_dst"))


def _ordered(pairs: DataFrame, ratios: Sequence[float], seed: int, like_python: bool, split_of) -> DataFrame:
    """``pairs`` in shuffled order, by Python's own shuffle or by digests of their paths."""
    return split_of(pairs, ["rel_path"], ratios, seed) if like_python else annotations.partition(pairs, "rel_path", ratios, seed)


# -- transforms -----------------------------------------------------------
def partition(spark: SparkSession, source: str, target: str, ratios: Sequence[float], overwrite: bool = False, seed: int = 42, like_python: bool = True) -> None:
    """The dataset in ``images/<split>`` and ``labels/<split>`` folders, split by shares.

    ``like_python`` shuffles as ``random.Random(seed).shuffle`` does, with 16 bytes an image on
    the driver; without, images are ordered by a digest of seed and path.
    """
    validate.partition_ratios(ratios)
    data = open_dataset(spark, source)
    dealt = _ordered(data.pairs(), ratios, seed, like_python, annotations.partition_like_python)
    name, label = text.basename(F.col("rel_path")), text.basename(F.col("label_rel_path"))
    moves = _moves(dealt, F.concat_ws("/", F.lit("images"), "split", name), F.concat(F.lit("labels/"), "split", F.lit("/"), label), F.col("pos"))
    settings = None
    if data.settings:
        n_test = annotations.cuts(dealt.count(), ratios)[2]
        settings = {**data.settings, "path": _absolute(target), "train": "images/train", "val": "images/val", "test": "images/test"}
        if not n_test:
            del settings["test"]
    _commit(data, _rows(data, moves), settings, target, overwrite)


repartition = partition  # earlier splits are ignored; the target may be the source


def unpartition(spark: SparkSession, source: str, target: str, overwrite: bool = False) -> None:
    """All images side by side in ``images/``, labels in ``labels/``."""
    data = open_dataset(spark, source)
    moves = _moves(data.pairs(), F.concat(F.lit("images/"), text.basename(F.col("rel_path"))), F.concat(F.lit("labels/"), text.basename(F.col("label_rel_path"))), F.col("rel_path"))
    names = data.settings.get("names") or []
    root = _absolute(target).rpartition("/")[0] if str(target).lower().endswith(".zip") else _absolute(target)
    _commit(data, _rows(data, moves), {"path": root, "train": "images", "val": "", "test": "", "nc": len(names), "names": names}, target, overwrite)


def merge(spark: SparkSession, sources: Sequence[str], target: str, overwrite: bool = False) -> None:
    """One archive of several datasets: class names united in order of appearance, files named ``src<k>_...``."""
    validate.merge_sources(sources)
    validate.archive_path(str(target))
    if files.kind(target) and not overwrite:
        raise FileExistsError(target)
    data = [open_dataset(spark, x) for x in sources]
    union = list(dict.fromkeys(name for d in data for name in d.names))
    rows = _settings_row(spark, {"path": ARCHIVE_ROOT, "train": "images/train", "val": "images/val", "nc": len(union), "names": union})
    for k, d in enumerate(data):
        ids = {i: union.index(name) for i, name in enumerate(d.names)}
        flat = lambda c, k=k: F.concat(F.lit(f"src{k}_"), F.replace(F.col(c), F.lit("/"), F.lit("_")))
        moves = _moves(d.pairs(), F.concat(F.lit("images/"), flat("rel_path")), F.concat(F.lit("labels/"), flat("expected")), F.col("rel_path"))
        texts = None if all(a == b for a, b in ids.items()) else _remapped(d, ids)
        rows = rows.unionByName(_rows(d, moves, texts))
    folder, _, name = str(target).rpartition("/")
    put_archives(rows.withColumn("archive", F.lit(name)), folder or ".")


def _lines(body: Column) -> Column:
    """Lines of a text; a final newline ends the last."""
    return F.split(F.regexp_replace(body, r"\r?\n\z", ""), r"\r?\n")


def _remapped(data: Dataset, ids: Mapping[int, int]) -> DataFrame:
    lines = F.transform(_lines(F.col("text")), lambda line: annotations.remap_line(line, ids))
    return data.texts().select(F.lit("").alias("archive"), "label_rel_path", F.when(F.col("text") == "", "").otherwise(F.concat(F.array_join(lines, "\n"), F.lit("\n"))).alias("text"))


def _kept(lines: Column, ids: Mapping[int, int]) -> Column:
    """The lines of these classes, under their new ids."""
    own = F.filter(lines, lambda line: F.coalesce(annotations.first_number(line).isin(*ids), F.lit(False)))
    return F.transform(own, lambda line: annotations.remap_line(line, ids))


def split(spark: SparkSession, source: str, folder: str, by_class: bool = False, ratios: Sequence[float] | None = None, class_groups: Sequence[Sequence[str]] | None = None, overwrite: bool = False, seed: int = 42, like_python: bool = True) -> list[str]:
    """An archive for each class, group of classes or share in ``folder``; their names.

    Groups come before ``by_class`` and that before ``ratios``.  A group's archive has the
    images with a box of its classes, with these boxes only; none is made without images.
    """
    validate.split_mode(by_class, ratios, class_groups)
    data = open_dataset(spark, source)
    names = data.names
    if class_groups is None and not by_class:
        archives = [f"split_part_{k}.zip" for k in range(len(validate.split_ratios(ratios)))]
        _absent(folder, archives, overwrite)
        dealt = annotations.split_like_python(data.pairs(), ["rel_path"], ratios, seed) if like_python else annotations.split_by_ratio(data.pairs(), "rel_path", ratios, seed)
        moves = _moves(dealt, F.concat(F.lit("images/"), text.basename(F.col("rel_path"))), F.concat(F.lit("labels/"), text.basename(F.col("label_rel_path"))), F.col("pos"), F.format_string("split_part_%d.zip", F.col("part").cast("int")))
        rows = _rows(data, moves)
        classes = dict.fromkeys(archives, names)
    else:
        groups = [list(g) for g in class_groups] if class_groups is not None else [[n] for n in names]
        archives = [f"split_{g[0]}.zip" if len(g) == 1 else f"split_group_{k}.zip" for k, g in enumerate(groups)]
        _absent(folder, archives, overwrite)
        classes = dict(zip(archives, groups))
        texts = None
        for archive, group in classes.items():
            kept = _kept(_lines(F.col("text")), {i: group.index(n) for i, n in enumerate(names) if n in group})
            own = data.texts().select(F.lit(archive).alias("archive"), "label_rel_path", kept.alias("kept")).where(F.size("kept") > 0).select("archive", "label_rel_path", F.concat(F.array_join("kept", "\n"), F.lit("\n")).alias("text"))
            texts = own if texts is None else texts.unionByName(own)
        texts = texts if texts is not None else spark.createDataFrame([], "archive string, label_rel_path string, text string")
        matched = data.pairs().join(texts.select("archive", "label_rel_path"), "label_rel_path")
        moves = _moves(matched, F.concat(F.lit("images/"), text.basename(F.col("rel_path"))), F.concat(F.lit("labels/"), F.col("stem"), F.lit(".txt")), F.col("rel_path"), F.col("archive"))
        rows = _rows(data, moves, texts)
        made = {r["archive"] for r in moves.select("archive").distinct().collect()}  # a row for each group
        classes = {a: g for a, g in classes.items() if a in made}
    for archive, listed in classes.items():
        rows = rows.unionByName(_settings_row(spark, {"path": ARCHIVE_ROOT, "train": "images/train", "val": "images/val", "nc": len(listed), "names": list(listed)}, archive))
    return put_archives(rows, folder) if classes else []


def _absent(folder: str, names: Sequence[str], overwrite: bool) -> None:
    there = [x for x in names if files.kind(files.join(folder, x))]
    if there and not overwrite:
        raise FileExistsError(files.join(folder, there[0]))


def remap_classes(spark: SparkSession, source: str, target: str, class_map: Mapping, overwrite: bool = False) -> None:
    """The dataset with classes renamed (values that are names) or moved (values that are ids)."""
    data = open_dataset(spark, source)
    names = data.names
    moves_of = validate.class_map(class_map, names)
    ids = {i: i for i in range(len(names))}
    called = dict(enumerate(names))
    for key, value in class_map.items():  # an id may be named and moved by two entries
        old = names.index(key) if isinstance(key, str) else key
        if isinstance(value, str):
            called[old] = value
        else:
            ids[old] = value
    table = {ids[i]: called[i] for i in sorted(moves_of.keys() | ids.keys())}
    listed = [table[i] for i in range(len(table))] if sorted(table) == list(range(len(table))) else table
    is_zip = str(target).lower().endswith(".zip")
    settings = {**data.settings, "path": ARCHIVE_ROOT if is_zip else _absolute(target), "nc": max(table, default=-1) + 1, "names": listed}
    moves = _moves(data.pairs(), F.concat(F.lit("images/"), "rel_path"), F.concat(F.lit("labels/"), "expected"), F.col("rel_path"))
    texts = None if all(a == b for a, b in ids.items()) else _remapped(data, ids)
    _commit(data, _rows(data, moves, texts), settings, target, overwrite)


def dataset_info(spark: SparkSession, source: str) -> dict:
    """classes, nc, total_images, total_labels, unlabeled_images and splits with their counts."""
    data = open_dataset(spark, source)
    row = annotations.dataset_info(data.pairs()).first().asDict()
    splits = {s: row.pop(s) for s in (*annotations.SPLITS, "raw")}
    return {"classes": data.names, "nc": len(data.names), **row, "splits": {s: n for s, n in splits.items() if n}}
