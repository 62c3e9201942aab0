"""ZIP archives as a Spark data source, and the sink that writes them.

``spark.read.format("zip").load(path)`` gives a row for each member; ``path``
is an archive or a folder of archives that executors can open.  Contents are
read only if ``content`` is asked for with the option ``content=true`` (the
default); equality filters on ``name`` skip other members before they are read.
"""

from __future__ import annotations

import posixpath
import zipfile
from collections.abc import Iterator, Sequence
from contextlib import ExitStack

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition

from .. import validate
from . import files

SCHEMA = "archive string, ord bigint, name string, file_size bigint, compress_size bigint, crc bigint, content binary"
#: Members in one partition, at most.
SLICE = 1000


class _Slice(InputPartition):
    def __init__(self, path: str, first: int, last: int) -> None:
        self.path, self.first, self.last = path, first, last


class ZipReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.content = str(options.get("content", "true")).lower() == "true"
        self.name: str | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("name",):
                self.name = f.value
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        paths = [p for p in files.children(self.path) if p.endswith(".zip")] if files.kind(self.path) == "folder" else [self.path]
        out = []
        for path in paths:
            with files.open_archive(validate.archive_path(path)) as z:
                n = len(z.infolist())
            out += [_Slice(path, a, min(a + SLICE, n)) for a in range(0, n, SLICE)]
        return out

    def read(self, partition: _Slice) -> Iterator[tuple]:
        with files.open_archive(partition.path) as z:
            members = z.infolist()
            for k in range(partition.first, partition.last):
                m = members[k]
                if self.name is None or m.filename == self.name:
                    content = z.open(m).read() if self.content and not m.is_dir() else None  # by entry: names may repeat
                    yield (posixpath.basename(partition.path), k, m.filename, m.file_size, m.compress_size, m.CRC, content)


class ZipSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "zip"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ZipReader(self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ZipSource)


def read(spark: SparkSession, path: str, content: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("zip").option("content", str(content).lower()).load(path)


def write(members: DataFrame, folder: str, overwrite: bool = False) -> list[str]:
    """One archive for each value of ``archive``; each is written by one task, member by member.

    Targets are looked at before anything is written.  An archive is written beside its target and
    then moved there, so a task that is run again replaces what the lost one left.
    """
    if not overwrite:
        for r in members.select("archive").distinct().toLocalIterator():
            if files.kind(files.join(folder, validate.archive_path(r["archive"]))):
                raise FileExistsError(f"exists already: {files.join(folder, r['archive'])}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[str] = []
        with ExitStack() as stack:
            z = None
            for batch in batches:
                for archive, name, content in zip(*(batch.column(i).to_pylist() for i in range(3))):
                    if not done or archive != done[-1]:
                        stack.close()
                        out = stack.enter_context(files.replacing(files.join(folder, validate.archive_path(archive))))
                        z = stack.enter_context(zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED))
                        done.append(archive)
                    z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), content or b"", zipfile.ZIP_DEFLATED)
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], ["archive"])

    rows = members.select("archive", "name", "content", "ord").repartition("archive").sortWithinPartitions("archive", "ord")
    return [r["archive"] for r in rows.select("archive", "name", "content").mapInArrow(run, "archive string").collect()]


def compress(spark: SparkSession, source: str, target: str, overwrite: bool = False) -> str:
    """A file or folder as an archive; names are relative to its parent, in order of path."""
    root, kind = str(source).rstrip("/"), files.kind(source)
    found = files.below(root) if kind == "folder" else [""] if kind else []
    if not found:
        raise FileNotFoundError(source)
    folder, _, name = validate.archive_path(target).rpartition("/")
    own = posixpath.basename(files.locate(root)[1])
    names = spark.createDataFrame([(name, k, posixpath.join(own, x).rstrip("/"), files.join(root, x) if x else root) for k, x in enumerate(found)], "archive string, ord bigint, name string, path string")

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                yield pa.RecordBatch.from_arrays([*(one.column(i) for i in range(3)), pa.array([files.read(one.column(3)[0].as_py())], pa.binary())], ["archive", "ord", "name", "content"])

    write(names.mapInArrow(load, "archive string, ord bigint, name string, content binary"), folder or ("/" if target.startswith("/") else "."), overwrite)
    return target


def extract(members: DataFrame, folder: str, overwrite: bool = False, flat: bool = False, names: DataFrame | None = None) -> int:
    """Write members as files below ``folder``; how many.

    Names that leave the folder and, without ``overwrite``, files that exist raise before anything is
    written; ``names(name)`` spares that look the contents.  Tasks that are run again write their files again.  Of members
    with one name the last of their slice of ``SLICE`` remains, and of several slices any.
    """

    def target(name: str) -> str:
        at = posixpath.normpath(posixpath.basename(name) if flat else name.replace("\\", "/"))
        if at.startswith(("/", "../")) or at in ("..", "."):
            raise ValueError(f"outside the folder: {name}")
        return files.join(folder, at)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                at = target(name)
                if not overwrite and not name.endswith("/") and files.kind(at):
                    raise FileExistsError(f"exists already: {at}")
        yield pa.RecordBatch.from_arrays([pa.array([], pa.int64())], ["n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if name.endswith("/"):
                    files.make(target(name))
                    continue
                with files.replacing(target(name)) as out:
                    out.write(content or b"")
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    (members if names is None else names).select("name").mapInArrow(check, "n long").count()
    return sum(r["n"] for r in members.select("name", "content").mapInArrow(run, "n long").collect())
