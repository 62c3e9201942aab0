"""Files by path or URI, on the driver and in tasks: local folders, HDFS, S3, GCS.

A file is written beside its target and then moved there, so a task that is run
again replaces what a lost one left.
"""

from __future__ import annotations

import os
import posixpath
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyarrow import fs as arrow_fs


def locate(path: str) -> tuple[arrow_fs.FileSystem, str]:
    """The filesystem of a path or URI, and the path there."""
    path = str(path)
    if path.startswith("file:/") and not path.startswith("file://"):  # as Spark writes local URIs
        path = path[len("file:") :]
    system, at = arrow_fs.FileSystem.from_uri(path if "://" in path else os.path.abspath(path))
    return system, at.rstrip("/") or "/"


def kind(path: str) -> str | None:
    """``file``, ``folder`` or None."""
    system, at = locate(path)
    found = system.get_file_info(at).type
    return {arrow_fs.FileType.File: "file", arrow_fs.FileType.Directory: "folder"}.get(found)


def size(path: str) -> int:
    system, at = locate(path)
    return system.get_file_info(at).size


def folders(path: str) -> list[str]:
    """Names of the folders directly below, in order."""
    system, at = locate(path)
    return sorted(posixpath.basename(x.path) for x in system.get_file_info(arrow_fs.FileSelector(at)) if x.type == arrow_fs.FileType.Directory)


def children(path: str) -> list[str]:
    """Files directly below a folder, in order."""
    system, at = locate(path)
    return sorted(join(path, posixpath.basename(x.path)) for x in system.get_file_info(arrow_fs.FileSelector(at)) if x.type == arrow_fs.FileType.File)


def below(folder: str) -> list[str]:
    """Files at any depth below a folder by their paths from there, in order of the paths' parts."""
    system, at = locate(folder)
    found = system.get_file_info(arrow_fs.FileSelector(at, recursive=True))
    return sorted((posixpath.relpath(x.path, at) for x in found if x.type == arrow_fs.FileType.File), key=lambda x: x.split("/"))


def make(folder: str) -> None:
    system, at = locate(folder)
    system.create_dir(at, recursive=True)


def read(path: str) -> bytes:
    system, at = locate(path)
    with system.open_input_stream(at) as f:
        return f.read()


def join(folder: str, *names: str) -> str:
    return "/".join([str(folder).rstrip("/"), *names])


def beside(path: str) -> str:
    """A fresh hidden name next to a path."""
    folder, _, name = str(path).rstrip("/").rpartition("/")
    return f"{folder + '/' if folder or str(path).startswith('/') else ''}.{name}.{uuid.uuid4().hex}"


@contextmanager
def replacing(path: str) -> Iterator[pa.NativeFile]:
    """A stream whose content is at ``path`` once the block has ended well."""
    system, at = locate(path)
    fresh = beside(at)
    system.create_dir(posixpath.dirname(at), recursive=True)
    try:
        with system.open_output_stream(fresh) as out:
            yield out
        system.move(fresh, at)
    except BaseException:
        if system.get_file_info(fresh).type != arrow_fs.FileType.NotFound:
            system.delete_file(fresh)
        raise


def delete(path: str) -> None:
    system, at = locate(path)
    if kind(path) == "folder":
        system.delete_dir(at)
    elif kind(path):
        system.delete_file(at)


def replace(fresh: str, target: str) -> None:
    """Move a finished folder to where the target was."""
    delete(target)
    system, at = locate(target)
    system.create_dir(posixpath.dirname(at), recursive=True)
    system.move(locate(fresh)[1], at)


def open_archive(path: str) -> zipfile.ZipFile:
    system, at = locate(path)
    return zipfile.ZipFile(system.open_input_file(at))


class Reader:
    """Contents of files and of archive members; one archive is open at a time."""

    def __init__(self) -> None:
        self.path, self.archive = None, None

    def _open(self, src: str) -> zipfile.ZipFile:
        if src != self.path:
            self.path, self.archive = src, open_archive(src)
        return self.archive

    def names(self, src: str) -> dict[str, int]:
        """Members by name; of several with one name the last, as extraction leaves it."""
        return {m.filename: k for k, m in enumerate(self._open(src).infolist())}

    def get(self, src: str, member: int | None) -> bytes:
        if member is None:
            return read(src)
        archive = self._open(src)
        return archive.open(archive.infolist()[member]).read()
