"""The files of a directory tree, listed by tasks.

A level of directories at a time is dealt out to tasks. Names are handed on in pages as they come from the file system, so a
flat directory of any size needs no more memory than a page, and what has to be asked about each name (is it a link,
its length and time) is asked by other tasks: pages are dealt out again before their names are looked at. Links are
listed as what they are, neither entered nor read, so a loop of links gives each file once.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator
from itertools import islice
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.plans.workspace import kept, ship
from marginalia.rules import root_path

#: Names in a page.
PAGE = 2_000
_PAGES = "place string, rel_path string, names array<string>"
_ENTRIES = "place string, rel_path string, is_dir boolean, length long, modified timestamp"


def local(root: str) -> str:
    """``file:/a`` and ``file:///a`` -> ``/a``; other roots stay as they are."""
    return unquote(root_path(root)) if root.startswith("file:") else root


def file_system(root: str):
    """The file system of a root, and the root's place in it."""
    from pyarrow import fs

    return (fs.LocalFileSystem(), root) if root.startswith("/") else fs.FileSystem.from_uri(root)


def _names(system, place: str) -> Iterator[str]:
    """Names in a directory, one by one where the file system hands them out so."""
    from pyarrow import fs

    if isinstance(system, fs.LocalFileSystem):
        with os.scandir(place) as found:
            for entry in found:
                yield entry.name
    else:
        for info in system.get_file_info(fs.FileSelector(place)):
            yield info.base_name


def _below(folder: str, name: str) -> str:
    return f"{folder.rstrip('/')}/{name}" if folder else name


def _entries(system, places: list[str]) -> Iterable[tuple[str, bool, int | None, object]]:
    """place, whether it is a directory, length and time of change; links and what is neither file nor directory are left out."""
    from pyarrow import fs

    if isinstance(system, fs.LocalFileSystem):
        places = [p for p in places if not os.path.islink(p)]
    for info in system.get_file_info(places):
        if info.type in (fs.FileType.File, fs.FileType.Directory):
            is_dir = info.type == fs.FileType.Directory
            yield info.path, is_dir, None if is_dir else info.size, info.mtime


def _batch(rows: list[tuple], names: list[str], kinds: list):
    import pyarrow as pa

    cols = list(zip(*rows, strict=True)) or [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)


def listed(spark: SparkSession, root: str, recursive: bool = True, page: int = PAGE) -> DataFrame:
    """Files below the root: place, rel_path, length, modified. A root that does not exist is an error.

    The root itself may be a link or a single file. Below it links are left out, to files as well as to directories. A
    directory that is gone when it is looked into counts as empty.
    """
    ship(spark)
    root = local(root)
    open_fs = file_system

    def pages(batches: Iterator) -> Iterator:
        import pyarrow as pa

        system, _ = open_fs(root)
        kinds = [pa.string(), pa.string(), pa.list_(pa.string())]
        for b in batches:
            for place, rel in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    names = _names(system, place)
                    while some := list(islice(names, page)):
                        yield _batch([(place, rel, some)], ["place", "rel_path", "names"], kinds)
                except FileNotFoundError:
                    continue

    def looked_at(batches: Iterator) -> Iterator:
        import pyarrow as pa

        system, _ = open_fs(root)
        names = ["place", "rel_path", "is_dir", "length", "modified"]
        kinds = [pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.timestamp("us", "UTC")]
        for b in batches:
            for place, rel, own in zip(*[b.column(k).to_pylist() for k in range(3)], strict=True):
                paths = {_below(place, n) or n: _below(rel, n) for n in own}
                rows = [(at, paths[at], *rest) for at, *rest in _entries(system, list(paths))]
                yield _batch(rows, names, kinds)

    def start(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyarrow import fs

        system, place = open_fs(root)
        for _ in batches:
            own = system.get_file_info(place)
            if own.type == fs.FileType.NotFound:
                raise FileNotFoundError(place)
            is_dir = own.type == fs.FileType.Directory
            kinds = [pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.timestamp("us", "UTC")]
            yield _batch([(place.rstrip("/") or "/", "", is_dir, None if is_dir else own.size, own.mtime)], ["place", "rel_path", "is_dir", "length", "modified"], kinds)

    cores = spark.sparkContext.defaultParallelism
    found = kept(spark.range(0, 1, 1, 1).mapInArrow(start, _ENTRIES))
    files = found.where("not is_dir").drop("is_dir")
    level = found.where("is_dir").select("place", "rel_path")
    while True:
        size = level.count()
        if not size:
            return files
        named = kept(level.repartition(min(size, cores * 4), "place").mapInArrow(pages, _PAGES))
        number = max(1, min(named.count(), cores * 4))
        found = kept(named.repartition(number).mapInArrow(looked_at, _ENTRIES))
        files = files.unionAll(found.where("not is_dir").drop("is_dir"))
        if not recursive:
            return files
        level = found.where("is_dir").select("place", "rel_path")
