"""Listings read by tasks: directories, and pages of remote sources.

A directory tree is walked by as many tasks as its upper levels have directories; a remote listing by one task a source,
page by page until a short one. Bounds on entries, depth and pages hold inside the readers, which fail rather than cut.
"""

from __future__ import annotations

import datetime
import os
import stat
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from siltwork.functions.checks import BoundExceeded

ENTRIES = "path string, name string, depth int, size long, modified timestamp, content binary"
#: Directories are opened on the driver until there are so many to deal out.
DEALT = 64


class _Folder(InputPartition):
    def __init__(self, path: str, whole: bool) -> None:
        self.path, self.whole = path, whole


class Tree(DataSource):
    """Regular files below ``root``: no links, in the order of names. Options: root, max_entries, max_depth, max_bytes (of a file's content), prune (directory names, by /)."""

    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return ENTRIES

    def reader(self, schema) -> DataSourceReader:
        return _TreeReader(self.options)


class _TreeReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root = options["root"].removeprefix("file://").rstrip("/") or "/"
        self.max_entries, self.max_depth, self.max_bytes = (int(options.get(k, d)) for k, d in (("max_entries", 100_000), ("max_depth", 64), ("max_bytes", 500 << 10)))
        self.prune = {n.lower() for n in options.get("prune", "").split("/") if n}

    def _children(self, folder: str) -> tuple[list[str], list[str]]:
        """(directories, files) of a folder by name; links and special files are in neither."""
        folders, plain = [], []
        with os.scandir(folder) as entries:
            for e in sorted(entries, key=lambda e: os.fsencode(e.name)):
                if e.is_dir(follow_symlinks=False):
                    if e.name.lower() not in self.prune:
                        folders.append(e.path)
                elif e.is_file(follow_symlinks=False):
                    plain.append(e.path)
        return folders, plain

    def partitions(self) -> list[InputPartition]:
        if os.path.islink(self.root) or not os.path.isdir(self.root):
            raise NotADirectoryError(self.root)
        whole, alone = [self.root], []
        for _ in range(3):  # the upper levels only, and only as far as they are narrow
            if len(whole) >= DEALT:
                break
            below = [f for d in whole for f in self._children(d)[0]]
            if not below or len(below) > 16 * DEALT:
                break
            whole, alone = below, alone + whole
        return [_Folder(d, False) for d in alone] + [_Folder(d, True) for d in whole]

    def read(self, partition: _Folder) -> Iterator[tuple]:
        seen, waiting = 0, [partition.path]
        while waiting:
            folders, plain = self._children(waiting.pop())
            seen += len(folders) + len(plain)
            if seen > self.max_entries:
                raise BoundExceeded(f"directory entries: more than {self.max_entries}")
            for path in plain:
                inner = os.path.relpath(path, self.root)
                depth = inner.count(os.sep)
                if depth > self.max_depth:
                    raise BoundExceeded(f"depth: more than {self.max_depth}")
                s = os.lstat(path)
                if stat.S_ISREG(s.st_mode):
                    content = open(path, "rb").read() if s.st_size <= self.max_bytes else None
                    yield inner, os.path.basename(path), depth, s.st_size, datetime.datetime.fromtimestamp(s.st_mtime), content
            if partition.whole:
                waiting += reversed(folders)


def tree(spark: SparkSession, root: str, **options) -> DataFrame:
    """path, name, depth, size, modified, content (null of a file over ``max_bytes``) of the files below a directory that all executors see."""
    spark.dataSource.register(Tree)
    reader = spark.read.format("tree").option("root", root)
    for name, value in options.items():
        reader = reader.option(name, value)
    return reader.load()


class _Source(InputPartition):
    def __init__(self, source: str) -> None:
        self.source = source


def paged(spark: SparkSession, sources: list[str], fetch: Callable[[str, int], list[dict]], schema: str, valid: Column | None = None, page_size: int = 100, most_pages: int = 10, most_sources: int = 20) -> DataFrame:
    """source and the columns of ``schema`` of all items that fetch(source, page) lists; pages count from 1 until one is short. A
    source of more than ``most_pages`` full pages, or more sources than ``most_sources``, fail. Items that break ``valid``, or
    are not of the schema, are left out."""
    if len(sources) > most_sources:
        raise BoundExceeded(f"sources: more than {most_sources}")
    from pyspark.sql.types import _parse_datatype_string

    fields = [f.name for f in _parse_datatype_string(schema).fields]
    kinds = {f.name: f.dataType.simpleString() for f in _parse_datatype_string(schema).fields}
    plain = {"string": str, "bigint": int, "int": int, "boolean": bool, "double": float}

    def fits(item) -> bool:
        return isinstance(item, dict) and all(item.get(n) is None or kinds[n] not in plain or type(item[n]) is plain[kinds[n]] for n in fields)

    columns = f"source string, {schema}"

    class Pages(DataSource):
        @classmethod
        def name(cls) -> str:
            return "pages"

        def schema(self) -> str:
            return columns

        def reader(self, schema) -> DataSourceReader:
            return Reader()

    class Reader(DataSourceReader):
        def partitions(self) -> list[InputPartition]:
            return [_Source(s) for s in sources]

        def read(self, partition: _Source) -> Iterator[tuple]:
            for page in range(1, most_pages + 2):
                items = fetch(partition.source, page)
                if page > most_pages:
                    if items:
                        raise BoundExceeded(f"{partition.source}: more than {most_pages} pages")
                    return
                for item in items:
                    if fits(item):
                        yield (partition.source, *[item.get(n) for n in fields])
                if len(items) < page_size:
                    return

    spark.dataSource.register(Pages)
    out = spark.read.format("pages").load()
    return out if valid is None else out.where(F.coalesce(valid, F.lit(False)))
