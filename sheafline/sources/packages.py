"""Office packages as a data source: ``spark.read.format("office_packages").option("table", "cells").load(folder)``.

Also from SQL: ``create temporary view c using office_packages options (path '...', table 'cells')``. Register it
once a session with ``register``.
"""

from __future__ import annotations

import posixpath
import zipfile
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import IntegerType, LongType, StringType, StructType

from . import ooxml

NAME = "office_packages"
DIAGNOSTICS = "file_id string, size long, package_type string, status string, error string, n_rows long"
#: Tables with their schemas, and the rows of a package for each; ``file_id`` is the file's path.
TABLES = {
    "cells": (ooxml.CELLS, lambda i, d: ooxml.workbook_rows(i, d, "cells")), "merges": (ooxml.MERGES, lambda i, d: ooxml.workbook_rows(i, d, "merges")),
    "attachments": (ooxml.ATTACHMENTS, lambda i, d: ooxml.workbook_rows(i, d, "attachments")), "layout": (ooxml.LAYOUT, ooxml.layout_rows), "blocks": (ooxml.BLOCKS, ooxml.document_rows),
    "diagnostics": (DIAGNOSTICS, None),
}
#: Parts that tell which kind of package a table is read from.
WORKBOOK, DOCUMENT = "xl/workbook.xml", "word/document.xml"
BROKEN = (zipfile.BadZipFile, KeyError, ET.ParseError, ValueError, EOFError, NotImplementedError, OSError)
ARROW = {StringType: pa.string(), IntegerType: pa.int32(), LongType: pa.int64()}


@dataclass
class Group(InputPartition):
    """Files that one task reads, with their sizes."""

    files: tuple[tuple[str, int], ...]


def grouped(files: Iterable[tuple[str, int]], target: int) -> list[Group]:
    """``files`` in order of path, in groups of about ``target`` bytes; an empty file counts as 4 KB, a larger one than ``target`` is alone."""
    groups: list[list[tuple[str, int]]] = []
    held = 0
    for path, size in sorted(files):
        cost = max(size, 4096)
        if not groups or held + cost > target:
            groups.append([])
            held = 0
        groups[-1].append((path, size))
        held += cost
    return [Group(tuple(g)) for g in groups]


def package_type(data: bytes) -> str:
    """``workbook``, ``document`` or ``other`` by the parts, whatever the ending is; raises where the directory can't be read."""
    with zipfile.ZipFile(pa.BufferReader(data)) as package:
        names = set(package.namelist())
    return "workbook" if WORKBOOK in names else "document" if DOCUMENT in names else "other"


def diagnosed(path: str, size: int, data: bytes) -> tuple:
    """The diagnostics row of a file: ``ok`` with its number of cells or blocks, ``unsupported``, or ``broken`` with the error."""
    kind = None
    try:
        kind = package_type(data)
        if kind == "other":
            return path, size, kind, "unsupported", None, 0
        rows = TABLES["cells" if kind == "workbook" else "blocks"][1](path, data)
        return path, size, kind, "ok", None, sum(1 for _ in rows)
    except BROKEN as e:
        return path, size, kind, "broken", f"{type(e).__name__}: {e}", 0


class Reader(DataSourceReader):
    """Reads groups of files. Only the columns of the asked schema are built; files that break have no rows here but one in ``diagnostics``."""

    def __init__(self, schema: StructType, options: dict[str, str]):
        self.table = options.get("table", "cells")
        self.names = [x.split()[0] for x in TABLES[self.table][0].split(", ")]
        unknown = [f.name for f in schema if f.name not in self.names]
        if unknown:
            raise ValueError(f"table {self.table} has no column {', '.join(unknown)}")
        self.fields = [(self.names.index(f.name), f.name, ARROW[type(f.dataType)]) for f in schema]
        self.path = options["path"]
        self.target = int(options.get("maxpartitionbytes", 128 << 20))
        self.batch = int(options.get("batchrows", 5000))
        self.wanted: set[str] | None = None

    def partitions(self) -> Sequence[InputPartition]:
        """The folder's files, below it to any depth, listed once; names that start with a dot, an underscore or ``~$`` are left out."""
        system, root = fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)
        found = [system.get_file_info(root)]
        if found[0].type == fs.FileType.Directory:
            found = system.get_file_info(fs.FileSelector(root, recursive=True))
        files = [(i.path, i.size) for i in found if i.type == fs.FileType.File and not posixpath.basename(i.path).startswith((".", "_", "~$"))]
        return grouped([f for f in files if self.wanted is None or f[0] in self.wanted], self.target) or [Group(())]

    def read(self, partition: Group) -> Iterator[pa.RecordBatch]:
        system = fs.FileSystem.from_uri(self.path)[0] if "://" in self.path or self.path.startswith("file:") else fs.LocalFileSystem()
        part: list[tuple] = []
        for path, size in partition.files:
            with system.open_input_stream(path) as stream:
                data = stream.read()
            for row in self._rows(path, size, data):
                part.append(row)
                if len(part) >= self.batch:
                    yield self._batch(part)
                    part = []
        if part:
            yield self._batch(part)

    def _rows(self, path: str, size: int, data: bytes) -> Iterator[tuple]:
        if self.table == "diagnostics":
            yield diagnosed(path, size, data)
            return
        rows = TABLES[self.table][1]
        try:
            if package_type(data) != ("document" if self.table == "blocks" else "workbook"):
                return
            for _ in rows(path, data):
                pass  # a package that breaks midway gives no rows, instead of its first ones
        except BROKEN:
            return
        yield from rows(path, data)

    def _batch(self, part: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in part], kind) for k, _, kind in self.fields], [n for _, n, _ in self.fields])


class PruningReader(Reader):
    """A reader that opens only the files that filters on ``file_id`` name."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("file_id",):
                named = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted = named if self.wanted is None else self.wanted & named
            else:
                yield f


class Packages(DataSource):
    """Options: ``path``, ``table`` (cells, merges, attachments, layout, blocks, diagnostics), ``maxPartitionBytes``, ``batchRows``, ``pushdown``.

    A schema with some of the table's columns builds only these. With ``pushdown`` and ``spark.sql.python.filterPushdown.enabled``
    filters on ``file_id`` leave files unread.
    """

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        table = self.options.get("table", "cells")
        if table not in TABLES:
            raise ValueError(f"no table {table}; there are {', '.join(TABLES)}")
        return TABLES[table][0]

    def reader(self, schema: StructType) -> DataSourceReader:
        options = {k.lower(): v for k, v in self.options.items()}
        return (PruningReader if options.get("pushdown", "false").lower() == "true" else Reader)(schema, options)


def register(spark: SparkSession) -> None:
    """Makes the format known to the session."""
    spark.dataSource.register(Packages)
