"""Workbooks as a Spark data source: ``spark.read.format("grid")`` and ``df.write.format("grid")``.

Reading: a task for each sheet of each file, which opens the file where it lies, reads the list of parts and the texts that sheets
share, and of the sheets only its own; a filter on ``sheet`` is pushed down, so other sheets are neither planned nor parsed.
Writing: tasks turn their rows into compressed stretches of a sheet's XML beside the target; the commit strings them together
as a stream, so no one holds the sheet. Files are reached through Arrow's file systems (local, hdfs, s3 and others).
"""

from __future__ import annotations

import gzip
import json
import shutil
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from loomfuse.sources.grid import BROKEN, SCHEMA, Book, batches_of, sheet_paths
from loomfuse.sources.sink import SHEET_HEAD, SHEET_PART, SHEET_TAIL, package_parts, row_xml

#: The rows that a sheet can hold.
MOST_ROWS = 1_048_576
#: The column that tells a row's place below the header.
PLACE = "row_idx"
CHUNK = 1 << 20


def _at(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


@dataclass
class SheetPart(InputPartition):
    """One sheet of one file; without a sheet, what is wrong with the file."""

    path: str
    sheet: str | None
    part: str | None
    error: str | None = None


class GridReader(DataSourceReader):
    def __init__(self, options: dict):
        given = options.get("paths") or options.get("path")
        if not given:
            raise ValueError("name a file: load(path), or the option paths, a JSON list")
        self.paths = json.loads(given) if given.startswith("[") else [given]
        if bad := [p for p in self.paths if p.lower().endswith(".xls")]:
            raise ValueError(f"the old .xls format can't be read; save as .xlsx: {', '.join(bad)}")
        self.sheets = {options["sheet"]} if "sheet" in options else None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes filters that name sheets; Spark applies all others."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("sheet",):
                named = set(f.value) if isinstance(f, In) else {f.value}
                self.sheets = named if self.sheets is None else self.sheets & named
            else:
                yield f

    def partitions(self) -> list[SheetPart]:
        found = []
        for path in self.paths:
            where, name = _at(path)
            try:
                with where.open_input_file(name) as file:
                    found += [SheetPart(path, s, part) for s, part in sheet_paths(zipfile.ZipFile(file)) if self.sheets is None or s in self.sheets]
            except BROKEN as e:
                if self.sheets is None:
                    found.append(SheetPart(path, None, None, str(e)))
        return found

    def read(self, partition: SheetPart) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            if partition.error is not None:
                raise ValueError(partition.error)
            where, name = _at(partition.path)
            with where.open_input_file(name) as file:
                yield from Book(file).rows(partition.sheet, partition.part)

        if partition is not None:  # Spark asks for nothing where there is no partition
            yield from batches_of(partition.path, rows())


@dataclass
class Stretch(WriterCommitMessage):
    """What a task has written: rows from ``first`` to ``last``."""

    file: str | None
    first: int = 0
    last: int = -1


class GridWriter(DataSourceArrowWriter):
    """A new workbook with one sheet: the column names in the first row, then rows at their ``row_idx``.

    Rows must come sorted by ``row_idx``, as ``orderBy`` leaves them: each task's rows rise, and tasks don't overlap. If that fails,
    or a task does, nothing is left behind and an older file stays.
    """

    def __init__(self, options: dict, schema: StructType, overwrite: bool):
        self.path, self.sheet = options["path"], options.get("sheet", "Sheet1")
        if PLACE not in schema.names:
            raise ValueError(f"rows need a column {PLACE}, their place from 0")
        self.names = [n for n in schema.names if n != PLACE]
        self.folder = f"{self.path}.parts-{uuid.uuid4().hex}"
        where, name = _at(self.path)
        if not overwrite and where.get_file_info(name).type != fs.FileType.NotFound:
            raise ValueError(f"{self.path} exists; use mode overwrite")
        where.create_dir(_at(self.folder)[1])

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Stretch:
        where, folder = _at(self.folder)
        file, done = f"{folder}/{uuid.uuid4().hex}.gz", Stretch(None)
        with where.open_output_stream(file) as raw, gzip.open(raw, "wb", compresslevel=1) as out:
            for batch in iterator:
                columns = [batch.column(n).to_pylist() for n in self.names]
                for i, at in enumerate(batch.column(PLACE).to_pylist()):
                    if at is None or at < 0 or done.file and at <= done.last:
                        raise ValueError(f"rows must be sorted by {PLACE}, each place once: {at} comes after {done.last}")
                    if at + 2 > MOST_ROWS:
                        raise ValueError(f"a sheet holds {MOST_ROWS} rows; {PLACE} {at} lies beyond")
                    done = Stretch(file, done.first if done.file else at, at)
                    out.write(row_xml(at + 2, [c[i] for c in columns]).encode())
        return done

    def commit(self, messages: list[Stretch | None]) -> None:
        where, name = _at(self.path)
        parts = sorted((m for m in messages if m and m.file), key=lambda m: m.first)
        for a, b in zip(parts, parts[1:], strict=False):
            if b.first <= a.last:
                self.abort(messages)
                raise ValueError(f"rows must be sorted by {PLACE}: one task ends at {a.last}, another begins at {b.first}")
        with where.open_output_stream(f"{name}.new") as raw, zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as book:
            for part, xml in package_parts(self.sheet).items():
                book.writestr(part, xml)
            with book.open(SHEET_PART, "w", force_zip64=True) as out:
                out.write((SHEET_HEAD + row_xml(1, self.names)).encode())
                for m in parts:
                    with where.open_input_stream(m.file) as packed, gzip.open(packed) as xml:
                        shutil.copyfileobj(xml, out, CHUNK)
                out.write(SHEET_TAIL.encode())
        where.move(f"{name}.new", name)
        where.delete_dir(_at(self.folder)[1])

    def abort(self, messages: list[Stretch | None]) -> None:
        where, folder = _at(self.folder)
        if where.get_file_info(folder).type != fs.FileType.NotFound:
            where.delete_dir(folder)


class GridSource(DataSource):
    """The format ``grid``: options path or paths (a JSON list), and sheet."""

    @classmethod
    def name(cls) -> str:
        return "grid"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> GridReader:
        return GridReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> GridWriter:
        return GridWriter(self.options, schema, overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, with its filters pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(GridSource)
