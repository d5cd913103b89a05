"""Landed documents as a data source of their own: ``spark.read.format("tidemark")`` and ``spark.readStream.format("tidemark")``.

Options: ``path``, the folder in which collectors have their folders, and
``names``, the collectors wanted, comma-separated (all folders if not given);
``split_bytes``, how much of a file one task reads.  Rows are those of
``files.json_lines``, lines that are no JSON being left out, with the collector's
name beside them.

A batch read is planned by ranges of files; a line belongs to the range in which
it begins.  A stream's offset is the last file it has taken, by time of change
and path: files that land later come with the next batch, each as a whole.

Paths are opened by ``pyarrow.fs`` (local and shared folders, HDFS, object
stores), in the tasks and for planning.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from tidemark.sources.files import DOCUMENT_COLUMNS

TEXT = [c.split()[0] for c in DOCUMENT_COLUMNS.split(", ") if c.endswith(" string")]
SCHEMA = f"collector string, {DOCUMENT_COLUMNS}, _file string, _block long, _pos long"
ARROW = pa.schema([("collector", pa.string()), *((c, pa.string()) for c in TEXT), ("metadata", pa.struct([("author", pa.string())])), ("_file", pa.string()), ("_block", pa.int64()), ("_pos", pa.int64())])
#: Rows handed over at once.
ROWS = 1_000


@dataclass
class Piece(InputPartition):
    """Lines of a file that begin in [start, end)."""

    collector: str
    file: str
    start: int
    end: int


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def listed(path: str, names: Sequence[str] | None) -> list[tuple[str, str, int]]:
    """(key, collector, size) of the landed files, in the order of their keys: time of change, then path."""
    system, root = opened(path)
    out = []
    for name in names or [i.base_name for i in system.get_file_info(fs.FileSelector(root)) if i.type == fs.FileType.Directory]:
        for info in system.get_file_info(fs.FileSelector(f"{root}/{name}", recursive=True, allow_not_found=True)):
            hidden = any(p.startswith(("_", ".")) for p in info.path[len(root) :].split("/"))
            if info.type == fs.FileType.File and not hidden and ".json" in info.path[len(root) :] and info.size:
                out.append((f"{info.mtime_ns or 0:020d} {info.path}", name, info.size))
    return sorted(out)


def as_text(value: Any) -> str | None:
    """Text as it is, any other value as JSON, as Spark's own reader has it for a text column."""
    return value if value is None or isinstance(value, str) else json.dumps(value, separators=(",", ":"), ensure_ascii=False)


def row_of(line: bytes) -> dict | None:
    """A line's document, None if it is none."""
    try:
        found = json.loads(line)
    except ValueError:
        return None
    meta = found.get("metadata") if isinstance(found, dict) else 0
    if meta is not None and not isinstance(meta, dict):
        return None
    return {c: as_text(found.get(c)) for c in TEXT} | {"metadata": None if meta is None else {"author": as_text(meta.get("author"))}}


def batches(path: str, piece: Piece) -> Iterator[pa.RecordBatch]:
    system, _ = opened(path)
    rows: list[dict] = []
    with system.open_input_file(piece.file) as file, io.BufferedReader(file, 1 << 20) as raw:
        at = piece.start
        if at:  # the line that runs into this piece belongs to the one before
            raw.seek(at - 1)
            at = at - 1 + len(raw.readline())
        while at < piece.end and (line := raw.readline()):
            row = row_of(line) if line.strip() else None
            if row is not None:
                rows.append(row | {"collector": piece.collector, "_file": piece.file, "_block": piece.start, "_pos": at})
            at += len(line)
            if len(rows) == ROWS:
                yield pa.RecordBatch.from_pylist(rows, ARROW)
                rows = []
    if rows:
        yield pa.RecordBatch.from_pylist(rows, ARROW)


class _Options:
    def __init__(self, options: dict[str, str]):
        self.path = options.get("path")
        if not self.path:
            raise ValueError("the option path is needed")
        self.names = [n.strip() for n in options["names"].split(",") if n.strip()] if options.get("names") else None
        self.split = int(options.get("split_bytes", 64 << 20))

    def pieces(self, found: list[tuple[str, str, int]]) -> list[Piece]:
        return [Piece(name, key[21:], low, min(low + self.split, size)) for key, name, size in found for low in range(0, size, self.split)]


class LandedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = _Options(options)

    def partitions(self) -> list[Piece]:
        return self.options.pieces(listed(self.options.path, self.options.names)) or [Piece("", "", 0, 0)]

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        return batches(self.options.path, partition) if partition.file else iter(())


class LandedStreamReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.options = _Options(options)

    def initialOffset(self) -> dict:
        return {"after": ""}

    def latestOffset(self) -> dict:
        found = listed(self.options.path, self.options.names)
        return {"after": found[-1][0] if found else ""}

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        found = [f for f in listed(self.options.path, self.options.names) if start["after"] < f[0] <= end["after"]]
        return self.options.pieces(found) or [Piece("", "", 0, 0)]

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        return batches(self.options.path, partition) if partition.file else iter(())


class LandedDocuments(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tidemark"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: Any) -> DataSourceReader:
        return LandedReader(self.options)

    def streamReader(self, schema: Any) -> DataSourceStreamReader:
        return LandedStreamReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LandedDocuments)
