"""A data source of blank-line separated records, read by byte ranges.

A file is cut into ranges anywhere. A record belongs to the range that holds the line end before it (the first record of
a file to the first range), and is read to its end, so that every record is read once, in one pass over the file.
A line is blank if it holds nothing but blanks, tabs and carriage returns.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatch

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "sent_id bigint, path string, block string"
#: Bytes of a range at most and, unless that is less, at least; bytes of a batch of records.
RANGE, LEAST, BATCH = 32 << 20, 1 << 16, 4 << 20
BACK = 1 << 12
BETWEEN = re.compile(rb"\n(?:[ \t\r]*+\n)++")
LEADING = re.compile(rb"(?:[ \t\r]*+\n)++")
TRAILING = re.compile(rb"\n[ \t\r]*+\Z")
PACKED = (".gz", ".bz2", ".zst", ".lz4")


@dataclass
class Ranges(InputPartition):
    """(path, offset of the file's first byte among all files, start, end) of the ranges of one task."""

    ranges: list[tuple[str, int, int, int]]


def opened_path(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path in it; a path without a scheme is one that all executors see."""
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path.removeprefix("file:")


def found_files(path: str, glob: str | None) -> list[tuple[str, int]]:
    """(path, bytes) of a file, or of the files of a folder tree; hidden files do not count.

    The pattern must match the name of the file or of a folder that holds it, as a table written by Spark is one.
    """
    system, inner = opened_path(path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    prefix = path[: len(path) - len(inner)] if path.endswith(inner) else ""
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    found = []
    for f in system.get_file_info(fs.FileSelector(inner, recursive=True)):
        parts = [p for p in f.path[len(inner) :].split("/") if p]
        if f.type != fs.FileType.File or any(p[0] in "._" for p in parts):
            continue
        if glob is None or any(fnmatch(p, glob) for p in parts):
            found.append((prefix + f.path, f.size))
    return found


def line_start(file: pa.NativeFile, at: int) -> int:
    """Where the line of the byte ``at`` begins."""
    step = BACK
    while at > 0:
        low = max(0, at - step)
        file.seek(low)
        newline = file.read(at - low).rfind(b"\n")
        if newline >= 0:
            return low + newline + 1
        if low == 0:
            break
        step *= 2
    return 0


def records_in(read, base: int, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(offset, record) of the records of one range.

    ``read(n)`` gives the next bytes of the file from ``base`` on, the begin of the line that holds ``start``.
    """
    data = read(max(end - base, 1))
    more, ended = BACK, False
    first = None
    looked, cuts = 0, []  # (end of a record, begin of the next)
    while True:
        passed = False
        for m in BETWEEN.finditer(data, looked):
            if not ended and not data[m.end() : m.end() + BACK].strip(b" \t\r"):
                break  # the gap may go on
            cuts.append((m.start(), m.end()))
            looked = m.end()
            if base + m.end() > end:
                passed = True
                break
        if passed or ended:
            break
        further = read(more)
        ended, more = not further, more * 2
        data += further
    lead = LEADING.match(data)
    if lead:
        first = lead.end()
    elif start == 0:
        first = 0
    begins = ([first] if first is not None else []) + [b for _, b in cuts if first is None or b > first]
    ends = [e for e, b in cuts if first is None or b > first]
    if first is None:
        ends = ends[1:]
    ends.append(len(data))
    for begin, stop in zip(begins, ends):
        if begin and base + begin > end:
            break
        block = data[begin:stop]
        if stop == len(data):  # a last line of blanks has no line end
            block = TRAILING.sub(b"", block)
        if block.strip():
            yield base + begin, block.strip(b"\r\n")


class RecordReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.paths = json.loads(options["paths"])
        self.glob = options.get("glob")
        self.size = int(options.get("range", RANGE))
        self.tasks = int(options.get("tasks", 1))

    def partitions(self) -> list[Ranges]:
        files = sorted({f for path in self.paths for f in found_files(path, self.glob)})
        tasks, room, before = [], 0, 0
        wanted = min(self.size, max(LEAST, sum(size for _, size in files) // self.tasks))
        for path, size in files:
            step = max(size, 1) if path.endswith(PACKED) else wanted
            for start in range(0, size, step):
                end = min(size, start + step)
                if not tasks or room < end - start:
                    tasks.append(Ranges([]))
                    room = wanted
                tasks[-1].ranges.append((path, before, start, end))
                room -= end - start
            before += size << (10 if path.endswith(PACKED) else 0)  # offsets in packed files count unpacked bytes
        return tasks or [Ranges([])]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        ids, paths, blocks, held = [], [], [], 0
        for path, before, start, end in partition.ranges:
            system, inner = opened_path(path)
            if path.endswith(PACKED):
                with system.open_input_stream(inner, compression="detect") as file:
                    whole = file.read()
                rows = list(records_in(whole_reader(whole), 0, 0, len(whole)))
            else:
                with system.open_input_file(inner) as file:
                    base = line_start(file, start)
                    file.seek(base)
                    rows = list(records_in(file.read, base, start, end))
            for at, block in rows:
                ids.append(before + at)
                paths.append(path)
                blocks.append(block.decode("utf-8", "replace").replace("\r", ""))
                held += len(block)
                if held > BATCH:
                    yield batch(ids, paths, blocks)
                    ids, paths, blocks, held = [], [], [], 0
        if ids:
            yield batch(ids, paths, blocks)


def whole_reader(data: bytes):
    """A ``read`` that gives everything at once."""
    parts = iter([data])
    return lambda n: next(parts, b"")


def batch(ids: list[int], paths: list[str], blocks: list[str]) -> pa.RecordBatch:
    columns = [pa.array(ids, pa.int64()), pa.array(paths, pa.string()), pa.array(blocks, pa.string())]
    return pa.RecordBatch.from_arrays(columns, names=["sent_id", "path", "block"])


class RecordSource(DataSource):
    """Options: ``paths`` (a JSON list of files or folders), ``glob`` on names, ``range`` in bytes, ``tasks`` wanted."""

    @classmethod
    def name(cls) -> str:
        return "blank_line_records"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RecordReader:
        return RecordReader(dict(self.options))


def read_records(spark: SparkSession, paths: str | list[str], glob: str | None = None, range_bytes: int = RANGE) -> DataFrame:
    """(sent_id, path, block): the records of files and folder trees; nothing for empty files.

    ``sent_id`` is the offset of the record among the bytes of all files in order of their paths: distinct in a read,
    ascending in a file, and the same for every ``range_bytes`` and in every later read of the same files. A compressed
    file is one range.
    """
    spark.dataSource.register(RecordSource)
    reader = spark.read.format(RecordSource.name()).option("paths", json.dumps([paths] if isinstance(paths, str) else list(paths)))
    if glob is not None:
        reader = reader.option("glob", glob)
    tasks = spark.sparkContext.defaultParallelism
    return reader.option("range", str(range_bytes)).option("tasks", str(tasks)).load()
