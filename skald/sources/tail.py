"""A log that grows: a data source whose offsets are byte positions after the last whole line.

Batch reads cut the file into byte ranges that begin and end at line ends. The stream hands out what was appended since, never a line without its end; a
file that became shorter, or whose first bytes changed, is read anew from its start, as a new generation of offsets. Lines keep their byte offset as `offset`."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "offset bigint, value string"
PART_BYTES = 16 << 20


class ByteRange(InputPartition):
    def __init__(self, begin: int, end: int, base: int = 0):
        self.begin, self.end, self.base = begin, end, base


def _local(path: str) -> str:
    return path[7:] if path.startswith("file://") else path[5:] if path.startswith("file:") else path


def last_line_end(path: str) -> int:
    """The position after the last line end; 0 where there is none or no file."""
    try:
        with open(path, "rb") as f:
            pos = f.seek(0, os.SEEK_END)
            while pos > 0:
                step = min(1 << 16, pos)
                f.seek(pos - step)
                at = f.read(step).rfind(b"\n")
                if at >= 0:
                    return pos - step + at + 1
                pos -= step
    except FileNotFoundError:
        pass
    return 0


def read_lines(path: str, part: ByteRange, whole: bool = False) -> Iterator[tuple[int, str]]:
    """Lines that begin in the range; with `whole`, the range begins at a line."""
    with open(path, "rb") as f:
        f.seek(part.begin)
        if not whole and part.begin > 0:
            f.seek(part.begin - 1)
            f.readline()
        while f.tell() < part.end:
            at = f.tell()
            line = f.readline()
            if not line:
                return
            yield part.base + at, line.rstrip(b"\n").decode("utf-8", "replace").rstrip("\r")


HEAD = 1024


def head_mark(path: str, length: int) -> int:
    """Checksum of the first bytes, by which a replaced file is told from one that grew."""
    try:
        with open(path, "rb") as f:
            return zlib.crc32(f.read(length))
    except FileNotFoundError:
        return 0


class LogReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[ByteRange]:
        size = os.path.getsize(self.path)
        return [ByteRange(i, min(i + PART_BYTES, size)) for i in range(0, max(size, 1), PART_BYTES)]

    def read(self, part: ByteRange) -> Iterator[tuple]:
        return read_lines(self.path, part)


class LogStream(DataSourceStreamReader):
    def __init__(self, path: str):
        self.path, self.base, self.position, self.head = path, 0, 0, [0, 0]

    def initialOffset(self) -> dict:
        return {"base": 0, "position": 0, "head": [0, 0]}

    def latestOffset(self) -> dict:
        end = last_line_end(self.path)
        if end < self.position or head_mark(self.path, self.head[0]) != self.head[1]:
            self.base += self.position  # the file was replaced
        self.position = end
        self.head = [min(end, HEAD), head_mark(self.path, min(end, HEAD))]
        return {"base": self.base, "position": end, "head": self.head}

    def partitions(self, start: dict, end: dict) -> list[ByteRange]:
        self.base, self.position, self.head = end["base"], end["position"], end.get("head", [0, 0])
        begin = start["position"] if start["base"] == end["base"] else 0
        cuts = [*range(begin, end["position"], PART_BYTES), end["position"]]
        return [ByteRange(a, b, end["base"]) for a, b in zip(cuts, cuts[1:]) if b > a]

    def read(self, part: ByteRange) -> Iterator[tuple]:
        return read_lines(self.path, part)

    def commit(self, end: dict) -> None:
        pass


class LogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "skald_log"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LogReader:
        return LogReader(_local(self.options["path"]))

    def streamReader(self, schema) -> LogStream:
        return LogStream(_local(self.options["path"]))


def register(spark: SparkSession) -> None:
    from ..common import ship

    ship(spark)
    spark.dataSource.register(LogSource)
