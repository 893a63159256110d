"""Large files as byte ranges: a data source that gives one file to many tasks, and its appended bytes to a stream.

    spark.dataSource.register(BlockSource)
    blocks = spark.read.format("file_blocks").load("file:///logs")                      # path, block, base, size, data
    lines = spark.readStream.format("file_blocks").load("file:///logs/app.log")         # what is appended, block by block of whole lines

In batch, a block is a number of scan windows with what the last of them reaches over, so that blocks are scanned each by itself
(``operators.blocks``). The driver lists names and sizes; tasks read the bytes. As a stream, a file that grows (a log, or where a pipe
is spooled to) is read up to its last line break in ranges of about one block, which begin and end at line breaks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from lanternscan.operators.blocks import FACTS, facts_of
from lanternscan.operators.buffers import STEP, WINDOW

#: Windows of a block: some six megabytes.
BLOCK_WINDOWS = 2048


def open_path(path: str):
    """An Arrow file system and the path in it; tasks that ask need no JVM."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path)) if re.match(r"[a-z0-9]+:/", path) else (fs.LocalFileSystem(), path)


def list_files(path: str) -> list[tuple[str, str, int]]:
    """(name below the path, path, size) of a file, or of all files below a folder without hidden ones."""
    from pyarrow import fs

    system, inner = open_path(path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.File:
        return [(info.base_name, path, info.size)]
    found = [f for f in system.get_file_info(fs.FileSelector(inner, recursive=True)) if f.type == fs.FileType.File]
    names = [(f.path[len(inner.rstrip("/")) + 1 :], f.size) for f in found]
    return sorted((n, f"{path.rstrip('/')}/{n}", size) for n, size in names if not any(p[0] in "._" for p in n.split("/")))


@dataclass
class Block(InputPartition):
    name: str
    path: str
    block: int
    base: int
    end: int
    size: int


class BlockReader(DataSourceReader):
    def __init__(self, path: str, windows: int):
        self.path, self.windows = path, windows

    def partitions(self) -> list[Block]:
        out, core = [], self.windows * STEP
        for name, path, size in list_files(self.path):
            last = -(-max(0, size - WINDOW) // STEP)  # the number of the last window
            for k in range(last // self.windows + 1 if size else 0):
                out.append(Block(name, path, k, k * core, min(size, (k + 1) * core - STEP + WINDOW), size))
        return out or [Block("", "", 0, 0, 0, 0)]

    def read(self, b: Block) -> Iterator[tuple]:
        if b.end > b.base:
            system, inner = open_path(b.path)
            with system.open_input_file(inner) as f:
                yield b.name, b.block, b.base, b.size, f.read_at(b.end - b.base, b.base)


class FactsReader(BlockReader):
    """Of each block only what its lines are known by."""

    def __init__(self, path: str, windows: int, marker: str):
        super().__init__(path, windows)
        self.marker = marker

    def read(self, b: Block) -> Iterator[tuple]:
        for row in super().read(b):
            yield facts_of(*row, self.marker)


class RangeOfLines:
    """Reads the lines that begin in a range of bytes."""

    def read(self, b: Block) -> Iterator[tuple]:
        if b.end <= b.base:
            return
        system, inner = open_path(b.path)
        with system.open_input_file(inner) as f:
            first = b.base
            if first and f.read_at(1, first - 1) != b"\n":
                first = self.next_line(f, first, b.size)
            last = b.end if b.end == b.size or f.read_at(1, b.end - 1) == b"\n" else self.next_line(f, b.end, b.size)
            if last > first:
                yield b.name, b.block, first, b.size, f.read_at(last - first, first)

    @staticmethod
    def next_line(f, at: int, size: int) -> int:
        while at < size:
            part = f.read_at(min(1 << 16, size - at), at)
            k = part.find(b"\n")
            if k >= 0:
                return at + k + 1
            at += len(part)
        return size


class LineReader(RangeOfLines, DataSourceReader):
    """Files in ranges of about one block that begin and end at line breaks."""

    def __init__(self, path: str, windows: int):
        self.path, self.bytes = path, windows * STEP

    def partitions(self) -> list[Block]:
        out = [Block(name, path, k, at, min(size, at + self.bytes), size) for name, path, size in list_files(self.path) for k, at in enumerate(range(0, size, self.bytes))]
        return out or [Block("", "", 0, 0, 0, 0)]


class GrowingReader(RangeOfLines, DataSourceStreamReader):
    """Offsets are sizes by path; a batch is the ranges between two of them."""

    def __init__(self, path: str, windows: int):
        self.path, self.bytes = path, windows * STEP

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {path: self.whole(path, size) for _, path, size in list_files(self.path)}

    def whole(self, path: str, size: int) -> int:
        """The end of the last whole line."""
        system, inner = open_path(path)
        with system.open_input_file(inner) as f:
            end = size
            while end:
                start = max(0, end - (1 << 16))
                at = f.read_at(end - start, start).rfind(b"\n")
                if at >= 0:
                    return start + at + 1
                end = start
        return 0

    def partitions(self, start: dict, end: dict) -> list[Block]:
        out = []
        for name, path, size in list_files(self.path):
            at, to = start.get(path, 0), end.get(path, 0)
            out += [Block(name, path, k, at + k * self.bytes, min(to, at + (k + 1) * self.bytes), to) for k in range(-(-max(0, to - at) // self.bytes))]
        return out or [Block("", "", 0, 0, 0, 0)]


class BlockSource(DataSource):
    """Options: ``windows``, the windows of a block; ``lines`` (true): blocks of whole lines, without what windows reach over;
    ``facts`` (the marker that hides lines): no bytes, but what ``scan_blocks`` needs to know of all blocks."""

    @classmethod
    def name(cls) -> str:
        return "file_blocks"

    def schema(self) -> str:
        if self.options.get("facts"):
            return FACTS
        return "path string, block int, base long, size long, data binary"

    def reader(self, schema) -> DataSourceReader:
        if self.options.get("facts"):
            return FactsReader(self.options["path"], int(self.options.get("windows", BLOCK_WINDOWS)), self.options["facts"])
        kind = LineReader if self.options.get("lines", "").lower() == "true" else BlockReader
        return kind(self.options["path"], int(self.options.get("windows", BLOCK_WINDOWS)))

    def streamReader(self, schema) -> GrowingReader:
        return GrowingReader(self.options["path"], int(self.options.get("windows", BLOCK_WINDOWS)))
