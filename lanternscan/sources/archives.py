"""Archive members as lines. What comes as a content is opened by one task, and its members stream out line by line. A zip archive that
is a file has its directory read alone; its members are rows, which many tasks read by their byte ranges."""

from __future__ import annotations

import bz2
import gzip
import io
import posixpath
import tarfile
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternscan.sources.blocks import open_path

MEMBER_BYTES = 100 << 20
LINE_BYTES = 1 << 20
SUFFIXES = (".tar.gz", ".tar.gzip", ".tar.bz2", ".zip", ".gz", ".gzip", ".tar", ".tgz", ".bz2")
LINES = "path string, line_no int, line string"
MEMBERS = "path string, real string, name string, at long, packed long, size long, method long"


def archive_kind(path: str) -> str | None:
    return next((s for s in SUFFIXES if path.lower().endswith(s)), None)


def is_safe(name: str) -> bool:
    name = name.replace("\\", "/")
    return not name.startswith("/") and ".." not in name.split("/")


def members(path: str, data: bytes) -> Iterator[tuple[str, bytes]]:
    """Name and content of each safe member of bounded size; a damaged archive ends where the damage begins."""
    kind = archive_kind(path)
    try:
        if kind == ".zip":
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                for m in z.infolist():
                    if not m.is_dir() and is_safe(m.filename) and m.file_size <= MEMBER_BYTES:
                        yield m.filename, z.read(m)
        elif kind in (".gz", ".gzip", ".bz2"):
            opened = (bz2 if kind == ".bz2" else gzip).open(io.BytesIO(data))
            yield posixpath.splitext(posixpath.basename(path))[0], opened.read(MEMBER_BYTES)
        elif kind:
            with tarfile.open(fileobj=io.BytesIO(data), mode="r:*") as t:
                for m in t:
                    if m.isreg() and is_safe(m.name) and m.size <= MEMBER_BYTES:
                        yield m.name, t.extractfile(m).read()
    except (OSError, EOFError, ValueError, zipfile.BadZipFile, tarfile.TarError):
        return


def line_batches(label: str, content: bytes) -> Iterator[pa.RecordBatch]:
    """The lines of a member, numbered; what follows a line that is too long is left out."""
    lines = content.split(b"\n")
    lines = lines[:-1] if lines and not lines[-1] else lines
    long = next((k for k, x in enumerate(lines) if len(x) > LINE_BYTES), len(lines))
    texts = [x.removesuffix(b"\r").decode("utf-8", "replace") for x in lines[:long]]
    for a in range(0, len(texts), 10_000):
        part = texts[a : a + 10_000]
        yield pa.RecordBatch.from_arrays([pa.array([label] * len(part)), pa.array(range(a + 1, a + 1 + len(part)), type=pa.int32()), pa.array(part)], names=["path", "line_no", "line"])


def zip_members(archives: DataFrame) -> DataFrame:
    """A row per safe member of bounded size of the zip files (path, real), from their directories alone. A damaged archive has none."""
    names = [c.split()[0] for c in MEMBERS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, real in zip(*[c.to_pylist() for c in batch.columns]):
                system, inner = open_path(real)
                try:
                    with system.open_input_file(inner) as f, zipfile.ZipFile(f) as z:
                        rows = [(path, real, m.filename, m.header_offset, m.compress_size, m.file_size, m.compress_type) for m in z.infolist() if not m.is_dir() and is_safe(m.filename) and m.file_size <= MEMBER_BYTES]
                except (OSError, EOFError, ValueError, zipfile.BadZipFile):
                    continue
                for a in range(0, len(rows), 10_000):
                    part = rows[a : a + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*part)], names=names)

    return archives.select("path", "real").mapInArrow(run, MEMBERS)


def read_member(f, at: int, packed: int, method: int) -> bytes:
    """One member's content by its range: the local header says where it begins."""
    head = f.read_at(30, at)
    if head[:4] != b"PK\3\4":
        raise zipfile.BadZipFile("no member where the directory says")
    data = f.read_at(packed, at + 30 + int.from_bytes(head[26:28], "little") + int.from_bytes(head[28:30], "little"))
    if method == zipfile.ZIP_STORED:
        return data
    if method == zipfile.ZIP_DEFLATED:
        return zlib.decompressobj(-15).decompress(data, MEMBER_BYTES)
    if method == zipfile.ZIP_BZIP2:
        return bz2.BZ2Decompressor().decompress(data, MEMBER_BYTES)
    raise zipfile.BadZipFile(f"method {method}")


def zip_lines(archives: DataFrame, tasks: int | None = None) -> DataFrame:
    """``outer!inner``, line number and line of every member of the zip files (path, real): members are dealt to tasks, not archives."""
    members = zip_members(archives)
    tasks = tasks or archives.sparkSession.sparkContext.defaultParallelism * 4
    dealt = members.repartition(tasks, "path", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, real, name, at, packed, _, method in zip(*[c.to_pylist() for c in batch.columns]):
                system, inner = open_path(real)
                try:
                    with system.open_input_file(inner) as f:
                        content = read_member(f, at, packed, method)
                except (OSError, EOFError, ValueError, zlib.error, zipfile.BadZipFile):
                    continue
                yield from line_batches(f"{path}!{name}", content)

    return dealt.mapInArrow(run, LINES)


def archive_lines(files: DataFrame) -> DataFrame:
    """``outer!inner``, line number and line of every member of the archives among (path, content)."""
    suffix = "|".join(s.replace(".", r"\.") for s in SUFFIXES)
    archives = files.filter(F.lower("path").rlike(rf"(?:{suffix})\z")).select("path", F.col("content").cast("binary"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(*[c.to_pylist() for c in batch.columns]):
                for name, content in members(path, data or b""):
                    yield from line_batches(f"{path}!{name}", content)

    return archives.mapInArrow(run, LINES)
