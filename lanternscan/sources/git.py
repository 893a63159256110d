"""Version control as patches. The driver lists commits only; each task asks for its own commits' patches, by one process, and reads them
as they come."""

from __future__ import annotations

import re
import subprocess
import threading
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

PATCHES = "patch_id string, seq int, line string"


def check_branch(name: str) -> str:
    """A plain branch name: no options, no parent steps, no lock files."""
    if not re.fullmatch(r"[A-Za-z0-9_./][A-Za-z0-9_./-]*", name) or ".." in name or name.endswith(".lock"):
        raise ValueError(f"bad branch name {name!r}")
    return name


def git(root: str, *args: str) -> str:
    done = subprocess.run(["git", "-C", root, *args], capture_output=True)
    if done.returncode:
        raise RuntimeError(f"git {args[0]} failed: {done.stderr.decode('utf-8', 'replace').strip()}")
    return done.stdout.decode("utf-8", "replace")


def patch_rows(patch_id: str, text: str) -> Iterator[pa.RecordBatch]:
    lines = text.split("\n")
    for a in range(0, len(lines), 10_000):
        part = lines[a : a + 10_000]
        yield pa.RecordBatch.from_arrays(
            [pa.array([patch_id] * len(part)), pa.array(range(a, a + len(part)), type=pa.int32()), pa.array(part)],
            names=["patch_id", "seq", "line"],
        )


def log_rows(root: str, shas: list[str], rows: int = 10_000) -> Iterator[pa.RecordBatch]:
    """(patch_id, seq, line) of the patches of some commits, from one process; a patch begins at its commit's line."""
    made = subprocess.Popen(
        ["git", "-C", root, "log", "-p", "--full-history", "--no-walk=unsorted", "--stdin"], stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.PIPE
    )
    said: list[bytes] = []
    feed = threading.Thread(target=lambda: (made.stdin.write("".join(f"{s}\n" for s in shas).encode()), made.stdin.close()), daemon=True)
    hear = threading.Thread(target=lambda: said.append(made.stderr.read()), daemon=True)
    feed.start()
    hear.start()
    wanted, patch_id, seq = set(shas), "", 0
    out: tuple[list, list, list] = ([], [], [])
    flush = lambda: pa.RecordBatch.from_arrays([pa.array(out[0]), pa.array(out[1], type=pa.int32()), pa.array(out[2])], names=["patch_id", "seq", "line"])
    for raw in made.stdout:
        line = raw.removesuffix(b"\n").decode("utf-8", "replace")
        if line.startswith("commit ") and line[7:47] in wanted:  # lines of messages and diffs begin with a space or a sign
            patch_id, seq = line[7:47], 0
        for column, value in zip(out, (patch_id, seq, line)):
            column.append(value)
        seq += 1
        if len(out[0]) >= rows:
            yield flush()
            out = ([], [], [])
    if out[0]:
        yield flush()
    hear.join()
    if made.wait():
        raise RuntimeError(f"git log failed: {b''.join(said).decode('utf-8', 'replace').strip()}")


def history(spark: SparkSession, root: str, branch: str = "") -> DataFrame:
    """(patch_id, seq, line) of every commit of a branch or of all; the folder must be reachable from the tasks."""
    shas = git(root, "rev-list", "--full-history", check_branch(branch) if branch else "--all").split()
    commits = spark.createDataFrame([(s,) for s in shas], "sha string").repartition(max(1, min(len(shas), 4 * spark.sparkContext.defaultParallelism)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shas = [sha for batch in batches for sha in batch.column(0).to_pylist()]  # names only
        if shas:
            yield from log_rows(root, shas)

    return commits.mapInArrow(run, PATCHES)


def staged(spark: SparkSession, root: str) -> DataFrame:
    """(patch_id, seq, line) of the staged changes, one patch per file; the driver lists names, each task asks for its own files' patches."""
    names = git(root, "diff", "--staged", "--name-status", "-z").split("\0")
    changed, k = [], 0
    while k < len(names) - 1:
        n = 2 if names[k][:1] in ("R", "C") else 1  # a rename or copy has two names
        changed.append((names[k + 1 : k + 1 + n],))
        k += 1 + n
    files = spark.createDataFrame(changed, "names array<string>")
    files = files.repartition(max(1, min(len(changed), 4 * spark.sparkContext.defaultParallelism)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for paths in batch.column(0).to_pylist():
                yield from patch_rows(f"staged {paths[-1]}", git(root, "diff", "--staged", "--", *(f":(top,literal){x}" for x in paths)))

    return files.mapInArrow(run, PATCHES)


def remote_url(root: str) -> str:
    """The origin's address, empty when there is none."""
    try:
        return git(root, "remote", "get-url", "origin").strip()
    except RuntimeError:
        return ""
