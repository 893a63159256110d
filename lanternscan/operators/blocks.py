"""The buffer path over blocks of large files: each task scans a block by itself, and only hits learn where their lines are.

A block knows its own line breaks. In which line it begins, and whether a line that reaches over its ends has the marker that hides
it, follows from all blocks of the file: a few numbers per block are summed up in order and joined to the hits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lanternscan.functions.text import ALLOW_MARKER, fingerprint, shannon_entropy
from lanternscan.operators.buffers import BATCH, STEP, WINDOW, all_matches, first_hits, line_of, on_lines, whole_characters
from lanternscan.operators.candidates import candidate_lookup, matching_rules
from lanternscan.plans.ruleset import RuleSet, globally_allowed, rule_allowed
from lanternscan.schema import finding

#: Lines are numbered within the block, from 1 for the one it begins in; ``starts`` and ``marked`` have an entry per listed line.
WINDOWS = "path string, block int, win int, base long, body string, first_line int, line_starts array<long>, marked array<boolean>, rule_ords array<int>"
FACTS = "path string, block int, breaks long, last_break long, first_marked boolean, last_marked boolean, over_breaks long, over_marked boolean"
#: Bytes of a block that the one before looks into.
OVER = WINDOW - STEP


def block_windows(blocks: DataFrame, rs: RuleSet, marker: str = ALLOW_MARKER) -> DataFrame:
    """Windows of (path, block, base, size, data) that some rule may match; one narrow pass."""
    build, stop = candidate_lookup(rs), marker.encode()
    names = [c.split()[0] for c in WINDOWS.split(", ")]
    kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()))

    def of_block(path, block, base, size, data, look):
        starts = marks = None
        for off in range(0, max(1, len(data) - (WINDOW - STEP)), STEP):
            end = min(off + WINDOW, len(data))
            part, lead = data[off:end], 0
            while base + off and lead < min(3, len(part)) and part[lead] & 0xC0 == 0x80:
                lead += 1
            body = (part[lead:] if base + end == size else whole_characters(part[lead:])).decode("utf-8", "replace")
            ords = look(body)
            if ords:
                if starts is None:
                    feeds = np.flatnonzero(np.frombuffer(data, dtype=np.uint8) == 10)
                    starts = np.concatenate(([0], feeds + 1))
                    marks, at = np.zeros(len(starts), dtype=bool), data.find(stop)
                    while at >= 0:
                        marks[line_of(starts, at)] = True
                        at = data.find(stop, at + 1)
                a, z = line_of(starts, off), line_of(starts, end - 1) + 1
                yield path, block, (base + off) // STEP, base + off + lead, body, a + 1, base + starts[a:z], marks[a:z], ords

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look, rows = build(), []
        for batch in batches:
            for i in range(batch.num_rows):
                for row in of_block(*(c[i].as_py() for c in batch.columns), look):
                    rows.append(row)
                    if len(rows) >= BATCH:
                        yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*rows), kinds)], names=names)
                        rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*rows), kinds)], names=names)

    return blocks.select("path", "block", "base", "size", "data").mapInArrow(run, WINDOWS)


def facts_of(path: str, block: int, base: int, size: int, data: bytes, marker: str = ALLOW_MARKER) -> tuple:
    """The row of ``block_facts`` of one block."""
    stop = marker.encode()
    core = data if base + len(data) >= size else data[:-OVER]  # without what is the next one's as well
    reach = min(len(data), len(core) + len(stop) - 1)  # a marker may reach over the end of the core

    def marked(at: int) -> bool:
        """The marker on the line of an offset, as far as the core has it."""
        begin, end = core.rfind(b"\n", 0, at) + 1, core.find(b"\n", at)
        return data.find(stop, begin, end if end >= 0 else reach) >= 0

    last = core.rfind(b"\n")
    over = min(OVER, len(core)) - 1
    return path, block, core.count(b"\n"), base + last if last >= 0 else None, marked(0), marked(len(core)), core.count(b"\n", 0, over), marked(over)


def block_facts(blocks: DataFrame, marker: str = ALLOW_MARKER) -> DataFrame:
    """A row per block: its line breaks, and whether the marker stands in its first line, its last, and the one at which the block before loses sight."""
    kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.bool_())
    names = [c.split()[0] for c in FACTS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = facts_of(*(c[i].as_py() for c in batch.columns), marker)
                yield pa.RecordBatch.from_arrays([pa.array([x], type=k) for x, k in zip(row, kinds)], names=names)

    return blocks.select("path", "block", "base", "size", "data").mapInArrow(run, FACTS)


def block_lines(facts: DataFrame) -> DataFrame:
    """``facts`` with line0, the number of the line that a block begins in, and start0, where that line begins."""
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return facts.withColumns({
        "line0": F.coalesce(F.sum("breaks").over(before), F.lit(0)) + 1,
        "start0": F.coalesce(F.last("last_break", ignorenulls=True).over(before) + 1, F.lit(0).cast("long")),
    })


def hidden_lines(lines: DataFrame) -> DataFrame:
    """path, line: lines over the ends of blocks that some block has seen the marker in."""
    seen = F.array(*(F.struct((F.col("line0") + n).alias("line"), F.col(m).alias("marked")) for n, m in ((F.lit(0), "first_marked"), (F.col("breaks"), "last_marked"), (F.col("over_breaks"), "over_marked"))))
    return lines.select("path", F.explode(seen).alias("s")).filter("s.marked").select("path", F.col("s.line").cast("int").alias("start_line")).distinct()


def scan_blocks(blocks: DataFrame, rs: RuleSet, marker: str = ALLOW_MARKER, facts: DataFrame | None = None) -> DataFrame:
    """Findings of ``scan_buffers`` for files that come as blocks. Rules with proximity conditions and allowlists that look at lines need whole contents.

    ``facts`` of the blocks can come from their source, which then sends numbers instead of the bytes for a second time.
    """
    if rs.radius or on_lines(rs):
        raise ValueError("proximity conditions and allowlists of lines need whole contents: use scan_buffers")
    hits = all_matches(matching_rules(block_windows(blocks, rs, marker), "body", rs)).withColumn("entropy", shannon_entropy("secret"))
    hits = hits.filter((F.col("min_entropy") <= 0) | (F.col("entropy") >= F.col("min_entropy")))
    secret, match, path, commit = F.col("secret"), F.col("match"), F.col("path"), F.lit("")
    hits = hits.filter(~rule_allowed(secret, match, match, path, commit)).filter(~globally_allowed(rs, secret, match, match, path, commit))
    hits = hits.withColumn("at", F.col("base") + F.col("offset")).withColumn("last", F.col("base") + F.col("offset") + F.octet_length("match") - 1)
    index = lambda offset: F.size(F.filter("line_starts", lambda s: s <= offset))
    for name in ("at", "last"):
        k = index(F.col(name))
        hits = hits.withColumns({f"{name}_line": F.col("first_line") + k - 1, f"{name}_start": F.element_at("line_starts", k), f"{name}_marked": F.element_at("marked", k)})
    hits = hits.select("path", "block", "win", "rule_ord", "rule_id", "description", "tags", "entropy", "match", "secret", "at", "last", "at_line", "at_start", "at_marked", "last_line", "last_start")
    lines = block_lines(block_facts(blocks, marker) if facts is None else facts)
    hits = hits.filter(~F.col("at_marked")).join(lines.select("path", "block", "line0", "start0"), ["path", "block"])
    start = lambda n: F.when(F.col(f"{n}_line") == 1, F.col("start0")).otherwise(F.col(f"{n}_start"))
    line = lambda n: (F.col("line0") + F.col(f"{n}_line") - 1).cast("int")
    rows = hits.select(
        "rule_id", "description", line("at").alias("start_line"), line("last").alias("end_line"), (F.col("at") - start("at") + 1).alias("start_column"), (F.col("last") - start("last") + 2).alias("end_column"),
        "match", "secret", path.alias("file"), commit.alias("commit"), "tags", "entropy", fingerprint(commit, path, "rule_id", line("at")).alias("fingerprint"), "rule_ord", "win", "at",
    )
    hidden = hidden_lines(lines).withColumnRenamed("path", "file")
    rows = rows.join(hidden, ["file", "start_line"], "left_anti")
    return finding(first_hits(rows).withColumn("place", F.col("win").cast("long")), ("rule_ord", "place"))
