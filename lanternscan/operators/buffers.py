"""The buffer path: overlapping byte windows over whole contents, all matches of a rule in each window.

A window carries its own text and, of lines, offsets only. What rules ask about the text of a line (does an allowlist's pattern fit it,
where does a required pattern stand) is found once per line of a content, as one number each, and windows carry these
numbers of the lines around them. So a line costs the same however many windows it reaches through, and no text is copied.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanternscan.functions.text import ALLOW_MARKER, fingerprint, platform_link, shannon_entropy
from lanternscan.operators.candidates import candidate_lookup, matching_rules
from lanternscan.operators.lines import commit_column
from lanternscan.plans.ruleset import DEFAULT_RADIUS, RuleSet, compile_allowlist, globally_allowed, rule_allowed
from lanternscan.schema import finding

WINDOW = 4096
STEP = 3072

#: ``first_line`` is the number of the first listed line; ``line_starts``, ``marked`` and each of ``facts`` have an entry per listed line.
WINDOWS = (
    "path string, commit string, win int, base long, body string, first_line int, line_starts array<long>, marked array<boolean>, "
    "facts array<array<int>>, rule_ords array<int>"
)
#: Windows that leave a task together.
BATCH = 512


def window_offsets(size: Column, window: int = WINDOW, step: int = STEP) -> Column:
    """Start offsets of the windows over ``size`` bytes: none for 0, one up to a window, the last reaches the end."""
    last = F.when(size <= window, F.lit(0)).otherwise(F.ceil((size - window) / step) * step).cast("long")
    return F.when(size > 0, F.sequence(F.lit(0).cast("long"), last, F.lit(step).cast("long"))).otherwise(F.array().cast("array<bigint>"))


def line_starts(data: bytes) -> np.ndarray:
    """Offsets at which lines start: 0, and after each line feed that a byte follows."""
    feeds = np.flatnonzero(np.frombuffer(data, dtype=np.uint8) == 10)
    return np.concatenate(([0], feeds[feeds < len(data) - 1] + 1)).astype(np.int64)


def line_of(starts: np.ndarray, offset: int) -> int:
    """0-based line of an offset."""
    return int(np.searchsorted(starts, offset, side="right")) - 1


def line_col(starts: np.ndarray, offset: int) -> tuple[int, int]:
    """1-based line and byte column of an offset."""
    k = line_of(starts, offset)
    return k + 1, offset - int(starts[k]) + 1


def whole_characters(part: bytes) -> bytes:
    """Without the beginning of a character that the end cuts."""
    for k in range(1, min(4, len(part)) + 1):
        b = part[-k]
        if b & 0xC0 == 0xC0:
            need = 4 if b >= 0xF0 else 3 if b >= 0xE0 else 2
            return part[:-k] if need > k else part
        if b < 0x80:
            break
    return part


def on_lines(rs: RuleSet) -> list[int]:
    """Numbers of the global allowlists whose patterns look at a line."""
    return [k for k, a in enumerate(rs.allowlists) if a.regexes and a.regex_target.lower() == "line"]


def line_facts(content: Column, rs: RuleSet) -> Column:
    """array<array<int>>: for each required pattern where it first stands on each line of the content (a byte column from 0, or -1), then
    for each of ``on_lines`` whether it fits (0, else -1). A required pattern is looked for only in contents with a keyword of its rule."""
    text = content.cast("string")
    low = F.lower(text)
    lines = F.split(text, "\n", -1)
    lines = F.when(F.element_at(lines, -1) == "", F.slice(lines, F.lit(1), F.size(lines) - 1)).otherwise(lines)
    ended = lambda x: F.rtrim(x, F.lit("\r"))

    def first_places(regex: str, guards: list[tuple[str, ...]]) -> Column:
        may = F.lit(False)
        for words in guards:
            some = F.lit(not words)
            for w in words:
                some = some | F.contains(low, F.lit(w))
            may = may | some
        before = lambda x: F.octet_length(F.element_at(F.split(ended(x), regex, 2), 1))
        return F.transform(
            F.when(may, lines).otherwise(F.array().cast("array<string>")),
            lambda x: F.when(F.rlike(ended(x), F.lit(regex)), before(x)).otherwise(F.lit(-1)),
        )

    def fitting(patterns: list[str]) -> Column:
        fits = lambda x: F.exists(F.array(*map(F.lit, patterns)), lambda p: F.rlike(ended(x), p))
        return F.transform(lines, lambda x: F.when(fits(x), F.lit(0)).otherwise(F.lit(-1)))

    facts = [first_places(regex, guards) for regex, guards in rs.required_patterns().items()]
    facts += [fitting(compile_allowlist(rs.allowlists[k])[1]) for k in on_lines(rs)]
    return F.array(*facts).cast("array<array<int>>")


def windows(files: DataFrame, rs: RuleSet | None = None, marker: str = ALLOW_MARKER, window: int = WINDOW, step: int = STEP) -> DataFrame:
    """Windows of (path, content, optional commit), see WINDOWS; one narrow pass. With rules only windows that some rule may match.

    A window is cut to whole characters, so that byte offsets can be counted on its text; ``base`` is its first byte. Lines are listed
    as far as proximity conditions may look.
    """
    radius = rs.radius if rs else 0
    build = candidate_lookup(rs) if rs else None
    stop = marker.encode()
    schema = pa.schema([
        ("path", pa.string()), ("commit", pa.string()), ("win", pa.int32()), ("base", pa.int64()), ("body", pa.string()), ("first_line", pa.int32()),
        ("line_starts", pa.list_(pa.int64())), ("marked", pa.list_(pa.bool_())), ("facts", pa.list_(pa.list_(pa.int32()))), ("rule_ords", pa.list_(pa.int32())),
    ])

    def marked_lines(data: bytes, starts: np.ndarray) -> np.ndarray | None:
        at = data.find(stop)
        if at < 0:
            return None
        out = np.zeros(len(starts), dtype=bool)
        while at >= 0:
            k = line_of(starts, at)
            out[k] = True
            at = data.find(stop, int(starts[k + 1])) if k + 1 < len(starts) else -1
        return out

    def of_file(path, commit, data: bytes, facts, look):
        starts = marks = None
        win = 0
        for off in range(0, len(data), step):
            end = min(off + window, len(data))
            part, lead = data[off:end], 0
            while off and lead < min(3, len(part)) and part[lead] & 0xC0 == 0x80:
                lead += 1
            body = (part[lead:] if end == len(data) else whole_characters(part[lead:])).decode("utf-8", "replace")
            ords = look(body) if look else []
            if ords or not look:
                if starts is None:
                    starts = line_starts(data)
                    marks = marked_lines(data, starts)
                    facts = [np.asarray(f, dtype=np.int32) for f in facts]
                a, z = max(0, line_of(starts, off) - radius), line_of(starts, end - 1) + radius + 1
                listed = starts[a:z]
                yield path, commit, win, off + lead, body, a + 1, listed, (marks[a:z] if marks is not None else []), [f[a:z] for f in facts], ords
            win += 1
            if end >= len(data):
                break

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = build() if build else None
        rows = []
        for batch in batches:
            path, commit, content, facts = batch.columns
            for i in range(batch.num_rows):  # one content at a time
                data = content[i].as_py() or b""
                for row in of_file(path[i].as_py(), commit[i].as_py(), data, facts[i].as_py() or [], look):
                    rows.append(row)
                    if len(rows) >= BATCH:
                        yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                        rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    content = F.col("content").cast("binary")
    facts = line_facts(content, rs or RuleSet(())).alias("facts")
    return files.select("path", commit_column(files).alias("commit"), content.alias("content"), facts).mapInArrow(run, WINDOWS)


def all_matches(df: DataFrame, body: str = "body", regex: str = "regex", group: str = "grp") -> DataFrame:
    """One row per match: match, secret (the group, or the match where the group is empty) and byte offset in the body."""
    found = df.withColumns({
        "_ms": F.expr(f"regexp_extract_all({body}, {regex}, 0)"),
        "_ss": F.expr(f"regexp_extract_all({body}, {regex}, {group})"),
        "_gs": F.expr(f"split({body}, {regex}, -1)"),
    })
    length = lambda xs, n: F.aggregate(F.slice(xs, F.lit(1), n), F.lit(0).cast("long"), lambda s, x: s + F.octet_length(x))
    out = found.select(*df.columns, "_ms", "_ss", "_gs", F.posexplode("_ms").alias("_k", "match"))
    secret = F.element_at("_ss", F.col("_k") + 1)
    return out.select(
        *df.columns, "match", F.when(secret == "", F.col("match")).otherwise(secret).alias("secret"),
        (length(F.col("_gs"), F.col("_k") + 1) + length(F.col("_ms"), F.col("_k"))).alias("offset"),
    ).filter("match <> ''")


def line_index(offset: Column) -> Column:
    """1-based place in line_starts of the line that holds an offset."""
    return F.size(F.filter("line_starts", lambda s: s <= offset))


def near_required(rs: RuleSet, index: Column, column0: Column) -> Column:
    """Every required pattern stands on some line close enough; columns count only on the match's own line."""
    radius = F.aggregate("required", F.lit(0), lambda m, q: F.greatest(m, q.lines))
    radius = F.when(radius == 0, DEFAULT_RADIUS).otherwise(radius)
    places = F.sequence(F.greatest(F.lit(1), index - radius), F.least(F.size("line_starts"), index + radius))
    known = F.array(*map(F.lit, rs.required_patterns()))

    def stands(q: Column) -> Column:
        firsts = F.get(F.col("facts"), (F.array_position(known, q.regex) - 1).cast("int"))

        def at(i: Column) -> Column:
            first = F.coalesce(F.get(firsts, i - 1), F.lit(-1))
            close = (q.lines <= 0) | (F.abs(i - index) <= q.lines)
            return close & (first >= 0) & ((q.columns <= 0) | (i != index) | (F.abs(first - column0) <= q.columns))

        return F.exists(places, at)

    return (F.size("required") == 0) | F.forall("required", stands)


def window_hits(
    files: DataFrame, rs: RuleSet, marker: str = ALLOW_MARKER, platform: str = "", owner: str = "", repo: str = "",
    window: int = WINDOW, step: int = STEP,
) -> DataFrame:
    """What survives of the matches in each window, with ``win`` and the offset ``at``; a match in two windows comes twice. No shuffle."""
    hits = all_matches(matching_rules(windows(files, rs, marker, window, step), "body", rs))
    hits = hits.withColumn("entropy", shannon_entropy("secret"))
    hits = hits.filter((F.col("min_entropy") <= 0) | (F.col("entropy") >= F.col("min_entropy")))
    secret, match, path, commit = (F.col(c) for c in ("secret", "match", "path", "commit"))
    hits = hits.filter(~rule_allowed(secret, match, match, path, commit))
    at = F.col("base") + F.col("offset")
    hits = hits.withColumn("at", at).withColumn("idx", line_index(F.col("at")))
    of_line = lambda values: F.get(values, F.col("idx") - 1)
    hits = hits.filter(~F.coalesce(of_line(F.col("marked")), F.lit(False)))
    n_required = len(rs.required_patterns())
    fits = {k: F.coalesce(of_line(F.get(F.col("facts"), F.lit(n_required + j))), F.lit(-1)) >= 0 for j, k in enumerate(on_lines(rs))}
    hits = hits.filter(~globally_allowed(rs, secret, match, match, path, commit, fits))
    column0 = F.col("at") - F.element_at("line_starts", F.col("idx"))
    if rs.radius:
        hits = hits.filter(near_required(rs, F.col("idx"), column0))
    last = F.col("at") + F.octet_length("match") - 1
    end_idx = line_index(last)
    start_line = F.col("first_line") + F.col("idx") - 1
    link = platform_link(platform, F.lit(owner), F.lit(repo), commit, path, start_line) if owner and repo else F.lit("")
    return hits.select(
        "rule_id", "description", start_line.alias("start_line"), (F.col("first_line") + end_idx - 1).alias("end_line"),
        (column0 + 1).alias("start_column"), (last - F.element_at("line_starts", end_idx) + 2).alias("end_column"), "match", "secret",
        path.alias("file"), "commit", "tags", "entropy", fingerprint(commit, path, "rule_id", start_line).alias("fingerprint"),
        link.alias("link"), "rule_ord", "win", "at",
    )


def first_hits(hits: DataFrame) -> DataFrame:
    """The first window's hit of each rule and offset; only hits are shuffled."""
    first = Window.partitionBy("file", "commit", "rule_id", "at").orderBy("win")
    return hits.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")


def scan_buffers(files: DataFrame, rs: RuleSet, marker: str = ALLOW_MARKER, **options) -> DataFrame:
    """Findings of whole contents, plus rule_ord and place (the window); options as of ``window_hits``."""
    rows = first_hits(window_hits(files, rs, marker, **options))
    return finding(rows.withColumn("place", F.col("win").cast("long")), ("rule_ord", "place"))
