"""Findings as they open and close: keyed state with event-time timers.

A finding that turns up is ``seen``; when it has not turned up for a while it is ``gone``, and when it turns up again it is ``back``. The state
of a finding is its keys and two values, so it can be kept for as long as findings are known. Findings share state rows and timers by a
hash of their keys: a call of Python costs milliseconds, so it advances a group of findings at once. Rows within a batch may come in any
order; rows of later batches that are older than a finding's latest sight only count as sights of the time when it was open.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Of each finding of a group: its keys, its latest sight in microseconds, and whether it is open.
STATE = "keys array<string>, last array<long>, open array<boolean>"
#: State rows. A batch writes those that it has rows for, so many small batches of very many findings want more.
GROUPS = 2048
#: Keys travel as JSON that gives each value back as it was.
EXACT = {"timeZone": "UTC", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}

LOWEST = np.iinfo(np.int64).min


def track(found: DataFrame, keys: Sequence[str], time: str = "ts", gap: str = "1 hour", delay: str = "10 minutes", groups: int = GROUPS) -> DataFrame:
    """keys, kind (seen, gone, back) and at, in append mode. ``gap``: without a sight for longer than this a finding is gone. ``groups`` stays as it is
    for the life of a checkpoint."""
    gap_us = int(pd.Timedelta(gap).total_seconds() * 1_000_000)
    rows = found.withWatermark(time, delay).select(
        F.pmod(F.xxhash64(*keys), F.lit(groups)).alias("_group"), F.to_json(F.struct(*keys), EXACT).alias("_key"), F.col(time).alias("_ts"), F.unix_micros(time).alias("_us")
    )

    def step(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        names, last, is_open = state.get if state.exists else ([], [], [])
        known, ids = len(names), {name: i for i, name in enumerate(names)}
        said: list[tuple[np.ndarray, str, np.ndarray]] = []  # numbers of findings, kind, microseconds
        c, t = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        if not state.hasTimedOut:
            for b in batches:
                c.append(np.fromiter((ids.setdefault(k, len(ids)) for k in b["_key"]), np.int64, len(b)))
                t.append(b["_us"].to_numpy(np.int64))
        c, t = np.concatenate(c), np.concatenate(t)
        last = np.append(np.array(last, np.int64), np.full(len(ids) - known, LOWEST))
        is_open = np.append(np.array(is_open, bool), np.zeros(len(ids) - known, bool))
        if len(c):
            order = np.lexsort((t, c))
            c, t = c[order], t[order]
            head = np.append(True, c[1:] != c[:-1])
            new = head & (c >= known)
            before = np.maximum(last[c], np.where(head, LOWEST, np.roll(t, 1)))
            at = np.flatnonzero(new | (t - np.where(new, t, before) > gap_us))
            opened, first = c[at], new[at]
            was_open = ~first & (is_open[opened] | np.append(False, opened[1:] == opened[:-1])[: len(at)])
            said += [(opened[was_open], "gone", before[at][was_open] + gap_us), (opened[first], "seen", t[at][first]), (opened[~first], "back", t[at][~first])]
            tail = np.append(head[1:], True)
            last[c[tail]] = np.maximum(last[c[tail]], t[tail])
            is_open[opened] = True
        # a timer must lie ahead of the watermark; what is behind it is gone at once
        due = (last + gap_us) // 1000 + 1
        over = np.flatnonzero(is_open & (due <= state.getCurrentWatermarkMs()))
        said.append((over, "gone", last[over] + gap_us))
        is_open[over] = False
        state.update((list(ids), last.tolist(), is_open.tolist()))
        if is_open.any():
            state.setTimeoutTimestamp(int(due[is_open].min()))
        which = np.concatenate([i for i, _, _ in said])
        if len(which):
            texts, kinds = np.array(list(ids), object), np.repeat(np.array([kind for _, kind, _ in said], object), [len(i) for i, _, _ in said])
            yield pd.DataFrame({"_key": texts[which], "kind": kinds, "us": np.concatenate([us for _, _, us in said])})

    out = rows.filter("_us IS NOT NULL").groupBy("_group").applyInPandasWithState(step, "_key string, kind string, us long", STATE, "append", GroupStateTimeout.EventTimeTimeout)
    key = F.from_json("_key", T.StructType([found.schema[k] for k in keys]), EXACT)
    return out.select(key.alias("_k"), "kind", F.timestamp_micros("us").alias("at")).select("_k.*", "kind", "at")
