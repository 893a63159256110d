"""Findings that open and close over batches of a stream."""

import random
from datetime import datetime, timedelta
from decimal import Decimal

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lanternscan.queries import oracle_sql, queries
from lanternscan.streaming.tracking import GROUPS, track

START = datetime(2026, 1, 5, 10)
SCHEMA = "fingerprint string, ts timestamp"


def test_seen_gone_and_back(spark, tmp_path):
    at = lambda minutes: START + timedelta(minutes=minutes)
    batches = [
        [("a", at(30)), ("a", at(0)), ("b", at(5)), ("a", at(0))],  # in any order, with repeats
        [("a", at(75)), ("c", at(70)), ("b", at(500)), ("b", at(441))],  # b was gone long ago
        [("a", at(600))],  # a was gone at 135, told by its timer or now
        [(None, at(5000))],  # the clock goes on
        [(None, at(5000))],
    ]
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        run = track(stream, ["fingerprint"]).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        run.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).filter("fingerprint IS NOT NULL").select("fingerprint", "kind", ((F.unix_micros("at") - F.unix_micros(F.lit(START))) / 60_000_000).cast("int").alias("m"))
    assert sorted(tuple(r) for r in got.collect()) == sorted([
        ("a", "seen", 0), ("a", "gone", 135), ("a", "back", 600), ("a", "gone", 660),
        ("b", "seen", 5), ("b", "gone", 65), ("b", "back", 441), ("b", "gone", 560), ("c", "seen", 70), ("c", "gone", 130),
    ])


def run_batches(spark, tmp_path, schema, keys, batches, **options):
    """Rows told over the batches, and the state rows at the end."""
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        run = track(stream, keys, **options).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        run.awaitTermination()
        state_rows = run.lastProgress.stateOperators[0].numRowsTotal
    return spark.read.parquet(str(tmp_path / "out")), state_rows


def test_findings_share_state_rows(spark, tmp_path):
    rng = random.Random(7)
    sights = {f"f{i}": sorted(rng.sample(range(3000), rng.randint(1, 40))) for i in range(600)}
    batches = [[(k, START + timedelta(minutes=m)) for k, ms in sights.items() for m in ms if m // 1000 == b] for b in range(3)]
    for b in batches:
        rng.shuffle(b)
    batches.append([(None, START + timedelta(days=30))])
    out, state_rows = run_batches(spark, tmp_path, SCHEMA, ["fingerprint"], batches)
    want = []
    for k, ms in sights.items():
        starts = [i for i, m in enumerate(ms) if not i or m - ms[i - 1] > 60]
        want += [(k, "back" if i else "seen", ms[i]) for i in starts]
        want += [(k, "gone", ms[j - 1] + 60) for j in [*starts[1:], len(ms)]]
    got = out.filter("fingerprint IS NOT NULL").select("fingerprint", "kind", ((F.unix_micros("at") - F.unix_micros(F.lit(START))) / 60_000_000).cast("int").alias("m"))
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    # far more findings than groups: calls of Python and timers do not grow with them
    out, state_rows = run_batches(spark, tmp_path / "few", SCHEMA, ["fingerprint"], [[(f"f{i}", START) for i in range(3000)]])
    assert out.count() == 3000 and state_rows <= GROUPS < 3000


def test_keys_come_back_as_they_were(spark, tmp_path):
    schema = "a long, b string, c timestamp, d decimal(38,2), e binary, ts timestamp"
    odd = [
        (2**63 - 1, 'x"\\\n é', datetime(1850, 1, 2, 3, 4, 5, 678901), Decimal("123456789012345678901234567890123456.78"), b"\x00\xff", START),
        (None, "", datetime(2024, 10, 27, 0, 30, 0, 1), None, b"", START),
        (None, None, None, Decimal("0.00"), None, START),
        (2**53 + 1, None, datetime(2024, 10, 27, 1, 30, 0, 1), None, None, START),
    ]
    out, _ = run_batches(spark, tmp_path, schema, ["a", "b", "c", "d", "e"], [odd], groups=1)
    want = spark.createDataFrame(odd, schema).select("a", "b", "c", "d", "e", F.lit("seen").alias("kind"), F.col("ts").alias("at"))
    assert out.exceptAll(want).count() == 0 and want.exceptAll(out).count() == 0


@pytest.mark.parametrize("no_data", ["true", "false"])
def test_query_keeps_events_without_a_user(spark, tmp_path, no_data):
    rng = random.Random(3)
    table = pa.table({
        "event_id": list(range(400)), "ts": pa.array([START + timedelta(minutes=rng.randrange(9000)) for _ in range(400)], pa.timestamp("us")),
        "user_id": pa.array([rng.choice([None, 1, 2**60 + 1]) for _ in range(400)], pa.int64()), "event_type": [rng.choice([None, "view", "error"]) for _ in range(400)],
    })
    pq.write_table(table, tmp_path / "events.parquet")
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", no_data)
    try:
        got = [tuple(r) for r in queries()["stream_open_findings"](spark, str(tmp_path)).collect()]
    finally:
        spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    duck = duckdb.connect()
    duck.register("events", table)
    assert sorted(got, key=str) == sorted(duck.sql(oracle_sql()["stream_open_findings"]).fetchall(), key=str)
