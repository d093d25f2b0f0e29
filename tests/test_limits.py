"""The limiter, in batch and as a stream."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from vettrail.operators.limits import client_key, fixed_windows
from vettrail.streaming.limiter import limit_stream

T0 = dt.datetime(2026, 1, 1)
CALLS = "client string, ts timestamp, seq long"


def brute(calls, limit, window):
    state, out = {}, {}
    for client, ts, seq in sorted(calls, key=lambda c: (c[1], c[2])):
        count, start = state.get(client, (0, ts))
        if (ts - start).total_seconds() >= window:
            count, start = 0, ts
        count += 1
        state[client] = count, start
        out[seq] = count, count <= limit, None if count <= limit else max(window - (ts - start).total_seconds(), 1.0)
    return out


@pytest.fixture(scope="module")
def calls():
    rnd = random.Random(7)
    rows = [(f"c{rnd.randrange(9)}", T0 + dt.timedelta(seconds=rnd.choice([0, 59, 60, 61]) + 20 * rnd.randrange(40)), i) for i in range(400)]
    return rows + [("edge", T0, 1000), ("edge", T0 + dt.timedelta(seconds=59), 1001), ("edge", T0 + dt.timedelta(seconds=59, microseconds=500000), 1002), ("edge", T0 + dt.timedelta(seconds=60), 1003)]


def test_batch(spark, calls):
    out = {r.seq: (r["count"], r.allowed, r.retry_after) for r in fixed_windows(spark.createDataFrame(calls, CALLS).repartition(3), 2, 60.0).collect()}
    assert out == brute(calls, 2, 60.0)
    assert out[1002] == (3, False, 1.0) and out[1003] == (1, True, None)
    assert fixed_windows(spark.createDataFrame([], CALLS)).count() == 0


def test_stream_gives_the_same(spark, calls, tmp_path):
    ordered = sorted(calls, key=lambda c: (c[1], c[2]))
    for i in range(3):
        part = ordered[i * len(ordered) // 3 : (i + 1) * len(ordered) // 3]
        spark.createDataFrame(part, CALLS).coalesce(1).write.parquet(str(tmp_path / "in"), mode="append")
    stream = limit_stream(spark.readStream.schema(CALLS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), 2, 60.0, "2 hours")
    query = stream.writeStream.format("memory").queryName("limits").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {r.seq: (r["count"], r.allowed, r.retry_after) for r in spark.table("limits").collect()}
    assert got == brute(calls, 2, 60.0)


def test_client_key(spark):
    df = spark.createDataFrame([(" 1.2.3.4 , 5.6.7.8", "p"), ("", "p"), (None, "p"), (None, None)], "f string, p string")
    assert [r[0] for r in df.select(client_key(F.col("f"), F.col("p"))).collect()] == ["1.2.3.4", "p", "p", "unknown"]
