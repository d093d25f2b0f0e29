"""Rate limits in windows that begin with a client's first call after the last window ended."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OUT = "client string, ts timestamp, seq long, count int, window_start timestamp, allowed boolean, retry_after double"


def client_key(forwarded: Column, peer: Column) -> Column:
    """The first forwarded address, else the peer's."""
    first = F.trim(F.substring_index(F.coalesce(forwarded, F.lit("")), ",", 1))
    return F.when(first != "", first).otherwise(F.coalesce(peer, F.lit("unknown")))


def step(state: tuple[int, pd.Timestamp] | None, now: pd.Timestamp, limit: int, window: float) -> tuple[int, pd.Timestamp, bool, float | None]:
    """One call: the count goes up even when it is refused; a window ends at exactly `window` seconds."""
    count, start = state or (0, now)
    passed = (now - start).total_seconds()
    if passed >= window:
        count, start, passed = 0, now, 0.0
    count += 1
    allowed = count <= limit
    return count, start, allowed, None if allowed else max(window - passed, 1.0)


def fixed_windows(calls: DataFrame, limit: int = 20, window: float = 60.0) -> DataFrame:
    """Every call (client, ts, seq) with its count, window and verdict.

    A partition is sorted by client and time and read as a stream that remembers one client's count and
    window start; no client's calls are ever held together.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client, state = None, None
        for rows in batches:
            out = []
            for own, ts in zip(rows["client"], rows["ts"]):
                if own != client:
                    client, state = own, None
                count, start, allowed, wait = step(state, ts, limit, window)
                state = (count, start)
                out.append((count, start, allowed, wait))
            yield rows.assign(**dict(zip(("count", "window_start", "allowed", "retry_after"), map(list, zip(*out)) if out else [[]] * 4))).astype({"count": "int32"})

    ordered = calls.select("client", F.col("ts").cast("timestamp").alias("ts"), F.col("seq").cast("long").alias("seq")).repartition("client")
    return ordered.sortWithinPartitions("client", "ts", "seq").mapInPandas(run, OUT)
