"""The limiter as a stream: count and window start are keyed state that expires with the window."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.limits import OUT, step

STATE = "count int, start timestamp"


def limit_stream(calls: DataFrame, limit: int = 20, window: float = 60.0, late: str = "10 minutes") -> DataFrame:
    """Streaming calls (client, ts, seq) with their verdicts; calls of one batch are taken in order of time."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = state.get if state.exists else None
        held = (held[0], pd.Timestamp(held[1])) if held else None
        rows = pd.concat(list(frames)).sort_values(["ts", "seq"])
        out = []
        for ts in rows["ts"]:
            count, start, allowed, wait = step(held, ts, limit, window)
            held = (count, start)
            out.append((count, start, allowed, wait))
        state.update((held[0], held[1].to_pydatetime()))
        end = int((held[1] + pd.Timedelta(seconds=window)).timestamp() * 1000)
        state.setTimeoutTimestamp(max(end, state.getCurrentWatermarkMs() + 1))
        count, start, allowed, wait = map(list, zip(*out))
        yield pd.DataFrame({"client": key[0], "ts": rows["ts"], "seq": rows["seq"], "count": pd.array(count, "int32"), "window_start": start, "allowed": allowed, "retry_after": wait})

    # watermarks need timestamps with a time zone
    keyed = calls.select("client", F.col("ts").cast("timestamp").alias("ts"), F.col("seq").cast("long").alias("seq")).withWatermark("ts", late)
    return keyed.groupBy("client").applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
