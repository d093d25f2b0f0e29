"""Verification of a stream: the batch plan over each micro-batch, so both give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans.verify import Lookups, verify_outreach


def verify_stream(outreach: DataFrame, lookups: Lookups, now: Column, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Start a query that hands every micro-batch's verifications to `sink` (rows, batch id); a batch that is repeated gives the same rows."""
    return (
        outreach.writeStream.foreachBatch(lambda rows, batch: sink(verify_outreach(rows, lookups, now), batch))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
