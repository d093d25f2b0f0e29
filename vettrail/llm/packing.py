"""Best-fit packing of tokenized documents into sequences, bulk-synchronously over sorted runs.

Documents are encoded where they are read; only (id, piece, start, length, checksum) goes on. Those
rows are range-sorted by length, longest first. All pieces of one length are interchangeable but for
their rank, and so are all open sequences with the same gap, so the sorted pieces and the sorted gaps
are held as runs: at most CAPACITY lengths and CAPACITY gaps, however many documents there are. A
superstep takes the longest length left, sweeps the gaps upwards from its successor (the smallest gap
that it fits), gives ranks to sequences in order, so that no two pieces claim one place, moves the
filled sequences to their new gap and opens new sequences for what is left. The next superstep sees
the updated gaps. This is exactly best-fit decreasing. The supersteps run on the driver over those
bounded runs instead of one shuffle per superstep over all documents; each document then finds its
place by its length and rank in one distributed pass.

Defined results: a null or empty text is the end id alone. A document longer than CAPACITY is cut
from its end into full pieces, its first piece has the rest. Repeated rows are packed one by one. An
empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bytebpe import CACHE_ENTRIES, default_vocabulary, encoder
from .common import materialize

CAPACITY, END_ID = 2048, 0
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _pieces(vocabulary: str, capacity: int, cache_entries: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(vocabulary, cache_entries), np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            out: list[tuple] = []
            for key, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
                ids = memoryview(enc.packed(text.as_py()) + end)
                n = len(ids) // 4
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    out.append((key, i, a, b - a, zlib.crc32(ids[4 * a : 4 * b])))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            columns = [*zip(*out)] if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [x.split()[0] for x in _PIECES.split(", ")])

    return run


def sweep(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over runs.

    counts: how many pieces each length has. Returns runs (length, first rank, first sequence, pieces
    per sequence, offset): from that rank on, pieces of that length fill consecutive sequences.
    """
    runs: list[tuple[int, int, int, int, int]] = []
    gaps: list[int] = []  # sorted sizes of open gaps
    open_: dict[int, list[tuple[int, int]]] = {}  # gap: runs of sequences (first, how many)
    opened = 0

    def put(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in open_:
                insort(gaps, gap)
                open_[gap] = []
            open_[gap].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0

        def fill(first: int, n: int, gap: int) -> None:
            """Pieces go to the n sequences from `first`, as many into each as its gap takes."""
            nonlocal left, rank
            each = gap // length
            full = min(n, left // each)
            if full:
                runs.append((length, rank, first, each, capacity - gap))
                put(gap - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if left and full < n:  # fewer than one sequence takes: the rest of the pieces
                runs.append((length, rank, first + full, left, capacity - gap))
                put(gap - left * length, first + full, 1)
                rank, left, full = rank + left, 0, full + 1
            put(gap, first + full, n - full)

        while left and gaps:
            at = bisect_left(gaps, length)
            if at == len(gaps):
                break
            gap = gaps[at]
            own = open_[gap]
            first, n = own.pop()
            if not own:
                del open_[gap], gaps[at]
            fill(first, n, gap)
        if left:
            n = -(-left // (capacity // length))
            first, opened = opened, opened + n
            fill(first, n, capacity)
    return runs


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, cache_entries: int = CACHE_ENTRIES) -> DataFrame:
    """One row per piece with its sequence and offset. cache_entries bounds what a Python worker remembers of the vocabulary's pre-tokens."""
    text = F.coalesce(F.col("text"), F.lit(""))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    pieces = materialize(source.mapInArrow(_pieces(vocabulary or default_vocabulary(), capacity, cache_entries), _PIECES), "pieces")
    order = [F.desc("length"), "doc_id", "piece", "ids_crc32", "start"]
    ranged = materialize(pieces.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranged")
    # a row per length in each range partition, CAPACITY lengths at most; a length that fills many partitions gets its ranks partition by partition
    held = ranged.groupBy("length", "part").agg(F.count("*").alias("n"))
    base = held.select("length", "part", F.coalesce(F.sum("n").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    counts = {r["length"]: r["n"] for r in held.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # CAPACITY rows at most
    runs = np.array(sorted(sweep(counts, capacity)) or np.zeros((0, 5)), np.int64).reshape(-1, 5)
    within = W.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32", "start")
    ranked = ranged.withColumn("r", F.row_number().over(within)).join(base, ["length", "part"]).withColumn("rank", F.col("base") + F.col("r") - 1)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = runs[:, 0] << 44 | runs[:, 1]
        for batch in batches:
            length, rank = batch["length"].to_numpy(), batch["rank"].to_numpy()
            own = runs[np.searchsorted(keys, length << 44 | rank, "right") - 1]
            nth = rank - own[:, 1]
            columns = [batch[x.split()[0]] for x in _PIECES.split(", ")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(own[:, 2] + nth // own[:, 3]), pa.array(own[:, 4] + nth % own[:, 3] * length)],
                [*(x.split()[0] for x in _PIECES.split(", ")), "sequence_id", "offset"],
            )

    return ranked.mapInArrow(place, _PIECES + ", sequence_id long, offset long")
