"""Repeated byte passages by a sampled suffix order.

A byte goes when some 400-byte string that covers it also starts anywhere else. Instead of every
suffix, one per window is sampled: the window's anchor is the 128-byte gram in it with the least
hash (the leftmost of equals). Equal windows have their anchors at equal places, so two equal windows
always meet under the anchor's hash, and a run of neighbouring windows shares one anchor: about one
suffix in 137 bytes is kept, and no repeated window can be missed.

1. A row per run: the leading-token hash of its anchor and a hash of the whole run (its windows' text).
   Runs whose anchor stands nowhere else go. Whole runs that occur again are repeated throughout.
2. Where runs share an anchor but differ, one of each kind sends its text. These suffixes are
   range-partitioned by their leading tokens with sampled splitters and sorted within each bucket; a
   multikey pass compares first the leading-token key, then the key of each 400-byte window. An
   anchor with more than HOT_KINDS kinds is split over several partitions and compared across the
   boundaries by the keys of its windows, so that no anchor, however frequent, has to fit into one task.
3. Repeated windows of a document merge into spans.

Strings are compared by 64-bit hash under an equal 64-bit anchor hash, 128 bits in all. 400 bytes are more
than many passages of over 50 words have: the query says of those, by passages.py, how many words of a
document stand in passages of 50 words or more that other documents hold too.

Defined results: a null text is empty. Every input row is a document of its own; equal rows are
copies of each other. Texts shorter than 400 bytes lose nothing. An empty table gives no rows.
cut_texts() keeps all columns and trims spans to whole characters; the query cuts bytes.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import passages
from .common import BYTE_VALUES, DOC, chunks, discard, identified, keyed, materialize, mix, prefix_sums, repeated, text_hash
from .windows import anchor_runs, stretches, window_hashes

#: Bytes of a repeated string, of the gram that anchors it.
LENGTH, GRAM = 400, 128
#: Bytes of text in one pass of the kernel.
PASS_BYTES = 1 << 19
#: Rows of text that are compared at once, whole anchors at least.
COMPARED_ROWS = 3_000
#: Kinds of run that one anchor may have in one partition: 10 MB of text.
HOT_KINDS = 20_000
#: A table of up to so many rows of at most 40 bytes is sent to all executors instead of shuffling the texts.
BROADCAST_ROWS = 400_000

_RUNS = "nid boolean, id long, th long, ah long, sh long, lo int, n int, rel int"
_DIGEST = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_shared_words long"
_FOUND = "edge boolean, nid boolean, id long, th long, lo int, n int, ah long, wh long"


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for t in chunks(batch["text"], PASS_BYTES):
            if (found := anchor_runs(BYTE_VALUES[t.data], t.start, t.end, LENGTH, GRAM)) is None:
                continue
            text, lo, n, rel, ah, sh = found
            rows = pa.array(text + t.rows.start)
            yield pa.RecordBatch.from_arrays(
                [*(batch[c].take(rows) for c in DOC), pa.array(ah), pa.array(sh), *(pa.array(x, pa.int32()) for x in (lo, n, rel))], _names(_RUNS)
            )


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text of each wanted run of a document."""
    for batch in batches:
        for i in range(batch.num_rows):
            text = memoryview((batch["text"][i].as_py() or "").encode())
            runs = batch["runs"][i].as_py()
            yield pa.RecordBatch.from_arrays(
                [pa.array([r["ah"] for r in runs], pa.int64()), pa.array([r["sh"] for r in runs], pa.int64()), pa.array([r["hot"] for r in runs], pa.bool_()),
                 *(pa.array([batch[c][i].as_py()] * len(runs), k) for c, k in zip(DOC, (pa.bool_(), pa.int64(), pa.int64()))),
                 pa.array([r["lo"] for r in runs], pa.int32()),
                 pa.array([bytes(text[r["lo"] : r["lo"] + r["n"] + LENGTH - 1]) for r in runs], pa.binary())],
                ["ah", "sh", "hot", *DOC, "lo", "seg"],
            )


def _compare(batches: Iterator[pa.RecordBatch], split: bool = False) -> Iterator[pa.RecordBatch]:
    """Repeated windows of one sorted bucket; where anchors are split, also the keys of all windows of its first and last anchor, for the boundaries."""

    def group(part: pa.Table, edges: set[int]) -> Iterator[pa.RecordBatch]:
        part = part.combine_chunks()
        ah = part["ah"].to_numpy()
        seg = part["seg"].combine_chunks() if part["seg"].num_chunks != 1 else part["seg"].chunk(0)
        keys, owner, window = [], [], []
        for t in chunks(seg, PASS_BYTES):
            hashes = window_hashes(prefix_sums(BYTE_VALUES[t.data]), LENGTH)
            n = t.end - t.start - LENGTH + 1
            own = np.repeat(np.arange(t.rows.start, t.rows.stop, dtype=np.int32), n)
            at = np.arange(len(own), dtype=np.int32) - np.repeat(np.concatenate(([0], np.cumsum(n)[:-1])).astype(np.int32), n)
            keys.append(hashes[at + t.start[own - t.rows.start]]), owner.append(own), window.append(at)
        keys, owner, window = map(np.concatenate, (keys, owner, window))
        twice = repeated(mix(keys ^ mix(ah.view(np.uint64))[owner]))
        lo = part["lo"].to_numpy()
        doc = [part[c].combine_chunks() for c in DOC]
        doc = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in doc]
        first, n = stretches(twice, owner)
        rows = pa.array(owner[first])
        zero = pa.array(np.zeros(len(first), np.int64))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.zeros(len(first), bool)), *(c.take(rows) for c in doc), pa.array(lo[owner[first]] + window[first], pa.int32()), pa.array(n, pa.int32()), zero, zero], _names(_FOUND)
        )
        at = np.flatnonzero(np.isin(ah[owner], list(edges))) if split else ah[:0]
        for i in range(0, len(at), 1 << 18):
            own = at[i : i + (1 << 18)]
            rows = pa.array(owner[own])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.ones(len(own), bool)), *(c.take(rows) for c in doc), pa.array(lo[owner[own]] + window[own], pa.int32()), pa.array(np.ones(len(own), np.int32)),
                 pa.array(ah[owner[own]]), pa.array(keys[own].view(np.int64))], _names(_FOUND)
            )

    held: list[pa.RecordBatch] = []
    size, begun = 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        if begun is None:
            begun = batch["ah"][0].as_py()
        held.append(batch)
        size += batch.num_rows
        if size >= COMPARED_ROWS:
            # all but the last anchor, of which more may come
            whole = pa.Table.from_batches(held)
            ah = whole["ah"].to_numpy()
            cut = int(np.searchsorted(ah, ah[-1], "left"))
            if cut:
                yield from group(whole.slice(0, cut), {begun})
                held, size = whole.slice(cut).to_batches(), len(ah) - cut
    if held:
        whole = pa.Table.from_batches(held)
        yield from group(whole, {begun, whole["ah"][-1].as_py()})


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A document's repeated windows as the maximal runs of bytes that they cover: start, end, start, end, ..."""
    for batch in batches:
        spans = []
        for found in batch["found"]:
            values = found.values
            lo, n = values.field(0).to_numpy().astype(np.int64), values.field(1).to_numpy().astype(np.int64)
            order = np.argsort(lo, kind="stable")
            start, end = lo[order], np.maximum.accumulate((lo + n - 1 + LENGTH)[order])
            cut = np.flatnonzero(np.concatenate(([True], start[1:] > end[:-1])))
            last = np.concatenate((cut[1:], [len(start)])) - 1
            spans.append(np.stack((start[cut], end[last]), 1).ravel())
        yield pa.RecordBatch.from_arrays([*(batch[c] for c in DOC), pa.array(spans, pa.list_(pa.int32()))], [*DOC, "spans"])


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(nid, id, th, spans): the repeated byte spans of every document that has some."""
    texts = identified(docs)
    runs = materialize(texts.mapInArrow(_runs, _RUNS), "runs")
    shared = runs.groupBy("ah").agg(F.count("*").alias("c")).filter("c > 1").select("ah")
    shared = materialize(shared, "anchors")
    runs_shared = materialize(runs.join(keyed(shared), "ah"), "shared")
    discard(runs)
    kinds = runs_shared.groupBy("ah", "sh").agg(F.count("*").alias("m"), F.min(F.struct(*DOC, "lo", "n")).alias("r"))
    kinds = materialize(kinds.select("ah", "sh", "m", "r.*"), "kinds")
    # whole runs that occur again
    again = kinds.filter("m > 1").select("ah", "sh")
    whole = runs_shared.join(again, ["ah", "sh"]).select(*DOC, "lo", "n")
    # anchors with several kinds of run: one of each kind sends its text
    several = kinds.groupBy("ah").agg(F.count("*").alias("c")).filter("c > 1").select("ah", (F.col("c") > HOT_KINDS).alias("hot"))
    several = materialize(several, "several")
    wanted = kinds.join(keyed(several), "ah").groupBy(*DOC).agg(F.collect_list(F.struct("ah", "sh", "hot", "lo", "n")).alias("runs"))
    wanted = materialize(wanted, "wanted")
    rows = wanted.agg(F.sum(F.size("runs"))).first()[0] or 0
    if rows <= BROADCAST_ROWS:
        met = texts.join(F.broadcast(wanted), DOC)
    else:  # of the texts, only those that have something to send meet their runs
        met = texts.join(keyed(wanted.select("th").distinct()), "th", "left_semi").join(wanted, DOC)
    segments = met.select(*DOC, "text", "runs").mapInArrow(_segments, "ah long, sh long, hot boolean, nid boolean, id long, th long, lo int, seg binary")
    # repeated rows send the same text twice: one of each
    parts = materialize(segments, "segments")
    segments = parts.dropDuplicates(["ah", "sh"])
    found = segments.filter("not hot").repartitionByRange("ah").sortWithinPartitions("ah").mapInArrow(_compare, _FOUND)
    found = materialize(found, "found").select(*DOC, "lo", "n")
    hot = segments.filter("hot")
    if not hot.isEmpty():
        hot = hot.repartitionByRange("ah", "sh").sortWithinPartitions("ah", "sh").mapInArrow(functools.partial(_compare, split=True), _FOUND)
        hot = materialize(hot, "hot")
        edges = hot.filter("edge").groupBy("ah", "wh").agg(F.count("*").alias("c")).filter("c > 1").select("ah", "wh")
        across = hot.filter("edge").join(edges, ["ah", "wh"]).select(*DOC, "lo", "n")
        found = found.union(hot.filter("not edge").select(*DOC, "lo", "n")).union(across)
    windows = whole.union(found)
    # bounded by the windows of one document
    spans = windows.groupBy(*DOC).agg(F.collect_set(F.struct("lo", "n")).alias("found")).mapInArrow(_merge, "nid boolean, id long, th long, spans array<int>")
    spans = materialize(spans, "spans")
    discard(shared, runs_shared, kinds, several, wanted, parts)
    return spans


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for nid, key, text, spans, shared in zip(*(batch[c] for c in ("nid", "id", "text", "spans", "shared"))):
            data, spans, shared = text.as_py().encode(), spans.as_py() or [], shared.as_py() or []
            sha, at, gone = hashlib.sha256(), 0, 0
            for a, b in zip(spans[::2], spans[1::2]):
                sha.update(data[at:a])
                at, gone = b, gone + b - a
            sha.update(data[at:])
            out.append((None if nid.as_py() else key.as_py(), len(data), gone, len(spans) // 2, sha.hexdigest(), sum(shared[1::2]) - sum(shared[::2])))
        kinds = [pa.int64()] * 4 + [pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 6, kinds)], _names(_DIGEST))


def passage_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the checksum of what stays, and the words in passages shared with other documents; one row per input row."""
    shared = passages.shared_spans(docs)
    spans = repeated_spans(docs)
    found = spans.join(shared.drop("later"), DOC, "full")
    total = sum(x or 0 for x in found.agg(F.sum(F.size("spans")), F.sum(F.size("shared"))).first())
    joined = identified(docs).join(F.broadcast(found) if total <= 4 * BROADCAST_ROWS else found, DOC, "left")
    return joined.select("nid", "id", "text", "spans", "shared").mapInArrow(_digest, _DIGEST)


def cut(text: str, spans: list[int] | None) -> str:
    """The text without its spans, each trimmed to whole characters."""
    if not spans:
        return text
    data, kept, at = text.encode(), [], 0
    for a, b in zip(spans[::2], spans[1::2]):
        while a < b and data[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(data) and data[b] & 0xC0 == 0x80:
            b -= 1
        kept.append(data[at:a])
        at = b
    return b"".join([*kept, data[at:]]).decode()


def cut_texts(docs: DataFrame) -> DataFrame:
    """The input's rows and columns, each text without its repeated passages."""
    spans = repeated_spans(docs).select(*[F.col(c).alias(f"_cut_{c}") for c in (*DOC, "spans")])
    total = spans.agg(F.sum(F.size("_cut_spans"))).first()[0] or 0
    on = (
        (F.col("doc_id").isNull() == F.col("_cut_nid")) & (F.coalesce(F.col("doc_id").cast("long"), F.lit(0)) == F.col("_cut_id"))
        & (text_hash() == F.col("_cut_th"))
    )
    joined = docs.join(F.broadcast(spans) if total <= 4 * BROADCAST_ROWS else spans, on, "left").select(*docs.columns, "_cut_spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = [t if s is None else cut(t, s) for t, s in zip(batch["text"].to_pylist(), batch["_cut_spans"].to_pylist())]
            names = [n for n in batch.schema.names if n != "_cut_spans"]
            yield pa.RecordBatch.from_arrays([pa.array(texts, batch["text"].type) if i == at else batch[n] for i, n in enumerate(names)], names)

    return joined.mapInArrow(run, docs.schema)
