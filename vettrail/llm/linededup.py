"""Line dedup: range-partitioned line hashes, streamed first occurrences, compressed keep bitmaps.

A line's key is the line without white space at its ends, A-Z in lower case. A key of MIN_CHARS code
points or more that stands in two documents or more loses all its lines but those in the smallest
doc_id. What moves is a row of hashes, ids and positions for each such line: it is range-partitioned
by (key hash, document, position) from sampled splitters and sorted within its partition, so even one
key with a third of all lines spreads over many partitions. Each partition is read as a stream that
remembers one key and its first document. Only the key with which a partition starts can have begun
earlier; its rows are settled against a table of one row per partition boundary. The outcome is a
zlib-compressed keep bitmap for each document that loses a line.

Keys are compared by two independent 64-bit hashes.

Defined results: a null or empty text is one empty line. A null doc_id counts as larger than any id,
all null ids as one document. Repeated rows of one id are one document; each row keeps its own
bitmap by its text. An empty table gives no rows. Other columns are kept by apply_bitmaps() and
ignored by the query.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FOLDED_VALUES, FOLDED_VALUES_2, chunks, discard, has_word, identified, materialize, prefix_sums, range_hash, text_hash, words

MIN_CHARS = 10
#: Bitmaps of up to so many bytes in all are sent to every executor; beyond that the texts are shuffled to meet them.
BROADCAST_BYTES = 32 << 20
_LINES = "h1 long, h2 long, nid boolean, id long, th long, pos int"
_SWEPT = "kind int, h1 long, h2 long, nid boolean, id long, th long, pos int"


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes, document and position of every line whose key is long enough."""
    for batch in batches:
        for t in chunks(batch["text"]):
            start, end, _ = words(t)
            breaks = np.flatnonzero(t.data == 10)
            line_start = np.concatenate(([0], breaks[:-1] + 1))
            text_of = np.searchsorted(t.end, breaks)
            position = np.arange(len(breaks)) - np.searchsorted(breaks, t.start)[text_of]
            first, past = np.searchsorted(start, line_start), np.searchsorted(start, breaks)
            some = past > first
            first, past, text_of, position = first[some], past[some], text_of[some], position[some]
            a, b = start[first], end[past - 1]
            characters = np.concatenate(([0], np.cumsum((t.data & 0xC0) != 0x80, dtype=np.int64)))
            long = characters[b] - characters[a] >= MIN_CHARS
            a, b, text_of, position = a[long], b[long], text_of[long], position[long]
            h1 = range_hash(prefix_sums(FOLDED_VALUES[t.data]), a, b).view(np.int64)
            h2 = range_hash(prefix_sums(FOLDED_VALUES_2[t.data]), a, b).view(np.int64)
            rows = pa.array(text_of + t.rows.start)
            yield pa.RecordBatch.from_arrays(
                [pa.array(h1), pa.array(h2), batch["nid"].take(rows), batch["id"].take(rows), batch["th"].take(rows), pa.array(position, pa.int32())],
                ["h1", "h2", "nid", "id", "th", "pos"],
            )


#: What a swept row says: this line goes; this line's key began the partition; the partition's last key and its first document.
DROPPED, LEADING, TRAILING = 0, 1, 2


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stream one sorted partition; only the current key, its first document and whether it leads are kept."""
    leading = last = None  # (h1, h2), (h1, h2, nid, id)
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        h1, h2, ids = (batch[k].to_numpy() for k in ("h1", "h2", "id"))
        nid = batch["nid"].to_numpy(zero_copy_only=False)
        if leading is None:
            leading = (h1[0], h2[0])
        new = np.ones(n, bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        new[0] = last is None or (h1[0], h2[0]) != last[:2]
        begin = np.maximum.accumulate(np.where(new, np.arange(n), -1))
        carried = begin < 0
        first_id, first_nid = ids[begin], nid[begin]
        if carried.any():
            first_id[carried], first_nid[carried] = last[3], last[2]
        leads = (h1 == leading[0]) & (h2 == leading[1])
        dropped = ~leads & ((ids != first_id) | (nid != first_nid))
        last = (h1[-1], h2[-1], bool(first_nid[-1]), int(first_id[-1]))
        for kind, mask in ((DROPPED, dropped), (LEADING, leads)):
            if mask.any():
                part = batch.filter(pa.array(mask))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(part.num_rows, kind, np.int32)), *part.columns], ["kind", *part.schema.names])
    if last is not None:
        values = [[TRAILING], [last[0]], [last[1]], [last[2]], [last[3]], [0], [0]]
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], ["kind", "h1", "h2", "nid", "id", "th", "pos"])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A document's dropped positions as a zlib-compressed bitmap of the lines up to the last dropped one; a set bit is kept."""
    for batch in batches:
        out = []
        for positions in batch["gone"]:
            at = np.asarray(positions.values, np.int64)
            bits = np.ones((int(at.max()) // 8 + 1) * 8, bool)
            bits[at] = False
            out.append(zlib.compress(np.packbits(bits, bitorder="little").tobytes()))
        yield pa.RecordBatch.from_arrays([batch["nid"], batch["id"], batch["th"], pa.array(out, pa.binary())], ["nid", "id", "th", "keep"])


def keep_bitmaps(docs: DataFrame) -> DataFrame:
    """(nid, id, th, keep): a bitmap for each document that loses lines; id and text hash name it."""
    lines = materialize(identified(docs).mapInArrow(_lines, _LINES), "lines")
    order = ["h1", "h2", "nid", "id", "pos"]
    swept = materialize(lines.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_sweep, _SWEPT), "swept")
    # first document of every key at a partition's edge: two rows per partition at most after the aggregation
    edges = swept.filter(F.col("kind") != DROPPED).groupBy("h1", "h2").agg(F.min(F.struct("nid", "id")).alias("first"))
    leading = swept.filter(F.col("kind") == LEADING).join(F.broadcast(edges), ["h1", "h2"])
    leading = leading.filter((F.col("nid") != F.col("first.nid")) | (F.col("id") != F.col("first.id"))).select("nid", "id", "th", "pos")
    gone = swept.filter(F.col("kind") == DROPPED).select("nid", "id", "th", "pos").union(leading)
    # bounded by the lines of one document; equal rows of a document name the same positions
    packed = gone.groupBy("nid", "id", "th").agg(F.collect_set("pos").alias("gone")).mapInArrow(_pack, "nid boolean, id long, th long, keep binary")
    packed = materialize(packed, "bitmaps")
    discard(lines, swept)
    return packed


def _sized(bitmaps: DataFrame, keep: str = "keep") -> DataFrame:
    """Marked for broadcast when their measured size (with 40 bytes of row each) stays below the bound."""
    size = bitmaps.agg(F.sum(F.octet_length(keep) + 40)).first()[0] or 0
    return F.broadcast(bitmaps) if size <= BROADCAST_BYTES else bitmaps


def drop_lines(text: str, keep: bytes | None) -> tuple[str, int, int]:
    """The text without the lines that the bitmap drops, the lines before, the lines dropped."""
    lines = text.split("\n")
    if keep is None:
        return text, len(lines), 0
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), bitorder="little")[: len(lines)]
    gone = {*np.flatnonzero(bits == 0).tolist()}
    return "\n".join([x for i, x in enumerate(lines) if i not in gone]), len(lines), len(gone)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [drop_lines(t.as_py(), k.as_py()) for t, k in zip(batch["text"], batch["keep"])]
        ids = [None if n.as_py() else i.as_py() for n, i in zip(batch["nid"], batch["id"])]
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.int64()),
             pa.array([hashlib.sha256(x[0].encode()).hexdigest() for x in out], pa.string())],
            ["doc_id", "n_lines", "n_dropped", "kept_sha256"],
        )


def line_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and the checksum of what stays, one row per input row."""
    joined = identified(docs).join(_sized(keep_bitmaps(docs)), ["nid", "id", "th"], "left")
    return joined.select("nid", "id", "text", "keep").mapInArrow(_digest, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def apply_bitmaps(docs: DataFrame, drop_emptied: bool = False) -> DataFrame:
    """The input's rows and columns, each text without its dropped lines; with drop_emptied, rows that lose their last word so go."""
    bitmaps = keep_bitmaps(docs).select(*[F.col(c).alias(f"_bitmap_{c}") for c in ("nid", "id", "th", "keep")])
    on = (
        (F.col("doc_id").isNull() == F.col("_bitmap_nid")) & (F.coalesce(F.col("doc_id").cast("long"), F.lit(0)) == F.col("_bitmap_id"))
        & (text_hash() == F.col("_bitmap_th"))
    )
    joined = docs.join(_sized(bitmaps, "_bitmap_keep"), on, "left").select(*docs.columns, "_bitmap_keep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() if k.as_py() is None else drop_lines(t.as_py(), k.as_py())[0] for t, k in zip(batch["text"], batch["_bitmap_keep"])]
            at = batch.schema.get_field_index("text")
            columns = [pa.array(texts, c.type) if i == at else c for i, c in enumerate(batch.columns) if batch.schema.names[i] != "_bitmap_keep"]
            out = pa.RecordBatch.from_arrays(columns, [n for n in batch.schema.names if n != "_bitmap_keep"])
            yield out.filter(pa.array([not k.is_valid or has_word(t) for t, k in zip(texts, batch["_bitmap_keep"])], pa.bool_())) if drop_emptied else out

    return joined.mapInArrow(run, docs.schema)
