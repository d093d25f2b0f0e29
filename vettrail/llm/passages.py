"""Passages of WORDS words or more that several documents hold, by a sampled suffix order over words.

The suffixes of a text begin at its words. As for bytes (suffixes.py), one suffix per window of WORDS
words is sampled: the one that begins with the window's anchor, its GRAM-word run of least hash. Equal windows
have equal anchors at equal places, so a shared window is never missed; a run of neighbouring windows
that has one anchor is one row.

1. A row for each document and kind of run: anchor hash, hash of the whole run, places. Anchors of one row go.
2. A kind of run that two documents hold is shared throughout.
3. Where an anchor has several kinds, the first document of each sends the keys of the run's windows. These
   suffixes are range-partitioned by their leading tokens (the anchor) with sampled splitters, sorted within
   each bucket, and compared. An anchor with more than HOT_KINDS kinds would overfill a bucket: its windows
   are aggregated one by one instead, each under its own key.

A shared window is a later copy in every document but the smallest (nid, id, text hash) that holds it, so
the first document keeps its passages whole. Words are [^\\x20\\x09-\\x0D]+, compared as they are written,
by 64-bit hash under an equal 64-bit anchor hash.

Defined results: null and empty texts, and texts of fewer than WORDS words, hold no passage. Equal rows (id
and text) are one document; rows that share an id but not the text are documents of their own. A passage
that stands twice in one document only isn't shared. A null id counts as larger than any. An empty table
gives no rows. Passages are judged on the input, not on what is left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE_VALUES, DOC, chunks, discard, has_word, identified, keyed, materialize, mix, prefix_sums, range_hash, text_hash, words
from .windows import anchor_runs, stretches, window_hashes

#: Words of a passage and of the run that anchors it.
WORDS, GRAM = 50, 10
#: Kinds of run that one anchor may have in a bucket.
HOT_KINDS = 5_000
#: Rows of window keys that are compared at once, whole anchors at least.
COMPARED_ROWS = 20_000
#: Up to so many runs to send (60 bytes each) go to all executors; more are shuffled.
BROADCAST_ROWS = 400_000

_RUNS = "nid boolean, id long, th long, ah long, sh long, los array<int>, n int"
_FOUND = "nid boolean, id long, th long, los array<int>, off int, n int, later boolean"
_KEYS = "nid boolean, id long, th long, ah long, sh long, los array<int>, keys array<long>"
_SPANS = "nid boolean, id long, th long, shared array<int>, later array<int>"


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The runs of windows with one anchor, one row for each text and kind."""
    for batch in batches:
        for t in chunks(batch["text"]):
            start, end, first = words(t)
            hashes = range_hash(prefix_sums(BYTE_VALUES[t.data]), start, end)
            if (found := anchor_runs(hashes, first[:-1], first[1:], WORDS, GRAM)) is None:
                continue
            text, lo, n, _, ah, sh = found
            order = np.lexsort((lo, sh, ah, text))
            text, lo, n, ah, sh = (x[order] for x in (text, lo, n, ah, sh))
            new = np.flatnonzero(np.concatenate(([True], (text[1:] != text[:-1]) | (ah[1:] != ah[:-1]) | (sh[1:] != sh[:-1]))))
            los = pa.ListArray.from_arrays(pa.array(np.append(new, len(lo)), pa.int32()), pa.array(lo, pa.int32()))
            rows = pa.array(text[new] + t.rows.start)
            yield pa.RecordBatch.from_arrays([*(batch[c].take(rows) for c in DOC), pa.array(ah[new]), pa.array(sh[new]), los, pa.array(n[new], pa.int32())], _names(_RUNS))


def _window_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each wanted run of a document the hashes of its windows."""
    for batch in batches:
        for t in chunks(batch["text"]):
            start, end, first = words(t)
            sums = prefix_sums(range_hash(prefix_sums(BYTE_VALUES[t.data]), start, end))
            keys = window_hashes(sums, WORDS).view(np.int64)
            wanted = batch["runs"].slice(t.rows.start, t.rows.stop - t.rows.start)
            flat = wanted.flatten()
            text = np.repeat(np.arange(len(t)), wanted.value_lengths().to_numpy())
            los = flat.field("los")
            lo = first[text] + los.flatten().to_numpy()[np.concatenate(([0], np.cumsum(los.value_lengths().to_numpy())))[:-1]]
            n = flat.field("n").to_numpy().astype(np.int64)
            to = np.concatenate(([0], np.cumsum(n)))
            own = np.arange(to[-1]) - np.repeat(to[:-1], n) + np.repeat(lo, n)
            lists = pa.ListArray.from_arrays(pa.array(to, pa.int32()), pa.array(keys[own]))
            rows = pa.array(text + t.rows.start)
            yield pa.RecordBatch.from_arrays([*(batch[c].take(rows) for c in DOC), flat.field("ah"), flat.field("sh"), los, lists], _names(_KEYS))


def _first_of(keys: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key whether rows of several ranks have it, and whether one of a smaller rank does."""
    order = np.argsort(keys, kind="stable")
    begin = np.flatnonzero(np.concatenate(([True], keys[order][1:] != keys[order][:-1])))
    size = np.diff(np.append(begin, len(keys)))
    least, most = np.minimum.reduceat(rank[order], begin), np.maximum.reduceat(rank[order], begin)
    shared, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    shared[order] = np.repeat(least != most, size)
    later[order] = np.repeat(least, size) < rank[order]
    return shared, later


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shared windows of one bucket, sorted by anchor; only a few whole anchors are held."""

    def group(part: pa.Table) -> pa.RecordBatch:
        one = part.combine_chunks().to_batches()[0]
        ah, n = one["ah"].to_numpy(), one["keys"].value_lengths().to_numpy()
        doc = np.lexsort((one["th"].to_numpy(), one["id"].to_numpy(), one["nid"].to_numpy(zero_copy_only=False)))
        same = np.ones(len(ah), bool)
        for c in DOC:
            values = one[c].to_numpy(zero_copy_only=False)[doc]
            same[1:] &= values[1:] == values[:-1]
        same[0] = False
        rank = np.empty(len(ah), np.int64)
        rank[doc] = np.cumsum(~same)
        owner = np.repeat(np.arange(len(ah)), n)
        keys = mix(one["keys"].flatten().to_numpy().view(np.uint64) ^ mix(ah.view(np.uint64))[owner])
        shared, later = _first_of(keys, rank[owner])
        first, size = stretches(shared, owner * 2 + later)
        rows = pa.array(owner[first])
        off = first - (np.cumsum(n) - n)[owner[first]]
        return pa.RecordBatch.from_arrays([*(one[c].take(rows) for c in (*DOC, "los")), pa.array(off, pa.int32()), pa.array(size, pa.int32()), pa.array(later[first])], _names(_FOUND))

    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size >= COMPARED_ROWS:
            whole = pa.Table.from_batches(held)
            ah = whole["ah"].to_numpy()
            cut = int(np.searchsorted(ah, ah[-1], "left"))  # more of the last anchor may come
            if cut:
                yield group(whole.slice(0, cut))
                held, size = whole.slice(cut).to_batches(), len(ah) - cut
    if held:
        yield group(pa.Table.from_batches(held))


def _compare_apart(runs: DataFrame) -> DataFrame:
    """The same for anchors that no bucket should hold whole: each window is aggregated under its own key."""
    windows = runs.select(*DOC, "ah", "los", F.posexplode("keys").alias("off", "wh"))
    doc = F.struct(*DOC)
    least = windows.groupBy("ah", "wh").agg(F.min(doc).alias("least"), F.max(doc).alias("most")).filter("least <> most").select("ah", "wh", "least")
    return windows.join(least, ["ah", "wh"]).select(*DOC, "los", "off", F.lit(1).alias("n"), (doc != F.col("least")).alias("later"))


def _spans(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The maximal runs of words that windows from lo on, n of them, cover: start, end, start, end, ..."""
    if not len(lo):
        return np.zeros(0, np.int32)
    order = np.argsort(lo, kind="stable")
    start, end = lo[order], np.maximum.accumulate((lo + n - 1 + WORDS)[order])
    cut = np.flatnonzero(np.concatenate(([True], start[1:] > end[:-1])))
    return np.stack((start[cut], end[np.append(cut[1:], len(start)) - 1]), 1).ravel().astype(np.int32)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        shared, later = [], []
        for found in batch["found"]:
            v = found.values
            times = v.field("los").value_lengths().to_numpy()
            lo = v.field("los").flatten().to_numpy().astype(np.int64) + np.repeat(v.field("off").to_numpy(), times)
            n, again = np.repeat(v.field("n").to_numpy().astype(np.int64), times), np.repeat(v.field("later").to_numpy(zero_copy_only=False), times)
            shared.append(_spans(lo, n))
            later.append(_spans(lo[again], n[again]))
        yield pa.RecordBatch.from_arrays([*(batch[c] for c in DOC), *(pa.array(x, pa.list_(pa.int32())) for x in (shared, later))], _names(_SPANS))


def shared_spans(docs: DataFrame) -> DataFrame:
    """(nid, id, th, shared, later): the shared runs of words of every document that has some, and those of them that an earlier document holds."""
    texts = identified(docs)
    runs = materialize(texts.mapInArrow(_runs, _RUNS), "runs")
    anchors = materialize(runs.groupBy("ah").agg(F.count("*").alias("c")).filter("c > 1").select("ah"), "anchors")
    near = materialize(runs.join(keyed(anchors), "ah"), "near")
    discard(runs)
    doc = F.struct(*DOC)
    kinds = near.groupBy("ah", "sh").agg(F.min(doc).alias("least"), F.max(doc).alias("most"), F.min(F.struct(*DOC, "los", "n")).alias("r"))
    kinds = materialize(kinds, "kinds")
    again = kinds.filter("least <> most").select("ah", "sh", "least")
    whole = near.join(again, ["ah", "sh"]).select(*DOC, "los", F.lit(0).alias("off"), "n", (doc != F.col("least")).alias("later"))
    several = kinds.groupBy("ah").agg(F.count("*").alias("c")).filter("c > 1").select("ah", (F.col("c") > HOT_KINDS).alias("hot"))
    several = materialize(several, "several")
    one = kinds.select("ah", "sh", "r.*").join(keyed(several), "ah")
    # bounded by the runs of one document
    wanted = materialize(one.groupBy(*DOC).agg(F.collect_list(F.struct("ah", "sh", "los", "n")).alias("runs")), "wanted")
    rows = wanted.agg(F.sum(F.size("runs"))).first()[0] or 0
    if rows <= BROADCAST_ROWS:
        met = texts.join(F.broadcast(wanted), DOC)
    else:  # of the texts, only those that have something to send meet their runs
        met = texts.join(keyed(wanted.select("th").distinct()), "th", "left_semi").join(wanted, DOC)
    sent = met.select(*DOC, "text", "runs").mapInArrow(_window_keys, _KEYS)
    sent = materialize(sent.dropDuplicates(["ah", "sh"]), "sent")  # equal rows send the same keys
    hot = several.filter("hot").select("ah")
    found = sent.join(F.broadcast(hot), "ah", "left_anti").repartitionByRange("ah").sortWithinPartitions("ah").mapInArrow(_compare, _FOUND)
    found = materialize(found, "found").union(whole)
    if not hot.isEmpty():
        found = found.union(_compare_apart(sent.join(F.broadcast(hot), "ah")).select(*_names(_FOUND)))
    # bounded by the windows of one document
    merged = found.groupBy(*DOC).agg(F.collect_set(F.struct("los", "off", "n", "later")).alias("found")).mapInArrow(_merge, _SPANS)
    merged = materialize(merged, "shared")
    discard(anchors, near, kinds, several, wanted, sent)
    return merged


def cut_words(text: str, spans: list[int] | None) -> str:
    """The text without the bytes from the first to the last word of each span; the white space around stays."""
    if not spans:
        return text
    data, kept, at = text.encode(), [], 0
    start, end, _ = words(next(chunks(pa.array([text]))))
    for a, b in zip(spans[::2], spans[1::2]):
        kept.append(data[at : start[a]])
        at = end[b - 1]
    return b"".join([*kept, data[at:]]).decode()


def cut_passages(docs: DataFrame, drop_emptied: bool = False) -> DataFrame:
    """The input's rows and columns, each text without the passages that an earlier document holds; with drop_emptied, rows that lose their last word so go."""
    spans = shared_spans(docs).filter("size(later) > 0").select(*[F.col(c).alias(f"_cut_{c}") for c in (*DOC, "later")])
    total = spans.agg(F.sum(F.size("_cut_later"))).first()[0] or 0
    on = (
        (F.col("doc_id").isNull() == F.col("_cut_nid")) & (F.coalesce(F.col("doc_id").cast("long"), F.lit(0)) == F.col("_cut_id"))
        & (text_hash() == F.col("_cut_th"))
    )
    joined = docs.join(F.broadcast(spans) if total <= 4 * BROADCAST_ROWS else spans, on, "left").select(*docs.columns, "_cut_later")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = [t if s is None else cut_words(t, s) for t, s in zip(batch["text"].to_pylist(), batch["_cut_later"].to_pylist())]
            names = [n for n in batch.schema.names if n != "_cut_later"]
            out = pa.RecordBatch.from_arrays([pa.array(texts, batch["text"].type) if i == at else batch[n] for i, n in enumerate(names)], names)
            yield out.filter(pa.array([s is None or has_word(t) for t, s in zip(texts, batch["_cut_later"].to_pylist())], pa.bool_())) if drop_emptied else out

    return joined.mapInArrow(run, docs.schema)
