"""Quality rules: base rules on words and repeats, then a hashed n-gram log-likelihood ratio.

Two multinomials over hashed word unigrams and bigrams are counted: one over trusted documents (label
quality 1, not toxic), one over every document of the corpus. A document's score is the mean over its
n-grams of log(p_trusted / p_corpus). The verdict is deterministic: a document stays when its score
reaches the threshold. Nothing is drawn at random.

The corpus counts cover all rows. The trusted side is fitted on a bounded sample of labelled rows:
the TRUSTED_ROWS ids whose hash is smallest, so that their ids can be broadcast. Every map task adds
up its own counts in two arrays of BUCKETS entries; what is shuffled is at most BUCKETS rows a task,
and the table that goes to the scoring tasks has BUCKETS entries at any corpus size.

Defined results: null and empty texts have no words and fail the base rules. Without any trusted row
the base rules alone decide. Repeated rows are scored alike. Extra columns are ignored by the query
and kept by the filter. A null doc_id is scored like any other and is never trusted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE_VALUES, Texts, chunks, mix, powers, prefix_sums, range_hash, repeated, sums_by_text, words

#: Buckets of the hashed n-grams, trusted rows that are read.
BUCKETS, TRUSTED_ROWS = 1 << 16, 50_000
#: Added to a bucket's trusted count and to the count that the corpus share leads one to expect: a
#: bucket seen a few times says next to nothing, so clean text with rare words isn't marked down.
SMOOTHING = 4.0
#: Least mean log ratio that stays.
THRESHOLD = -0.17
#: Base rules.
MIN_WORDS, WINDOW, MAX_REPEAT_PERCENT = 20, 8, 30
SYMBOLS = b"#*$%&|<>"

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True

STATS_SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, llr double, kept boolean"


def _sequence_windows(values: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of `size` consecutive values."""
    up, down = powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(values * up[: len(values)], out=sums[1:])
        return mix((sums[size:] - sums[:-size]) * down[: len(values) - size + 1])


def _grams(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the unigram at each word and of the bigram that starts there (-1: the text ends)."""
    single = (mix(hashes) >> np.uint64(48)).astype(np.int64) & (BUCKETS - 1)
    double = np.full(len(hashes), -1, np.int64)
    if len(hashes) > 1:
        with np.errstate(over="ignore"):
            pair = mix(hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:])
        double[:-1] = (pair >> np.uint64(48)).astype(np.int64) & (BUCKETS - 1)
        ends = first[1:] - 1
        double[ends[(ends >= 0) & (first[1:] > first[:-1])]] = -1
    return single, double


def _base(t: Texts) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Base counts of each text, its word hashes and the index of its first word."""
    n = len(t)
    start, end, first = words(t)
    sums = prefix_sums(BYTE_VALUES[t.data])
    hashes = range_hash(sums, start, end)
    characters = np.concatenate(([0], np.cumsum((t.data & 0xC0) != 0x80, dtype=np.int64)))
    symbols = np.concatenate(([0], np.cumsum(_SYMBOL[t.data], dtype=np.int64)))
    out = {
        "n_words": np.diff(first),
        "word_chars": sums_by_text(characters[end] - characters[start], first),
        "n_symbols": symbols[t.end] - symbols[t.start],
    }
    # lines with a word; the newline after each text closes its last line
    breaks = np.flatnonzero(t.data == 10)
    line_start = np.concatenate(([0], breaks[:-1] + 1)) if len(breaks) else np.zeros(0, np.int64)
    text_of = np.searchsorted(t.end, breaks)
    at = np.searchsorted(start, line_start)
    wordy = (at < len(start)) & (start[np.minimum(at, max(len(start) - 1, 0))] < breaks) if len(start) else np.zeros(len(breaks), bool)
    line_start, line_end, text_of = line_start[wordy], breaks[wordy], text_of[wordy]
    with np.errstate(over="ignore"):
        lines = range_hash(sums, line_start, line_end) ^ mix(text_of.astype(np.uint64) + np.uint64(1))
    _, kept = np.unique(lines, return_index=True)
    out["n_dup_lines"] = np.bincount(text_of, minlength=n) - np.bincount(text_of[kept], minlength=n)
    # words inside a window that occurs again in its own text
    inside = np.zeros(len(hashes) + 1, np.int64)
    if len(hashes) >= WINDOW:
        windows = _sequence_windows(hashes, WINDOW)
        owner = np.repeat(np.arange(n), np.diff(first))
        own = owner[: len(windows)] == owner[WINDOW - 1 :]
        at = np.flatnonzero(own)
        twice = at[repeated(windows[at] ^ mix(owner[at].astype(np.uint64) + np.uint64(1)))]
        np.add.at(inside, twice, 1)
        np.add.at(inside, twice + WINDOW, -1)
    out["n_repeat_words"] = sums_by_text(np.cumsum(inside[:-1]) > 0, first)
    return out, hashes, first


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the buckets over a task's texts, by the flag `trusted`."""
    total = np.zeros((2, BUCKETS), np.int64)
    for batch in batches:
        trusted = np.asarray(batch["trusted"].to_numpy(zero_copy_only=False), bool)
        for t in chunks(batch["text"]):
            start, end, first = words(t)
            hashes = range_hash(prefix_sums(BYTE_VALUES[t.data]), start, end)
            single, double = _grams(hashes, first)
            total[0] += np.bincount(single, minlength=BUCKETS) + np.bincount(double[double >= 0], minlength=BUCKETS)
            flags = trusted[t.rows]
            if flags.any():
                own = np.repeat(flags, np.diff(first))
                total[1] += np.bincount(single[own], minlength=BUCKETS) + np.bincount(double[own & (double >= 0)], minlength=BUCKETS)
    if total[0].any():
        at = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[0][at]), pa.array(total[1][at])], ["bucket", "n_corpus", "n_trusted"])


def fit(docs: DataFrame, labels: DataFrame, trusted_rows: int = TRUSTED_ROWS) -> np.ndarray | None:
    """Log ratio of each bucket; None without a trusted row."""
    trusted = (
        labels.filter((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0) & F.col("doc_id").isNotNull())
        .select(F.col("doc_id").cast("long").alias("id")).distinct()
        .orderBy(F.xxhash64("id"), "id").limit(trusted_rows)  # the documented bound of the fitted sample
    )
    marked = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(F.broadcast(trusted.withColumn("hit", F.lit(True))), "id", "left")
    counts = marked.select(F.coalesce("hit", F.lit(False)).alias("trusted"), "text").mapInArrow(_count, "bucket long, n_corpus long, n_trusted long")
    rows = counts.groupBy("bucket").agg(F.sum("n_corpus").alias("c"), F.sum("n_trusted").alias("t")).collect()  # BUCKETS rows at most
    corpus, good = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in rows:
        corpus[r["bucket"]], good[r["bucket"]] = r["c"], r["t"]
    if not good.any():
        return None
    expected = corpus * (good.sum() / corpus.sum())
    return np.log((good + SMOOTHING) / (expected + SMOOTHING))


def _rate(ratio: np.ndarray | None, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for t in chunks(batch["text"]):
                base, hashes, first = _base(t)
                base["base_failed"] = (base["n_words"] < MIN_WORDS) | (100 * base["n_repeat_words"] > MAX_REPEAT_PERCENT * base["n_words"])
                if ratio is None:
                    base["llr"] = np.zeros(len(t))
                else:
                    single, double = _grams(hashes, first)
                    value = ratio[single] + np.where(double >= 0, ratio[double], 0.0)
                    total = np.concatenate(([0.0], np.cumsum(value)))
                    grams = np.maximum(sums_by_text(1 + (double >= 0), first), 1)
                    base["llr"] = np.round((total[first[1:]] - total[first[:-1]]) / grams, 6)
                base["kept"] = ~base["base_failed"] & (base["llr"] >= threshold)
                parts.append(base)
            names = [x.split()[0] for x in STATS_SCHEMA.split(", ")]
            stats = [pa.array(np.concatenate([p[k] for p in parts]) if parts else np.zeros(0)) for k in names]
            stats = [a.cast({"base_failed": pa.bool_(), "kept": pa.bool_(), "llr": pa.float64()}.get(k, pa.int64())) for k, a in zip(names, stats)]
            rest = [k for k in batch.schema.names if k != "text"]
            yield pa.RecordBatch.from_arrays([batch[k] for k in rest] + stats, rest + names)

    return run


def rate_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, the base counts, the score and the verdict of every row."""
    ratio = fit(docs, labels)
    return docs.select("doc_id", "text").mapInArrow(_rate(ratio, threshold), "doc_id long, " + STATS_SCHEMA)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    ratio = fit(docs, labels)
    rate = _rate(ratio, threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            verdict = next(iter(rate(iter([batch.select(["text"])]))))["kept"] if batch.num_rows else pa.array([], pa.bool_())
            yield batch.filter(verdict)

    return docs.mapInArrow(run, docs.schema)
