"""Scratch tables, text batches and byte-level numpy kernels that the operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import tables

# --------------------------------------------------------------------------- scratch tables


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir; only where that is unset, one of our own (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="vettrail-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/vettrail/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage ends here, executors may go."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path  # for discard()
    return out


def discard(*frames: DataFrame) -> None:
    """Delete scratch tables that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_scratch", None)
        if path:
            spark = df.sparkSession
            jvm = spark._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


#: Rows in an Arrow batch: texts may have 100 KB and more, and an executor holds a few batches per core.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder; Arrow batches of the session become small enough for long texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, str(BATCH_ROWS))
    return tables.table(spark, sf_dir, name)


# --------------------------------------------------------------------------- batches of texts

#: Bytes of text that the kernels hold at once; a longer single text is a chunk by itself.
CHUNK_BYTES = 1 << 19


class Texts:
    """Some whole texts as one byte array; text i is data[start[i]:end[i]], a newline stands after each."""

    __slots__ = ("data", "start", "end", "rows")

    def __init__(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, rows: slice):
        self.data, self.start, self.end, self.rows = data, start, end, rows

    def __len__(self) -> int:
        return len(self.start)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32, len(column) + 1, column.offset * (8 if wide else 4)).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Texts]:
    """The texts of a column in order, in chunks of about `limit` bytes."""
    raw, at = text_buffer(column)
    n, i = len(at) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        j = min(j, n)
        size = np.diff(at[i : j + 1])
        start = np.concatenate(([0], np.cumsum(size + 1)[:-1])).astype(np.int64)
        data = np.full(int(size.sum()) + (j - i), 10, np.uint8)
        if j - i == 1:
            data[: size[0]] = raw[at[i] : at[j]]
        else:
            keep = np.ones(len(data), bool)
            keep[start + size] = False
            data[keep] = raw[at[i] : at[j]]
        yield Texts(data, start, start + size, slice(i, j))
        i = j


# --------------------------------------------------------------------------- 64-bit hashes

_U = np.uint64
#: Odd multiplier of the rolling hash and its inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _splitmix_table(seed: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(seed))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> _U(30))
        x = x * _U(0xBF58476D1CE4E5B9)
        x ^= x >> _U(27)
        x *= _U(0x94D049BB133111EB)
        x ^= x >> _U(31)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, _U)
    with np.errstate(over="ignore"):
        have = 1
        while have < n:
            step = min(have, n - have)
            out[have : have + step] = out[:step] * _U(pow(base, have, 1 << 64))
            have += step
    return out


_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, n of each at least; kept between calls."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, CHUNK_BYTES + (1 << 16))
        _POWERS["up"], _POWERS["down"] = _powers(_BASE, size), _powers(_INVERSE, size)
    return _POWERS["up"], _POWERS["down"]


#: A random 64-bit value for each byte; the second folds A-Z to a-z, the third is for a second, independent hash of folded bytes.
BYTE_VALUES = _splitmix_table(11, 256)
FOLDED_VALUES = BYTE_VALUES.copy()
FOLDED_VALUES[65:91] = BYTE_VALUES[97:123]
FOLDED_VALUES_2 = _splitmix_table(23, 256)
FOLDED_VALUES_2[65:91] = FOLDED_VALUES_2[97:123]


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """S with S[i] = sum of values[j] * base**j for j < i, modulo 2**64."""
    up, _ = powers(len(values) + 1)
    out = np.zeros(len(values) + 1, _U)
    with np.errstate(over="ignore"):
        np.cumsum(values * up[: len(values)], out=out[1:])
    return out


def range_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mixed 64-bit hash of each run [start, end) of what prefix_sums() took."""
    _, down = powers(len(sums) + 1)
    with np.errstate(over="ignore"):
        return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(_U) * _U(0xD6E8FEB86659FD93))


_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[32, 9, 10, 11, 12, 13]] = True


def words(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word [^\\x20\\x09-\\x0D]+, and for each text the index of its first word (n + 1)."""
    gap = _SEPARATOR[t.data]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], gap, [True])).view(np.int8)))
    start, end = edge[0::2], edge[1::2]
    return start, end, np.searchsorted(start, np.concatenate((t.start, [len(t.data)])))


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    if len(keys) < 2:
        return np.zeros(len(keys), bool)
    sorted_keys = np.sort(keys)
    twice = sorted_keys[1:][sorted_keys[1:] == sorted_keys[:-1]]
    if not len(twice):
        return np.zeros(len(keys), bool)
    twice = twice[np.concatenate(([True], twice[1:] != twice[:-1]))]
    at = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
    return twice[at] == keys


def sums_by_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of values[first[i]:first[i + 1]] for each i."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return total[first[1:]] - total[first[:-1]]


def has_word(text: str) -> bool:
    return bool(text.strip(" \t\n\v\f\r"))


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))


def text_hash(name: str = "text"):
    """With the id, what names a row's document."""
    return F.xxhash64(text_or_empty(name))


#: What identified() names a document by.
DOC = ["nid", "id", "th"]


def identified(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").isNull().alias("nid"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), text_hash().alias("th"), text_or_empty().alias("text"))


#: A table of up to so many 64-bit keys (8 MB of them) is sent to all executors.
BROADCAST_KEYS = 1_000_000


def keyed(keys: DataFrame) -> DataFrame:
    """A table of keys, marked for broadcast when its counted rows stay below the bound."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys
