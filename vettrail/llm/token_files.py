"""Token-id files: ORC with run-length encoded ids, row indexes and Bloom filters on the document id.

write_token_files() puts documents into ascending order by a range partition of the *texts* (ids are
wider than the text they come from and are never shuffled), encodes each partition as a stream and
writes one ORC file per partition. Ids are an array<int> column, which ORC stores by integer
run-length encoding; stripes are read in parallel, and the row index and Bloom filter on the id let a
reader skip stripes. read_token_table() reads the files back and derives each document's place.

Defined results: a null or empty text has the end id alone. Null ids sort first; repeated ids stand in
order of the text's checksum, one range partition never having to hold all of a repeated id. An
empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bytebpe import default_vocabulary, encoder
from .common import materialize, scratch_path

END_ID = 0
#: Entries of the encoder's caches: this operator shares its executor with nothing else that is large.
CACHE_ENTRIES = 450_000
#: Rows between two entries of ORC's row index, and bytes of a stripe.
INDEX_STRIDE, STRIPE_BYTES = 2_000, 16 << 20
#: Documents that one Arrow batch of ids may hold: 20,000 words are some 60,000 ids.
IDS_PER_BATCH = 1 << 21


def _encode(vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary, CACHE_ENTRIES)
        for batch in batches:
            for i, j, to, ids in enc.columns(batch["text"], END_ID):
                at = 0
                while at < j - i:
                    n = max(1, int(np.searchsorted(to, to[at] + IDS_PER_BATCH, "right")) - 1 - at)
                    lists = pa.ListArray.from_arrays(pa.array((to[at : at + n + 1] - to[at]).astype(np.int32)), pa.array(ids[to[at] : to[at + n]]))
                    yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(i + at, n), batch["tie"].slice(i + at, n), lists], ["doc_id", "tie", "ids"])
                    at += n

    return run


def write_token_files(docs: DataFrame, path: str, vocabulary: str | None = None) -> None:
    """Encode every document and write ORC files whose names and rows ascend by document id."""
    vocabulary = vocabulary or default_vocabulary()
    text = F.coalesce(F.col("text"), F.lit(""))
    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
        .withColumn("tie", F.xxhash64("text"))
        .repartitionByRange("doc_id", "tie")
        .sortWithinPartitions("doc_id", "tie")
    )
    ordered.mapInArrow(_encode(vocabulary), "doc_id long, tie long, ids array<int>").write.options(**{
        "compression": "lz4", "orc.create.index": "true", "orc.row.index.stride": str(INDEX_STRIDE), "orc.stripe.size": str(STRIPE_BYTES),
        "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01",
    }).orc(path)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch["ids"]
        at = np.asarray(ids.offsets, np.int64)
        flat = np.ascontiguousarray(np.asarray(ids.values), "<i4").view(np.uint8)
        crcs = [zlib.crc32(flat[a * 4 : b * 4]) for a, b in zip(at[:-1], at[1:])]
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], batch["tie"], batch["file"], pa.array(np.diff(at), pa.int64()), pa.array(crcs, pa.int64())],
            ["doc_id", "tie", "file", "n_tokens", "ids_crc32"],
        )


def file_number(name: Column) -> Column:
    """The order of a file among all: its partition's number, then its place among the partition's files, as numbers (names of six digits come after those of five)."""
    part = lambda pattern: F.regexp_extract(name, pattern, 1)
    return part(r"part-(\d+)").cast("long") * 1_000_000 + F.coalesce(F.nullif(part(r"-c(\d+)[.]"), F.lit("")).cast("long"), F.lit(0))


def read_token_table(spark: SparkSession, path: str) -> DataFrame:
    """Each document's place, length and checksum, read from the files once."""
    rows = spark.read.schema("doc_id long, tie long, ids array<int>").orc(path)
    rows = rows.withColumn("file", file_number(F.input_file_name()))
    rows = materialize(rows.mapInArrow(_digest, "doc_id long, tie long, file long, n_tokens long, ids_crc32 long"), "places")
    # a file holds one range partition, so neither window holds more than that or a row per file (16 bytes each)
    files = rows.groupBy("file").agg(F.sum("n_tokens").alias("total"))
    before = W.orderBy("file").rowsBetween(W.unboundedPreceding, -1)
    files = files.select("file", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    within = W.partitionBy("file").orderBy("doc_id", "tie").rowsBetween(W.unboundedPreceding, -1)
    return rows.join(F.broadcast(files), "file").select(
        "doc_id", (F.col("base") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).cast("long").alias("start"), "n_tokens", "ids_crc32"
    )


def find_documents(spark: SparkSession, path: str, ids: list[int]) -> DataFrame:
    """(doc_id, ids) of some documents: the file's statistics, row index and Bloom filter tell which stripes and rows are read."""
    return spark.read.schema("doc_id long, ids array<int>").orc(path).filter(F.col("doc_id").isin(*ids))


def token_table(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Write the files below the shared folder and read the table back."""
    path = scratch_path(docs.sparkSession, "ids")
    write_token_files(docs, path, vocabulary)
    return read_token_table(docs.sparkSession, path)
