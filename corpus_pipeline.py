"""The corpus pipeline: documents through the stages in STAGES, each written as Parquet before the next reads it.

Quality rules drop rejected documents. Line dedup takes lines out that an earlier document holds. MinHash
keeps one document of each group of near copies among what is left. Passage dedup takes passages of 50
words or more out that an earlier document holds; the first document keeps them. Best-fit packing places
the rest. A document whose last word line dedup or passage dedup takes goes with it: earlier documents
hold all of it. Every stage works on all rows that the one before it kept. All but the last return the
columns of documents, with n_chars brought up to date. An empty table gives no rows.
A part of the training-data subpackage: it goes where that goes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vettrail.llm import linededup, minhash, packing, passages, quality
from vettrail.llm.common import discard, materialize, table


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars of the text as it is now; a null text keeps what it had."""
    if "n_chars" not in docs.columns:
        return docs
    kind = docs.schema["n_chars"].dataType
    return docs.withColumn("n_chars", F.coalesce(F.char_length("text").cast(kind), F.col("n_chars")))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(linededup.apply_bitmaps(docs, drop_emptied=True))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.keep_first(docs)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(passages.cut_passages(docs, drop_emptied=True))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # workers live on through all stages: a small cache leaves their memory to the others
    return packing.pack_documents(docs, cache_entries=60_000)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("passage_dedup", passage_dedup),
    ("best_fit_packing", pack),
]

#: Hashed n-grams, near duplicates and token ids aren't SQL; the tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), name)
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
