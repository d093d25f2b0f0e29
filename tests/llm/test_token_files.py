"""What the ORC files hold beside the ids: stripes, row index, Bloom filters, and what a reader skips by them."""

import glob
import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from vettrail.llm import bytebpe, token_files

from . import fixtures


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    """20,000 short documents with even ids in two files of several stripes."""
    path = str(tmp_path_factory.mktemp("orc") / "ids")
    patch = pytest.MonkeyPatch()
    patch.setattr(token_files, "INDEX_STRIDE", 1000)
    patch.setattr(token_files, "STRIPE_BYTES", 1 << 16)
    n = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    docs = spark.range(20_000).selectExpr("id * 2 AS doc_id", "concat('document ', id, ' has words ', id * 7919 % 10007) AS text")
    token_files.write_token_files(docs, f"file://{path}")
    spark.conf.set("spark.sql.shuffle.partitions", n)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    patch.undo()
    return path


def readers(spark, path):
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for name in sorted(glob.glob(f"{path}/part-*.orc")):
        yield jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(name), jvm.org.apache.orc.OrcFile.readerOptions(conf))


def scanned(df):
    """Rows that the scan of a finished query gave out."""
    plan = df._jdf.queryExecution().executedPlan()
    while plan.children().size():
        plan = plan.children().head()
    return plan.metrics().get("numOutputRows").get().value()


def test_metadata(spark, files):
    all_ = [*readers(spark, files)]
    assert len(all_) == 2
    for r in all_:
        assert r.getStripes().size() > 1 and r.getRowIndexStride() == 1000 and r.getCompressionKind().toString() == "LZ4"
        assert all(s.getIndexLength() > 0 for s in r.getStripes())
        kinds = {str(x.getKind()) for s in r.getStripes() for x in footer(spark, r, s)}
        assert {"ROW_INDEX", "BLOOM_FILTER_UTF8"} <= kinds


def footer(spark, reader, stripe):
    """Streams of a stripe."""
    rows = reader.rows()
    try:
        return [*rows.readStripeFooter(stripe).getStreamsList()]
    finally:
        rows.close()


def test_a_lookup_skips(spark, files):
    """By statistics all stripes but one and most of its row groups; an odd id lies within their bounds, and the Bloom filter knows that it isn't there."""
    found = token_files.find_documents(spark, f"file://{files}", [12_346])
    assert [r.doc_id for r in found.collect()] == [12_346]
    assert 0 < scanned(found) <= 1000
    absent = token_files.find_documents(spark, f"file://{files}", [12_347])
    assert absent.collect() == [] and scanned(absent) == 0
    everything = spark.read.orc(f"file://{files}")
    assert len(everything.collect()) == 20_000


def test_ids_are_run_length_encoded(spark, files):
    assert all(str(e.getKind()) == "DIRECT_V2" for r in readers(spark, files) for s in r.getStripes() for e in encodings(r, s))


def encodings(reader, stripe):
    rows = reader.rows()
    try:
        return [rows.readStripeFooter(stripe).getColumns(i) for i in range(1, rows.readStripeFooter(stripe).getColumnsCount())]
    finally:
        rows.close()


def test_files_are_ordered_by_number(spark, tmp_path):
    """After part-99999 comes part-100000, whatever the order of their names."""
    path = str(tmp_path / "ids")
    rows = [(i, "some words " * (i + 1)) for i in range(6)]
    for first in range(0, 6, 2):
        token_files.write_token_files(fixtures.frame(spark, rows[first : first + 2]).coalesce(1), f"file://{path}-{first}")
    os.mkdir(path)
    for first, name in zip(range(0, 6, 2), ("part-99998", "part-99999", "part-100000")):
        parts = sorted(glob.glob(f"{path}-{first}/part-*.orc"))
        for n, old in enumerate(parts):
            os.rename(old, f"{path}/{name}{re.sub('^part-[0-9]+', '', os.path.basename(old)).replace('-c000', f'-c{n:03}')}")
    out = sorted((r.start, r.doc_id, r.n_tokens) for r in token_files.read_token_table(spark, f"file://{path}").collect())
    assert [k for _, k, _ in out] == [0, 1, 2, 3, 4, 5]
    at = 0
    for start, _, n in out:
        assert start == at
        at += n


ODD = [
    "a \xa0 \xa0", "it's.é \xa0 \xa0b", ". \n \xa0 \xa0", "of.\nOr.", "\nfirst\nlast\n", "x\n\ny", "x\n\n\ny", "x\n\n", "x\t\n", "x\r\ny\r\n", "a\n ", "a \nb", "a\n b\t c ", "\0x \0y\n\0",
    "", None, " ", "\n", "word<|endoftext|>\nword", "Go!! go,\n12 \u3000o'clock’s\u2028it",
]


def wanted(rows):
    """The ids of an unaltered Tokenizer and the end id."""
    return [[*x.ids, 0] for x in Tokenizer.from_file(bytebpe.default_vocabulary()).encode_batch([r or "" for r in rows], add_special_tokens=False)]


@pytest.mark.parametrize("part", [1 << 22, 64])
def test_columns_equal_the_library(monkeypatch, part):
    """Columns that are cut at spaces and line feeds, sliced ones and parts of few texts; text by text the same."""
    monkeypatch.setattr(bytebpe, "PART_BYTES", part)
    rnd = random.Random(2)
    signs = ["a", "é", "word", " ", " ", "\n", "\n", "\t", "\r", "\x0b", "\0", "\x1c", "\x85", "\xa0", "\u3000", "\u200b", ",", ".", "!!", "'s", "7", "<|endoftext|>"]
    rows = ODD + ["".join(rnd.choice(signs) for _ in range(rnd.randint(0, 9))) for _ in range(5_000 if part > 64 else 500)]
    want = wanted(rows)
    enc = bytebpe.Encoder(bytebpe.default_vocabulary(), 100)
    assert [[*np.frombuffer(enc.packed(r), "<u4"), 0] for r in rows] == want
    for first in (0, 7):
        got = {}
        for i, j, to, ids in enc.columns(pa.array(rows, pa.string()).slice(first), 0):
            got |= {first + k: ids[to[k - i] : to[k - i + 1]].tolist() for k in range(i, j)}
        assert [got[k] for k in range(first, len(rows))] == want[first:]
    assert [*enc.columns(pa.array([], pa.string()), 0)] == []


def test_each_piece_is_looked_up_once():
    """Of a column, however often it occurs; line feeds don't join the words beside them to one piece."""
    enc = bytebpe.Encoder(bytebpe.default_vocabulary(), 1000)
    asked = []

    class Asked(dict):
        def __getitem__(self, piece):
            asked.append(piece)
            return inner[piece]

    inner, enc.spaced = enc.spaced, Asked()
    texts = ["start one two\none two.\none two"] * 50
    [(_, _, to, ids)] = enc.columns(pa.array(texts), 0)
    assert len(asked) == len(set(asked)) <= 6
    assert ids.tolist() == [x for row in wanted(texts) for x in row] and len(to) == 51


@pytest.mark.parametrize("most", [1 << 21, 5])
def test_odd_white_space_in_files(spark, monkeypatch, most):
    monkeypatch.setattr(token_files, "IDS_PER_BATCH", most)
    want, start = [], 0
    for i, x in enumerate(wanted(ODD)):
        want.append((i, start, len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
        start += len(x)
    assert sorted(tuple(r) for r in token_files.token_table(fixtures.frame(spark, [*enumerate(ODD)])).collect()) == want
