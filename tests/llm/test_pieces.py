"""Pieces against the sentencepiece library, decoding against the text."""

import random
import zlib

import numpy as np
import pytest
from sentencepiece import SentencePieceProcessor

from vettrail.llm import pieces

from . import fixtures


@pytest.fixture(scope="module")
def library():
    return SentencePieceProcessor(model_file=pieces.default_model())


def packed(library, text):
    return np.array(library.encode(text), "<u4").tobytes()


def test_words_and_marks(library):
    own = pieces.pieces(pieces.default_model())
    rnd = random.Random(2)
    texts = ["", " ", "   ", "a  b", "a\nb \n c", "\t", " x ", "é😀 漢字", "x▁y", "aaaaaaaaaaaaaaaa", "ababab" * 40, " " * 50 + "x" + " " * 33, "don't stop—now"]
    texts += ["".join(rnd.choice("abcdeiorstn  \n.,é'漢😀0159▁") for _ in range(rnd.randint(1, 60))) for _ in range(1500)]
    texts += ["".join(rnd.choice("etaoinshr") for _ in range(rnd.randint(1, 40))) for _ in range(1500)]
    assert own.encode(texts) == [packed(library, t) for t in texts]


def test_documents(spark, sf, library):
    rows = fixtures.documents(sf)
    out = {(r.doc_id, r.n_tokens, r.ids_crc32): r for r in pieces.encode_documents(fixtures.frame(spark, rows).repartition(3)).collect()}
    for key, text in rows:
        ids = packed(library, text or "")
        r = out[key, len(ids) // 4, zlib.crc32(ids)]
        assert r.round_trip and r.decoded_crc32 == zlib.crc32((text or "").encode())


def test_shared_prefixes_are_computed_once():
    own = pieces.Pieces(pieces.default_model())
    asked = []
    real = own._pair
    own._pair = lambda a, b: asked.append(1) or real(a, b)
    own.segment(["▁transformation"])
    alone = len(asked)
    own.segment(["▁transformation", "▁transformations", "▁transformationx", "▁transformationxy"])
    assert len(asked) < 4 * alone


def test_small_cache_gives_the_same(monkeypatch, library):
    monkeypatch.setattr(pieces, "CACHED_WORDS", 20)
    monkeypatch.setattr(pieces, "CACHED_PAIRS", 10)
    own = pieces.Pieces(pieces.default_model())
    for i in range(20):
        text = " ".join(f"word{i}{j} other" for j in range(i))
        assert own.encode([text, text]) == [packed(library, text)] * 2


def test_empty(spark):
    assert pieces.encode_documents(fixtures.frame(spark, []).filter("doc_id = 1")).collect() == []
