"""Packing against sequential best-fit decreasing and against the tokenizer itself."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from vettrail.llm import packing
from vettrail.llm.bytebpe import default_vocabulary, encoder

from . import fixtures


def best_fit(lengths, capacity):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= n]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - n)
        else:
            gaps.append(capacity - n)
    return len(gaps)


@pytest.mark.parametrize("seed", range(8))
def test_sweep_is_best_fit_decreasing(seed):
    rnd = random.Random(seed)
    lengths = [min(64, int(rnd.paretovariate(0.8))) if seed % 2 else rnd.randint(1, 64) for _ in range(rnd.randint(1, 900))]
    counts, places = Counter(lengths), defaultdict(list)
    runs = sorted(packing.sweep(counts, 64))
    for n, (length, first, seq, each, offset) in enumerate(runs):
        following = runs[n + 1][1] if n + 1 < len(runs) and runs[n + 1][0] == length else counts[length]
        for i in range(following - first):
            places[seq + i // each].append((offset + i % each * length, length))
    assert sum(map(len, places.values())) == len(lengths)
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64
    assert len(places) == best_fit(lengths, 64)


def test_pack_documents(spark, sf):
    rows = fixtures.documents(sf)
    out = packing.pack_documents(fixtures.frame(spark, rows).repartition(3)).collect()
    tokenizer = encoder(default_vocabulary()).tokenizer
    want = Counter()
    for (i, _), e in zip(rows, tokenizer.encode_batch([t or "" for _, t in rows], add_special_tokens=False)):
        ids = np.array(e.ids + [0], "<u4")
        cuts = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)]
        for p, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[i, p, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    places = defaultdict(list)
    for r in out:
        places[r.sequence_id].append((r.offset, r.length))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(places) == best_fit([r.length for r in out], 2048)


def test_pack_nothing(spark):
    assert packing.pack_documents(fixtures.frame(spark, []).filter("doc_id = 1")).collect() == []


def test_added_tokens_as_the_library_has_them():
    """Texts that hold an added token, against a Tokenizer as it is read from the file."""
    plain = Tokenizer.from_file(default_vocabulary())
    texts = ["<|endoftext|>", "one <|endoftext|> two", "one  <|endoftext|>\n\n two<|endoftext|><|endoftext|>", " it's 12<|endoftext|>é", "<|endoftext| >", "<|endoftext|"]
    for text in texts:
        ids = plain.encode(text, add_special_tokens=False).ids
        assert (50256 in ids) == ("<|endoftext|>" in text)
        assert np.frombuffer(encoder(default_vocabulary()).packed(text), "<u4").tolist() == ids
