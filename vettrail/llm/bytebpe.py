"""Byte-level BPE of whole texts into packed ids, with the tokenizers library's own model.

A text is cut into pre-tokens by the vocabulary's published pattern; each distinct pre-token goes once
through the library's merge model, and its ids are kept as packed little-endian 32-bit integers. A
text's ids are then the joined pieces: the same ids as Tokenizer.encode(text, add_special_tokens=False),
several times as fast. A text that holds one of the file's added tokens, such as <|endoftext|>, goes
through Tokenizer.encode itself. The tests compare the two. Whole columns are cut by Arrow and each distinct
piece of some megabytes of text is looked up once.
"""

from __future__ import annotations

import functools
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers import Tokenizer

#: Entries of each generation of the two caches that a Python worker keeps between tasks, unless told otherwise: some 80 MB.
CACHE_ENTRIES = 300_000
#: Bytes of text whose pieces are looked up together; a longer single text is a part by itself.
PART_BYTES = 1 << 22
#: Stands for a line feed that begins a piece of a column.
LINE = "\0"
#: White space next to white space, for RE2; a few characters more than the pattern's \\s do no harm.
RUNS = r"[\s\v\x1c-\x1f\x{85}\p{Z}]{2}"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte: printable Latin-1 is itself, the rest follows U+0100."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {b: chr(b) for b in printable}
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + len(out) - len(printable))
    return out


class _Pieces(dict):
    """Ids of pre-tokens that don't begin with a space, found when first asked for.

    Two generations: a full young one becomes the old one, and what is asked for again comes back.
    """

    def __init__(self, find, most: int):
        self.find, self.most, self.old = find, most, {}

    def __missing__(self, piece: str) -> bytes:
        out = self.old.get(piece)
        if out is None:
            out = self.find(piece)
        if len(piece) <= 64:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[piece] = out
        return out


class _Spaced(_Pieces):
    """Ids of a space and what follows it up to the next space, which may be several pre-tokens; after LINE, of a line feed and what follows it."""

    def __init__(self, find, split, plain, most: int):
        super().__init__(self._several, most)
        self.one, self.split, self.plain = find, split, plain

    def _several(self, chunk: str) -> bytes:
        if chunk.isalpha():  # letters alone are one pre-token
            return self.one(" " + chunk)
        if chunk[-1:] in (",", ".") and chunk[:-1].isalpha():
            return self[chunk[:-1]] + self.plain[chunk[-1]]
        if chunk[:1] == LINE:
            word = chunk[1:]
            if word[-1:] in (",", ".") and word[:-1].isalpha():
                return self.plain["\n"] + self.plain[word[:-1]] + self.plain[word[-1]]
            return self.plain["\n"] + (self.plain[word] if word.isalpha() else b"".join([self.plain[x] for x in self.split(word)]))
        pieces = self.split(" " + chunk)
        if len(pieces) == 1:
            return self.one(pieces[0])
        return b"".join([self[x[1:]] if x[0] == " " and x != " " else self.plain[x] for x in pieces])


#: Packs so many ids.
_PACK = [struct.Struct(f"<{n}I").pack for n in range(16)]


class Encoder:
    def __init__(self, path: str, entries: int):
        import public_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = self.tokenizer.model
        if hasattr(self.model, "_resize_cache"):  # each piece comes once; the library's own cache would only cost time
            self.model._resize_cache(0)
        self.tokenize = self.model.tokenize
        self.split = regex.compile(public_tokenizers.PATTERN).findall
        self.alphabet = str.maketrans({chr(b): c for b, c in _byte_alphabet().items()})
        self.space = " ".translate(self.alphabet)
        self.plain = _Pieces(self._merge, entries)
        self.spaced = _Spaced(self._merge, self.split, self.plain, entries)

    def _merge(self, piece: str) -> bytes:
        marked = self.space + piece[1:] if piece[0] == " " and piece.isascii() and piece[1:].isalpha() else piece.encode().decode("latin-1").translate(self.alphabet)
        ids = [x.id for x in self.tokenize(marked)]
        return _PACK[len(ids)](*ids) if len(ids) < len(_PACK) else struct.pack(f"<{len(ids)}I", *ids)

    def packed(self, text: str | None) -> bytes:
        """The ids of a whole text, four bytes each; nothing for a null or empty text.

        A space between two characters that aren't spaces always begins a pre-token, so the text may be
        cut there and each cut looked up as a whole. Texts with runs of spaces, or with no-break spaces, which
        the vocabulary merges with spaces, go pre-token by pre-token.
        """
        if not text:
            return b""
        for token in self.added:
            if token in text:
                ids = self.tokenizer.encode(text, add_special_tokens=False).ids
                return struct.pack(f"<{len(ids)}I", *ids)
        if "  " in text or LINE in text or "\xa0" in text:
            return b"".join(map(self.plain.__getitem__, self.split(text)))
        first, *rest = text.split(" ")
        return b"".join(map(self.plain.__getitem__, self.split(first))) + b"".join(map(self.spaced.__getitem__, rest))

    def columns(self, texts: pa.Array, end: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Parts of a column of texts: from row, to row, offsets (one more than rows), ids; each text's are those of packed(), and the end id."""
        texts = texts.fill_null("")
        to = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
        i = 0
        while i < len(texts):
            j = max(i + 1, int(np.searchsorted(to, (to[i - 1] if i else 0) + PART_BYTES, "right")))
            yield i, j, *self._column(texts.slice(i, j - i), end)
            i = j

    def _column(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """A line feed between two characters that aren't white space, or at an end, is a pre-token by itself, so texts are cut there too."""
        apart = pc.match_substring_regex(texts, RUNS).to_numpy(zero_copy_only=False)
        for mark in (LINE, *self.added):
            apart = apart | pc.match_substring(texts, mark).to_numpy(zero_copy_only=False)
        whole = {i: self.packed(texts[i].as_py()) for i in np.flatnonzero(apart).tolist()}
        cut = pc.split_pattern(pc.replace_substring(pc.if_else(pa.array(apart), "", texts), "\n", f" {LINE}"), " ")
        at = cut.offsets.to_numpy().astype(np.int64)
        pieces = cut.values.slice(at[0], at[-1] - at[0]).dictionary_encode()
        at -= at[0]
        number = pieces.indices.to_numpy().astype(np.int64)
        # none holds a space
        kinds = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(pieces.dictionary)], pa.int32()), pieces.dictionary), " ")[0].as_py().split(" ")
        ids = [*map(self.spaced.__getitem__, kinds)]
        first = {}  # the first piece of a text has no space before it
        for i in set(number[at[:-1]].tolist()):
            first[i] = len(ids)
            ids.append(b"".join(map(self.plain.__getitem__, self.split(kinds[i]))))
        number[at[:-1]] = [first[i] for i in number[at[:-1]].tolist()]
        for i, x in whole.items():
            number[at[i]] = len(ids)
            ids.append(x)
        number = np.insert(number, at[1:], len(ids))
        ids.append(struct.pack("<I", end))
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        begin = np.cumsum(size) - size
        flat, size = np.frombuffer(b"".join(ids), "<i4"), size[number]
        to = np.concatenate(([0], np.cumsum(size)))
        out = flat[np.repeat(begin[number] - to[:-1], size) + np.arange(to[-1])]
        return to[at + np.arange(len(at))], out


@functools.lru_cache(maxsize=2)
def encoder(path: str, entries: int = CACHE_ENTRIES) -> Encoder:
    return Encoder(path, entries)
