"""SentencePiece encoding and decoding with a shared-prefix forward pass.

A text is marked (a mark before the text and for every space) and cut before each run of marks and
around line ends; no piece of the vocabulary crosses such a cut. The distinct words of a batch are
sorted, which lays them out as the depth-first order of their trie: going from one word to the next,
the forward scores of the common prefix stay on the stack and only the rest is computed.

The public vocabulary is one of merges by rank, for which the segmentation with the greatest sum of
scores is not the library's. The forward pass therefore ranks by merges: the score of a prefix is its last piece,
and a piece may extend a prefix when merging the last piece and it on their own leaves the two
as they are. Exactly one piece can do so at each place, hence the back-pointers of the forward pass are the
library's segmentation, and they depend on the prefix alone, which is what lets words share them.
Words that begin with several marks, whose pieces have equal ranks, are merged directly.

Defined results: a null text is empty, an empty text has no ids. Characters beyond the vocabulary
become byte pieces. Decoding turns marks into spaces, so a text that itself holds U+2581 comes back
with spaces there and round_trip is false. Repeated rows are encoded alike; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import heapq
import re
import string
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: Words remembered by a Python worker between batches, pair verdicts remembered.
CACHED_WORDS, CACHED_PAIRS = 500_000, 400_000
_WORDS = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n").findall


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        self.rank: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.bytes = [0] * 256
        self.shown: list[bytes] = []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[1:-1], 16)
                self.bytes[value] = i
                self.shown.append(bytes([value]))
            elif model.is_control(i) or model.is_unknown(i):
                self.shown.append(b"")
            else:
                self.rank[piece], self.ids[piece] = model.get_score(i), i
                self.shown.append(piece.replace(MARK, " ").encode())
        self.longest = max(map(len, self.ids))
        order = sorted({-x for x in self.rank.values()})
        self.order = {p: bisect_left(order, -x) for p, x in self.rank.items()}
        # only pieces that their own merges lead to can stand in a segmentation; of each, its last merge
        self.last_merge: dict[str, tuple[str, str]] = {}
        self.whole = {p for p in self.ids if self.merge(p, self.last_merge) == [p]}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.known: dict[str, bytes] = {}
        self.code = {p: np.array([i], "<u4").tobytes() for p, i in self.ids.items()}
        # punctuation that no piece joins to a letter: words may be cut between the two
        joined = {c for p in self.ids for pair in zip(p, p[1:]) if any(map(str.isalpha, pair)) for c in pair}
        free = "".join(re.escape(c) for c in string.punctuation if c not in joined)
        letter = r"[^\W\d_]"
        self.parts = re.compile(f"(?<={letter})(?=[{free}])|(?<=[{free}])(?={letter})").split if free else lambda w: [w]

    def merge(self, word: str, last_merge: dict[str, tuple[str, str]] | None = None) -> list[str]:
        """Merges by rank, the leftmost of equals first; notes what the word as a whole was made of."""
        parts: list[str | None] = list(word)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        rank, heap = self.rank, []

        def offer(i: int, j: int) -> None:
            both = parts[i] + parts[j]
            if both in rank:
                heapq.heappush(heap, (-rank[both], i, j, both))

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, both = heapq.heappop(heap)
            if parts[i] is None or j >= len(parts) or parts[j] is None or after[i] != j or parts[i] + parts[j] != both:
                continue
            if last_merge is not None and len(both) == len(word):
                last_merge[word] = (parts[i], parts[j])
            parts[i], parts[j], after[i] = both, None, after[j]
            if after[j] < len(parts):
                before[after[j]] = i
                offer(i, after[j])
            if before[i] >= 0:
                offer(before[i], i)
        return [p for p in parts if p is not None]

    def _pair(self, a: str, b: str) -> bool:
        """Whether merging a + b ends in a and b: the pieces' merges are undone, the latest first, and none of
        the merges across the cut that this lays open may come before the one just undone."""
        key = (a, b)
        found = self.pairs.get(key)
        if found is not None:
            return found
        order, made, bound, found = self.order, self.last_merge, len(self.order), True
        while True:
            across = order.get(a + b)
            if across is not None and across < bound:
                found = False
                break
            left, right = made.get(a), made.get(b)
            if left is None and right is None:
                break
            if right is None or left is not None and order[a] > order[b]:
                bound, a = order[a], left[1]
            else:  # of equals the left one came first
                bound, b = order[b] + 1, right[0]
        if len(self.pairs) >= CACHED_PAIRS:
            self.pairs.clear()
        self.pairs[key] = found
        return found

    def _packed(self, pieces: list[str]) -> bytes:
        try:
            return b"".join([self.code[p] for p in pieces])
        except KeyError:  # characters beyond the vocabulary
            ids = [i for p in pieces for i in ([self.ids[p]] if p in self.ids else [self.bytes[b] for b in p.encode()])]
            return np.array(ids, "<u4").tobytes()

    def segment(self, words: list[str]) -> dict[str, bytes]:
        """Packed ids of distinct words: sorted, depth-first over their trie."""
        parts = {w: [w] if w.lstrip(MARK).isalpha() else self.parts(w) for w in words}
        out: dict[str, bytes] = {}
        whole, longest, pair = self.whole, self.longest, self._pair
        last: list[str] = [""]  # last[i]: the last piece of the segmentation of the first i characters
        previous = ""
        for word in sorted({x for own in parts.values() for x in own}):
            if word[:2] == MARK + MARK:
                out[word] = self._packed(self.merge(word))
                continue
            shared, most = 0, min(len(word), len(previous))
            while shared < most and word[shared] == previous[shared]:
                shared += 1
            del last[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                for start in range(max(0, end - longest), end):
                    piece = word[start:end]
                    if piece in whole and (not start or pair(last[start], piece)):
                        break
                else:
                    piece = word[end - 1]
                last.append(piece)
            pieces, at = [], len(word)
            while at:
                pieces.append(last[at])
                at -= len(last[at])
            out[word] = self._packed(pieces[::-1])
            previous = word
        return {w: out[own[0]] if len(own) == 1 else b"".join([out[x] for x in own]) for w, own in parts.items()}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed little-endian 32-bit ids of each text."""
        marked = [_WORDS(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        known = self.known
        new = {w for ws in marked for w in ws if w not in known}
        found = self.segment([*new])
        if len(known) + len(found) > CACHED_WORDS:  # what this batch needs is all that stays
            known = self.known = {w: known[w] for ws in marked for w in ws if w in known}
        known.update(found)
        return [b"".join(map(known.__getitem__, ws)) for ws in marked]

    def decode(self, packed: bytes) -> str:
        text = b"".join(map(self.shown.__getitem__, np.frombuffer(packed, "<u4").tolist())).decode(errors="replace")
        return text[1:] if text[:1] == " " else text


@functools.lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


_OUT = "doc_id long, n_tokens long, ids_crc32 long, decoded_crc32 long, round_trip boolean"


def encode_documents(docs: DataFrame, model: str | None = None) -> DataFrame:
    """Tokens and their checksum for every whole text, and whether decoding gives the text again."""
    path = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(path)
        for batch in batches:
            texts = [t or "" for t in batch["text"].to_pylist()]
            packed = own.encode(texts)
            back = [own.decode(p) for p in packed]
            columns = [
                batch["doc_id"], pa.array([len(p) // 4 for p in packed], pa.int64()), pa.array([zlib.crc32(p) for p in packed], pa.int64()),
                pa.array([zlib.crc32(b.encode()) for b in back], pa.int64()), pa.array([a == b for a, b in zip(texts, back)], pa.bool_()),
            ]
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in _OUT.split(", ")])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return source.mapInArrow(run, _OUT)
