"""Windows of tokens and the sampled suffixes that anchor them: numpy kernels of the suffix operators."""

from __future__ import annotations

import numpy as np

from .common import mix, powers, prefix_sums, range_hash

#: Low bits of a sort key that hold the position; the rest is the gram's hash.
POSITION_BITS = 31


def window_hashes(sums: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of `size` bytes; equals range_hash() of the same bytes."""
    _, down = powers(len(sums))
    n = len(sums) - size
    with np.errstate(over="ignore"):
        return mix((sums[size:] - sums[:-size]) * down[:n] + np.uint64(size) * np.uint64(0xD6E8FEB86659FD93))


def anchor_runs(values: np.ndarray, start: np.ndarray, end: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...] | None:
    """For each run of windows of `length` tokens with one anchor: text, first window, windows, anchor, anchor's hash, run's hash.

    values: a 64-bit value for each token; text i has the tokens from start[i] to end[i].
    """
    long = np.flatnonzero(end - start >= length)
    if not len(long):
        return None
    sums = prefix_sums(values)
    grams = window_hashes(sums, gram)
    low = np.uint64((1 << POSITION_BITS) - 1)
    least = grams & ~low | np.arange(len(grams), dtype=np.uint64)
    width, have = length - gram + 1, 1
    while 2 * have <= width:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < width:
        rest = width - have
        least = np.minimum(least[:-rest], least[rest:])
    inside = np.zeros(len(least) + 1, np.int8)
    inside[start[long]] += 1
    inside[end[long] - length + 1] -= 1
    at = np.flatnonzero(np.cumsum(inside[:-1]))
    anchor = (least[at] & low).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
    lo, anchor = at[first], anchor[first]
    n = np.diff(np.concatenate((first, [len(at)])))
    with np.errstate(over="ignore"):
        whole = mix(range_hash(sums, lo, lo + n + length - 1) ^ (anchor - lo).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    text = long[np.searchsorted(start[long], lo, "right") - 1]
    return text, lo - start[text], n, anchor - lo, grams[anchor].view(np.int64), whole.view(np.int64)


def stretches(flags: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First index and size of each stretch of set flags that has one owner."""
    on = np.flatnonzero(flags)
    if not len(on):
        return on, on
    cut = np.flatnonzero(np.concatenate(([True], (on[1:] != on[:-1] + 1) | (owner[on[1:]] != owner[on[:-1]]))))
    return on[cut], np.diff(np.concatenate((cut, [len(on)])))
