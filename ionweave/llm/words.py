"""Words of many texts at once: where they lie and 64-bit hashes, with whole-array operations on UTF-8 bytes."""

from __future__ import annotations

import numpy as np
import xxhash

_IS_WORD = np.ones(256, bool)
_IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
#: The lower 0, 1, ... 8 bytes of a word of eight.
_LOWER = np.array([(1 << (8 * i)) - 1 for i in range(9)], np.uint64)
#: Two odd constants for each of two independent hashes.
_SEEDS = np.array([[0x9E3779B97F4A7C15, 0xD1342543DE82EF95], [0xAF251AF3B0F025B5, 0xF1357AEA2E62A9C5]], np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads their bits."""
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x81DADEF4BC2DD44D)
    h ^= h >> np.uint64(33)
    return h


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and end byte of each word (maximal runs without white space), and the text it is in."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    is_word = _IS_WORD[data]
    before = np.empty(len(data) + 1, bool)
    before[0] = before[-1] = False
    before[1:-1] = is_word[:-1]
    cuts = offs[(offs > 0) & (offs < len(data))]
    before[cuts] = False  # a text's first byte begins a word whatever stands before
    starts = np.flatnonzero(is_word & ~before[:-1])
    after = np.empty(len(data), bool)
    after[:-1] = is_word[1:]
    after[-1] = False
    after[cuts - 1] = False
    ends = np.flatnonzero(is_word & ~after) + 1
    return starts, ends, np.searchsorted(offs, starts, side="right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, streams: int = 1) -> list[np.ndarray]:
    """One or two independent 64-bit hashes of each word's bytes.

    A word of up to eight bytes is one integer, which is mixed by a bijection:
    such words of one length never collide. Longer ones mix in a second integer, and those
    of more than sixteen bytes get the halves of their XXH3-128.
    """
    if not len(starts):
        return [np.zeros(0, np.uint64)] * streams
    padded = np.zeros(len(data) + 16, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 9,), "<u8", padded, strides=(1,))  # the eight bytes from each place on
    size = ends - starts
    first = eight[starts] & _LOWER[np.minimum(size, 8)]
    out = [mixed((first + c) ^ (size.astype(np.uint64) * k)) for c, k in _SEEDS[:streams]]
    more = np.flatnonzero((size > 8) & (size <= 16))
    if len(more):
        second = eight[starts[more] + 8] & _LOWER[size[more] - 8]
        for h, (_, k) in zip(out, _SEEDS):
            h[more] = mixed(h[more] ^ (second * k))
    long = np.flatnonzero(size > 16)
    if len(long):
        raw = data.tobytes()
        found = b"".join(xxhash.xxh3_128_digest(raw[a:b]) for a, b in zip(starts[long].tolist(), ends[long].tolist()))
        for h, half in zip(out, np.frombuffer(found, "<u8").reshape(-1, 2).T):
            h[long] = half
    return out


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive hashes (one for each start).

    Windows of 2, 4, 8 ... are mixed from two halves, those of k from two that overlap;
    as each step mixes, sequences that cancel out in a polynomial hash don't here.
    """
    n = len(h) - k + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    two = lambda a, b: mixed(a * np.uint64(0xC2B2AE3D27D4EB4F) + (b ^ (b >> np.uint64(32))) * np.uint64(0x165667B19E3779F9))
    width = 1
    while 2 * width <= k:
        h = two(h[:-width], h[width:])
        width *= 2
    return h if width == k else two(h[:n], h[k - width :][:n])
