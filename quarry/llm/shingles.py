"""Word shingles of whole texts as 64-bit values, by arrays over the bytes of many texts at once.

Words are what stands between the bytes 0x20 and 0x09-0x0D after A-Z became a-z. A text's shingles
are its distinct runs of WIDTH words; with fewer words the whole sequence is one shingle; without
words there is none.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

WIDTH = 5
#: Bytes of text that go through the arrays at once.
GROUP_BYTES = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
_rng = np.random.default_rng(20240229)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] = _LOWER[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_PLACE = _rng.integers(1, 1 << 63, WIDTH, dtype=np.uint64) | np.uint64(1)
_SHORT = _rng.integers(1, 1 << 63, WIDTH + 1, dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(joined: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A hash of each word joined[start:stop]: its blocks of eight bytes are mixed, each with its place, before they are added up."""
    padded = np.append(_LOWER[joined], np.zeros(8, np.uint8))
    eight = np.ndarray(len(joined), "<u8", padded, strides=(1,))  # the eight bytes from each place on
    length = stops - starts
    blocks = (length + 7) >> 3
    begins = np.cumsum(blocks) - blocks
    place = np.arange(int(blocks.sum())) - np.repeat(begins, blocks)
    value = eight[np.repeat(starts, blocks) + 8 * place]
    rest = np.minimum(np.repeat(length, blocks) - 8 * place, 8)
    value &= ~np.uint64(0) >> (64 - 8 * rest).astype(np.uint64)
    value = mixed(mixed(value) + mixed((place + 1).astype(np.uint64) * _ODD))
    total = np.add.reduceat(value, begins) if len(begins) else value
    return mixed(total + length.astype(np.uint64) * _ODD)


def _group(texts: list[bytes]) -> Iterator[np.ndarray]:
    joined = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    ends = np.cumsum([len(x) + 1 for x in texts])
    space = _SPACE[joined]
    word = ~space
    starts = np.flatnonzero(word & np.append(True, space[:-1]))
    stops = np.flatnonzero(space & np.append(False, word[:-1]))
    words = word_hashes(joined, starts, stops)
    cut = np.searchsorted(starts, ends)
    full = np.zeros(max(0, len(words) - WIDTH + 1), np.uint64)
    for k in range(WIDTH):
        full += mixed(words[k : k + len(full)] * _PLACE[k])
    full = mixed(full)
    first = 0
    for last in cut.tolist():
        n = last - first
        if n >= WIDTH:
            yield np.unique(full[first : last - WIDTH + 1])
        elif n:
            yield mixed(_SHORT[n : n + 1] + mixed(words[first:last] * _PLACE[:n]).sum(keepdims=True, dtype=np.uint64))
        else:
            yield np.zeros(0, np.uint64)
        first = last


def shingle_sets(texts: Iterable[str]) -> Iterator[np.ndarray]:
    """For each text its distinct shingles, ascending."""
    group, size = [], 0
    for text in texts:
        data = (text or "").encode("utf-8")
        if group and size + len(data) > GROUP_BYTES:
            yield from _group(group)
            group, size = [], 0
        group.append(data)
        size += len(data) + 1
    if group:
        yield from _group(group)
