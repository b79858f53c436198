"""Hashes of words and word sequences, computed on bytes for many texts at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes that are hashed at once; a cut falls between words.
BLOCK = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
BACK = np.uint64(pow(int(BASE), -1, 1 << 64))
_MIX = np.uint64(0xBF58476D1CE4E5B9)
#: A-Z to a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
UNCHANGED = np.arange(256, dtype=np.uint8)
#: Words are runs of anything but white space.
SOLID = np.ones(256, dtype=bool)
SOLID[[0x20, *range(0x09, 0x0E)]] = False
#: Words are runs of ASCII letters, digits and the bytes of other letters.
LETTERS = np.zeros(256, dtype=bool)
LETTERS[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out)


_UP, _DOWN = _powers(BASE, BLOCK + 1), _powers(BACK, BLOCK + 1)


def _block_end(data: np.ndarray, at: int, letter: np.ndarray) -> int:
    """The end of a block that starts at `at`: after the last byte between words, if there is
    one, else after the next one."""
    end = at + BLOCK
    while end < len(data):
        gap = np.flatnonzero(~letter[LOWER[data[max(at, end - BLOCK) : end]]])
        if len(gap):
            return max(at, end - BLOCK) + int(gap[-1]) + 1
        end += BLOCK
    return len(data)


def word_hashes(
    data: np.ndarray, breaks: np.ndarray, letter: np.ndarray = LETTERS, fold: np.ndarray = LOWER
) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word of `data` (bytes); no word goes across a position in `breaks`.

    A word is a run of the bytes marked in `letter`, as `fold` maps them. It has one hash
    wherever it stands: the sum of its bytes times powers of a base, divided by the power at its
    start.
    """
    starts, hashes, at = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], 0
    while at < len(data):
        end = _block_end(data, at, letter)
        block = fold[data[at:end]]
        up, down = (_UP, _DOWN) if len(block) <= BLOCK else (_powers(b, len(block)) for b in (BASE, BACK))
        inside = letter[block]
        first = np.ones(len(block) + 1, dtype=bool)  # a word may not go on from the byte before
        first[1:-1] = ~inside[:-1]
        first[breaks[np.searchsorted(breaks, at) : np.searchsorted(breaks, end)] - at] = True
        begin = np.flatnonzero(inside & first[:-1])
        last = np.flatnonzero(inside & np.append(~inside[1:] | first[1:-1], True)) + 1
        sums = np.zeros(len(block) + 1, dtype=np.uint64)
        np.cumsum((block.astype(np.uint64) + np.uint64(1)) * up[: len(block)], out=sums[1:])
        starts.append(begin + at)
        hashes.append(mix((sums[last] - sums[begin]) * down[begin]))
        at = end
    return np.concatenate(starts), np.concatenate(hashes)


def words(texts: pa.Array, letter: np.ndarray = LETTERS, fold: np.ndarray = LOWER) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hash of every word of a string array, in order."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    starts, found = word_hashes(data, offsets[:-1], letter, fold)
    return np.searchsorted(offsets, starts, side="right") - 1, found


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """For each text the sorted, distinct hashes of its runs of `width` words; a text of fewer
    words is one run. No words, no runs."""
    rows, found = words(texts, SOLID)
    bounds = np.searchsorted(rows, np.arange(len(texts) + 1))
    runs = found.copy()
    for i in range(1, width):
        runs = mix(runs[: len(found) - i] * BASE + found[i:]) if len(found) > i else runs[:0]
    out = []
    for start, end in zip(bounds[:-1], bounds[1:]):
        if end - start >= width:
            out.append(np.unique(runs[start : end - width + 1]))
            continue
        whole = np.zeros(0, np.uint64)
        if end > start:
            whole = np.array([end - start], dtype=np.uint64)
            for word in found[start:end]:
                whole = mix(whole * BASE + word)
        out.append(whole)
    return out
