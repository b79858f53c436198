"""A compressed full-text index over words: suffix order, wavelet matrix, matching statistics."""

from __future__ import annotations

import numpy as np

_ONE = np.uint64(1)


class BitRank:
    """Bits packed in 64-bit words, with the number of ones before each word."""

    def __init__(self, bits: np.ndarray) -> None:
        padded = np.zeros(len(bits) // 64 * 64 + 64, dtype=np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.zeros(len(self.words), dtype=np.int32)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])

    def ones(self, at: np.ndarray) -> np.ndarray:
        """How many of the first `at` bits are set."""
        word = at >> 6
        below = (_ONE << (at & 63).astype(np.uint64)) - _ONE
        return self.before[word] + np.bitwise_count(self.words[word] & below)


class WaveletMatrix:
    """A sequence of symbols, one bit vector per binary digit; `occurrences` takes one step per
    digit for any number of questions at once."""

    def __init__(self, symbols: np.ndarray, alphabet: int) -> None:
        self.digits = max(1, int(alphabet - 1).bit_length())
        self.levels: list[BitRank] = []
        self.zeros: list[int] = []
        now = symbols
        for digit in reversed(range(self.digits)):
            bits = (now >> digit) & 1
            self.levels.append(BitRank(bits.astype(np.uint8)))
            self.zeros.append(int(len(now) - bits.sum()))
            now = np.concatenate([now[bits == 0], now[bits == 1]])
        everything = np.arange(alphabet)
        self.first = self._follow(everything, np.zeros(alphabet, dtype=np.int64))

    def _follow(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, (bits, zeros) in enumerate(zip(self.levels, self.zeros)):
            ones = bits.ones(at)
            at = np.where((symbol >> (self.digits - 1 - level)) & 1, zeros + ones, at - ones)
        return at

    def occurrences(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often `symbol` stands among the first `at` symbols."""
        return self._follow(symbol, at) - self.first[symbol]


class FMIndex:
    """An index of word sequences (arrays of word hashes, none longer than `longest` words).

    Every sequence ends with a terminator of its own, so no match goes across two of them.
    Suffixes are ordered by prefix doubling; the last word of the suffix before is kept in a
    wavelet matrix, the common prefixes of neighbours, cut at `width`, in one byte each.
    """

    def __init__(self, flat: np.ndarray, lengths: np.ndarray, width: int) -> None:
        if width > 120:
            raise ValueError("common prefixes are kept in one byte")
        self.width = width
        pieces = len(lengths)
        self.names, symbols = np.unique(flat, return_inverse=True)
        ends = np.cumsum(lengths + 1) - 1
        self.starts = ends - lengths
        text = np.zeros(len(flat) + pieces, dtype=np.int64)
        inside = np.ones(len(text), dtype=bool)
        inside[ends] = False
        text[inside] = symbols + 1
        self.size = len(text)
        order, levels = self._suffixes(text, inside, pieces, int(lengths.max(initial=0)))
        self.row = levels[-1]  # of every place of the text
        self.common = self._common_prefixes(order, levels[:-1])
        self.alphabet = len(self.names) + 1
        self.tree = WaveletMatrix(text[order - 1], self.alphabet)
        counts = np.bincount(text, minlength=self.alphabet)
        self.below = np.concatenate([[0], np.cumsum(counts)[:-1]])
        # rows whose suffixes agree in `width` words form a block
        head = np.flatnonzero(self.common[:-1] < width)
        self.block = np.cumsum(self.common[:-1] < width) - 1
        self.block_start = head
        self.block_end = np.append(head[1:], self.size)
        self.owner = np.searchsorted(ends, order)  # the sequence of each row
        self._least: list[np.ndarray] | None = None

    @staticmethod
    def _suffixes(text: np.ndarray, inside: np.ndarray, pieces: int, longest: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """The order of all suffixes, and their ranks by the first 1, 2, 4, ... words."""
        rank = np.where(inside, text + pieces, 0)
        rank[~inside] = np.arange(pieces)
        levels = [rank.astype(np.int32)]
        step, n = 1, len(text)
        after = np.zeros(n, dtype=np.int64)
        while True:
            after[:] = 0
            after[: n - step] = rank[step:]
            key = rank * np.int64(n + pieces + 2) + after
            order = np.argsort(key, kind="stable")
            new = np.ones(n, dtype=np.int64)
            new[0] = 0
            new[1:] = np.diff(key[order]) > 0
            rank = np.empty(n, dtype=np.int64)
            rank[order] = np.cumsum(new)
            levels.append(rank.astype(np.int32))
            step *= 2
            if step > longest + 1:
                return order, levels

    def _common_prefixes(self, order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
        """Words that each row shares with the row before, at most `width`; -1 at both ends."""
        a, b = order[:-1].copy(), order[1:].copy()
        shared = np.zeros(len(a), dtype=np.int64)
        for step, rank in reversed([(1 << k, r) for k, r in enumerate(levels)]):
            for _ in range(1 if step < 1 << (len(levels) - 1) else 2):
                same = (np.maximum(a, b) < self.size) & (shared < self.width)
                same[same] = rank[a[same]] == rank[b[same]]
                shared[same] += step
                a[same] += step
                b[same] += step
        out = np.full(self.size + 1, -1, dtype=np.int8)
        out[1:-1] = np.minimum(shared, self.width)
        return out

    def _wider(self, low: np.ndarray, high: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The largest interval around [low, high) whose rows share `depth` words: jumps of
        falling powers of two over the least common prefix of that many rows."""
        if self._least is None:
            self._least = [self.common]
            while (1 << len(self._least)) <= self.size:
                last, half = self._least[-1], 1 << (len(self._least) - 1)
                self._least.append(np.minimum(last[:-half], last[half:]))
        low, high = low.copy(), high.copy()
        for power in reversed(range(len(self._least))):
            jump, least = 1 << power, self._least[power]
            able = low - jump + 1 >= 0
            able[able] = least[low[able] - jump + 1] >= depth[able]
            low[able] -= jump
            able = high + jump <= len(self.common)
            able[able] = least[high[able]] >= depth[able]
            high[able] += jump
        return low, high

    def symbols(self, words: np.ndarray) -> np.ndarray:
        """The symbols of words; 0 for those that no sequence holds."""
        if not len(self.names):
            return np.zeros(len(words), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.names, words), len(self.names) - 1)
        return np.where(self.names[at] == words, at + 1, 0)

    def matching_statistics(self, words: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For every place of the streamed sequences (`lengths` words each, one after the other):
        how many words from there on stand somewhere in the index, up to `width`, and a row
        where they do.

        All sequences go backwards side by side, one word per step. Where the longer match is
        not there, the match is cut to the next shorter one that occurs elsewhere too.
        """
        symbol = self.symbols(words)
        found, row = np.zeros(len(words), dtype=np.int64), np.zeros(len(words), dtype=np.int64)
        first = np.cumsum(lengths) - lengths
        low = np.zeros(len(lengths), dtype=np.int64)
        high, depth = low + self.size, low.copy()
        for place in reversed(range(int(lengths.max(initial=0)))):
            live = np.flatnonzero(lengths > place)
            at = first[live] + place
            known = symbol[at] > 0
            low[live[~known]], high[live[~known]], depth[live[~known]] = 0, self.size, 0
            todo = live[known]
            while len(todo):
                c = symbol[first[todo] + place]
                both = self.tree.occurrences(np.tile(c, 2), np.concatenate([low[todo], high[todo]]))
                new_low, new_high = self.below[c] + both[: len(todo)], self.below[c] + both[len(todo) :]
                good = new_low < new_high
                done = todo[good]
                low[done], high[done] = new_low[good], new_high[good]
                depth[done] += 1
                todo = todo[~good]
                if len(todo):  # a known word extends the empty match, so this ends
                    shorter = np.maximum(self.common[low[todo]], self.common[high[todo]]).astype(np.int64)
                    shorter = np.maximum(shorter, 0)
                    low[todo], high[todo] = self._wider(low[todo], high[todo], shorter)
                    depth[todo] = shorter
            deep = live[depth[live] >= self.width]
            block = self.block[low[deep]]
            low[deep], high[deep], depth[deep] = self.block_start[block], self.block_end[block], self.width
            found[at], row[at] = depth[live], low[live]
        return found, row

    def least_by_block(self, value: np.ndarray) -> np.ndarray:
        """For every block, the least `value` of the sequences in it."""
        return np.minimum.reduceat(value[self.owner], self.block_start)
