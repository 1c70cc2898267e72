"""A bidirectional FM-index over a delimited vocabulary, searched for many patterns at once.

The words stand in order, each between delimiters: ``$w1$w2$...$``. Suffixes that are equal up to
their delimiter are ordered by the word, so a rank among the suffixes that begin with a delimiter is
the number of a word. One index holds the text, its twin the mirrored words; a search that starts at
the right half extends to the left in the first, one that starts at the left half extends to the
right in the second. A search scheme names which part is exact and which may hold the error.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

# Wider intervals are extended symbol by symbol, narrower ones row by row: the cost differs, not
# the result.
_ROWS = 64
# Symbol 0 is the delimiter, 1 what stands left of the first one; letters follow.
LETTERS = 2


class Index:
    """FM-index of distinct words, which it keeps in sorted order."""

    def __init__(self, words: Sequence[str]):
        self.words = sorted(set(words))
        points = np.frombuffer("".join(self.words).encode("utf-32-le"), "<u4")
        self.alphabet, codes = np.unique(points, return_inverse=True)
        lengths = np.fromiter(map(len, self.words), np.int64, len(self.words))
        self.starts = np.concatenate([np.zeros(1, np.int64), np.cumsum(lengths + 1)])
        n = int(self.starts[-1]) + 1
        text = np.zeros(n, np.int64)  # the delimiter, before each word and at the end
        inside = np.ones(n, bool)
        inside[self.starts] = False
        text[inside] = codes + LETTERS
        self.size = n
        suffixes = self._suffixes(text, inside)
        self.bwt = text[suffixes - 1].astype(np.int32)
        self.bwt[0] = LETTERS - 1  # nothing stands left of the first delimiter
        order = np.argsort(self.bwt, kind="stable")
        self.keys = self.bwt[order].astype(np.int64) * (n + 1) + order
        self.step = np.empty(n, np.int64)  # rank of the suffix one place further left
        self.step[order] = np.arange(n)
        self.symbols = len(self.alphabet) + LETTERS

    def _suffixes(self, text: np.ndarray, inside: np.ndarray) -> np.ndarray:
        """Suffixes in order: by what precedes their next delimiter, then by place."""
        n, bits = self.size, max(1, (len(self.alphabet) + LETTERS).bit_length())
        width = 62 // bits
        left = np.append(self.starts[1:], n - 1)  # of each word its closing delimiter
        owner = np.cumsum(~inside) - 1
        room = left[np.minimum(owner, len(left) - 1)] - np.arange(n)  # symbols before it
        room[~inside] = 0
        key = np.zeros(n, np.int64)
        for k in range(width):
            key <<= bits
            reach = np.flatnonzero(room > k)
            key[reach] |= text[reach + k]
        longest = int(room.max(initial=0))
        rank = self._ranks(key)
        while width < longest:  # the part after the first `width` symbols decides next
            after = np.zeros(n, np.int64)
            reach = np.flatnonzero(room > width)
            after[reach] = rank[reach + width] + 1
            rank = self._ranks(rank * (n + 1) + after)
            width *= 2
        return np.argsort(rank, kind="stable")

    @staticmethod
    def _ranks(key: np.ndarray) -> np.ndarray:
        order = np.argsort(key, kind="stable")
        found = key[order]
        rank = np.empty(len(key), np.int64)
        rank[order] = np.concatenate([np.zeros(1, np.int64), np.cumsum(found[1:] != found[:-1])])
        return rank

    def codes(self, text: str) -> np.ndarray:
        """Symbols of a word of the vocabulary."""
        points = np.frombuffer(text.encode("utf-32-le"), "<u4")
        return np.searchsorted(self.alphabet, points) + LETTERS

    def extend(self, low: np.ndarray, high: np.ndarray, symbol: np.ndarray):
        """Suffix-rank intervals after one more symbol on the left; empty where it never stands."""
        one = high - low == 1
        row = np.minimum(low, self.size - 1)
        hit = self.bwt[row] == symbol
        new_low = np.where(one & hit, self.step[row], 0)
        new_high = np.where(one & hit, new_low + 1, 0)
        many = np.flatnonzero(~one & (high > low))
        if len(many):
            base = symbol[many] * np.int64(self.size + 1)
            new_low[many] = np.searchsorted(self.keys, base + low[many])
            new_high[many] = np.searchsorted(self.keys, base + high[many])
        return new_low, new_high

    def children(self, low: np.ndarray, high: np.ndarray):
        """All extensions of distinct intervals by a symbol: parent, symbol, low, high; by parent."""
        wide = np.flatnonzero(high - low > _ROWS)
        narrow = np.flatnonzero(high - low <= _ROWS)
        sizes = (high - low)[narrow]
        parent = np.repeat(narrow, sizes)
        place = np.arange(len(parent)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        rows = low[parent] + place
        key = parent * np.int64(self.symbols) + self.bwt[rows]
        order = np.argsort(key, kind="stable")
        key, to = key[order], self.step[rows[order]]
        begin = np.flatnonzero(np.concatenate([np.ones(min(1, len(key)), bool), key[1:] != key[:-1]]))
        count = np.diff(np.append(begin, len(key)))
        found = [(key[begin], to[begin], to[begin] + count)]
        for symbol in range(LETTERS, self.symbols if len(wide) else 0):
            base = np.int64(symbol) * (self.size + 1)
            a = np.searchsorted(self.keys, base + low[wide])
            b = np.searchsorted(self.keys, base + high[wide])
            some = b > a
            found.append((wide[some] * np.int64(self.symbols) + symbol, a[some], b[some]))
        key = np.concatenate([f[0] for f in found])
        order = np.argsort(key, kind="stable")
        key = key[order]
        parent = key // self.symbols
        return (parent, key - parent * self.symbols,
                np.concatenate([f[1] for f in found])[order],
                np.concatenate([f[2] for f in found])[order])


class _Patterns:
    """Symbols of many words, one after the other; the place before a word is its delimiter."""

    def __init__(self, index: Index, words: Sequence[str]):
        codes = index.codes("".join(words))
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        self.start = np.cumsum(lengths + 1) - lengths
        self.flat = np.zeros(int(lengths.sum()) + len(words) + 1, np.int64)
        inside = np.ones(len(self.flat), bool)
        inside[self.start - 1] = inside[-1] = False
        self.flat[inside] = codes
        self.length = lengths

    def symbol(self, word: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.flat[self.start[word] + at]


def one_error(index: Index, words: Sequence[str], low_end: np.ndarray, high_end: np.ndarray,
              shorter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (pattern, word of the index) that differ by exactly one code point.

    What stands right of ``high_end`` in a pattern must match exactly and is matched first; the one
    error lies in ``[low_end, high_end)``, and what stands left of it is exact again. ``shorter``
    patterns lose a code point, the others have one replaced or inserted (at ``high_end`` at the
    latest). All patterns move in step, so memory is a few numbers per live interval.
    """
    if not len(words):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    patterns = _Patterns(index, words)
    n = len(words)
    ident, at = np.arange(n), patterns.length - 1
    low, high = np.zeros(n, np.int64), np.full(n, len(index.starts), np.int64)
    empty = np.empty(0, np.int64)
    bad = (empty, empty, empty, empty)  # pattern, place to match next, interval: one error made
    hits: list[tuple[np.ndarray, np.ndarray]] = []
    while len(ident) or len(bad[0]):
        # Exact so far: where the error may come, every extension is also tried as the error.
        made = [bad]
        in_zone = (at < high_end[ident]) & (at >= low_end[ident] - 1)
        here = np.flatnonzero(in_zone)
        lose = here[shorter[ident[here]] & (at[here] >= low_end[ident[here]])]
        made.append((ident[lose], at[lose] - 1, low[lose], high[lose]))
        change = here[~shorter[ident[here]]]
        if len(change):
            spans, which = np.unique(low[change] * np.int64(index.size + 1) + high[change],
                                     return_inverse=True)
            parent, symbol, a, b = index.children(spans // (index.size + 1),
                                                  spans % (index.size + 1))
            begin = np.searchsorted(parent, np.arange(len(spans) + 1))
            sizes = np.diff(begin)[which]
            who = np.repeat(change, sizes)
            child = np.repeat(begin[which], sizes) + np.arange(len(who)) - np.repeat(
                np.cumsum(sizes) - sizes, sizes)
            word, place, new = ident[who], at[who], symbol[child]
            other = new >= LETTERS
            replaced = other & (place >= low_end[word]) & (new != patterns.symbol(word, place))
            for keep, back in ((replaced, 1), (other, 0)):
                made.append((word[keep], place[keep] - back, a[child[keep]], b[child[keep]]))
        bad = tuple(np.concatenate(part) for part in zip(*made))
        # One symbol further, for both kinds; a match of the delimiter on the left ends a search.
        low, high = index.extend(low, high, patterns.symbol(ident, at))
        live = (high > low) & (at >= low_end[ident])
        ident, at, low, high = ident[live], at[live] - 1, low[live], high[live]
        word, place, a, b = bad
        a, b = index.extend(a, b, patterns.symbol(word, place))
        ended = (b > a) & (place < 0)
        hits.append((word[ended], a[ended]))
        live = (b > a) & (place >= 0)
        bad = (word[live], place[live] - 1, a[live], b[live])
    return np.concatenate([h[0] for h in hits]), np.concatenate([h[1] for h in hits])
