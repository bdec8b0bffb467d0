"""Words and shingles of many texts at once, as 64-bit hashes, in numpy."""

from __future__ import annotations

import numpy as np

_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_rng = np.random.default_rng(20240229)
#: Bytes whose words are hashed by one running sum, about.
PIECE = 1 << 20
#: A random number for each byte, upper-case ASCII letters as their lower case.
_LETTER = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_LETTER[ord("A") : ord("Z") + 1] = _LETTER[ord("a") : ord("z") + 1]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_ORDER = _rng.integers(1, 1 << 63, 8, dtype=np.uint64) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64 bits over one another."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of the multiplier and of its inverse, modulo 2**64."""
    if len(_powers[0]) <= n:
        size = 1 << (n + 1).bit_length()
        for k, base in enumerate((_MULTIPLIER, pow(_MULTIPLIER, -1, 1 << 64))):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of many texts, A-Z taken as a-z, and hashes of any part of them."""

    def __init__(self, texts: list[bytes]):
        self.data = data = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
        space = _SPACE[data]
        # A word starts after a space and ends before one.
        self.starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
        self.ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
        # Sums start anew at the first word after each PIECE bytes, so that the powers stay short.
        cuts = [0]
        while (k := int(np.searchsorted(self.starts, cuts[-1] + PIECE))) < len(self.starts):
            cuts.append(int(self.starts[k]))
        self.total = np.empty(len(data) + 1, np.uint64)
        for a, b in zip(cuts, [*cuts[1:], len(data)], strict=True):
            up, self.down = _power(b - a)
            self.total[a] = 0
            np.cumsum(_LETTER[data[a:b]] * up[: b - a], out=self.total[a + 1 : b + 1])
        self.place = self.starts - np.array(cuts)[np.searchsorted(cuts, self.starts, side="right") - 1]
        lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        #: Words of text i are numbers first[i] to first[i + 1] - 1.
        self.first = np.searchsorted(self.starts, np.concatenate([[1], 1 + np.cumsum(lengths)]))

    def strip(self, around: bytes) -> None:
        """Leave bytes of ``around`` out at both ends of each word; a word of nothing else becomes empty."""
        out = np.zeros(256, bool)
        out[list(around)] = True
        for step, edge in ((1, self.starts), (-1, self.ends)):
            open_ = np.arange(len(edge))
            while len(open_ := open_[(self.starts[open_] < self.ends[open_]) & out[self.data[edge[open_] - (step < 0)]]]):
                edge[open_] += step
                if step > 0:
                    self.place[open_] += 1

    def hashes(self, most: int | None = None) -> np.ndarray:
        """Of each word, or of its first ``most`` bytes."""
        ends = self.ends if most is None else np.minimum(self.ends, self.starts + most)
        return mix((self.total[ends] - self.total[self.starts]) * self.down[self.place] + (ends - self.starts).astype(np.uint64))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and each text's first word: text i has ``hashes[first[i]:first[i + 1]]``."""
    words = Words(texts)
    return words.hashes(), words.first


def shingles(texts: list[bytes], width: int = 5) -> list[np.ndarray]:
    """Each text's set of distinct shingles of ``width`` words, sorted; all words as one where there are fewer; none without words."""
    words, first = word_hashes(texts)
    n = len(words)
    if n >= width:
        rolled = np.zeros(n - width + 1, np.uint64)
        for k in range(width):
            rolled += words[k : n - width + 1 + k] * _ORDER[k]
        rolled = mix(rolled)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= width:
            x = np.sort(rolled[a : b - width + 1])
            out.append(x[np.concatenate([[True], x[1:] != x[:-1]])])
        elif b > a:
            short = (words[a:b] * _ORDER[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
            out.append(mix(np.array([short], np.uint64)))
        else:
            out.append(np.empty(0, np.uint64))
    return out
