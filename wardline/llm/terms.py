"""Terms of many texts at once: runs of ASCII letters and digits and of all characters beyond ASCII, A-Z taken as a-z."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np

from .textbytes import mix

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
#: Of lower-cased bytes: those of terms. All bytes of a character beyond ASCII are over 0x7F.
_INSIDE = np.zeros(256, bool)
_INSIDE[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: Terms of more bytes than that are folded one by one.
LONG = 64


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


_CRC = _crc_table()


class Spans:
    """Span k is ``data[starts[k]:ends[k]]``."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        self.data, self.starts, self.ends = data, starts, ends

    def _fold(self, begin: int, dtype: type, step: Callable[[np.ndarray, np.ndarray], np.ndarray], end: Callable[[np.ndarray], np.ndarray], alone: Callable[[bytes], int]) -> np.ndarray:
        """Byte by byte over all spans at once, the longest first, so that those still open stand together."""
        n = self.ends - self.starts
        order = np.argsort(-n, kind="stable")
        size, at = n[order], self.starts[order]
        value = np.full(len(n), begin, dtype)
        upto = np.searchsorted(-size, -np.arange(LONG), side="left")  # spans of more than p bytes
        for p in range(min(LONG, int(size[0]) if len(size) else 0)):
            k = int(upto[p])
            value[:k] = step(value[:k], self.data[at[:k] + p])
        value = end(value)
        for i in range(int(np.searchsorted(-size, -LONG, side="left"))):
            value[i] = alone(self.data[at[i] : at[i] + size[i]].tobytes())
        out = np.empty_like(value)
        out[order] = value
        return out

    def crc32(self) -> np.ndarray:
        """Unsigned CRC-32 of each span's bytes."""
        return self._fold(0xFFFFFFFF, np.uint32, lambda v, b: _CRC[(v ^ b) & np.uint32(255)] ^ (v >> np.uint32(8)), lambda v: v ^ np.uint32(0xFFFFFFFF), zlib.crc32)

    def hashes(self) -> np.ndarray:
        """64-bit hash of each span's bytes."""
        own = lambda b: int.from_bytes(hashlib.blake2b(b, digest_size=8).digest(), "little")
        return self._fold(0xCBF29CE484222325, np.uint64, lambda v, b: (v ^ b) * np.uint64(0x100000001B3), mix, own)


class Terms(Spans):
    """Terms as spans of the lower-cased bytes; text i has terms ``first[i]`` to ``first[i + 1] - 1``."""

    def __init__(self, texts: list[bytes]):
        data = _LOWER[np.frombuffer(b"\n" + b"\n".join(texts) + b"\n", np.uint8)]
        inside = _INSIDE[data]
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        super().__init__(data, edges[::2], edges[1::2])
        lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.first = np.searchsorted(self.starts, np.concatenate([[1], 1 + np.cumsum(lengths)]))

    def of_text(self) -> np.ndarray:
        """Number of the text that each term is in."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def runs(self, width: int) -> Iterator[tuple[Spans, np.ndarray]]:
        """For each of 1 to ``width``: all runs of so many neighbouring terms of a text, joined by one space, and the text that each is in."""
        text = self.of_text()
        yield self, text
        if width > 1:
            size = self.ends - self.starts + 1  # with the space after it
            ends = np.cumsum(size)
            starts = ends - size
            data = self.data[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.starts - starts, size)]
            data[ends - 1] = ord(" ")
            for w in range(2, width + 1):
                same = np.flatnonzero(text[w - 1 :] == text[: len(text) - w + 1])
                yield Spans(data, starts[same], ends[same + w - 1] - 1), text[same]
