"""Content-defined anchors: places that any two equal strings of a given length have in common."""

from __future__ import annotations

import numpy as np

from .textbytes import mix

_BYTE = np.random.default_rng(20240301).integers(1, 1 << 63, 256, dtype=np.uint64)


def gram_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """64-bit hashes of all strings of ``width`` bytes (a power of two) of ``data``."""
    h, k = _BYTE[data], 1
    while k < width:
        h = (h[:-k] ^ (h[:-k] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + h[k:] * np.uint64(0x94D049BB133111EB)
        k *= 2
    return mix(h)


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least value of each ``width`` neighbours."""
    k = 1
    while 2 * k <= width:
        x = np.minimum(x[:-k], x[k:])
        k *= 2
    rest = width - k
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def anchors(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the grams that have the least hash of some window of ``length`` bytes.

    Two equal windows choose the grams at the same places in them; where a window holds its least
    hash more than once, all of them are chosen.
    """
    if len(data) < length:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    h = gram_hashes(data, gram)
    span = length - gram + 1
    least = sliding_least(h, span)
    # A gram is chosen if its hash is the least of a window that holds it: of windows starting up to span - 1 before.
    greatest = np.uint64(0xFFFFFFFFFFFFFFFF)
    padded = np.concatenate([np.zeros(span - 1, np.uint64), least, np.zeros(span - 1, np.uint64)])
    most = greatest - sliding_least(greatest - padded, span)
    at = np.flatnonzero(h == most[: len(h)])
    return at, h[at]
