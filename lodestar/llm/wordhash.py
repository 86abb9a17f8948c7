"""64-bit hashes of all words of a byte string at once."""

from __future__ import annotations

import numpy as np

from lodestar.llm.memory import remembered

BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
#: bytes whose powers are kept; longer inputs are hashed with powers made for them
KEPT = 1 << 21


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


@remembered(1)
def _kept() -> tuple[np.ndarray, np.ndarray]:
    return _powers(BASE, KEPT), _powers(pow(BASE, -1, 1 << 64), KEPT)


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every bit over all others."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def spans(buffer: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes b with inside[b]."""
    on = np.zeros(len(buffer) + 2, np.int8)
    on[1:-1] = inside[buffer]
    edge = np.diff(on)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def span_hashes(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A polynomial over each span's bytes; the same bytes give the same hash wherever they stand."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    n = len(buffer)
    powers, inverse = _kept() if n <= KEPT else (_powers(BASE, n), _powers(pow(BASE, -1, 1 << 64), n))
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum((buffer.astype(np.uint64) + np.uint64(1)) * powers[:n], out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * inverse[starts])
