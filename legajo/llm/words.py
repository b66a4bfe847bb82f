"""Words ``[^\\x20\\x09-\\x0D]+`` of UTF-8 texts and hashes of word runs, in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from legajo.llm.common import CHUNK_BYTES, text_buffers

WORD_SQL = r"[^\x20\x09-\x0D]+"
_P = 0x9E3779B97F4A7C15 | 1
_Q = 0xC2B2AE3D27D4EB4F | 1
_TABLE = np.random.default_rng(20240229).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SPACES = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_POWERS: dict[int, np.ndarray] = {}


#: Powers that a worker remembers; what longer texts need goes with them.
_MOST_POWERS = CHUNK_BYTES + 1024


def _powers(base: int, n: int) -> np.ndarray:
    if base in _POWERS and len(_POWERS[base]) >= n:
        return _POWERS[base][:n]
    grown = np.full(max(n, 1 << 16), base, np.uint64)
    grown[0] = 1
    np.multiply.accumulate(grown, out=grown)
    if len(grown) <= _MOST_POWERS:
        _POWERS[base] = grown
    return grown[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of 64-bit hashes."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _rolling(values: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    n = len(values)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values * _powers(base, n), out=sums[1:])
    return sums, _powers(pow(base, -1, 1 << 64), n + 1)


class Words:
    """Word starts and ends (byte offsets), per-row word offsets ``rows`` and 64-bit word hashes."""

    def __init__(self, column: pa.Array, lower: bool, breaks: np.ndarray = SPACES):
        """breaks: of each byte, whether it ends a word."""
        data, offsets = text_buffers(column)
        if lower and len(data):
            data = data + np.where((data >= 65) & (data <= 90), np.uint8(32), np.uint8(0))
        self.data = data
        n = len(data)
        solid = np.zeros(n + 2, bool)
        solid[1:-1] = ~breaks[data]
        first = np.zeros(n + 1, bool)
        first[offsets] = True
        starts = solid[1:-1] & (~solid[:-2] | first[:-1])
        ends = solid[1:-1] & (~solid[2:] | first[1:])
        self.starts, self.ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        self.rows = np.searchsorted(self.starts, offsets)
        sums, inverse = _rolling(_TABLE[data], _P)
        self.hashes = mix((sums[self.ends] - sums[self.starts]) * inverse[self.starts] + (self.ends - self.starts).astype(np.uint64))

    def grams(self, k: int) -> np.ndarray:
        """Hash of the k words from each word on; runs that leave their row have no meaning."""
        sums, inverse = self.sums()
        n = len(self.hashes)
        if n < k:
            return np.zeros(0, np.uint64)
        return mix((sums[k:] - sums[: n - k + 1]) * inverse[: n - k + 1] + np.uint64(k))

    def sums(self) -> tuple[np.ndarray, np.ndarray]:
        if not hasattr(self, "_sums"):
            self._sums = _rolling(self.hashes, _Q)
        return self._sums

    def span(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the words [start, end), equal for equal word sequences."""
        sums, inverse = self.sums()
        return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))


def shingle_sets(words: Words, k: int) -> list[np.ndarray]:
    """Of each row the sorted distinct hashes of its k-word shingles; the whole sequence if it is shorter."""
    grams, out = words.grams(k), []
    for a, b in zip(words.rows[:-1].tolist(), words.rows[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(grams[a : b - k + 1]))
        elif b > a:
            out.append(words.span(np.array([a]), np.array([b])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
