"""Words, windows and hashes of whole batches of texts as numpy arrays.

Arrow hands a task its texts as one byte buffer with offsets; the functions here work on slices of
such a buffer, so that cost is a few array operations and no Python step per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20

_SPLIT = np.uint64(0x9E3779B97F4A7C15)
_MIX_A = np.uint64(0xBF58476D1CE4E5B9)
_MIX_B = np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """The finishing steps of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX_A
    x = x ^ (x >> np.uint64(27))
    x = x * _MIX_B
    return x ^ (x >> np.uint64(31))


def byte_values(seed: int) -> np.ndarray:
    """A random 64-bit number for each byte, the same in every task."""
    with np.errstate(over="ignore"):
        return mixed((np.arange(256, dtype=np.uint64) + np.uint64(seed * 256 + 1)) * _SPLIT)


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False

_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, CHUNK_BYTES + 1)
        base = 0x5851F42D4C957F2D
        inverse = pow(base, -1, 1 << 64)
        for name, x in (("up", base), ("down", inverse)):
            p = np.full(size, x, dtype=np.uint64)
            p[0] = 1
            _POWERS[name] = np.cumprod(p)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def chunks(column: pa.Array | pa.ChunkedArray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of whole texts of about ``size`` bytes; null is an empty text."""
    first = 0
    for part in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        if part.null_count:
            part = part.fill_null("")
        part = part.cast(pa.large_binary()) if not pa.types.is_large_binary(part.type) else part
        _, offsets, data = part.buffers()
        offs = np.frombuffer(offsets, dtype=np.int64)[part.offset : part.offset + len(part) + 1]
        raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
        row = 0
        while row < len(part):
            end = max(row + 1, int(np.searchsorted(offs, offs[row] + size, side="right")) - 1)
            yield first + row, raw[offs[row] : offs[end]], offs[row : end + 1] - offs[row]
            row = end
        first += len(part)


def word_spans(raw: np.ndarray, offs: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each run of bytes for which ``inside`` holds."""
    m = inside[raw]
    if not len(m):
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty, empty
    begins = m.copy()
    begins[1:] &= ~m[:-1]
    ends = m.copy()
    ends[:-1] &= ~m[1:]
    heads = offs[:-1][(offs[:-1] < offs[1:])]
    begins[heads] = m[heads]
    ends[heads[1:] - 1] = m[heads[1:] - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(offs, starts, side="right") - 1


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, from one running sum over all bytes."""
    up, down = _powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(values[raw] * up[: len(raw)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _SPLIT)


def gram_hashes(words: np.ndarray, texts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``k`` consecutive words of one text, and the number of their first word."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    h = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        h = h * _SPLIT + mixed(words[j : j + n] + np.uint64(j + 1))
    at = np.flatnonzero(texts[:n] == texts[k - 1 :])
    return mixed(h[at] + np.uint64(k)), at
