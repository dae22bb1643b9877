"""Words and word shingles of whole texts, for code that runs inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

SHINGLE = 5
_STEP = np.uint64(0x9E3779B97F4A7C15)


def utf8(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column."""
    return column.cast(pa.binary()).to_pylist()


def words(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased: bytes.lower() and
    bytes.split() touch exactly these ASCII characters."""
    return text.lower().split() if text else []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(found: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, found), dtype=np.uint64, count=len(found))


def shingle_hashes(found: list[bytes], size: int = SHINGLE) -> np.ndarray:
    """A 64-bit hash for each run of ``size`` words, in order. A shorter, not
    empty text has one: that of all its words."""
    if not found:
        return np.empty(0, dtype=np.uint64)
    each = word_hashes(found)
    width = min(size, len(found))
    total = each[: len(each) - width + 1].copy()
    for k in range(1, width):
        total = mix(total * _STEP + each[k : len(each) - width + 1 + k])
    return mix(total + np.uint64(width))
