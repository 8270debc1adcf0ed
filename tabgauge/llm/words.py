"""Words, word hashes and shingles of whole texts, computed inside tasks."""

from __future__ import annotations

import numpy as np
import xxhash

SPACES = b" \t\n\x0b\x0c\r"

_BLOCK = 4 << 20
_KNOWN_WORDS = 100_000
_K1 = np.uint64(0x9E3779B97F4A7C15)
_K2 = np.uint64(0xC2B2AE3D27D4EB4F)


class _Hashes(dict):
    """Word to 64-bit hash; remembers a bounded number of words."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < _KNOWN_WORDS:
            self[word] = value
        return value


_hashes = _Hashes()


def small(batches, rows: int = 256):
    """Record batches of few rows, so that what is made of them stays small."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def blocks(data: bytes, separators: bytes = SPACES, size: int = _BLOCK):
    """The data in pieces of about `size` bytes, cut only after a separator."""
    start = 0
    while len(data) - start > size:
        ends = [data.find(separators[i : i + 1], start + size) for i in range(len(separators))]
        end = min((e for e in ends if e >= 0), default=len(data) - 1) + 1
        yield data[start:end]
        start = end
    yield data[start:] if start else data


def word_hashes(data: bytes) -> np.ndarray:
    """One 64-bit hash per word; words are what ASCII white space separates."""
    parts = []
    for block in blocks(data):
        words = block.split()
        parts.append(np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words)))
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def mixed(values: np.ndarray) -> np.ndarray:
    """Every output bit depends on every input bit."""
    values = (values ^ (values >> np.uint64(32))) * _K1
    values = (values ^ (values >> np.uint64(29))) * _K2
    return values ^ (values >> np.uint64(32))


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash for each run of `size` neighbours; none when there are fewer."""
    count = len(hashes) - size + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    found = hashes[:count].copy()
    for step in range(1, size):
        found = mixed(found) + hashes[step : step + count]
    return mixed(found)


def shingles(data: bytes, size: int) -> np.ndarray:
    """Sorted distinct shingles; a shorter text that has words is one shingle."""
    hashes = word_hashes(data)
    if 0 < len(hashes) < size:
        return windows(np.append(hashes, np.uint64(len(hashes))), len(hashes) + 1)
    return np.unique(windows(hashes, size))
