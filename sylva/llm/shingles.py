"""Sets of word shingles as 64-bit hashes, computed in Python workers from UTF-8 bytes."""

from __future__ import annotations

import numpy as np
import xxhash

from sylva.llm._bytes import segments

SHINGLE = 5
_REMEMBERED = 100_000
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


class _Words(dict):
    """Word -> 64-bit hash."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _REMEMBERED:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_words = _Words()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes) -> np.ndarray:
    """The sorted distinct hashes (int64) of the 5-word shingles of a text, A-Z lower-cased.

    Fewer words make one shingle of the whole sequence; no words make none.
    """
    parts = [np.fromiter(map(_words.__getitem__, s.lower().split()), dtype=np.uint64) for s in segments(text)]
    w = parts[0] if len(parts) == 1 else np.concatenate(parts)
    if not len(w):
        return np.empty(0, np.int64)
    with np.errstate(over="ignore"):
        if len(w) < SHINGLE:
            h = np.array([len(w)], np.uint64) + (w * _FACTORS[: len(w)]).sum(dtype=np.uint64)
        else:
            n = len(w) - SHINGLE + 1
            h = w[:n] * _FACTORS[0]
            for j in range(1, SHINGLE):
                h = h + w[j : j + n] * _FACTORS[j]
        return np.unique(_mixed(h).view(np.int64))


def set_keys(hashes: np.ndarray) -> tuple[int, int]:
    """Two signed 64-bit keys of a set."""
    digest = xxhash.xxh3_128_digest(hashes.tobytes())
    return int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True)
