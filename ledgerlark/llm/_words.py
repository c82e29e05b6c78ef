"""Words and shingles of texts as 64-bit hashes, in tasks."""

from __future__ import annotations

import numpy as np
import xxhash

_FACTORS = [np.uint64(pow(0x9E3779B97F4A7C15, i, 1 << 64) | 1) for i in range(1, 65)]
_hash = xxhash.xxh64_intdigest


def mixed(h: np.ndarray) -> np.ndarray:
    """The finishing steps of a 64-bit hash; one to one."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_hash, words), np.uint64, len(words))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of k words; none if there are fewer."""
    m = max(0, len(h) - k + 1)
    out = np.zeros(m, np.uint64)
    for j in range(k):
        out += h[j : j + m] * _FACTORS[j]
    return mixed(out)


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """The distinct k-word shingles of a text, sorted; of fewer words, the whole sequence as one.

    A-Z are lowered; words are runs of anything but space and the characters 09 to 0D.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return np.unique(grams(hashes(words), min(k, len(words)))) if words else np.empty(0, np.uint64)
