"""Word shingles of whole texts, hashed in blocks of documents."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

from . import memory

WORDS = 5
#: Bytes of text that are hashed at once; a longer text is a block of its own.
BLOCK = 1 << 18
ID_BITS = np.uint64(48)
ID_MASK = np.uint64((1 << 48) - 1)
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
BASE = 0xD6E8FEB86659FD93


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, BASE, np.uint64), np.full(n, pow(BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


memory.REMEMBERED["shingles"] = _powers.cache_clear


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * M2
    return h ^ (h >> np.uint64(29))


def blocks(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts whose characters add up to about a block."""
    start, n = 0, 0
    for k, t in enumerate(texts):
        n += len(t)
        if n >= BLOCK or k - start >= 60_000:
            yield start, k + 1
            start, n = k + 1, 0
    if start < len(texts):
        yield start, len(texts)


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc (place in texts), id (48 bits) and count of each distinct shingle, by doc and id.

    Words are what lies between ASCII white space, in lower case. A text of one to four words has one
    shingle, all its words; a text without words has none. At most 65,535 texts.
    """
    data = "\n".join([t.lower() for t in texts]).encode() + b"\n"
    raw = np.frombuffer(data, np.uint8)
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    begins = np.flatnonzero(~blank & np.concatenate(([True], blank[:-1])))
    if not len(begins):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    ends = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
    up, down = _powers(1 << max(20, int(len(raw)).bit_length()))
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * M1 * up[: len(raw)], out=total[1:])
    word = mixed((total[ends] - total[begins]) * down[begins])
    sizes = np.array([len(t.lower().encode()) + 1 for t in texts])
    of = np.searchsorted(np.cumsum(sizes), begins, "right")
    n_words = np.bincount(of, minlength=len(texts))
    first = np.cumsum(n_words) - n_words
    n_own = np.where(n_words >= WORDS, n_words - WORDS + 1, np.minimum(n_words, 1))
    doc = np.repeat(np.arange(len(texts)), n_own)
    at = first[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(n_own) - n_own, n_own)
    padded = np.concatenate((word, np.zeros(WORDS, np.uint64)))
    h = np.zeros(len(doc), np.uint64)
    for k in range(WORDS):
        h = mixed((h + np.where(k < n_words[doc], padded[at + k], np.uint64(0))) * M1 + np.uint64(k))
    packed = np.sort((doc.astype(np.uint64) << ID_BITS) | (h >> np.uint64(16)))
    fresh = np.flatnonzero(np.concatenate(([True], packed[1:] != packed[:-1])))
    count = np.diff(np.append(fresh, len(packed)))
    return (packed[fresh] >> ID_BITS).astype(np.int64), packed[fresh] & ID_MASK, count
