"""Word shingles of whole texts as 64-bit hashes, computed with numpy inside tasks.

Words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased. A text with fewer than
n words has its whole word sequence as its one shingle; a text without words has none.
"""

from __future__ import annotations

import numpy as np

CHUNK = 1 << 20
WORD = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15 | 1
_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def mix_one(x: int) -> int:
    """``mix`` of one number, as a signed one."""
    x &= WORD
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & WORD
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & WORD
    x ^= x >> 31
    return x - (1 << 64) if x >> 63 else x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and its inverse modulo 2^64, for i < n at least."""
    global _powers, _inverse
    if len(_powers) < n:
        n = max(n, CHUNK + 1)
        for name, base in (("_powers", BASE), ("_inverse", pow(BASE, -1, 1 << 64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            globals()[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers, _inverse


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, and where each text's words begin (one entry more than texts)."""
    joined = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    low = joined | (((joined >= 65) & (joined <= 90)).astype(np.uint8) << 5)
    word = ~((low == 32) | ((low >= 9) & (low <= 13)))
    edge = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]]).view(np.int8)))
    start, stop = edge[::2], edge[1::2]
    pw, inv = powers(len(low) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((low.astype(np.uint64) + np.uint64(1)) * pw[: len(low)], dtype=np.uint64)])
    hashes = mix((total[stop] - total[start]) * inv[start] + (stop - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return hashes, np.concatenate([[0], np.searchsorted(start, ends)])


def distinct(hashes: np.ndarray) -> np.ndarray:
    """The sorted distinct values of a non-empty array."""
    own = np.sort(hashes)
    keep = np.empty(len(own), bool)
    keep[0] = True
    np.not_equal(own[1:], own[:-1], out=keep[1:])
    return own[keep]


def shingle_sets(texts: list[str | None], n: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its n-word shingles."""
    return shingle_sets_and_words(texts, n)[0]


def shingle_sets_and_words(texts: list[str | None], n: int) -> tuple[list[np.ndarray], list[int]]:
    """The sets of ``shingle_sets`` and how many words each text has."""
    out: list[np.ndarray] = []
    counts: list[int] = []
    raw = [(t or "").encode("utf-8", "replace") for t in texts]
    i = 0
    with np.errstate(over="ignore"):
        while i < len(raw):
            j, size = i, 0
            while j < len(raw) and (j == i or size + len(raw[j]) < CHUNK):
                size += len(raw[j]) + 1
                j += 1
            hashes, first = word_hashes(raw[i:j])
            every = np.zeros(max(0, len(hashes) - n + 1), np.uint64)
            for k in range(n):
                every = every * np.uint64(0x2545F4914F6CDD1D) + hashes[k : k + len(every)]
            every = mix(every)
            counts += np.diff(first).tolist()
            for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                if b - a >= n:
                    out.append(distinct(every[a : b - n + 1]))
                elif b > a:
                    whole = np.uint64(b - a)
                    for h in hashes[a:b]:
                        whole = whole * np.uint64(0x9FB21C651E98DF25) + h
                    out.append(mix(np.array([whole], np.uint64)))
                else:
                    out.append(np.zeros(0, np.uint64))
            i = j
    return out, counts


def set_digest(hashes: np.ndarray) -> tuple[int, int]:
    """Two signed 64-bit digests of a set of hashes, the sum of their scramblings and of the squares: 128 bits name a set."""
    own = mix(hashes ^ np.uint64(0xA0761D6478BD642F))
    one, two = mix_one(int(own.sum()) + len(hashes)), mix_one(int(np.dot(own, own)) + len(hashes))
    return one, two
