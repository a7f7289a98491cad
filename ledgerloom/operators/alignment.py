"""Partial alignment of short strings with many texts: the window of a text that is most like a caption.

Likeness is twice the longest common subsequence over both lengths. All windows of all texts of a batch are compared at once: the
programme's rows are bits of 64-bit numbers, one per window, and a step reads one more character of every window. Texts that share too
few characters with the caption (counted in buckets, so never too few) are left out before. Used inside Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD, BUCKETS = 64, 64


def common(a: str, b: str) -> int:
    """Length of the longest common subsequence (bit-parallel; the rows of the programme are bits of one number)."""
    at: dict[str, int] = {}
    for i, ch in enumerate(a):
        at[ch] = at.get(ch, 0) | (1 << i)
    row = full = (1 << len(a)) - 1
    for ch in b:
        hit = row & at.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - bin(row).count("1")


def ratio(a: str, b: str) -> float:
    return 2 * common(a, b) / (len(a) + len(b)) if a or b else 1.0


def best_window(needle: str, text: str) -> tuple[float, int, int]:
    """The window of the text most like the needle: (ratio, start, end); the first of equals. Windows have the
    needle's length, or less at the text's edges."""
    n, best = len(needle), (0.0, 0, 0)
    for start in range(-n + 1, len(text)):
        lo, hi = max(0, start), min(len(text), start + n)
        if (score := ratio(needle, text[lo:hi])) > best[0]:
            best = (score, lo, hi)
    return best


class Texts:
    """A batch of texts as character codes, one after another."""

    def __init__(self, texts: list[str]) -> None:
        self.texts = texts
        self.length = np.array([len(t) for t in texts], np.int64)
        self.codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.first = np.cumsum(self.length) - self.length
        owner = np.repeat(np.arange(len(texts)), self.length)
        self.counts = np.bincount(owner * BUCKETS + self.codes % BUCKETS, minlength=len(texts) * BUCKETS).reshape(len(texts), BUCKETS)

    def shared(self, needle: str) -> np.ndarray:
        """At least as many characters as each text has in common with the needle."""
        own = np.bincount(np.frombuffer(needle.encode("utf-32-le", "surrogatepass"), np.uint32) % BUCKETS, minlength=BUCKETS)
        return np.minimum(self.counts, own).sum(axis=1)

    def bits(self, needle: str, codes: np.ndarray) -> np.ndarray:
        """For each character the places where the needle has it, as bits."""
        at: dict[int, int] = {}
        for i, ch in enumerate(needle):
            at[ord(ch)] = at.get(ord(ch), 0) | (1 << i)
        known = np.array(sorted(at), np.uint32)
        where = np.minimum(np.searchsorted(known, codes), len(known) - 1)
        return np.where(known[where] == codes, np.array([at[int(k)] for k in known], np.uint64)[where], np.uint64(0))

    def ratios(self, needle: str, least: float) -> np.ndarray:
        """The likeness of each whole text where it is ``least`` or more; 0 or a smaller likeness elsewhere."""
        out, n = np.zeros(len(self.texts)), len(needle)
        upper = 2 * np.minimum(self.shared(needle), self.length) / np.maximum(n + self.length, 1)
        pick = np.flatnonzero((upper >= least) & (self.length > 0))
        if not n or not len(pick):
            return out
        if n > WORD:
            out[pick] = [ratio(needle, self.texts[i]) for i in pick]
            return out
        size = self.length[pick]
        places = self.first[pick][:, None] + np.arange(size.max())
        inside = np.arange(size.max()) < size[:, None]
        bits = np.where(inside, self.bits(needle, self.codes[np.minimum(places, len(self.codes) - 1)]), np.uint64(0))
        left = lcs_rows((bits[:, j] for j in range(bits.shape[1])), n, len(pick))
        out[pick] = 2 * (n - left) / (n + size)
        return out

    def partial(self, needle: str, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``best_window`` of each text longer than the needle where it is ``least`` or more; zeros or a smaller one elsewhere."""
        n, score = len(needle), np.zeros(len(self.texts))
        lo, hi = np.zeros(len(self.texts), np.int64), np.zeros(len(self.texts), np.int64)
        most = self.shared(needle)
        pick = np.flatnonzero((2 * most / np.maximum(n + most, 1) >= least) & (self.length > n))
        if not n or not len(pick):
            return score, lo, hi
        if n > WORD:
            for i in pick:
                score[i], lo[i], hi[i] = best_window(needle, self.texts[i])
            return score, lo, hi
        # The texts with n - 1 empty places between them, so that no window holds characters of two.
        size = self.length[pick]
        begin = np.cumsum(size + n - 1) - size
        flat = np.zeros(int(size.sum()) + (len(pick) + 1) * (n - 1), np.uint64)
        inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        flat[inner + np.repeat(begin, size)] = self.bits(needle, self.codes[inner + np.repeat(self.first[pick], size)])
        windows = len(flat) - n + 1
        left = lcs_rows((flat[j : j + windows] for j in range(n)), n, windows)
        per_text = size + n - 1
        from_ = np.cumsum(per_text) - per_text
        start = np.arange(windows) - np.repeat(from_, per_text) - (n - 1)
        lows, highs = np.maximum(start, 0), np.minimum(start + n, np.repeat(size, per_text))
        likeness = 2 * (n - left) / (n + highs - lows)
        best = np.maximum.reduceat(likeness, from_)
        place = np.where(likeness == np.repeat(best, per_text), np.arange(windows), windows)
        at = np.minimum.reduceat(place, from_)
        score[pick], lo[pick], hi[pick] = best, np.where(best > 0, lows[at], 0), np.where(best > 0, highs[at], 0)
        return score, lo, hi


def lcs_rows(steps: Iterator[np.ndarray], n: int, many: int) -> np.ndarray:
    """How many of the needle's n characters are not in the common subsequence, for ``many`` strings read in steps."""
    full = np.uint64((1 << n) - 1)
    row = np.full(many, full)
    for bits in steps:
        hit = row & bits
        row = (row + hit) | (row - hit)
    return np.bitwise_count(row & full).astype(np.int64)


def partial_ratio(a: str, b: str) -> float:
    """The likeness of the shorter string to the best window of the longer one, whichever is which."""
    if not a or not b:
        return float(a == b)
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    return max(best_window(short, long)[0], best_window(long, short)[0] if len(a) == len(b) else 0.0)


def like_any(texts: list[str], labels: list[str], whole: float, part: float | None = None, least_chars: int = 0) -> np.ndarray:
    """Whether a text is like any label: as a whole, or (``part``) its shorter side like a window of the other."""
    out, batch = np.zeros(len(texts), bool), Texts(texts)
    enough = batch.length >= max(1, least_chars)
    for label in (x for x in labels if len(x) >= max(1, least_chars)):
        out |= batch.ratios(label, whole) >= whole
        if part is not None:
            out |= batch.partial(label, part)[0] >= part
    if part is not None:  # texts that are not longer than a label are looked for in the labels
        own = Texts([x for x in labels if len(x) >= max(1, least_chars)])
        for i in np.flatnonzero(enough & ~out & (batch.length <= max(own.length, default=0))):
            text = texts[i]
            same = [x for x in own.texts if len(x) == len(text)]
            out[i] = bool((own.partial(text, part)[0] >= part).any()) or any(partial_ratio(text, x) >= part for x in same)
    return out & enough


def is_label_like(clean: Column, labels: list[str], least: float = 0.88) -> Column:
    """Whether a cleaned text is a label itself, up to slips."""

    @F.pandas_udf("boolean")
    def one(texts: pd.Series) -> pd.Series:
        codes, own = pd.factorize(texts.fillna(""))
        return pd.Series(like_any(list(own), labels, least)[codes])

    return one(clean)


def are_like_labels(clean: Column, labels: list[str], whole: float = 0.88, part: float = 0.90, least_chars: int = 8) -> Column:
    """For an array of cleaned texts, which of them are labels or pieces of labels."""

    @F.pandas_udf("array<boolean>")
    def one(rows: pd.Series) -> pd.Series:
        own = sorted({t for r in rows if r is not None for t in r if t})
        told = dict(zip(own, like_any(own, labels, whole, part, least_chars).tolist(), strict=True))
        return rows.map(lambda r: None if r is None else [told.get(t, False) for t in r])

    return one(clean)
