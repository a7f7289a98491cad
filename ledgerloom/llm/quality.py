"""Operator 5: quality by Bradley-Terry pairwise ranking.

Preference pairs (a document labelled good over one labelled bad) give a linear
score by logistic loss on feature differences. The accepted share is set by a
quantile of the training scores: the score at the quantile of the bad share
becomes exactly ``accept_at`` (0.3) on the 0-to-1 scale, with a slope fitted on the
same rows. Features are surface statistics of the whole text, each cut at
quantiles of the training sample into steps, so that one extreme value weighs no
more than its step.

Scale: features of at most about ``max_train`` labelled rows (some 25 numbers each)
come to the driver; scoring is one map without shuffle.

Defined results: null and empty texts have the features of an empty text and are
scored like any other. Null labels are not learned from. Without both labels in
the training rows every score is the share of good labels (0 without labels).
Extra columns are not read, whatever their names; repeated rows are scored alike and count as often as they
occur. Very long texts are scored whole. A null ``doc_id`` belongs to no fold: it is never learned from and its
``held_out`` is true. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import held_out, table
from ledgerloom.llm.toxicity import labelled_texts

SYMBOLS = np.frombuffer(b"#$%&*+<=>@[]^_`{|}~\\/", np.uint8)
FEATURES = (
    "log_words", "log_chars", "letters", "digits", "upper", "symbols", "bangs", "pipes", "stops", "commas",
    "distinct_words", "top_word", "repeats", "lines", "distinct_lines", "line_length", "word_length", "short_words", "capital_words", "long_words",
    "distinct_pairs", "non_ascii", "closing_stop", "symbol_words",
)


def features(text: str | None) -> list[float]:
    """Surface statistics of a whole text, in the order of FEATURES."""
    raw = (text or "").encode("utf-8", "replace")
    by = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = (text or "").split()
    n, m = max(len(raw), 1), max(len(words), 1)
    upper = int(by[65:91].sum())
    letters = upper + int(by[97:123].sum()) + int(by[192:].sum())
    counts = Counter(words)
    lines = [x for x in (text or "").split("\n") if x.strip()]
    k = max(len(lines), 1)
    lengths = [len(w) for w in words]
    return [
        math.log1p(len(words)), math.log1p(len(raw)), letters / n, by[48:58].sum() / n, upper / max(letters, 1), by[SYMBOLS].sum() / n, by[33] / m, by[124] / m, by[46] / m, by[44] / m,
        len(counts) / m, max(counts.values(), default=0) / m, sum(a == b for a, b in zip(words, words[1:], strict=False)) / m, math.log1p(len(lines)), len(set(lines)) / k, math.log1p(len(words) / k), sum(lengths) / m, sum(x <= 3 for x in lengths) / m, sum(w[0].isupper() for w in words) / m, sum(x > 20 for x in lengths) / m,
        len(set(zip(words, words[1:], strict=False))) / m, by[128:].sum() / n, float((text or "").rstrip()[-1:] in ".!?"), sum(not w[-1].isalnum() and w[-1] not in ".,!?;:" for w in words) / m,
    ]


def steps(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """One-hot steps of every feature, side by side."""
    out = []
    for i, c in enumerate(cuts):
        one = np.zeros((len(x), len(c) + 1), np.float32)
        one[np.arange(len(x)), np.searchsorted(c, x[:, i], side="right")] = 1
        out.append(one)
    return np.concatenate(out, axis=1)


@dataclass
class QualityModel:
    cuts: list[np.ndarray]
    weights: np.ndarray
    threshold: float
    slope: float
    accept_at: float

    def scores(self, texts: pd.Series) -> np.ndarray:
        if not len(texts):
            return np.zeros(0)
        raw = np.zeros(len(texts))
        if len(self.weights):
            raw = steps(np.array([features(t) for t in texts]), self.cuts) @ self.weights
        base = math.log(self.accept_at / (1 - self.accept_at))
        return 1 / (1 + np.exp(-np.clip(self.slope * (raw - self.threshold) + base, -60, 60)))


def fit_pairs(x: np.ndarray, good: np.ndarray, bad: np.ndarray, n_pairs: int = 40_000, rounds: int = 150, l2: float = 1e-4) -> np.ndarray:
    """Bradley-Terry weights: logistic loss of w . (x_good - x_bad) over ``n_pairs`` pairs.

    Pairs run through both sides at coprime paces, so every row is in some pair."""
    i = np.arange(max(n_pairs, len(good), len(bad)))
    a, b = good[i % len(good)], bad[(i * 7919 + i // len(good)) % len(bad)]
    diff = x[a] - x[b]
    w, g2 = np.zeros(x.shape[1]), np.full(x.shape[1], 1e-10)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(np.clip(diff @ w, -60, 60)))
        g = -(p @ diff) / len(diff) + l2 * w
        g2 += g * g
        w -= 0.5 * g / np.sqrt(g2)
    return w


def fit_slope(margin: np.ndarray, y: np.ndarray, base: float) -> float:
    """Slope a of sigmoid(a * margin + base), by bisection on the gradient of the logistic loss."""
    lo, hi = 0.05, 20.0
    for _ in range(50):
        a = (lo + hi) / 2
        p = 1 / (1 + np.exp(-np.clip(a * margin + base, -60, 60)))
        lo, hi = (a, hi) if float(((y - p) * margin).sum()) > 0 else (lo, a)
    return (lo + hi) / 2


def train(labelled: DataFrame, *, accept_at: float = 0.3, n_steps: int = 12) -> QualityModel:
    """Fit on rows of (doc_id, text, label 0/1); the caller bounds their number."""

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"k": pdf["k"], "y": pdf["y"], "x": [features(t) for t in pdf["t"]]})

    data = labelled.where("label is not null").select(F.col("doc_id").alias("k"), F.col("text").alias("t"), F.col("label").cast("int").alias("y"))
    got = data.mapInPandas(vectors, "k string, y int, x array<double>").orderBy("k", "y").toPandas()
    y = (got["y"].to_numpy() > 0).astype(float) if len(got) else np.zeros(0)
    if not len(y) or y.min() == y.max():
        share = min(max(float(y.mean()) if len(y) else 0.0, 1e-6), 1 - 1e-6)
        return QualityModel([], np.zeros(0), 0.0, 1.0, share)
    x = np.array(got["x"].tolist())
    cuts = [np.unique(np.quantile(x[:, i], np.linspace(0, 1, n_steps + 1)[1:-1])) for i in range(x.shape[1])]
    z = steps(x, cuts)
    w = fit_pairs(z, np.flatnonzero(y > 0), np.flatnonzero(y == 0))
    raw = z @ w
    threshold = float(np.quantile(raw, 1 - y.mean()))
    base = math.log(accept_at / (1 - accept_at))
    return QualityModel(cuts, w, threshold, fit_slope(raw - threshold, y, base), accept_at)


def score_column(model: QualityModel, text_col: str = "text"):  # noqa: ANN201
    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(model.scores(texts))

    return score(F.col(text_col))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score; learned outside the fold crc32(doc_id) % 5 = 0."""
    docs = table(spark, sf_dir, "documents")
    model = train(labelled_texts(docs, table(spark, sf_dir, "labels"), "quality", 5, 0, 10_000))
    return docs.select(
        "doc_id", held_out(5, 0), score_column(model).alias("score")
    ).withColumn("predicted", (F.col("score") >= 0.3).cast("int"))
