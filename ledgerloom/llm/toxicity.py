"""Operator 1: toxicity by a counterfactual-regularised classifier.

A logistic model over words and word beginnings (log counts) is trained on labelled texts. A
labelled text that names a group of people is paired with the same text naming another group of the
same kind. Of a text that names none, one sentence (chosen by a hash of the document's key) is
given a mention of a group, and is paired with the sentence that names another one and
with the sentence as it was. The loss adds ``penalty`` times the mean squared change of the
logit over the pairs, so that the mere mention of a group moves the score as little as possible.
A term shares its beginning with other words and would else inherit what these have learned.

Features are chosen by the significance of their log odds and scaled by these
(the naive-Bayes form of logistic regression), which learns from few examples. The features of
the identity terms always take part. Terms are a parameter; the table here covers four languages.

Scale: two passes over a bounded sample of labelled rows (``max_train``, about
10,000) choose the features with a distributed count and bring only the chosen
ones to the driver, where the model (at most ``max_features`` weights and those of the terms) is fitted.
Scoring is one map over the whole texts: no shuffle, and a model of fixed size.

Defined results: null and empty texts have no features and get the score of the
intercept alone. Rows with a null label are not learned from. Repeated rows and repeated labels of
one document all count. Very long texts are scored whole, like any other. Without positive or
without negative labels the score is the share of positive labels (0 without any labels); an
empty table gives no rows. Other columns of the inputs are not read, whatever their names. A null
``doc_id`` belongs to no fold: it is never learned from and its ``held_out`` is true.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import bounded_sample, crc_mod, held_out, small_batches, table

WORD = re.compile(r"[^\W\d_]+")
DIMS = 1 << 20
PREFIXES = (4, 5, 6, 7)

# Terms for groups of people, by language; terms of one line can replace each other.
IDENTITY_TERMS = (
    # English
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic", "protestant"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics", "protestants"),
    ("black", "white", "asian", "african", "european", "latino", "indigenous", "arab"),
    ("gay", "straight", "lesbian", "bisexual", "transgender", "heterosexual"),
    ("women", "men"), ("woman", "man"), ("girls", "boys"),
    ("immigrants", "natives", "refugees", "foreigners", "citizens"),
    ("mexican", "chinese", "indian", "german", "french", "spanish", "american", "nigerian", "turkish"),
    ("elderly", "young", "disabled", "deaf", "blind"),
    # German
    ("muslime", "christen", "juden", "hindus", "buddhisten", "atheisten", "katholiken", "protestanten"),
    ("schwarze", "weiße", "asiaten", "afrikaner", "europäer", "araber"),
    ("schwule", "lesben", "bisexuelle", "heterosexuelle"),
    ("frauen", "männer"), ("mädchen", "jungen"),
    ("einwanderer", "einheimische", "flüchtlinge", "ausländer"),
    ("türken", "deutsche", "franzosen", "spanier", "chinesen", "polen", "amerikaner"),
    # French
    ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées", "catholiques", "protestants"),
    ("noirs", "blancs", "asiatiques", "africains", "européens", "arabes"),
    ("gays", "lesbiennes", "bisexuels", "hétérosexuels"),
    ("femmes", "hommes"), ("filles", "garçons"),
    ("immigrés", "autochtones", "réfugiés", "étrangers"),
    ("allemands", "français", "espagnols", "chinois", "mexicains", "américains"),
    # Spanish
    ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos", "católicos", "protestantes"),
    ("negros", "blancos", "asiáticos", "africanos", "europeos", "árabes"),
    ("homosexuales", "lesbianas", "bisexuales", "heterosexuales"),
    ("mujeres", "hombres"), ("niñas", "niños"),
    ("inmigrantes", "nativos", "refugiados", "extranjeros"),
    ("alemanes", "franceses", "españoles", "chinos", "mexicanos", "americanos"),
)


def word_features(word: str) -> tuple[int, ...]:
    """Hashed features of one lower-case word: itself and its beginnings."""
    own = [zlib.crc32(word.encode()) % DIMS]
    own += [zlib.crc32(f"{n}:{word[:n]}".encode()) % DIMS for n in PREFIXES if len(word) > n]
    return tuple(own)


def counts(words: Counter, cache: dict[str, tuple[int, ...]], index: np.ndarray | None) -> Counter:
    """Feature counts of a text's word counts; ``index`` keeps only chosen features
    and numbers them. ``cache`` remembers words and is emptied when it grows."""
    out: Counter = Counter()
    for word, n in words.items():
        own = cache.get(word)
        if own is None:
            own = word_features(word)
            if index is not None:
                own = tuple(int(index[f]) for f in own if index[f] >= 0)
            if len(cache) > 200_000:
                cache.clear()
            cache[word] = own
        for f in own:
            out[f] += n
    return out


def swapped(text: str, groups: tuple[tuple[str, ...], ...]) -> str | None:
    """The text with every identity term replaced by the next one of its line, or None."""
    other = {t: g[(i + 1) % len(g)] for g in groups for i, t in enumerate(g)}
    found = False

    def swap(m: re.Match) -> str:
        nonlocal found
        if (new := other.get(m[0].lower())) is not None:
            found = True
            return new
        return m[0]

    out = WORD.sub(swap, text)
    return out if found else None


SENTENCE_END = re.compile(r"(?<=[.!?])\s+|\n+")


def mentions(text: str, key: str, groups: tuple[tuple[str, ...], ...]) -> tuple[str, str, str] | None:
    """One sentence of a text, and the same with a mention of a group and of another one of its kind after the
    first word; None where no sentence has a word. ``key`` decides on the sentence and the group."""
    sentences = [s for s in SENTENCE_END.split(text) if WORD.search(s)]
    if not sentences or not groups:
        return None
    h = zlib.crc32(key.encode())
    own = sentences[h % len(sentences)]
    line = groups[zlib.crc32(b"line" + key.encode()) % len(groups)]
    one, other = (line[(h // 7 + i) % len(line)] for i in (0, 1))
    at = WORD.search(own).end()  # type: ignore[union-attr]
    return own, f"{own[:at]} {one}{own[at:]}", f"{own[:at]} {other}{own[at:]}"


@dataclass
class ToxicityModel:
    """``index`` maps a hashed feature to its weight's place (-1: not used); ``pairs`` counts the counterfactuals learned from."""

    features: np.ndarray
    weights: np.ndarray
    intercept: float
    pairs: int = 0
    _index: np.ndarray | None = field(default=None, repr=False)
    _cache: dict = field(default_factory=dict, repr=False)

    def logit(self, text: str | None) -> float:
        if self._index is None:
            self._index = np.full(DIMS, -1, np.int32)
            self._index[self.features] = np.arange(len(self.features))
            self._w = self.weights.tolist()
        z = self.intercept
        for f, n in counts(Counter(WORD.findall((text or "").lower())), self._cache, self._index).items():
            z += self._w[f] * (1.0 + math.log(n))
        return z

    def score(self, text: str | None) -> float:
        z = self.logit(text)
        return 1.0 / (1.0 + math.exp(-min(max(z, -60.0), 60.0)))

    def __getstate__(self) -> dict:
        return {"features": self.features, "weights": self.weights, "intercept": self.intercept, "pairs": self.pairs, "_index": None, "_cache": {}}


def fit_logistic(
    rows: np.ndarray, cols: np.ndarray, vals: np.ndarray, labels: np.ndarray, pairs: np.ndarray, n_rows: int, n_cols: int,
    penalty: float, l2: float = 1e-4, steps: int = 200,
) -> tuple[np.ndarray, float]:
    """Full-batch Adagrad on logistic loss + penalty * (change of logit over ``pairs``)^2.

    Rows from ``len(labels)`` on are counterfactuals: they enter only by ``pairs``.
    """
    n = len(labels)
    share = float(np.clip(labels.mean(), 1e-6, 1 - 1e-6))
    w, b = np.zeros(n_cols), float(np.log(share / (1 - share)))
    gw, gb = np.full(n_cols, 1e-12), 1e-12
    for _ in range(steps):
        z = np.bincount(rows, weights=w[cols] * vals, minlength=n_rows) + b
        e = np.zeros(n_rows)
        e[:n] = (1 / (1 + np.exp(-np.clip(z[:n], -60, 60))) - labels) / n
        bias = float(e.sum())
        if len(pairs):
            change = 2 * penalty * (z[pairs[:, 0]] - z[pairs[:, 1]]) / len(pairs)
            np.add.at(e, pairs[:, 0], change)
            np.add.at(e, pairs[:, 1], -change)
        g = np.bincount(cols, weights=e[rows] * vals, minlength=n_cols) + l2 * w
        gw += g * g
        gb += bias * bias
        w -= 0.3 * g / np.sqrt(gw)
        b -= 0.1 * bias / np.sqrt(gb)
    return w, b


def train(
    labelled: DataFrame, *, text_col: str = "text", label_col: str = "label", key_col: str = "doc_id",
    penalty: float = 1.0, max_train: int = 10_000, max_features: int = 1_000, min_docs: int = 3,
    identity_terms: tuple[tuple[str, ...], ...] = IDENTITY_TERMS,
) -> ToxicityModel:
    """Fit on ``labelled`` (text, label 0/1); at most about ``max_train`` rows are used."""
    data = labelled.where(F.col(label_col).isNotNull()).select(
        F.col(key_col).alias("k"), F.col(text_col).alias("t"), F.col(label_col).cast("int").alias("y")
    )

    def feature_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache: dict = {}
        by: tuple[Counter, Counter] = (Counter(), Counter())
        n = [0, 0]
        for pdf in batches:
            for t, y in zip(pdf["t"], pdf["y"], strict=True):
                found: set[int] = set()
                for word in set(WORD.findall((t or "").lower())):
                    own = cache.get(word)
                    if own is None:
                        if len(cache) > 200_000:
                            cache.clear()
                        own = cache[word] = word_features(word)
                    found.update(own)
                by[y > 0].update(found)
                n[y > 0] += 1
        keys = list(by[0].keys() | by[1].keys())
        yield pd.DataFrame({"f": [-1, *keys], "n0": [n[0], *(by[0][k] for k in keys)], "n1": [n[1], *(by[1][k] for k in keys)]})

    stats = data.mapInPandas(feature_counts, "f long, n0 long, n1 long").groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    total = stats.where("f = -1").collect()
    n0, n1 = (int(total[0]["n0"]), int(total[0]["n1"])) if total else (0, 0)
    if n0 == 0 or n1 == 0:
        share = n1 / (n0 + n1) if n0 + n1 else 0.0
        share = min(max(share, 1e-6), 1 - 1e-6)
        return ToxicityModel(np.zeros(0, np.int64), np.zeros(0), float(np.log(share / (1 - share))))
    odds = F.log((F.col("n1") + 0.5) / F.lit(n1 + 1.0)) - F.log((F.col("n0") + 0.5) / F.lit(n0 + 1.0))
    stats = stats.where("f >= 0").withColumn("odds", odds)
    z_score = F.abs("odds") / F.sqrt(1 / (F.col("n1") + 0.5) + 1 / (F.col("n0") + 0.5))
    most = min(max_features, max(200, 3 * min(n0, n1)))  # few examples cannot carry many weights
    chosen = {r["f"]: abs(r["odds"]) for r in stats.where(F.col("n0") + F.col("n1") >= min_docs).orderBy(z_score.desc(), "f").limit(most).collect()}
    # The features of the terms always have weights, else the penalty would have nothing to hold down.
    own = sorted({f for g in identity_terms for t in g for f in word_features(t)})
    known = {r["f"]: abs(r["odds"]) for r in stats.where(F.col("f").isin(own)).collect()} if own else {}
    for f in own:
        chosen.setdefault(f, max(known.get(f, 0.0), 0.1))
    features = np.array(sorted(chosen), np.int64)
    scale = np.array([chosen[f] for f in features])

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = np.full(DIMS, -1, np.int32)
        index[features] = np.arange(len(features))
        cache: dict = {}

        def packed(text: str) -> tuple[bytes, bytes]:
            c = counts(Counter(WORD.findall(text.lower())), cache, index)
            return np.fromiter(c.keys(), np.int32, len(c)).tobytes(), np.fromiter(c.values(), np.int32, len(c)).tobytes()

        for pdf in batches:
            out = []
            for k, t, y in zip(pdf["k"], pdf["t"], pdf["y"], strict=True):
                t = t or ""
                out.append((k, y, 0, *packed(t)))
                if (other := swapped(t, identity_terms)) is not None:
                    out.append((k, y, 1, *packed(other)))
                elif (three := mentions(t, k or "", identity_terms)) is not None:
                    out += [(k, y, 2 + i, *packed(s)) for i, s in enumerate(three)]
            yield pd.DataFrame(out, columns=["k", "y", "part", "f", "n"])

    # Parts: 0 the text, 1 the text with swapped terms, 2 to 4 a sentence, with a mention, with another one.
    got = data.mapInPandas(vectors, "k string, y int, part int, f binary, n binary").toPandas()
    got = got.sort_values(["part", "k", "y", "f"], kind="stable", na_position="first").reset_index(drop=True)
    place = {p: g.index.to_numpy() for p, g in got.groupby("part")}
    none = np.zeros(0, np.int64)
    texts, swaps = place.get(0, none), place.get(1, none)
    named = {k: i for i, k in zip(texts, got["k"][texts], strict=True)}
    pairs = [(named[k], i) for i, k in zip(swaps, got["k"][swaps], strict=True)]
    pairs += [(b, c) for b, c in zip(place.get(3, none), place.get(4, none), strict=True)] + [(a, b) for a, b in zip(place.get(2, none), place.get(3, none), strict=True)]
    lists = list(zip(got["f"], got["n"], strict=True))
    cols = np.concatenate([np.frombuffer(f, np.int32) for f, _ in lists])
    vals = 1.0 + np.log(np.concatenate([np.frombuffer(n, np.int32) for _, n in lists]).astype(float))
    vals *= scale[cols]
    rows = np.repeat(np.arange(len(lists)), [len(f) // 4 for f, _ in lists])
    labels = (got["y"][texts] > 0).to_numpy().astype(float)
    w, b = fit_logistic(rows, cols, vals, labels, np.array(pairs, np.int64).reshape(-1, 2), len(lists), len(features), penalty)
    return ToxicityModel(features, w * scale, b, len(pairs))


def score_column(model: ToxicityModel, text_col: str = "text"):  # noqa: ANN201
    """The score as a column; each Python worker keeps one copy of the model."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([model.score(t) for t in texts], dtype=float)

    return score(F.col(text_col))


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, mod: int, held: int, most: int) -> DataFrame:
    """Texts with a label of documents outside the held-out fold, about ``most`` of them."""
    small_batches(docs.sparkSession)
    ids = labels.where(F.col(label).isNotNull() & (crc_mod("doc_id", mod) != held)).select("doc_id", F.col(label).alias("label"))
    ids = bounded_sample(ids, "doc_id", most, f"train {label}")
    return docs.select(F.col("doc_id"), F.col("text")).join(ids, "doc_id").select(F.col("doc_id").cast("string").alias("doc_id"), "text", "label")


def train_on(docs: DataFrame, labels: DataFrame, max_train: int = 10_000) -> ToxicityModel:
    return train(labelled_texts(docs, labels, "toxic", 4, 2, max_train), max_train=max_train)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity score; learned outside the fold crc32(doc_id) % 4 = 2."""
    docs = table(spark, sf_dir, "documents")
    model = train_on(docs, table(spark, sf_dir, "labels"))
    return docs.select(
        "doc_id", held_out(4, 2), score_column(model).alias("score")
    ).withColumn("predicted", (F.col("score") >= 0.3).cast("int"))
