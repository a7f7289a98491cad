"""Operator 9: language by word-first backoff.

A known word is scored by its log frequency in each language; an unseen word by
its character n-grams, at every place by the longest known one of at most four
characters and by shorter ones where that is unseen too. The words' evidence is
averaged and turned into a probability per language.

Scale: frequencies are counted with a distributed aggregation over a bounded sample of labelled
documents, at most about ``per_lang`` of every language, so a rare language is learned beside a hot one.
The model keeps the ``max_words`` words and ``max_grams`` n-grams that are most frequent in each language, so
what goes to the executors grows with the number of languages, not with the input. Prediction is one map over
whole texts, however long, without shuffle.

Defined results: null text and text without a letter give ``und`` and score 0; so does any text if no document
carries a language. Equal scores go to the first language by name. Rows with a null language are predicted but
not learned from; so are rows with a null id, which are held out. Repeated rows are predicted alike and learned
from as often as they occur. An empty table gives no rows. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import bounded_sample, crc_mod, held_out, materialise, small_batches, table

WORD = re.compile(r"[^\W\d_]+")
LONGEST = 4  # backoff() spells these lengths out


def letters_in(word: str) -> bool:
    return word.isalpha() or any(c.isalpha() for c in word)


def grams(word: str) -> list[str]:
    """All n-grams of the padded word, n = 1 to LONGEST (a pad alone is none)."""
    w = f"\x02{word}\x03"
    return [w[i : i + n] for n in range(1, LONGEST + 1) for i in range(len(w) - n + 1) if n > 1 or 0 < i < len(w) - 1]


ROOM = 100_000  # unseen words remembered at a time


@dataclass
class LanguageModel:
    """Centred log frequencies, one column per language in ``langs``; unknown characters say nothing."""

    langs: list[str]
    words: dict[str, int]
    word_logs: np.ndarray
    grams: dict[str, int]
    gram_logs: np.ndarray  # one row more than grams: the last is for unknown characters
    _rows: dict = field(default_factory=dict, repr=False)
    _logs: np.ndarray | None = field(default=None, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_rows": {}, "_logs": None}

    def backoff(self, words: list[str]) -> np.ndarray:
        """Evidence of unseen words: at every place the longest known n-gram, on average."""
        found, at, none = self.grams, [], len(self.grams)
        lengths = [len(w) + 2 for w in words]
        for word in words:
            w = f"\x02{word}\x03"
            for i in range(len(w)):
                own = found.get(w[i : i + 4])
                if own is None:
                    own = found.get(w[i : i + 3])
                    if own is None:
                        own = found.get(w[i : i + 2])
                        if own is None:
                            own = found.get(w[i], none)
                at.append(own)
        sums = np.add.reduceat(self.gram_logs[at], np.concatenate([[0], np.cumsum(lengths)[:-1]]), axis=0)
        return sums / np.array(lengths)[:, None] * 2

    def predict(self, text: str | None) -> tuple[str, float]:
        if self._logs is None or len(self._rows) > len(self.words) + ROOM:
            self._rows = dict(self.words)
            self._logs = np.concatenate([self.word_logs, np.zeros((2 * ROOM, len(self.langs)))])
        rows, counts, new = [], [], []
        for w, n in Counter(WORD.findall(text.lower())).items() if text else ():
            at = self._rows.get(w)
            if at is None:
                if not letters_in(w):
                    continue
                at = self._rows[w] = len(self._rows)
                new.append(w)
            rows.append(at)
            counts.append(n)
        if not rows or not self.langs:
            return "und", 0.0
        if new:
            until = len(self._rows)
            if until > len(self._logs):  # only a text with very many new words comes here
                self._logs = np.concatenate([self._logs, np.zeros((until, len(self.langs)))])
            self._logs[until - len(new) : until] = self.backoff(new)
        n = np.array(counts, float)
        z = n @ self._logs[rows] / n.sum() * min(n.sum(), 25)
        p = np.exp(z - z.max())
        p /= p.sum()
        best = int(p.argmax())
        return self.langs[best], float(p[best])


def train(labelled: DataFrame, *, text_col: str = "text", lang_col: str = "lang", max_words: int = 10_000, max_grams: int = 10_000) -> LanguageModel:
    """Fit on rows of text and language; the caller bounds their number."""
    small_batches(labelled.sparkSession)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by: dict[str, Counter] = {}

        def flush() -> pd.DataFrame:
            rows = []
            for lang, own in by.items():
                rows += [("w", lang, w, n) for w, n in own.items()]
                g: Counter = Counter()
                for w, n in own.items():
                    for x in grams(w):
                        g[x] += n
                rows += [("g", lang, x, n) for x, n in g.items()]
            by.clear()
            return pd.DataFrame(rows, columns=["kind", "lang", "gram", "n"])

        for pdf in batches:
            for t, lang in zip(pdf["t"], pdf["lang"], strict=True):
                by.setdefault(lang, Counter()).update(w for w in WORD.findall((t or "").lower()) if letters_in(w))
            if sum(map(len, by.values())) > 200_000:
                yield flush()
        yield flush()

    data = labelled.where(F.col(lang_col).isNotNull()).select(F.col(text_col).alias("t"), F.col(lang_col).alias("lang"))
    stats = data.mapInPandas(partial, "kind string, lang string, gram string, n long").groupBy("kind", "lang", "gram").agg(F.sum("n").alias("n"))
    stats = materialise(stats, "language-counts")
    per = stats.groupBy("kind", "gram").agg(F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by"), F.sum("n").alias("n"))
    # The most frequent of every language; at most languages x max rows come to the driver.
    place = F.row_number().over(Window.partitionBy("kind", "lang").orderBy(F.desc("n"), "gram"))
    most = F.when(F.col("kind") == "w", max_words).otherwise(max_grams)
    top = stats.withColumn("place", place).where(F.col("place") <= most).select("kind", "gram").distinct()
    best = per.where("n >= 2").join(top, ["kind", "gram"]).orderBy("kind", F.desc("n"), "gram").collect()
    kept = {k: [r for r in best if r["kind"] == k] for k in ("w", "g")}
    sums = {(r["kind"], r["lang"]): (r["n"], r["v"]) for r in stats.groupBy("kind", "lang").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()}
    langs = sorted({lang for _, lang in sums})

    def logs(kind: str, by: dict[str, int], smooth: float) -> np.ndarray:
        own = np.array([(by.get(x, 0) + smooth) / (sums.get((kind, x), (0, 1))[0] + smooth * sums.get((kind, x), (0, 1))[1]) for x in langs])
        return np.log(own)

    def centred(kind: str, by: dict[str, int]) -> np.ndarray:
        x = logs(kind, by, 0.5)
        return np.clip(x - x.mean(), -8, 8)

    return LanguageModel(
        langs,
        {r["gram"]: i for i, r in enumerate(kept["w"])},
        np.array([centred("w", r["by"]) for r in kept["w"]]).reshape(len(kept["w"]), len(langs)),
        {r["gram"]: i for i, r in enumerate(kept["g"])},
        np.array([centred("g", r["by"]) for r in kept["g"]] + [np.zeros(len(langs))]).reshape(len(kept["g"]) + 1, len(langs)),
    )


def predict_columns(model: LanguageModel, text_col: str = "text"):  # noqa: ANN201
    """struct<lang_pred, score> of a text column."""

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([model.predict(t) for t in texts], columns=["lang_pred", "score"])

    return predict(F.col(text_col))


def sampled(docs: DataFrame, per_lang: int, lang_col: str = "lang", key_col: str = "doc_id") -> DataFrame:
    """About ``per_lang`` rows of every language (all, if there are fewer), by a hash of the key."""
    counts = docs.groupBy(F.col(lang_col).alias("__lang")).agg(F.count("*").alias("__rows"))  # one row per language
    cut = F.lit(2**31) * F.lit(per_lang) / F.col("__rows")
    near = docs.join(F.broadcast(counts), F.col(lang_col) == F.col("__lang"))
    return near.where(F.pmod(F.xxhash64(F.col(key_col), F.lit("language")), F.lit(2**31)) < cut).select(*[docs[c] for c in docs.columns])


def op9_language(spark: SparkSession, sf_dir: str, per_lang: int = 1_500) -> DataFrame:
    """Every document's language; learned outside the fold crc32(doc_id) % 3 = 1."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(sampled(docs.where(F.col("lang").isNotNull() & (crc_mod("doc_id", 3) != 1)), per_lang))
    return docs.select("doc_id", held_out(3, 1), predict_columns(model).alias("p")).select(
        "doc_id", "held_out", F.col("p.lang_pred").alias("lang_pred"), F.col("p.score").alias("score")
    )
