"""Near copies among texts that only share some common lines."""

from __future__ import annotations

import random

import numpy as np

from ledgerloom.llm import ngram_join
from ledgerloom.llm.shingles import shingle_sets


def texts_with_common_lines(seed: int, n: int) -> list[str]:
    """Random words around one or two of three common lines; every tenth text comes again with another last word."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choices("abcdefghijklmnop", k=6))
    lines = [" ".join(word() for _ in range(24)) for _ in range(3)]
    out = []
    for i in range(n):
        own = [word() for _ in range(rnd.choice((40, 80, 120)))]
        for line in rnd.sample(lines, rnd.choice((1, 2))):
            at = rnd.randrange(len(own))
            own[at:at] = [line]
        out.append(" ".join(own))
        if i % 10 == 0:
            out.append(" ".join([*own[:-1], word()]))
    return out


def components(texts: list[str], words: int, percent: int) -> list[int]:
    """By comparing all pairs."""
    sets = [set(s.tolist()) for s in shingle_sets(texts, words)]
    label = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            both = len(a & b)
            if 100 * both >= percent * (len(a) + len(b) - both) and label[i] != label[j]:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return label


def test_common_lines_make_no_large_cluster(spark, monkeypatch):
    """They tie nearly all of these texts together by some key, though few are linked: so many pairs of parts were compared."""
    texts, compared, write = texts_with_common_lines(7, 600), [], ngram_join.materialise

    def counted(df, name):
        out = write(df, name)
        if name == "ngram-members":
            compared.append(out.count())
        return out

    monkeypatch.setattr(ngram_join, "materialise", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for words, percent in ((5, 80), (3, 90)):
        found = {r["doc_id"]: r["component_id"] for r in ngram_join.near_duplicates(docs, words=words, percent=percent).collect()}
        assert [found[i] for i in range(len(texts))] == components(texts, words, percent)
    assert all(120 <= n <= 200 for n in compared), compared


def test_linked_sets_share_enough_keys():
    """Random sets that are just similar enough share as many keys of a class as ``shared_least`` says."""
    rnd = np.random.default_rng(11)
    for percent in (80, 90):
        least = ngram_join.shared_least(percent)
        for _ in range(300):
            both = int(rnd.integers(4, 900))
            differ = both * (100 - percent) // percent
            cut = int(rnd.integers(0, differ + 1))
            x = np.unique(rnd.integers(0, 2**63, both + differ).astype(np.uint64))
            if len(x) < both + differ or 100 * both < percent * len(x) or not differ:
                continue
            a, b = np.sort(x[: both + cut]), np.sort(np.concatenate([x[:both], x[both + cut :]]))
            one, two = ngram_join.join_keys([a, b], percent)
            shared = np.intersect1d(one, two)
            of = (shared & np.uint64(ngram_join.CLASS_BITS)).astype(int)
            assert any((of == c).sum() >= least[c] for c in set(of.tolist()))
