"""Captions in spans: which field's caption a span carries, and the value that follows it in the same span.

The captions are a bounded dictionary, the spans are not: distinct span texts are matched once (documents
of one kind repeat their captions), and the hits join back to the spans by text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import clean_label
from ledgerloom.operators.alignment import Texts

LONGEST_CAPTION = 180
# What may stand between a caption and its value, and an abbreviation's point before a number.
SEPARATOR = re.compile(r"\s*[:\-–—=|>]")
ABBREVIATION = re.compile(r"\s*\.\s*[0-9]")
PREFIX = re.compile(r"[\s:\-–—=|.,)#]+")


def needed(caption: str, base: float) -> float:
    return max(base, 0.97) if len(caption) <= 4 else max(base, 0.92) if len(caption) <= 6 else base


Found = tuple[str, float, str]  # caption, similarity, rest


def set_off(text: str, end: int, pattern: re.Pattern | None) -> str:
    """The value after a caption that ends at ``end``; empty if what follows is no value but more prose."""
    tail = text[end:]
    rest = PREFIX.sub("", tail, count=1).strip() if PREFIX.match(tail) else tail.strip()
    if not rest or ABBREVIATION.match(tail):
        return ""
    parted = SEPARATOR.match(tail) or tail.lstrip().startswith(".") or (pattern is not None and pattern.fullmatch(rest))
    return rest if parted else ""


def caption_of(text: str, captions: list[str], scores: list[tuple[float, float, int, int]], pattern: re.Pattern | None, base: float) -> Found | None:
    """The field's best caption in a span: (caption, similarity, rest). A caption that is the whole span leaves no rest;
    one at its beginning must be set off by a separator, or leave a rest of the field's own shape. ``scores`` has for each
    caption the likeness of the whole span, and of its best window with where that begins and ends."""
    best: Found | None = None
    for caption, (whole, part, start, end) in zip(captions, scores, strict=True):
        least, score = needed(caption, base), best[1] if best else 0.0
        if whole >= least and whole > score:
            best, score = (caption, whole, ""), whole
        if len(text) > len(caption) and part >= least and start <= 2 and (rest := set_off(text, end, pattern)):
            if part > score or (part >= score - 0.02 and len(caption) > len(best[0] if best else "")):
                best = (caption, part, rest)
    return best


def captions_of(texts: list[str], cleans: list[str], captions: list[str], pattern: re.Pattern | None, base: float) -> Iterator[tuple[int, Found]]:
    """``caption_of`` for a batch: each caption is aligned with all texts at once, and only texts near one are looked at."""
    low, clean = Texts([t.lower() for t in texts]), Texts(cleans)
    told = [(clean.ratios(c, needed(c, base)), *low.partial(c, needed(c, base))) for c in captions]
    near = np.zeros(len(texts), bool)
    for c, (whole, part, *_) in zip(captions, told, strict=True):
        near |= (whole >= needed(c, base)) | (part >= needed(c, base))
    for i in np.flatnonzero(near):
        scores = [(float(w[i]), float(p[i]), int(s[i]), int(e[i])) for w, p, s, e in told]
        if (hit := caption_of(texts[i], captions, scores, pattern, base)) is not None:
            yield int(i), hit


def caption_hits(spans: DataFrame, captions: dict[str, list[str]], patterns: dict[str, str] | None = None, base: float = 0.82) -> DataFrame:
    """``spans`` (with text) and for each field whose caption it carries: field, caption, similarity, rest."""
    own = {f: [c.lower() for c in cs] for f, cs in captions.items()}
    shapes = {f: re.compile(p) for f, p in (patterns or {}).items()}

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts, plain, cleans = pdf["text"].tolist(), pdf["text"].str.strip().tolist(), pdf["clean"].tolist()
            out = [(texts[i], f, *hit) for f, cs in own.items() for i, hit in captions_of(plain, cleans, cs, shapes.get(f), base)]
            yield pd.DataFrame(out, columns=["text", "field", "caption", "similarity", "rest"])

    # Texts are short and their alignment costly, so they are dealt out by number: Spark would join them to few tasks by their bytes.
    parts = int(spans.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = spans.select("text").where((F.btrim("text") != "") & (F.length(F.btrim("text")) <= LONGEST_CAPTION)).repartition(parts, "text").distinct()
    hits = texts.withColumn("clean", clean_label(F.col("text"))).mapInPandas(match, "text string, field string, caption string, similarity double, rest string")
    return spans.join(hits, "text")


def without_captions(values: list[str], captions: list[str], pattern: re.Pattern | None, base: float = 0.82, rounds: int = 2) -> list[str]:
    """Values without a caption of their own field that is repeated at their beginning (a sub-caption in the value's cell): in each
    round the caption whose removal leaves the least, if what follows it is set off."""
    values = [v.strip() for v in values]
    for _ in range(rounds):
        low, shorter = Texts([v.lower() for v in values]), list(values)
        for c in captions:
            part, start, end = low.partial(c, needed(c, base))
            for i in np.flatnonzero((part >= needed(c, base)) & (start <= 2)):
                rest = set_off(values[i], int(end[i]), pattern)
                if rest and len(rest) < len(shorter[i]):
                    shorter[i] = rest
        if shorter == values:
            break
        values = shorter
    return values


def own_captions_removed(field: Column, value: Column, captions: dict[str, list[str]], patterns: dict[str, str] | None = None, base: float = 0.82) -> Column:
    """``value`` without captions of ``field`` at its beginning. Null stays null; a batch's distinct values are aligned once."""
    own = {f: [c.lower() for c in cs] for f, cs in captions.items()}
    shapes = {f: re.compile(p) for f, p in (patterns or {}).items()}

    @F.pandas_udf("string")
    def one(fields: pd.Series, values: pd.Series) -> pd.Series:
        out = values.copy()
        for f, cs in own.items():
            rows = (fields == f) & values.notna()
            distinct = values[rows].unique().tolist()
            if distinct:
                out[rows] = values[rows].map(dict(zip(distinct, without_captions(distinct, cs, shapes.get(f), base), strict=True)))
        return out

    return one(field, value)


def fragment_tier(fragment: Column, tiers: dict[str, dict[str, list[str]]], priority: list[str]) -> Column:
    """The tier of an address fragment: the first of ``priority`` whose head words begin it, whose tail words end it or whose
    phrases occur in it; unknown otherwise. ``tiers`` is the keyword table (head, tail, any)."""
    text = F.btrim(F.regexp_replace(F.lower(fragment), "[^a-z0-9&]+", " "))
    words = F.split(text, " ")
    out = F.lit("unknown")
    for name in reversed(priority):
        t = tiers[name]
        any_phrase = F.lit(False)
        for phrase in t.get("any", []):
            any_phrase = any_phrase | F.contains(F.concat(F.lit(" "), text, F.lit(" ")), F.lit(f" {phrase} "))
        hit = F.get(words, F.lit(0)).isin(*t.get("head", [])) | F.element_at(words, -1).isin(*t.get("tail", [])) | any_phrase
        out = F.when(hit, name).otherwise(out)
    return out
