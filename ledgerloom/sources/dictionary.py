"""The dictionary of fields, the document profiles and the key word tables as JSON files: strict, small, read on the driver."""

from __future__ import annotations

import dataclasses
import json
import re

from pyspark.sql import SparkSession
from pyspark.sql.utils import AnalysisException

from ledgerloom.operators import validate
from ledgerloom.operators.segments import Keywords, Tier
from ledgerloom.plans.extraction import Field, check

FIELD_KEYS = {f.name for f in dataclasses.fields(Field)}


def text(spark: SparkSession, path: str) -> str | None:
    """A whole file, from any file system that Spark reads; None where there is none."""
    try:
        row = spark.read.text(path, wholetext=True).first()
    except AnalysisException:
        return None
    return row and row["value"]


def compiled(pattern: str, where: str) -> str:
    try:
        re.compile(pattern)
    except re.error as e:
        raise ValueError(f"{where}: bad pattern {pattern!r}: {e}") from e
    return pattern


def fields(source: str) -> dict[str, Field]:
    """``{"fields": {name: {captions, patterns, ..}}}`` as checked fields, in order. Unknown keys, unknown validators, bad
    patterns and fields that nothing could find are refused by name."""
    raw = json.loads(source).get("fields") or {}
    if not raw:
        raise ValueError("no fields")
    out = {}
    for name, own in raw.items():
        if not isinstance(own, dict):
            raise ValueError(f"{name}: must be an object")
        if unknown := sorted(set(own) - FIELD_KEYS):
            raise ValueError(f"{name}: unknown keys {unknown}")
        if missing := [v for v in own.get("validators", []) if v not in validate.RULES]:
            raise ValueError(f"{name}: undefined validators {missing}")
        for key in ("patterns", "exclude"):
            for p in own.get(key, []):
                compiled(p, name)
        given = {k: tuple(v) if isinstance(v, list) else v for k, v in own.items()}
        aliases = own.get("aliases", {})
        given["aliases"] = tuple((compiled(p, name), canonical) for canonical, ps in aliases.items() for p in ([ps] if isinstance(ps, str) else ps))
        out[name] = Field(**({"captions": (), "consistent": False} | given))
    check(out)
    return out


def profiles(source: str | None) -> dict[str, tuple[tuple[str, ...], tuple[str, ...]]]:
    """``{name: {filename: [..], content: [..]}}``; no file, no profiles."""
    return {n: (tuple(p.get("filename", ())), tuple(p.get("content", ()))) for n, p in json.loads(source or "{}").items()}


def keywords(source: str | None) -> Keywords:
    """``{tiers: {name: {level, head, tail, any}}, priority: [..]}``; a missing or broken file gives an empty table."""
    try:
        raw = json.loads(source or "{}")
        tiers = {n: Tier(t["level"], *(tuple(w.lower() for w in t.get(k) or ()) for k in ("head", "tail", "any"))) for n, t in raw.get("tiers", {}).items()}
    except (ValueError, KeyError, TypeError, AttributeError):
        return Keywords({})
    return Keywords(tiers, tuple(raw.get("priority", ())))


def sample_errors(patterns: dict[str, list[str]], accept: dict[str, list[str]], refuse: dict[str, list[str]]) -> list[tuple[str, str, str]]:
    """(field, sample, accepted or refused) where a field's patterns judge a sample wrongly."""
    fits = lambda name, s: any(re.fullmatch(p, s) for p in patterns.get(name, []))
    bad = [(n, s, "refused") for n, samples in accept.items() for s in samples if not fits(n, s)]
    return bad + [(n, s, "accepted") for n, samples in refuse.items() for s in samples if fits(n, s)]
