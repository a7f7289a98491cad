"""Spaces put back into run-together address text: ``FLAT302GREENPARKTOWER`` to ``FLAT 302 GREENPARK TOWER``.

A run is cut into pieces so that their points are highest. What a piece earns depends on itself and its two neighbours only, so
the best cover is a shortest path over pieces: key words earn points where they stand as their role asks (a word that begins a
component at the run's beginning or after an anchor, one that ends a component at the end or before an anchor), unit numbers
earn points anywhere, ordinary words none, and every cut costs. A run is cut only if an anchor in its place carries the cuts
and the points exceed those of the whole run by a margin; otherwise it stays as it is. Only spaces are added, nothing else changes.

Scale: a map over the rows without a shuffle. A batch's distinct runs are cut once, and a worker remembers runs that it has seen; runs
without an anchor in them are passed over by one search. Points are whole hundredths.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.operators.segments import STRUCTURE, UNKNOWN_LEVEL, Keywords

# Points, the margin, which runs and pieces are looked at, the broadest tier whose end words part components,
# and the shapes of unit numbers.
STRONG, WEAK, PER_CUT, MARGIN = 200, 80, 50, 75
LEAST_RUN, MOST_RUN, MOST_PIECE, FACILITY_LEVEL = 6, 40, 18, 3
NUMBER = re.compile(r"\d+(?:st|nd|rd|th)|\d{2,}[a-z]?(?:[-/]\d+[a-z]?)*|[a-z]-\d+[a-z]?|[a-z]?\d[a-z]")
LONE_DIGIT = re.compile(r"\d")
LETTER = re.compile(r"[a-rt-z]|ii|iii|iv|vi|vii|viii|ix|xi|xii")
VOWEL, CONSONANTS = re.compile("[aeiouy]"), re.compile("[bcdfghjklmnpqrstvwxz]{4,}")


@dataclass(frozen=True)
class Look:
    """What a piece is: unconditional points, whether it is a strong anchor, the role of a key word, whether only a
    structure's word before it makes it a unit, whether it is such a word."""

    points: int = 0
    strong: bool = False
    role: str = ""
    letter: bool = False
    structure: bool = False
    digits: bool = False


@dataclass(frozen=True)
class Vocabulary:
    """Key words with tier, role and level, and all roles that a word has anywhere."""

    words: dict[str, tuple[str, str, int]]
    roles: dict[str, frozenset[str]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        object.__setattr__(self, "look", lru_cache(maxsize=50_000)(self._look))
        object.__setattr__(self, "edge", lru_cache(maxsize=50_000)(self._edge))
        anchors = [w for w, (_, role, level) in self.words.items() if len(w) >= 4 and role != "any" and not (role == "tail" and level > FACILITY_LEVEL)]
        object.__setattr__(self, "anchor", re.compile("|".join([r"\d", *map(re.escape, sorted(anchors))])))

    def _look(self, core: str) -> Look | None:
        """``None``: no piece of an address."""
        if NUMBER.fullmatch(core):
            return Look(STRONG, strong=True, digits=core.isdigit())
        if LONE_DIGIT.fullmatch(core):
            return Look(WEAK, digits=True)
        if LETTER.fullmatch(core):
            return Look(letter=True)
        if core in self.words:
            tier, role, level = self.words[core]
            structure = tier == STRUCTURE and role == "head"
            if len(core) < 4 or (role == "tail" and level > FACILITY_LEVEL):
                return Look(structure=structure)
            return Look(WEAK, role=role) if role == "any" else Look(0, True, role, structure=structure)
        if len(core) < 4 or not VOWEL.search(core) or CONSONANTS.search(core):
            return None
        return Look()

    def _edge(self, core: str, end: bool) -> frozenset[str]:
        """The roles of the key word that a piece is, or ends (begins) with."""
        if core in self.roles:
            return self.roles[core]
        fits = core.endswith if end else core.startswith
        return frozenset().union(*(r for w, r in self.roles.items() if len(w) < len(core) and fits(w)))

    def apart(self, left: str, right: str) -> bool:
        """Whether a cut between two pieces may be: not inside a number, not between words of one role."""
        return not (left.isdigit() and right.isdigit()) and not (self.edge(left, True) & self.edge(right, False))


def vocabulary(kw: Keywords) -> Vocabulary:
    """Words of three letters or more: roles first, then the words of phrases, then connectors. A word that ends names of
    localities anywhere (a morpheme) is one of them wherever else it is listed."""
    tiers = list(kw.tiers.items())
    morphemes = {w.casefold() for _, t in tiers if t.level > FACILITY_LEVEL for w in t.tail}
    words: dict[str, tuple[str, str, int]] = {}
    roles: dict[str, set[str]] = {}
    for name, tier in tiers:
        for role, listed in (("head", tier.head), ("tail", tier.tail)):
            for w in (w.casefold() for w in listed if len(w) >= 3):
                roles.setdefault(w, set()).add(role)
                words.setdefault(w, (name, role, UNKNOWN_LEVEL if role == "tail" and w in morphemes else tier.level))
    for name, tier in tiers:
        for w in (w.casefold() for phrase in tier.phrases for w in phrase.split() if len(w) >= 3):
            words.setdefault(w, (name, "any", tier.level))
    for w in kw.connectors:
        if w.isalpha():
            words.setdefault(w.casefold(), ("", "any", UNKNOWN_LEVEL))
    return Vocabulary(words, {w: frozenset(r) for w, r in roles.items()})


def core(piece: str) -> str:
    return re.sub("[^a-z0-9]+", "", piece.casefold())


def confirms(after: Look, unit: bool) -> bool:
    """Whether a piece shows that the word before it ends a component; ``unit``: a letter after a structure's word."""
    return after.strong or unit or after.role == "head" or after.digits


def anchored(cores: list[str], v: Vocabulary) -> bool:
    """Whether a strong anchor stands where its role asks."""
    looks = [v.look(c) for c in cores]
    unit = [i > 0 and x.letter and looks[i - 1].structure for i, x in enumerate(looks)]
    for i, x in enumerate(looks):
        if x.role == "tail" and x.strong and (i == len(looks) - 1 or confirms(looks[i + 1], unit[i + 1])):
            return True
        if x.role == "head" and x.strong and (i == 0 or looks[i - 1].strong or unit[i - 1]):
            return True
        if unit[i] or (x.strong and not x.role):
            return True
    return False


def break_run(run: str, v: Vocabulary) -> list[str]:
    """The pieces of one run without spaces; the run alone if it is not to be cut. Of equal points the fewest
    pieces win, then longer ones first."""
    if not LEAST_RUN <= len(run) <= MOST_RUN or not v.anchor.search(run.casefold()):
        return [run]
    ends: list[list[tuple[tuple[int, int, tuple[int, ...]], str, Look]]] = [[] for _ in range(len(run) + 1)]
    for a in range(len(run)):
        if a and not ends[a]:
            continue
        for b in range(a + 1, min(len(run), a + MOST_PIECE) + 1):
            own = core(run[a:b])
            look = v.look(own) if own else None
            if look is None:
                continue
            ways = [((look.points + STRONG * (look.role == "head" and look.strong), -1, (b,)), None)] if not a and not look.letter else []
            for (points, n, cuts), before, left in ends[a]:
                unit = look.letter and left.structure
                if (look.letter and not unit) or not v.apart(before, own):
                    continue
                gain = look.points - PER_CUT + STRONG * unit
                gain += STRONG * (look.role == "head" and look.strong and left.strong)
                gain += STRONG * (left.role == "tail" and left.strong and confirms(look, unit))
                ways.append(((points + gain, n - 1, (*cuts, b)), None))
            if ways:
                ends[b].append((max(ways)[0], own, look))
    whole = [((p + STRONG * (x.role == "tail" and x.strong), n, cuts), c) for (p, n, cuts), c, x in ends[len(run)]]
    if not whole:
        return [run]
    (points, _, cuts), _ = max(whole)
    pieces = [run[a:b] for a, b in zip((0, *cuts[:-1]), cuts, strict=True)]
    uncut = v.look(core(run))
    # Left whole, a run that is no piece of an address stands far below any cover.
    floor = -300 if uncut is None or uncut.letter else uncut.points + STRONG * bool(uncut.strong and uncut.role)
    if len(pieces) < 2 or not anchored([core(p) for p in pieces], v) or points < floor + MARGIN:
        return [run]
    return pieces


def respace(text: str, cut: Callable[[str], list[str]]) -> str:
    """A text with its runs cut; as it was if nothing is."""
    runs = text.split()
    pieces = [p for r in runs for p in cut(r)]
    return text if len(pieces) == len(runs) else " ".join(pieces)


def respaced(text: Column, kw: Keywords) -> Column:
    """``text`` with spaces put back. Null stays null; without key words nothing changes."""
    return F.get(respaced_all(F.array(text), kw), F.lit(0))


def respaced_all(texts: Column, kw: Keywords) -> Column:
    """``respaced`` of every text of an array."""
    if not kw.tiers:
        return texts

    @F.pandas_udf("array<string>")
    def one(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        v = vocabulary(kw)
        cut = lru_cache(maxsize=100_000)(lambda run: break_run(run, v))
        for rows in batches:
            known = {t: respace(t, cut) for t in {t for r in rows if r is not None for t in r if t is not None}}
            yield rows.map(lambda r: None if r is None else [known.get(t) for t in r])

    return one(texts)
