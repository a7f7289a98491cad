"""Left-over address text to up to four ordered lines, by a table of key words.

Everything is array work inside the row, without a shuffle: fragments are told apart by their key words, neighbouring
fragments are cut where the address steps from one kind of place to another, and the weakest cuts go until the lines
fit. Merging two groups changes no other cut's strength, so "merge the weakest until it fits" is one sort of the cuts.
Confidences and strengths are whole hundredths, so no threshold depends on rounding.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The kinds that a fragment's shape tells, the level of a fragment without a kind, and the lines by confidence.
PREMISES, STRUCTURE, LOCALITY, UNKNOWN, UNKNOWN_LEVEL = "premises_unit", "structural", "locality", "unknown", 4
LINES = {"high": 4, "medium": 3, "low": 2}
DESIGNATOR, ORDINAL, HASH_NUMBER, SHORT_DESIGNATOR = r"\A[a-z]?[-/]?\d+[a-z]?([-/]\d+[a-z]?)*\z", r"\A\d+(st|nd|rd|th)\z", r"\A#|\Ano\.?\s*\d", r"\A[a-z0-9]{1,3}\z"


@dataclass(frozen=True)
class Tier:
    """A kind of place: its level from narrow (1) to broad (5), and the words that begin, end or occur in its fragments."""

    level: int
    head: tuple[str, ...] = ()
    tail: tuple[str, ...] = ()
    phrases: tuple[str, ...] = ()


@dataclass(frozen=True)
class Keywords:
    """The table: tiers, which of them wins where several fit, words that hold on to the next one, and thresholds in hundredths."""

    tiers: dict[str, Tier]
    priority: tuple[str, ...] = ()
    connectors: tuple[str, ...] = ("no", "nos", "of", "at", "the", "and")
    cut_at: int = 50
    high: int = 70
    medium: int = 45
    unknown: int = 55
    least_run: int = 4
    least_tokens: int = 4
    most_designators: int = 4

    @property
    def ranked(self) -> list[str]:
        known = [t for t in self.priority if t in self.tiers]
        return known + sorted(set(self.tiers) - set(known))

    @property
    def heads(self) -> list[str]:
        return sorted({w for t in self.tiers.values() for w in t.head})

    @property
    def tails(self) -> list[str]:
        return sorted({w for t in self.tiers.values() for w in t.tail})


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda t: t != "")


def word(token: Column) -> Column:
    """A token as it is looked up: lower case, letters and digits only."""
    return F.regexp_replace(F.lower(token), "[^a-z0-9]+", "")


def parts(segment: Column, kw: Keywords) -> Column:
    """array<struct<text, injected>>: a segment without commas, cut before words that begin a fragment, after words that
    end one and after the designators of a beginning word. Tokens keep their order and spelling."""
    own = tokens(segment)
    words = F.transform(own, word)
    n = F.size(own)
    at = lambda i: F.get(words, i)
    head, tail = lambda w: w.isin(*kw.heads), lambda w: w.isin(*kw.tails)

    def cuts(w: Column, i: Column) -> Column:
        after = F.slice(words, i + 2, kw.most_designators)
        stops = F.transform(after, lambda d: ~d.rlike(SHORT_DESIGNATOR) | head(d) | tail(d))
        run = F.when(F.exists(stops, lambda s: s), F.array_position(stops, True).cast("int") - 1).otherwise(F.size(after))
        return F.array_compact(F.array(
            F.when(tail(w) & (i < n - 1) & ~tail(at(i + 1)), i),
            F.when(head(w) & (i > 0) & ~head(at(F.greatest(i - 1, F.lit(0)))) & ~at(F.greatest(i - 1, F.lit(0))).isin(*kw.connectors), i - 1),
            F.when(head(w) & (run > 0) & (i + run < n - 1), i + run),
        ))

    found = F.array_sort(F.array_distinct(F.flatten(F.transform(words, cuts))))
    starts = F.concat(F.array(F.lit(0)), F.transform(found, lambda c: c + 1))
    ends = F.concat(found, F.array(n - 1))
    pieces = F.transform(starts, lambda s, k: F.array_join(F.slice(own, s + 1, F.get(ends, k) - s + 1), " "))
    pieces = F.filter(pieces, lambda p: F.btrim(p, F.lit(" ,")) != "")
    whole = F.array(F.struct(segment.alias("text"), F.lit(False).alias("injected")))
    return F.when(F.size(pieces) > 1, F.transform(pieces, lambda p: F.struct(p.alias("text"), F.lit(True).alias("injected")))).otherwise(whole)


def matches(words: Column, kw: Keywords) -> Column:
    """array<struct<rank, conf>>: the tiers that fit a fragment's words, exactly or, where none does, in the first run-together word."""
    hit = lambda ok, rank, conf: F.when(ok, F.struct(F.lit(rank).alias("rank"), F.lit(conf).alias("conf")))
    first, last, text = F.get(words, F.lit(0)), F.element_at(words, -1), F.array_join(words, " ")
    exact, glued = [], []
    for rank, name in enumerate(kw.ranked):
        t = kw.tiers[name]
        exact += [hit(first.isin(*t.head), rank, 100)] if t.head else []
        exact += [hit(last.isin(*t.tail), rank, 100)] if t.tail else []
        exact += [hit(F.contains(text, F.lit(p)), rank, 90) for p in t.phrases if p]
        long_head, long_tail = [w for w in t.head if len(w) >= 4], [w for w in t.tail if len(w) >= 4]
        either = [rf"\A(?:{'|'.join(long_head)}).+"] * bool(long_head) + [rf".+(?:{'|'.join(long_tail)})\z"] * bool(long_tail)
        glued += [(rank, "|".join(either))] if either else []
    none = F.array().cast("array<struct<rank:int,conf:int>>")
    whole = F.array_compact(F.array(*exact)) if exact else none
    if not glued:
        return whole
    per_word = F.transform(words, lambda w: F.array_compact(F.array(*[hit((F.length(w) >= 5) & w.rlike(p), rank, 75) for rank, p in glued])))
    merged = F.coalesce(F.get(F.filter(per_word, lambda m: F.size(m) > 0), F.lit(0)), none)
    return F.when(F.size(whole) > 0, whole).otherwise(merged)


def kind(text: Column, words: Column, found: Column, kw: Keywords) -> Column:
    """struct<tier, level, conf> of a fragment from its matches or, without any, from its shape. Nothing beside it counts."""
    one = lambda tier, level, conf: F.struct(F.lit(tier).alias("tier"), F.lit(level).alias("level"), F.lit(conf).alias("conf"))
    n = F.size(words)
    shape = (
        F.when((n == 1) & F.get(words, F.lit(0)).rlike(ORDINAL), one(PREMISES, 1, 85))
        .when(F.lower(F.btrim(text)).rlike(HASH_NUMBER), one(PREMISES, 1, 80))
        .when(F.array_join(words, "").rlike(DESIGNATOR), one(PREMISES, 1, 70))
        .when((n == 2) & F.get(words, F.lit(1)).rlike(SHORT_DESIGNATOR) & F.get(words, F.lit(0)).isin(*kw.tails), one(STRUCTURE, 1, 80))
        .otherwise(one(UNKNOWN, UNKNOWN_LEVEL, kw.unknown))
    )
    rank = F.array_min(F.transform(found, lambda m: m["rank"]))
    alone = F.size(F.array_distinct(F.transform(found, lambda m: m["rank"]))) == 1
    names, levels = F.array(*map(F.lit, kw.ranked)), F.array(*[F.lit(kw.tiers[t].level) for t in kw.ranked])
    conf = F.when(alone, F.array_max(F.transform(found, lambda m: m["conf"]))).otherwise(50)
    by_word = F.struct(F.get(names, rank).alias("tier"), F.get(levels, rank).alias("level"), conf.alias("conf"))
    return F.when(F.size(found) > 0, by_word).otherwise(shape)


def strength(a: Column, b: Column) -> Column:
    """How strongly two neighbouring fragments are apart, in hundredths."""
    step = b["level"] - a["level"]
    s = F.when(step == 1, 50).when(step > 1, 60).when(step < 0, F.when((a["level"] <= 2) & (b["level"] <= 2), 20).otherwise(40)).otherwise(0)
    return F.greatest(F.lit(0), s + F.when(a["tier"] != b["tier"], 20).otherwise(0) - F.when(a["injected"] | b["injected"], 15).otherwise(0))


def fragments(addresses: DataFrame, kw: Keywords, segments: str = "segments") -> DataFrame:
    """Adds ``fragments``, array<struct<text, injected, tier, level, conf>>, of an array of segments. Blank and null
    segments go; without key words every segment is one unknown fragment."""
    clean = F.filter(F.transform(F.coalesce(F.col(segments), F.array().cast("array<string>")), lambda s: F.btrim(F.coalesce(s, F.lit("")))), lambda s: s != "")
    x = addresses.withColumn("__s", clean)
    plain = F.transform("__s", lambda s: F.struct(s.alias("text"), F.lit(False).alias("injected")))
    if not kw.tiers:
        unknown = lambda p: F.struct(p["text"], p["injected"], F.lit(UNKNOWN).alias("tier"), F.lit(UNKNOWN_LEVEL).alias("level"), F.lit(kw.unknown).alias("conf"))
        return x.withColumn("fragments", F.transform(plain, unknown)).drop("__s")
    only = F.get("__s", F.lit(0))
    x = x.withColumn("__p", F.when((F.size("__s") == 1) & (F.size(tokens(only)) >= kw.least_tokens), parts(only, kw)).otherwise(plain))
    x = x.withColumn("__p", F.transform("__p", lambda p: F.struct(p["text"].alias("text"), p["injected"].alias("injected"), F.transform(tokens(p["text"]), word).alias("words"))))
    x = x.withColumn("__p", F.transform("__p", lambda p: F.struct(p["text"].alias("text"), p["injected"].alias("injected"), p["words"].alias("words"), matches(p["words"], kw).alias("found"))))
    x = x.withColumn("__p", F.transform("__p", lambda p: F.struct(p["text"].alias("text"), p["injected"].alias("injected"), kind(p["text"], p["words"], p["found"], kw).alias("k"))))
    done = lambda p: F.struct(p["text"].alias("text"), p["injected"].alias("injected"), p["k"]["tier"].alias("tier"), p["k"]["level"].alias("level"), F.when(p["injected"], F.greatest(F.lit(0), p["k"]["conf"] - 10)).otherwise(p["k"]["conf"]).alias("conf"))
    return x.withColumn("fragments", F.transform("__p", done)).drop("__s", "__p")


def lines(addresses: DataFrame, kw: Keywords, segments: str = "segments") -> DataFrame:
    """Adds ``lines`` (up to four), ``line_confidence`` high, medium or low and ``line_score``, the mean confidence.

    All fragments, joined again, are the input's text in its order. A run of ``least_run`` or more localities at the end
    gives its last one a line of its own, if something stands before the run. Without text: no lines, low."""
    x = fragments(addresses, kw, segments)
    local = kw.tiers[LOCALITY].level if LOCALITY in kw.tiers else UNKNOWN_LEVEL
    f, n = F.col("fragments"), F.size("fragments")
    total = F.aggregate(f, F.lit(0), lambda s, p: s + p["conf"])
    injected, vague = F.exists(f, lambda p: p["injected"]), F.forall(f, lambda p: p["tier"] == UNKNOWN)
    level = F.when((n == 0) | (injected & vague), "low").when((total >= kw.high * n) & ~injected, "high").when(total >= kw.medium * n, "medium").otherwise("low")
    gaps = F.transform(f, lambda p, i: F.struct(F.lit(0).alias("kept"), F.when(i > 0, strength(F.get(f, F.greatest(i - 1, F.lit(0))), p)).otherwise(-1).alias("gap"), i.alias("i")))
    x = x.withColumn("__level", level).withColumn("__cuts", F.filter(gaps, lambda g: g["gap"] >= kw.cut_at))
    x = x.withColumn("line_score", F.when(n > 0, F.round(total / (100 * n), 3)).otherwise(0.0))
    last_cut = F.coalesce(F.array_max(F.transform("__cuts", lambda g: g["i"])), F.lit(-1))
    narrow = F.coalesce(F.array_max(F.transform(f, lambda p, i: F.when(p["level"] < local, i))), F.lit(-1))
    run = n - F.greatest(last_cut, narrow + 1)
    x = x.withColumn("__peel", (F.col("__level") != "low") & (last_cut > 0) & (run >= kw.least_run) & (run > 1))
    peeled = F.array(F.struct(F.lit(1).alias("kept"), F.lit(0).alias("gap"), (n - 1).alias("i")))
    x = x.withColumn("line_confidence", F.when(F.col("__peel") & (F.col("__level") == "high"), "medium").otherwise(F.col("__level")))
    room = F.when(F.col("line_confidence") == "high", LINES["high"] - 1).when(F.col("line_confidence") == "medium", LINES["medium"] - 1).otherwise(LINES["low"] - 1)
    strongest = F.slice(F.sort_array(F.when(F.col("__peel"), F.concat("__cuts", peeled)).otherwise(F.col("__cuts")), asc=False), F.lit(1), room)
    x = x.withColumn("__at", F.array_sort(F.transform(strongest, lambda g: g["i"])))
    starts = F.concat(F.array(F.lit(0)), F.col("__at"))
    ends = F.concat(F.col("__at"), F.array(n))
    text = F.transform(starts, lambda s, k: F.array_join(F.transform(F.slice(f, s + 1, F.get(ends, k) - s), lambda p: p["text"]), ", "))
    none = F.array().cast("array<string>")
    return x.withColumn("lines", F.when(n > 0, text).otherwise(none)).drop("__level", "__cuts", "__peel", "__at")


def address_columns(found: DataFrame) -> DataFrame:
    """``lines`` as address_1 to address_4, empty where there is none."""
    return found.withColumns({f"address_{i + 1}": F.coalesce(F.get("lines", F.lit(i)), F.lit("")) for i in range(4)})


def back_fill(packets: DataFrame, resolved: DataFrame, key: str = "packet_id") -> DataFrame:
    """Packets whose address_1 is a whole address, with its parts put in place, and ``resolved_fields``, what was filled.

    ``packets`` has address_1 to address_4, city, state, pin_code, pin_kind and pin_confidence; ``resolved`` the same
    address columns as read from address_1. Nothing changes where city, state and a trusted PIN are there, or address_1 has
    neither comma nor digit. address_2 to 4 are overwritten, city, state and PIN only filled; a PIN that only a pattern
    found, and that the address does not confirm, is cleared."""
    parts_ = ("address_1", "address_2", "address_3", "address_4", "city", "state", "pin_code")
    has = lambda c: F.coalesce(c, F.lit("")) != ""
    own = resolved.select(F.col(key).alias("__key"), *[F.col(c).alias(f"__{c}") for c in parts_])
    x = packets.join(own, F.col(key) == F.col("__key"), "left")
    solid = has(F.col("pin_code")) & ~((F.coalesce("pin_kind", F.lit("")) == "pattern_only") | (F.coalesce("pin_confidence", F.lit(0.0)) < 0.5))
    asked = has(F.col("address_1")) & ~(has(F.col("city")) & has(F.col("state")) & solid) & F.col("address_1").rlike(r"(?U),|\d")
    told = F.lit(False)
    for c in parts_[1:]:
        told = told | has(F.col(f"__{c}"))
    x = x.withColumn("__go", asked & told).withColumn("__solid", solid)
    new, filled = {}, []
    for c in parts_:
        fill = F.col("__go") & has(F.col(f"__{c}"))
        if c in ("city", "state", "pin_code"):
            fill = fill & ~has(F.col(c))
        new[c] = F.when(fill, F.col(f"__{c}")).otherwise(F.col(c))
        filled += [F.when(fill, c)] if c != "address_1" else []
    new["pin_code"] = F.when(F.col("__go") & has(F.col("pin_code")) & ~F.col("__solid") & ~has(F.col("__pin_code")), "").otherwise(new["pin_code"])
    x = x.withColumn("__filled", F.array_compact(F.array(*filled)))
    return x.select(*[new[c].alias(c) if c in new else F.col(c) for c in packets.columns], F.col("__filled").alias("resolved_fields"))
