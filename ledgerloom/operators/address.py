"""One combined address string to premises, city, state and PIN.

Segments are exploded and joined to the lookup tables by key (state, city) or value (PIN), then collected again per
address; the choice between them is array work. The lookup tables are bounded dimensions (hundreds of names, some
twenty thousand PINs), so Spark broadcasts them by size; as larger ones they are shuffled by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import lookup_key
from ledgerloom.operators import segments as S
from ledgerloom.operators import wordbreak
from ledgerloom.operators.captions import fragment_tier

# Country words, and words that rule a segment out as a guessed city.
COUNTRY_WORDS = ("india", "bharat", "in", "ind")
NOT_CITY = COUNTRY_WORDS + (
    "near", "opp", "opposite", "behind", "beside", "above", "below", "road", "street", "lane", "marg", "nagar", "colony", "sector", "block", "floor", "plot",
    "no", "gala", "unit", "phase", "part",
)
PIN = r"(?<![0-9])([1-9][0-9]{5})(?![0-9])"


def segments(address: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(address, F.lit("")), "[,\r\n]"), lambda s: F.btrim(s, F.lit(" \t"))), lambda s: s != "")


def without_country(segs: Column) -> Column:
    """Country words at the end go: all after the last segment that is none."""
    kept = F.transform(segs, lambda s, i: F.when(~F.lower(s).isin(*COUNTRY_WORDS), i + 1).otherwise(0))
    return F.slice(segs, F.lit(1), F.coalesce(F.array_max(kept), F.lit(0)))


def same_place(a: Column, b: Column) -> Column:
    norm = lambda x: F.translate(F.lower(F.coalesce(x, F.lit(""))), " .", "")
    return norm(a) == norm(b)


def city_case(x: Column) -> Column:
    return F.when((x == F.upper(x)) | (x == F.lower(x)), F.initcap(F.lower(x))).otherwise(x)


MOST_CITY_WORDS = 3
CITY_REST = ("unknown", "locality", "village_po")


def city_prefixes(exploded: DataFrame, cities: DataFrame) -> DataFrame:
    """(id, peels array<struct<i, w>>): segments whose first ``w`` words, but not all, name a known city."""
    words = F.split("seg", r"\s+")
    heads = F.filter(
        F.transform(F.sequence(F.lit(1), F.lit(MOST_CITY_WORDS)), lambda w: F.struct(w.alias("w"), lookup_key(F.array_join(F.slice(words, F.lit(1), w), " ")).alias("key"))), lambda h: h["w"] < F.size(words)
    )
    own = exploded.where(F.col("seg").isNotNull()).select("id", "i", F.explode(heads).alias("h")).select("id", "i", "h.w", "h.key")
    return own.join(cities.select("key").distinct(), "key").groupBy("id").agg(F.collect_set(F.struct("i", "w")).alias("peels"))


def resolve(
    addresses: DataFrame, states: DataFrame, cities: DataFrame, pins: DataFrame | None = None, tiers: dict | None = None, priority: list[str] | None = None
) -> DataFrame:
    """(id, address) to (id, address_1, city, state, pin_code, confidence). ``states`` has (key, state), ``cities``
    (key), ``pins`` (pin, state, district); without PINs nothing is inferred from them. With a keyword table
    (``tiers`` and their ``priority``) a segment of premises or a street is never guessed to be the city, nor is a city peeled
    off the front of one. ``rest`` holds what address_1 joins."""
    base = addresses.select("id", without_country(segments(F.col("address"))).alias("raw"))
    hit = F.coalesce(F.array_min(F.transform("raw", lambda s, i: F.when(s.rlike(PIN), i))), F.lit(-1))
    pin = F.when(F.col("hit") >= 0, F.regexp_extract(F.get("raw", F.col("hit")), PIN, 1)).otherwise("")
    left = F.transform("raw", lambda s, i: F.when(i == F.col("hit"), F.btrim(F.regexp_replace(s, r"\A([\s\S]*?)" + PIN + r"([\s\S]*)\z", "$1 $3"), F.lit(" ,"))).otherwise(s))
    base = base.withColumn("hit", hit).withColumn("pin", pin).withColumn("segs", without_country(F.filter(left, lambda s: s != "")))
    if pins is not None:
        p = pins.select(F.col("pin").alias("p_pin"), F.col("state").alias("pin_state"), F.col("district").alias("pin_district"))
        base = base.join(p, base.pin == p.p_pin, "left")
    else:
        base = base.withColumn("pin_state", F.lit(None).cast("string")).withColumn("pin_district", F.lit(None).cast("string"))
    exploded = base.select("id", "segs", F.posexplode_outer("segs").alias("i", "seg"))
    keyed = exploded.withColumn("k1", lookup_key(F.col("seg"))).withColumn("k2", lookup_key(F.concat(F.col("seg"), F.coalesce(F.get("segs", F.col("i") + 1), F.lit("\x00none")))))
    one = states.select(F.col("key").alias("k1"), F.col("state").alias("state1"))
    two = states.select(F.col("key").alias("k2"), F.col("state").alias("state2"))
    known = cities.select(F.col("key").alias("k1"), F.lit(True).alias("city"))
    told = keyed.join(one, "k1", "left").join(two, "k2", "left").join(known, "k1", "left")
    last = F.col("i") + 1 < F.size("segs")
    found = told.groupBy("id").agg(
        F.max(F.when(F.col("state1").isNotNull(), F.struct("i", "state1"))).alias("s1"), F.max(F.when(last & F.col("state2").isNotNull(), F.struct("i", "state2"))).alias("s2"),
        F.collect_set(F.when(F.col("city"), F.col("i"))).alias("city_at"),
    )
    x = base.join(found, "id").join(city_prefixes(exploded, cities), "id", "left")
    x = x.withColumn("token_state", F.coalesce("s1.state1", "s2.state2")).withColumn("at", F.coalesce("s1.i", "s2.i", F.lit(-1)))
    x = x.withColumn("wide", F.when(F.col("s1").isNotNull(), 1).when(F.col("s2").isNotNull(), 2).otherwise(0)).withColumn("state", F.coalesce("token_state", "pin_state", F.lit("")))
    # What is left after the state, with the places that hold a known city.
    rest = F.filter(
        F.transform("segs", lambda s, i: F.struct(s.alias("s"), i.alias("i"), F.array_contains("city_at", i).alias("city"), (~((i >= F.col("at")) & (i < F.col("at") + F.col("wide")))).alias("keep"))), lambda t: t["keep"]
    )
    x = x.withColumn("rest", rest)
    district = F.nullif(F.col("pin_district"), F.lit(""))
    places = lambda ok: F.array_max(F.transform("rest", lambda t, i: F.when(ok(t), i)))
    named = F.coalesce(places(lambda t: t["city"] & ~(district.isNotNull() & same_place(t["s"], district))), places(lambda t: t["city"]))
    by_district = F.when(district.isNotNull(), places(lambda t: same_place(t["s"], district)))
    end = F.get("rest", F.size("rest") - 1)["s"]
    plain = ~F.lower(end).isin(*NOT_CITY) & ~end.rlike(r"\A[0-9]+\z") & ~F.arrays_overlap(F.split(F.lower(end), r"\s+"), F.array(*map(F.lit, NOT_CITY)))
    if tiers:
        plain = plain & fragment_tier(end, tiers, priority or list(tiers)).isin("unknown", "locality", "village_po")
    state_city = x.join(cities.select(F.col("key").alias("state_key")), lookup_key(F.col("state")) == F.col("state_key"), "left")
    x = state_city.withColumn("chosen", F.coalesce(named, by_district))
    # A known city at the front of a segment, the longest of the last segment that has one and goes on as a part of a city.
    tail = lambda s, w: F.array_join(F.slice(F.split(s, r"\s+"), w + 1, F.size(F.split(s, r"\s+"))), " ")
    part_of_city = lambda s: fragment_tier(s, tiers, priority or list(tiers)).isin(*CITY_REST) if tiers else F.lit(True)
    own = lambda t: F.filter(F.coalesce("peels", F.array().cast("array<struct<i:int,w:int>>")), lambda p: (p["i"] == t["i"]) & part_of_city(tail(t["s"], p["w"])))
    peels = F.transform("rest", lambda t, j: F.array_max(F.transform(own(t), lambda p: F.struct(j.alias("j"), p["w"].alias("w")))))
    x = x.withColumn("peel", F.when(F.col("chosen").isNull() & district.isNull(), F.array_max(peels)))
    peeled = F.get("rest", F.col("peel.j"))["s"]
    x = x.withColumn("peeled_city", F.array_join(F.slice(F.split(peeled, r"\s+"), F.lit(1), F.col("peel.w")), " ")).withColumn("peeled_rest", tail(peeled, F.col("peel.w")))
    state_is_city = (F.col("state") != "") & F.col("state_key").isNotNull() & F.col("peel").isNull()
    guess = F.col("chosen").isNull() & F.col("peel").isNull() & district.isNull() & ~state_is_city & ((F.col("state") != "") | (F.col("pin") != "")) & (F.size("rest") > 0) & plain
    x = x.withColumn("chosen", F.when(guess, F.size("rest") - 1).otherwise(F.col("chosen")))
    inferred = F.col("chosen").isNull() & F.col("peel").isNull() & (district.isNotNull() | state_is_city)
    token = F.get("rest", F.col("chosen"))["s"]
    city = F.when(F.col("chosen").isNotNull(), city_case(token)).when(F.col("peel").isNotNull(), city_case(F.col("peeled_city"))).when(district.isNotNull(), city_case(district)).when(state_is_city, city_case(F.col("state"))).otherwise("")
    kept = lambda t, i: F.when(F.coalesce(i == F.col("peel.j"), F.lit(False)), F.col("peeled_rest")).when(~F.coalesce(i == F.col("chosen"), F.lit(False)), t["s"])
    lines = F.filter(F.transform("rest", kept), lambda s: s.isNotNull())
    x = x.withColumn("city", city).withColumn("inferred", inferred).withColumn("lines", lines)
    # Segments at the end that only repeat the city or the district are labels, not premises.
    label = lambda s: same_place(s, F.col("city")) | F.coalesce(same_place(s, district) & district.isNotNull(), F.lit(False))
    upto = F.coalesce(F.array_max(F.transform("lines", lambda s, i: F.when(~label(s), i + 1))), F.lit(0))
    trimmed = F.when(F.col("chosen").isNotNull(), F.slice("lines", F.lit(1), upto)).otherwise(F.col("lines"))
    n = (F.col("pin") != "").cast("int") + (F.col("state") != "").cast("int") + (F.col("city") != "").cast("int")
    confidence = (
        F.when(F.col("token_state") != F.col("pin_state"), "low").when((n == 3) & ~F.col("inferred"), "high").when(n >= 2, "medium").otherwise("low")
    )
    return x.select(
        "id", F.btrim(F.array_join(trimmed, ", "), F.lit(" ,")).alias("address_1"), "city", "state", F.col("pin").alias("pin_code"), confidence.alias("confidence"), trimmed.alias("rest")
    )


CONFIDENCE = ("low", "medium", "high")


def resolve_lines(addresses: DataFrame, states: DataFrame, cities: DataFrame, pins: DataFrame | None, kw: S.Keywords) -> DataFrame:
    """(id, address) to (id, address_1 to address_4, city, state, pin_code, confidence): what the place leaves of an address, spaces
    put back, as up to four lines. The lines are array work in the row that resolves the place; their joined text is the single line's.
    The confidence is the lower of both."""
    tiers = {name: {"head": t.head, "tail": t.tail, "any": t.phrases} for name, t in kw.tiers.items()}
    x = resolve(addresses, states, cities, pins, tiers or None, kw.ranked)
    x = S.address_columns(S.lines(x.withColumn("segments", wordbreak.respaced_all(F.col("rest"), kw)), kw))
    rank = lambda c: F.array_position(F.array(*map(F.lit, CONFIDENCE)), F.col(c))
    worse = F.when((F.size("rest") > 0) & (rank("line_confidence") < rank("confidence")), F.col("line_confidence")).otherwise(F.col("confidence"))
    return x.select("id", *[f"address_{i}" for i in range(1, 5)], "city", "state", "pin_code", worse.alias("confidence"))
