"""Validation of field values: findings per rule, one status per field, agreement across documents."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.text import full_match, lookup_key, similarity, strip

# The rules and the fields that they belong to.
STATES = (
    "Andhra Pradesh", "Arunachal Pradesh", "Assam", "Bihar", "Chhattisgarh", "Goa", "Gujarat", "Haryana", "Himachal Pradesh", "Jharkhand", "Karnataka",
    "Kerala", "Madhya Pradesh", "Maharashtra", "Manipur", "Meghalaya", "Mizoram", "Nagaland", "Odisha", "Punjab", "Rajasthan", "Sikkim", "Tamil Nadu",
    "Telangana", "Tripura", "Uttar Pradesh", "Uttarakhand", "West Bengal", "Andaman and Nicobar Islands", "Chandigarh",
    "Dadra and Nagar Haveli and Daman and Diu", "Delhi", "Jammu and Kashmir", "Ladakh", "Lakshadweep", "Puducherry",
)
COUNTRIES = (
    "India", "Bharat", "United States", "United Kingdom", "Singapore", "United Arab Emirates", "Germany", "China", "Japan", "Australia", "Canada", "France",
    "Netherlands", "Switzerland",
)
STATE_CODES = tuple(f"{i:02d}" for i in range(1, 39))


@dataclass(frozen=True)
class Rule:
    """One validator. ``kind`` is regex, length, enum, non_empty, substring_equals, state_code or pin_state."""

    name: str
    kind: str
    severity: str = "error"
    pattern: str = ""
    values: tuple[str, ...] = ()
    least: int = 0
    most: int = 0
    source: str = ""
    target: str = ""
    start: int = 0
    end: int = 0
    derived: bool = field(default=False)


RULES = {
    r.name: r
    for r in (
        Rule("non_empty", "non_empty"),
        Rule("gstin_format", "regex", pattern="[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][1-9A-Z]Z[0-9A-Z]"),
        Rule("gstin_contains_pan", "substring_equals", source="gst_number", target="pan", start=2, end=12, derived=True),
        Rule("gstin_state_code", "state_code", "warning", source="gst_number", derived=True),
        Rule("pan_format", "regex", pattern="[A-Z]{5}[0-9]{4}[A-Z]"),
        Rule("tan_format", "regex", pattern="[A-Z]{4}[0-9]{5}[A-Z]"),
        Rule("udyam_format", "regex", pattern="UDYAM-[A-Z]{2}-[0-9]{2}-[0-9]{7}"),
        Rule("esic_format", "regex", "warning", pattern="[0-9]{17}"),
        Rule("pin_format", "regex", pattern="[1-9][0-9]{5}"),
        Rule("pin_matches_state", "pin_state", "warning", source="pin_code", derived=True),
        Rule("indian_state", "enum", "warning", values=STATES),
        Rule("country_name", "enum", values=COUNTRIES),
        Rule("email_format", "regex", pattern=r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"),
        Rule("indian_phone", "regex", pattern="[6-9][0-9]{9}"),
        Rule("ifsc_format", "regex", pattern="[A-Z]{4}0[A-Z0-9]{6}"),
        Rule("account_number_format", "length", pattern="[0-9]*", least=9, most=18),
    )
}
FIELD_RULES = {
    "vendor_name": ("non_empty",), "gst_number": ("gstin_format", "gstin_contains_pan", "gstin_state_code"), "pan": ("pan_format",), "tan": ("tan_format",),
    "udyam_number": ("udyam_format",), "esic_number": ("esic_format",), "state": ("indian_state", "pin_matches_state"), "country": ("country_name",),
    "pin_code": ("pin_format",), "telephone": ("indian_phone",), "email": ("email_format",), "ifsc": ("ifsc_format",),
    "account_number": ("account_number_format",),
}


def passes(rule: Rule, value: Column, row: dict[str, Column]) -> Column:
    """Whether a value passes; null where the rule cannot judge. ``row`` has the packet's other fields."""
    text = F.coalesce(value, F.lit(""))
    if rule.kind == "regex":
        return full_match(text, [rule.pattern])
    if rule.kind == "length":
        return full_match(text, [rule.pattern]) & F.length(text).between(rule.least, rule.most)
    if rule.kind == "enum":
        return F.lower(strip(text)).isin(*[v.lower() for v in rule.values])
    if rule.kind == "non_empty":
        return strip(text) != ""
    source = F.nullif(F.coalesce(row[rule.source], F.lit("")), F.lit(""))
    if rule.kind == "substring_equals":
        target = F.nullif(F.coalesce(row[rule.target], F.lit("")), F.lit(""))
        return F.upper(F.substring(source, rule.start + 1, rule.end - rule.start)) == F.upper(target)
    if rule.kind == "state_code":
        return F.substring(source, 1, 2).isin(*STATE_CODES)
    # Both sides in their canonical spelling, where one is known; without a PIN of six digits in the directory no judgement.
    want = F.nullif(F.coalesce(row["pin_state"], F.lit("")), F.lit(""))
    got = F.coalesce(row["canonical_state"], strip(text))
    return F.when((strip(text) != "") & full_match(strip(source), ["[0-9]{6}"]), F.lower(want) == F.lower(got))


def findings(packets: DataFrame, fields: list[str], key: str = "packet_id", rules: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(packet, field, validator, severity, ok) of a wide table; a value-less field has no findings. ``rules`` names each field's
    validators (``FIELD_RULES`` if not given).

    One projection and one explode; ``pin_state`` and ``canonical_state`` come from ``with_pin_state``, if joined."""
    rules = FIELD_RULES if rules is None else rules
    row = {c: F.col(c) for c in packets.columns}
    row.setdefault("pin_state", F.lit(None).cast("string"))
    row.setdefault("canonical_state", F.lit(None).cast("string"))
    judged = F.array(*[
        F.struct(F.lit(f).alias("field"), F.lit(name).alias("validator"), F.lit(RULES[name].severity).alias("severity"), passes(RULES[name], F.col(f), row).alias("ok"))
        for f in fields
        for name in rules.get(f, ())
        if not RULES[name].derived or {RULES[name].source, RULES[name].target or RULES[name].source} <= set(row)
    ]).cast("array<struct<field:string,validator:string,severity:string,ok:boolean>>")
    empty = {f: F.coalesce(F.col(f), F.lit("")) == "" for f in fields}
    has_value = F.coalesce(*[F.when(F.col("x.field") == f, ~empty[f]) for f in fields])
    return packets.select(key, *fields, F.explode(judged).alias("x")).where(has_value & F.col("x.ok").isNotNull()).select(key, "x.*")


def with_pin_state(packets: DataFrame, pins: DataFrame, states: DataFrame) -> DataFrame:
    """Adds pin_state, what the PIN directory (pin, state, ..) names for pin_code, and canonical_state, the spelling that
    the table of states and aliases (key, state) gives for state; both canonical where known, null where not."""
    spelling = states.groupBy("key").agg(F.min("state").alias("spelling"))
    named = pins.groupBy(F.col("pin").alias("__pin")).agg(F.min("state").alias("named"))
    named = named.join(spelling, lookup_key(F.col("named")) == F.col("key"), "left").select("__pin", F.coalesce("spelling", "named").alias("pin_state"))
    out = packets.join(named, strip(F.col("pin_code")) == F.col("__pin"), "left").drop("__pin")
    own = spelling.select(F.col("key").alias("__key"), F.col("spelling").alias("canonical_state"))
    return out.join(own, lookup_key(F.col("state")) == F.col("__key"), "left").drop("__key")


def or_missing(status: Column, value: Column) -> Column:
    """A field without a value is missing; one that no rule judges is not validated."""
    return F.when(F.coalesce(value, F.lit("")) == "", "missing").otherwise(F.coalesce(status, F.lit("not_validated")))


def statuses(found: DataFrame, key: str = "packet_id") -> DataFrame:
    """One status per field: invalid if an error failed, warning if a warning did, else valid."""
    failed = lambda s: F.max((~F.col("ok") & (F.col("severity") == s)).cast("int"))
    return found.groupBy(key, "field").agg(
        F.when(failed("error") == 1, "invalid").when(failed("warning") == 1, "warning").otherwise("valid").alias("status"),
        F.sum((~F.col("ok")).cast("long")).alias("n_failed"),
    )


def consistency(values: DataFrame, threshold: float = 85.0, keys: tuple[str, ...] = ("packet_id", "field")) -> DataFrame:
    """Agreement of each field across documents: the best value per document, then all document pairs.

    ``values`` has keys, doc_id, value, score and cand_ord. Pairs stay inside one packet's field, whose
    documents are few; lengths rule most unlike pairs out before they are compared."""
    w = Window.partitionBy(*keys, "doc_id").orderBy((F.coalesce("value", F.lit("")) == "").cast("int"), F.desc("score"), "cand_ord")
    best = values.withColumn("rn", F.row_number().over(w)).where("rn = 1").select(*keys, "doc_id", F.nullif(F.lower("value"), F.lit("")).alias("value"))
    docs = best.groupBy(*keys).agg(F.array_sort(F.collect_list(F.when(F.col("value").isNotNull(), F.struct("doc_id", "value")))).alias("d"))
    pairs = F.flatten(F.transform("d", lambda a, i: F.transform(F.slice("d", i + 2, F.size("d")), lambda b: F.struct(a["value"].alias("a"), b["value"].alias("b")))))
    unlike = F.size(F.filter(pairs, lambda p: similarity(p["a"], p["b"], threshold) < threshold))
    return docs.select(
        *keys, F.size("d").cast("long").alias("n_docs"), unlike.cast("long").alias("n_conflicts"),
        F.when(F.size("d") == 0, "not_checked").when(F.size("d") == 1, "single_source").when(unlike > 0, "inconsistent").otherwise("consistent").alias("agreement"),
    )
