"""From spans to one validated record per packet, as one plan over many packets.

A value beside a caption goes on over further spans and rows; captions of its own field at its beginning go. One without a
pattern that is wholly another field's value is marked as foreign and scores lower. After the choice of values a combined address is
taken apart and put in place, fields that follow from others are derived in the order of their dependencies, and the
record is validated, with the PIN directory where there is one. Eight reasons send a field to review.

Geometry is joined per page, choices are made per packet and field; every stage is a DataFrame, so
Spark plans the exchanges (page, then packet and field) and nothing is looped over on the driver. Caption hits, values beside captions,
candidates and chosen values are written to the shared folder, so that what reads them twice does not compute them again.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from graphlib import CycleError, TopologicalSorter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import NORMALISERS, canonicalise, clean_label, find_matches, full_match, normalise, website_of
from ledgerloom.operators import address, alignment, captions, fields, layout, segments, validate
from ledgerloom.sources.scratch import written

WEIGHTS = {"label": 0.45, "pattern": 0.30, "proximity": 0.15, "confidence": 0.10}


@dataclass(frozen=True)
class Field:
    """What is looked for: captions, the value's patterns, its normalisers, and where it is expected."""

    captions: tuple[str, ...]
    patterns: tuple[str, ...] = ()
    normalisers: tuple[str, ...] = ("strip", "collapse_spaces")
    expected: tuple[str, ...] = ()
    aliases: tuple[tuple[str, str], ...] = ()
    directions: tuple[str, ...] = ("right", "below")
    required: bool = False
    default: str | None = None
    text: bool = field(default=True)
    exclude: tuple[str, ...] = ()
    consistent: bool = True
    priority: int = 50
    derive: tuple[str, str] | None = None
    validators: tuple[str, ...] | None = None  # None: those that FIELD_RULES gives the field's name


#: What a field can be derived from another one by: the rule's expression of the source value.
DERIVATIONS = {"email_domain": website_of}
# The confidence of derived values, and the least of values that an address was resolved to.
DERIVED_CONFIDENCE, RESOLVED_CONFIDENCE = 0.40, 0.55


@dataclass(frozen=True)
class Places:
    """What addresses are resolved by: states (key, state), cities (key), the PIN directory (pin, state, district) and the key words of lines."""

    states: DataFrame
    cities: DataFrame
    pins: DataFrame | None = None
    keywords: segments.Keywords = segments.Keywords({})


def rules_of(dictionary: dict[str, Field]) -> dict[str, tuple[str, ...]]:
    """The validators of each field."""
    return {n: validate.FIELD_RULES.get(n, ()) if f.validators is None else f.validators for n, f in dictionary.items()}


def by_priority(dictionary: dict[str, Field]) -> list[str]:
    """The fields, those of high priority first, equal ones in the order of the dictionary."""
    return sorted(dictionary, key=lambda n: -dictionary[n].priority)


def derivation_order(dictionary: dict[str, Field]) -> list[str]:
    """The derived fields, each after what it is derived from. Unknown rules and fields and circles are refused."""
    for name, f in dictionary.items():
        if f.derive and f.derive[0] not in dictionary:
            raise ValueError(f"{name}: derived from unknown field {f.derive[0]}")
        if f.derive and f.derive[1] not in DERIVATIONS:
            raise ValueError(f"{name}: unknown derivation {f.derive[1]}")
    try:
        every = TopologicalSorter({n: [f.derive[0]] if f.derive else [] for n, f in dictionary.items()}).static_order()
        return [n for n in every if dictionary[n].derive]
    except CycleError as e:
        raise ValueError(f"{e.args[1][0]}: derived from itself by way of {e.args[1]}") from e


def check(dictionary: dict[str, Field]) -> None:
    """Refuses a dictionary that cannot work, naming the field."""
    for name, f in dictionary.items():
        if not f.captions and not f.patterns and not f.derive and f.default is None and name not in ADDRESS:
            raise ValueError(f"{name}: neither captions nor patterns")
        if bad := [op for op in f.normalisers if op not in NORMALISERS]:
            raise ValueError(f"{name}: unknown normalisers {bad}")
        if bad := [v for v in f.validators or () if v not in validate.RULES]:
            raise ValueError(f"{name}: undefined validators {bad}")
        if bad := set(f.directions) - {"right", "below", "left", "above"}:
            raise ValueError(f"{name}: unknown directions {sorted(bad)}")
    derivation_order(dictionary)
    if abs(sum(WEIGHTS.values()) - 1) > 1e-6:
        raise ValueError("weights must sum to 1")


def by_field(dictionary: dict[str, Field], of: object) -> Column:
    """CASE over the field column; ``of`` makes each field's expression."""
    out = F.lit(None)
    for name, f in reversed(dictionary.items()):
        out = F.when(F.col("field") == name, of(f)).otherwise(out)  # type: ignore[operator]
    return out


def derived(f: Field, raw: Column) -> Column:
    """struct<value, matched>: the first match in the raw or the normalised text, else the normalised text."""
    plain = normalise(raw, list(f.normalisers))
    if not f.patterns:
        return F.struct(canonicalise(plain, list(f.aliases)).alias("value"), F.lit(False).alias("matched"))
    first = F.coalesce(F.get(find_matches(raw, list(f.patterns)), F.lit(0)), F.get(find_matches(plain, list(f.patterns)), F.lit(0)), F.when(full_match(plain, list(f.patterns)), plain))
    value = normalise(first, list(f.normalisers))
    return F.struct(F.when(first.isNotNull(), value).otherwise(plain).alias("value"), first.isNotNull().alias("matched"))


def foreign(dictionary: dict[str, Field]) -> Column:
    """Whether a value of a field without patterns is wholly a value of another field's pattern."""
    value = F.coalesce(F.col("d.value"), F.lit(""))
    fits = F.lit(False)
    for f in dictionary.values():
        if f.patterns:
            fits = fits | full_match(value, list(f.patterns))
    free = [n for n, f in dictionary.items() if not f.patterns]
    return F.col("field").isin(*free) & fits


def candidates(spans: DataFrame, dictionary: dict[str, Field]) -> DataFrame:
    """All candidates of all fields. ``spans``: packet_id, doc_id and span_id (both unique in the packet), doc_type, page,
    text, confidence and the box."""
    known = {n: list(f.captions) for n, f in dictionary.items() if f.captions}
    shapes = {n: "|".join(f.patterns) for n, f in dictionary.items() if f.patterns}
    hits = written(captions.caption_hits(spans, known, shapes), "extract-hits")
    keep = ("packet_id", "doc_id", "doc_type", "page", "span_id")
    inline = hits.where("rest <> ''").select(*keep, "confidence", "field", "caption", "similarity", F.lit(1.0).alias("proximity"), F.lit("inline").alias("kind"), F.col("rest").alias("raw"), F.lit(False).alias("label_like"))
    whole = hits.where("rest = ''")
    units = spans.groupBy(*layout.PACKET_PAGE).agg(F.coalesce(F.percentile(F.when(F.col("y2") > F.col("y1"), F.col("y2") - F.col("y1")), 0.5), F.lit(1.0)).alias("usual"))
    marked = whole.select(*layout.PACKET_PAGE, "span_id", "x1", "y1", "x2", "y2").distinct().join(units, list(layout.PACKET_PAGE))
    marked = marked.withColumn("unit", F.when(F.col("y2") > F.col("y1"), F.col("y2") - F.col("y1")).otherwise(F.col("usual"))).drop("usual")
    near = layout.neighbours(marked, spans, 12.0, layout.PACKET_PAGE).select("packet_id", "a_span_id", "b_span_id", "direction", "distance_ratio", "same_line")
    asked = whole.select("packet_id", F.col("span_id").alias("a_span_id"), "field", "caption", "similarity")
    # The whole value that begins beside a caption: over the spans to its right and the rows below that go on with it.
    starts = near.select("packet_id", F.col("b_span_id").alias("span_id"), F.lit(True).alias("start")).distinct()
    captions_ = hits.select("packet_id", "span_id", F.lit(True).alias("label_like")).distinct()
    laid = spans.join(layout.lines(spans, layout.PACKET_PAGE).select("packet_id", "span_id", "line"), ["packet_id", "span_id"])
    laid = laid.join(starts, ["packet_id", "span_id"], "left").join(captions_, ["packet_id", "span_id"], "left").na.fill(False, ["start", "label_like"])
    values = layout.continued_values(laid, keys=layout.PACKET_PAGE).select("packet_id", "span_id", "value")
    values = spans.join(values, ["packet_id", "span_id"])
    beside = (
        asked.join(near, ["packet_id", "a_span_id"]).where(F.coalesce(by_field(dictionary, lambda f: F.col("direction").isin(*f.directions)), F.lit(False)))
        .join(values.withColumnRenamed("span_id", "b_span_id"), ["packet_id", "b_span_id"]).withColumnRenamed("b_span_id", "span_id")
        .select(*keep, "confidence", "field", "caption", "similarity", (1 - F.col("distance_ratio")).alias("proximity"), F.when(F.col("same_line"), "adjacent_same_line").otherwise("adjacent").alias("kind"),
                F.col("value").alias("raw"))
    )
    every = [c.lower() for cs in known.values() for c in cs]
    beside = beside.withColumn("label_like", alignment.is_label_like(clean_label(F.col("raw")), every)).withColumn("raw", captions.own_captions_removed(F.col("field"), F.col("raw"), known, shapes))
    beside = written(beside, "extract-beside")
    claimed = inline.select("packet_id", "field", "span_id").unionByName(beside.select("packet_id", "field", "span_id"))
    scanned = spans.select(*keep, "confidence", F.explode(F.array(*[
        F.struct(F.lit(n).alias("field"), find_matches(F.col("text"), list(f.patterns)).alias("found")) for n, f in dictionary.items() if f.patterns
    ])).alias("x")).select(*keep, "confidence", "x.field", F.explode("x.found").alias("raw"))
    loose = fields.pattern_only(scanned, claimed, ("packet_id", "field", "span_id")).select(*keep, "confidence", "field", F.lit(None).cast("string").alias("caption"), F.lit(0.0).alias("similarity"), F.lit(0.0).alias("proximity"), F.lit("pattern_only").alias("kind"), "raw", F.lit(False).alias("label_like"))
    pooled = inline.unionByName(beside).unionByName(loose)
    pooled = pooled.withColumn("d", by_field(dictionary, lambda f: derived(f, F.col("raw"))))
    refused = {n: f.exclude for n, f in dictionary.items() if f.exclude}
    for name, patterns in refused.items():
        pooled = pooled.where(~((F.col("field") == name) & F.col("d.value").rlike("|".join(f"(?:{p})" for p in patterns))))
    expected = by_field(dictionary, lambda f: F.col("doc_type").isin(*f.expected) if f.expected else F.lit(None).cast("boolean"))
    order = F.struct("doc_id", "page", "span_id", fields.of(fields.KIND_RANK, F.col("kind")).alias("k"), (-F.col("proximity")).alias("p"), "raw")
    return pooled.select(
        "packet_id", "doc_id", "doc_type", "page", "caption", "field", F.col("d.value").alias("value"), F.col("d.matched").alias("matched"), "kind", F.col("similarity").alias("label_similarity"), "proximity",
        F.col("confidence").alias("ocr_confidence"), by_field(dictionary, lambda f: F.lit(bool(f.patterns))).alias("has_pattern"), expected.alias("expected_doc"), "label_like",
        foreign(dictionary).alias("foreign"), by_field(dictionary, lambda f: F.lit(f.text and not f.patterns)).alias("is_text"), order.alias("cand_ord"),
    )


ADDRESS = ("address_1", "address_2", "address_3", "address_4", "city", "state", "pin_code")


def with_addresses(results: DataFrame, places: Places, names: list[str]) -> DataFrame:
    """``results`` with address_1 taken apart and put in place; ``resolved`` marks what that filled."""
    own = results.where(F.col("field").isin(*ADDRESS))
    pick = lambda f, c: F.max(F.when(F.col("field") == f, F.col(c)))
    wide = own.groupBy("packet_id").agg(*[pick(f, "value").alias(f) for f in ADDRESS], pick("pin_code", "kind").alias("pin_kind"), pick("pin_code", "confidence").alias("pin_confidence"))
    asked = wide.where(F.coalesce("address_1", F.lit("")) != "").select(F.col("packet_id").alias("id"), F.col("address_1").alias("address"))
    resolved = address.resolve_lines(asked, places.states, places.cities, places.pins, places.keywords).withColumnRenamed("id", "packet_id")
    filled = segments.back_fill(wide, resolved)
    rows = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("new"), F.array_contains("resolved_fields", f).alias("resolved")) for f in ADDRESS if f in names])
    told = filled.select("packet_id", F.explode(rows).alias("x")).select("packet_id", "x.*").withColumn("told", F.lit(True))
    out = results.join(told, ["packet_id", "field"], "left").withColumn("resolved", F.coalesce("resolved", F.lit(False)))
    better = F.greatest(F.coalesce("confidence", F.lit(0.0)), F.lit(RESOLVED_CONFIDENCE))
    return out.withColumn("value", F.when(F.col("told"), F.col("new")).otherwise(F.col("value"))).withColumn("confidence", F.when(F.col("resolved"), better).otherwise(F.col("confidence"))).drop("new", "told")


def with_derived(results: DataFrame, dictionary: dict[str, Field]) -> DataFrame:
    """``results`` with empty fields derived from others, sources first; ``derived`` marks them."""
    order = derivation_order(dictionary)
    if not order:
        return results.withColumn("derived", F.lit(False))
    needed = sorted({n for f in order for n in (f, dictionary[f].derive[0])})
    wide = fields.canonical(results.where(F.col("field").isin(*needed)), needed)
    new = []
    for f in order:
        source, rule = dictionary[f].derive
        made = F.nullif(DERIVATIONS[rule](F.col(source)), F.lit(""))
        wide = wide.withColumn(f"__{f}", F.when(F.col(f).isNull(), made)).withColumn(f, F.coalesce(f, f"__{f}"))
        new.append(F.when(F.col(f"__{f}").isNotNull(), F.struct(F.lit(f).alias("field"), F.col(f"__{f}").alias("made"))))
    made = wide.select("packet_id", F.explode(F.array_compact(F.array(*new))).alias("x")).select("packet_id", "x.field", "x.made")
    out = results.join(made, ["packet_id", "field"], "left").withColumn("derived", F.col("made").isNotNull())
    return out.withColumn("value", F.coalesce("made", "value")).withColumn("confidence", F.when(F.col("derived"), F.lit(DERIVED_CONFIDENCE)).otherwise(F.col("confidence"))).drop("made")


def extract(spans: DataFrame, dictionary: dict[str, Field], places: Places | None = None) -> dict[str, DataFrame]:
    """results (one row per packet and field), flags, agreement, findings and the wide canonical record."""
    check(dictionary)
    names = list(dictionary)
    pool = fields.scored(candidates(spans, dictionary), WEIGHTS)
    rules = rules_of(dictionary)
    plain = {n: [validate.RULES[r] for r in rules[n] if not validate.RULES[r].derived] for n in names}

    def status(n: str) -> Column:
        out = F.lit("valid") if plain[n] else F.lit(None).cast("string")
        for rule in sorted(plain[n], key=lambda r: r.severity == "error"):
            out = F.when(~validate.passes(rule, F.col("value"), {}), "invalid" if rule.severity == "error" else "warning").otherwise(out)
        return out

    judged = F.coalesce(*[F.when(F.col("field") == n, status(n)) for n in names])
    pool = written(fields.biased(fields.without_junk(pool).withColumn("status", judged)), "extract-pool")
    best = fields.chosen(pool, also=("doc_id", "page", "caption")).withColumnRenamed("score", "confidence")
    every = spans.select("packet_id").distinct().select("packet_id", F.explode(F.array(*map(F.lit, names))).alias("field"))
    results = every.join(best, ["packet_id", "field"], "left")
    results = with_addresses(results, places, names) if places and "address_1" in names else results.withColumn("resolved", F.lit(False))
    results = written(with_derived(results, dictionary), "extract-values")
    wide = fields.canonical(results, names)
    if places and places.pins is not None and {"pin_code", "state"} <= set(names):
        wide = validate.with_pin_state(wide, places.pins, places.states)
    findings = validate.findings(wide, names, rules=rules)
    results = results.join(validate.statuses(findings), ["packet_id", "field"], "left").withColumn("status", validate.or_missing(F.col("status"), F.col("value")))
    results = fields.with_defaults(results, {n: f.default for n, f in dictionary.items() if f.default} or {"": ""})
    compared = [n for n, f in dictionary.items() if f.consistent]
    agreement = validate.consistency(pool.where((F.col("score") >= fields.LEAST_ACCEPTED) & F.col("field").isin(*compared)))
    flags = fields.review_flags(results, tuple(n for n, f in dictionary.items() if f.required), agreement, findings)
    return {"results": results, "flags": flags, "agreement": agreement, "findings": findings, "canonical": fields.canonical(results, names)}
