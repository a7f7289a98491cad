"""Document types by keyword profiles, and the onboarding form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import clean_label, strip
from ledgerloom.operators.alignment import are_like_labels

FILENAME_WEIGHT, CONTENT_WEIGHT, LEAST_SCORE, FIRST_PAGES = 1.0, 2.0, 1.0, 3


def classify(docs: DataFrame, profiles: dict[str, tuple[tuple[str, ...], tuple[str, ...]]]) -> DataFrame:
    """Adds doc_type and type_score. ``docs`` has name and text (of the first pages); a profile has name and content
    keywords. The first profile with the highest score wins; below LEAST_SCORE it is other. No join: profiles are few."""
    name, text = F.lower(F.coalesce("name", F.lit(""))), F.lower(F.coalesce("text", F.lit("")))

    def hits(x: Column, words: tuple[str, ...]) -> Column:
        out = F.lit(0.0)
        for w in words:
            out = out + F.contains(x, F.lit(w.lower())).cast("double")
        return out

    scores = F.array(*[
        F.struct((hits(name, n) * FILENAME_WEIGHT + hits(text, c) * CONTENT_WEIGHT).alias("score"), F.lit(-i).alias("turn"), F.lit(p).alias("profile"))
        for i, (p, (n, c)) in enumerate(profiles.items())
    ])
    best = docs.withColumn("__best", F.array_max(scores))
    ok = F.col("__best.score") >= LEAST_SCORE
    return best.select(*docs.columns, F.when(ok, F.col("__best.profile")).otherwise("other").alias("doc_type"), F.when(ok, F.col("__best.score")).otherwise(0.0).alias("type_score"))


def first_pages(pages: DataFrame) -> DataFrame:
    """(doc_id, text) of the first pages; the page filter reaches the scan."""
    own = pages.where(F.col("page") <= FIRST_PAGES).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "text"))).alias("p"))
    return own.select("doc_id", F.array_join(F.col("p")["text"], "\n").alias("text"))


def onboarding(packets: DataFrame, status: dict[str, Column]) -> DataFrame:
    """The customer form of wide packets: invalid identifiers blanked, PAN taken from the GSTIN where needed, address joined."""

    def valid(c: str) -> Column:
        return F.when(F.coalesce(status.get(c, F.lit("valid")), F.lit("not_validated")) != "invalid", F.coalesce(F.col(c), F.lit(""))).otherwise("")

    inner = F.substring(F.upper(valid("gst_number")), 3, 10)
    fallback = (valid("pan") == "") & inner.rlike(r"\A[A-Z]{5}[0-9]{4}[A-Z]\z")
    lines = [F.nullif(strip(F.coalesce(F.col(f"address_{i}"), F.lit(""))), F.lit("")) for i in range(1, 5) if f"address_{i}" in packets.columns]
    return packets.select(
        "packet_id", valid("gst_number").alias("gst_registration_number"), F.when(fallback, inner).otherwise(valid("pan")).alias("pan_number"), fallback.alias("pan_from_gstin"),
        valid("pin_code").alias("pin_code"), valid("ifsc").alias("ifsc"), F.array_join(F.array_compact(F.array(*lines)), ", ").alias("billing_address"),
    )


def band(score: Column) -> Column:
    return F.when(score >= 0.8, "good").when(score >= 0.6, "warn").otherwise("bad")


CAPTION_SUFFIX, LEAK_WORDS, LEAK_CHARS, LEAK_RATIO, LEAK_PART = r"(?i)\bif any\b\W*\z", 8, 8, 0.88, 0.90


def caption_leaks(values: Column, captions: list[str], lead_words: list[str], class_words: list[str]) -> Column:
    """For an array of values, which of them are a form's own caption: an "if any" ending, a class word, a caption's first word in a
    short value, close likeness to a known caption, or a piece of one (the shorter side like a window of the other)."""
    clean = F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: clean_label(F.coalesce(v, F.lit(""))))
    like = are_like_labels(clean, captions, LEAK_RATIO, LEAK_PART, LEAK_CHARS)

    def plain(value: Column, own: Column) -> Column:
        words = F.split(own, " ")
        lead = F.get(words, F.lit(0)).isin(*lead_words) & (F.size(words) <= LEAK_WORDS)
        return (own != "") & (value.rlike(CAPTION_SUFFIX) | own.isin(*class_words) | lead)

    return F.zip_with(F.zip_with(values, clean, lambda v, c: F.coalesce(plain(v, c), F.lit(False))), like, lambda a, b: a | F.coalesce(b, F.lit(False)))


def caption_leak(value: Column, captions: list[str], lead_words: list[str], class_words: list[str]) -> Column:
    """``caption_leaks`` of one value."""
    return F.get(caption_leaks(F.array(value), captions, lead_words, class_words), F.lit(0))


def best_text(value: Column, alternatives: Column, leaks: Callable[[Column], Column]) -> Column:
    """struct<value, replaced>: the first of the value and its alternatives that is no caption leak, else empty. ``leaks`` tells it of an array of values."""
    options = F.filter(F.concat(F.array(F.coalesce(value, F.lit(""))), F.coalesce(alternatives, F.array().cast("array<string>"))), lambda v: F.coalesce(v, F.lit("")) != "")
    good = F.filter(F.zip_with(F.transform(options, lambda v, i: F.struct(v.alias("v"), i.alias("i"))), leaks(options), lambda o, l: F.struct(o["v"].alias("v"), o["i"].alias("i"), l.alias("leak"))), lambda o: ~o["leak"])
    first = F.get(good, F.lit(0))
    return F.struct(F.coalesce(first["v"], F.lit("")).alias("value"), F.coalesce(first["i"] > 0, F.lit(False)).alias("replaced"))


def review_names(flags: DataFrame, names: dict[str, str], fields: list[str] | None = None) -> DataFrame:
    """(packet_id, needs_review): form names of flagged fields, each once, as first seen: by stage, then in the order of ``fields`` (by
    name without it); unmapped ones go."""
    known = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    own = flags.withColumn("name", F.try_element_at(known, F.col("field"))).where("name is not null")
    place = F.array_position(F.lit(fields), F.col("field")) if fields else F.lit(0)
    return own.groupBy("packet_id").agg(F.array_distinct(F.array_sort(F.collect_list(F.struct("stage", place.alias("place"), "name")))["name"]).alias("needs_review"))


def compare_rows(results: DataFrame, review: DataFrame) -> DataFrame:
    """Rows of the compare view: every field with its band and whether it needs review."""
    flagged = review.select("packet_id", "field").distinct().withColumn("needs_review", F.lit(True))
    return results.join(flagged, ["packet_id", "field"], "left").withColumn("needs_review", F.coalesce("needs_review", F.lit(False))).withColumn("band", band(F.col("confidence")))


def company_url(base: str, company: Column, entity: str) -> Column:
    """OData address of a company's entity set; quotes are doubled."""
    return F.concat(F.lit(f"{base.rstrip('/')}/Company('"), F.replace(company, F.lit("'"), F.lit("''")), F.lit(f"')/{entity}"))
