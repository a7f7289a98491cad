"""From candidate values to one record per packet: scoring, bias, choice, defaults, flags, pivot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.text import collapse_spaces

# Fixed values of the scoring.
KIND_BONUS = {"inline": 0.30, "adjacent_same_line": 0.18, "adjacent": 0.0, "pattern_only": -0.10}
KIND_RANK = {"inline": 0, "adjacent_same_line": 1, "adjacent": 1, "pattern_only": 2}
PRECEDENCE = ("gst_certificate", "udyam_certificate", "cancelled_cheque", "other")
LABEL_LIKE, FOREIGN, SHORT, LEAST_TEXT = 0.55, 0.40, 0.5, 3
TIE_BAND, LEAST_ACCEPTED = 0.05, 0.60
JUNK_NAMES = (
    "micro", "small", "medium", "micro enterprise", "small enterprise", "medium enterprise", "micro enterprises", "small enterprises", "medium enterprises",
)


def of(table: dict, key: Column) -> Column:
    out = F.lit(None)
    for k, v in table.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def least_similarity(label: Column, base: float = 0.82) -> Column:
    """Short captions need a closer match."""
    n = F.length(label)
    return F.when(n <= 4, F.greatest(F.lit(base), F.lit(0.97))).when(n <= 6, F.greatest(F.lit(base), F.lit(0.92))).otherwise(F.lit(base))


def scored(candidates: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Adds ``score`` and ``notes``. Needs: label_similarity, proximity, ocr_confidence, has_pattern, matched, kind,
    expected_doc (null: no expectation), label_like, foreign, is_text, value. Empty and unmatched patterned values go."""
    matched, patterned = F.col("matched"), F.col("has_pattern")
    pattern = F.when(patterned & matched, 1.0).when(~patterned, 0.5).otherwise(0.0)
    parts = {"label": F.col("label_similarity"), "proximity": F.col("proximity"), "pattern": pattern, "confidence": F.col("ocr_confidence")}
    s = F.lit(0.0)
    for name, w in weights.items():
        s = s + F.lit(w) * parts[name]
    s = s + of(KIND_BONUS, F.col("kind"))
    s = s + F.when(F.col("expected_doc").isNull(), 0.0).when(F.col("expected_doc"), 0.05).otherwise(-0.05)
    like = F.col("label_like") & (F.col("kind") != "inline") & ~matched
    s = F.when(like, s * LABEL_LIKE).otherwise(s)
    s = F.when(F.col("foreign"), s * FOREIGN).otherwise(s)
    short = F.col("is_text") & (F.length("value") < LEAST_TEXT)
    s = F.when(short, s * SHORT).otherwise(s)
    notes = F.array_compact(F.array(F.when(like, "label_like"), F.when(F.col("foreign"), "foreign_pattern"), F.when(short, "too_short")))
    kept = candidates.where((F.coalesce("value", F.lit("")) != "") & (~patterned | matched))
    return kept.withColumn("score", F.least(F.lit(1.0), F.greatest(F.lit(0.0), s))).withColumn("notes", notes)


def biased(candidates: DataFrame) -> DataFrame:
    """Lets the non-derived findings of a candidate move its score: ``status`` is invalid, warning, valid or null."""
    s = F.col("score")
    moved = F.when(F.col("status") == "invalid", s * 0.35).when(F.col("status") == "warning", s * 0.75)
    return candidates.withColumn("score", moved.when(F.col("status") == "valid", F.least(F.lit(1.0), s + 0.10)).otherwise(s))


def without_junk(candidates: DataFrame, keys: tuple[str, ...] = ("packet_id", "field")) -> DataFrame:
    """Drops class words taken for names, but only where another candidate remains."""
    junk = (F.col("field") == "vendor_name") & F.lower(collapse_spaces(F.coalesce("value", F.lit("")))).isin(*JUNK_NAMES)
    good = F.sum((~junk).cast("int")).over(Window.partitionBy(*keys))
    return candidates.withColumn("good", good).where(~junk | (F.col("good") == 0)).drop("good")


def chosen(candidates: DataFrame, keys: tuple[str, ...] = ("packet_id", "field"), also: tuple[str, ...] = ()) -> DataFrame:
    """One value per field, with the columns named by ``also`` of the same candidate, and up to five alternatives.

    Only expected document types count where any is there; within TIE_BAND of the best of these the
    document type's precedence decides, then the kind, then the score. Alternatives come from the first six
    of the list before that restriction. All windows share one partitioning: one shuffle."""
    p = Window.partitionBy(*keys)
    ranked = F.row_number().over(p.orderBy(F.desc("score"), "cand_ord"))
    any_expected = F.max(F.coalesce(F.col("expected_doc"), F.lit(False)).cast("int")).over(p)
    order = F.coalesce(F.array_position(F.array(*map(F.lit, PRECEDENCE)), F.col("doc_type")), F.lit(0))
    order = F.when(order == 0, len(PRECEDENCE) + 1).otherwise(order)
    pool = candidates.withColumn("rank", ranked).withColumn("allowed", (any_expected == 0) | F.coalesce(F.col("expected_doc"), F.lit(False)))
    pool = pool.withColumn("best", F.max(F.when(F.col("allowed"), F.col("score"))).over(p))
    in_band = F.col("allowed") & (F.col("best") - F.col("score") <= TIE_BAND)
    pool = pool.withColumn("turn", F.row_number().over(p.orderBy((~in_band).cast("int"), order, of(KIND_RANK, F.col("kind")), F.desc("score"), "cand_ord")))
    others = F.slice(F.array_sort(F.collect_list(F.when((F.col("rank") <= 6) & (F.col("turn") > 1), F.struct("rank", "value")))), 1, 5)
    win = lambda c: F.max(F.when(F.col("turn") == 1, F.col(c)))
    return pool.groupBy(*keys).agg(
        win("value").alias("value"), win("score").alias("score"), win("doc_type").alias("doc_type"), win("kind").alias("kind"), others["value"].alias("alternatives"),
        *[win(c).alias(c) for c in also],
    )


def with_defaults(results: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """Missing values take the field's default with confidence 1; invalid ones take it and keep their confidence."""
    default = of(defaults, F.col("field")).cast("string")
    missing = (F.coalesce("value", F.lit("")) == "") & default.isNotNull()
    replaced = (F.col("status") == "invalid") & default.isNotNull() & ~missing
    return results.select(
        *[c for c in results.columns if c not in ("value", "status", "confidence", "defaulted")],
        F.when(missing | replaced, default).otherwise(F.col("value")).alias("value"), F.when(missing | replaced, "valid").otherwise(F.col("status")).alias("status"),
        F.when(missing, 1.0).otherwise(F.col("confidence")).alias("confidence"), (missing | replaced).alias("defaulted"),
    )


def review_flags(results: DataFrame, required: tuple[str, ...], agreement: DataFrame | None = None, findings: DataFrame | None = None) -> DataFrame:
    """(packet, field, reason, stage) in the order in which the stages raise them; values that an address was resolved to come
    first, a PIN of another state (from ``findings``) last."""
    empty = F.coalesce("value", F.lit("")) == ""
    resolved = F.coalesce(F.col("resolved"), F.lit(False)) if "resolved" in results.columns else F.lit(False)
    checks = F.array_compact(F.array(
        F.when(resolved & ~empty, F.struct(F.lit(0).alias("stage"), F.lit("value_resolved_from_combined_address").alias("reason"))),
        F.when(F.coalesce(F.col("derived"), F.lit(False)) & ~empty, F.struct(F.lit(1).alias("stage"), F.lit("value_derived_not_printed").alias("reason"))),
        F.when(F.col("field").isin(*required) & empty, F.struct(F.lit(2).alias("stage"), F.lit("missing_required_field").alias("reason"))),
        F.when((F.col("status") == "invalid") & ~empty, F.struct(F.lit(3).alias("stage"), F.lit("failed_validation").alias("reason"))),
        F.when((F.col("status") == "warning") & ~empty, F.struct(F.lit(3).alias("stage"), F.lit("validation_warning").alias("reason"))),
        F.when(~empty & ~F.coalesce(F.col("defaulted"), F.lit(False)) & (F.col("confidence") < LEAST_ACCEPTED), F.struct(F.lit(4).alias("stage"), F.lit("low_confidence").alias("reason"))),
    ))
    flags = results.select("packet_id", "field", F.explode(checks).alias("f")).select("packet_id", "field", "f.reason", "f.stage")
    if agreement is not None:
        flags = flags.unionByName(agreement.where("agreement = 'inconsistent'").select("packet_id", "field", F.lit("cross_document_mismatch").alias("reason"), F.lit(5).alias("stage")))
    if findings is not None:
        other = findings.where((F.col("validator") == "pin_matches_state") & ~F.col("ok")).select("packet_id")
        flags = flags.unionByName(other.distinct().select("packet_id", F.lit("pin_code").alias("field"), F.lit("pin_state_mismatch").alias("reason"), F.lit(6).alias("stage")))
    return flags


def canonical(results: DataFrame, fields: list[str]) -> DataFrame:
    """One wide row per packet; empty values are null."""
    return results.groupBy("packet_id").pivot("field", fields).agg(F.first(F.nullif("value", F.lit(""))))


def packet_summary(results: DataFrame) -> DataFrame:
    filled = F.count_if(F.coalesce("value", F.lit("")) != "")
    return results.groupBy("packet_id").agg(
        F.count("*").alias("total"), filled.alias("filled"), (F.count("*") - filled).alias("empty"), F.count_if(F.col("status") == "valid").alias("valid"),
        F.bround(100.0 * filled / F.count("*"), 0).alias("fill_rate"),
    )


def pattern_only(spans: DataFrame, labelled: DataFrame, keys: tuple[str, ...] = ("field", "span_id")) -> DataFrame:
    """Spans that no caption of the field has claimed: left for the pattern scan."""
    return spans.join(labelled.select(*keys).distinct(), list(keys), "left_anti")
