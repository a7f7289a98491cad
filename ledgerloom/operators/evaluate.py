"""Read-back verification of cells and scoring against ground truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import compare_cell, compare_truth

# Identifiers that must agree exactly, and the fields of the address block.
EXACT_FIELDS = ("gst_number", "pan", "tan", "udyam_number", "esic_number", "pin_code", "telephone", "ifsc", "account_number")
ADDRESS_FIELDS = ("address_1", "address_2", "address_3", "address_4", "city", "state", "pin_code")
OUTCOMES = ("wrong", "hallucinated", "missed", "correct", "correctly_absent")


MOST_CELLS = 10_000


def fill_cells(results: DataFrame, cell_map: DataFrame) -> DataFrame:
    """(packet, sheet, cell, value): what a filled template holds, in long form; empty values take the blank value. A map of up to
    ``MOST_CELLS`` cells, as counted, goes to every task, since fields are too few a key to shuffle by."""
    few = cell_map.limit(MOST_CELLS + 1).count() <= MOST_CELLS
    return results.join(F.broadcast(cell_map) if few else cell_map, "field").select(
        "packet_id", "sheet", "cell", "field", F.coalesce(F.nullif("value", F.lit("")), "blank_value").alias("value")
    )


def cell_map(rows: DataFrame) -> DataFrame:
    """(field, sheet, cell, blank_value) with cells in upper case; a field without a cell and two fields in one cell are
    refused by name. A bounded table of a template's fields."""
    own = rows.withColumn("cell", F.upper(F.btrim("cell")))
    if bad := own.where(F.coalesce("cell", F.lit("")) == "").select("field").head():
        raise ValueError(f"{bad['field']}: no cell")
    if bad := own.groupBy("sheet", "cell").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("field")).alias("f")).where("n > 1").head():
        raise ValueError(f"{', '.join(bad['f'])}: all in cell {bad['cell']}")
    return own


def fill_sheets(results: DataFrame, cells: DataFrame, sheets: list[str], available: list[str]) -> DataFrame:
    """What a template with several chosen sheets holds: a cell with a sheet of its own is filled there, one without in
    every chosen sheet (the first available, if none is chosen). An unknown sheet is refused."""
    chosen = sheets or available[:1]
    named = [r["sheet"] for r in cells.select("sheet").distinct().where("sheet IS NOT NULL").collect()]
    if unknown := sorted({*chosen, *named} - set(available)):
        raise ValueError(f"sheets {unknown} not among {available}")
    every = cells.withColumn("sheet", F.explode(F.when(F.col("sheet").isNotNull(), F.array("sheet")).otherwise(F.array(*map(F.lit, chosen)))))
    return fill_cells(results, every)


def checked_truth(truth: DataFrame, verified: bool, allow_unverified: bool = False) -> DataFrame:
    """Truth rows (field, expected, absent): refused if nobody has verified them, or if a field has both a value and the
    mark that it is absent, or neither."""
    if not verified and not allow_unverified:
        raise ValueError("the truth is not verified")
    absent = F.coalesce("absent", F.lit(False))
    if bad := truth.where(absent == F.col("expected").isNotNull()).select("field", absent.alias("absent")).head():
        raise ValueError(f"{bad['field']}: " + ("absent, but has a value" if bad["absent"] else "neither a value nor absent"))
    return truth


def by_outcome(outcomes: DataFrame) -> DataFrame:
    """Report order: the worst outcomes first, then fields."""
    return outcomes.orderBy(F.array_position(F.array(*map(F.lit, OUTCOMES)), F.col("outcome")), "field")


def address_text(x: Column) -> Column:
    """Address text as it is compared: spaces around commas, runs of spaces and outer commas do not count, nor does case."""
    spaced = F.regexp_replace(F.replace(F.coalesce(x, F.lit("")), F.lit(","), F.lit(" , ")), r"(?U)\s+", " ")
    return F.lower(F.btrim(spaced, F.lit(" ,")))


def address_outcomes(rows: DataFrame) -> DataFrame:
    """Adds ``outcome`` to rows of expected and extracted address text; an expected text that is empty means absent."""
    want, got = F.btrim(F.coalesce("expected", F.lit(""))), F.btrim(F.coalesce("extracted", F.lit("")))
    none, nothing = want == "", got == ""
    return rows.withColumn(
        "outcome",
        F.when(none & nothing, "correctly_absent").when(none, "hallucinated").when(nothing, "missed").when(address_text(got) == address_text(want), "correct").otherwise("wrong"),
    )


def address_tally(outcomes: DataFrame) -> DataFrame:
    """Cases by the resolver's confidence: how many, how many without a fault, and how many of those miscalibrated (right
    though low with something to find, or wrong though high). ``outcomes``: id, field, expected, confidence, outcome."""
    bad = F.count_if(F.col("outcome").isin("wrong", "missed", "hallucinated"))
    found = F.count_if(F.col("field").isin("city", "state", "pin_code") & (F.btrim(F.coalesce("expected", F.lit(""))) != ""))
    cases = outcomes.groupBy("id", "confidence").agg(bad.alias("bad"), found.alias("found"))
    off = ((F.col("bad") == 0) & (F.col("confidence") == "low") & (F.col("found") > 0)) | ((F.col("bad") > 0) & (F.col("confidence") == "high"))
    return cases.groupBy("confidence").agg(F.count("*").alias("n"), F.count_if(F.col("bad") == 0).alias("right"), F.count_if(off).alias("miscalibrated"))


def verify_cells(expected: DataFrame, cells: DataFrame, keys: tuple[str, ...] = ("packet_id", "sheet", "cell")) -> DataFrame:
    """Every expected cell with what was read back, and PASS or FAIL."""
    read = cells.select(*keys, F.col("value").alias("actual"))
    return expected.join(read, list(keys), "left").withColumn("status", F.when(compare_cell(F.col("value")) == compare_cell(F.col("actual")), "PASS").otherwise("FAIL"))


def verification_summary(verified: DataFrame, by: str = "packet_id") -> DataFrame:
    ok = F.count_if(F.col("status") == "PASS")
    return verified.groupBy(by).agg(F.count("*").alias("total"), ok.alias("passed"), (F.count("*") - ok).alias("failed"), F.round(100.0 * ok / F.count("*"), 6).alias("success_rate"))


def outcome(absent: Column, expected: Column, extracted: Column, field: Column) -> Column:
    has = F.btrim(F.coalesce(extracted, F.lit(""))) != ""
    exact = field.isin(*EXACT_FIELDS)
    return (
        F.when(absent & has, "hallucinated").when(absent, "correctly_absent").when(~has, "missed")
        .when(compare_truth(expected, exact) == compare_truth(extracted, exact), "correct").otherwise("wrong")
    )


def evaluate(truth: DataFrame, extracted: DataFrame) -> DataFrame:
    """Truth (packet, field, expected, absent) with extracted (packet, field, value): one outcome per true field."""
    joined = truth.join(extracted.select("packet_id", "field", F.col("value").alias("extracted")), ["packet_id", "field"], "left")
    return joined.withColumn("outcome", outcome(F.col("absent"), F.col("expected"), F.col("extracted"), F.col("field")))


def outcome_summary(outcomes: DataFrame, by: str) -> DataFrame:
    """Counts, recall, precision and accuracy in percent; null where nothing is to be counted."""
    n = {o: F.count_if(F.col("outcome") == o) for o in OUTCOMES}
    present, produced = n["correct"] + n["wrong"] + n["missed"], n["correct"] + n["wrong"] + n["hallucinated"]
    rate = lambda x, y: F.bround(100.0 * x / F.nullif(y, F.lit(0)), 1)
    return outcomes.groupBy(by).agg(
        *[v.alias(k) for k, v in n.items()], F.count("*").alias("total"), rate(n["correct"], present).alias("recall"), rate(n["correct"], produced).alias("precision"),
        rate(n["correct"] + n["correctly_absent"], F.count("*")).alias("accuracy"),
    )


def address_block(outcomes: DataFrame, by: str) -> DataFrame:
    """The address fields as one verdict: exact if none is wrong, missed or hallucinated."""
    own = outcomes.where(F.col("field").isin(*ADDRESS_FIELDS))
    bad = F.count_if(F.col("outcome").isin("wrong", "missed", "hallucinated"))
    scored = F.count("*") - F.count_if(F.col("outcome") == "correctly_absent")
    good = F.count_if(F.col("outcome") == "correct")
    return own.groupBy(by).agg(F.count("*").alias("fields"), (bad == 0).alias("exact"), F.bround(100.0 * good / F.nullif(scored, F.lit(0)), 1).alias("field_accuracy"))


def report_json(outcomes: DataFrame, key: str = "packet_id") -> DataFrame:
    """(packet, body): the evaluation of each packet as JSON: counts and rates, the address block (null without address fields)
    and each field's outcome with what was expected and extracted, by field; blank texts are null."""
    shown = lambda c: F.when(F.btrim(F.coalesce(F.col(c), F.lit(""))) != "", F.col(c)).alias(c)
    expected = F.when(~F.coalesce("absent", F.lit(False)), F.col("expected")).alias("expected")
    results = outcomes.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("field", "outcome", expected, shown("extracted")))).alias("results"))
    block = address_block(outcomes, key)
    block = block.select(key, F.struct(*[c for c in block.columns if c != key]).alias("address_block"))
    summary = outcome_summary(outcomes, key)
    names = [c for c in summary.columns if c != key]
    x = results.join(summary, key).join(block, key, "left")
    body = F.struct(F.col(key).cast("string").alias("vendor_id"), F.struct(*names, "address_block").alias("summary"), "results")
    return x.select(key, F.to_json(body, {"ignoreNullFields": "false"}).alias("body"))
