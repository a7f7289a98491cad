"""Extraction results as the payloads and forms that other systems take."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import titlecase
from ledgerloom.operators.fields import packet_summary

# Form field to extraction field, where the names differ or are tried in turn, and document names.
VENDOR_FIELDS = {
    "vendor_name": "vendor_name", "address_1": "address_1", "address_2": "address_2", "address_3": "address_3", "address_4": "address_4", "city": "city", "state": "state",
    "country": "country", "pin_code": "pin_code", "telephone_1": "telephone", "telephone_2": None, "email": "email", "website": "website", "company_type": "company_type",
    "nature_of_business": "nature_of_business", "tan_no": "tan", "pan": "pan", "tds_applicable": "tds_applicable", "gst_no": "gst_number", "esic_no": "esic_number",
    "udyam_no": "udyam_number", "bank_name": "bank_name", "branch_address": "branch_address", "ifsc_swift_code": "ifsc", "account_type": "account_type", "account_number": "account_number",
}
CUSTOMER_FIELDS = {
    "company_name": ("vendor_name", "company_name"), "contact_name": ("contact_name",), "city": ("city",), "state": ("state",), "zip_code": ("pin_code", "zip_code"), "country": ("country",),
    "gst_registration_number": ("gst_number", "gst_registration_number"), "pan_number": ("pan", "pan_number"), "email_id_to": ("email", "email_id_to"), "email_id_cc": ("email_id_cc",),
    "phone_number": ("telephone", "phone_number"), "payment_terms": ("payment_terms",), "salesperson": ("salesperson",), "region": ("region",), "customer_agreement": ("customer_agreement",),
}
DOCUMENT_NAMES = {
    "gst_certificate": "GST Certificate", "udyam_certificate": "Udyam Certificate", "cancelled_cheque": "Cancelled Cheque", "pan_card": "PAN Card", "bank_statement": "Bank Statement",
    "other": "Other",
}
PAN = r"\A[A-Z]{5}[0-9]{4}[A-Z]\z"


def blank(x: Column) -> Column:
    return F.coalesce(x, F.lit(""))


def first_of(packets: DataFrame, names: tuple[str, ...]) -> Column:
    """The first of the columns, as far as the table has them, that is not empty; else empty."""
    return F.coalesce(*[F.nullif(F.col(n), F.lit("")) for n in names if n in packets.columns], F.lit(""))


def without_nulls(records: DataFrame) -> DataFrame:
    """Null strings are empty; other types stay."""
    return records.na.fill("", [f.name for f in records.schema.fields if f.dataType.typeName() == "string"])


def vendor_payload(packets: DataFrame, key: str = "packet_id") -> DataFrame:
    return packets.select(key, *[(first_of(packets, (source,)) if source else F.lit("")).alias(name) for name, source in VENDOR_FIELDS.items()])


def joined_address(packets: DataFrame, names: tuple[str, ...]) -> Column:
    return F.array_join(F.array_compact(F.array(*[F.nullif(F.col(n), F.lit("")) for n in names if n in packets.columns] or [F.lit(None).cast("string")])), ", ")


def customer_payload(packets: DataFrame, key: str = "packet_id") -> DataFrame:
    """The review form of a generic result: address_1 to address_3 joined, else a billing address; type Services unless given."""
    address = F.coalesce(F.nullif(joined_address(packets, ("address_1", "address_2", "address_3")), F.lit("")), first_of(packets, ("billing_address",)))
    kind = F.coalesce(F.nullif(first_of(packets, ("type",)), F.lit("")), F.lit("Services"))
    return packets.select(key, *[first_of(packets, names).alias(n) for n, names in CUSTOMER_FIELDS.items()], address.alias("billing_address"), kind.alias("type"))


def review_fields(needs_review: Column) -> Column:
    """Names out of an array of (field, reason); blanks and nulls go. A null list stays null."""
    return F.filter(F.transform(needs_review, lambda x: x["field"]), lambda f: blank(f) != "")


def document_name(doc_type: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in DOCUMENT_NAMES.items() for x in kv])
    return F.coalesce(F.try_element_at(known, doc_type), titlecase(F.replace(doc_type, F.lit("_"), F.lit(" "))))


def source_documents(documents: DataFrame, key: str = "packet_id") -> DataFrame:
    """(packet, source_documents): name, kind and confidence (score to two places, at most 1) of every document, by doc_id."""
    one = F.struct("doc_id", blank(F.col("name")).alias("file_name"), document_name(F.coalesce("doc_type", F.lit("other"))).alias("document_type"), F.least(F.lit(1.0), F.bround(F.coalesce("type_score", F.lit(0.0)), 2)).alias("confidence"))
    rows = documents.groupBy(key).agg(F.array_sort(F.collect_list(one)).alias("d"))
    return rows.select(key, F.transform("d", lambda d: F.struct(d["file_name"].alias("file_name"), d["document_type"].alias("document_type"), d["confidence"].alias("confidence"))).alias("source_documents"))


def with_location(form: DataFrame, resolved: DataFrame, key: str = "packet_id") -> DataFrame:
    """Fills city, state and zip_code of a form from its billing address, where one of them is empty; what was filled is
    added to ``review`` (each name once) and the address keeps the rest. ``resolved``: key, address_1, city, state, pin_code."""
    r = resolved.select(F.col(key).alias("__key"), F.col("address_1").alias("__rest"), F.col("city").alias("__city"), F.col("state").alias("__state"), F.col("pin_code").alias("__zip_code"))
    x = form.join(r, F.col(key) == F.col("__key"), "left")
    names = ("city", "state", "zip_code")
    empty = {n: blank(F.col(n)) == "" for n in names}
    told = {n: blank(F.col(f"__{n}")) != "" for n in names}
    go = (blank(F.col("billing_address")) != "") & (empty["city"] | empty["state"] | empty["zip_code"]) & (told["city"] | told["state"] | told["zip_code"])
    added = F.array_compact(F.array(*[F.when(go & empty[n] & told[n], n) for n in names]))
    new = {n: F.when(go & empty[n] & told[n], F.col(f"__{n}")).otherwise(F.col(n)) for n in names}
    new["billing_address"] = F.when(go, F.coalesce(F.nullif(F.col("__rest"), F.lit("")), F.col("billing_address"))).otherwise(F.col("billing_address"))
    new["review"] = F.array_distinct(F.concat(F.coalesce("review", F.array().cast("array<string>")), added))
    return x.select(*[new.get(c, F.col(c)).alias(c) for c in form.columns])


def customer_form(packets: DataFrame, invalid: dict[str, Column], key: str = "packet_id") -> DataFrame:
    """The onboarding form: 17 fields, the bank's details and ``review``. ``packets`` has the canonical fields (a missing one
    is empty) and ``review``, the form names to look at; ``invalid`` says of which fields a value failed: these are left empty.
    A PAN that is missing is taken from the GSTIN and put up for review."""
    value = lambda n: first_of(packets, (n,))
    valid = lambda n: F.when(F.coalesce(invalid.get(n, F.lit(False)), F.lit(False)), "").otherwise(value(n))
    inner = F.substring(valid("gst_number"), 3, 10)
    derived = (valid("pan") == "") & inner.rlike(PAN)
    review = F.coalesce(F.col("review") if "review" in packets.columns else F.lit(None).cast("array<string>"), F.array().cast("array<string>"))
    bank = F.struct(value("bank_name").alias("bank_name"), value("account_number").alias("account_number"), valid("ifsc").alias("ifsc_code"), value("branch_address").alias("branch"))
    empty = ("contact_name", "email_id_cc", "payment_terms", "salesperson", "region", "customer_agreement")
    return packets.select(
        key, value("vendor_name").alias("company_name"), joined_address(packets, ("address_1", "address_2", "address_3", "address_4")).alias("billing_address"), value("city").alias("city"), value("state").alias("state"),
        valid("pin_code").alias("zip_code"), value("country").alias("country"), valid("gst_number").alias("gst_registration_number"), F.when(derived, inner).otherwise(valid("pan")).alias("pan_number"),
        value("email").alias("email_id_to"), value("telephone").alias("phone_number"), *[F.lit("").alias(n) for n in empty], F.lit("Services").alias("type"), bank.alias("bank_details"),
        F.array_distinct(F.concat(review, F.when(derived, F.array(F.lit("pan_number"))).otherwise(F.array().cast("array<string>")))).alias("review"),
    )


def result_json(results: DataFrame, flags: DataFrame, key: str = "packet_id") -> DataFrame:
    """(packet, values, body): a map of every field's value (null if empty), and the record as JSON with ``needs_review``, the
    flagged fields in the flags' order (stage, field), repeated where several flags were raised."""
    entry = F.struct("field", F.nullif("value", F.lit("")).alias("value"))
    values = results.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("values"))
    review = flags.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("stage", "field"))).alias("r")).select(F.col(key).alias("__key"), F.transform("r", lambda x: x["field"]).alias("needs_review"))
    x = values.join(review, F.col(key) == F.col("__key"), "left").withColumn("needs_review", F.coalesce("needs_review", F.array().cast("array<string>")))
    body = F.to_json(F.struct(F.col("values").alias("canonical"), "needs_review"), {"ignoreNullFields": "false"})
    return x.select(key, "values", "needs_review", body.alias("body"))


# Reasons that only warn; all others are errors.
WARNINGS = ("value_resolved_from_combined_address", "value_derived_not_printed", "validation_warning", "cross_document_mismatch", "pin_state_mismatch")


def nested_result(extracted: dict[str, DataFrame], order: list[str], documents: DataFrame | None = None, key: str = "packet_id") -> DataFrame:
    """(packet, body): everything that was found, as JSON with the flat record, each field with its source, status and
    alternatives, the review list with confidence and severity, the documents and a summary; fields as in ``order``.

    ``extracted`` has results and flags, and agreement and findings where there are any. ``documents`` (key, doc_id, path,
    doc_type) names the sources; without it they stay numbers. A packet without results has no row; one field's rows
    are few, so every group is one packet's."""
    results, flags = extracted["results"], extracted["flags"]
    text, none = F.lit("").cast("string"), F.array().cast("array<string>")
    for c, kind in (("doc_id", "long"), ("page", "int"), ("caption", "string"), ("kind", "string"), ("alternatives", "array<string>")):
        if c not in results.columns:
            results = results.withColumn(c, F.lit(None).cast(kind))
    summary = packet_summary(results).select(F.col("packet_id").alias("__key"), F.struct("total", "filled", "empty", "valid", "fill_rate").alias("summary"))
    if extracted.get("findings") is not None:
        told = extracted["findings"].where(~F.col("ok")).groupBy(key, "field").agg(F.array_sort(F.collect_list("validator")).alias("messages"))
        results = results.join(told, [key, "field"], "left")
    if extracted.get("agreement") is not None:
        results = results.join(extracted["agreement"].select(key, "field", "agreement"), [key, "field"], "left")
    if documents is not None:
        name = F.element_at(F.split("path", "/"), -1)
        results = results.join(documents.select(key, "doc_id", name.alias("source")), [key, "doc_id"], "left")
    maybe = lambda c, other: F.coalesce(F.col(c), other) if c in results.columns else other
    one = F.struct(
        F.nullif("value", text).alias("value"), F.bround(F.coalesce("confidence", F.lit(0.0)), 4).alias("confidence"), maybe("source", F.col("doc_id").cast("string")).alias("source_document"),
        F.col("page").alias("source_page"), F.col("caption").alias("matched_label"), F.col("kind").alias("match_kind"), F.col("status").alias("validation_status"),
        maybe("messages", none).alias("validation_messages"), maybe("agreement", F.lit("not_checked")).alias("consistency"), F.coalesce("alternatives", none).alias("alternatives"),
    )
    fields = results.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("field", one.alias("one")))).alias("by"))
    sure = results.select(key, "field", F.bround(F.coalesce("confidence", F.lit(0.0)), 4).alias("confidence"))
    severity = F.when(F.col("reason").isin(*WARNINGS), "warning").otherwise("error").alias("severity")
    flagged = flags.join(sure, [key, "field"], "left").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("stage", "field", "reason", "confidence", severity))).alias("r"))
    flagged = flagged.select(F.col(key).alias("__packet"), F.transform("r", lambda x: x.dropFields("stage")).alias("needs_review"))
    x = fields.join(summary, F.col(key) == F.col("__key"), "left").join(flagged, F.col(key) == F.col("__packet"), "left")
    x = x.withColumn("needs_review", F.coalesce("needs_review", F.array().cast(flagged.schema["needs_review"].dataType)))
    if documents is not None:
        listed = F.array_sort(F.collect_list(F.struct("doc_id", F.element_at(F.split("path", "/"), -1).alias("document"), "doc_type")))
        own = documents.groupBy(F.col(key).alias("__of")).agg(F.transform(listed, lambda d: d.dropFields("doc_id")).alias("documents"))
        x = x.join(own, F.col(key) == F.col("__of"), "left")
    canonical = F.struct(*[F.col("by")[f]["value"].alias(f) for f in order], F.col("needs_review.field").alias("needs_review"))
    of = F.struct(*[F.col("by")[f].alias(f) for f in order])
    docs = [F.coalesce("documents", F.array().cast(x.schema["documents"].dataType)).alias("documents")] if documents is not None else []
    whole = F.struct("summary.*", F.size("needs_review").alias("needs_review"))
    body = F.to_json(F.struct(canonical.alias("canonical"), of.alias("fields"), "needs_review", *docs, whole.alias("summary")), {"ignoreNullFields": "false"})
    return x.select(key, body.alias("body"))
