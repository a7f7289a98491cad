"""The record-processing queries: each applies one operator family to whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions import text as T
from ledgerloom.operators import address as A
from ledgerloom.operators import captions as CA
from ledgerloom.operators import classify as C
from ledgerloom.operators import evaluate as E
from ledgerloom.operators import fields as FI
from ledgerloom.operators import forms as FO
from ledgerloom.operators import layout as L
from ledgerloom.operators import records as R
from ledgerloom.operators import segments as S
from ledgerloom.operators import validate as V
from ledgerloom.operators import wordbreak as WB
from ledgerloom.plans import extraction as X
from ledgerloom.plans.derived import candidates, vendors
from ledgerloom.sources import lookups as LU

EMAIL = V.RULES["email_format"].pattern
WEIGHTS = {"label": 0.45, "pattern": 0.30, "proximity": 0.15, "confidence": 0.10}
RULED = ["vendor_name", "gst_number", "pan", "pin_code", "state", "country", "email", "telephone", "ifsc", "account_number"]
PROFILES = {
    "english": (("en_",), ("the ", "licensed under", " and ")), "french": (("fr_",), ("les ", "éau")), "german": (("de_",), ("der ", "und ", "nicht")),
    "spanish": (("es_",), ("los ", "ción", "para ")),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def emails(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, email): guarded matches, normalised and validated."""
    docs = docs.where(F.contains("text", F.lit("@")))  # before the costly scan
    found = docs.select("doc_id", F.posexplode(T.find_matches(F.coalesce("text", F.lit("")), [EMAIL])).alias("pos", "raw"))
    email = T.normalise(F.col("raw"), ["lowercase", "remove_spaces"])
    return found.select("doc_id", F.col("pos").cast("long").alias("pos"), email.alias("email")).where(T.full_match(F.col("email"), [EMAIL]))


def email_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emails(table(spark, sf_dir, "documents"))


def account_number_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.explode(T.find_matches(F.coalesce("text", F.lit("")), ["[0-9]{9,18}"])).alias("raw"))
    found = docs.select("doc_id", T.normalise(F.col("raw"), ["digits_only"]).alias("account_number"))
    found = found.where(V.passes(V.RULES["account_number_format"], F.col("account_number"), {}))
    return found.groupBy("doc_id", "account_number").agg(F.count("*").alias("n"))


def website_derive(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    first = emails(docs).groupBy("doc_id").agg(F.min_by("email", "pos").alias("email"))
    site = T.website_of(F.col("email"))
    return docs.select("doc_id").join(first, "doc_id", "left").select(
        "doc_id", "email", site.alias("website"),
        F.when(F.col("email").isNull(), "missing_required_field").when(site.isNotNull(), "value_derived_not_printed").alias("flag"),
    )


def normalize_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.concat(F.lit("  - "), "p_name", F.lit("  :\t"), "p_brand", F.lit(" | +91-9"), F.lpad(F.col("p_partkey").cast("string"), 9, "0"), F.lit("  "))
    phone = F.concat(F.lit("+91-9"), F.lpad(F.col("p_partkey").cast("string"), 9, "0"))
    return table(spark, sf_dir, "part").select(
        "p_partkey", T.normalise(x, ["strip"]).alias("stripped"), T.normalise(x, ["collapse_spaces"]).alias("collapsed"), T.normalise(x, ["remove_spaces", "uppercase"]).alias("squashed"),
        T.normalise(F.concat("p_name", F.lit(" "), "p_type"), ["titlecase"]).alias("titled"), T.normalise(x, ["digits_only"]).alias("digits"),
        T.normalise(phone, ["strip_country_code"]).alias("phone"), T.clean_label(x).alias("label"), T.strip_value_prefix(x).alias("bare"), T.lookup_key(x).alias("key"),
    )


def corporate_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vendors(spark, sf_dir)
    glued = F.concat(F.lit("Orbit"), F.col("packet_id").cast("string"), F.element_at(F.array(*map(F.lit, ("PVTLTD", "privatelimited", "IndustriesLtd", ""))), (F.col("packet_id") % 4 + 1).cast("int")))
    phrase = F.element_at(F.array(*map(F.lit, ("PRIVATELIMITEDCOMPANY", "Partnership Firm", "sole  proprietorship", "Other Form"))), (F.col("packet_id") % 4 + 1).cast("int"))
    return v.select(
        "packet_id", T.normalise(F.col("vendor_name"), ["collapse_spaces", "split_corporate_suffix"]).alias("spaced"), T.normalise(glued, ["split_corporate_suffix"]).alias("unglued"),
        T.normalise(phrase, ["expand_known_phrase"]).alias("legal_form"),
    )


def ifsc_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixed = T.normalise(F.col("ifsc"), ["fix_ifsc_confusions"])
    return vendors(spark, sf_dir).select("packet_id", "ifsc", fixed.alias("fixed"), V.passes(V.RULES["ifsc_format"], fixed, {}).alias("ok"))


def width_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", *[T.fit_width(F.coalesce("text", F.lit("")), w).alias(f"w{w}") for w in (20, 30, 50, 80)])


def doc_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat("lang", F.lit("_"), "source").alias("name"), "text")
    return C.classify(docs, PROFILES).select("doc_id", "doc_type", "type_score")


def type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc_classify(spark, sf_dir).groupBy("doc_type").agg(F.count("*").alias("n"), F.max("type_score").alias("best"))


def validator_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.statuses(V.findings(vendors(spark, sf_dir), RULED)).withColumnRenamed("field", "field_name")


def validator_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.findings(vendors(spark, sf_dir), RULED).groupBy("validator").agg(F.count("*").alias("n"), F.count_if(F.col("ok")).alias("passed"))


def pin_state_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each vendor's state is that of its PIN, by a directory of three quarters of the PINs and a table of spellings."""
    v = vendors(spark, sf_dir)
    pins = v.where("packet_id % 4 <> 3 AND packet_id % 6 <> 0").select(F.col("pin_code").alias("pin"), F.when(F.col("packet_id") % 5 == 0, "WB").when(F.col("packet_id") % 2 == 0, "West Bengal").otherwise("KERALA").alias("state"))
    states = spark.createDataFrame([("westbengal", "West Bengal"), ("wb", "West Bengal"), ("kerala", "Kerala")], "key string, state string")
    found = V.findings(V.with_pin_state(v, pins, states), ["state"])
    return found.where("validator = 'pin_matches_state'").select("packet_id", F.col("field").alias("field_name"), "ok")


def gstin_pan_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vendors(spark, sf_dir)
    status = {f: F.when(V.passes(V.RULES[r], F.col(f), {}), "valid").otherwise("invalid") for f, r in (("gst_number", "gstin_format"), ("pan", "pan_format"), ("pin_code", "pin_format"), ("ifsc", "ifsc_format"))}
    return C.onboarding(v, status)


def synthetic_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.synthetic_layout(table(spark, sf_dir, "documents")).select("doc_id", "page", F.col("order").alias("line_no"), F.length("text").alias("chars"), "x1", "y1", "x2", "y2")


def grid_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight spans per supplier on a page of its nation, on an integer grid."""
    rows = table(spark, sf_dir, "supplier").selectExpr("CAST(s_nationkey AS BIGINT) AS doc_id", "CAST(s_suppkey % 4 AS INT) AS page", "s_suppkey", "explode(sequence(0, 7)) AS n")
    return rows.selectExpr(
        "doc_id", "page", "s_suppkey * 8 + n AS span_id", "CAST((s_suppkey * 7 + n * 3) % 40 * 10 AS DOUBLE) AS x1", "CAST((s_suppkey * 5 + n * 11) % 50 * 10 AS DOUBLE) AS y1",
        "CAST((s_suppkey * 7 + n * 3) % 40 * 10 + 30 + n AS DOUBLE) AS x2", "CAST((s_suppkey * 5 + n * 11) % 50 * 10 + 8 AS DOUBLE) AS y2", "CAST(8 AS DOUBLE) AS unit", "n",
    )


def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = grid_spans(spark, sf_dir)
    found = L.neighbour_counts(spans.where("n = 0"), spans)
    return found.groupBy("doc_id", "direction").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.round("distance_ratio", 6)).alias("ratios"), F.min("first_span").alias("first_span"))


def line_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.lines(grid_spans(spark, sf_dir)).withColumnRenamed("order", "span_order")


def char_sessionize(spark: SparkSession, sf_dir: str) -> DataFrame:
    chars = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc_id"), F.lit(1).alias("page"), F.posexplode(F.split(F.concat("s_name", F.lit("\nx"), F.col("s_acctbal").cast("int").cast("string")), "")).alias("i", "ch"))
    x = F.col("i") * 5.0 + F.when(F.col("i") >= 8, 20.0).otherwise(0.0)
    placed = chars.select("doc_id", "page", "i", "ch", x.alias("x1"), F.lit(0.0).alias("y1"), (x + 4.0).alias("x2"), F.lit(10.0).alias("y2"))
    return L.sessions(placed).select("doc_id", F.col("session").cast("long").alias("session_no"), "text", "x1", "x2")


def page_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "documents").select("doc_id", "text", (F.col("doc_id") % 12 * 1.0).alias("image_area"), F.lit(10.0).alias("page_area"))
    return L.page_trust(pages).groupBy("method", F.coalesce("ocr_reason", F.lit("none")).alias("reason")).agg(F.count("*").alias("n"))


def candidate_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = FI.scored(candidates(spark, sf_dir), WEIGHTS)
    return out.select("packet_id", "cand_ord", F.round("score", 9).alias("score"), F.array_join("notes", ",").alias("notes"))


def pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FI.without_junk(FI.biased(FI.scored(candidates(spark, sf_dir), WEIGHTS)))


def validation_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FI.biased(FI.scored(candidates(spark, sf_dir), WEIGHTS)).select("packet_id", "cand_ord", F.round("score", 9).alias("score"))


def choose_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = FI.chosen(pool(spark, sf_dir))
    return out.select("packet_id", F.col("field").alias("field_name"), "value", F.round("score", 9).alias("score"), "doc_type", "kind", F.array_join("alternatives", "|").alias("alternatives"))


def pattern_only_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = candidates(spark, sf_dir).select(F.col("field"), (F.col("packet_id") * 12 + F.col("cand_ord")).alias("span_id"), "kind", "value")
    left = FI.pattern_only(c, c.where("kind <> 'pattern_only'"))
    return left.select(F.col("field").alias("field_name"), "span_id", "value")


def long_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vendors(spark, sf_dir)
    rows = v.select("packet_id", F.explode(F.create_map(*[x for f in RULED for x in (F.lit(f), F.col(f))])).alias("field", "value"))
    rows = rows.join(V.statuses(V.findings(v, RULED)), ["packet_id", "field"], "left")
    confidence = F.when(F.col("packet_id") % 3 == 0, 0.5).otherwise(0.9)
    return rows.withColumn("status", V.or_missing(F.col("status"), F.col("value"))).withColumn("confidence", confidence).withColumn("derived", (F.col("field") == "state") & (F.col("packet_id") % 4 == 0))


def canonical_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FI.canonical(FI.with_defaults(long_results(spark, sf_dir), {"country": "India"}), RULED)


def packet_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FI.packet_summary(FI.with_defaults(long_results(spark, sf_dir), {"country": "India"}))


def review_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = FI.with_defaults(long_results(spark, sf_dir), {"country": "India"})
    return FI.review_flags(results, ("vendor_name", "gst_number", "pan")).withColumnRenamed("field", "field_name")


def cross_doc_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = candidates(spark, sf_dir).where("field = 'vendor_name' AND value <> ''").withColumn("score", F.col("label_similarity"))
    return V.consistency(values).withColumnRenamed("field", "field_name")


def lookup_state_city(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens against small dimensions: canonical state, then alias, then known city. The dimensions are the
    nation and region tables, of fixed size, so Spark broadcasts them by their file size."""
    nation = table(spark, sf_dir, "nation").select(T.lookup_key(F.col("n_name")).alias("state_key"), F.col("n_name").alias("canonical"))
    alias = table(spark, sf_dir, "nation").select(F.concat(F.lit("st"), F.col("n_nationkey").cast("string")).alias("alias_key"), F.col("n_name").alias("by_alias"))
    cities = table(spark, sf_dir, "region").select(T.lookup_key(F.col("r_name")).alias("city_key"))
    k = F.col("s_suppkey")
    token = F.when(k % 3 == 0, F.concat(F.lit(" Nation_"), (k % 30).cast("string"))).when(k % 3 == 1, F.concat(F.lit("ST-"), (k % 30).cast("string"))).otherwise(F.lit("Asia"))
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", token.alias("token"), T.lookup_key(token).alias("key"))
    out = rows.join(nation, rows.key == nation.state_key, "left").join(alias, rows.key == alias.alias_key, "left").join(cities, rows.key == cities.city_key, "left")
    return out.select("s_suppkey", "token", F.coalesce("canonical", "by_alias").alias("state"), F.col("city_key").isNotNull().alias("is_city"))


def records_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    return R.page(orders, 100, 50, "o_orderdate", "o_orderkey").select("o_orderkey", "o_totalprice")


def customer_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as stored records: a registration number that some share and some lack."""
    k = F.col("c_custkey")
    gst = F.when(k % 9 == 0, F.lit("  ")).otherwise(F.concat(F.lit("G"), (k % 1000).cast("string")))
    rows = table(spark, sf_dir, "customer").select(k.alias("id"), F.col("c_name").alias("customer_name"), gst.alias("gst"), F.concat(F.lit("U"), k.cast("string")).alias("udyam"), F.col("c_mktsegment").alias("city"))
    return R.blank_to_null(rows, ["gst", "udyam"])


def find_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = customer_records(spark, sf_dir)
    incoming = rows.select("id", "gst", F.when(F.col("id") % 2 == 0, F.concat(F.lit("U"), (F.col("id") + 1).cast("string"))).otherwise(F.lit(None)).alias("udyam"))
    return R.duplicates(incoming, rows, ("gst", "udyam"), exclude="id").select("id", "existing_id", "clash")


def unique_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.violations(customer_records(spark, sf_dir), "gst")


def patch_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = customer_records(spark, sf_dir)
    changes = rows.where("id % 4 = 0").select("id", F.create_map(F.lit("city"), F.concat(F.lit("New"), F.col("id").cast("string")), F.lit("gst"), F.lit(None).cast("string")).alias("sent"))
    return R.patch(rows, changes, ["customer_name", "city", "gst"])


def delete_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = customer_records(spark, sf_dir)
    return R.delete(rows, rows.where("id % 5 = 0"))


def upsert_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = customer_records(spark, sf_dir)
    incoming = rows.where("id % 6 = 0").withColumn("id", F.when(F.col("id") % 12 == 0, F.col("id")).otherwise(-F.col("id"))).withColumn("city", F.lit("UPSERTED"))
    return R.upsert(rows, incoming)


def mark_pushed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = customer_records(spark, sf_dir).withColumn("bc_status", F.when(F.col("id") % 3 == 0, "pushed").otherwise("not_pushed"))
    return R.mark_pushed(rows, rows.where("id % 2 = 0")).groupBy("bc_status", "outcome").agg(F.count("*").alias("n"))


def erp_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vendors(spark, sf_dir).withColumnsRenamed({"packet_id": "id", "telephone": "telephone_1", "gst_number": "gst_no"})
    out = R.erp_payload(v, R.VENDOR_ERP, ("address_2", "address_3"))
    return out.select("id", "Name", "Address", "Address_2", "City", "County", "Country_Region_Code", "Post_Code", "Phone_No", "E_Mail", "PAN_Number", "GST_Number", F.array_join("truncated_fields", ",").alias("truncated"))


def verify_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = spark.createDataFrame([("vendor_name", "Main", "B2", "-"), ("pan", "Main", "B3", "N/A"), ("account_number", "Bank", "C1", "")], "field string, sheet string, cell string, blank_value string")
    results = long_results(spark, sf_dir).select("packet_id", "field", "value")
    expected = E.fill_cells(results, cells)
    actual = F.when(F.col("packet_id") % 10 == 0, F.lit("tampered")).when(F.col("cell") == "C1", F.concat("value", F.lit(".0"))).otherwise(F.concat(F.lit(" "), F.upper("value")))
    read = expected.select("packet_id", "sheet", "cell", actual.alias("value")).where("packet_id % 15 <> 1")
    return E.verification_summary(E.verify_cells(expected, read))


def truth_and_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One outcome per packet and field: the truth is the derived vendor, what was extracted a disturbed copy."""
    fields = ("vendor_name", "pan", "pin_code", "state", "city", "address_1", "address_2")
    v = vendors(spark, sf_dir)
    long = v.select("packet_id", F.posexplode(F.array(*[F.struct(F.lit(f).alias("field"), F.coalesce(F.col(f), F.lit("")).alias("v")) for f in fields])).alias("i", "x")).select("packet_id", "i", "x.field", "x.v")
    k = F.col("packet_id") + F.col("i")
    truth = long.select("packet_id", "field", F.col("v").alias("expected"), (k % 6 == 0).alias("absent"))
    got = F.when(k % 7 == 0, F.lit(None).cast("string")).when(k % 5 == 0, F.concat("v", F.lit("x"))).when(k % 4 == 0, F.concat(F.lit("  "), F.lower("v"), F.lit(". "))).otherwise(F.col("v"))
    return E.evaluate(truth, long.select("packet_id", "field", got.alias("value")))


def eval_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.outcome_summary(truth_and_values(spark, sf_dir), "field").withColumnRenamed("field", "field_name")


def address_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.address_block(truth_and_values(spark, sf_dir), "packet_id")


def eval_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evaluation of every packet as JSON, and what is read back from it."""
    body = E.report_json(truth_and_values(spark, sf_dir))
    at = lambda p: F.get_json_object("body", f"$.{p}")
    rows = F.from_json(at("results"), "array<struct<field:string,outcome:string,expected:string,extracted:string>>")
    told = F.array_join(F.transform(rows, lambda r: F.concat_ws(":", r["field"], r["outcome"], F.when(r["expected"].isNull(), "-"), F.when(r["extracted"].isNull(), "/"))), ",")
    return body.select(
        "packet_id", at("summary.total").cast("long").alias("total"), at("summary.accuracy").cast("double").alias("accuracy"), at("summary.address_block.fields").cast("long").alias("block_fields"), told.alias("told")
    )


def nested_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every packet's whole result as JSON, and what is read back from it."""
    results = FI.with_defaults(long_results(spark, sf_dir), {"country": "India"})
    found = {"results": results, "flags": FI.review_flags(results, ("vendor_name", "gst_number", "pan")), "findings": V.findings(vendors(spark, sf_dir), RULED)}
    at = lambda p: F.get_json_object("body", f"$.{p}")
    reasons = F.from_json(at("needs_review"), "array<struct<reason:string>>")["reason"]
    return FO.nested_result(found, RULED).select(
        "packet_id", at("summary.total").cast("long").alias("total"), at("summary.filled").cast("long").alias("filled"), at("summary.valid").cast("long").alias("valid"), at("summary.needs_review").cast("long").alias("n_review"),
        at("canonical.gst_number").alias("gst_number"), at("fields.country.value").alias("country"), F.array_join(F.from_json(at("canonical.needs_review"), "array<string>"), ",").alias("review"), F.array_join(reasons, ",").alias("reasons"),
    )


def label_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names against a few captions: the best caption by similarity, first in order on ties."""
    parts = table(spark, sf_dir, "part").select(F.lower("p_name").alias("name")).distinct()
    captions = ("small ring", "red widget", "bolt", "blue gear")
    best = F.array_max(F.array(*[F.struct(F.round(T.similarity(F.col("name"), F.lit(c)), 6).alias("score"), F.lit(-i).alias("turn"), F.lit(c).alias("caption")) for i, c in enumerate(captions)]))
    return parts.select("name", best.alias("b")).select("name", F.col("b.score").alias("score"), F.col("b.caption").alias("caption"))


def gap_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Address fragments cut into groups where the gap to the fragment before is strong."""
    f = table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS packet_id", "explode(sequence(0, 5)) AS i").selectExpr("packet_id", "i", "(packet_id * 3 + i * i) % 6 AS level", "(packet_id + i) % 4 AS tier", "(packet_id + i) % 5 = 0 AS injected")
    w = Window.partitionBy("packet_id").orderBy("i")
    step = F.col("level") - F.lag("level").over(w)
    last = F.lag("level").over(w)
    base = F.when(step == 1, 0.5).when(step > 1, 0.6).when(step < 0, F.when((F.col("level") <= 2) & (last <= 2), 0.2).otherwise(0.4)).otherwise(0.0)
    gap = F.greatest(F.lit(0.0), F.round(base + F.when(F.col("tier") != F.lag("tier").over(w), 0.2).otherwise(0.0) - F.when(F.col("injected"), 0.15).otherwise(0.0), 6))
    cut = F.coalesce((gap >= 0.5).cast("int"), F.lit(0))
    groups = f.withColumn("cut", cut).withColumn("g", F.sum("cut").over(w))
    return groups.groupBy("packet_id", "g").agg(F.count("*").alias("n"), F.min("i").alias("first_i"), F.max("level").alias("top_level"))


CAPTIONS = {
    "vendor_name": ["legal name", "name of enterprise", "company name"], "gst_number": ["gstin", "gst number", "registration number"], "pan": ["pan", "permanent account number"],
    "city": ["city", "town"], "state": ["state"],
}


def caption_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captions, some misspelt, before the derived vendors' values: best caption and the value after it."""
    v = vendors(spark, sf_dir)
    lines = F.array(
        F.concat(F.lit("Legal Name: "), "vendor_name"), F.lit("GSTIN"), F.concat(F.lit("Permanent Acc0unt Number - "), F.coalesce("pan", F.lit(""))), F.concat(F.lit("City of "), "city"),
        F.concat(F.lit("Stale: "), "state"), F.concat(F.lit("Registration Nurnber|"), F.coalesce("gst_number", F.lit("none"))),
    )
    spans = v.select("packet_id", F.posexplode(lines).alias("span_id", "text"))
    hits = CA.caption_hits(spans, CAPTIONS, {"pan": "[A-Z]{5}[0-9]{4}[A-Z]"})
    return hits.select("packet_id", "span_id", F.col("field").alias("field_name"), "caption", F.round("similarity", 6).alias("similarity"), "rest")


def address_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Combined addresses of suppliers; states, cities and PINs come from the nation table."""
    nation = table(spark, sf_dir, "nation")
    states = nation.select(T.lookup_key(F.concat(F.lit("State "), F.col("n_nationkey"))).alias("key"), F.concat(F.lit("State "), F.col("n_nationkey")).alias("state"))
    cities = nation.select(T.lookup_key(F.concat(F.lit("Town"), F.col("n_nationkey"))).alias("key"))
    pins = nation.select((F.lit(500000) + F.col("n_nationkey")).cast("string").alias("pin"), F.concat(F.lit("State "), F.col("n_nationkey")).alias("state"), F.concat(F.lit("District "), F.col("n_nationkey")).alias("district"))
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    address = F.concat(
        F.lit("Plot "), k, F.lit(", Park Lane"), F.when(k % 3 == 0, F.concat(F.lit(", TOWN"), n)).otherwise(""), F.when(k % 5 == 0, F.concat(F.lit(", District "), n)).otherwise(""),
        F.when(k % 2 == 0, F.concat(F.lit(", STATE "), n)).otherwise(""), F.when(k % 7 != 0, F.concat(F.lit(" - "), F.lit(500000) + (n + k % 4) % 25)).otherwise(", India"),
    )
    return A.resolve(table(spark, sf_dir, "supplier").select(k.alias("id"), address.alias("address")), states, cities, pins).drop("rest")


KEYWORDS = S.Keywords(
    {
        "premises_unit": S.Tier(1, ("plot", "unit"), ("floor",)), "structural": S.Tier(1, ("block",)), "building_name": S.Tier(2, (), ("building", "tower")),
        "estate_zone": S.Tier(2, (), ("park",), ("tech park",)), "thoroughfare": S.Tier(3, (), ("road",)), "landmark": S.Tier(3, ("near",)),
        "locality": S.Tier(4, ("sector",), ("nagar",)), "village_po": S.Tier(5, ("village",)),
    },
    ("village_po", "estate_zone", "premises_unit", "structural", "building_name", "landmark", "thoroughfare", "locality"),
)
PIECES = (
    "Plot 7", "3RD FLOOR", "Block B", "Sunrise Building", "Orion Tech Park", "MG Road", "Near Lake Road", "Gandhi Nagar", "Andul", "Village Rampur", "GREENFIELDTOWER", "#12", "B-12", "Building D",
)


def address_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of two to seven pieces as up to four lines; every fifth ends in five localities."""
    k = F.col("s_suppkey")
    n = F.when(k % 5 == 0, F.lit(7)).otherwise(2 + k % 6).cast("int")
    at = lambda i: F.when((k % 5 == 0) & (i >= 2), 7 + (k + i) % 2).otherwise((k * (i + 2) + 3 * i * i) % 14)
    pieces = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(F.array(*map(F.lit, PIECES)), at(i).cast("int")))
    found = S.address_columns(S.lines(table(spark, sf_dir, "supplier").select(k.alias("packet_id"), pieces.alias("segments")), KEYWORDS))
    return found.select("packet_id", "address_1", "address_2", "address_3", "address_4", "line_confidence", "line_score")


RUN_WORDS = S.Keywords(
    {
        "premises_unit": S.Tier(1, ("flat", "plot"), ("floor",)), "structural": S.Tier(1, ("block", "wing")), "building_name": S.Tier(2, (), ("plaza", "mahal", "wadi")),
        "thoroughfare": S.Tier(3, (), ("road",)), "locality": S.Tier(4, ("sector", "pocket"), ("nagar", "halli", "wadi")),
    }
)


def word_break(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of customers that have lost their spaces, and the same with spaces put back; fused names stay whole."""
    k = F.col("c_custkey")
    pick = lambda n, *words: F.element_at(F.array(*map(F.lit, words)), (F.floor(k / 6) % n + 1).cast("int"))
    place = pick(5, "LAKESIDE", "TALOJA", "HOSUR", "SERVICE", "ELECTRON")
    run = (
        F.when(k % 6 == 0, F.concat(F.lit("FLATNO"), 100 + k % 900)).when(k % 6 == 1, F.concat(F.lit("BLOCK"), pick(4, "A", "B", "C", "D"), F.lit("SECTOR"), 10 + k % 80))
        .when(k % 6 == 2, F.concat(place, F.lit("ROAD"))).when(k % 6 == 3, pick(4, "MAHALAXMI", "BOMMANAHALLI", "RAMWADI", "GANDHINAGAR"))
        .when(k % 6 == 4, F.concat(F.lit("2NDFLOORWING"), pick(3, "A", "C", "E"))).otherwise(F.concat(F.lit("PLOTNO"), 10 + k % 90, F.lit("  "), place, F.lit("PLAZA")))
    )
    rows = table(spark, sf_dir, "customer").select("c_custkey", run.alias("run_together"))
    return rows.select("c_custkey", "run_together", WB.respaced(F.col("run_together"), RUN_WORDS).alias("address"))


def places(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """States, cities and PINs named after the nations, and cities of one and two words."""
    nation = table(spark, sf_dir, "nation")
    state = F.concat(F.lit("State "), F.col("n_nationkey"))
    names = nation.select(F.concat(F.lit("Town"), F.col("n_nationkey")).alias("name")).unionByName(nation.select(F.concat(F.lit("New Port "), F.col("n_nationkey")).alias("name")))
    pins = nation.select((F.lit(500000) + F.col("n_nationkey")).cast("string").alias("pin"), state.alias("state"), F.concat(F.lit("District "), F.col("n_nationkey")).alias("district"))
    return nation.select(T.lookup_key(state).alias("key"), state.alias("state")), names.select(T.lookup_key(F.col("name")).alias("key")), pins


def address_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Combined addresses of customers as up to four lines and a place: a city at the front of a segment (not of a street's name), a named
    one, the PIN's district; run-together words get their spaces back."""
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    address = (
        F.when(k % 5 == 0, F.concat(F.lit("FLATNO"), 100 + k % 900, F.lit(", LAKESIDEROAD, NEW PORT "), n, F.lit(" SECTOR "), 10 + k % 80, F.lit(", STATE "), n))
        .when(k % 5 == 1, F.concat(F.lit("TOWN"), n, F.lit(" ROAD, STATE "), n))
        .when(k % 5 == 2, F.concat(F.lit("Plot "), 10 + k % 90, F.lit(", HOSUR ROAD, GANDHINAGAR, Town"), n, F.lit(", "), 500000 + n))
        .when(k % 5 == 3, F.concat(F.lit("BLOCKB, SUNRISEPLAZA, "), 500000 + n, F.lit(", India"))).otherwise(F.concat(F.lit("TOWN"), n, F.lit(" POCKET 4, Old House")))
    )
    states, cities, pins = places(spark, sf_dir)
    return A.resolve_lines(table(spark, sf_dir, "customer").select(k.alias("id"), address.alias("address")), states, cities, pins, RUN_WORDS)


STATES = ("Kerala", "Goa", "Punjab", "Bihar", "Gujarat")
PACKET_FIELDS = {
    "vendor_name": X.Field(("legal name",), expected=("gst_certificate",), required=True),
    "gst_number": X.Field(("gstin",), ("[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][1-9A-Z]Z[0-9A-Z]",), ("uppercase", "remove_spaces"), required=True),
    "pan": X.Field(("pan", "permanent account number"), ("[A-Z]{5}[0-9]{4}[A-Z]",), ("uppercase", "remove_spaces")),
    "address_1": X.Field(("principal place of business", "building no"), consistent=False),
    "address_2": X.Field((), consistent=False), "address_3": X.Field((), consistent=False), "address_4": X.Field((), consistent=False),
    "city": X.Field((), consistent=False), "state": X.Field((), consistent=False),
    "pin_code": X.Field(("postal code",), ("[1-9][0-9]{5}",), consistent=False),
    "email": X.Field(("email",), (r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}",), ("lowercase", "remove_spaces")),
    "website": X.Field(("website",), derive=("email", "email_domain")),
    "ifsc": X.Field(("ifsc",), normalisers=("uppercase", "remove_spaces")),
    "country": X.Field(("country",), default="India"),
}


def packet_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two documents of every supplier as spans on a page: a certificate and a cheque."""
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    m, digits = k % 6, F.lpad((k % 10000).cast("string"), 4, "0")
    state = F.element_at(F.array(*map(F.lit, STATES)), (n % 5 + 1).cast("int"))
    address = F.concat(F.lit("Building No: FLATNO"), 100 + k % 900, F.lit(", LAKESIDEROAD, NEW PORT "), n, F.lit(" SECTOR "), 10 + k % 80, F.lit(", "), state)
    span = lambda doc, kind, x, y, text: F.struct(F.lit(doc).alias("doc_id"), F.lit(kind).alias("doc_type"), F.lit(float(x)).alias("x1"), F.lit(float(y)).alias("y1"), text.alias("text"))
    gst = lambda x, y, text: span(1, "gst_certificate", x, y, text)
    cheque = lambda x, y, text: span(2, "cancelled_cheque", x, y, text)
    lines = F.array(
        F.when(m != 5, gst(0, 0, F.lit("Legal Name"))), F.when(m != 5, gst(80, 0, F.concat(F.lit("Acme Tools "), k))),
        gst(0, 40, F.concat(F.lit("GSTIN: "), F.when(m == 1, "99").otherwise(F.lpad((n + 1).cast("string"), 2, "0")), F.lit("ABCDE"), digits, F.lit("F1Z5"))),
        gst(0, 80, F.lit("PAN")), gst(60, 80, F.concat(F.lit("ABCDE"), digits, F.lit("F"))),
        gst(0, 120, F.lit("Principal Place of Business")), gst(180, 120, address),
        gst(0, 240, F.concat(F.lit("Email: Info@"), F.when(m == 2, "gmail").otherwise(F.concat(F.lit("Vendor"), k)), F.lit(".com"))),
        F.when(m.isin(0, 3), gst(0, 320, F.concat(F.lit("Postal Code: "), 500000 + F.when(m == 3, (n + 1) % 25).otherwise(n)))),
        F.when(m == 4, cheque(0, 0, F.concat(F.lit("Legal Name: Other House "), k))), cheque(0, 100, F.concat(F.lit("IFSC: SBIN"), F.when(m == 2, "X").otherwise("0"), F.lpad(k.cast("string"), 6, "0"))),
    )
    rows = table(spark, sf_dir, "supplier").select(k.alias("packet_id"), F.posexplode(F.array_compact(lines)).alias("span_id", "s")).select("packet_id", F.col("span_id").cast("long").alias("span_id"), "s.*")
    return rows.select(
        "packet_id", F.col("doc_id").cast("long").alias("doc_id"), "doc_type", F.lit(1).alias("page"), "span_id", "text", F.lit(0.95).alias("confidence"),
        "x1", "y1", (F.col("x1") + 6 * F.length("text")).alias("x2"), (F.col("y1") + 10).alias("y2"),
    )


def extract_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole plan over all packets: the record, and why its fields go to review."""
    nation = table(spark, sf_dir, "nation")
    _, cities, _ = places(spark, sf_dir)
    state = F.element_at(F.array(*map(F.lit, STATES)), (F.col("n_nationkey") % 5 + 1).cast("int"))
    pins = nation.select((F.lit(500000) + F.col("n_nationkey")).cast("string").alias("pin"), state.alias("state"), F.concat(F.lit("District "), F.col("n_nationkey")).alias("district"))
    names = spark.createDataFrame([(s.lower(), s) for s in STATES], "key string, state string")
    out = X.extract(packet_spans(spark, sf_dir), PACKET_FIELDS, X.Places(names, cities, pins, RUN_WORDS))
    told = F.array_sort(F.collect_list(F.struct("stage", F.concat_ws(":", "field", "reason").alias("f"))))["f"]
    flags = out["flags"].groupBy("packet_id").agg(F.array_join(told, " ").alias("flags"))
    return out["canonical"].join(flags, "packet_id", "left").withColumn("flags", F.coalesce("flags", F.lit("")))


OWN_CAPTIONS = {"address_1": ["Building No./Flat No.", "Flat No", "Address of Principal Place of"]}
LABELS = ["address of principal place of business", "legal name of business"]


def caption_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of suppliers without the captions of their own field, some misspelt, and whether another value is only a form's caption."""
    k = F.col("s_suppkey")
    raw = (
        F.when(k % 4 == 0, F.concat(F.lit("Building No./Flat No.: Unit "), k)).when(k % 4 == 1, F.concat(F.lit("Bui1ding No./Flat No - Plot "), k))
        .when(k % 4 == 2, F.concat(F.lit("FLAT NO. "), k, F.lit(", BLOCK C"))).otherwise(F.concat(F.lit("Address of Principal Place of: Building No./Flat No.: Gate "), k))
    )
    name = (
        F.when(k % 6 == 0, "Address of Principal Place").when(k % 6 == 1, "Legal Narne of Business").when(k % 6 == 2, "Micro").when(k % 6 == 3, "Type of Thing")
        .when(k % 6 == 4, "Trade Name, if any").otherwise(F.concat(F.lit("Acme Trading "), k))
    )
    rows = table(spark, sf_dir, "supplier").select(k, raw.alias("raw"), name.alias("name"))
    value = CA.own_captions_removed(F.lit("address_1"), F.col("raw"), OWN_CAPTIONS)
    return rows.select("s_suppkey", "raw", value.alias("cleaned"), "name", C.caption_leak(F.col("name"), LABELS, ["type", "date"], ["micro", "small"]).cast("int").alias("leak"))


def raw_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a PIN directory as published: repeated, with odd PINs and spellings, and PINs that lie in two districts."""
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    pin = F.when(k % 13 == 0, "12345").when(k % 17 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit(" "), 500000 + F.floor(k / 3) % 700))
    state = F.when(k % 19 == 0, "").when(k % 4 == 0, "WEST BENGAL").when(k % 4 == 1, "westbengal").otherwise(F.concat(F.lit("state "), n % 3))
    return table(spark, sf_dir, "customer").select(pin.alias("pincode"), F.concat(F.lit("DISTRICT "), n % 4).alias("district"), state.alias("state"), k.alias("at"))


def lookup_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The PIN directory from raw rows, first rows kept and collisions counted."""
    return LU.build_pins(raw_places(spark, sf_dir), {"WEST BENGAL": "West Bengal"})


def city_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """City names: the districts of the raw rows and the nations as aliases, each once."""
    return LU.build_cities(raw_places(spark, sf_dir), table(spark, sf_dir, "nation").select(F.col("n_name").alias("name")))


def record_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch of new records against the stored ones: what is accepted and what is not, and why."""
    k = F.col("c_custkey")
    incoming = table(spark, sf_dir, "customer").select(
        k.alias("row_id"), F.when(k % 11 != 0, F.col("c_name")).alias("customer_name"), (k % 30).cast("int").alias("n_nationkey"),
        F.concat(F.when(k % 5 == 0, "G").otherwise("N"), F.when(k % 5 == 0, k % 1000).otherwise(F.floor(k / 3)).cast("string")).alias("gst"),
        F.when(k % 4 != 0, F.concat(F.lit("N"), F.floor(k / 2).cast("string"))).alias("udyam"),
    )
    stored = customer_records(spark, sf_dir).where("id % 2 = 0")
    owners = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("n_nationkey"))
    return R.insert(incoming, stored, ("gst", "udyam"), "customer_name", "row_id", owner="n_nationkey", owners=owners).select("row_id", "outcome", "clash", "existing_id")


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vendor and the customer payload of every vendor, side by side."""
    v = vendors(spark, sf_dir)
    vendor = FO.vendor_payload(v).select("packet_id", "vendor_name", "address_2", "address_4", "telephone_1", "telephone_2", "tan_no", "gst_no", "ifsc_swift_code")
    customer = FO.customer_payload(v).select("packet_id", "company_name", "billing_address", "zip_code", "pan_number", "phone_number", "region", "type")
    return vendor.join(customer, "packet_id")


def customer_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The onboarding form of every vendor, its location filled from what the address was resolved to."""
    v = vendors(spark, sf_dir).withColumn("review", F.when(F.col("packet_id") % 4 == 0, F.array(F.lit("company_name"), F.lit("city"))).otherwise(F.array().cast("array<string>")))
    v = v.withColumn("city", F.when(F.col("packet_id") % 3 == 0, "").otherwise(F.col("city")))
    fails = lambda f, r: ~V.passes(V.RULES[r], F.col(f), {})
    form = FO.customer_form(v, {"gst_number": fails("gst_number", "gstin_format"), "pan": fails("pan", "pan_format"), "pin_code": fails("pin_code", "pin_format"), "ifsc": fails("ifsc", "ifsc_format")})
    resolved = v.where("packet_id % 2 = 0").select("packet_id", F.concat(F.lit("Rest "), F.col("packet_id").cast("string")).alias("address_1"), F.lit("Found City").alias("city"), F.lit("Goa").alias("state"), F.lit("403001").alias("pin_code"))
    out = FO.with_location(form, resolved)
    return out.select("packet_id", "company_name", "billing_address", "city", "state", "zip_code", "pan_number", "type", F.col("bank_details.ifsc_code").alias("ifsc_code"), F.array_join("review", ",").alias("review"))


def text_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, blocks): four lines of every document in turn as paragraphs, the first one a higher heading, and as a table."""
    lines = F.col("lines")
    table_of = lambda own: F.array(F.struct(F.lit(None).cast("string").alias("text"), F.transform(own, lambda s: F.split(s, ", ")).alias("cells"), F.lit(None).cast("double").alias("height")))
    paragraphs = lambda own: F.transform(own, lambda s, j: F.struct(s.alias("text"), F.lit(None).cast("array<array<string>>").alias("cells"), F.when(j == 0, 66.0).alias("height")))
    own = lambda g: F.slice(lines, g * 4 + 1, F.lit(4))
    stretches = F.sequence(F.lit(0), F.expr("(size(lines) - 1) div 4").cast("int"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.split(F.coalesce("text", F.lit("")), "\n").alias("lines"))
    return docs.select("doc_id", F.flatten(F.transform(stretches, lambda g: F.when(g % 2 == 1, table_of(own(g))).otherwise(paragraphs(own(g))))).alias("blocks"))


def block_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs and tables of every document as spans on pages."""
    out = L.block_layout(text_blocks(spark, sf_dir))
    return out.select("doc_id", "page", F.col("order").alias("span_no"), F.length("text").alias("chars"), F.coalesce("row", F.lit(-1)).alias("row_no"), F.coalesce("col", F.lit(-1)).alias("col_no"), "x1", "y1", "x2", "y2")


def back_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets whose first address line holds the whole address, put in order by what it was resolved to."""
    k = F.col("packet_id")
    v = vendors(spark, sf_dir).select(
        k, F.when(k % 7 == 0, "Main Gate").otherwise(F.col("address_1")).alias("address_1"), F.coalesce("address_2", F.lit("")).alias("address_2"), F.lit("stale").alias("address_3"), F.lit("").alias("address_4"),
        F.when(k % 2 == 0, "").otherwise(F.col("city")).alias("city"), F.when(k % 3 != 0, F.col("state")).otherwise("").alias("state"), F.col("pin_code"),
        F.when(k % 4 == 0, "pattern_only").otherwise("inline").alias("pin_kind"), F.when(k % 9 == 0, 0.4).otherwise(0.9).alias("pin_confidence"),
    )
    resolved = v.where("packet_id % 8 <> 5").select(
        k, F.lit("Line One").alias("address_1"), F.concat(F.lit("Line Two "), k.cast("string")).alias("address_2"), F.when(k % 5 == 0, "Line Three").otherwise("").alias("address_3"), F.lit("").alias("address_4"),
        F.lit("Pune").alias("city"), F.lit("Maharashtra").alias("state"), F.when(k % 10 == 0, "411001").otherwise("").alias("pin_code"),
    )
    out = S.back_fill(v, resolved)
    return out.select("packet_id", "address_1", "address_2", "address_3", "city", "state", "pin_code", F.array_join("resolved_fields", ",").alias("resolved"))


def address_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Address text against its truth, by the resolver's confidence."""
    v = vendors(spark, sf_dir)
    k = F.col("packet_id")
    rows = F.array(
        F.struct(F.lit("address_1").alias("field"), F.col("address_1").alias("expected"), F.when(k % 4 == 0, F.concat(F.lit(" "), F.upper(F.replace("address_1", F.lit(", "), F.lit("  ,"))), F.lit(","))).when(k % 7 == 0, "").otherwise(F.col("address_1")).alias("extracted")),
        F.struct(F.lit("address_2").alias("field"), F.col("address_2").alias("expected"), F.when(k % 6 == 0, "Extra").otherwise(F.col("address_2")).alias("extracted")),
        F.struct(F.lit("city").alias("field"), F.when(k % 5 != 0, F.col("city")).alias("expected"), F.when(k % 5 != 0, F.col("city")).alias("extracted")),
    )
    confidence = F.element_at(F.array(F.lit("high"), F.lit("medium"), F.lit("low")), (k % 3 + 1).cast("int"))
    long = v.select(k.alias("id"), confidence.alias("confidence"), F.explode(rows).alias("x")).select("id", "confidence", "x.*")
    return E.address_tally(E.address_outcomes(long))


def sheet_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A template with three sheets, two of them chosen: what each cell holds."""
    cells = spark.createDataFrame([("vendor_name", None, "b2", "-"), ("pan", None, "b3", "N/A"), ("account_number", "Bank", "c1", "")], "field string, sheet string, cell string, blank_value string")
    results = long_results(spark, sf_dir).select("packet_id", "field", "value")
    filled = E.fill_sheets(results, E.cell_map(cells), ["Main", "Copy"], ["Main", "Copy", "Bank"])
    return filled.select("packet_id", F.col("sheet").alias("sheet_name"), "cell", F.col("field").alias("field_name"), F.col("value").alias("cell_value"))
