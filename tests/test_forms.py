"""Forms, insertion, truth and sheet checks, dictionary files and runs."""

import json
import random

import pytest

from pyspark.sql import functions as F

from ledgerloom.operators import evaluate, forms, records
from ledgerloom.plans.extraction import extract
from ledgerloom.sources import dictionary, lookups, runs, spans


def test_insert(spark):
    stored = spark.createDataFrame([(1, "A", "u1"), (2, "B", None)], "id long, gst string, udyam string")
    rows = [(10, "x", "A", None), (11, "x", "C", "u2"), (12, "x", "D", "u2"), (13, "x", "D", None), (14, "", "E", None), (15, None, "F", None), (16, "x", None, None), (17, "x", None, None), (18, "x", "Z", "u1")]
    incoming = spark.createDataFrame(rows, "n long, name string, gst string, udyam string")
    got = {r["n"]: (r["outcome"], r["clash"], r["existing_id"]) for r in records.insert(incoming, stored, ("gst", "udyam"), "name", "n").collect()}
    assert got == {
        10: ("conflict", "gst", 1), 11: ("accepted", None, None), 12: ("conflict", "udyam", None), 13: ("accepted", None, None), 14: ("missing_required", None, None), 15: ("missing_required", None, None),
        16: ("accepted", None, None), 17: ("accepted", None, None), 18: ("conflict", "udyam", 1),
    }
    assert records.insert(incoming.limit(0), stored, ("gst",), "name", "n").count() == 0
    out = records.stored(incoming.limit(1), F.lit("2020-01-01").cast("timestamp")).first()
    assert out["bc_status"] == "not_pushed" and out["created_at"] == out["updated_at"]


def test_one_hot_key_in_a_batch(spark):
    stored = spark.createDataFrame([], "id long, gst string")
    incoming = spark.range(3000).select(F.col("id").alias("n"), F.lit("x").alias("name"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("gst"))
    n = {r["outcome"]: r["count"] for r in records.insert(incoming, stored, ("gst",), "name", "n").groupBy("outcome").count().collect()}
    assert n == {"accepted": 2001, "conflict": 999}


def row_by_row(rows, stored):
    taken = [{r[1] for r in stored if r[1]}, {r[2] for r in stored if r[2]}]
    ids = [{r[1]: r[0] for r in reversed(stored)}, {r[2]: r[0] for r in reversed(stored)}]
    own, out = [set(), set()], {}
    for n, name, *values in sorted(rows):
        hit = next((i for i, v in enumerate(values) if v is not None and v in taken[i]), None)
        late = next((i for i, v in enumerate(values) if v is not None and v in own[i]), None)
        if not name:
            out[n] = ("missing_required", None, None)
        elif hit is not None:
            out[n] = ("conflict", ("gst", "udyam")[hit], ids[hit][values[hit]])
        elif late is not None:
            out[n] = ("conflict", ("gst", "udyam")[late], None)
        else:
            out[n] = ("accepted", None, None)
            for i, v in enumerate(values):
                own[i] |= {v} if v is not None else set()
    return out


def test_insertion_like_row_by_row(spark):
    """Random batches, and a chain in which every second row is refused by the one before it."""
    rnd = random.Random(8)
    stored = [(i, f"s{i}", f"t{i % 5}" if i % 2 else None) for i in range(1, 9)]
    pick = lambda kind: rnd.choice([None, f"{kind}{rnd.randrange(40)}", f"{kind}{rnd.randrange(400)}", f"hot{kind}" if rnd.random() < 0.3 else None])
    batch = [(n, "" if rnd.random() < 0.05 else "x", rnd.choice([pick("s"), pick("g")]), rnd.choice([pick("t"), pick("u")])) for n in range(400)]
    chain = [(1_000 + n, "x", f"c{n // 2}", f"d{(n + 1) // 2}") for n in range(12)]
    rows = batch + chain
    incoming = spark.createDataFrame(rows, "n long, name string, gst string, udyam string").repartition(5)
    known = spark.createDataFrame(stored, "id long, gst string, udyam string")
    got = {r["n"]: (r["outcome"], r["clash"], r["existing_id"]) for r in records.insert(incoming, known, ("gst", "udyam"), "name", "n").collect()}
    assert got == row_by_row(rows, stored)
    assert [got[1_000 + n][0] for n in range(4)] == ["accepted", "conflict", "accepted", "conflict"]


def test_payloads_and_review(spark):
    df = spark.createDataFrame([(1, None, "Acme", "", "B"), (2, "Old", "", None, None)], "packet_id int, company_name string, vendor_name string, address_1 string, address_2 string")
    got = {r["packet_id"]: r for r in forms.customer_payload(df).collect()}
    assert (got[1]["company_name"], got[1]["billing_address"], got[1]["type"]) == ("Acme", "B", "Services") and got[2]["company_name"] == "Old"
    assert forms.vendor_payload(df).where("packet_id = 2").first()["address_1"] == ""
    flags = spark.createDataFrame([([("pan", "low"), (None, "x"), ("", "y"), ("pan", "z")],), (None,)], "r array<struct<field:string,reason:string>>")
    assert [r[0] for r in flags.select(forms.review_fields(F.col("r"))).collect()] == [["pan", "pan"], None]
    assert forms.without_nulls(spark.createDataFrame([(None, None)], "a string, n int")).first() == ("", None)


def test_documents_and_result(spark):
    docs = spark.createDataFrame([("p", 1, "b.pdf", "land_deed", 0.456), ("p", 0, "a.pdf", "pan_card", 6.0), ("p", 2, None, None, None)], "packet_id string, doc_id int, name string, doc_type string, type_score double")
    assert [tuple(d) for d in forms.source_documents(docs).first()["source_documents"]] == [("a.pdf", "PAN Card", 1.0), ("b.pdf", "Land Deed", 0.46), ("", "Other", 0.0)]
    results = spark.createDataFrame([("p", "pan", ""), ("p", "city", "Pune")], "packet_id string, field string, value string")
    flags = spark.createDataFrame([("p", "pan", 3), ("p", "city", 2), ("p", "pan", 2)], "packet_id string, field string, stage int")
    row = forms.result_json(results, flags).first()
    assert row["values"] == {"city": "Pune", "pan": None} and json.loads(row["body"]) == {"canonical": {"city": "Pune", "pan": None}, "needs_review": ["city", "pan", "pan"]}


def test_cells_and_truth(spark):
    cells = lambda *rows: spark.createDataFrame(rows, "field string, sheet string, cell string, blank_value string")
    with pytest.raises(ValueError, match="a, b"):
        evaluate.cell_map(cells(("a", None, "b2", ""), ("b", None, "B2", "")))
    with pytest.raises(ValueError, match="a: no cell"):
        evaluate.cell_map(cells(("a", None, None, "")))
    with pytest.raises(ValueError, match="Gone"):
        evaluate.fill_sheets(cells(), cells(("a", "Gone", "B2", "")), [], ["Main"])
    truth = lambda *rows: spark.createDataFrame(rows, "field string, expected string, absent boolean")
    assert evaluate.checked_truth(truth(("a", "x", None), ("b", None, True)), True).count() == 2
    for rows, verified, message in (((("a", "x", True),), True, "absent"), ((("a", None, None),), True, "neither"), ((("a", "x", None),), False, "verified")):
        with pytest.raises(ValueError, match=message):
            evaluate.checked_truth(truth(*rows), verified)
    out = spark.createDataFrame([("z", "correct"), ("b", "wrong"), ("a", "wrong"), ("c", "missed")], "field string, outcome string")
    assert [r["field"] for r in evaluate.by_outcome(out).collect()] == ["a", "b", "c", "z"]
    texts = spark.createDataFrame([(" Plot 4 ,MG  Road, ", "plot 4, mg road"), ("a b", "ab")], "a string, b string")
    assert [r[0] for r in texts.select(evaluate.address_text(F.col("a")) == evaluate.address_text(F.col("b"))).collect()] == [True, False]


FIELDS = {"fields": {
    "pan": {"captions": ["pan"], "patterns": ["[A-Z]{5}[0-9]{4}[A-Z]"], "validators": ["pan_format"], "exclude": ["^AAAAA"], "required": True},
    "country": {"captions": ["country"], "aliases": {"India": ["(?i)bharat", "(?i)ind"]}, "default": "India", "consistent": True},
}}


def test_dictionary_files(spark, tmp_path):
    path = tmp_path / "fields.json"
    path.write_text(json.dumps(FIELDS))
    got = dictionary.fields(dictionary.text(spark, str(path)))
    assert list(got) == ["pan", "country"] and got["pan"].required and not got["pan"].consistent and got["pan"].validators == ("pan_format",) and got["country"].validators is None and got["country"].aliases == (("(?i)bharat", "India"), ("(?i)ind", "India"))
    assert dictionary.text(spark, str(tmp_path / "none.json")) is None and dictionary.profiles(None) == {} and not dictionary.keywords("{broken").tiers
    kw = dictionary.keywords(json.dumps({"tiers": {"locality": {"level": 4, "tail": ["NAGAR"]}}, "priority": ["locality"]}))
    assert kw.tiers["locality"].tail == ("nagar",) and dictionary.profiles('{"a": {"content": ["x"]}}') == {"a": ((), ("x",))}
    bad = {"unknown keys": {"a": {"captions": ["x"], "colour": 1}}, "undefined": {"a": {"captions": ["x"], "validators": ["nope"]}}, "bad pattern": {"a": {"patterns": ["("]}}, "neither": {"a": {}}, "object": {"a": 3}, "no fields": {}}
    for message, own in bad.items():
        with pytest.raises(ValueError, match=message):
            dictionary.fields(json.dumps({"fields": own}))
    assert dictionary.sample_errors({"pan": ["[A-Z]{5}"]}, {"pan": ["ABCDE", "x"]}, {"pan": ["AAAAA"]}) == [("pan", "x", "refused"), ("pan", "AAAAA", "accepted")]


def test_excluded_values_are_no_candidates(spark):
    rows = [("p", 0, "other", 1, 0, "PAN: AAAAA1234F", 0.95, 0.0, 0.0, 90.0, 10.0), ("p", 0, "other", 1, 1, "Country: Bharat", 0.95, 0.0, 40.0, 90.0, 50.0)]
    schema = "packet_id string, doc_id long, doc_type string, page int, span_id long, text string, confidence double, x1 double, y1 double, x2 double, y2 double"
    got = extract(spark.createDataFrame(rows, schema), dictionary.fields(json.dumps(FIELDS)))["canonical"].first()
    assert got["pan"] is None and got["country"] == "India"


def test_runs(spark, tmp_path):
    path = str(tmp_path / "runs")
    assert runs.load(spark, path, "0123456789", "body string") is None
    rows = spark.createDataFrame([("0123456789", "a"), ("abcdefabcd", "b")], "run_id string, body string")
    runs.save(rows, path)
    runs.save(rows.where("body = 'a'").withColumn("body", F.lit("new")), path)
    assert runs.load(spark, path, "0123456789", "body string").first()["body"] == "new" and runs.load(spark, path, "abcdefabcd", "body string").first()["body"] == "b"
    assert runs.load(spark, path, "../x", "body string") is None and runs.load(spark, path, "ffffffffff", "body string") is None
    assert spark.range(1).select(runs.new_run_id().alias("r")).where(F.col("r").rlike(r"\A[0-9a-f]{10}\z")).count() == 1


def test_state_spelling(spark):
    df = spark.createDataFrame([("ORISSA",), ("tamilnadu",), ("new land",), (None,)], "s string")
    known = {"ORISSA": "Odisha", "ODISHA": "Odisha", "TAMIL NADU": "Tamil Nadu"}
    assert [r[0] for r in df.select(lookups.state_spelling(F.col("s"), known)).collect()] == ["Odisha", "Tamil Nadu", "New Land", ""]


def test_text_layer_share(spark):
    page = lambda n, m: {"number": n, "extraction_method": m, "spans": []}
    rows = [("p", [{"path": "a", "pages": [page(1, "pdf_text"), page(2, None)]}]), ("q", [{"path": "b", "pages": [page(1, "ocr")]}])]
    sets = spark.createDataFrame(rows, spans.DOCUMENT_SET)
    assert spans.text_layer_share(sets).first() == (3, 1, pytest.approx(1 / 3))
    assert spans.text_layer_share(sets.limit(0)).first() == (0, 0, None)


def test_lookups_are_built_and_published(spark, tmp_path):
    raw = [(3, "700019", "KOLKATA", "west bengal"), (1, "700019 ", "kolkata", "WEST BENGAL"), (2, "700019", "Howrah", "West Bengal"), (4, "70001", "x", "Goa"), (5, "403001", " ab ", ""), (6, "403001", "42", "goa"), (7, None, None, None)]
    df = spark.createDataFrame(raw, "at int, pincode string, district string, state string")
    pins = lookups.build_pins(df, {"WEST BENGAL": "West Bengal", "GOA": "Goa"})
    assert sorted(map(tuple, pins.collect())) == [("403001", "42", "Goa", 0), ("700019", "Kolkata", "West Bengal", 1)]
    towns = lookups.build_cities(df, spark.createDataFrame([("Pune",), ("kolkata",)], "name string"))
    assert sorted(r[0] for r in towns.collect()) == ["howrah", "kolkata", "pune"]
    folder = str(tmp_path / "places")
    tables = {"pins": pins.select("pin", "state", "district"), "states": lookups.build_states(spark, ["Goa"], {"wb": "West Bengal"}), "cities": towns}
    lookups.publish(tables, folder)
    assert [p.name for p in tmp_path.iterdir()] == ["places"] and len(list((tmp_path / "places" / "pins").glob("*.csv"))) == 1
    assert [tuple(r) for r in lookups.pin_directory(spark, f"{folder}/pins").orderBy("pin").collect()] == [("403001", "Goa", "42"), ("700019", "West Bengal", "Kolkata")]
    with pytest.raises(FileExistsError):
        lookups.publish(tables, folder)


def test_document_sets_as_json(spark):
    """Nothing is lost on the way to JSON and back but what is rounded; from flat tables either."""
    span = lambda text, **kw: {"text": text, "bbox": {"x1": 1.004, "y1": 2.0, "x2": 30.126, "y2": 12.0}, "confidence": 0.91234, "source": "ocr", "order": 0, "table": None, "synthetic_bbox": False} | kw
    page = {"number": 1, "width": 1654.004, "height": 2338.0, "extraction_method": "docx", "ocr_reason": None, "duration_s": 0.25, "spans": [span("PAN"), span("é \"x\"", order=1, table={"table_index": 0, "row": 2, "col": 1}, synthetic_bbox=True)]}
    empty = {"number": 2, "width": 10.0, "height": 20.0, "extraction_method": "ocr", "ocr_reason": "no_text_layer", "duration_s": 1.5, "spans": []}
    docs = [{"path": "in/a.docx", "doc_type": "docx", "metadata": {"k": "v"}, "pages": [page, empty]}, {"path": "b.pdf", "doc_type": "pdf", "metadata": {}, "pages": []}]
    sets = spark.createDataFrame([("p", docs), ("q", []), ("r", None)], spans.DOCUMENT_SET)
    bodies = {r["packet_id"]: json.loads(r["body"]) for r in spans.document_set_json(sets).collect()}
    one = bodies["p"]
    assert (one["document_count"], one["span_count"], one["duration_s"]) == (2, 2, 1.75) and bodies["q"] == bodies["r"] == {"document_count": 0, "span_count": 0, "duration_s": 0.0, "documents": []}
    first, second = one["documents"][0]["pages"]
    assert one["documents"][0]["document"] == "a.docx" and one["documents"][1]["metadata"] == {} and one["documents"][0]["page_count"] == 2
    assert "ocr_reason" not in first and second["ocr_reason"] == "no_text_layer" and second["span_count"] == 0 and first["width"] == 1654.0
    assert first["spans"][0] == {"text": "PAN", "page": 1, "bbox": [1.0, 2.0, 30.13, 12.0], "source_document": "a.docx", "confidence": 0.9123, "source": "ocr", "order": 0}
    assert first["spans"][1]["table"] == {"table_index": 0, "row": 2, "col": 1} and first["spans"][1]["synthetic_bbox"] is True
    back = spans.from_document_set_json(spans.document_set_json(sets))
    assert [r["body"] for r in spans.document_set_json(back).orderBy("packet_id").collect()] == [r["body"] for r in spans.document_set_json(sets).orderBy("packet_id").collect()]
    assert spans.from_document_set_json(spark.createDataFrame([("x", "{broken")], "packet_id string, body string")).first()["documents"] is None
    flat = spans.to_document_sets(spans.spans(sets), spans.pages(sets), spans.documents(sets)).where("packet_id = 'p'").first()["documents"]
    assert [(d["path"], d["doc_type"], d["metadata"], [p["number"] for p in d["pages"]]) for d in flat] == [("in/a.docx", "docx", {"k": "v"}, [1, 2]), ("b.pdf", "pdf", {}, [])]
    assert [s["text"] for s in flat[0]["pages"][0]["spans"]] == ["PAN", "é \"x\""] and flat[0]["pages"][1]["ocr_reason"] == "no_text_layer" and flat[0]["pages"][1]["spans"] == []


def test_evaluation_as_json(spark):
    truth = spark.createDataFrame([("v", "pan", "ABCDE1234F", None), ("v", "city", None, True), ("v", "state", "Goa", False), ("w", "pan", None, True)], "packet_id string, field string, expected string, absent boolean")
    got = spark.createDataFrame([("v", "pan", " abcde 1234f"), ("v", "city", "Pune"), ("v", "state", " ")], "packet_id string, field string, value string")
    out = evaluate.evaluate(truth.withColumn("absent", F.coalesce("absent", F.lit(False))), got)
    body = {r["packet_id"]: json.loads(r["body"]) for r in evaluate.report_json(out).collect()}
    assert body["v"]["vendor_id"] == "v" and [(r["field"], r["outcome"], r["expected"], r["extracted"]) for r in body["v"]["results"]] == [
        ("city", "hallucinated", None, "Pune"), ("pan", "correct", "ABCDE1234F", " abcde 1234f"), ("state", "missed", "Goa", None)]
    s = body["v"]["summary"]
    assert (s["total"], s["recall"], s["precision"], s["accuracy"]) == (3, 50.0, 50.0, 33.3) and s["address_block"]["exact"] is False and s["address_block"]["fields"] == 2
    assert body["w"]["summary"]["recall"] is None and body["w"]["summary"]["address_block"] is None
