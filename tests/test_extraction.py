import json

import pytest

from ledgerloom.operators.forms import nested_result
from ledgerloom.plans.extraction import Field, by_priority, extract

DICTIONARY = {
    "vendor_name": Field(("legal name", "name of enterprise"), expected=("gst_certificate",), required=True),
    "gst_number": Field(("gstin",), ("[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][1-9A-Z]Z[0-9A-Z]",), ("uppercase", "remove_spaces"), required=True),
    "pan": Field(("pan", "permanent account number"), ("[A-Z]{5}[0-9]{4}[A-Z]",), ("uppercase", "remove_spaces")),
    "email": Field(("email",), (r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}",), ("lowercase", "remove_spaces")),
    "country": Field(("country",), default="India"),
}


def page(packet, doc, kind, lines):
    return [(packet, doc, kind, 1, doc * 100 + i, text, 0.95, float(x), float(y), float(x + 6 * len(text)), float(y + 10)) for i, (text, x, y) in enumerate(lines)]


def test_packets_to_records(spark):
    rows = page("p1", 1, "gst_certificate", [("Legal Name", 0, 0), ("Acme Tools Ltd", 80, 0), ("GSTIN: 27ABCDE1234F1Z5", 0, 20), ("PAN", 0, 60), ("ABCDE1234F", 40, 60), ("write to Info@Acme.co.in now", 0, 200)])
    rows += page("p1", 2, "cancelled_cheque", [("Legal Name", 0, 0), ("Other House", 80, 0)])
    rows += page("p2", 3, "gst_certificate", [("Permanent Account Number", 0, 0), ("XYZAB9999Q", 0, 14), ("Country: Narnia", 0, 300)])
    spans = spark.createDataFrame(rows, "packet_id string, doc_id long, doc_type string, page int, span_id long, text string, confidence double, x1 double, y1 double, x2 double, y2 double")
    out = extract(spans, DICTIONARY)
    got = {r["packet_id"]: r.asDict() for r in out["canonical"].collect()}
    assert got["p1"] == {"packet_id": "p1", "vendor_name": "Acme Tools Ltd", "gst_number": "27ABCDE1234F1Z5", "pan": "ABCDE1234F", "email": "info@acme.co.in", "country": "India"}
    assert got["p2"] == {"packet_id": "p2", "vendor_name": None, "gst_number": None, "pan": "XYZAB9999Q", "email": None, "country": "India"}
    flags = {(r["packet_id"], r["field"], r["reason"]) for r in out["flags"].collect()}
    assert {("p2", "vendor_name", "missing_required_field"), ("p2", "gst_number", "missing_required_field"), ("p1", "vendor_name", "cross_document_mismatch")} <= flags
    assert not any(p == "p1" and reason == "missing_required_field" for p, _, reason in flags)
    papers = spark.createDataFrame([("p1", 1, "in/a.pdf", "gst_certificate"), ("p1", 2, "b.png", "cancelled_cheque"), ("p1", 7, "c.png", "other"), ("p2", 3, "d.pdf", None)], "packet_id string, doc_id long, path string, doc_type string")
    body = {r["packet_id"]: json.loads(r["body"]) for r in nested_result(out, list(DICTIONARY), papers).collect()}
    one = body["p1"]
    assert list(one["canonical"]) == [*DICTIONARY, "needs_review"] and one["canonical"]["pan"] == "ABCDE1234F" and body["p2"]["canonical"]["vendor_name"] is None
    pan, country = one["fields"]["pan"], one["fields"]["country"]
    assert (pan["source_document"], pan["source_page"], pan["matched_label"], pan["match_kind"], pan["validation_status"]) == ("a.pdf", 1, "pan", "adjacent_same_line", "valid")
    assert (country["value"], country["confidence"], country["source_document"]) == ("India", 1.0, None) and one["fields"]["email"]["match_kind"] == "pattern_only"
    assert one["fields"]["vendor_name"]["consistency"] == "inconsistent"
    assert [d["document"] for d in one["documents"]] == ["a.pdf", "b.png", "c.png"] and one["documents"][1]["doc_type"] == "cancelled_cheque"
    mismatch = next(x for x in one["needs_review"] if x["reason"] == "cross_document_mismatch")
    assert mismatch["field"] == "vendor_name" and mismatch["severity"] == "warning" and 0 < mismatch["confidence"] <= 1
    assert one["canonical"]["needs_review"] == [x["field"] for x in one["needs_review"]] and one["summary"]["needs_review"] == len(one["needs_review"])
    assert {k: body["p2"]["summary"][k] for k in ("total", "filled", "empty", "fill_rate")} == {"total": 5, "filled": 2, "empty": 3, "fill_rate": 40.0}


@pytest.mark.parametrize("bad", [Field((), ()), Field(("a",), normalisers=("nope",)), Field(("a",), directions=("up",))])
def test_dictionary_is_checked(spark, bad):
    with pytest.raises(ValueError, match="broken"):
        extract(spark.createDataFrame([], "packet_id string"), {"broken": bad})


def test_values_over_several_spans_and_foreign_values(spark):
    """A value goes on over spans and rows; the same document numbers in two packets do not mix; a number of another
    field beside a caption gives way."""
    dictionary = DICTIONARY | {"address_1": Field(("address",))}
    rows = page("p1", 0, "gst_certificate", [("Address", 0, 0), ("Plot 3, Block C,", 60, 0), ("Sector 18", 165, 0), ("Pune City", 60, 12), ("PAN", 0, 24), ("ABCDE1234F", 60, 24)])
    rows += page("p2", 0, "gst_certificate", [("Address", 0, 0), ("Hall 9", 60, 0), ("Legal Name", 0, 40), ("27ABCDE1234F1Z5", 80, 40), ("Legal Name: Bolt Works", 0, 90)])
    spans = spark.createDataFrame(rows, "packet_id string, doc_id long, doc_type string, page int, span_id long, text string, confidence double, x1 double, y1 double, x2 double, y2 double")
    got = {r["packet_id"]: r.asDict() for r in extract(spans, dictionary)["canonical"].collect()}
    assert got["p1"]["address_1"] == "Plot 3, Block C, Sector 18, Pune City" and got["p1"]["pan"] == "ABCDE1234F"
    assert got["p2"]["address_1"] == "Hall 9" and got["p2"]["vendor_name"] == "Bolt Works" and got["p2"]["gst_number"] == "27ABCDE1234F1Z5"
    status = {(r["packet_id"], r["field"]): r["status"] for r in extract(spans, dictionary)["results"].collect()}
    assert status["p1", "vendor_name"] == "missing" and status["p1", "pan"] == "valid" and status["p1", "address_1"] == "not_validated"


def test_a_field_with_a_pattern_is_never_foreign(spark):
    """A value whose normalised form no longer fits its own pattern, but another field's, keeps its score."""
    from pyspark.sql import functions as F

    from ledgerloom.plans.extraction import foreign

    dictionary = {"code": Field(("code",), ("[0-9]{4}x",)), "pin": Field(("pin",), ("[0-9]{6}",)), "name": Field(("name",)), "note": Field(("note",))}
    rows = [("code", "560001"), ("name", "560001"), ("name", "Acme"), ("pin", "560001"), ("note", "1234x"), ("note", None)]
    df = spark.createDataFrame([(f, (v,)) for f, v in rows], "field string, d struct<value:string>")
    assert [r[0] for r in df.select(foreign(dictionary)).collect()] == [False, True, False, False, True, False]


def test_derived_fields_follow_their_sources(spark, monkeypatch):
    """Sources first whatever the order of the dictionary; printed values stay; what cannot be derived stays empty."""
    from pyspark.sql import functions as F

    from ledgerloom.plans import extraction

    monkeypatch.setitem(extraction.DERIVATIONS, "shout", lambda c: F.upper(c))
    dictionary = {"banner": Field((), derive=("website", "shout")), "website": Field((), derive=("email", "email_domain")), "email": Field(("email",))}
    assert extraction.derivation_order(dictionary) == ["website", "banner"]
    rows = [(1, "email", "a@acme.co.in"), (1, "website", None), (1, "banner", ""), (2, "email", "a@gmail.com"), (2, "website", None), (2, "banner", None), (3, "email", None), (3, "website", "www.x.y"), (3, "banner", None)]
    df = spark.createDataFrame([(*r, 0.9) for r in rows], "packet_id int, field string, value string, confidence double")
    got = {(r["packet_id"], r["field"]): (r["value"], r["derived"], r["confidence"]) for r in extraction.with_derived(df, dictionary).collect()}
    assert got[1, "website"] == ("www.acme.co.in", True, 0.4) and got[1, "banner"] == ("WWW.ACME.CO.IN", True, 0.4) and got[1, "email"] == ("a@acme.co.in", False, 0.9)
    assert got[2, "website"][1] is False and got[2, "banner"][1] is False
    assert got[3, "website"] == ("www.x.y", False, 0.9) and got[3, "banner"] == ("WWW.X.Y", True, 0.4)


@pytest.mark.parametrize(
    "bad",
    [
        {"a": Field((), derive=("b", "email_domain")), "b": Field((), derive=("a", "email_domain"))},
        {"a": Field((), derive=("zz", "email_domain"))},
        {"a": Field(("a",), derive=("a", "nope"))},
        {"a": Field(("a",), derive=("a", "email_domain"))},
    ],
)
def test_derivations_are_checked(spark, bad):
    with pytest.raises(ValueError, match="a: |b: "):
        extract(spark.createDataFrame([], "packet_id string"), bad)


def test_validators_of_the_dictionary_run(spark):
    """A field's own validators replace those of its name; none at all means that it is not validated."""
    dictionary = {
        "pan": Field(("pan",), ("[A-Z0-9]+",), validators=()), "code": Field(("code",), ("[0-9]+",), validators=("pin_format",), priority=90),
        "state": Field(("state",), priority=90), "tan": Field(("tan",), ("[A-Z0-9]+",)),
    }
    rows = page("p", 0, "other", [("PAN: 12", 0, 0), ("Code: 12", 0, 40), ("State: Goa", 0, 80), ("TAN: 12", 0, 120)])
    rows += page("q", 0, "other", [("Code: 560001", 0, 40), ("State: Atlantis", 0, 80)])
    spans = spark.createDataFrame(rows, "packet_id string, doc_id long, doc_type string, page int, span_id long, text string, confidence double, x1 double, y1 double, x2 double, y2 double")
    got = {(r["packet_id"], r["field"]): r["status"] for r in extract(spans, dictionary)["results"].collect()}
    assert (got["p", "pan"], got["p", "code"], got["p", "state"], got["p", "tan"]) == ("not_validated", "invalid", "valid", "invalid")
    assert (got["q", "code"], got["q", "state"]) == ("valid", "warning")
    assert by_priority(dictionary) == ["code", "state", "pan", "tan"]
    with pytest.raises(ValueError, match="x: undefined validators"):
        extract(spans, {"x": Field(("x",), validators=("nope",))})


def test_python_steps_run_once(spark):
    """Caption hits and values beside captions are computed once: what is pooled from them calls no Python, and pages are
    folded many in a batch, not one by one."""
    from ledgerloom.operators import layout
    from ledgerloom.plans.extraction import candidates

    rows = page("p1", 1, "gst_certificate", [("Legal Name", 0, 0), ("Acme Tools Ltd", 80, 0), ("GSTIN: 27ABCDE1234F1Z5", 0, 20)])
    spans = spark.createDataFrame(rows, "packet_id string, doc_id long, doc_type string, page int, span_id long, text string, confidence double, x1 double, y1 double, x2 double, y2 double")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    pool = candidates(spans, DICTIONARY)
    assert not any(step in plan(pool) for step in ("InPandas", "EvalPython"))
    assert {(r["field"], r["value"]) for r in pool.collect()} >= {("vendor_name", "Acme Tools Ltd"), ("gst_number", "27ABCDE1234F1Z5")}
    lined = layout.lines(spans, layout.PACKET_PAGE)
    assert "InPandas" not in plan(lined) and [r["line"] for r in lined.orderBy("order").collect()] == [0, 0, 1]
