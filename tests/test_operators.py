import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions.text import lookup_key
from ledgerloom.operators import alignment, address, captions, classify, evaluate, fields, layout, records, validate
from ledgerloom.sources import lookups, spans
from ledgerloom.streaming import landing


def test_address(spark):
    states = spark.createDataFrame([("westbengal", "West Bengal"), ("delhi", "Delhi"), ("punjab", "Punjab")], "key string, state string")
    cities = spark.createDataFrame([("kolkata",), ("mohali",), ("delhi",)], "key string")
    pins = spark.createDataFrame([("700019", "West Bengal", "Kolkata"), ("711302", "West Bengal", "Howrah"), ("160055", "Punjab", "S.A.S Nagar")], "pin string, state string, district string")
    cases = {
        "12 Park Street, KOLKATA, KOLKATA, WEST BENGAL - 700019, India": ("12 Park Street", "Kolkata", "West Bengal", "700019", "high"),
        "Plot 4, ANDUL, Natibpur, 711302": ("Plot 4, ANDUL, Natibpur", "Howrah", "West Bengal", "711302", "medium"),
        "E-65, Phase 8, MOHALI, S.A.S Nagar, Punjab 160055": ("E-65, Phase 8", "Mohali", "Punjab", "160055", "high"),
        "Shop 3, Kondli, DELHI": ("Shop 3, Kondli", "Delhi", "Delhi", "", "medium"),
        "Hall, WEST, BENGAL, 711302 x": ("Hall, x", "Howrah", "West Bengal", "711302", "medium"),
        "Near Old Road, Punjab": ("Near Old Road", "", "Punjab", "", "low"),
        "Mohali, Punjab 700019": ("", "Mohali", "Punjab", "700019", "low"),
        "": ("", "", "", "", "low"),
    }
    df = spark.createDataFrame(list(enumerate(cases)), "id long, address string")
    got = {r["id"]: (r["address_1"], r["city"], r["state"], r["pin_code"], r["confidence"]) for r in address.resolve(df, states, cities, pins).collect()}
    assert got == dict(enumerate(cases.values()))


def test_lines_against_plain_python(spark):
    rows = [(1, 1, i, float((i * 37) % 50), float((i * i) % 23), float((i * 37) % 50 + 5), float((i * i) % 23 + 8)) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, page int, span_id long, x1 double, y1 double, x2 double, y2 double")
    got = {r["span_id"]: r["line"] for r in layout.lines(df).collect()}
    lines, own = [], {}
    for _, _, i, x1, y1, _, y2 in sorted(rows, key=lambda r: (r[4], r[3], r[2])):
        cy = (y1 + y2) / 2
        for k, line in enumerate(lines):
            if abs(sum(line) / len(line) - cy) <= 0.6 * 8:
                line.append(cy)
                own[i] = k
                break
        else:
            own[i] = len(lines)
            lines.append([cy])
    order = sorted(range(len(lines)), key=lambda k: min(r[4] for r in rows if own[r[2]] == k))
    assert got == {i: order.index(k) for i, k in own.items()}


def test_consistency(spark):
    rows = [(1, "f", 0, "Acme Ltd", 0.9, 0), (1, "f", 1, "acme ltd", 0.9, 0), (1, "f", 1, "zzz", 0.5, 1), (2, "f", 0, "Acme", 0.9, 0), (2, "f", 1, "Other", 0.9, 0), (3, "f", 0, "x", 1.0, 0), (4, "f", 0, "", 1.0, 0), (4, "f", 1, None, 1.0, 0)]
    df = spark.createDataFrame(rows, "packet_id int, field string, doc_id int, value string, score double, cand_ord int")
    got = {r["packet_id"]: r["agreement"] for r in validate.consistency(df).collect()}
    assert got == {1: "consistent", 2: "inconsistent", 3: "single_source", 4: "not_checked"}


def test_junk_stays_if_alone(spark):
    df = spark.createDataFrame([(1, "vendor_name", "Micro"), (2, "vendor_name", "Small  Enterprise"), (2, "vendor_name", "Acme")], "packet_id int, field string, value string")
    assert sorted(r["value"] for r in fields.without_junk(df).collect()) == ["Acme", "Micro"]


def test_patch_distinguishes_null_from_absent(spark):
    rows = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id int, name string, city string")
    sent = spark.createDataFrame([(1, {"city": None}), (2, {})], "id int, sent map<string,string>")
    assert sorted(map(tuple, records.patch(rows, sent, ["name", "city"]).collect())) == [(1, "a", None), (2, "b", "y")]


def test_page_limits(spark):
    with pytest.raises(ValueError):
        records.page(spark.range(3), 501)


def test_outcomes(spark):
    rows = [("pan", False, "AB 1", "ab1"), ("city", False, "M B Control", "m.b. control"), ("city", True, None, "x"), ("city", True, None, None), ("city", False, "a", ""), ("pin_code", False, "700019", "700019.0")]
    df = spark.createDataFrame(rows, "field string, absent boolean, expected string, got string")
    got = [r[0] for r in df.select(evaluate.outcome(F.col("absent"), F.col("expected"), F.col("got"), F.col("field"))).collect()]
    assert got == ["correct", "correct", "hallucinated", "correctly_absent", "missed", "correct"]


def test_lookups(spark, tmp_path):
    (tmp_path / "pins.csv").write_text("pin,state,district\n700019,West Bengal,Old\n700019,West Bengal,Kolkata\nbad,x,y\n")
    (tmp_path / "states.txt").write_text("# names\nWest Bengal\nWB\tWest Bengal\n\n")
    assert [tuple(r) for r in lookups.pin_directory(spark, str(tmp_path / "pins.csv")).collect()] == [("700019", "West Bengal", "Kolkata")]
    assert {tuple(r) for r in lookups.states(spark, str(tmp_path / "states.txt")).collect()} == {("westbengal", "West Bengal"), ("wb", "West Bengal")}
    assert spark.range(1).select(lookup_key(F.lit("W. Bengal"))).first()[0] == "wbengal"


def document_set(packet):
    box = {"x1": 1.005, "y1": 2.0, "x2": 30.0, "y2": 12.0}
    return (
        '{"packet_id": "%s", "documents": [{"path": "a.pdf", "pages": [{"number": 1, "spans": [{"text": "PAN", "bbox": %s, "confidence": 0.91234}, {"text": " ", "bbox": %s}]}]}]}'
        % (packet, str(box).replace("'", '"'), str(box).replace("'", '"'))
    )


def test_spans_round_trip(spark, tmp_path):
    (tmp_path / "p.json").write_text(document_set("p1"))
    flat = spans.drop_unsure(spans.spans(spans.read_document_sets(spark, str(tmp_path))))
    assert [(r["packet_id"], r["page"], r["order"], r["text"], r["source"]) for r in flat.collect()] == [("p1", 1, 0, "PAN", "ocr")]
    back = spans.to_document_sets(flat).first()
    assert back["documents"][0]["pages"][0]["spans"][0]["confidence"] == 0.9123


def test_landing_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(document_set("p1"))
    (tmp_path / "in" / "b.json").write_text(document_set("p2"))
    stream = landing.landing_spans(spark, str(tmp_path / "in"))
    landing.run_batches(stream, lambda df: df.groupBy("packet_id").count(), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert {(r["packet_id"], r["count"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {("p1", 2), ("p2", 2)}


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b, 1):
            new.append(row[j - 1] + 1 if x == y else max(row[j], new[-1]))
        row = new
    return row[-1]


def test_common_length_against_the_plain_programme():
    words = ["", "a", "legal name", "lega1 narne", "permanent account number", "abcabcabc" * 9, "ünïcode"]
    assert all(alignment.common(a, b) == lcs(a, b) for a in words for b in words)


def test_caption_hits(spark):
    texts = ["Legal Name: Acme Ltd", "GSTIN", "State of mind", "Flat No. 302", "City - Pune", "PAN ABCDE1234F", "Legai Name", ""]
    spans = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "span_id int, text string")
    known = {"name": ["Legal Name", "Name"], "gst": ["GSTIN"], "state": ["State"], "flat": ["Flat No"], "city": ["City"], "pan": ["PAN"]}
    got = {(r["span_id"], r["field"]): (r["caption"], r["rest"]) for r in captions.caption_hits(spans, known, {"pan": "[A-Z]{5}[0-9]{4}[A-Z]"}).collect()}
    assert got == {(0, "name"): ("legal name", "Acme Ltd"), (1, "gst"): ("gstin", ""), (4, "city"): ("city", "Pune"), (5, "pan"): ("pan", "ABCDE1234F"), (6, "name"): ("legal name", "")}


def test_fragment_tier(spark):
    tiers = {"landmark": {"head": ["near"]}, "thoroughfare": {"tail": ["road"]}, "estate_zone": {"any": ["industrial area"]}}
    df = spark.createDataFrame([("Near Old Road",), ("Park ROAD.",), ("Bawana Industrial Area 2",), ("Kondli",)], "x string")
    got = [r[0] for r in df.select(captions.fragment_tier(F.col("x"), tiers, ["estate_zone", "landmark", "thoroughfare"])).collect()]
    assert got == ["landmark", "thoroughfare", "estate_zone", "unknown"]


def test_continued_values(spark):
    rows = [  # span, text, line, label_like, start, x1, y1
        (1, "Address", 0, True, False, 0.0, 0.0), (2, "Flat 3, Block C,", 0, False, True, 100.0, 0.0), (3, "3rd Floor, Park", 0, False, False, 185.0, 0.0), (4, "far away", 0, False, False, 400.0, 0.0),
        (5, "Sector 18", 1, False, False, 102.0, 11.0), (6, "Pune", 2, False, False, 100.0, 22.0), (7, "PAN", 3, True, False, 100.0, 33.0), (8, "x", 4, False, False, 100.0, 44.0),
    ]
    df = spark.createDataFrame([(1, 1, i, t, n, like, s, x, y, x + 5 * len(t), y + 10) for i, t, n, like, s, x, y in rows], "doc_id long, page int, span_id long, text string, line int, label_like boolean, start boolean, x1 double, y1 double, x2 double, y2 double")
    assert [tuple(r) for r in layout.continued_values(df).collect()] == [(1, 1, 2, "Flat 3, Block C, 3rd Floor, Park, Sector 18 Pune")]


def test_caption_leaks_give_way_to_alternatives(spark):
    leaks = lambda v: classify.caption_leaks(v, ["address of principal place of business"], ["address", "legal"], ["small", "micro"])
    rows = [("Small", ["Acme Ltd"]), ("Trade Name, if any", ["Micro", "Bolt Co"]), ("Address of Principal Place of", []), ("Acme", ["x"]), ("Address of the long lane where many people went by bus today", None), (None, None)]
    df = spark.createDataFrame(list(enumerate(rows)), "i int, r struct<v:string, a:array<string>>")
    got = [(r[0]["value"], r[0]["replaced"]) for r in df.orderBy("i").select(classify.best_text(F.col("r.v"), F.col("r.a"), leaks)).collect()]
    assert got == [("Acme Ltd", True), ("Bolt Co", True), ("", False), ("Acme", False), ("Address of the long lane where many people went by bus today", False), ("", False)]


def test_review_names_and_url(spark):
    flags = spark.createDataFrame([(1, "pan", 3), (1, "email", 2), (1, "pan", 4), (1, "zz", 1)], "packet_id int, field string, stage int")
    assert classify.review_names(flags, {"pan": "pan_number", "email": "email"}).first()["needs_review"] == ["email", "pan_number"]
    tied = spark.createDataFrame([(1, "pan", 2), (1, "email", 2), (1, "city", 2)], "packet_id int, field string, stage int")
    assert classify.review_names(tied, {"pan": "pan_number", "email": "email", "city": "city"}, ["city", "pan", "email"]).first()["needs_review"] == ["city", "pan_number", "email"]
    assert spark.range(1).select(classify.company_url("http://h/", F.lit("O'Neil"), "VendorCard")).first()[0] == "http://h/Company('O''Neil')/VendorCard"


def test_premises_are_no_city(spark):
    states = spark.createDataFrame([("punjab", "Punjab")], "key string, state string")
    cities = spark.createDataFrame([("mohali",)], "key string")
    df = spark.createDataFrame([(1, "Hall 2, Metro Logistics Park, Punjab"), (2, "Hall 2, Barville, Punjab")], "id long, address string")
    got = {r["id"]: r["city"] for r in address.resolve(df, states, cities, tiers={"estate_zone": {"tail": ["park"]}}).collect()}
    assert got == {1: "", 2: "Barville"}


def test_packets_with_equal_document_numbers_stay_apart(spark, tmp_path):
    """Two packets, both with document 0 and page 1: spans, neighbours and lines of one never meet the other's."""
    box = lambda x, y: '{"x1": %d, "y1": %d, "x2": %d, "y2": %d}' % (x, y, x + 40, y + 10)
    for name, value, x in (("a", "ABCDE1234F", 50), ("b", "ZZZZZ9999Z", 60)):
        both = f'[{{"text": "PAN", "bbox": {box(0, 0)}}}, {{"text": "{value}", "bbox": {box(x, 0)}}}]'
        (tmp_path / f"{name}.json").write_text(f'{{"packet_id": "{name}", "documents": [{{"path": "x.pdf", "doc_type": "pan_card", "pages": [{{"number": 1, "spans": {both}}}]}}]}}')
    flat = spans.spans(spans.read_document_sets(spark, str(tmp_path)))
    assert {r["doc_type"] for r in flat.collect()} == {"pan_card"} and flat.select("packet_id", "span_id").distinct().count() == 4
    near = layout.neighbours(flat.where("text = 'PAN'").withColumn("unit", F.lit(10.0)), flat, keys=layout.PACKET_PAGE)
    text = {(r["packet_id"], r["span_id"]): r["text"] for r in flat.collect()}
    assert {(r["packet_id"], text[r["packet_id"], r["b_span_id"]]) for r in near.collect()} == {("a", "ABCDE1234F"), ("b", "ZZZZZ9999Z")}
    assert {r["line"] for r in layout.lines(flat, layout.PACKET_PAGE).collect()} == {0}


def test_lines_have_a_least_tolerance(spark):
    """Flat spans: centres up to 1 apart share a line; lines are numbered by their upper edge."""
    rows = [(1, 1, 1, 0.0, 5.0, 9.0, 5.1), (1, 1, 2, 10.0, 5.9, 19.0, 6.0), (1, 1, 3, 0.0, 1.0, 9.0, 1.1)]
    df = spark.createDataFrame(rows, "doc_id long, page int, span_id long, x1 double, y1 double, x2 double, y2 double")
    assert {r["span_id"]: (r["line"], r["order"]) for r in layout.lines(df).collect()} == {3: (0, 0), 1: (1, 1), 2: (1, 2)}


def test_pin_and_state_in_any_spelling(spark):
    pins = spark.createDataFrame([("700019", "WB", "Kolkata"), ("411001", "Maharashtra", "Pune")], "pin string, state string, district string")
    states = spark.createDataFrame([("westbengal", "West Bengal"), ("wb", "West Bengal")], "key string, state string")
    rows = [(1, "700019", "west bengal"), (2, "700019", "W.B."), (3, "700019", "Kerala"), (4, "999999", "Kerala"), (5, "", "Kerala"), (6, "70001", "Kerala"), (7, "411001", "MAHARASHTRA"), (8, "700019", " ")]
    df = validate.with_pin_state(spark.createDataFrame(rows, "packet_id int, pin_code string, state string"), pins, states)
    got = {r["packet_id"]: r["ok"] for r in validate.findings(df, ["state", "pin_code"]).where("validator = 'pin_matches_state'").collect()}
    assert got == {1: True, 2: True, 3: False, 7: True}


def test_erp_fields_of_both_records(spark):
    vendor = spark.createDataFrame([(1, "Acme", "India", "ABCDE1234F", "27ABCDE1234F1Z5", " ")], "id int, vendor_name string, country string, pan string, gst_no string, city string")
    body = records.payload_json(records.erp_payload(vendor, records.VENDOR_ERP)).first()["body"]
    assert body == '{"No":"","Name":"Acme","Country_Region_Code":"India","PAN_Number":"ABCDE1234F","GST_Number":"27ABCDE1234F1Z5"}'
    customer = spark.createDataFrame([(1, "Acme", "Ann", "700019", "a@b.in", "India")], "id int, company_name string, contact_name string, zip_code string, email_id_to string, country string")
    body = records.payload_json(records.erp_payload(customer, records.CUSTOMER_ERP)).first()["body"]
    assert body == '{"No":"","Name":"Acme","Contact":"Ann","Country_Region_Code":"India","Post_Code":"700019","E_Mail":"a@b.in"}'


def test_city_at_the_front_of_a_segment(spark):
    """The longest known city of one to three words; not in front of a street, not where the PIN names a district or a segment is a city."""
    states = spark.createDataFrame([("goa", "Goa")], "key string, state string")
    cities = spark.createDataFrame([("navi",), ("navimumbai",), ("noida",), ("ghazipur",), ("fourwordcityname",)], "key string")
    pins = spark.createDataFrame([("403001", "Goa", "North Goa")], "pin string, state string, district string")
    tiers = {"thoroughfare": {"tail": ["road"]}, "locality": {"head": ["sector"]}}
    rows = {
        "Flat 2, NOIDA SECTOR 62": ("Flat 2, SECTOR 62", "Noida"),
        "NAVI MUMBAI SECTOR 9, Old House": ("SECTOR 9, Old House", "Navi Mumbai"),
        "GHAZIPUR ROAD, Lane 3": ("GHAZIPUR ROAD, Lane 3", ""),
        "NAVI ROAD": ("NAVI ROAD", ""),
        "Noida Sector 1, Navi Pocket": ("Noida Sector 1, Pocket", "Navi"),
        "NOIDA SECTOR 62, Ghazipur": ("NOIDA SECTOR 62", "Ghazipur"),
        "NOIDA SECTOR 62 403001": ("NOIDA SECTOR 62", "North Goa"),
        "FOUR WORD CITY NAME x": ("FOUR WORD CITY NAME x", ""),
        "NOIDA": ("", "Noida"),
    }
    df = spark.createDataFrame(list(enumerate(rows)), "id int, address string")
    got = {r["id"]: (r["address_1"], r["city"]) for r in address.resolve(df, states, cities, pins, tiers).collect()}
    assert [got[i] for i in range(len(rows))] == list(rows.values())


def test_lines_join_to_the_single_line(spark):
    from ledgerloom.plans.queries import RUN_WORDS

    states, cities = spark.createDataFrame([("goa", "Goa")], "key string, state string"), spark.createDataFrame([("pune",)], "key string")
    texts = ["Plot 5, Lake Road, Gandhi Nagar, Pune, Goa", "Block B, Sector 9", "Pune", "", None, "x, y, z, Sector 4, a b, Pune Sector 8, Goa", "2nd Floor Wing A Lake Road Sector 5"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, address string")
    one = {r["id"]: r for r in address.resolve(df, states, cities).collect()}
    for r in address.resolve_lines(df, states, cities, None, RUN_WORDS).collect():
        lines = [r[f"address_{i}"] for i in range(1, 5) if r[f"address_{i}"]]
        assert ", ".join(lines).replace(",", "").split() == one[r["id"]]["address_1"].replace(",", "").split()
        assert (r["city"], r["state"], r["pin_code"]) == (one[r["id"]]["city"], one[r["id"]]["state"], one[r["id"]]["pin_code"])


def test_neighbours_are_counted_by_box(spark):
    """Counts by box are those of the pairs: equal boxes, flat captions that are beside themselves, unknown edges and ids. A
    page of equal boxes makes no pair of spans."""
    r, rows = random.Random(5), []
    for i in range(240):
        x, y, w, h = r.choice([0, 10, 20, 60]), r.choice([0, 2, 10, 30]), r.choice([1, 5, 30]), r.choice([1, 10])
        box = [float(x), float(y), float(x + w), float(y + h)]
        if i % 40 == 7:
            box[i % 4] = None
        rows.append((i % 3, i % 2, None if i % 50 == 9 else i, *box, 10.0, i % 4 == 0))
    df = spark.createDataFrame(rows, "doc_id long, page int, span_id long, x1 double, y1 double, x2 double, y2 double, unit double, caption boolean")
    pairs = layout.neighbours(df.where("caption"), df).groupBy("doc_id", "page", "direction", "distance_ratio").agg(F.count("*").alias("n"), F.min("b_span_id").alias("first_span"))
    want = sorted(map(tuple, pairs.collect()))
    assert len(want) > 20 and sorted(map(tuple, layout.neighbour_counts(df.where("caption"), df).collect())) == want

    many = spark.range(60_000).selectExpr("1L AS doc_id", "1 AS page", "id AS span_id", "double(id % 2 * 40) AS x1", "0d AS y1", "double(id % 2 * 40 + 30) AS x2", "8d AS y2", "8d AS unit")
    got = {r["direction"]: (r["n"], r["first_span"]) for r in layout.neighbour_counts(many, many).collect()}
    assert got == {"right": (900_000_000, 1), "left": (900_000_000, 0)}
