"""Address segmentation against a plain reading of its rules, and its invariants."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import segments as S
from ledgerloom.plans.queries import KEYWORDS, PIECES


def run(spark, rows, kw=KEYWORDS):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "id int, segments array<string>")
    return {r["id"]: r for r in S.lines(df, kw).collect()}


def merged(frags, cap, cut_at=50):
    """Cuts by strength, then the weakest groups joined one by one."""

    def gap(a, b):
        step = b["level"] - a["level"]
        s = 50 if step == 1 else 60 if step > 1 else 0 if step == 0 else 20 if a["level"] <= 2 and b["level"] <= 2 else 40
        return max(0, s + (20 if a["tier"] != b["tier"] else 0) - (15 if a["injected"] or b["injected"] else 0))

    groups = [[frags[0]]]
    for a, b in zip(frags, frags[1:], strict=False):
        if gap(a, b) >= cut_at:
            groups.append([b])
        else:
            groups[-1].append(b)
    kept = None
    run_ = 0
    for f in reversed(groups[-1]):
        if f["level"] < 4:
            break
        run_ += 1
    if cap > 2 and len(groups) > 1 and run_ >= 4:
        cap = min(cap, 3)
        last = groups.pop()
        groups += [last[:-1], last[-1:]]
        kept = id(groups[-1])
    while len(groups) > cap:
        weak = min((i for i in range(len(groups) - 1) if id(groups[i + 1]) != kept), key=lambda i: (gap(groups[i][-1], groups[i + 1][0]), i))
        groups[weak : weak + 2] = [groups[weak] + groups[weak + 1]]
    return [", ".join(f["text"] for f in g) for g in groups]


def test_lines_against_merging_one_by_one(spark):
    rng = random.Random(5)
    rows = [[rng.choice(PIECES) for _ in range(rng.randint(2, 9))] for _ in range(300)]
    rows += [["Plot 7", "MG Road", *[rng.choice(("Andul", "Gandhi Nagar")) for _ in range(n)]] for n in range(2, 8)]
    for i, r in run(spark, rows).items():
        mean = sum(f["conf"] for f in r["fragments"]) / len(r["fragments"])
        cap = 4 if mean >= 70 else 3 if mean >= 45 else 2
        assert r["lines"] == merged(r["fragments"], cap), rows[i]
        assert ", ".join(r["lines"]) == ", ".join(rows[i]) and 1 <= len(r["lines"]) <= 4
        assert r["line_score"] == pytest.approx(mean / 100, abs=6e-4)


def test_kind_depends_on_the_fragment_only(spark):
    rows = [[p, "Andul"] for p in PIECES] + [["Andul", p] for p in PIECES]
    found = run(spark, rows)
    first = [(found[i]["fragments"][0]["tier"], found[i]["fragments"][0]["conf"]) for i in range(len(PIECES))]
    last = [(found[i + len(PIECES)]["fragments"][1]["tier"], found[i + len(PIECES)]["fragments"][1]["conf"]) for i in range(len(PIECES))]
    assert first == last
    assert dict(zip(PIECES, first, strict=True))["Near Lake Road"] == ("landmark", 50)


def test_text_without_commas_is_cut_at_key_words(spark):
    rows = [["Plot 7 Block B Sunrise Building MG Road Andul"], ["Park Tower Road East Side"], ["Plot 7"], ["Unit B 12 floor x y"], ["see the plot 4 there now"]]
    found = run(spark, rows)
    texts = [[f["text"] for f in found[i]["fragments"]] for i in range(len(rows))]
    assert texts[0] == ["Plot 7", "Block B", "Sunrise Building", "MG Road", "Andul"]
    assert texts[1] == ["Park Tower Road", "East Side"]  # words that end a fragment are not cut from one another
    assert texts[2] == ["Plot 7"]
    assert texts[4] == ["see the plot 4", "there now"]  # a connector holds on to the word after it
    for i, r in enumerate(rows):
        assert " ".join(texts[i]) == r[0]
        assert not found[i]["fragments"][0]["injected"] or found[i]["line_confidence"] != "high"


def test_empty_text_and_no_key_words(spark):
    rows = [[], ["", None, "  "], None, ["Plot 7", "MG Road"]]
    found = run(spark, rows)
    assert [found[i]["lines"] for i in range(3)] == [[], [], []] and {found[i]["line_confidence"] for i in range(3)} == {"low"}
    plain = run(spark, rows, S.Keywords({}))
    assert plain[3]["lines"] == ["Plot 7, MG Road"] and plain[3]["line_confidence"] == "medium"
    cols = spark.createDataFrame([(["a", "b"],)], "lines array<string>")
    assert S.address_columns(cols).select("address_1", "address_2", "address_3", "address_4").first() == ("a", "b", "", "")


def test_long_addresses_stay_whole(spark):
    long = [f"Plot {i}" if i % 3 else f"Area{i} Nagar" for i in range(2000)]
    got = run(spark, [long])[0]
    assert ", ".join(got["lines"]) == ", ".join(long) and len(got["lines"]) <= 4


def test_back_fill_keeps_what_was_captioned(spark):
    cols = "packet_id int, address_1 string, address_2 string, address_3 string, address_4 string, city string, state string, pin_code string"
    packets = spark.createDataFrame(
        [(1, "Plot 1, Pune", "noise", "", "", "Nashik", "", "970072", "pattern_only", 0.9), (2, "Gate", "", "", "", "", "", "", None, None), (3, "Plot 2, Pune", "", "", "", "Pune", "Goa", "403001", "inline", 0.9),
         (4, None, None, None, None, None, None, None, None, None)], cols + ", pin_kind string, pin_confidence double")
    resolved = spark.createDataFrame([(i, "Plot 1", "Area", "", "", "Pune", "Goa", "") for i in (1, 2, 3, 4)], cols)
    got = {r["packet_id"]: r for r in S.back_fill(packets, resolved).collect()}
    assert tuple(got[1])[1:8] == ("Plot 1", "Area", "", "", "Nashik", "Goa", "") and got[1]["resolved_fields"] == ["address_2", "state"]
    assert [got[i]["resolved_fields"] for i in (2, 3, 4)] == [[], [], []]
    assert got[3]["pin_code"] == "403001" and got[2]["address_1"] == "Gate"


def test_no_shuffle(spark):
    df = spark.range(10).select(F.array(F.lit("Plot 7"), F.lit("MG Road")).alias("segments"))
    assert "Exchange" not in S.lines(df, KEYWORDS)._jdf.queryExecution().executedPlan().toString()
