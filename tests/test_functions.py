import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import text as T
from ledgerloom.operators import validate as V


def apply(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("x"))).collect()]


@pytest.mark.parametrize(
    ("op", "value", "want"),
    [
        ("strip", "  a b \t", "a b"), ("collapse_spaces", " a \n b ", "a b"), ("remove_spaces", "a  b", "ab"), ("titlecase", "M.B.CONTROL pvt", "M.b.control Pvt"),
        ("digits_only", "+91-98 7", "91987"), ("strip_country_code", "+91 9876543210", "9876543210"), ("strip_country_code", "911234567890", "911234567890"),
        ("fix_ifsc_confusions", "5b1no123456", "SBIN0123456"), ("fix_ifsc_confusions", "short", "short"), ("expand_known_phrase", "PRIVATELIMITEDCOMPANY", "private limited company"),
        ("expand_known_phrase", "Other", "Other"), ("split_corporate_suffix", "ORBITLOGISTICSPVTLTD", "ORBITLOGISTICS PVT LTD"), ("split_corporate_suffix", "Orbit Works pvt ltd", "Orbit Works PVT LTD"),
        ("split_corporate_suffix", "AMCO", "AMCO"), ("split_corporate_suffix", "ltdltdltd", "ltdltd LTD"), ("strip", None, ""),
    ],
)
def test_normalisers(spark, op, value, want):
    assert apply(spark, [value], lambda x: T.normalise(x, [op])) == [want]


def test_unknown_normaliser_fails_early():
    with pytest.raises(KeyError):
        T.normalise(F.lit("x"), ["no_such_op"])


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b, 1):
            new.append(row[j - 1] + 1 if x == y else max(row[j], new[-1]))
        row = new
    return row[-1]


def test_similarity(spark):
    pairs = [("pin code", "pin  c0de"), ("abc", "abc"), ("kitten", "sitting"), ("", "x"), ("", ""), ("é", "e")]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = [r[0] for r in df.select(T.similarity(F.col("a"), F.col("b"))).collect()]
    want = [200 * lcs(a, b) / (len(a) + len(b)) if a or b else 100.0 for a, b in pairs]
    assert got == pytest.approx(want)


def test_guarded_matches(spark):
    digits = lambda x: T.find_matches(x, ["[0-9]{9,18}"])
    assert apply(spark, ["a 123456789 123456789, x987654321", "no"], digits) == [["123456789", "123456789"], []]


def test_full_match_is_not_fooled_by_a_final_newline(spark):
    assert apply(spark, ["ABCDE1234F", "ABCDE1234F\n"], lambda x: T.full_match(x, ["[A-Z]{5}[0-9]{4}[A-Z]"])) == [True, False]


@pytest.mark.parametrize(("email", "want"), [("a@b.co.in", "www.b.co.in"), ("a@GMAIL.com", None), ("a@local", None), ("none", None), ("x@.y.org.", "www.y.org")])
def test_website(spark, email, want):
    assert apply(spark, [email], T.website_of) == [want]


@pytest.mark.parametrize(("x", "w", "want"), [("short", 10, "short"), ("alpha beta gamma", 11, "alpha beta"), ("abcdefghij", 4, "abcd"), ("alpha, beta", 7, "alpha"), ("ab  cd", 4, "ab")])
def test_fit_width(spark, x, w, want):
    assert apply(spark, [x], lambda c: T.fit_width(c, w)) == [want]


def test_sixteen_rules():
    assert len(V.RULES) == 16
