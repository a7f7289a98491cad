"""Column builders for normalising, matching and comparing field values.

All are expressions over built-in functions, so they stay inside code generation. White space
and digits follow Unicode, as in the data model; a null value normalises to the empty string.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Legal-form phrases, corporate suffixes with their spelling, free mail domains, column widths of the ERP.
LEGAL_PHRASES = (
    "private limited company", "public limited company", "one person company", "limited liability partnership", "private limited",
    "public limited", "partnership firm", "sole proprietorship", "proprietorship firm", "proprietorship", "partnership",
    "hindu undivided family", "co operative society", "cooperative society", "trust", "society", "government", "limited",
)
SUFFIX_SPELLING = {
    "pvt": "PVT", "pvtltd": "PVT LTD", "ltd": "LTD", "limited": "LIMITED", "private": "PRIVATE", "privatelimited": "PRIVATE LIMITED",
    "llp": "LLP", "opc": "OPC", "plc": "PLC", "company": "COMPANY", "co": "CO", "corporation": "CORPORATION", "corp": "CORP",
    "incorporated": "INCORPORATED", "inc": "INC", "enterprises": "ENTERPRISES", "enterprise": "ENTERPRISE", "industries": "INDUSTRIES", "udyog": "UDYOG",
}
GLUED_SUFFIXES = (
    "privatelimited", "private", "limited", "pvtltd", "pvt", "ltd", "llp", "opc", "plc", "company", "corporation", "corp", "incorporated",
    "enterprises", "enterprise", "industries",
)
FREE_MAIL = (
    "gmail.com", "googlemail.com", "yahoo.com", "yahoo.co.in", "yahoo.in", "hotmail.com", "outlook.com", "live.com", "msn.com", "rediffmail.com",
    "rediff.com", "sify.com", "vsnl.net", "vsnl.com", "bsnl.in", "airtelmail.in", "icloud.com", "me.com", "aol.com", "protonmail.com", "proton.me",
    "zoho.com", "yandex.com", "mail.com",
)
ERP_WIDTHS = {
    "Name": 50, "Address": 50, "Address_2": 50, "City": 30, "County": 30, "Contact": 50, "Phone_No": 30, "MobilePhoneNo": 30, "E_Mail": 80,
    "Home_Page": 80, "Post_Code": 20, "PAN_Number": 20, "GST_Number": 20,
}
STEM_LEAST = 4

Normaliser = Callable[[Column], Column]


def strip(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)\A\s+|\s+\z", "")


def collapse_spaces(x: Column) -> Column:
    return strip(F.regexp_replace(x, r"(?U)\s+", " "))


def remove_spaces(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)\s+", "")


def titlecase(x: Column) -> Column:
    """Every space-separated token: first letter upper, the rest lower."""
    return F.array_join(F.transform(F.split(x, " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30)))), " ")


def digits_only(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)\D", "")


def strip_country_code(x: Column) -> Column:
    return F.regexp_replace(x, r"\A(?:\+?91)[\s\-]?(?=[6-9][0-9]{9}\z)", "")


def fix_ifsc(x: Column) -> Column:
    """Repairs look-alike characters of an 11-character bank code; other lengths stay."""
    up = F.upper(x)
    fixed = F.concat(F.translate(F.substring(up, 1, 4), "015826", "OISBZG"), F.lit("0"), F.substring(up, 6, 6))
    return F.when(F.length(x) == 11, fixed).otherwise(x)


def expand_known_phrase(x: Column) -> Column:
    squashed = {p.replace(" ", ""): p for p in LEGAL_PHRASES}
    known = F.create_map(*[F.lit(v) for kv in squashed.items() for v in kv])
    return F.coalesce(F.try_element_at(known, F.lower(remove_spaces(x))), x)


def split_corporate_suffix(x: Column) -> Column:
    """Spaced names get their trailing suffix words spelt the standard way; from a single glued word
    known suffixes are peeled while a stem of STEM_LEAST letters is left."""
    spelling = F.create_map(*[F.lit(v) for kv in SUFFIX_SPELLING.items() for v in kv])
    words = F.filter(F.split(x, r"(?U)\s+"), lambda w: w != "")
    spaced = F.aggregate(
        F.reverse(words),
        F.struct(F.lit(True).alias("tail"), F.array().cast("array<string>").alias("out")),
        lambda acc, w: F.struct(
            (acc["tail"] & F.try_element_at(spelling, F.lower(w)).isNotNull()).alias("tail"),
            F.array_prepend(acc["out"], F.when(acc["tail"], F.coalesce(F.try_element_at(spelling, F.lower(w)), w)).otherwise(w)).alias("out"),
        ),
        lambda acc: F.when(F.size(acc["out"]) > 0, F.array_join(acc["out"], " ")).otherwise(x),
    )
    pattern = r"(?i)\A(.{%d,}?)(%s)\z" % (STEM_LEAST, "|".join(sorted(GLUED_SUFFIXES, key=len, reverse=True)))
    # The shortest stem is found by the longest suffix; a name has few suffixes, and each step removes at least three letters.
    glued = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.floor(F.length(x) / 3).cast("int"))),
        F.struct(x.alias("stem"), F.array().cast("array<string>").alias("out")),
        lambda acc, _: F.when(
            acc["stem"].rlike(pattern),
            F.struct(
                F.regexp_extract(acc["stem"], pattern, 1).alias("stem"),
                F.array_prepend(acc["out"], F.try_element_at(spelling, F.lower(F.regexp_extract(acc["stem"], pattern, 2)))).alias("out"),
            ),
        ).otherwise(acc),
        lambda acc: F.array_join(F.array_prepend(acc["out"], acc["stem"]), " "),
    )
    return F.when(F.contains(strip(x), F.lit(" ")) | (x == ""), spaced).otherwise(glued)


NORMALISERS: dict[str, Normaliser] = {
    "strip": strip, "collapse_spaces": collapse_spaces, "remove_spaces": remove_spaces, "uppercase": F.upper, "lowercase": F.lower, "titlecase": titlecase,
    "digits_only": digits_only, "strip_country_code": strip_country_code, "fix_ifsc_confusions": fix_ifsc, "expand_known_phrase": expand_known_phrase,
    "split_corporate_suffix": split_corporate_suffix,
}


def normalise(x: Column, ops: list[str]) -> Column:
    """The named normalisers in turn; an unknown name raises KeyError before anything runs."""
    x = F.coalesce(x, F.lit(""))
    for op in ops:
        x = NORMALISERS[op](x)
    return x


def clean_label(x: Column) -> Column:
    return F.lower(collapse_spaces(F.regexp_replace(strip(x), r"(?U)\A[\s\-:.|*]+|[\s\-:.|*]+\z", "")))


def strip_value_prefix(x: Column) -> Column:
    return strip(F.regexp_replace(x, r"(?U)\A[\s:\-–—=|.,)#]+", ""))


def lookup_key(x: Column) -> Column:
    return F.regexp_replace(F.lower(x), "[^a-z0-9]", "")


def full_match(x: Column, patterns: list[str]) -> Column:
    """Whether any pattern covers the whole value; without patterns everything matches."""
    return x.rlike(r"\A(?:" + "|".join(f"(?:{p})" for p in patterns) + r")\z") if patterns else F.lit(True)


def guarded(pattern: str) -> str:
    """The pattern where no letter or digit touches it."""
    return rf"(?<![A-Za-z0-9])(?:{pattern})(?![A-Za-z0-9])"


def find_matches(x: Column, patterns: list[str]) -> Column:
    """All guarded matches, pattern by pattern; if there are none, unguarded ones of five letters or more."""
    found = F.flatten(F.array(*[F.regexp_extract_all(x, F.lit(guarded(p)), F.lit(0)) for p in patterns]))
    loose = F.filter(
        F.flatten(F.array(*[F.regexp_extract_all(x, F.lit(p), F.lit(0)) for p in patterns])), lambda m: F.replace(m, F.lit(" "), F.lit("")).rlike(r"(?U)\A\p{L}{5,}\z")
    )
    return F.when(F.size(found) > 0, found).otherwise(loose)


def canonicalise(x: Column, aliases: list[tuple[str, str]]) -> Column:
    """The name of the first alias pattern found in the value, else the value."""
    out = x
    for pattern, name in reversed(aliases):
        out = F.when(x.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def website_of(email: Column) -> Column:
    """www.<domain> of an e-mail; null without a dotted domain or for free mail providers."""
    domain = F.regexp_replace(strip(F.regexp_extract(F.lower(strip(email)), r"\A[^@]*@([\s\S]*)\z", 1)), r"\A\.+|\.+\z", "")
    return F.when(F.contains(domain, F.lit(".")) & ~domain.isin(*FREE_MAIL), F.concat(F.lit("www."), domain))


def fit_width(x: Column, width: int) -> Column:
    """The value cut to ``width`` at the last space inside it, without a trailing separator."""
    head = F.substring(x, 1, width)
    cut = F.when(head.rlike(r"(?s)\A.+ "), F.regexp_replace(F.regexp_replace(head, r"(?s) [^ ]*\z", ""), r"\s+\z", "")).otherwise(head)
    cut = F.regexp_replace(F.regexp_replace(cut, r"[,;]+\z", ""), r"\s+\z", "")
    return F.when(F.length(x) <= width, x).otherwise(F.coalesce(F.nullif(cut, F.lit("")), head))


def compare_cell(x: Column) -> Column:
    """Cell values as they are compared: trimmed, whole numbers without ``.0``, lower case."""
    return F.lower(F.regexp_replace(strip(F.coalesce(x, F.lit(""))), r"\A([0-9]+)\.0\z", "$1"))


def compare_truth(x: Column, exact: Column) -> Column:
    """Truth values as they are compared: identifiers exactly, other text without punctuation."""
    t = F.regexp_replace(strip(F.coalesce(x, F.lit(""))), r"\A([0-9]+)\.0\z", "$1")
    return F.when(exact, F.replace(F.upper(t), F.lit(" "), F.lit(""))).otherwise(F.lower(collapse_spaces(F.regexp_replace(t, r"[^\w\s]", " "))))


def common_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence, row by row of the dynamic programme. For short texts."""
    bs = F.split(b, "")
    zero = F.transform(F.sequence(F.lit(0), F.length(b)), lambda i: F.lit(0))

    def row(prev: Column, ch: Column) -> Column:
        return F.aggregate(
            F.sequence(F.lit(1), F.length(b)),
            F.array(F.lit(0)),
            lambda cur, j: F.array_append(cur, F.when(F.get(bs, j - 1) == ch, F.get(prev, j - 1) + 1).otherwise(F.greatest(F.get(prev, j), F.get(cur, j - 1)))),
        )

    return F.when((a == "") | (b == ""), 0).otherwise(F.aggregate(F.split(a, ""), zero, row, lambda last: F.element_at(last, -1)))


def similarity(a: Column, b: Column, at_least: float = 0.0) -> Column:
    """200 * common / (length sum), 0 to 100; pairs whose lengths rule out ``at_least`` are not compared (0)."""
    total = F.length(a) + F.length(b)
    possible = 200.0 * F.least(F.length(a), F.length(b)) >= at_least * total
    return F.when(total == 0, 100.0).when(~possible, 0.0).otherwise(200.0 * common_length(a, b) / total)
