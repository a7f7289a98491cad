"""Partial alignment of batches against all windows one by one; captions in values and labels as values."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import alignment as A
from ledgerloom.operators import captions, classify

RND = random.Random(11)
ALPHABET = "ab cé–"


def strings(n, longest, alphabet=ALPHABET):
    return ["".join(RND.choice(alphabet) for _ in range(RND.randrange(longest))) for _ in range(n)]


@pytest.mark.parametrize("least", [0.0, 0.5, 0.82, 1.0])
def test_all_windows(least):
    texts = [*strings(60, 40), "", "a", "x" * 90, "abc" * 30, "日本 abc"]
    batch = A.Texts(texts)
    for needle in [*strings(12, 14), "a", "abc" * 21, "abc" * 22, "permanent account number"]:
        if not needle:
            continue
        whole, (score, lo, hi) = batch.ratios(needle, least), batch.partial(needle, least)
        for i, text in enumerate(texts):
            right = A.ratio(needle, text)
            assert whole[i] == right if right >= least and text else whole[i] <= right
            if len(text) <= len(needle):
                assert score[i] == 0
                continue
            want = A.best_window(needle, text)
            got = (score[i], lo[i], hi[i])
            assert got == want if want[0] >= least and want[0] > 0 else got[0] <= want[0]


def test_labels_and_their_pieces():
    labels = [x for x in strings(20, 16, "abc ") if x]
    texts = strings(80, 20, "abc ")
    for least_chars in (0, 5):
        got = A.like_any(texts, labels, 0.88, 0.9, least_chars)
        long = [x for x in labels if len(x) >= max(1, least_chars)]
        want = [len(t) >= max(1, least_chars) and any(A.ratio(t, x) >= 0.88 or A.partial_ratio(t, x) >= 0.9 for x in long) for t in texts]
        assert got.tolist() == want
    assert A.partial_ratio("principal place", "address of principal place of business") == 1.0 == A.partial_ratio("address of principal place of business", "principal place")


def slow_caption(text, clean, own, pattern, base):
    """The field's best caption, each window compared on its own."""
    return captions.caption_of(text, own, [(A.ratio(clean, c), *A.best_window(c, text.lower())) for c in own], pattern, base)


def test_captions_of_a_batch():
    own = ["legal name", "name", "name of enterprise", "pan"]
    texts = [t for c in own for t in (c, c.upper() + ": Acme", c[:-1] + " - x", "see " + c + ": y", c + " of it", "." + c + ".: z", c + " No. 3")] + strings(50, 30, "legan m:of")
    texts = [t.strip() for t in texts if t.strip()]
    cleans = [t.lower().rstrip(": ") for t in texts]
    got = dict(captions.captions_of(texts, cleans, own, None, 0.82))
    want = {i: hit for i, (t, c) in enumerate(zip(texts, cleans)) if (hit := slow_caption(t, c, own, None, 0.82))}
    assert got == want and len(got) > 8


def test_own_captions_go(spark):
    own = {"address_1": ["Building No./Flat No.", "Flat No", "Address of Principal Place of"], "pan": ["PAN"]}
    rows = [
        ("address_1", "Building No./Flat No.: 1ST FLOOR", "1ST FLOOR"),
        ("address_1", "Address of Principal Place of: Bui1ding No./Flat No.: Plot 9", "Plot 9"),
        ("address_1", "FLAT NO. 302, BLOCK C", "FLAT NO. 302, BLOCK C"),
        ("address_1", "Flat Nature: x", "Flat Nature: x"),
        ("pan", "PAN ABCDE1234F", "ABCDE1234F"),
        ("pan", "PAN card holder", "PAN card holder"),
        ("city", "City: Pune", "City: Pune"),
        ("pan", None, None),
        ("pan", "", ""),
    ]
    df = spark.createDataFrame(rows, "f string, v string, want string")
    got = df.select("v", "want", captions.own_captions_removed(F.col("f"), F.col("v"), own, {"pan": "[A-Z]{5}[0-9]{4}[A-Z]"}).alias("got")).collect()
    assert [(r["v"], r["got"]) for r in got] == [(r["v"], r["want"]) for r in got]


def test_label_like_and_leaks(spark):
    labels = ["legal name of business", "trade name", "address of principal place of business"]
    df = spark.createDataFrame([("legal narne of business",), ("principal place of busines",), ("trade nam",), ("acme trading",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(A.is_label_like(F.col("t"), labels)).collect()] == [True, False, True, False, False, False]
    assert [r[0] for r in df.select(classify.caption_leak(F.col("t"), labels, ["type"], ["micro"])).collect()] == [True, True, True, False, False, False]
