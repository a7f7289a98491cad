"""Operator 6: document fingerprints by one-permutation MinHash.

Every word shingle is hashed once; the upper bits choose one of ``BINS`` bins and each bin keeps
its smallest hash. An empty bin copies a filled one, the first in its own random sequence of
bins (optimal densification: the sequence is the same for every document, so equal sets of
filled bins copy alike). Of each bin the low eight bits are stored, as hex digits. Of unequal
bins a share 1 / 256 agrees by chance; ``likeness`` corrects for this.

Only Spark expressions: the smallest hash of a bin is the first of its bin in the sorted
hashes. Fingerprints need no shuffle. The query's next document needs one: rows are cut into ranges of
the order (id, then a hash of the text) that begin at sampled rows, so ranges hold about equally many rows
however ids are spread, and one id with very many texts fills several ranges. A row that begins a
range is also sent to the range before, so no range's first rows ever meet in one place and no text
is broadcast. Only the beginnings (two numbers each, ``MOST_RANGES`` at most) pass the driver.

Defined results: null texts count as empty; a text without words has the empty
fingerprint, alike (1) to itself and unlike (0) any other; a text with fewer words than a
shingle has its word sequence as its one shingle. Letter case and the kind of white space
do not matter. Equal ids are ordered by a hash of the text, then by text; null ids come first; repeated
rows are documents of their own. Very long texts are read whole. Extra columns are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import table

BINS, BIN_BITS, LOW, TRIES = 128, 7, 256, 6
RANGE_ROWS = 512
MOST_RANGES = 100_000
PER_RANGE = 4  # sampled rows for each range
TASK_BYTES = 64 << 20


def shingle_hashes(text: Column, words: int) -> Column:
    """Sorted hashes of the shingles of ``words`` words."""
    tokens = F.split(F.lower(F.btrim(text, F.lit(" \t\n\r\f\x0b"))), "[ \t\n\r\f\x0b]+")
    return F.transform(
        F.array(tokens),
        lambda t: F.sort_array(F.transform(F.sequence(F.lit(1), F.greatest(F.size(t) - (words - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(t, i, words)))),
    )[0]


def bin_of(h: Column) -> Column:
    return F.shiftrightunsigned(h, 64 - BIN_BITS)


def signature(text: Column, words: int = 5) -> Column:
    """The low bits of every bin, array<int> of BINS numbers; empty for a text without words."""

    def first_of_bins(hashes: Column) -> Column:
        return F.filter(hashes, lambda h, i: (i == 0) | (bin_of(h) != bin_of(F.get(hashes, i - 1))))

    def slotted(mins: Column) -> Column:
        """The smallest hashes with their place: ``slots`` has one entry per bin, null where it is empty."""
        return F.transform(
            F.array(F.transform(mins, bin_of)),
            lambda bins: F.struct(
                mins.alias("mins"),
                F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda j: F.get(mins, F.array_position(bins, j.cast("long")).cast("int") - 1)).alias("slots"),
            ),
        )[0]

    def filled(own: Column) -> Column:
        """Every empty bin takes the first filled one of its random sequence of bins; where ``TRIES``
        numbers of that sequence are empty too, the filled one that comes first in a random order."""

        def attempt(j: Column, t: int) -> Column:
            return F.get(own["slots"], F.pmod(F.xxhash64(j, F.lit(t)), F.lit(BINS)).cast("int"))

        return F.transform(
            own["slots"],
            lambda x, j: F.coalesce(
                x,
                *[attempt(j, t) for t in range(TRIES)],
                F.array_min(F.transform(own["mins"], lambda h: F.struct(F.xxhash64(j, bin_of(h)).alias("order"), h.alias("h"))))["h"],
            ),
        )

    blank = F.btrim(text, F.lit(" \t\n\r\f\x0b")) == ""
    # transform() over an array of one element gives its value a name, so that it is computed once.
    low = F.transform(F.transform(F.array(shingle_hashes(text, words)), first_of_bins), slotted)
    bits = F.transform(F.transform(low, filled)[0], lambda h: h.bitwiseAND(F.lit(LOW - 1)).cast("int"))
    return F.when(blank, F.array().cast("array<int>")).otherwise(bits)


def packed(sig: Column) -> Column:
    """The stored form: two hex digits a bin."""
    return F.array_join(F.transform(sig, lambda x: F.lpad(F.lower(F.hex(x.cast("long"))), 2, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two signatures, corrected for chance agreement of the low bits."""
    agree = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same)) / F.lit(float(BINS))
    chance = 1.0 / LOW
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(
        F.greatest(F.lit(0.0), (agree - chance) / (1 - chance))
    )


def fingerprint(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5) -> DataFrame:
    """(doc_id, fingerprint): one map over the documents."""
    return docs.select(F.col(id_col), packed(signature(F.coalesce(F.col(text_col), F.lit("")), words)).alias("fingerprint"))


def beginnings(keys: DataFrame, rows: int, range_rows: int) -> list[tuple[int | None, int]]:
    """The first (id, hash) of every range: the smallest of all rows, and rows at equal steps of a hashed sample."""
    ranges = min(MOST_RANGES, max(1, -(-rows // range_rows)))
    first = keys.agg(F.min("key").alias("k")).first()["k"]
    cut = min(2**31, max(1, 2**31 * PER_RANGE * ranges // max(rows, 1)))
    some = keys.where(F.pmod(F.xxhash64("key", F.lit("range")), F.lit(2**31)) < F.lit(cut)) if cut < 2**31 else keys
    own = some.select("key.id", "key.h").distinct().orderBy(F.col("id").asc_nulls_first(), "h").toArrow()
    step = max(1, own.num_rows // ranges)
    starts = list(zip(own["id"].to_pylist()[::step], own["h"].to_pylist()[::step], strict=True))
    return [(first["id"], first["h"])] + [x for x in starts if x != (first["id"], first["h"])]


def with_next(docs: DataFrame, *, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(doc_id, text, sig, next_text, next_sig): every document with the next one by id, the last with the first."""
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.struct(F.col("doc_id").cast("long").alias("id"), F.xxhash64(text).alias("h")).alias("key"))
    rows, size = keyed.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    if not rows:
        return keyed.select("doc_id", "text", signature(F.col("text")).alias("sig"), F.col("text").alias("next_text"), signature(F.col("text")).alias("next_sig"))
    starts = beginnings(keyed.select("key"), rows, range_rows)
    numbers = lambda xs: F.split(F.lit(",".join(map(str, xs))), ",").cast("array<bigint>")  # noqa: E731  a constant to Spark
    given, ids, hashes = numbers([int(i is not None) for i, _ in starts]), numbers([i or 0 for i, _ in starts]), numbers([h for _, h in starts])
    own = F.struct(F.col("key.id").isNotNull().cast("long").alias("g"), F.coalesce("key.id", F.lit(0).cast("long")).alias("i"), F.col("key.h").alias("h"))
    begin = lambda at: F.struct(F.get(given, at).alias("g"), F.get(ids, at).alias("i"), F.get(hashes, at).alias("h"))
    # The last range whose beginning is not after the row, by halving (the first range begins with the smallest row).
    halves = F.sequence(F.lit(1), F.lit(max(1, len(starts).bit_length())))

    def halved(acc: Column, _: Column) -> Column:
        mid = F.floor((acc["lo"] + acc["hi"] + 1) / 2).cast("int")
        below = begin(mid) <= own
        return F.struct(F.when(below, mid).otherwise(acc["lo"]).alias("lo"), F.when(below, acc["hi"]).otherwise(mid - 1).alias("hi"))

    r = F.aggregate(halves, F.struct(F.lit(0).alias("lo"), F.lit(len(starts) - 1).alias("hi")), halved, lambda acc: acc["lo"])
    before = F.when(F.col("r") == 0, len(starts) - 1).otherwise(F.col("r") - 1)
    places = F.array(F.struct(F.col("r").alias("r"), F.lit(False).alias("tail")), F.when(begin(F.col("r")) == own, F.struct(before.alias("r"), F.lit(True).alias("tail"))))
    dealt = keyed.withColumn("r", r).withColumn("place", F.explode(F.array_compact(places))).select("doc_id", "text", "key", "place.r", "place.tail")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(size or 0) // TASK_BYTES))
    w = Window.partitionBy("r").orderBy("tail", F.col("key.id").asc_nulls_first(), "key.h", "text")
    return (
        dealt.repartition(parts, "r")
        .withColumn("sig", signature(F.col("text")))
        .withColumn("next_text", F.lead("text").over(w))
        .withColumn("next_sig", F.lead("sig").over(w))
        .where("not tail")
        .select("doc_id", "text", "sig", "next_text", "next_sig")
    )


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of its edited form, and how alike they and the next one's are."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - cut), F.substring("next_text", F.lit(1), cut))
    return (
        with_next(docs)
        .withColumn("edited", edited)
        .withColumn("edited_sig", signature(F.col("edited")))
        .select(
            "doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), packed(F.col("sig")).alias("fingerprint"),
            packed(F.col("edited_sig")).alias("edited_fingerprint"), likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"),
            likeness(F.col("sig"), F.col("next_sig")).alias("near_next"),
        )
    )
