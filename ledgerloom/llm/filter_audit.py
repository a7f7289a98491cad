"""Operator 12: how quality filters act on one another, in every order of applying them.

Each document becomes a mask with one bit per filter that it fails. Documents are counted by part and
mask; these cells are unpivoted against all steps of all orders. A running bit-or over the steps tells which
filters failed a cell's documents before a step; conditional sums of the cells give the
counts of a step, and a window over a part's rows of one filter the total of its removals (``shapley``).

Scale: texts are read once, in place; ids, 256-bit digests and masks are shuffled. Copies of a text are told by
digest and id: the smallest id of every digest is a partial aggregation, and the join back is on digest *and* id,
so no group of copies meets in one task. Equal rows are counted before any shuffle, rows without an id are
spread by their text. Cells are at most 32 a part, whatever the number of rows, and are built where they are aggregated.

Defined results: a null text is empty, a null source the part ``''``. Without an id a document is not identical to a smaller
one, nor a smaller one, and has no labels. Repeated rows of one id are documents that are not smaller than each other. Of several
labels of one id any 1 counts. Very long texts are read whole. An empty table has no parts and gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import table

WHITE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

Filter = Callable[[Column], Column]


def _words(text: Column) -> Column:
    """The words of a text that has any; of an empty one an empty word."""
    return F.split(F.btrim(text, F.lit(WHITE)), r"[\x20\x09-\x0D]+")


def few_words(least: int) -> Filter:
    return lambda text: F.when(F.btrim(text, F.lit(WHITE)) == "", F.lit(0 < least)).otherwise(F.size(_words(text)) < least)


def repetitive(percent: int) -> Filter:
    return lambda text: F.when(F.btrim(text, F.lit(WHITE)) == "", F.lit(False)).otherwise(100 * F.size(F.array_distinct(_words(text))) < percent * F.size(_words(text)))


def shouting(percent: int) -> Filter:
    return lambda text: 100 * (F.length(text) - F.length(F.translate(text, UPPER, ""))) > percent * F.length(text)


def has_symbols(symbols: str) -> Filter:
    return lambda text: F.length(F.translate(text, symbols, "")) < F.length(text)


#: Filters that look at one text; ``E`` is the one that looks at all documents.
FILTERS: dict[str, Filter] = {"A": few_words(200), "B": repetitive(50), "C": shouting(2), "D": has_symbols("#$%&*|")}
COPY = "E"


def masks(docs: DataFrame, filters: dict[str, Filter], copy: str | None, part_col: str = "source", text_col: str = "text") -> DataFrame:
    """(doc_id, spread, part, mask, n): what each document fails, equal rows counted. ``spread`` keeps rows without an id apart."""
    rows = docs.select(F.col("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    bits = [F.when(fails(F.col("__text")), F.lit(1 << i)).otherwise(F.lit(0)) for i, fails in enumerate(filters.values())]
    own = rows.select("doc_id", "part", F.sha2("__text", 256).alias("digest"), sum(bits[1:], bits[0]).alias("mask"))
    own = own.groupBy("doc_id", "digest", "part", "mask").agg(F.count("*").alias("n"))
    if copy:
        least = own.where(F.col("doc_id").isNotNull()).groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
        own = own.join(least, ["digest", "doc_id"], "left")
        later = F.col("doc_id").isNotNull() & F.col("first").isNull()
        own = own.withColumn("mask", F.col("mask") + F.when(later, F.lit(1 << len(filters))).otherwise(F.lit(0)))
    return own.select("doc_id", F.when(F.col("doc_id").isNull(), F.col("digest")).otherwise(F.lit("")).alias("spread"), "part", "mask", "n")


def cells(docs: DataFrame, labels: DataFrame, filters: dict[str, Filter] = FILTERS, copy: str | None = COPY, part_col: str = "source", text_col: str = "text") -> DataFrame:
    """(part, mask, n, n_good, n_toxic): documents by what they fail."""
    marks = (
        labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id")
        .agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("bad")).withColumn("spread", F.lit(""))
    )
    told = masks(docs, filters, copy, part_col, text_col).join(marks, ["doc_id", "spread"], "left")
    times = lambda c: F.sum(F.col("n") * F.coalesce(F.col(c), F.lit(0)))
    return told.groupBy("part", "mask").agg(F.sum("n").alias("n"), times("good").alias("n_good"), times("bad").alias("n_toxic"))


def audit(
    docs: DataFrame, labels: DataFrame, filters: dict[str, Filter] = FILTERS, copy: str | None = COPY, part_col: str = "source", text_col: str = "text"
) -> DataFrame:
    """One row per part, order of the filters and step."""
    letters = "".join(filters) + (copy or "")
    orders = ["".join(p) for p in permutations(letters)]
    steps = (
        cells(docs, labels, filters, copy, part_col, text_col)
        .withColumn("filter_order", F.explode(F.lit(orders)))
        .select("*", F.posexplode(F.split("filter_order", "")).alias("at", "filter"))
        .withColumn("bit", F.element_at(F.create_map(*[F.lit(x) for i, f in enumerate(letters) for x in (f, 1 << i)]), F.col("filter")))
        .withColumn("failed", F.col("mask").bitwiseAND(F.col("bit")))
    )
    before = Window.partitionBy("part", "mask", "filter_order").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    steps = steps.withColumn("earlier", F.coalesce(F.bit_or("failed").over(before), F.lit(0)))
    fails, gone = F.col("failed") != 0, F.col("earlier") != 0
    total = lambda when, c="n": F.sum(F.when(when, F.col(c)).otherwise(0))
    told = steps.groupBy("part", "filter_order", (F.col("at") + 1).alias("step"), "filter").agg(
        total(~fails & ~gone).alias("kept"),
        total(fails & ~gone).alias("removed"),
        total(fails & gone).alias("redundant"),
        total(F.col("mask") == F.col("bit")).alias("unique_fails"),
        total(fails & ~gone, "n_good").alias("good_lost"),
        total(fails & ~gone, "n_toxic").alias("toxic_lost"),
    )
    return told.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter")))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five filters over all documents, by source, in all 120 orders."""
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("filter")


OP12_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS least FROM t),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(bad, 0) AS bad,
    CASE WHEN len(words) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN coalesce(w.doc_id > least, false) THEN 'E' ELSE '' END AS fails
  FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(bad) AS bad FROM f GROUP BY part, fails),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS v),
o AS (
  SELECT a.v || b.v || c.v || d.v || e.v AS filter_order FROM x a, x b, x c, x d, x e
  WHERE len(list_distinct([a.v, b.v, c.v, d.v, e.v])) = 5),
s AS (SELECT filter_order, unnest(generate_series(1, 5)) AS step FROM o),
j AS (
  SELECT part, fails, n, good, bad, filter_order, step, substr(filter_order, CAST(step AS INT), 1) AS filter,
    contains(fails, substr(filter_order, CAST(step AS INT), 1)) AS here,
    step > 1 AND length(translate(fails, substr(filter_order, 1, CAST(step AS INT) - 1), '')) < length(fails) AS gone
  FROM c, s),
r AS (
  SELECT part, filter_order, step, filter,
    coalesce(sum(n) FILTER (WHERE NOT here AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (WHERE here AND NOT gone), 0) AS removed,
    coalesce(sum(n) FILTER (WHERE here AND gone), 0) AS redundant, coalesce(sum(n) FILTER (WHERE fails = filter), 0) AS unique_fails,
    coalesce(sum(good) FILTER (WHERE here AND NOT gone), 0) AS good_lost, coalesce(sum(bad) FILTER (WHERE here AND NOT gone), 0) AS toxic_lost
  FROM j GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley
FROM r
"""
