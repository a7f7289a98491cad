"""Operator 8: mixing sources to target weights by Pfair scheduling.

Each source's documents, in hashed order, are cut into blocks. With integer target
weights a_i that sum to Q, block k of source i (from 0) is released at slot
floor(k * Q / a_i) and due by slot ceil((k + 1) * Q / a_i). Earliest-deadline-first over
released blocks fills every slot and stays less than one block from the target share
at every slot. The schedule repeats after Q slots, so one cycle is computed (a fold
over Q slots) and every block finds its slot by arithmetic.

Every document is kept, once. When a source has no blocks left, a new phase
begins, in which the sources that remain share the slots by their weights.

Only DataFrame functions are used. A hot source is numbered in ranges of its hash (some
hundred rows each), so that no task gets a whole source; the hash is of the key and of the row, so
one key (or null) on very many different rows is spread too. The plan has one row per
source and is broadcast only up to ``BROADCAST_SOURCES`` of them. The fold costs
sources x Q steps per phase, and there are at most as many phases as sources, one task each: it is
meant for up to some hundred sources (README has figures).

Defined results: a null source is a source of its own; sources without a weight get
weight 1; ties in the hashed order go by ``key_col``; repeated rows are documents of their
own; texts, of any length, are not read; an empty table gives no rows. Extra columns pass through, whatever
their names; columns named mix_phase, mix_slot or mix_position are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import materialise, table

BROADCAST_SOURCES = 1_000
RANGE_ROWS = 512
MADE = ("mix_phase", "mix_slot", "mix_position")


def one_cycle(weights: Column) -> Column:
    """Earliest-deadline-first over one cycle of sum(weights) slots.

    Returns an array over the slots of struct<i, k>: source index and its block in the cycle.
    """
    q = F.aggregate(weights, F.lit(0), lambda a, w: a + w)
    zeros = F.transform(weights, lambda w: F.lit(0))
    none = F.array().cast("array<struct<i:int,k:int>>")

    def step(acc: Column, t: Column) -> Column:
        due = F.transform(
            weights,
            lambda w, i: F.when(
                F.floor(F.get(acc["done"], i) * q / w) <= t,
                F.struct(F.ceil((F.get(acc["done"], i) + 1) * q / w).cast("int").alias("deadline"), i.cast("int").alias("i")),
            ),
        )
        picked = F.transform(
            F.array(F.array_min(due)["i"]),
            lambda i: F.struct(
                F.transform(acc["done"], lambda k, j: F.when(j == i, k + 1).otherwise(k)).alias("done"),
                F.array_append(acc["slots"], F.struct(i.alias("i"), F.get(acc["done"], i).alias("k"))).alias("slots"),
            ),
        )
        return F.get(picked, F.lit(0))

    return F.aggregate(F.sequence(F.lit(0), q - 1), F.struct(zeros.alias("done"), none.alias("slots")), step, lambda acc: acc["slots"])


def target_weights(sizes: DataFrame, weights: dict[str, int] | None, parts: int) -> DataFrame:
    """Adds the integer weight ``a``: the given one, or in proportion to the square root of the size."""
    if weights is not None:
        given = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(int(v)))])
        return sizes.withColumn("a", F.greatest(F.lit(1), F.coalesce(F.try_element_at(given, F.coalesce("s", F.lit(""))), F.lit(1))))
    whole = F.sum(F.sqrt("n")).over(Window.partitionBy(F.lit(1)))
    return sizes.withColumn("a", F.greatest(F.lit(1), F.round(F.lit(parts) * F.sqrt("n") / whole).cast("int")))


def mixing_plan(sizes: DataFrame) -> DataFrame:
    """(s, blocks, a) per source to (s, plan): for each phase its block range, cycle and slots."""
    all_sources = sizes.groupBy().agg(F.array_sort(F.collect_list(F.struct("s", "blocks", "a"))).alias("src")).where(F.size("src") > 0)
    # A phase ends where a source's blocks run out, at blocks / a cycles.
    ends = all_sources.withColumn("ends", F.array_sort(F.array_distinct(F.transform("src", lambda x: x["blocks"] / x["a"]))))
    phases = ends.select("src", "ends", F.posexplode("ends").alias("phase", "until"))
    # Of the sources that run out there one gives the exact ratio.
    last = F.get(F.filter("src", lambda x: x["blocks"] / x["a"] == F.col("until")), F.lit(0))
    before = F.get(F.filter("src", lambda x: x["blocks"] / x["a"] == F.get("ends", F.col("phase") - 1)), F.lit(0))

    def done(x: Column, at: Column) -> Column:
        return F.least(x["blocks"], F.floor(at["blocks"] * x["a"] / at["a"]))

    active = F.transform(
        F.filter("src", lambda x: x["blocks"] / x["a"] >= F.col("until")),
        lambda x: F.struct(
            x["s"].alias("s"), x["a"].alias("a"),
            F.when(F.col("phase") > 0, done(x, F.col("before"))).otherwise(F.lit(0)).cast("long").alias("first"),
            F.when(x["blocks"] / x["a"] == F.col("until"), x["blocks"]).otherwise(done(x, F.col("last"))).cast("long").alias("end"),
        ),
    )
    cycles = (
        phases.withColumn("last", last).withColumn("before", before).withColumn("active", active)
        .select("phase", "active", F.aggregate("active", F.lit(0), lambda q, x: q + x["a"]).alias("q"))
        .withColumn("cycles", F.array_max(F.transform("active", lambda x: F.ceil((x["end"] - x["first"]) / x["a"]))))
        .repartition("phase")
        .withColumn("slots", one_cycle(F.col("active")["a"]))
    )
    w = Window.partitionBy(F.lit(1)).orderBy("phase").rowsBetween(Window.unboundedPreceding, -1)
    placed = cycles.withColumn("offset", F.coalesce(F.sum(F.col("cycles") * F.col("q")).over(w), F.lit(0)))
    own = placed.select("phase", "q", "offset", "slots", F.posexplode("active").alias("i", "x")).select(
        F.col("x.s").alias("s"),
        F.struct(
            "phase", F.col("x.first").alias("first"), F.col("x.end").alias("end"), F.col("x.a").alias("a"), "q", "offset",
            F.filter(F.transform("slots", lambda p, t: F.when(p["i"] == F.col("i"), t.cast("int"))), lambda t: t.isNotNull()).alias("slots"),
        ).alias("p"),
    )
    return own.groupBy("s").agg(F.array_sort(F.collect_list("p")).alias("plan"))


def mix(
    docs: DataFrame, *, source_col: str = "source", key_col: str = "doc_id", weights: dict[str, int] | None = None,
    parts: int = 1_000, block_docs: int = 32, seed: str = "mix", tie_col: str | None = None,
) -> DataFrame:
    """``docs`` with mix_phase, mix_slot and mix_position (their order is the mix)."""
    own = [c for c in docs.columns if c not in MADE]
    total = docs.count()
    bits = max(0, math.ceil(math.log2(max(1, total / RANGE_ROWS))))
    # The row travels as one struct, so its columns' names cannot clash with those made here.
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"), F.col(source_col).cast("string").alias("s"), F.col(key_col).cast("string").alias("key"))
    keyed = keyed.withColumn("h", F.xxhash64("key", F.lit(seed), *([F.col("row")[tie_col]] if tie_col else [])))
    keyed = keyed.withColumn("r", F.shiftrightunsigned("h", 64 - bits).cast("long") if bits else F.lit(0).cast("long"))
    ranges = materialise(keyed.groupBy("s", "r").agg(F.count("*").alias("n")), "mix-ranges")
    before = Window.partitionBy("s").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.select(F.col("s").alias("s2"), F.col("r").alias("r2"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    sizes = ranges.groupBy("s").agg(F.sum("n").alias("n")).withColumn("blocks", F.ceil(F.col("n") / block_docs))
    plan = materialise(mixing_plan(target_weights(sizes, weights, parts)), "mix-plan").select(F.col("s").alias("s3"), "plan")
    if plan.count() <= BROADCAST_SOURCES:
        plan = F.broadcast(plan)
    numbered = keyed.join(offsets, F.col("s").eqNullSafe(F.col("s2")) & (F.col("r") == F.col("r2"))).withColumn(
        "n", F.col("offset") + F.row_number().over(Window.partitionBy("s", "r").orderBy("h", "key")) - 1
    )
    phase = F.get(F.filter("plan", lambda p: (p["first"] <= F.col("block")) & (F.col("block") < p["end"])), F.lit(0))
    at = F.col("block") - F.col("p.first")
    slot = F.col("p.offset") + F.floor(at / F.col("p.a")) * F.col("p.q") + F.get("p.slots", F.pmod(at, F.col("p.a")).cast("int"))
    placed = numbered.withColumn("block", F.floor(F.col("n") / block_docs)).join(plan, F.col("s").eqNullSafe(F.col("s3"))).withColumn("p", phase).withColumn("slot", slot.cast("long"))
    return placed.select(
        *[F.col("row")[c].alias(c) for c in own], F.col("p.phase").alias("mix_phase"), F.col("slot").alias("mix_slot"),
        (F.col("slot") * block_docs + F.pmod(F.col("n"), F.lit(block_docs))).alias("mix_position"),
    )


def by_text(docs: DataFrame, weights: dict[str, int] | None = None) -> DataFrame:
    """``mix`` with a hash of the text between rows of one id."""
    tied = docs.withColumn("__tie", F.xxhash64(F.coalesce("text", F.lit(""))))
    return mix(tied, weights=weights, tie_col="__tie").drop("__tie")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in the mix, sources weighted by the square root of their size."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie"))
    return mix(docs, tie_col="tie").drop("tie")
