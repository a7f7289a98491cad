"""Lookup tables as DataFrames: PIN directory, states with aliases, cities. All are inputs, small ones of known size."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions.text import lookup_key, strip, titlecase


def pin_directory(spark: SparkSession, path: str) -> DataFrame:
    """(pin, state, district) of a CSV file with header; only six-digit PINs, the last row of each wins."""
    rows = spark.read.schema("pin string, state string, district string").option("header", True).csv(path).withColumn("at", F.monotonically_increasing_id())
    rows = rows.withColumn("pin", strip(F.col("pin"))).where(F.col("pin").rlike(r"\A[0-9]{6}\z"))
    last = F.row_number().over(Window.partitionBy("pin").orderBy(F.desc("at")))
    return rows.withColumn("rn", last).where("rn = 1").select("pin", "state", "district")


def pin_collisions(rows: DataFrame) -> DataFrame:
    """PINs whose rows disagree on the state or district: (pin, kept, n_other), the first by ``at`` kept."""
    first = F.first(F.struct("state", "district")).over(Window.partitionBy("pin").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    marked = rows.withColumn("kept", first).withColumn("other", (F.struct("state", "district") != F.col("kept")).cast("int"))
    return marked.groupBy("pin").agg(F.first("kept").alias("kept"), F.sum("other").alias("n_other")).where("n_other > 0")


def states(spark: SparkSession, path: str) -> DataFrame:
    """(key, state) of a text file: ``alias<TAB>name`` or a name alone; comments and blank lines skipped, names before aliases."""
    rows = spark.read.text(path).where(~F.col("value").rlike(r"\A\s*(?:#|\z)")).select(F.split("value", "\t").alias("p"))
    own = rows.select(lookup_key(F.get("p", F.lit(0))).alias("key"), strip(F.element_at("p", -1)).alias("state"), (F.size("p") > 1).cast("int").alias("alias"))
    return own.groupBy("key").agg(F.min_by("state", F.struct("alias", "state")).alias("state"))


def cities(spark: SparkSession, path: str) -> DataFrame:
    """(key) of a text file of names."""
    return spark.read.text(path).where(~F.col("value").rlike(r"\A\s*(?:#|\z)")).select(lookup_key(F.col("value")).alias("key")).where("key <> ''").distinct()


def state_spelling(raw: Column, spellings: dict[str, str]) -> Column:
    """A state as the directory spells it: by its upper case name, by a known spelling without spaces, else in title case.
    ``spellings`` maps upper case names to the canonical ones."""
    own = strip(F.coalesce(raw, F.lit("")))
    if not spellings:
        return titlecase(own)
    upper = F.create_map(*[F.lit(x) for kv in spellings.items() for x in kv])
    squashed = F.create_map(*[F.lit(x) for name in sorted(set(spellings.values())) for x in (name.lower().replace(" ", ""), name)])
    return F.coalesce(F.try_element_at(upper, F.upper(own)), F.try_element_at(squashed, F.replace(F.lower(own), F.lit(" "), F.lit(""))), titlecase(own))


def build_pins(raw: DataFrame, spellings: dict[str, str], order: str = "at") -> DataFrame:
    """(pin, district, state, n_other) from raw rows (pincode, district, state, and their order): only six-digit PINs with a state; of
    each the first row stays, and ``n_other`` counts its rows that say otherwise (the collision report).

    Equal rows are counted first, so neither aggregation holds more of a PIN than its different places."""
    rows = raw.select(strip(F.coalesce("pincode", F.lit(""))).alias("pin"), titlecase(strip(F.coalesce("district", F.lit("")))).alias("district"), state_spelling(F.col("state"), spellings).alias("state"), F.col(order).alias("at"))
    rows = rows.where(F.col("pin").rlike(r"\A[0-9]{6}\z") & (F.col("state") != ""))
    places = rows.groupBy("pin", "district", "state").agg(F.count("*").alias("n"), F.min("at").alias("at"))
    first = F.min_by(F.struct("district", "state", "n"), "at")
    kept = places.groupBy("pin").agg(first.alias("first"), F.sum("n").alias("n"))
    return kept.select("pin", "first.district", "first.state", (F.col("n") - F.col("first.n")).alias("n_other"))


def build_states(spark: SparkSession, names: list[str], aliases: dict[str, str]) -> DataFrame:
    """(alias, state): every name without an alias, and the aliases."""
    rows = [(None, n) for n in sorted(set(names))] + sorted(aliases.items())
    return spark.createDataFrame(rows, "alias string, state string")


def build_cities(raw: DataFrame, aliases: DataFrame) -> DataFrame:
    """(name): the districts of the raw rows, folded, of three characters or more and not numbers, and the aliases (name); each once."""
    own = F.lower(strip(F.coalesce("district", F.lit(""))))
    named = raw.select(own.alias("name")).where((F.length("name") > 2) & ~F.col("name").rlike(r"\A[0-9]+\z"))
    return named.union(aliases.select(F.lower("name").alias("name"))).distinct()


def publish(tables: dict[str, DataFrame], folder: str) -> None:
    """Writes the tables, each as one sorted CSV file, beside ``folder`` and gives them that name at once; an existing one is refused.

    Lookup tables are bounded (some twenty thousand PINs, hundreds of names), so one file each is meant."""
    spark = next(iter(tables.values())).sparkSession
    next_ = f"{folder.rstrip('/')}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(path(folder)):
        raise FileExistsError(folder)
    for name, df in tables.items():
        df.coalesce(1).sortWithinPartitions(*df.columns).write.option("header", True).csv(f"{next_}/{name}")
    if not files.rename(path(next_), path(folder)):
        raise OSError(f"cannot publish {folder}")
