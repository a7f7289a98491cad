"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables; only Spark opens the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which all machines share.

    Only where the session names none and runs on one machine (tests) is a temporary folder made, kept
    for the rest of the session; on a cluster a missing setting is an error, as executors would
    each write to a disk of their own.
    """
    known = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    known = known or spark.conf.get("spark.ledgerloom.scratch", None)
    if not known:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        known = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.ledgerloom.scratch", known)
    return known


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession, megabytes: int = 4) -> None:
    """Bounds the bytes of an Arrow batch: rows hold whole texts, so a bound on their number (Spark's
    10,000) bounds nothing. Plans run after the operator has returned, so this is a setting of the
    session; one that the user has made tighter stays."""
    own, bound = spark.conf.get(BATCH_BYTES).lower().rstrip("b"), megabytes << 20
    if not own.isdigit() or int(own) > bound:
        spark.conf.set(BATCH_BYTES, str(bound))


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: this cuts lineage,
    and a lost executor costs only the tasks that it ran."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def marked(df: DataFrame, col: str, values: list[int], name: str) -> DataFrame:
    """Adds ``name``: whether ``col`` is among ``values``, a list of bounded length without repeats. It becomes the build
    side of a broadcast hash join, so a row costs one probe whatever the length."""
    named = df.sparkSession.range(1).select(F.explode(F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")).alias("__value"))
    return df.join(F.broadcast(named), F.col(col) == F.col("__value"), "left").withColumn(name, F.col("__value").isNotNull()).drop("__value")


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt over all cores where its files give fewer partitions; large inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def crc_mod(col: str, mod: int) -> Column:
    """crc32 of the id written as text, modulo ``mod``."""
    return F.crc32(F.col(col).cast("string")) % F.lit(mod)


def held_out(mod: int, fold: int) -> Column:
    """Whether a document is outside the rows to learn from; so is one without an id."""
    return F.coalesce(crc_mod("doc_id", mod) == fold, F.lit(True)).alias("held_out")


def bounded_sample(ids: DataFrame, key: str, most: int, seed: str) -> DataFrame:
    """About ``most`` rows of ``ids`` (all, if there are fewer), chosen by a
    hash of ``key`` so that reruns choose the same rows."""
    total = ids.count()
    if total <= most:
        return ids
    cut = int(most / total * 2**31)
    return ids.where(F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(2**31)) < F.lit(cut))
