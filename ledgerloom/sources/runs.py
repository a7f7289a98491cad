"""Runs kept as a table partitioned by their id, so that reading one prunes to its folder."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

RUN_ID = re.compile("[0-9a-f]{10}")


def new_run_id() -> Column:
    return F.substring(F.md5(F.expr("uuid()").cast("binary")), 1, 10)


def save(state: DataFrame, path: str) -> None:
    """``state`` has run_id; the folders of the runs in it are replaced, others stay."""
    state.write.partitionBy("run_id").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str, run_id: str, schema: str) -> DataFrame | None:
    """One run, or None where the id is malformed or unknown."""
    if not RUN_ID.fullmatch(run_id):
        return None
    try:
        own = spark.read.schema(schema + ", run_id string").parquet(path).where(F.col("run_id") == run_id)
    except AnalysisException:
        return None
    return None if own.isEmpty() else own
