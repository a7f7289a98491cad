"""Tables between the stages of a plan, in the folder that all machines share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

OWN = "spark.ledgerloom.stages"


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only a session on one machine that names none gets a temporary folder."""
    known = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(OWN, None)
    if not known:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        known = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set(OWN, known)
    return known.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written and read back: what follows does not compute it again, and a lost executor costs only its own tasks."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
