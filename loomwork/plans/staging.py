"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_OWN: dict[str, str] = {}  # temporary folders of sessions that have none


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. A session of one process that has none gets a temporary folder; on
    a cluster, whose machines would each write to their own disk, that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.conf.get("spark.app.id", "")
        found = _OWN[app] = _OWN.get(app) or "file://" + tempfile.mkdtemp(prefix="loomwork-")
    return found.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once and read again, so that later steps see the same rows in any attempt."""
    path = f"{shared_dir(df.sparkSession)}/loomwork/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
