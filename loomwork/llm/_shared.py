"""Where intermediate tables go, and helpers that several operators use."""

from __future__ import annotations

import contextlib
import uuid

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.staging import shared_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/loomwork/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession):
    """Queries that run inside leave no shuffle files once they are over."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


def _to(df: DataFrame, path: str, codec: str = "zstd") -> DataFrame:
    with shuffles_removed(df.sparkSession):
        df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, read again: cuts the lineage, survives executors."""
    return _to(df, scratch_path(df.sparkSession, name))


def _empty(spark: SparkSession, path: str) -> None:
    """Delete what is in a folder: an empty table replaces it."""
    spark.range(0).write.mode("overwrite").parquet(path)


def forget(table: DataFrame) -> None:
    """Delete a table that :func:`written` made and nothing reads any more."""
    for path in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        if "/loomwork/" in path:
            _empty(table.sparkSession, path)


@contextlib.contextmanager
def workspace(spark: SparkSession, name: str):
    """Inside, ``table(df, name)`` does what :func:`written` does; afterwards those tables go."""
    path = scratch_path(spark, name)
    yield lambda df, name: _to(df, f"{path}/{name}-{uuid.uuid4().hex}")
    _empty(spark, path)


def digest(*parts: Column) -> Column:
    """32 bytes that stand for a whole text."""
    return F.unhex(F.sha2(F.concat(*parts) if len(parts) > 1 else parts[0], 256))


def row_slices(batch: pa.RecordBatch, text: int, most_bytes: int = 1 << 20):
    """Consecutive slices of ``batch`` of about ``most_bytes`` of text, one row at least each."""
    sizes = pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if i > start and held + n > most_bytes:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield batch.slice(start)
