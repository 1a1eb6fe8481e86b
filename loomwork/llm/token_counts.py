"""Token counts through a digest cache."""

from __future__ import annotations

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokenizer
from ._shared import digest, row_slices, scratch_path

CACHE_SCHEMA = "lw_digest binary, lw_tokens long"


def _encoder(args):
    def encode(batches):
        bpe = tokenizer.load(*args)
        for batch in batches:
            for part in row_slices(batch, 1):
                counts = [len(bpe.ids(t)) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64())], ["lw_digest", "lw_tokens"])

    return encode


def _stored(spark: SparkSession, cache: str) -> DataFrame | None:
    try:
        found = spark.read.schema(CACHE_SCHEMA).parquet(cache)
        found.schema  # noqa: B018  a remote session looks only now
        return found
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def token_counts(docs: DataFrame, text: str = "text", cache: str | None = None, bpe=None, out: str = "n_tokens") -> DataFrame:
    """``docs`` with the column ``out``: how many tokens each whole text has.

    A text and the tokenizer's version make a digest. Digests that the table ``cache`` (a Parquet
    path; None: a new, empty one) holds are joined to their stored counts; of the others each is
    encoded once and appended, so each digest is there once (one job at a time may write to a
    cache). A null text counts as an empty one and has 0 tokens; repeated rows
    stay; an empty ``docs`` gives no rows. Columns of ``docs`` keep their names, ``out`` replaces
    one of the same name. Texts meet in a shuffle once, after the map side has dropped repeats, so
    a text that a third of the rows share travels once a task; the counts' join has fixed-width
    rows and no aggregate over it, which lets Spark split a hot digest.
    """
    spark = docs.sparkSession
    bpe = bpe or tokenizer.public()
    cache = cache or scratch_path(spark, "token-cache")
    own = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    keyed = docs.withColumn("lw_digest", digest(own, F.lit("\x00" + tokenizer.version(bpe[0]))))
    known = _stored(spark, cache)
    wanted = keyed.select("lw_digest", own.alias("lw_text"))
    if known is not None:
        wanted = wanted.join(known.select("lw_digest"), "lw_digest", "left_anti")
    misses = wanted.dropDuplicates(["lw_digest"])
    misses.mapInArrow(_encoder(bpe), CACHE_SCHEMA).write.mode("append").parquet(cache)
    stored = spark.read.schema(CACHE_SCHEMA).parquet(cache).withColumnRenamed("lw_tokens", "lw_count")
    names = [c for c in docs.columns if c != out]
    return keyed.join(stored, "lw_digest", "left").select(*(F.col(f"`{c}`") for c in names), F.col("lw_count").alias(out))
