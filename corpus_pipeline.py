"""From raw documents to packed training sequences, one operator a stage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm import decontamination, minhash, quality, suffixes
from loomwork.llm._shared import written
from loomwork.llm.packing import pack


def _apart(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text`` and the other columns as one, out of the way of what operators add."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    return docs.select("doc_id", "text", F.struct(*rest).alias("lw_rest"))


def _together(docs: DataFrame, columns: list[str], **new: Column) -> DataFrame:
    return docs.select(*(new.get(c, F.col("text") if c == "text" else F.col("lw_rest").getField(c)).alias(c) for c in columns))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier draws."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return _together(quality.resample(_apart(docs), labels).where("kept"), docs.columns)


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return minhash.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of over 50 words that stand elsewhere too; ``n_chars`` follows."""
    cut = suffixes.remove_repeats(_apart(docs), **suffixes.PASSAGES)
    if "n_chars" not in docs.columns:
        return _together(cut, docs.columns)
    size = F.char_length("text").cast(docs.schema["n_chars"].dataType)
    return _together(cut, docs.columns, n_chars=F.when(F.col("n_removed") > 0, size).otherwise(F.col("lw_rest.n_chars")))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _together(decontamination.find_leaks(_apart(docs), items).where(F.size("leaks") == 0), docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1,024 ids."""
    pieces = pack(docs.select("doc_id", "text"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", keep_good),
    ("near-duplicates", keep_distinct),
    ("suffix-array dedup", cut_repeats),
    ("benchmark decontamination", drop_leaks),
    ("packing", pack_sequences),
]

#: SQL can express neither the sampling nor the hashes; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{k}")
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
