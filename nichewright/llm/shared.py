"""Helpers that several operators share: table access, the shared work folder and text conventions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nichewright.plans.storage import materialise, release, work_dir

__all__ = ["ascii_lower", "few", "materialise", "partitions", "release", "table", "text_batches", "text_id", "work_dir"]

#: Tables of at most so many rows are broadcast, others joined by shuffle; adaptive execution splits their hot keys.
MOST_BROADCAST_ROWS = 500_000

#: Words are runs of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: ``str.translate`` table that lower-cases A-Z and nothing else.
ASCII_LOWER = {ord(a): b for a, b in zip(UPPER, LOWER, strict=True)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(column: Column) -> Column:
    """Lower-cases A-Z only; ``lower`` would fold other scripts as well."""
    return F.translate(column, UPPER, LOWER)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_batches(documents: DataFrame, most: int = 1000) -> DataFrame:
    """The documents, after their session's Arrow batches were set to ``most`` rows at most.

    The default of 10,000 rows counts rows, not bytes, and whole texts of that many can outgrow a Python worker's memory.
    """
    conf, key = documents.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= most:
        conf.set(key, most)
    return documents


def few(rows: DataFrame, most: int = MOST_BROADCAST_ROWS) -> DataFrame:
    """``rows`` marked for a broadcast if there are at most ``most`` of them; they are counted, so they should be a written table."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows


def text_id(text: Column) -> Column:
    """128 bits of the text's SHA-256, which exact copies share; a null text counts as empty."""
    return F.unhex(F.substring(F.sha2(F.coalesce(text, F.lit("")), 256), 1, 32))
