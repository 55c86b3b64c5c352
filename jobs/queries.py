"""Both jobs as registered queries: each runs twice into one new folder, and the query returns what is there after the second run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import assign_arrivals, prepare_text
from nichewright.plans.storage import work_dir


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*((F.round(c, 6) + F.lit(0.0)).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes))


def job1_prepare_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    output = work_dir(spark, "job1")
    for _ in range(2):
        prepare_text.prepare(spark, sf_dir, output)
    return _rounded(prepare_text.features_table(spark, output))


def job2_assign_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    output = work_dir(spark, "job2")
    for _ in range(2):
        assign_arrivals.assign_arrivals(spark, sf_dir, output)
    return _rounded(assign_arrivals.assigned_table(spark, output))


QUERIES = {f.__name__: f for f in (job1_prepare_text, job2_assign_arrivals)}
ORACLE_SQL = {"job1_prepare_text": prepare_text.sql(), "job2_assign_arrivals": assign_arrivals.sql()}
