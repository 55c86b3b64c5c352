"""Cells, vectors, counts and points as views over the test tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RADIUS, POINT_RADIUS, TRANSPORT_RADIUS = 8.0, 12.0, 5.0
Z = range(3, 11)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def at(i: int):
    """Component i, from 1, of an embedding as a double."""
    return F.col("embedding")[i - 1].cast("double")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_idx"), F.col("label").alias("sample_id"), F.round(at(1) * 100.0, 6).alias("x"), F.round(at(2) * 100.0, 6).alias("y"))


def vectors(spark: SparkSession, sf_dir: str, dims=Z) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_idx"), F.array(*(at(i) for i in dims)).alias("z"))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_idx"), F.col("label").alias("niche"))


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, parts = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    joined = lines.select("l_suppkey", "l_partkey", "l_quantity").join(parts.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return joined.groupBy(F.col("l_suppkey").alias("row_idx"), F.col("p_brand").alias("gene")).agg(F.sum("l_quantity").alias("value"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("row_idx"), F.col("c_nationkey").alias("sample_id"), (F.col("c_acctbal") / 100).alias("x"), (F.col("c_custkey") % 97).cast("double").alias("y"))


def _edges(view: str, radius: float) -> str:
    d = "sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y))"
    return f"SELECT * FROM (SELECT a.row_idx, b.row_idx AS neighbor, {d} AS distance, b.x - a.x AS dx, b.y - a.y AS dy FROM {view} a JOIN {view} b ON a.sample_id IS NOT DISTINCT FROM b.sample_id AND a.row_idx <> b.row_idx) WHERE distance <= {radius}"


SQL = {
    "cells": "SELECT vec_id AS row_idx, label AS sample_id, round(100.0::DOUBLE * embedding[1]::DOUBLE, 6) AS x, round(100.0::DOUBLE * embedding[2]::DOUBLE, 6) AS y FROM embeddings",
    "zs": "SELECT vec_id AS row_idx, " + ", ".join(f"embedding[{i}]::DOUBLE AS z{i}" for i in Z) + " FROM embeddings",
    "labels_": "SELECT vec_id AS row_idx, label AS niche FROM embeddings",
    "counts": "SELECT l_suppkey AS row_idx, p_brand AS gene, SUM(l_quantity) AS value FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2",
    "points": "SELECT c_custkey AS row_idx, c_nationkey AS sample_id, c_acctbal / 100 AS x, CAST(c_custkey % 97 AS DOUBLE) AS y FROM customer",
    "edges": _edges("cells", RADIUS),
    "near": _edges("cells", TRANSPORT_RADIUS),
    "point_edges": _edges("points", POINT_RADIUS),
    "wide_edges": _edges("points", 30.0),
    # Squared distances of the eight z, both directions, and the two ends' labels.
    "dist": "SELECT a.row_idx AS i, b.row_idx AS j, " + " + ".join(f"(a.z{k} - b.z{k}) * (a.z{k} - b.z{k})" for k in Z) + " AS cost FROM zs a JOIN zs b ON a.row_idx <> b.row_idx",
    "pairs": "SELECT d.*, a.niche AS li, b.niche AS lj FROM dist d JOIN labels_ a ON a.row_idx = d.i JOIN labels_ b ON b.row_idx = d.j",
}
NEEDS = {"edges": ["cells"], "near": ["cells"], "point_edges": ["points"], "wide_edges": ["points"], "dist": ["zs"], "pairs": ["zs", "dist", "labels_"]}


def with_views(names: str, *more: str) -> str:
    """``WITH`` and the named views, with what they need, followed by further common table expressions."""
    wanted: dict[str, None] = {}
    for name in names.split():
        wanted |= dict.fromkeys([*NEEDS.get(name, []), name])
    return "WITH RECURSIVE " + ",\n".join([*(f"{n} AS ({SQL[n]})" for n in wanted), *more]) + "\n"
