"""The registered queries of this subpackage, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from nichewright.llm import ann, centroids, close_vectors, licenses, mixing, url_filter
from nichewright.llm.shared import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from nichewright.llm.token_files import token_files

    return token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), url_filter.RULES)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nichewright.llm.simhash import simhash_components

    return simhash_components(table(spark, sf_dir, "documents"), threshold=4)


def op4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from nichewright.llm.pieces import round_trip

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), dropout=0.1)


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, F.col("embedding"), k=5)


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nichewright.llm.toxicity import toxicity_scores

    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nichewright.llm.quality import quality_scores

    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, most_repeats=2)


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nichewright.llm.minhash import fingerprinted

    return fingerprinted(table(spark, sf_dir, "documents"), threshold=0.8, slots=64, width=5)


def op11_exponion(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    return centroids.exponion_clusters(table(spark, sf_dir, "embeddings"), F.col("embedding"), k=40, rounds=5, dimension=64, factor=256.0, salt="2:")


def op12_close_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    return close_vectors.close_vectors(table(spark, sf_dir, "embeddings"), F.col("label"), F.col("embedding"), threshold=0.98)


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_token_files, op2_url_filter, op3_simhash, op4_pieces, op5_nearest, op6_licenses, op7_toxicity, op8_quality, op9_mixing, op10_minhash, op11_exponion, op12_close_vectors)}
ORACLE_SQL: dict[str, str] = {"op2_url_filter": url_filter.oracle_sql(), "op5_nearest": ann.oracle_sql(), "op6_licenses": licenses.oracle_sql(), "op9_mixing": mixing.oracle_sql(), "op11_exponion": centroids.oracle_sql(), "op12_close_vectors": close_vectors.oracle_sql()}
