"""Costs of all pairs that a run writes share by share, so that one that was broken off continues where it stopped.

A share is a set of pairs of blocks.  It is written as one partition of a table, in place of what a broken-off run may have left of it,
and then entered in a table of finished shares with its number of pairs; a rerun computes the shares that aren't entered.  What the costs
were made of is kept beside them, and a folder that holds others is refused.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nichewright.operators import transport
from nichewright.sources import bundle

COSTS, FINISHED = "i long, j long, cost double, share int", "share int, pairs long"
_log = logging.getLogger("nichewright")


def finished_shares(spark, path: str) -> dict[int, int]:
    """{share: pairs} of what is written below ``path``; one row for each of a few shares."""
    if not bundle.exists(spark, f"{path}/finished"):
        return {}
    return {r.share: r.pairs for r in spark.read.schema(FINISHED).parquet(f"{path}/finished").collect()}


def _write_share(costs: DataFrame, path: str, share: int) -> int:
    """Replaces the share's partition; returns its number of pairs."""
    spark = costs.sparkSession
    costs.withColumn("share", F.lit(share)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("share").parquet(f"{path}/costs")
    pairs = spark.read.schema(COSTS).parquet(f"{path}/costs").where(F.col("share") == share).count()
    spark.createDataFrame([(share, pairs)], FINISHED).coalesce(1).write.mode("append").parquet(f"{path}/finished")
    return pairs


def stored_costs(packed: DataFrame, path: str, measure: str = "sinkhorn", shares: int = 16, **kernel) -> DataFrame:
    """(i, j, cost) as ``transport.pair_costs`` gives them, kept below ``path``; only shares that aren't there yet are computed.

    ``packed`` should be a written table.  Other measures, settings or numbers of shares than the folder was begun with raise ValueError.
    """
    if shares < 1:
        raise ValueError("shares must be positive")
    spark = packed.sparkSession
    request = bundle.plain({"measure": measure, "shares": shares, "measures": transport.fingerprint(packed), "kernel": kernel})
    if bundle.exists(spark, f"{path}/request.json"):
        if (old := bundle.read_json(spark, f"{path}/request.json")) != request:
            raise ValueError(f"{path} holds costs of {old}, not of {request}")
    else:
        bundle.write_json(spark, f"{path}/request.json", request)
    done = finished_shares(spark, path)
    _log.info("%d of %d shares are in %s", len(done), shares, path)
    for share in range(shares):
        if share not in done:
            done[share] = _write_share(transport.pair_costs(packed, measure=measure, share=(share, shares), **kernel), path, share)
            _log.info("share %d: %d pairs written to %s", share, done[share], path)
    if not sum(done.values()):
        return spark.createDataFrame([], "i long, j long, cost double")
    return spark.read.schema(COSTS).parquet(f"{path}/costs").drop("share")
