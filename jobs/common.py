"""What both jobs share: settings from a JSON file, the command line and the log."""

from __future__ import annotations

import argparse
import dataclasses
import json
import logging
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from nichewright.plans.storage import discard

log = logging.getLogger("jobs")


def settings(spark: SparkSession, kind: type, path: str | None, **given):
    """A ``kind`` from the JSON object at ``path``, with the ``given`` values that aren't None above it; unknown names raise ValueError."""
    values = json.loads(spark.read.text(path, wholetext=True).first()[0]) if path else {}
    known = {f.name for f in dataclasses.fields(kind)}
    if unknown := sorted(set(values) - known):
        raise ValueError(f"{path} has unknown settings: {', '.join(unknown)}")
    return kind(**values | {k: v for k, v in given.items() if v is not None})


def counted(df: DataFrame, name: str, **measures) -> tuple[DataFrame, Callable[[], dict[str, int]]]:
    """``df``, and a function for what was counted while its rows passed: ``rows`` and the ``measures``, without a pass of their own."""
    seen = Observation(name)
    observed = df.observe(seen, F.count(F.lit(1)).alias("rows"), *(c.alias(n) for n, c in measures.items()))

    def found() -> dict[str, int]:
        try:
            return seen.get
        except Py4JJavaError:  # Spark saw that there are no rows and left the counting out of the plan
            return dict.fromkeys(["rows", *measures], 0)

    return observed, found


def written(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path``, or None where no run has written one yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def main(run: Callable[..., dict], kind: type, argv: list[str] | None, **options: str) -> None:
    """The command line: ``--input``, ``--output``, ``--config`` and further ``options`` with their help."""
    parser = argparse.ArgumentParser(description=(run.__doc__ or "").split("\n")[0])
    parser.add_argument("--input", required=True, help="folder of the tables")
    parser.add_argument("--output", required=True, help="folder that the job writes to")
    parser.add_argument("--config", help="JSON file of settings")
    for name, text in options.items():
        parser.add_argument(f"--{name.replace('_', '-')}", help=text)
    args = vars(parser.parse_args(argv))
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(run.__module__).getOrCreate()
    try:
        own = settings(spark, kind, args.pop("config"))
        log.info("done: %s", json.dumps(run(spark, args.pop("input"), args.pop("output"), own, **args)))
    finally:
        log.info("%d work folders removed", discard(spark))
        spark.stop()
