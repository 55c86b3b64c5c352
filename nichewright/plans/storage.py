"""Shared work folders: where long plans are cut, so that lineage stays short and lost executors cost little."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: The work folders of this process.
_made: list[str] = []


def work_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which driver and executors share; ``discard`` removes it.

    Where the setting is missing a folder of this machine is taken in local mode (tests, a laptop); a cluster's executors don't share
    one, so there it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"file://{os.path.join(tempfile.gettempdir(), 'checkpoints', 'nichewright')}"
    _made.append(f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}")
    return _made[-1]


def made() -> int:
    """How many work folders this process has made and not removed."""
    return len(_made)


def discard(spark: SparkSession, keep: int = 0) -> int:
    """Removes the work folders that this process has made, but for the first ``keep``, and returns how many there were.

    Tables that are still read from them are lost, so it's for the end of a command, when its output is written.
    """
    gone = 0
    for path in _made[keep:]:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        gone += place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    del _made[keep:]
    return gone


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it again, which cuts its lineage and survives lost executors."""
    spark = df.sparkSession
    path = work_dir(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Has the driver drop what nothing refers to any more, so that the files of shuffles whose result is written are deleted."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
