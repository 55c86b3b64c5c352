"""A cohort as a directory of Parquet tables, JSON summaries, reference models and the fingerprints of cached results."""

from __future__ import annotations

import dataclasses
import json
import math
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    """The Hadoop file system and path of any URI that Spark reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def _aside(spark: SparkSession, path: str) -> list:
    """Tables that were moved aside from ``path`` and not deleted, the newest first."""
    fs, p = _fs(spark, path)
    if not fs.exists(p.getParent()):
        return []
    found = [f for f in fs.listStatus(p.getParent()) if f.getPath().getName().startswith(f"{p.getName()}.old-")]
    return [f.getPath() for f in sorted(found, key=lambda f: -f.getModificationTime())]


def table_path(spark: SparkSession, path: str) -> str | None:
    """Where the table of ``path`` is: there, or aside if a writer stopped between its two renames; None if there is none."""
    if exists(spark, path):
        return path
    return next((str(p.toString()) for p in _aside(spark, path)), None)


def write_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = (), compression: str = "zstd") -> None:
    """Replaces a table as a whole, which may be made from itself.

    It is written beside its place; the old table is moved aside, the new one takes its place, and only then the old one goes.  A
    crash in between leaves the old table under ``<path>.old-...``, where ``table_path`` finds it and from where the next writer puts
    it back; a failed rename puts it back at once.  A table has one writer at a time.
    """
    spark, tag = df.sparkSession, uuid.uuid4().hex
    fs, place = _fs(spark, path)
    df.write.option("compression", compression).partitionBy(*partition_by).parquet(f"{path}.new-{tag}")
    new, old = (spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{kind}-{tag}") for kind in ("new", "old"))
    if not fs.exists(place) and (aside := _aside(spark, path)):
        fs.rename(aside[0], place)
    had = fs.exists(place)
    if had and not fs.rename(place, old):
        raise OSError(f"{path} can't be moved aside")
    if not fs.rename(new, place):
        if had:
            fs.rename(old, place)
        raise OSError(f"{path}.new-{tag} can't be renamed to {path}")
    for gone in _aside(spark, path):
        fs.delete(gone, True)


def write_bundle(tables: dict[str, DataFrame], path: str) -> None:
    for name, df in tables.items():
        write_table(df, f"{path}/{name}")


def read_bundle(spark: SparkSession, path: str, names: tuple[str, ...], required: dict[str, tuple[str, ...]] | None = None) -> dict[str, DataFrame]:
    """The named tables; one that is missing, or lacks a required column, raises KeyError."""
    out = {}
    for name in names:
        if (place := table_path(spark, f"{path}/{name}")) is None:
            raise KeyError(f"{path} has no table {name}")
        out[name] = spark.read.parquet(place)
        if lacking := set((required or {}).get(name, ())) - set(out[name].columns):
            raise KeyError(f"{name} lacks {', '.join(sorted(lacking))}")
    return out


def plain(value):
    """A value as JSON takes it: NumPy scalars and arrays, tuples and dataclasses become plain; NaN and infinities become null."""
    if dataclasses.is_dataclass(value) and not isinstance(value, type):
        value = dataclasses.asdict(value)
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, set)):
        return [plain(v) for v in value]
    if isinstance(value, np.ndarray):
        return plain(value.tolist())
    if isinstance(value, np.generic):
        value = value.item()
    if isinstance(value, float) and not math.isfinite(value):
        return None
    return value


def write_json(spark: SparkSession, path: str, value) -> None:
    """A JSON file with sorted keys, by the file system that Spark has for the path."""
    fs, place = _fs(spark, path)
    out = fs.create(place, True)
    try:
        out.write(bytearray(json.dumps(plain(value), sort_keys=True, indent=2).encode()))
    finally:
        out.close()


def read_json(spark: SparkSession, path: str):
    return json.loads("\n".join(r.value for r in spark.read.text(path).collect()))


def cached(spark: SparkSession, path: str, request: dict, make, overwrite: bool = False) -> tuple[DataFrame, bool]:
    """(table, was it reused): the stored table if its fingerprint has every requested value, else ``make()`` is stored."""
    print_path = f"{path}.fingerprint.json"
    stored = read_json(spark, print_path) if exists(spark, print_path) and exists(spark, path) else None
    if not overwrite and stored is not None and all(stored.get(k) == v for k, v in plain(request).items()):
        return spark.read.parquet(path), True
    write_table(make(), path)
    write_json(spark, print_path, request)
    return spark.read.parquet(path), False


def distance_store(n: int, store: str = "auto", most_inline: int = 5000) -> str:
    """``inline`` or ``parquet``: where a distance relation of n rows belongs."""
    if store not in ("auto", "inline", "parquet"):
        raise ValueError("store must be auto, inline or parquet")
    return store if store != "auto" else "inline" if n <= most_inline else "parquet"


def save_reference(path: str, labels: DataFrame, medoids: DataFrame, names: DataFrame | None = None, packed: DataFrame | None = None, settings: dict | None = None) -> None:
    """A model for later assignment: (row_idx, niche), (niche, medoid, size) and, if given, (row_idx, name).

    With ``packed``, the measures of a run, those of the medoids are kept too, and ``settings`` (its config and scales) beside them.
    """
    if packed is not None:
        write_table(packed.join(medoids.select(F.col("medoid").alias("row_idx")), "row_idx", "left_semi"), f"{path}/reference_measures")
    if settings is not None:
        write_json(labels.sparkSession, f"{path}/settings.json", settings)
    named = medoids if names is None else medoids.join(names.select(F.col("row_idx").alias("medoid"), F.col("name").alias("medoid_name")), "medoid", "left")
    write_bundle({"reference_labels": labels, "reference_medoids": named}, path)
    write_json(labels.sparkSession, f"{path}/cluster_medoids.json", {r.niche: r.medoid for r in medoids.collect()})  # a row a niche


def save_self_costs(path: str, reference: DataFrame, epsilon: float, sweeps: int) -> None:
    """The self costs of a model's ``reference_measures``, with the kernel and the measures that they belong to."""
    from nichewright.operators import transport

    write_table(transport.self_costs(reference, epsilon, sweeps), f"{path}/reference_self_costs")
    write_json(reference.sparkSession, f"{path}/self_costs.json", {"epsilon": epsilon, "sweeps": sweeps, "measures": transport.fingerprint(reference)})


def load_self_costs(spark: SparkSession, path: str, reference: DataFrame, epsilon: float, sweeps: int) -> DataFrame | None:
    """The stored self costs, None where a model has none; ValueError if they belong to another kernel or other measures."""
    from nichewright.operators import transport

    if not exists(spark, f"{path}/self_costs.json"):
        return None
    held, wanted = read_json(spark, f"{path}/self_costs.json"), {"epsilon": epsilon, "sweeps": sweeps, "measures": transport.fingerprint(reference)}
    if held != wanted:
        raise ValueError(f"the self costs in {path} are of {held}, not of {wanted}")
    return spark.read.parquet(f"{path}/reference_self_costs")


def load_reference(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    found = read_bundle(spark, path, ("reference_labels", "reference_medoids"))
    return found["reference_labels"], found["reference_medoids"]


def align_external(cells: DataFrame, external: DataFrame, keys: tuple[str, ...] = ("source_file", "cell_id"), dimensions: int | None = 3) -> DataFrame:
    """The cells with the vector ``z`` of another table by key; missing or repeated keys, or another length, raise ValueError."""
    from nichewright.operators.pooling import violations

    if not (bad := violations(external, cells, keys)).isEmpty():
        raise ValueError(f"keys that don't map one to one: {bad.limit(5).collect()}")
    if dimensions is not None and not external.where(F.size("z") != dimensions).isEmpty():
        raise ValueError(f"vectors must have {dimensions} dimensions")
    return cells.join(external.select(*keys, "z"), list(keys))
