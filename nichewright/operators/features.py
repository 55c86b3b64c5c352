"""Normalisation, standardisation, PCA/SVD embeddings and their stored state."""

from __future__ import annotations

import os
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The widest features whose covariance is made, and the numbers that a block of directions may hold on the driver and in every task.
MOST_DIMENSIONS, MOST_NUMBERS = 4_096, 32_000_000


def library_size_log1p(counts: DataFrame, target_sum: float = 1e4, row: str = "row_idx", value: str = "value") -> DataFrame:
    """Counts in long form with ``normalised`` = log1p(value * target / row sum); rows whose sum isn't positive keep the scale 1."""
    return counts.withColumn("normalised", log_normalised(F.col(value), F.sum(value).over(Window.partitionBy(row)), target_sum))


def log_normalised(value: Column, total: Column, target_sum: float = 1e4) -> Column:
    """log1p of a count that is scaled as if its row summed to ``target_sum``; a total that isn't positive keeps the scale 1."""
    return F.log1p(value * F.when(total > 0, F.lit(float(target_sum)) / total).otherwise(F.lit(1.0)))


def sparse_column_stats(values: DataFrame, rows: int, column: str = "gene", value: str = "normalised") -> DataFrame:
    """(column, mean, scale) of ``rows`` rows whose values are in long form, absent ones being zeros; scales as in ``column_stats``.

    Columns without a value have no row; a column may have a value once in each row.
    """
    mean = F.sum(value) / F.lit(float(max(rows, 1)))
    deviation = F.sqrt(F.greatest(F.sum(F.col(value) * F.col(value)) / F.lit(float(max(rows, 1))) - mean * mean, F.lit(0.0)))
    return values.groupBy(column).agg(mean.alias("mean"), F.when((deviation <= 1e-8) | F.isnan(deviation), F.lit(1.0)).otherwise(deviation).alias("scale"))


def column_stats(rows: DataFrame, vector: str = "z") -> DataFrame:
    """(dim, mean, scale) of an array column: population deviations, 1 where they are at most 1e-8 or not finite."""
    long = rows.select(F.posexplode(vector).alias("dim", "v"))
    deviation = F.stddev_pop("v")
    return long.groupBy("dim").agg(F.avg("v").alias("mean"), F.when((deviation <= 1e-8) | F.isnan(deviation), F.lit(1.0)).otherwise(deviation).alias("scale"))


@dataclass(frozen=True)
class EmbeddingState:
    """(features - mean) / scale, optionally minus reducer_mean and times components transposed, then standardised again."""

    mean: tuple[float, ...]
    scale: tuple[float, ...]
    components: tuple[tuple[float, ...], ...] | None = None
    reducer_mean: tuple[float, ...] | None = None
    out_mean: tuple[float, ...] | None = None
    out_scale: tuple[float, ...] | None = None
    method: str = "precomputed"

    def transform(self, vector: Column) -> Column:
        """An array expression, without Python on the executors; another length than the state's raises at run time."""
        lit = lambda values: F.array(*(F.lit(float(v)) for v in values))
        n = len(self.mean)
        checked = F.when(F.size(vector) == n, vector).when(vector.isNull(), vector).otherwise(F.raise_error(F.lit(f"features must have {n} dimensions")).cast("array<double>"))
        standard = lambda v, m, s: F.zip_with(F.zip_with(v, lit(m), lambda a, b: a.cast("double") - b), lit(s), lambda a, b: a / b)
        z = standard(checked, self.mean, self.scale)
        if self.components is not None:
            if self.reducer_mean is not None:
                z = F.zip_with(z, lit(self.reducer_mean), lambda a, b: a - b)
            z = F.array(*(F.aggregate(F.zip_with(z, lit(w), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x) for w in self.components))
        return z if self.out_mean is None else standard(z, self.out_mean, self.out_scale)

    def save(self, df_of, path: str) -> None:
        """Writes the state as a one-row Parquet table; ``df_of`` is the session."""
        schema = "method string, mean array<double>, scale array<double>, components array<array<double>>, reducer_mean array<double>, out_mean array<double>, out_scale array<double>"
        as_list = lambda v: None if v is None else [list(x) if isinstance(x, tuple) else x for x in v]
        df_of.createDataFrame([(self.method, *(as_list(getattr(self, f)) for f in ("mean", "scale", "components", "reducer_mean", "out_mean", "out_scale")))], schema).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark, path: str) -> EmbeddingState:
        row = spark.read.parquet(path).first().asDict()
        return cls(**{k: v if v is None or isinstance(v, str) else tuple(tuple(x) if isinstance(x, list) else x for x in v) for k, v in row.items()})


def _stats(rows: DataFrame, vector: str) -> tuple[tuple[float, ...], tuple[float, ...]]:
    found = sorted(column_stats(rows, vector).collect())
    return tuple(r["mean"] for r in found), tuple(r["scale"] for r in found)


def fit_embedding(rows: DataFrame, vector: str = "z", method: str = "pca", dimensions: int = 10, standardise: bool = True, seed: int = 1337) -> EmbeddingState:
    """Fits ``pca``, ``svd`` (uncentred) or ``precomputed``.  The covariance, of the features' size squared, is summed by the executors.

    Null vectors are left out of the fit.  A table without a vector raises ValueError, as does one of over ``MOST_DIMENSIONS``
    dimensions unless precomputed: ``sparse_svd`` is for these.
    """
    if method in ("scvi", "totalvi"):
        raise NotImplementedError(f"{method} embeddings are made elsewhere and passed in as precomputed")
    if method not in ("pca", "svd", "precomputed"):
        raise ValueError(f"unknown embedding method {method!r}")
    rows = rows.where(F.col(vector).isNotNull())
    first = rows.select(vector).first()
    if first is None:
        raise ValueError("there are no vectors")
    d = len(first[0])
    if method != "precomputed" and d > MOST_DIMENSIONS:
        raise ValueError(f"over {MOST_DIMENSIONS} dimensions")
    mean, scale = _stats(rows, vector) if standardise or method != "precomputed" else ((0.0,) * d, (1.0,) * d)
    state = EmbeddingState(mean, scale, method=method)
    if method == "precomputed":
        return state
    gram, total, count = second_moments(rows.select(state.transform(F.col(vector)).alias("v")), "v", d)
    k = min(max(dimensions, 1), d, max(count - 1, 1))
    centre = total / count if method == "pca" else np.zeros(d)
    values, vectors = np.linalg.eigh(gram / count - np.outer(centre, centre))
    chosen = _signed(vectors[:, np.argsort(-values)[:k]]).T
    reduced = EmbeddingState(mean, scale, tuple(map(tuple, chosen.tolist())), tuple(centre.tolist()), method=method)
    out = _stats(rows.select(reduced.transform(F.col(vector)).alias("v")), "v")
    return EmbeddingState(mean, scale, reduced.components, reduced.reducer_mean, *out, method=method)


def _signed(axes: np.ndarray) -> np.ndarray:
    """The columns with a fixed sign: the entry of the largest size is positive."""
    return axes * np.where(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])] < 0, -1, 1)


def _summed(parts: DataFrame) -> dict[int, np.ndarray]:
    """The sums of (block, v) by block; each block is added up in one task, from a short array of every partition."""
    total = lambda group: pd.DataFrame({"block": group["block"].iloc[:1], "v": [np.sum(np.stack(group["v"].to_numpy()), 0)]})
    return {r.block: np.array(r.v) for r in parts.groupBy("block").applyInPandas(total, "block int, v array<double>").collect()}


def _narrowed(rows: DataFrame) -> DataFrame:
    """As many partitions as run at once, at most, without a shuffle: each one's partial sums are held and sent once."""
    return rows.coalesce(max(rows.sparkSession.sparkContext.defaultParallelism, 1))


def second_moments(rows: DataFrame, vector: str, d: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Sum of outer products, sum and count of the vectors that aren't null: d + 1 short arrays from each task that runs at once."""

    def part(batches):
        gram, total, n = np.zeros((d, d)), np.zeros(d), 0
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            gram, total, n = gram + x.T @ x, total + x.sum(0), n + len(x)
        if n:
            yield pa.RecordBatch.from_pydict({"block": pa.array(range(d + 1), pa.int32()), "v": pa.array([*gram, np.append(total, n)], pa.list_(pa.float64()))})

    sums = _summed(_narrowed(rows.where(F.col(vector).isNotNull()).select(vector)).mapInArrow(part, "block int, v array<double>"))
    last = sums.get(d, np.zeros(d + 1))
    return np.stack([sums.get(i, np.zeros(d)) for i in range(d)]), last[:-1], int(last[-1])


def sparse_rows(values: DataFrame, genes: list[str], value: str = "normalised") -> DataFrame:
    """(row_idx, at, w): the places in ``genes`` and the values of each row of the long table (row_idx, gene, value).

    Entries with a null value, or a gene that isn't in the list, are left out; their row stays, and is empty if it has no other.
    """
    place = values.sparkSession.createDataFrame(list(enumerate(genes)), "at int, gene string")
    placed = values.select("row_idx", "gene", F.col(value).cast("double").alias("w")).join(F.broadcast(place), "gene", "left")
    entry = F.when(F.col("at").isNotNull() & F.col("w").isNotNull(), F.struct("at", "w"))
    held = placed.groupBy("row_idx").agg(F.sort_array(F.collect_list(entry)).alias("e"))
    return held.select("row_idx", F.col("e.at").alias("at"), F.col("e.w").alias("w"))


def sparse_svd(rows: DataFrame, width: int, components: int, n_iter: int = 7, seed: int = 1337, extra: int = 10) -> np.ndarray:
    """The ``components`` leading right singular vectors (width x components) of sparse rows (row_idx, at, w), without centring.

    A randomised range search: a block of ``components + extra`` directions is sent to the tasks, multiplied by the rows and back,
    summed and made orthogonal again, ``n_iter`` times and once more; nothing of the size width x width is made.  The block is held
    by the driver and every task, so width x (components + extra) over ``MOST_NUMBERS`` raises ValueError.  Entries of one place in a
    row add up; no more vectors are returned than the width.  Rows are read once a round: pass a written table.
    """
    if width < 1 or components < 1:
        raise ValueError("width and components must be positive")
    size = min(components + extra, width)
    if width * size > MOST_NUMBERS:
        raise ValueError(f"{width} x {size} numbers are over {MOST_NUMBERS}")
    context = rows.sparkSession.sparkContext
    held = _narrowed(rows.select("at", "w"))

    def times(block: np.ndarray, back: bool) -> np.ndarray:
        sent = context.broadcast(block)

        def part(batches):
            q, out = sent.value, np.zeros((width if back else size, size))
            for at, w, start in _slices(batches):
                y = _product(q, at, w, start)
                if back:
                    _back(y, at, w, start, out)
                else:
                    out += y.T @ y
            for b in range(0, len(out), 16):
                if out[b : b + 16].any():
                    yield pa.RecordBatch.from_pydict({"block": pa.array([b // 16], pa.int32()), "v": pa.array([out[b : b + 16].ravel()], pa.list_(pa.float64()))})

        sums = _summed(held.mapInArrow(part, "block int, v array<double>"))
        sent.unpersist()
        out = np.zeros((width if back else size, size))
        for b, v in sums.items():
            out[b * 16 : b * 16 + 16] = v.reshape(-1, size)
        return out

    block = np.linalg.qr(np.random.default_rng(seed).normal(size=(width, size)))[0]
    for _ in range(n_iter + 1):
        block = np.linalg.qr(times(block, True))[0]
    values, turned = np.linalg.eigh(times(block, False))
    return _signed(block @ turned[:, np.argsort(-values)[: min(components, width)]])


def sparse_project(rows: DataFrame, axes: np.ndarray) -> DataFrame:
    """(row_idx, z): the sparse rows times the axes, which are sent to every task; an empty row is all zeros."""
    sent = rows.sparkSession.sparkContext.broadcast(axes)

    def run(batches):
        for batch in batches:
            for part in range(0, batch.num_rows, 1024):
                piece = batch.slice(part, 1024)
                for at, w, start in _slices([piece.select(["at", "w"])]):
                    z = _product(sent.value, at, w, start)
                    yield pa.RecordBatch.from_pydict({"row_idx": piece.column("row_idx").cast(pa.int64()), "z": pa.array(list(z), pa.list_(pa.float64()))})

    return rows.select("row_idx", "at", "w").mapInArrow(run, "row_idx long, z array<double>")


def dense_rows(rows: DataFrame, width: int) -> DataFrame:
    """(row_idx, z): the sparse rows with all their places; for few genes, or where no reduction is asked for."""

    def run(batches):
        for batch in batches:
            for n in range(0, batch.num_rows, 256):
                piece = batch.slice(n, 256)
                for at, w, start in _slices([piece.select(["at", "w"])]):
                    z = np.zeros((len(start) - 1, width))
                    np.add.at(z, (np.repeat(np.arange(len(z)), np.diff(start)), at), w)
                    yield pa.RecordBatch.from_pydict({"row_idx": piece.column("row_idx").cast(pa.int64()), "z": pa.array(list(z), pa.list_(pa.float64()))})

    return rows.select("row_idx", "at", "w").mapInArrow(run, "row_idx long, z array<double>")


def _slices(batches):
    """(places, values, starts) of at most 1,024 sparse rows at a time."""
    for batch in batches:
        for first in range(0, batch.num_rows, 1024):
            piece = batch.slice(first, 1024)
            at, w = piece.column("at"), piece.column("w")
            lengths = at.value_lengths().to_numpy(zero_copy_only=False)
            yield at.flatten().to_numpy(zero_copy_only=False), w.flatten().to_numpy(zero_copy_only=False).astype(float), np.concatenate([[0], np.cumsum(lengths)]).astype(int)


#: Numbers that are gathered at once where sparse rows meet a block of directions.
GATHERED = 2_000_000


def _segments(key: np.ndarray, values, size: int, out: np.ndarray) -> np.ndarray:
    """``out`` plus the rows ``values(a, b)`` of a sorted ``key``, added up by key, ``GATHERED`` numbers at a time."""
    step = max(1, GATHERED // max(size, 1))
    for a in range(0, len(key), step):
        own = key[a : a + step]
        edge = np.concatenate([[0], np.flatnonzero(own[1:] != own[:-1]) + 1])
        out[own[edge]] += np.add.reduceat(values(a, a + step), edge)
    return out


def _product(q: np.ndarray, at: np.ndarray, w: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Sparse rows times ``q``: at once where a twentieth of the places is held, else a row at a time."""
    out, width = np.zeros((len(start) - 1, q.shape[1])), len(q)
    for a, b in _dense_parts(start, width):
        x = _dense(at, w, start, a, b, width)
        if x is not None:
            out[a:b] = x @ q
            continue
        for n in range(a, b):
            own = slice(start[n], start[n + 1])
            out[n] = w[own] @ q[at[own]]
    return out


def _dense_parts(start: np.ndarray, width: int):
    """Ranges of rows that have ``GATHERED`` places at most, one row at least."""
    step = max(1, GATHERED // max(width, 1))
    return [(a, min(a + step, len(start) - 1)) for a in range(0, len(start) - 1, step)]


def _dense(at: np.ndarray, w: np.ndarray, start: np.ndarray, a: int, b: int, width: int) -> np.ndarray | None:
    """Rows a to b with all their places, or None where they hold under a twentieth of them."""
    own = slice(start[a], start[b])
    if 20 * (own.stop - own.start) < (b - a) * width:
        return None
    row = np.repeat(np.arange(b - a), np.diff(start[a : b + 1]))
    return np.bincount(row * width + at[own], weights=w[own], minlength=(b - a) * width).reshape(b - a, width)


def _back(y: np.ndarray, at: np.ndarray, w: np.ndarray, start: np.ndarray, out: np.ndarray) -> np.ndarray:
    """``out`` plus the transposed sparse rows times ``y``: at once where rows are dense enough, else in runs of sorted places."""
    for a, b in _dense_parts(start, len(out)):
        x = _dense(at, w, start, a, b, len(out))
        if x is not None:
            out += x.T @ y[a:b]
            continue
        own = slice(start[a], start[b])
        row, order = np.repeat(np.arange(a, b), np.diff(start[a : b + 1])), np.argsort(at[own], kind="stable")
        place, weight, source = at[own][order], w[own][order], row[order]
        _segments(place, lambda i, j: weight[i:j, None] * y[source[i:j]], y.shape[1], out)  # noqa: B023
    return out


def sparse_variance(rows: DataFrame, axes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(variance, share of all variance) of sparse rows (row_idx, at, w) along each of the ``axes``; shares are 0 without any variance.

    One pass: every task sends the sums of its places and of its squares, and those of the projections.
    """
    width, k = axes.shape
    sent = rows.sparkSession.sparkContext.broadcast(axes)

    def part(batches):
        places, rest = np.zeros((width, 1)), np.zeros(2 * k + 2)
        for at, w, start in _slices(batches):
            z = _product(sent.value, at, w, start)
            _back(np.ones((len(z), 1)), at, w, start, places)
            rest += np.concatenate([z.sum(0), (z * z).sum(0), [(_merged(at, w, start) ** 2).sum(), len(z)]])
        for b in range(0, width, 4096):
            if places[b : b + 4096].any():
                yield pa.RecordBatch.from_pydict({"block": pa.array([b // 4096], pa.int32()), "v": pa.array([places[b : b + 4096, 0]], pa.list_(pa.float64()))})
        if rest[-1]:
            yield pa.RecordBatch.from_pydict({"block": pa.array([-1], pa.int32()), "v": pa.array([rest], pa.list_(pa.float64()))})

    sums = _summed(_narrowed(rows.select("at", "w")).mapInArrow(part, "block int, v array<double>"))
    rest = sums.pop(-1, np.zeros(2 * k + 2))
    n = max(rest[-1], 1.0)
    total = rest[-2] / n - sum(float(((v / n) ** 2).sum()) for v in sums.values())
    variance = np.maximum(rest[k : 2 * k] / n - (rest[:k] / n) ** 2, 0.0)
    return variance, variance / total if total > 1e-12 else np.zeros(k)


def _merged(at: np.ndarray, w: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The values with entries of one place in a row added to its first one, the others being 0."""
    row = np.repeat(np.arange(len(start) - 1), np.diff(start))
    order = np.lexsort((at, row))
    first = np.concatenate([[True], (np.diff(row[order]) != 0) | (np.diff(at[order]) != 0)])[: len(order)]
    out = np.zeros(len(w))
    np.add.at(out, order[np.flatnonzero(first)[np.cumsum(first) - 1]], w[order])
    return out


def svd_request(env: dict[str, str] | None = None) -> dict:
    """The request for cached count features from the environment; malformed values fall back to the defaults."""
    env = dict(os.environ) if env is None else env

    def number(name: str, default, kind, least=None):
        try:
            value = kind(env[name])
        except (KeyError, ValueError):
            return default
        return value if least is None else max(value, least)

    use = env.get("NICHE_X_USE_SVD", "1").strip().lower() not in ("0", "false", "no", "off")
    return {"target_sum": number("NICHE_X_TARGET_SUM", 1e4, float), "use_svd": use, "components": number("NICHE_X_SVD_COMPONENTS", 256, int, 2), "n_iter": number("NICHE_X_SVD_N_ITER", 7, int, 1), "random_state": number("NICHE_X_SVD_RANDOM_STATE", 1337, int)}


def resolve_feature(name: str, allow_umap: bool = False) -> list[str]:
    """Warnings about a feature column; one made by UMAP needs ``allow_umap``, else ValueError."""
    low = name.lower()
    if "umap" in low and not allow_umap:
        raise ValueError(f"{name} looks like a UMAP layout, which distorts distances; allow it explicitly to go on")
    return [f"{name}: distances in a {token} layout are not metric" for token in ("umap", "tsne", "phate", "forceatlas") if token in low]


def feature_kind(name: str, from_counts: bool, reduced: bool = False) -> str:
    """What space a feature column spans, for the summary."""
    low = name.lower()
    if "umap" in low:
        return "umap_embedding"
    if any(token in low for token in ("tsne", "phate", "forceatlas")):
        return "visualization_like_embedding"
    return ("full_gene_runtime_svd" if reduced else "full_gene_dense") if from_counts else "obsm"


def provenance(method: str, samples: int, batch_key: str | None = None) -> dict:
    """Notes on batch effects for the summary: PCA and SVD over several samples don't correct them."""
    uncorrected = samples > 1 and method in ("pca", "svd")
    return {
        "batch_key": batch_key,
        "batch_correction_applied": False,
        "warning": f"{method} over {samples} samples leaves batch effects in; a corrected latent space can be passed as precomputed" if uncorrected else None,
        "note": f"{batch_key} is only recorded" if uncorrected and batch_key else None,
    }
