"""A data source for H5AD files, where h5py is installed: ``spark.dataSource.register(H5adSource)``, then format ``h5ad``.

Options: ``path`` (a file that every executor sees), ``table`` and ``rows`` a partition (default 100,000).  Each partition opens the file
and reads its own range.  The tables are

* ``obs`` (the default): row_idx, cell_id, the columns ``obs`` (comma-joined) as strings and the keys ``obsm`` (comma-joined) as arrays;
* ``counts``: row_idx, gene_idx, value of the entries of ``X``, or of the layer ``layer``, that aren't 0.  A matrix stored by rows, and a dense one, is
  read by ranges of rows, ``batch`` rows at once (default 1,000); one stored by columns by ranges of columns;
* ``genes``: gene_idx, gene;
* ``uns``: key (the path, joined by slashes) and value as JSON, arrays and scalars; what can't be put in JSON as its text.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType


def _h5py():
    try:
        import h5py
    except ImportError as error:
        raise ImportError("reading H5AD needs h5py; convert the file to Parquet tables where it is installed") from error
    return h5py


TABLES = ("obs", "counts", "genes", "uns")


class Rows(InputPartition):
    def __init__(self, start: int, stop: int):
        self.start, self.stop = start, stop


class H5adReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.step = options["path"], int(options.get("rows", "100000"))
        self.obs, self.obsm = ([c for c in options.get(k, "").split(",") if c] for k in ("obs", "obsm"))
        self.table, self.layer, self.batch = options.get("table", "obs"), options.get("layer"), int(options.get("batch", "1000"))
        if self.table not in TABLES or self.step < 1 or self.batch < 1:
            raise ValueError(f"table must be one of {', '.join(TABLES)}, and rows and batch positive")

    def _matrix(self, f):
        """(X or the layer, its encoding, its shape)."""
        x = f["layers"][self.layer] if self.layer else f["X"]
        kind = _text(x.attrs.get("encoding-type", "")) if hasattr(x, "keys") else "array"
        if kind not in ("array", "csr_matrix", "csc_matrix"):
            raise ValueError(f"a matrix of the encoding {kind!r} can't be read")
        return x, kind, tuple(int(n) for n in (x.shape if kind == "array" else x.attrs["shape"]))

    def partitions(self) -> list[Rows]:
        with _h5py().File(self.path, "r") as f:
            if self.table == "uns":
                return [Rows(0, 1)]
            if self.table == "counts":
                _, kind, shape = self._matrix(f)
                n = shape[1] if kind == "csc_matrix" else shape[0]
            else:
                of = f["var" if self.table == "genes" else "obs"]
                n = len(of[of.attrs["_index"]])
        return [Rows(a, min(n, a + self.step)) for a in range(0, n, self.step)]

    def read(self, partition: Rows) -> Iterator:
        yield from {"obs": self._read_obs, "counts": self._read_counts, "genes": self._read_genes, "uns": self._read_uns}[self.table](partition)

    def _read_counts(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        with _h5py().File(self.path, "r") as f:
            x, kind, _ = self._matrix(f)
            for a in range(partition.start, partition.stop, self.batch):
                b = min(a + self.batch, partition.stop)
                if kind == "array":
                    block = np.asarray(x[a:b], float)
                    major, minor = np.nonzero(block)
                    value = block[major, minor]
                else:
                    ends = np.asarray(x["indptr"][a : b + 1], np.int64)
                    major, minor, value = np.repeat(np.arange(b - a), np.diff(ends)), np.asarray(x["indices"][ends[0] : ends[-1]], np.int64), np.asarray(x["data"][ends[0] : ends[-1]], float)
                    major, minor, value = (v[value != 0] for v in (major, minor, value))
                row, gene = (minor, major + a) if kind == "csc_matrix" else (major + a, minor)
                yield pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(gene, pa.int64()), pa.array(value, pa.float64())], ["row_idx", "gene_idx", "value"])

    def _read_genes(self, partition: Rows) -> Iterator[tuple]:
        with _h5py().File(self.path, "r") as f:
            names = f["var"][f["var"].attrs["_index"]][partition.start : partition.stop]
        yield from ((partition.start + i, _text(v)) for i, v in enumerate(names))

    def _read_uns(self, partition: Rows) -> Iterator[tuple]:
        def walk(path: str, held) -> Iterator[tuple]:
            if hasattr(held, "keys"):
                for key in sorted(held.keys()):
                    yield from walk(f"{path}/{key}" if path else key, held[key])
            else:
                value = np.asarray(held[()])
                plain = value.astype(str) if value.dtype.kind in "OSU" and not any(isinstance(v, bytes) for v in value.ravel()) else value
                yield path, json.dumps(plain.tolist(), default=_text)

        with _h5py().File(self.path, "r") as f:
            if "uns" in f:
                yield from walk("", f["uns"])

    def _read_obs(self, partition: Rows) -> Iterator[tuple]:
        part = slice(partition.start, partition.stop)
        with _h5py().File(self.path, "r") as f:
            obs = f["obs"]
            columns = [[_text(v) for v in obs[obs.attrs["_index"]][part]]]
            for name in self.obs:
                held = obs[name]
                if hasattr(held, "keys"):  # categories and codes
                    values = held["categories"][:]
                    columns.append([_text(values[c]) if c >= 0 else None for c in held["codes"][part]])
                else:
                    columns.append([_text(v) for v in held[part]])
            vectors = [f["obsm"][k][part].astype(float).tolist() for k in self.obsm]
        for i, row in enumerate(zip(*columns, *vectors, strict=True)):
            yield (partition.start + i, *row)


def _text(value) -> str:
    return value.decode() if isinstance(value, bytes) else str(value)


class H5adSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "h5ad"

    def schema(self) -> StructType:
        reader = H5adReader(self.options)
        if reader.table == "counts":
            return StructType([StructField("row_idx", LongType()), StructField("gene_idx", LongType()), StructField("value", DoubleType())])
        if reader.table == "genes":
            return StructType([StructField("gene_idx", LongType()), StructField("gene", StringType())])
        if reader.table == "uns":
            return StructType([StructField("key", StringType()), StructField("value", StringType())])
        strings = [StructField(c, StringType()) for c in ("cell_id", *reader.obs)]
        return StructType([StructField("row_idx", LongType()), *strings, *(StructField(k, ArrayType(DoubleType())) for k in reader.obsm)])

    def reader(self, schema: StructType) -> H5adReader:
        return H5adReader(self.options)
