"""The H5AD reader against a stand-in for h5py, which isn't installed here: groups, datasets and attributes of nested dictionaries."""

import importlib.util
import json

import numpy as np
import pytest
from nichewright.sources import h5ad


class Group(dict):
    def __init__(self, attrs=None, **held):
        super().__init__(**held)
        self.attrs = attrs or {}


class Dataset:
    """Slices like an h5py dataset; ``[()]`` is all of it."""

    reads: list = []

    def __init__(self, values):
        self.values, self.shape, self.attrs = np.asarray(values), np.shape(values), {}

    def __len__(self):
        return len(self.values)

    def __getitem__(self, at):
        Dataset.reads.append(at)
        return self.values[at]


RNG = np.random.default_rng(6)
DENSE = RNG.integers(0, 3, (23, 7)) * (RNG.random((23, 7)) < 0.4)


def compressed(x, kind):
    rows = x if kind == "csr_matrix" else x.T
    indices = [np.flatnonzero(r) for r in rows]
    data = [r[i] for r, i in zip(rows, indices, strict=True)]
    return Group({"encoding-type": kind, "shape": np.array(x.shape)}, data=Dataset(np.concatenate(data).astype("f4")), indices=Dataset(np.concatenate(indices)), indptr=Dataset(np.cumsum([0, *map(len, indices)])))


def stored(x):
    cells = [f"c{i}".encode() for i in range(23)]
    kind = Group({}, categories=Dataset(np.array([b"t", b"u"], object)), codes=Dataset([i % 3 - 1 for i in range(23)]))
    return Group(
        {},
        X=x,
        layers=Group({}, twice=Dataset(DENSE * 2)),
        obs=Group({"_index": "name"}, name=Dataset(np.array(cells, object)), kind=kind, size=Dataset(np.arange(23))),
        var=Group({"_index": "gene"}, gene=Dataset(np.array([f"g{i}" for i in range(7)], object))),
        obsm=Group({}, X_pca=Dataset(DENSE[:, :2] / 2)),
        uns=Group({}, run=Group({}, note=Dataset(np.array(b"done", object)), sizes=Dataset([1, 2])), seed=Dataset(5)),
    )


@pytest.fixture
def opened(monkeypatch):
    def use(file):
        class Opened:
            def __init__(self, path, mode):
                assert (path, mode) == ("some.h5ad", "r")

            def __enter__(self):
                return file

            def __exit__(self, *_):
                return None

        monkeypatch.setattr(h5ad, "_h5py", lambda: type("h5py", (), {"File": Opened}))

    return use


def rows(**options):
    reader = h5ad.H5adReader({"path": "some.h5ad"} | options)
    return [r for part in reader.partitions() for r in reader.read(part)]


@pytest.mark.parametrize("x", [Dataset(DENSE), compressed(DENSE, "csr_matrix"), compressed(DENSE, "csc_matrix")], ids=["dense", "by rows", "by columns"])
@pytest.mark.parametrize(("step", "batch"), [("100", "1000"), ("5", "2"), ("1", "1")])
def test_counts_by_ranges(opened, x, step, batch):
    opened(stored(x))
    found = {(r, g): v for b in rows(table="counts", rows=step, batch=batch) for r, g, v in zip(*(c.to_pylist() for c in b.columns), strict=True)}
    assert found == {(i, j): float(DENSE[i, j]) for i, j in zip(*np.nonzero(DENSE), strict=True)}


def test_a_range_reads_no_more_than_itself(opened):
    x = compressed(DENSE, "csr_matrix")
    opened(stored(x))
    reader = h5ad.H5adReader({"path": "some.h5ad", "table": "counts", "rows": "5"})
    part = reader.partitions()[2]
    Dataset.reads.clear()
    list(reader.read(part))
    ends = x["indptr"].values
    assert (part.start, part.stop) == (10, 15) and Dataset.reads == [slice(10, 16), slice(ends[10], ends[15]), slice(ends[10], ends[15])]


def test_layers_genes_cells_and_metadata(opened):
    opened(stored(Dataset(DENSE)))
    assert sum(b.column("value").to_numpy().sum() for b in rows(table="counts", layer="twice", rows="4")) == 2 * DENSE.sum()
    assert rows(table="genes", rows="3") == [(i, f"g{i}") for i in range(7)]
    cells = rows(obs="kind,size", obsm="X_pca", rows="10")
    assert cells[0] == (0, "c0", None, "0", (DENSE[0, :2] / 2).tolist()) and cells[4][:4] == (4, "c4", "t", "4") and len(cells) == 23
    assert {k: json.loads(v) for k, v in rows(table="uns")} == {"run/note": "done", "run/sizes": [1, 2], "seed": 5}


def test_schemas_and_errors(opened):
    opened(stored(Group({"encoding-type": "other", "shape": (1, 1)})))
    of = lambda **o: h5ad.H5adSource({"path": "some.h5ad"} | o).schema().simpleString()
    assert of(table="counts") == "struct<row_idx:bigint,gene_idx:bigint,value:double>" and of(table="uns") == "struct<key:string,value:string>"
    assert of(obs="kind", obsm="X_pca") == "struct<row_idx:bigint,cell_id:string,kind:string,X_pca:array<double>>" and of(table="genes") == "struct<gene_idx:bigint,gene:string>"
    with pytest.raises(ValueError, match="other"):
        rows(table="counts")
    with pytest.raises(ValueError, match="table must be"):
        rows(table="cells")


def test_without_the_library_the_reader_says_so():
    if importlib.util.find_spec("h5py") is None:
        with pytest.raises(ImportError, match="needs h5py"):
            h5ad._h5py()
