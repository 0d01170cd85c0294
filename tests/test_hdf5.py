"""HDF5 inputs, read through a stand-in for h5py: a pickled tree of dicts with attributes, in a module that executors import too."""

import pickle
import sys
import types

import numpy as np
import pytest

from cytoquilt.sources import hdf5
from cytoquilt.sources.inputs import read_any

STAND_IN = """
import pickle
import numpy as np


class Dataset:
    def __init__(self, x):
        self.x, self.shape = x, x.shape

    def __getitem__(self, at):
        return self.x[at]


class Group:
    def __init__(self, tree, attrs):
        self.tree, self.attrs = tree, attrs

    def __getitem__(self, name):
        at = self
        for part in name.split("/"):
            node = at.tree[part]
            at = Group(*node) if isinstance(node, tuple) else Dataset(node)
        return at

    def __iter__(self):
        return iter(self.tree)

    def __contains__(self, name):
        return name in self.tree


class File(Group):
    def __init__(self, path, mode):
        with open(path, "rb") as f:
            super().__init__(pickle.load(f), {})

    def __enter__(self):
        return self

    def __exit__(self, *why):
        pass
"""


@pytest.fixture(scope="module")
def h5(spark, tmp_path_factory):
    where = tmp_path_factory.mktemp("h5") / "h5py.py"
    where.write_text(STAND_IN)
    spark.sparkContext.addPyFile(str(where))
    module = types.ModuleType("h5py")
    exec(STAND_IN, module.__dict__)
    before = sys.modules.get("h5py")
    sys.modules["h5py"] = module
    yield module
    sys.modules.pop("h5py") if before is None else sys.modules.__setitem__("h5py", before)


X = np.array([[1, 0, 2], [0, 3, 0], [4, 0, 5], [0, 0, 0], [0, 6, 0]], np.float32)


def packed(x, kind):
    rows = x if kind == "csr_matrix" else x.T
    ptr = np.concatenate([[0], np.cumsum([np.count_nonzero(r) for r in rows])])
    return ({"indptr": ptr, "indices": np.concatenate([r.nonzero()[0] for r in rows]).astype(np.int32), "data": np.concatenate([r[r != 0] for r in rows])}, {"encoding-type": kind, "shape": np.array(x.shape)})


def words(*w):
    return np.array([x.encode() for x in w], object)


def whole(x):
    axis = lambda names, cols: ({"_index": words(*names), **cols}, {"_index": "_index", "column-order": np.array(list(cols), object)})
    obs = {
        "kind": ({"codes": np.array([0, 1, -1, 1, 0], np.int8), "categories": words("A", "B")}, {"encoding-type": "categorical"}),
        "n": np.arange(5), "score": np.linspace(0, 1, 5), "ok": np.array([True, False, True, True, False]), "note": words("a", "b", "c", "d", "e"),
        "some": ({"values": np.arange(5), "mask": np.array([False, True, False, False, False])}, {"encoding-type": "nullable-integer"}),
    }
    return {
        "X": x, "obs": axis("abcde", obs), "var": axis(["g0", "g1", "g2"], {}), "layers": ({"dense": X, "columns": packed(X * 2, "csc_matrix")}, {}),
        "obsm": ({"X_umap": np.arange(10.0).reshape(5, 2)}, {}), "varm": ({"PCs": np.ones((3, 2))}, {}), "obsp": ({"near": packed(np.eye(5), "csr_matrix")}, {}), "varp": ({}, {}),
        "uns": ({"title": np.array(b"t", object), "list": np.arange(3), "deep": ({"k": np.float64(2.5)}, {})}, {}),
        "raw": ({"X": packed(X * 3, "csr_matrix"), "var": axis(["r0", "r1", "r2"], {})}, {}),
    }


def cells(df):
    return sorted(tuple(r) for r in df.collect())


def want(x):
    return sorted((int(i), int(j), float(x[i, j])) for i, j in zip(*x.nonzero()))


@pytest.mark.parametrize("layout", ["csr_matrix", "csc_matrix", "dense"])
def test_h5ad_with_all_parts(spark, h5, tmp_path, monkeypatch, layout):
    monkeypatch.setattr(hdf5, "BAND", 2)
    path = tmp_path / "a.h5ad"
    path.write_bytes(pickle.dumps(whole(X if layout == "dense" else packed(X, layout))))
    ann = read_any(spark, str(path))
    assert cells(ann.x) == cells(ann.layers["dense"]) == want(X)
    assert cells(ann.layers["columns"]) == want(X * 2) and cells(ann.raw.x) == want(X * 3)
    rows = [r.asDict() for r in ann.obs.orderBy("row_id").collect()]
    assert [r["kind"] for r in rows] == ["A", "B", None, "B", "A"] and [r["some"] for r in rows] == [0, None, 2, 3, 4]
    assert rows[1] == {"row_id": 1, "obs_name": "b", "kind": "B", "n": 1, "score": 0.25, "ok": False, "note": "b", "some": None}
    assert [r.var_name for r in ann.raw.var.orderBy("col_id").collect()] == ["r0", "r1", "r2"]
    assert [r.vec for r in ann.obsm["X_umap"].orderBy("row_id").collect()] == np.arange(10.0).reshape(5, 2).tolist() and ann.varm["PCs"].count() == 3
    assert cells(ann.obsp["near"]) == [(i, i, 1.0) for i in range(5)] and ann.obsp["near"].columns == ["row_id", "row_id2", "value"]
    assert ann.uns == {"title": "t", "list": [0, 1, 2], "deep": {"k": 2.5}}


def test_nothing_is_lost_in_silence(spark, h5, tmp_path):
    def read(change):
        tree = whole(packed(X, "csr_matrix"))
        change(tree)
        path = tmp_path / "b.h5ad"
        path.write_bytes(pickle.dumps(tree))
        return read_any(spark, str(path))

    for change in (lambda t: t.update(extra=X), lambda t: t.update(X=({}, {"encoding-type": "other"})), lambda t: t.update(X=X[:3]), lambda t: t["obsm"][0].update(table=({}, {})), lambda t: t["obs"][0].update(kind=({}, {}))):
        with pytest.raises(ValueError):
            read(change)
    assert read(lambda t: [t.pop(k) for k in ("X", "raw", "uns", "layers")]).x is None


def test_10x(spark, h5, tmp_path):
    """Three genes by two barcodes in the file: two cells by three genes here."""
    features = ({"id": words("G0", "G1", "G2"), "name": words("a", "b", "c"), "feature_type": words("E", "E", "E")}, {})
    tree = {"matrix": ({"barcodes": words("CELL1-1", "CELL2-1"), "data": np.array([1, 3, 2]), "indices": np.array([0, 2, 1]), "indptr": np.array([0, 2, 3]), "shape": np.array([3, 2]), "features": features}, {})}
    path = tmp_path / "c.h5"
    path.write_bytes(pickle.dumps(tree))
    ann = read_any(spark, str(path))
    assert cells(ann.x) == [(0, 0, 1.0), (0, 2, 3.0), (1, 1, 2.0)]
    assert [tuple(r) for r in ann.obs.orderBy("row_id").collect()] == [(0, "CELL1-1"), (1, "CELL2-1")]
    assert [tuple(r) for r in ann.var.orderBy("col_id").collect()][2] == (2, "c", "G2", "E")


def test_without_h5py(spark, monkeypatch):
    monkeypatch.setitem(sys.modules, "h5py", None)
    with pytest.raises(RuntimeError, match="h5py"):
        read_any(spark, "/nowhere/a.h5ad")
