"""Annotated matrices in HDF5 files (.h5ad, 10x .h5), where h5py is installed.

The driver reads names, shapes and types only. Matrices, columns and vectors are read by
executors, a band of rows (or of columns, for a column layout) at a time; the path must be
one that all of them see. What a file holds and this reader does not know is an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, StringType, StructField, StructType

from ..model import AnnMatrix

#: Rows (or columns) that one band of a file holds, and entries of an Arrow batch.
BAND, BATCH = 4096, 1 << 18
KINDS = {"csr_matrix": "csr", "csc_matrix": "csc"}
TRIPLETS = StructType([StructField("row_id", LongType()), StructField("col_id", LongType()), StructField("value", DoubleType())])


def _h5py():
    try:
        import h5py
    except ImportError as e:
        raise RuntimeError("HDF5 files need h5py, which is not installed here; export the matrix as Parquet or MatrixMarket") from e
    return h5py


def _word(v):
    return v.decode() if isinstance(v, bytes) else v.item() if isinstance(v, np.generic) else v


def _is_group(h5py, node) -> bool:
    return isinstance(node, h5py.Group)


def _bands(spark: SparkSession, path: str, n: int, schema: StructType, read: Callable) -> DataFrame:
    """read(file, first, last) -> columns of schema, for every band of n rows, on executors."""
    bands = -(-n // BAND)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _h5py().File(path, "r") as f:
            for batch in batches:
                for k in batch.column(0).to_pylist():
                    cols = read(f, k * BAND, min((k + 1) * BAND, n))
                    whole = pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, arrow)], schema=arrow)
                    for at in range(0, whole.num_rows, BATCH):
                        yield whole.slice(at, BATCH)

    return spark.range(bands, numPartitions=max(1, min(bands, 10_000))).mapInArrow(run, schema)


def _matrix(spark: SparkSession, h5py, f, path: str, where: str, names: tuple[str, str] = ("row_id", "col_id")) -> tuple[DataFrame, tuple[int, int]]:
    """(triplets, shape) of a dense, CSR or CSC matrix below `where`."""
    node = f[where]
    schema = StructType([StructField(n, LongType()) for n in names] + [TRIPLETS["value"]])
    if not _is_group(h5py, node):
        if len(node.shape) != 2:
            raise ValueError(f"{where} has {len(node.shape)} dimensions")

        def dense(f, a: int, b: int) -> tuple:
            x = np.asarray(f[where][a:b])
            r, c = x.nonzero()
            return r + a, c, x[r, c].astype(float)

        return _bands(spark, path, node.shape[0], schema, dense), tuple(map(int, node.shape))
    kind = KINDS.get(_word(node.attrs.get("encoding-type", node.attrs.get("h5sparse_format", ""))))
    if kind is None:
        raise ValueError(f"{where} holds no matrix that can be read: {dict(node.attrs)}")
    shape = tuple(int(v) for v in node.attrs.get("shape", node.attrs.get("h5sparse_shape")))

    def sparse(f, a: int, b: int) -> tuple:
        g = f[where]
        ptr = np.asarray(g["indptr"][a : b + 1]).astype(np.int64)
        major = np.repeat(np.arange(a, b), np.diff(ptr))
        minor = np.asarray(g["indices"][int(ptr[0]) : int(ptr[-1])]).astype(np.int64)
        value = np.asarray(g["data"][int(ptr[0]) : int(ptr[-1])]).astype(float)
        return (major, minor, value) if kind == "csr" else (minor, major, value)

    return _bands(spark, path, shape[0] if kind == "csr" else shape[1], schema, sparse), shape


def _column(h5py, node, what: str):
    """(type, reader of a band) of a column: plain, categorical, or with a mask."""
    if _is_group(h5py, node):
        if "codes" in node and "categories" in node:
            names = [_word(v) for v in node["categories"][:]]
            kind, _ = _plain(np.asarray(names) if names else np.zeros(0, "U1"))
            return kind, lambda n, a, b: [names[k] if k >= 0 else None for k in n["codes"][a:b]]
        if "values" in node and "mask" in node:
            kind, cast = _plain(np.asarray(node["values"][:0]))
            return kind, lambda n, a, b: [None if m else cast(v) for v, m in zip(n["values"][a:b], n["mask"][a:b])]
        raise ValueError(f"column {what} cannot be read: {dict(node.attrs)}")
    kind, cast = _plain(np.asarray(node[:0]))
    return kind, lambda n, a, b: [cast(v) for v in n[a:b]]


def _plain(sample: np.ndarray):
    if sample.dtype.kind == "b":
        return BooleanType(), bool
    if sample.dtype.kind in "iu":
        return LongType(), int
    if sample.dtype.kind == "f":
        return DoubleType(), float
    return StringType(), _word


def _axis(spark: SparkSession, h5py, f, path: str, where: str, key: str, name: str) -> tuple[DataFrame, int]:
    """(key, name, columns) of obs or var."""
    g = f[where]
    index = _word(g.attrs["_index"])
    n = int(g[index].shape[0])
    order = [_word(c) for c in g.attrs.get("column-order", [])]
    made = [(c, *_column(h5py, g[c], f"{where}/{c}")) for c in order]
    clash = {key, name} & {c for c, _, _ in made}
    if clash:
        raise ValueError(f"{where} has columns named like the engine's own: {sorted(clash)}")
    schema = StructType([StructField(key, LongType()), StructField(name, StringType()), *(StructField(c, kind) for c, kind, _ in made)])

    def read(f, a: int, b: int) -> list:
        g = f[where]
        return [np.arange(a, b), [str(_word(v)) for v in g[index][a:b]], *(get(g[c], a, b) for c, _, get in made)]

    return _bands(spark, path, n, schema, read), n


def _vectors(spark: SparkSession, h5py, f, path: str, where: str, key: str) -> DataFrame:
    node = f[where]
    if _is_group(h5py, node) or len(node.shape) != 2:
        raise ValueError(f"{where} is no dense two-dimensional array")
    schema = StructType([StructField(key, LongType()), StructField("vec", ArrayType(DoubleType()))])
    return _bands(spark, path, int(node.shape[0]), schema, lambda f, a, b: (np.arange(a, b), list(np.asarray(f[where][a:b]).astype(float))))


def _values(h5py, node):
    """Unstructured values: groups as dicts, arrays as lists."""
    if _is_group(h5py, node):
        if _word(node.attrs.get("encoding-type", "dict")) not in ("dict", ""):
            raise ValueError(f"unstructured value cannot be read: {dict(node.attrs)}")
        return {k: _values(h5py, node[k]) for k in node}
    x = node[()]
    return [_word(v) for v in x.tolist()] if isinstance(x, np.ndarray) and x.ndim else _word(x.item() if isinstance(x, np.ndarray) else x)


def read_h5ad(spark: SparkSession, path: str) -> AnnMatrix:
    """An .h5ad file with all its parts: X, layers and raw in any layout, obs, var, obsm, varm, obsp, varp, uns."""
    h5py = _h5py()
    with h5py.File(path, "r") as f:
        known = {"X", "obs", "var", "layers", "obsm", "varm", "obsp", "varp", "uns", "raw"}
        strange = sorted(set(f) - known)
        if strange:
            raise ValueError(f"parts that cannot be read: {strange}")
        (obs, n_obs), (var, n_var) = _axis(spark, h5py, f, path, "obs", "row_id", "obs_name"), _axis(spark, h5py, f, path, "var", "col_id", "var_name")

        def matrix(where: str) -> DataFrame:
            x, shape = _matrix(spark, h5py, f, path, where)
            if shape != (n_obs, n_var):
                raise ValueError(f"{where} is {shape}, the axes are {(n_obs, n_var)}")
            return x

        inside = lambda g: sorted(f[g]) if g in f else []
        raw = None
        if "raw" in f:
            raw_var, _ = _axis(spark, h5py, f, path, "raw/var", "col_id", "var_name")
            raw = AnnMatrix(obs=obs, var=raw_var, x=_matrix(spark, h5py, f, path, "raw/X")[0], varm={k: _vectors(spark, h5py, f, path, f"raw/varm/{k}", "col_id") for k in (sorted(f["raw/varm"]) if "varm" in f["raw"] else [])})
        return AnnMatrix(
            obs=obs, var=var, x=matrix("X") if "X" in f else None, layers={k: matrix(f"layers/{k}") for k in inside("layers")},
            obsm={k: _vectors(spark, h5py, f, path, f"obsm/{k}", "row_id") for k in inside("obsm")}, varm={k: _vectors(spark, h5py, f, path, f"varm/{k}", "col_id") for k in inside("varm")},
            obsp={k: _matrix(spark, h5py, f, path, f"obsp/{k}", ("row_id", "row_id2"))[0] for k in inside("obsp")}, varp={k: _matrix(spark, h5py, f, path, f"varp/{k}", ("col_id", "col_id2"))[0] for k in inside("varp")},
            uns=_values(h5py, f["uns"]) if "uns" in f else {}, raw=raw,
        )


def read_10x(spark: SparkSession, path: str) -> AnnMatrix:
    """A 10x HDF5 file: stored by barcode, so its flat arrays are rows of cells by genes."""
    h5py = _h5py()
    with h5py.File(path, "r") as f:
        n_genes, n_cells = (int(v) for v in f["matrix/shape"][:])
        kinds = {k: c for k, c in (("id", "gene_id"), ("feature_type", "feature_type"), ("genome", "genome")) if k in f["matrix/features"]}

    def sparse(f, a: int, b: int) -> tuple:
        m = f["matrix"]
        ptr = np.asarray(m["indptr"][a : b + 1]).astype(np.int64)
        cut = slice(int(ptr[0]), int(ptr[-1]))
        return np.repeat(np.arange(a, b), np.diff(ptr)), np.asarray(m["indices"][cut]).astype(np.int64), np.asarray(m["data"][cut]).astype(float)

    words = lambda d, a, b: [_word(v) for v in d[a:b]]
    obs = _bands(spark, path, n_cells, StructType([StructField("row_id", LongType()), StructField("obs_name", StringType())]), lambda f, a, b: (np.arange(a, b), words(f["matrix/barcodes"], a, b)))
    var = _bands(spark, path, n_genes, StructType([StructField("col_id", LongType()), StructField("var_name", StringType()), *(StructField(c, StringType()) for c in kinds.values())]), lambda f, a, b: (np.arange(a, b), words(f["matrix/features/name"], a, b), *(words(f[f"matrix/features/{k}"], a, b) for k in kinds)))
    return AnnMatrix(obs=obs, var=var, x=_bands(spark, path, n_cells, TRIPLETS, sparse))
