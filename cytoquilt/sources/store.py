"""A versioned store of annotated matrices on Parquet.

    refs/<branch>/<n>.json    the branch's n-th snapshot id; the highest n counts
    snapshots/<id>.json       parent, message and nodes: path -> folder, format, attributes
    data/<name>/              immutable Parquet folders, shared by all snapshots that name them

A commit writes its snapshot file and then creates the branch's next ref, which fails if
another writer was first. Readers resolve one snapshot when they open a session, so they
never see half a commit; nothing that a snapshot names is ever rewritten.
"""

from __future__ import annotations

import json
import os
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import AnnMatrix
from ..operators import layout
from .files import Files

FORMATS = ("csr", "csc", "dense")


class StoreError(RuntimeError):
    """A store that is missing, exists already, or was changed by someone else."""


@dataclass
class Session:
    """One snapshot of a branch; a writable one stages nodes until it commits."""

    store: Store
    branch: str
    snapshot: str
    nodes: dict[str, dict]
    writable: bool = False
    staged: dict[str, dict] = field(default_factory=dict)

    def exists(self, path: str) -> bool:
        return path in self.staged or path in self.nodes

    def node(self, path: str) -> dict:
        found = self.staged.get(path) or self.nodes.get(path)
        if found is None:
            raise StoreError(f"no {path}; there are {sorted({*self.nodes, *self.staged})}")
        return found

    def read(self, path: str) -> DataFrame:
        return self.store.spark.read.parquet(f"{self.store.root}/data/{self.node(path)['dir']}")

    def write(self, path: str, df: DataFrame, kind: str = "table", sort: list[str] | None = None, files: int | None = None, **attrs) -> None:
        """Stage a table. With `sort`, rows are range-partitioned and sorted, so that filters skip row groups."""
        if not self.writable:
            raise StoreError("this session is read-only")
        name = f"{path.replace('/', '.')}-{os.urandom(6).hex()}"
        if sort:
            df = (df.repartitionByRange(files, *sort) if files else df.repartitionByRange(*sort)).sortWithinPartitions(*sort)
        df.write.option("compression", "zstd").option("parquet.block.size", 16 << 20).parquet(f"{self.store.root}/data/{name}")
        self.staged[path] = {"dir": name, "kind": kind, **attrs}

    def remove(self, path: str) -> None:
        self.node(path)
        self.staged[path] = {}

    def set_uns(self, uns: dict) -> None:
        self.staged["uns"] = {"kind": "dict", "value": uns}

    def commit(self, message: str) -> str:
        """One atomic commit of all that is staged; fails if the branch has moved since the session was opened."""
        if not self.writable:
            raise StoreError("this session is read-only")
        nodes = {k: v for k, v in (self.nodes | self.staged).items() if v}
        new = self.store._snapshot(self.snapshot, message, nodes)
        self.store._move(self.branch, new, self.snapshot)
        self.nodes, self.staged, self.snapshot = nodes, {}, new
        return new


class Store:
    def __init__(self, spark: SparkSession, root: str):
        if root.startswith("gs://") and not spark.conf.get("spark.hadoop.fs.gs.impl", None):
            raise StoreError("gs:// needs the Hadoop connector on the class path (spark.hadoop.fs.gs.impl)")
        self.spark, self.root = spark, root.rstrip("/")
        self.files = Files(spark, self.root)

    # -- life of a store

    @staticmethod
    def exists(spark: SparkSession, root: str) -> bool:
        return Files(spark, root).exists("refs")

    @classmethod
    def create(cls, spark: SparkSession, root: str, overwrite: bool = False) -> Store:
        store = cls(spark, root)
        if store.files.exists():
            if not overwrite:
                raise StoreError(f"{root} exists; overwrite is off")
            store.files.delete()
        first = store._snapshot(None, "created", {})
        store.files.create("refs/main/0000000000.json", json.dumps({"snapshot": first}))
        return store

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> Store:
        if not cls.exists(spark, root):
            raise StoreError(f"no store at {root}")
        return cls(spark, root)

    @classmethod
    def open_or_create(cls, spark: SparkSession, root: str) -> Store:
        return cls.open(spark, root) if cls.exists(spark, root) else cls.create(spark, root)

    # -- snapshots and branches

    def _snapshot(self, parent: str | None, message: str, nodes: dict) -> str:
        new = os.urandom(10).hex()
        self.files.create(f"snapshots/{new}.json", json.dumps({"parent": parent, "message": message, "time": time.time(), "nodes": nodes}))
        return new

    def _move(self, branch: str, new: str, expected: str | None) -> None:
        refs = self.files.list(f"refs/{branch}")
        if expected is not None and self.lookup(branch) != expected:
            raise StoreError(f"{branch} has moved; open a new session")
        try:
            self.files.create(f"refs/{branch}/{(int(refs[-1][:10]) + 1 if refs else 0):010d}.json", json.dumps({"snapshot": new}))
        except Exception as e:
            raise StoreError(f"{branch} has moved; open a new session") from e

    def lookup(self, branch: str) -> str:
        refs = [r for r in self.files.list(f"refs/{branch}") if r.endswith(".json")]
        if not refs:
            raise StoreError(f"no branch {branch}; there are {self.branches()}")
        return json.loads(self.files.read(f"refs/{branch}/{refs[-1]}"))["snapshot"]

    def branches(self) -> list[str]:
        return self.files.list("refs")

    def create_branch(self, branch: str, snapshot: str | None = None) -> None:
        if branch in self.branches():
            raise StoreError(f"branch {branch} exists")
        self._move(branch, snapshot or self.lookup("main"), None)

    def reset_branch(self, branch: str, snapshot: str) -> None:
        """Point a branch at any snapshot; main is moved forward to a finished branch this way."""
        self._load(snapshot)
        self._move(branch, snapshot, None)

    def _load(self, snapshot: str) -> dict:
        return json.loads(self.files.read(f"snapshots/{snapshot}.json"))

    def ancestry(self, branch: str = "main") -> list[dict]:
        """Snapshots of a branch, newest first."""
        out, at = [], self.lookup(branch)
        while at:
            s = self._load(at)
            out.append({"id": at, "message": s["message"], "time": s["time"]})
            at = s["parent"]
        return out

    def readonly(self, branch: str = "main", snapshot: str | None = None) -> Session:
        at = snapshot or self.lookup(branch)
        return Session(self, branch, at, self._load(at)["nodes"])

    def writable(self, branch: str = "main") -> Session:
        s = self.readonly(branch)
        s.writable = True
        return s

    # -- matrices

    def write(self, ann: AnnMatrix, fmt: str = "csr", branch: str = "main", message: str = "write", sort: list[str] | None = None, chunk: tuple[int, int] = (2048, 2048)) -> str:
        """All parts of a matrix in one commit, X last. Layers and raw follow X's format."""
        s = self.writable(branch)
        stage(s, ann, fmt, sort, chunk)
        return s.commit(message)

    def load(self, branch: str = "main", snapshot: str | None = None) -> AnnMatrix:
        return load(self.readonly(branch, snapshot))


def _packed(x: DataFrame, fmt: str, shape: tuple[int, int], chunk: tuple[int, int]) -> tuple[DataFrame, list[str]]:
    if fmt == "csr":
        return layout.compressed(x), ["row_id"]
    if fmt == "csc":
        return layout.compressed(x, "col_id", "row_id"), ["col_id"]
    if fmt == "dense":
        return layout.tiles(x, *shape, *chunk), ["row_block", "col_block"]
    raise StoreError(f"unknown format {fmt}; there are {FORMATS}")


def stage(s: Session, ann: AnnMatrix, fmt: str, sort: list[str] | None = None, chunk: tuple[int, int] = (2048, 2048), prefix: str = "") -> None:
    s.write(f"{prefix}obs", ann.obs, sort=sort or ["row_id"], columns=ann.obs.columns)
    if ann.var is not None:
        s.write(f"{prefix}var", ann.var, sort=["col_id"], columns=ann.var.columns)
    if ann.uns:
        s.set_uns(ann.uns)
    for group, parts in (("obsm", ann.obsm), ("varm", ann.varm), ("obsp", ann.obsp), ("varp", ann.varp)):
        for k, v in parts.items():
            s.write(f"{prefix}{group}/{k}", v, kind=group)
    matrices = ([("X", ann.x)] if ann.x is not None else []) + [(f"layers/{k}", v) for k, v in ann.layers.items()]
    if matrices:
        n = ann.obs.agg(F.max("row_id")).first()[0]
        g = ann.var.agg(F.max("col_id")).first()[0]
        shape = (int(n or 0) + 1, int(g or 0) + 1) if n is not None else (0, 0)
        for name, x in matrices:
            df, key = _packed(x, fmt, shape, chunk)
            s.write(f"{prefix}{name}", df, kind="matrix", sort=key, format=fmt, shape=list(shape), chunk=list(chunk), dtype=dict(x.dtypes)["value"])
    if ann.raw is not None:
        stage(s, ann.raw, fmt, None, chunk, prefix + "raw/")


def matrix(s: Session, path: str = "X") -> DataFrame:
    """Triplets of a stored matrix, whatever its layout."""
    node, df = s.node(path), s.read(path)
    if node["format"] == "csr":
        return layout.triplets(df).select("row_id", "col_id", "value")
    if node["format"] == "csc":
        return layout.triplets(df, "col_id", "row_id").select("row_id", "col_id", "value")
    rows, cols = node["chunk"]
    cells = df.select("row_block", "col_block", "n_cols", F.posexplode("values").alias("p", "value")).where("value <> 0")
    return cells.select((F.col("row_block") * rows + F.floor(F.col("p") / F.col("n_cols"))).alias("row_id"), (F.col("col_block") * cols + F.col("p") % F.col("n_cols")).alias("col_id"), "value")


def open_x(s: Session, path: str = "X") -> dict:
    """Format, sparseness, shape and type of a matrix from the manifest alone."""
    n = s.node(path)
    return {"format": n["format"], "is_sparse": n["format"] != "dense", "n_obs": n["shape"][0], "n_vars": n["shape"][1], "dtype": n["dtype"]}


def load(s: Session, prefix: str = "") -> AnnMatrix:
    names = [k[len(prefix) :] for k in s.nodes if k.startswith(prefix)]
    group = lambda g: {k.split("/", 1)[1]: s.read(prefix + k) for k in names if k.startswith(g + "/")}
    return AnnMatrix(
        obs=s.read(prefix + "obs"),
        var=s.read(prefix + "var") if "var" in names else None,
        x=matrix(s, prefix + "X") if "X" in names else None,
        layers={k.split("/", 1)[1]: matrix(s, prefix + k) for k in names if k.startswith("layers/")},
        obsm=group("obsm"), varm=group("varm"), obsp=group("obsp"), varp=group("varp"),
        uns=s.nodes["uns"]["value"] if not prefix and "uns" in s.nodes else {},
        raw=load(s, "raw/") if not prefix and any(k.startswith("raw/") for k in names) else None,
    )


def write_back(store: Store, embedding: DataFrame, labels: DataFrame, branch: str = "main", umap_key: str = "X_umap", label_key: str = "leiden", message: str = "results") -> str:
    """Add a layout and a label column; doing it again replaces both. X is shared with the snapshot before."""
    s = store.writable(branch)
    obs = s.read("obs")
    with_label = obs.drop(label_key).join(labels.select(F.col("node").alias("__n"), F.col("community").alias(label_key)), F.col("row_id") == F.col("__n"), "left").drop("__n")
    s.write("obs", with_label, sort=["row_id"], columns=with_label.columns)
    s.write(f"obsm/{umap_key}", embedding.select(F.col("node").alias("row_id"), F.array("x", "y").alias("vec")), kind="obsm")
    return s.commit(message)


def write_subset(store: Store, name: str, obs: DataFrame, embedding: DataFrame, umap_key: str = "X_umap") -> Store:
    """A view without X at subsets/<name> below the store, replaced if it is there."""
    view = Store.create(store.spark, f"{store.root}/subsets/{name}", overwrite=True)
    view.write(AnnMatrix(obs=obs, obsm={umap_key: embedding}), message=f"subset {name}")
    return view
