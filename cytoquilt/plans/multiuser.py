"""Several users on one store: each step works on a branch, commits once, and moves main forward. Steps done before are skipped."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.shapes import slug_name
from ..model import AnnMatrix
from ..operators import embed, layout, preprocess, select
from ..operators.layout import compressed
from ..sources.store import Store, matrix


def _branch(store: Store, name: str) -> str:
    if name in store.branches():
        store.reset_branch(name, store.lookup("main"))
    else:
        store.create_branch(name)
    return name


def ingest(store: Store, ann: AnnMatrix) -> str | None:
    """Commit the raw matrix to main, once."""
    if store.readonly().exists("X"):
        return None
    return store.write(ann, message="ingest raw counts")


def add_normalized(store: Store, user: str) -> str | None:
    """layers/norm on the user's branch, then main moves to it. The raw X keeps its files."""
    if store.readonly().exists("layers/norm"):
        return None
    s = store.writable(_branch(store, user))
    node = s.node("X")
    logged = preprocess.log1p(preprocess.normalize_total(matrix(s)))
    s.write("layers/norm", compressed(logged), kind="matrix", sort=["row_id"], format="csr", shape=node["shape"], chunk=node["chunk"], dtype="double")
    new = s.commit(f"{user}: normalised layer")
    store.reset_branch("main", new)
    return new


def analyse(store: Store, user: str, column: str, value: str, n_top_genes: int = 2000, n_comps: int = 30, n_neighbors: int = 15, seed: int = 0) -> str | None:
    """Analysis of one kind of cells under analyses/<name>: labels, layout and variable genes; then main moves to it."""
    group = f"analyses/{slug_name(value)}"
    if store.readonly().exists(f"{group}/obs"):
        return None
    s = store.writable(_branch(store, user))
    obs = select.checked(s.read("obs"), **{column: value})
    x = select.by_frame(matrix(s, "layers/norm"), "row_id", obs, "row_id")
    n = obs.agg(F.count(F.lit(1)).alias("n"))
    top = preprocess.variable_genes(preprocess.variable_stats(x, n, genes=s.read("var")), n_top_genes).persist()
    new = select.reindexed(s.read("var"), top).withColumnRenamed("col_id", "__c")
    few = preprocess.scale(x.join(new, F.col("col_id") == F.col("__c")).select("row_id", F.col("new_id").alias("col_id"), "value"), n)
    genes = top.count()
    points = layout.dense_rows(layout.compressed(few), genes).select("row_id", F.col("values").alias("vec"))
    scores, _, _ = embed.pca(points, min(n_comps, genes))
    vectors = scores.select("row_id", F.col("scores").alias("vec")).persist()
    graph = embed.connectivities(embed.knn_ivf(vectors, vectors, n_neighbors, max(1, min(256, int(vectors.count() ** 0.5))), 8, seed=seed), n_neighbors).persist()
    labels, xy = embed.leiden(graph, seed=seed), embed.umap(graph, seed=seed)
    out = obs.select(F.col("row_id").alias("cell_index")).join(labels.select("node", F.col("community").cast("string").alias("leiden")), F.col("cell_index") == F.col("node"), "left").drop("node")
    s.write(f"{group}/obs", out, sort=["cell_index"])
    s.write(f"{group}/X_umap", xy.select(F.col("node").alias("cell_index"), "x", "y"))
    s.write(f"{group}/var", s.read("var").join(top.select(F.col("col_id").alias("__c")), F.col("col_id") == F.col("__c"), "left").select("col_id", F.col("__c").isNotNull().alias("highly_variable")))
    commit = s.commit(f"{user}: {column} = {value}")
    store.reset_branch("main", commit)
    return commit


def history(store: Store, branch: str = "main") -> list[str]:
    return [f"{s['id'][:8]} {s['message']}" for s in store.ancestry(branch)]
