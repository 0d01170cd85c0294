"""The standard analysis of a stored matrix, timed step by step."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shapes import slug_name
from ..operators import embed, layout, preprocess, select
from ..sources.store import Store, write_back, write_subset


@dataclass(frozen=True)
class Settings:
    """Defaults of a run; each field is also a flag of the command line."""

    data_path: str = ""
    branch: str = "main"
    subset_column: str = ""
    subset_value: str = ""
    write_results: bool = True
    subset_dir_name: str = ""
    umap_key: str = "X_umap"
    leiden_key: str = "leiden"
    n_top_genes: int = 2000
    n_comps: int = 30
    n_neighbors: int = 20
    neighbors_algorithm: str = "ivfflat"
    leiden_resolution: float = 1.1
    leiden_iterations: int = 100
    umap_min_dist: float = 0.45
    batch_key: str = ""
    random_seed: int = 5671
    label: str = ""


def neighbours(points: DataFrame, s: Settings) -> DataFrame:
    if s.neighbors_algorithm == "brute":
        return embed.knn_brute(points, points, s.n_neighbors)
    if s.neighbors_algorithm not in ("ivfflat", "ivfpq", "mg_ivfflat", "mg_ivfpq"):
        raise ValueError(f"unknown neighbours algorithm {s.neighbors_algorithm}")
    pieces = embed.PIECES if s.neighbors_algorithm.endswith("ivfpq") else 0
    return embed.knn_ivf(points, points, s.n_neighbors, 0, 0, seed=s.random_seed, pieces=pieces)


def run(spark: SparkSession, s: Settings, on_step: Callable[[str, float], None] | None = None) -> dict:
    """Load, subset, metrics, normalise, variable genes, scale, PCA, correction, neighbours, layout, communities, write back."""
    steps: list[tuple[str, float]] = []
    clock = time.time()

    def done(name: str) -> None:
        nonlocal clock
        steps.append((name, time.time() - clock))
        if on_step:
            on_step(*steps[-1])
        clock = time.time()

    store = Store.open(spark, s.data_path)
    ann = store.load(s.branch)
    if s.subset_column:
        ann = ann.subset(**{s.subset_column: s.subset_value})
    done("load")
    n = ann.n_obs()
    qc = preprocess.qc_cells(ann.obs, ann.x)
    logged = ann.normalized()
    done("normalize")
    top = preprocess.variable_genes(preprocess.variable_stats(logged.x, n, genes=logged.var), s.n_top_genes).persist()
    n_genes = top.count()
    few = logged.genes(top)
    done("hvg")
    scaled = preprocess.scale(few.x, n)
    dense = layout.dense_rows(layout.compressed(scaled), n_genes)
    points = select.by_frame(dense, "row_id", ann.obs, "row_id").select("row_id", F.col("values").alias("vec"))
    comps = min(s.n_comps, n_genes)
    scores, _, share = embed.pca(points, comps)
    x_pca = scores.select("row_id", F.col("scores").alias("vec")).persist()
    x_pca.count()
    done("pca")
    if s.batch_key:
        with_batch = x_pca.join(ann.obs.select(F.col("row_id").alias("__r"), s.batch_key), F.col("row_id") == F.col("__r")).select("row_id", "vec", s.batch_key)
        x_pca = embed.harmony(with_batch, s.batch_key, seed=s.random_seed).select("row_id", "vec").persist()
        done("harmony")
    graph = embed.connectivities(neighbours(x_pca, s), s.n_neighbors).persist()
    graph.count()
    done("neighbors")
    xy = embed.umap(graph, s.umap_min_dist, seed=s.random_seed)
    done("umap")
    labels = embed.leiden(graph, s.leiden_resolution, s.leiden_iterations, s.random_seed)
    done("leiden")
    if s.write_results and s.subset_column:
        name = s.subset_dir_name or slug_name(f"{s.subset_column}_{s.subset_value}")
        obs = ann.obs.join(labels.select(F.col("node").alias("__n"), F.col("community").alias(s.leiden_key)), F.col("row_id") == F.col("__n"), "left").drop("__n")
        write_subset(store, name, obs, xy.select(F.col("node").alias("row_id"), F.array("x", "y").alias("vec")), s.umap_key)
    elif s.write_results:
        write_back(store, xy, labels, s.branch, s.umap_key, s.leiden_key)
    done("write")
    return {"steps": steps, "qc": qc, "umap": xy, "labels": labels, "graph": graph, "variance_ratio": share}
