"""Timed selections on a store, with run statistics of what they read."""

from __future__ import annotations

import time

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators import layout, select
from ..sources.store import Store, matrix, open_x


def run(spark: SparkSession, path: str, axis: str = "row", mode: str = "sequential", count: int | None = None, obs_column: str | None = None, obs_value: str | None = None, fmt: str = "native", repeats: int = 5, warmup: int = 1, seed: int = 0, branch: str = "main") -> dict:
    """One record: what was selected, its runs, and wall times of the repeats."""
    s = Store.open(spark, path).readonly(branch)
    info = open_x(s)
    if mode == "celltype":
        if axis != "row" or not (obs_column and obs_value is not None):
            raise ValueError("celltype selects rows and needs an obs column and value")
    elif count is None:
        raise ValueError(f"{mode} needs a count")
    key, length = ("row_id", info["n_obs"]) if axis == "row" else ("col_id", info["n_vars"])
    x = matrix(s)

    def chosen():
        if mode == "sequential":
            return select.sequential(x, key, count, length)
        if mode == "random":
            return select.by_ids(x, key, select.random_ids(length, count, seed))
        return select.by_frame(x, key, select.matching(s.read("obs"), **{obs_column: obs_value}), "row_id")

    stats = {"n_selected": count, "n_runs": None, "mean_run": None, "scattered": False}
    if mode == "celltype":
        stats = select.run_stats(select.checked(s.read("obs"), **{obs_column: obs_value})).first().asDict()
    elif mode == "random":
        r = np.diff(select.random_ids(length, count, seed)) != 1
        stats |= {"n_runs": int(r.sum()) + 1, "mean_run": count / (int(r.sum()) + 1)}

    def deliver(df) -> int:
        major, minor = (key, "col_id" if key == "row_id" else "row_id")
        if fmt == "native":
            return df.agg(F.count(F.lit(1))).first()[0]
        if fmt == "csr":
            return layout.compressed(df, major, minor).agg(F.sum(F.size("indices"))).first()[0] or 0
        packed = layout.compressed(df)
        return layout.dense_rows(packed, info["n_vars"]).agg(F.sum(F.size(F.filter("values", lambda v: v != 0)))).first()[0] or 0

    times, nnz = [], 0
    for k in range(warmup + repeats):
        t = time.time()
        nnz = deliver(chosen())
        if k >= warmup:
            times.append(time.time() - t)
    q = lambda p: float(np.percentile(times, p)) if times else None
    return {"store": path, "format": info["format"], "axis": axis, "mode": mode, "seed": seed, "delivered": fmt, "nnz": int(nnz), "timings_s": times, "min_s": q(0), "median_s": q(50), "p95_s": q(95), **{k: stats[k] for k in ("n_selected", "n_runs", "mean_run", "scattered")}}
