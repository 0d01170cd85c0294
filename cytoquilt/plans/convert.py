"""Conversions and concatenations of inputs into a store, under a config."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..model import AnnMatrix
from ..operators.ingest import Part, check_parts, concat_obs, concat_x, row_counts
from ..sources.config import AppConfig
from ..sources.inputs import read_any
from ..sources.store import Store

FORMAT = {"sparse-csr": "csr", "sparse-csc": "csc", "dense": "dense"}


def _target(spark: SparkSession, path: str, cfg: AppConfig) -> Store:
    if cfg.io.icechunk_storage == "gcs":
        raise NotImplementedError("the gcs place is not wired up; give a gs:// path to a session with the connector")
    if cfg.io.backend == "icechunk" and Store.exists(spark, path) and not cfg.io.overwrite:
        return Store.open(spark, path)  # one more commit on a versioned store
    return Store.create(spark, path, cfg.io.overwrite)


def _write(spark: SparkSession, ann: AnnMatrix, path: str, cfg: AppConfig, message: str) -> list[str]:
    warnings = ann.validate(require_non_empty=cfg.validation.require_non_empty, reject_spatial=cfg.validation.reject_spatial)
    if cfg.validation.require_non_empty:
        for what, df, least in (("obs", ann.obs, cfg.validation.min_obs), ("var", ann.var, cfg.validation.min_vars)):
            if least > 1 and df.limit(least).count() < least:
                raise ValueError(f"fewer than {least} {what}")
    if cfg.grouping.enabled:
        if cfg.io.x_storage == "sparse-csc":
            raise ValueError("sorting needs row-wise storage")
        ann = ann.sorted(list(cfg.grouping.sort_by))
    _target(spark, path, cfg).write(ann, FORMAT[cfg.io.x_storage], message=message, chunk=(cfg.chunks.x_row_chunk, cfg.chunks.x_col_chunk))
    return warnings


def convert(spark: SparkSession, source: str, target: str, cfg: AppConfig | None = None) -> list[str]:
    """One input into a store, one commit; returns warnings."""
    return _write(spark, read_any(spark, source), target, cfg or AppConfig(), f"convert {source}")


def concat(spark: SparkSession, sources: list[str], target: str, cfg: AppConfig | None = None) -> list[str]:
    """Inputs appended on the cell axis: X, obs and var only. Genes must be the same in the same order."""
    cfg = cfg or AppConfig()
    if cfg.io.x_storage == "sparse-csc":
        raise ValueError("concatenation needs row-wise storage")
    anns = [read_any(spark, s) for s in sources]
    parts = [Part(a.obs, a.var, a.x) for a in anns]
    columns = list(cfg.concat.obs_columns) or None
    warnings = check_parts(parts, columns)
    sizes = row_counts(parts)
    merged = AnnMatrix(obs=concat_obs(parts, columns, sizes), var=anns[0].var, x=concat_x(parts, sizes))
    return warnings + _write(spark, merged, target, replace(cfg, grouping=replace(cfg.grouping, enabled=False)), f"concat {len(sources)} inputs")


def inspect(spark: SparkSession, path: str, branch: str = "main") -> dict:
    """Layout of X from the manifest, and its entries counted from the data."""
    from ..sources.store import open_x

    s = Store.open(spark, path).readonly(branch)
    info = open_x(s)
    df = s.read("X")
    n = df.agg(F.sum("nnz") if info["format"] == "dense" else F.sum(F.size("indices"))).first()[0]
    return info | {"nnz": int(n or 0), "files": len(df.inputFiles())}
