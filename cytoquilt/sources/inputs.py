"""Inputs of conversions: stores, Parquet or MatrixMarket folders, and HDF5 files where h5py is installed."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from ..model import AnnMatrix
from .files import Files
from .hdf5 import read_10x, read_h5ad
from .readers import read_triplets
from .store import Store


def names_from(df: DataFrame, key: str, name: str) -> DataFrame:
    """(key, name, columns): a table read from text in file order gets 0-based ids from a `position` column if it has one."""
    return df.withColumnRenamed("position", key) if "position" in df.columns and key not in df.columns else df


def read_folder(spark: SparkSession, path: str) -> AnnMatrix:
    """obs.parquet and var.parquet with row_id and col_id, and X as x.parquet triplets or matrix.mtx."""
    files = Files(spark, path)
    if not files.exists():
        raise FileNotFoundError(path)
    obs, var = names_from(spark.read.parquet(f"{path}/obs.parquet"), "row_id", "obs_name"), names_from(spark.read.parquet(f"{path}/var.parquet"), "col_id", "var_name")
    x = spark.read.parquet(f"{path}/x.parquet") if files.exists("x.parquet") else read_triplets(spark, f"{path}/matrix.mtx")
    return AnnMatrix(obs=obs, var=var, x=x)


def from_csr(spark: SparkSession, ptr, idx, data, cells: list[str], genes: list[dict]) -> AnnMatrix:
    """A matrix from CSR arrays that are in memory already."""
    rows = [(r, int(idx[k]), float(data[k])) for r in range(len(ptr) - 1) for k in range(int(ptr[r]), int(ptr[r + 1]))]
    return AnnMatrix(
        obs=spark.createDataFrame(list(enumerate(cells)), "row_id long, obs_name string"),
        var=spark.createDataFrame([(i, g["var_name"], g.get("gene_id"), g.get("feature_type")) for i, g in enumerate(genes)], "col_id long, var_name string, gene_id string, feature_type string"),
        x=spark.createDataFrame(rows, "row_id long, col_id long, value double"),
    )


def read_any(spark: SparkSession, path: str, branch: str = "main") -> AnnMatrix:
    if path.endswith(".h5ad"):
        return read_h5ad(spark, path)
    if path.endswith(".h5"):
        return read_10x(spark, path)
    if os.path.exists(f"{path.removeprefix('file://')}/zarr.json"):
        from .zarr import read_store

        return read_store(spark, path)
    if Store.exists(spark, path):
        return Store.open(spark, path).load(branch)
    return read_folder(spark, path)
