"""Store queries: written, opened and read back through the shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..model import AnnMatrix
from ..sources.files import scratch
from ..sources.store import Store, open_x, write_back
from .binding import counts, obs, var

SMALL = 300


def _stored(spark, d, fmt: str = "csr") -> Store:
    store = Store.create(spark, scratch(spark, "store"))
    cells = obs(spark, d)
    store.write(AnnMatrix(obs=cells, var=var(spark, d), x=counts(spark, d)), fmt)
    return store


def open_x_info(spark, d):
    return spark.createDataFrame([open_x(_stored(spark, d).readonly())], "format string, is_sparse boolean, n_obs long, n_vars long, dtype string")


def store_roundtrip(spark, d):
    """X written by columns and read back as triplets."""
    return _stored(spark, d, "csc").load().x


def writeback(spark, d):
    """Labels and a layout added to a stored matrix as a new snapshot, then read back with it."""
    store = _stored(spark, d)
    cells = obs(spark, d)
    labels = cells.select(F.col("row_id").alias("node"), (F.col("row_id") % 7).cast("int").alias("community"))
    xy = cells.select(F.col("row_id").alias("node"), F.col("total").alias("x"), (-F.col("total")).alias("y"))
    write_back(store, xy, labels)
    ann = store.load()
    return ann.obs.join(ann.obsm["X_umap"].withColumnRenamed("row_id", "r"), F.col("row_id") == F.col("r")).select("row_id", "cell_type", "leiden", F.col("vec")[0].alias("x"), F.col("vec")[1].alias("y"))


QUERIES = {f.__name__: f for f in (open_x_info, store_roundtrip, writeback)}
ORACLE = {
    "open_x_info": "select 'csr' as format, true as is_sparse, (select max(o_orderkey) + 1 from orders) as n_obs, (select max(p_partkey) + 1 from part) as n_vars, 'double' as dtype",
    "store_roundtrip": "select l_orderkey as row_id, l_partkey as col_id, sum(l_quantity) as value from lineitem group by 1, 2",
    "writeback": "select o_orderkey as row_id, o_orderpriority as cell_type, (o_orderkey % 7)::int as leiden, o_totalprice as x, -o_totalprice as y from orders",
}
