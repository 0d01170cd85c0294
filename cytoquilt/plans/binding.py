"""The matrix model over the driver's tables: cells are orders, genes are parts, counts are summed line quantities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.layout import summed
from ..session import table

#: The same matrix in SQL, for the DuckDB twins.
X = "x as (select l_orderkey as r, l_partkey as c, sum(l_quantity) as v from lineitem group by 1, 2)"


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("row_id"), F.col("l_partkey").alias("col_id"), F.col("l_quantity").alias("value"))
    return summed(rows)


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_id"), F.col("o_orderpriority").alias("cell_type"), F.col("o_orderstatus").alias("batch"), F.col("o_totalprice").alias("total"), F.col("o_custkey").alias("donor"))


def var(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("col_id"), F.col("p_name").alias("var_name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("kind"))


#: The positive part of the embeddings in thousandths, a matrix of few columns, in SQL.
E = "k as (select * from (select vec_id as r, generate_subscripts(embedding, 1) - 1 as c, floor(unnest(embedding)::double * 1000) as v from embeddings) where v > 0), ext as (select max(vec_id) + 1 as rows, max(len(embedding)) as cols from embeddings)"


def narrow(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int, int]:
    """(triplets, rows, columns) of the same matrix."""
    e = table(spark, sf_dir, "embeddings")
    cells = e.select(F.col("vec_id").alias("row_id"), F.posexplode("embedding").alias("p", "v"))
    ends = e.agg(F.max("vec_id").alias("rows"), F.max(F.size("embedding")).alias("cols")).first()
    x = cells.select("row_id", F.col("p").cast("long").alias("col_id"), F.floor(F.col("v").cast("double") * 1000).cast("double").alias("value")).where("value > 0")
    return x, int(ends["rows"] if ends["rows"] is not None else -1) + 1, int(ends["cols"] or 0)


def extent(axis: DataFrame, key: str) -> int:
    """One more than the largest id of an axis: ids are places from 0."""
    last = axis.agg(F.max(key)).first()[0]
    return 0 if last is None else int(last) + 1
