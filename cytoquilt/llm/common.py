"""What the operators share: reading tables, Arrow limits, sizing and connected components."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField

#: Rows that one Arrow batch holds at most; the mean document has a few KB, a long one 100 KB.
BATCH_ROWS = 512
#: Text that one bucket of documents holds on average (uncompressed bytes are about twice these).
BUCKET_BYTES = 3 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tune(spark: SparkSession) -> SparkSession:
    """Bound what an Arrow batch holds, so that Python workers stay small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def field(df: DataFrame, name: str, to: str | None = None) -> StructField:
    return StructField(to or name, df.schema[name].dataType, True)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df does not have, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


#: A plan's size when the optimizer does not know it (rows of an RDD): so much for each partition.
UNKNOWN_EACH = 16 << 20


def scan_bytes(df: DataFrame) -> int:
    """Size of the files under a plan as the optimizer knows it; reads no data."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 58 else UNKNOWN_EACH * df.rdd.getNumPartitions()


def parts_for(df: DataFrame, each: int = 8 << 20, least: int = 2) -> int:
    """Partitions for a shuffle of about all of df's bytes: grows with the input, and never below the session's own."""
    own = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return int(min(max(own, least, -(-scan_bytes(df) // each)), 200_000))


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one on a single machine (a test)."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        where = spark.conf.get("spark.checkpoint.dir", None)
        if not where and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir is not set: executors and driver have no shared folder")
        sc.setCheckpointDir(where or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc.getCheckpointDir().rstrip("/")


def checkpoint(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut the lineage through the shared folder."""
    shared_root(df.sparkSession)
    return df.checkpoint(eager)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, for tables or archives that executors write and read."""
    return f"{shared_root(spark)}/{name}-{os.urandom(6).hex()}"


def drop_dir(spark: SparkSession, path: str) -> None:
    """Delete a folder that is not read any more, in whatever store it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def crc_mod(col: str, n: int) -> Column:
    """crc32 of the id as text modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % n


def bucket_of(col: str, n: int) -> Column:
    return F.pmod(F.xxhash64(F.col(col)), F.lit(n)).cast("int")


#: Edges that a partition of the component search holds about.
EDGES_EACH = 100_000


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of undirected edges (a, b): rows (v, comp) with the smallest vertex reachable.

    Alternating large-star and small-star steps (Kiveris et al. 2014), until every vertex has
    one link, to its component's least. Each step takes a minimum per vertex, aggregated
    before the shuffle, and joins it back; a star's hub is a hot key of that join on the edges'
    side alone (two numbers a row), and stays in one task until it is as large as what adaptive
    execution splits (`skewedPartitionThresholdInBytes`). Edges go to the shared checkpoint folder
    after each round; nothing but counts reaches the driver. Partitions follow the edges.
    """
    e = checkpoint(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("m")).distinct())
    k = max(2, min(-(-e.count() // EDGES_EACH), 20_000))
    e = e.coalesce(k)
    for _ in range(rounds):
        ends = e.select(F.col("u").alias("v"), "m").union(e.select(F.col("m").alias("v"), "m"))
        flat = ends.groupBy("v").agg(F.min("m").alias("comp"), F.max("m").alias("most"))
        if not flat.where("comp <> most").coalesce(k).limit(1).count():
            return flat.select("v", "comp")
        # large star: every neighbour above u is linked with the least of u and its neighbours
        both = e.select("u", F.col("m").alias("v")).union(e.select(F.col("m").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low"))
        large = both.where("v > u").join(low.withColumnRenamed("u", "u2"), F.col("u") == F.col("u2")).select(F.col("v").alias("u"), F.col("low").alias("m")).where("u <> m").coalesce(k).distinct().coalesce(k)
        # small star: every neighbour below u, and u itself, is linked with the least of them
        low = large.groupBy("u").agg(F.min("m").alias("low"))
        small = (
            large.join(low.withColumnRenamed("u", "u2"), F.col("u") == F.col("u2"))
            .select(F.inline(F.array(F.struct(F.col("m").alias("u"), F.col("low").alias("m")), F.struct(F.col("u").alias("u"), F.col("low").alias("m")))))
            .where("u <> m")
            .coalesce(k)
            .distinct()
            .coalesce(k)
        )
        e = checkpoint(small)
    raise RuntimeError("components did not settle")
