"""Incremental ingest: new cohort files become commits of a store as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.layout import summed
from ..sources.store import Store

TRIPLETS = "row_id long, col_id long, value double"


def append_batch(store: Store, batch: DataFrame, number: int, branch: str = "main") -> str | None:
    """Add one batch of triplets as its own node and commit it; a batch that was committed before is skipped.

    A restarted stream may offer its last batch again: the node's name carries the batch
    number, so each batch is in the store exactly once.
    """
    session, name = store.writable(branch), f"batches/{number:010d}"
    if session.exists(name):
        return None
    session.write(name, summed(batch), kind="triplets", sort=["row_id"])
    return session.commit(f"batch {number}")


def batches(store: Store, branch: str = "main") -> DataFrame:
    """All committed triplets, repeated places added up."""
    session = store.readonly(branch)
    names = sorted(n for n in session.nodes if n.startswith("batches/"))
    out = None
    for n in names:
        one = session.read(n).select("row_id", "col_id", "value")
        out = one if out is None else out.union(one)
    return summed(out) if out is not None else store.spark.createDataFrame([], TRIPLETS)


def follow(spark: SparkSession, folder: str, store: Store, checkpoint: str, branch: str = "main", once: bool = True):
    """Start a query that commits every new Parquet file of triplets in the folder; with once, those there now."""
    stream = spark.readStream.schema(TRIPLETS).parquet(folder)
    writer = stream.writeStream.foreachBatch(lambda df, n: append_batch(store, df, n, branch)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def event_counts(events: DataFrame, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Windowed counts per cell type of an event stream, with a watermark for late rows (batch frames work too)."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if rows.isStreaming:
        rows = rows.withWatermark("ts", late)
    return rows.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
