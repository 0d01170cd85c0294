from pyspark.sql import functions as F

from cytoquilt.sources.store import Store
from cytoquilt.streaming import ingest


def test_each_file_once(spark, tmp_path):
    store, folder = Store.create(spark, f"{tmp_path}/s"), f"{tmp_path}/in"
    for n in range(3):
        spark.createDataFrame([(n, 0, 1.0), (0, 1, 2.0)], ingest.TRIPLETS).write.mode("append").parquet(folder)
        ingest.follow(spark, folder, store, f"{tmp_path}/c").awaitTermination()
    assert sorted(map(tuple, ingest.batches(store).collect())) == [(0, 0, 1.0), (0, 1, 6.0), (1, 0, 1.0), (2, 0, 1.0)]
    assert ingest.append_batch(store, spark.createDataFrame([(9, 9, 9.0)], ingest.TRIPLETS), 0) is None
    assert len(store.ancestry()) == 4


def test_event_counts_streams_like_batch(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", "event_type", "value")
    want = sorted(map(str, ingest.event_counts(events).select("start", "event_type", "n", F.round("total", 6)).collect()))
    events.write.parquet(f"{tmp_path}/e")
    stream = ingest.event_counts(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/e"))
    q = stream.writeStream.format("memory").queryName("event_counts").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/k").start()
    q.awaitTermination()
    got = sorted(map(str, spark.table("event_counts").select("start", "event_type", "n", F.round("total", 6)).collect()))
    assert got == want
