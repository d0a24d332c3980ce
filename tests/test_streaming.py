from pyspark.sql import functions as F

from seqrec.streaming import updates


def test_history_table(spark, tmp_path):
    rows = [(1, 10 + i, i) for i in range(5)] + [(2, 20, 1)]
    spark.createDataFrame(rows, "user_id long, item_id long, timestamp long").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("user_id long, item_id long, timestamp long").parquet(str(tmp_path / "in"))
    updates.start_history_table(stream, str(tmp_path / "out"), str(tmp_path / "cp"), history=3).awaitTermination()
    got = {r.user_id: r.history_item_ids for r in updates.recent_histories(spark.read.parquet(str(tmp_path / "out")), 3).collect()}
    assert got == {1: [12, 13, 14], 2: [20]}


def test_popularity_stream(spark, tmp_path):
    spark.createDataFrame([(1, "2024-01-01 01:00:00"), (1, "2024-01-01 02:00:00"), (2, "2024-01-03 01:00:00")], "item_id long, t string").select("item_id", F.to_timestamp("t").alias("event_time")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("item_id long, event_time timestamp").parquet(str(tmp_path / "in"))
    q = updates.popularity_stream(stream).writeStream.outputMode("complete").format("memory").queryName("pop").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.item_id, r.item_count) for r in spark.table("pop").collect()) == [(1, 2), (2, 1)]
