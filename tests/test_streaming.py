import json

from pyspark.sql import functions as F
from test_sources import EVENTS

from millrace.streaming import ingest


def test_chat_stream_restarts_where_it_stopped(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.json").write_text("\n".join(json.dumps(e) for e in EVENTS))
    run = lambda: ingest.write_batches(ingest.chat_stream(spark, str(tmp_path / "in"), 1), ingest.parquet_sink(str(tmp_path / "out")), str(tmp_path / "state")).awaitTermination()
    run()
    (tmp_path / "in/2.json").write_text(json.dumps(EVENTS[1] | {"message_id": "m9"}))
    run()
    run()
    assert sorted(r.message_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["m1", "m2", "m9"]


def test_windows_equal_the_batch_result(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    events.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = ingest.windowed_counts(stream, "ts", "1 hour", None, "10 minutes", "event_type").writeStream.format("memory").queryName("hourly").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = events.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").count().select("w.start", "w.end", "event_type", "count")
    assert sorted(map(tuple, spark.table("hourly").collect())) == sorted(map(tuple, batch.collect()))


def test_advancing_marks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    schema = "k string, at timestamp, v long"
    write = lambda name, rows: spark.createDataFrame(rows, "k string, at string, v long").withColumn("at", F.to_timestamp("at")).coalesce(1).write.parquet(str(tmp_path / "in" / name))
    stream = ingest.advancing(spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(str(tmp_path / "in")), "k", "at")
    run = lambda: stream.writeStream.foreachBatch(lambda df, b: df.write.mode("overwrite").parquet(str(tmp_path / f"out/b={b}"))).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    write("1", [("a", "2024-01-01 00:00:00", 1), ("a", "2024-01-02 00:00:00", 2)])
    run()
    write("2", [("a", "2024-01-01 12:00:00", 3), ("a", "2024-01-03 00:00:00", 4), ("b", "2023-01-01 00:00:00", 5), ("a", None, 6)])
    run()
    assert sorted(r.v for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2, 4, 5, 6]


def test_distinct_messages(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.json").write_text("\n".join(json.dumps(e) for e in [EVENTS[0], EVENTS[0], EVENTS[1]]))
    out = ingest.distinct_messages(ingest.chat_stream(spark, str(tmp_path / "in")), ["message_id"])
    q = out.writeStream.format("memory").queryName("once").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("once").count() == 2
