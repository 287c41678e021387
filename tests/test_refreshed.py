import datetime
import time

from pyspark.sql import functions as F

from millrace.engine import Engine
from millrace.operators import reports
from millrace.streaming import ingest, metrics, refreshed

NOW = datetime.datetime(2024, 5, 1)


def test_a_term_added_between_batches_is_found_in_the_next(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "house"), buckets=4)
    term = lambda *rows: spark.createDataFrame(rows, "term string, normalized_meaning string")
    put = lambda name, *rows: spark.createDataFrame(rows, "id long, text string").coalesce(1).write.parquet(str(tmp_path / "in" / name))
    stream = lambda: spark.readStream.schema("id long, text string").option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    sink = refreshed.with_newest(e.tables, "dim_slang_dict", refreshed.terms_in, ingest.parquet_sink(str(tmp_path / "out")))
    added = []

    def and_then(df, batch):  # within one run of the stream
        sink(df, batch)
        if not added:
            added.append(batch)
            e.put_slang(term(("猫池", "群控")), NOW)

    e.put_slang(term(("接码", "收短信"), ("旧词", "x")), NOW)
    put("1", (1, "接码 猫池"), (2, "没有"))
    put("2", (3, "猫池 接码 旧词"), (4, None))
    ingest.write_batches(stream(), and_then, str(tmp_path / "state")).awaitTermination()
    got = sorted(tuple(r)[:4] for r in spark.read.parquet(str(tmp_path / "out")).select("id", "term", "meaning", "version").collect())
    assert got == [(1, "接码", "收短信", 1), (3, "接码", "收短信", 2), (3, "旧词", "x", 2), (3, "猫池", "群控", 2)]
    e.review_slang("旧词", False, "me", NOW)
    e.tables.upsert("dim_slang_dict", term(("旧词", "x")).withColumn("status", F.lit("rejected")), ["term"])
    put("3", (5, "旧词"))
    ingest.write_batches(stream(), sink, str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).filter("id = 5").count() == 0


def test_observed_throughput_is_that_of_a_second_pass(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), "value")
    names = tuple(sorted(r[0] for r in events.select("event_type").distinct().collect()))
    failed = F.col("value") < 5
    want = sorted(tuple(r) for r in reports.throughput(events, "event_type", "ts", failed).select("event_type", "items", "errors", "elapsed_sec", "items_per_sec").collect())
    df, seen = metrics.observed(events, "event_type", names, "ts", failed)
    df.write.format("noop").mode("overwrite").save()
    assert metrics.rates(seen.get, names) == want
    events.repartition(4).write.parquet(str(tmp_path / "in"))
    listener = metrics.Throughput(names)
    spark.streams.addListener(listener)
    stream, _ = metrics.observed(spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in")), "event_type", names, "ts", failed)
    stream.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    for _ in range(100):
        if sum(listener.total.get(f"{k}_{i}", 0) for k in ("items", "errors") for i in range(len(names))) == events.count():
            break
        time.sleep(0.1)
    spark.streams.removeListener(listener)
    assert listener.rates() == want
    assert metrics.rates({"first": None}, names) == []
