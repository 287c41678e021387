import time

import pytest

from millrace.streaming import ingest, jobs


def put(spark, folder, name, rows):
    spark.createDataFrame([(j, s, k, p, d) for j, s, k, p, d in rows], jobs.EVENTS).coalesce(1).write.parquet(f"{folder}/{name}")


def run(spark, tmp_path, sink=None, **how):
    events = spark.readStream.schema(jobs.EVENTS).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = ingest.write_batches(jobs.transitions(events, **how), sink or ingest.parquet_sink(str(tmp_path / "out")), str(tmp_path / "state"))
    q.awaitTermination()


def told(spark, tmp_path):
    return sorted(tuple(r)[:6] for r in spark.read.parquet(str(tmp_path / "out")).collect())


def test_states_over_restarts_and_a_lost_batch(spark, tmp_path):
    put(spark, tmp_path / "in", "1", [("a", 1, "submit", 0, ""), ("a", 2, "start", 0, ""), ("b", 1, "start", 0, ""), ("b", 3, "submit", 0, ""), ("c", 2, "submit", 0, ""), ("c", 4, "submit", 0, "")])
    run(spark, tmp_path)
    assert told(spark, tmp_path) == [("a", 1, "pending", 0, 1, ""), ("a", 2, "running", 5, 1, ""), ("b", 3, "pending", 0, 1, ""), ("c", 2, "pending", 0, 1, "")]
    assert sorted(map(tuple, jobs.unfinished(spark, str(tmp_path / "state")).collect())) == [("a", "running", 1), ("b", "pending", 1), ("c", "pending", 1)]
    put(spark, tmp_path / "in", "2", [("a", 5, "progress", 40, "extract_entities"), ("a", 6, "success", 0, "NEED_GRAPH_ANALYSIS"), ("b", 7, "success", 0, "")])
    sink = ingest.parquet_sink(str(tmp_path / "out"))

    def failing(df, batch):
        sink(df, batch)
        raise RuntimeError("lost after all was written")

    with pytest.raises(Exception, match="lost after"):
        run(spark, tmp_path, failing)
    put(spark, tmp_path / "in", "3", [("a", 8, "submit", 0, "again"), ("b", 9, "start", 0, ""), ("b", 10, "failure", 0, "broken")])
    run(spark, tmp_path)
    assert told(spark, tmp_path)[2:] == [("a", 5, "running", 40, 1, "extract_entities"), ("a", 6, "success", 100, 1, "NEED_GRAPH_ANALYSIS"), ("a", 8, "pending", 0, 2, "again"), ("b", 3, "pending", 0, 1, ""), ("b", 9, "running", 5, 1, ""), ("b", 10, "failed", 0, 1, "broken"), ("c", 2, "pending", 0, 1, "")]


@pytest.fixture
def no_empty_batches(spark):
    """With timers, a stream that only takes what is there would go on with empty batches for ever."""
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    yield
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")


def test_a_running_job_that_is_not_heard_of_is_lost(spark, tmp_path, no_empty_batches):
    put(spark, tmp_path / "in", "1", [("a", 1, "submit", 0, ""), ("a", 2, "start", 0, ""), ("b", 1, "submit", 0, "")])
    run(spark, tmp_path, lost_ms=1500, attempts=2)
    time.sleep(2)
    put(spark, tmp_path / "in", "2", [("c", 1, "submit", 0, "")])
    run(spark, tmp_path, lost_ms=1500, attempts=2)
    assert ("a", 2, "pending", 0, 2, "lost") in told(spark, tmp_path)
    put(spark, tmp_path / "in", "3", [("a", 3, "start", 0, "")])
    run(spark, tmp_path, lost_ms=1500, attempts=2)
    time.sleep(2)
    put(spark, tmp_path / "in", "4", [("c", 2, "start", 0, "")])
    run(spark, tmp_path, lost_ms=1500, attempts=2)
    assert ("a", 3, "failed", 0, 2, "lost") in told(spark, tmp_path) and not any(r[0] == "b" and r[5] == "lost" for r in told(spark, tmp_path))


def test_escalation_feeds_the_queue(spark, tmp_path):
    sink, folder = ingest.parquet_sink(str(tmp_path / "out")), str(tmp_path / "in")

    def both(df, batch):
        sink(df, batch)
        again = jobs.escalations(df.sparkSession.read.parquet(f"{tmp_path}/out/batch={batch}"))
        again.write.mode("overwrite").parquet(f"{folder}/escalated-{batch}")

    put(spark, folder, "1", [("a", 1, "submit", 0, ""), ("a", 2, "start", 0, ""), ("a", 3, "success", 0, "NEED_STANDARD_ANALYSIS"), ("b", 1, "submit", 0, ""), ("b", 2, "start", 0, ""), ("b", 3, "success", 0, "LOW_RISK_ARCHIVED")])
    run(spark, tmp_path, both)
    run(spark, tmp_path, both)
    put(spark, folder, "2", [("a:standard", 4, "start", 0, ""), ("a:standard", 5, "success", 0, "NEED_STANDARD_ANALYSIS")])
    run(spark, tmp_path, both)
    run(spark, tmp_path, both)
    assert [r[:3] for r in told(spark, tmp_path) if r[0].startswith("a:")] == [("a:standard", 3, "pending"), ("a:standard", 4, "running"), ("a:standard", 5, "success")]
