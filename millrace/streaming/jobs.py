"""A queue of analysis jobs as a stream of events: every job is a state machine, kept by Spark across restarts.

submit makes a job pending, start running; progress, success and failure count while it runs. A job that runs but is not heard of for
a time is lost: a timer makes it pending again, and failed after so many attempts. What another event asks for in a state is ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

EVENTS = "job_id string, seq long, kind string, progress int, detail string"
TRANSITIONS = "job_id string, seq long, status string, progress int, attempt int, detail string"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: What a decision escalates to, and the progress that each step stands for.
ESCALATES = {"NEED_STANDARD_ANALYSIS": "standard", "NEED_GRAPH_ANALYSIS": "graph"}
STEPS = {"init": 5, "classify": 20, "extract_entities": 40, "decide_tools": 55, "extract_evidence": 70, "risk_score": 80, "generate_report": 90, "persist": 95}


def after(status: str | None, attempt: int, kind: str, progress: int | None) -> tuple[str, int, int] | None:
    """(status, progress, attempt) that an event leads to, or None if it changes nothing."""
    if kind == "submit" and status in (None, "success", "failed"):
        return "pending", 0, attempt + 1
    if kind == "start" and status == "pending":
        return "running", STEPS["init"], attempt
    if status == "running" and kind == "progress":
        return "running", max(0, min(100, progress or 0)), attempt
    if status == "running" and kind in ("success", "failure"):
        return ("success", 100, attempt) if kind == "success" else ("failed", 0, attempt)
    return None


class _Job(StatefulProcessor):
    def __init__(self, lost_ms: int, attempts: int):
        self.lost_ms, self.attempts = lost_ms, attempts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "status string, attempt int, seq long, watched long")

    def _say(self, key, seq, status, progress, attempt, detail, watched) -> Row:
        self.job.update((status, attempt, seq, watched))
        return Row(job_id=key[0], seq=seq, status=status, progress=progress, attempt=attempt, detail=detail)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        status, attempt, _, watched = self.job.get() if self.job.exists() else (None, 0, None, None)
        # the rows of one job in one micro-batch, in their order
        for r in sorted(rows, key=lambda r: r.seq):
            to = after(status, attempt, r.kind, r.progress)
            if to is None:
                continue
            status, progress, attempt = to
            if watched is not None:
                self.handle.deleteTimer(watched)
                watched = None
            if status == "running" and self.lost_ms:
                watched = timerValues.getCurrentProcessingTimeInMs() + self.lost_ms
                self.handle.registerTimer(watched)
            yield self._say(key, r.seq, status, progress, attempt, r.detail, watched)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        status, attempt, seq, watched = self.job.get()
        if status == "running" and watched == expiredTimerInfo.getExpiryTimeInMs():
            again = attempt < self.attempts
            yield self._say(key, seq, "pending" if again else "failed", 0, attempt + 1 if again else attempt, "lost", None)

    def close(self) -> None:
        pass


def transitions(events: DataFrame, lost_ms: int = 0, attempts: int = 3) -> DataFrame:
    """What becomes of the jobs: a row (TRANSITIONS) for each event that changes one, and for each job that is lost.

    events (EVENTS): seq orders a job's events; those of later micro-batches come after those of earlier ones. lost_ms is the time
    after which a running job that nothing is heard of is lost; 0 never. Its timer runs on while no stream does, and fires in the
    first micro-batch behind it. A stream with timers that is triggered by availableNow ends only if
    spark.sql.streaming.noDataMicroBatches.enabled is false.
    """
    spark = events.sparkSession
    if events.isStreaming:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    rows = events.select("job_id", "seq", "kind", "progress", "detail").filter("job_id is not null")
    return rows.groupBy("job_id").transformWithState(_Job(lost_ms, attempts), TRANSITIONS, "append", "processingTime" if lost_ms else "none")


def escalations(done: DataFrame, automatic: Column | None = None) -> DataFrame:
    """Events that submit the next stage of jobs that succeeded with a decision that asks for more; the second stage of the queue.

    done: TRANSITIONS, whose detail is the decision. A job's next stage is named after it, so one that is given twice is one job. A
    job that is itself a next stage goes no further than its own mode.
    """
    mode = F.create_map(*(F.lit(x) for kv in ESCALATES.items() for x in kv))[F.col("detail")]
    stage = F.when(F.endswith("job_id", F.lit(":graph")), 2).when(F.endswith("job_id", F.lit(":standard")), 1).otherwise(0)
    further = F.when(mode == "graph", 2).when(mode == "standard", 1) > stage
    asked = done.filter((F.col("status") == "success") & mode.isNotNull() & further & (F.lit(True) if automatic is None else automatic))
    return asked.select(F.concat("job_id", F.lit(":"), mode).alias("job_id"), "seq", F.lit("submit").alias("kind"), F.lit(0).alias("progress"), F.lit("escalated").alias("detail"))


def unfinished(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(job_id, status, attempt): what a stopped queue has to take up again, read from the state that its checkpoint holds."""
    state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "job").load()
    return state.select(F.col("key.job_id").alias("job_id"), F.col("value.status").alias("status"), F.col("value.attempt").alias("attempt")).filter("status in ('pending', 'running')")
