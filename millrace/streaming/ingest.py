"""Streams: chat ingestion, incremental reads by high-water mark, windows, state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..schemas import CHAT
from ..sources.records import chat_messages


def chat_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """Messages of chat events that arrive as JSON files; the source's rate is bounded by files_per_batch."""
    return chat_messages(spark.readStream.schema(CHAT).option("maxFilesPerTrigger", files_per_batch).json(path))


def write_batches(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, **trigger) -> StreamingQuery:
    """Hands each micro-batch to write(frame, batch id); progress is kept in checkpoint, so a restart goes on where it stopped.

    A batch may come again after a failure, with the same id: write must overwrite by id, as parquet_sink() does.
    """
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def parquet_sink(path: str) -> Callable[[DataFrame, int], None]:
    return lambda df, batch: df.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def distinct_messages(stream: DataFrame, keys: list[str], at: str = "sent_at", delay: str = "1 day") -> DataFrame:
    """The first of messages with the same keys within the watermark; state older than that is dropped."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, at: str, window: str, slide: str | None = None, delay: str = "10 minutes", *by: str) -> DataFrame:
    """Counts by event-time window; rows later than the watermark are dropped."""
    keys = F.window(at, window, slide) if slide else F.window(at, window)
    out = stream.withWatermark(at, delay).groupBy(keys.alias("w"), *by).agg(F.count(F.lit(1)).alias("cnt"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "cnt")


def session_counts(df: DataFrame, at: str, gap: str, key: str, delay: str = "10 minutes") -> DataFrame:
    rows = df.withWatermark(at, delay) if df.isStreaming else df
    out = rows.groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("cnt"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "cnt")


def advancing(stream: DataFrame, key: str, at: str) -> DataFrame:
    """Rows newer than the greatest time seen of their key in earlier batches, with `seen`, the new mark; state: one time a key."""
    schema = stream.schema

    def step(k: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        mark = pd.Timestamp(state.get[0]) if state.exists else None
        rows = pd.concat(list(frames))
        fresh = rows if mark is None else rows[rows[at].isna() | (rows[at] > mark)]
        newest = max([t for t in (mark, rows[at].max()) if t is not None and not pd.isna(t)], default=None)
        if newest is not None:
            state.update((newest.to_pydatetime(),))
        yield fresh[schema.names]

    return stream.groupBy(key).applyInPandasWithState(step, schema, "mark timestamp", "append", "NoTimeout")


def incremental(df: DataFrame, marks: DataFrame, key: str, at: str) -> DataFrame:
    """The batch form: rows newer than the mark (key, mark) of their key, rows without a time or without a mark."""
    return df.join(marks, key, "left").filter(F.col(at).isNull() | F.col("mark").isNull() | (F.col(at) > F.col("mark"))).drop("mark")
