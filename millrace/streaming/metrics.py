"""Throughput of a source as it is read: counts that Spark takes along with the rows, without a second pass over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

NAME = "throughput"


def _metrics(by: str, names: tuple[str, ...], at: str, failed: Column) -> list[Column]:
    bad = F.coalesce(failed, F.lit(False))
    of = lambda n: F.lit(False) if n is None else F.coalesce(F.col(by) == n, F.lit(False))
    out = [F.min(at).cast("timestamp").alias("first"), F.max(at).cast("timestamp").alias("last")]
    for k, name in enumerate(names):
        out += [F.count_if(of(name) & ~bad).alias(f"items_{k}"), F.count_if(of(name) & bad).alias(f"errors_{k}")]
    return out


def observed(df: DataFrame, by: str, names: tuple[str, ...], at: str, failed: Column) -> tuple[DataFrame, Observation | None]:
    """df, whose next action or micro-batches count items and errors of each of `names` in column `by`, and the first and last time.

    For a batch the observation gives them to rates(); of a stream they go to a Throughput listener.
    """
    metrics = _metrics(by, names, at, failed)
    if df.isStreaming:
        return df.observe(NAME, *metrics), None
    seen = Observation(NAME)
    return df.observe(seen, *metrics), seen


def rates(metrics: dict, names: tuple[str, ...]) -> list[tuple[str, int, int, float, float]]:
    """(name, items, errors, elapsed_sec, items_per_sec) of each name that had any; time runs from the first row of all to the last."""
    if metrics.get("first") is None:
        return []
    elapsed = (metrics["last"] - metrics["first"]).total_seconds()
    out = []
    for k, name in enumerate(names):
        items, errors = metrics[f"items_{k}"], metrics[f"errors_{k}"]
        if items or errors:
            out.append((name, items, errors, round(elapsed, 1), round(items / elapsed, 4) if elapsed else 0.0))
    return out


class Throughput(StreamingQueryListener):
    """Adds up what observed() counts in the micro-batches of the streams of a session; add it with spark.streams.addListener()."""

    def __init__(self, names: tuple[str, ...]):
        self.names, self.total = names, {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        found = event.progress.observedMetrics.get(NAME)
        if found is None:
            return
        row = found.asDict()
        for key, value in row.items():
            if value is None:
                continue
            old = self.total.get(key)
            pick = min if key == "first" else max
            self.total[key] = value if old is None else pick(old, value) if key in ("first", "last") else old + value

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def rates(self) -> list[tuple[str, int, int, float, float]]:
        return rates(self.total, self.names)
