"""The author-aware decision over an unbounded run of posts, in micro-batches.

A post is decided by the hash remembered first among all within its reach, which may stand in any band of bits, and what it adds to
what is remembered decides about later ones. State that is keyed by a band knows neither, so what is remembered is a table: a batch
is decided by operators.dedup.decided() against the hashes that its own posts are near to, and adds its part under its number.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.dedup import decided
from ..work import checkpointed

#: Batches after which the parts of what is remembered are put together.
TOGETHER = 16


def _numbers(spark: SparkSession, path: str, name: str) -> list[int]:
    """Numbers n of the whole folders name=n under path: those that the committer has marked."""
    top = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(top):
        return []
    found = [(x.getPath(), re.fullmatch(rf"{name}=(\d+)", x.getPath().getName())) for x in fs.listStatus(top)]
    return sorted(int(m[1]) for p, m in found if m and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def _drop(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def remembered_before(spark: SparkSession, path: str, batch: int) -> DataFrame | None:
    """(simhash, author, seq, id, quote): what the batches before this one have remembered; None if there are none."""
    whole = [n for n in _numbers(spark, f"{path}/remembered", "before") if n <= batch]
    since = whole[-1] if whole else 0
    parts = [f"{path}/remembered/before={since}"] if whole else []
    parts += [f"{path}/remembered/batch={n}" for n in _numbers(spark, f"{path}/remembered", "batch") if since <= n < batch]
    return spark.read.parquet(*parts) if parts else None


def deciding(path: str, order: str = "batch_seq", most: int = 3, remember_noise: bool = False, keep: int | None = None) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: decides about the posts of each batch and writes them under path/decided/batch=n.

    A batch reads only what the ones before it wrote, and overwrites its own folders, so one that comes again after a failure gives the
    same rows. order must rise from batch to batch. keep is how far back in order a post is remembered; None remembers all, and
    the decisions are then those of one batch over all posts.
    """

    def write(posts: DataFrame, batch: int) -> None:
        spark = posts.sparkSession
        posts = checkpointed(posts)
        if posts.limit(1).count() == 0:
            return
        old = remembered_before(spark, path, batch)
        if old is not None and keep is not None:
            old = old.filter(F.col("seq") >= F.lit(posts.agg(F.min(order)).first()[0] - keep))
        told, added = decided(posts, order, most, remember_noise, old)
        added.write.mode("overwrite").parquet(f"{path}/remembered/batch={batch}")
        told.write.mode("overwrite").parquet(f"{path}/decided/batch={batch}")
        if batch % TOGETHER == TOGETHER - 1:
            together(spark, path, batch + 1, keep)

    return write


def together(spark: SparkSession, path: str, before: int, keep: int | None = None) -> None:
    """Writes what the batches before this one remember as one table, without what is too old, and drops the one before the last.

    The batches' own parts go once two such tables hold them, so that a batch that comes again still finds all it read.
    """
    parts = remembered_before(spark, path, before)
    if parts is None:
        return
    if keep is not None:
        parts = parts.filter(F.col("seq") >= F.lit(parts.agg(F.max("seq")).first()[0] - keep))
    parts.groupBy("simhash", "author").agg(F.min(F.struct("seq", "id", "quote")).alias("first")).select("simhash", "author", "first.*").write.mode("overwrite").parquet(f"{path}/remembered/before={before}")
    older = [n for n in _numbers(spark, f"{path}/remembered", "before") if n < before]
    for n in older[:-1]:
        _drop(spark, f"{path}/remembered/before={n}")
    if older:
        for n in _numbers(spark, f"{path}/remembered", "batch"):
            if n < older[-1]:
                _drop(spark, f"{path}/remembered/batch={n}")


def decide(stream: DataFrame, path: str, checkpoint: str, trigger: dict | None = None, **how) -> StreamingQuery:
    """Runs deciding(path, **how) over a stream of posts; a restart goes on where the last whole batch ended."""
    return stream.writeStream.foreachBatch(deciding(path, **how)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def decisions(spark: SparkSession, path: str) -> DataFrame:
    """The posts of all whole batches with their decisions."""
    return spark.read.parquet(*(f"{path}/decided/batch={n}" for n in _numbers(spark, f"{path}/decided", "batch")))
