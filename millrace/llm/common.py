"""Helpers that the training-data operators share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words everywhere: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Stands in for a null identifier where a join key must not be null.
NULL_ID = -(2**63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of checkpoints: that of spark.checkpoint.dir. Only a local session, as in tests, may go without that setting."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return context._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """Writes df to the folder of spark.checkpoint.dir, shared by all executors, and cuts its lineage there."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written_table(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the folder of checkpoints, read again."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_table(table: DataFrame) -> None:
    """Removes the files of a table that written_table() gave."""
    spark = table.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def one_of_each(df: DataFrame, *keys: str) -> DataFrame:
    """One row of df for each combination of the keys, nulls alike: the one with the least hash of all its columns.

    Rows meet on the map side first, so a key that very many rows have is no large group.
    """
    hashed = [F.col(f"`{f.name}`") for f in df.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*[F.col(f"`{c}`") for c in rest])
    # the keys go out as they are, so that a join by them needs no other shuffle
    return df.groupBy(*keys).agg(F.min_by(row, F.xxhash64(*hashed)).alias("__one")).select(*keys, *[F.col(f"__one.`{c}`") for c in rest])


def running(df: DataFrame, order: list, sums: dict) -> DataFrame:
    """df with the running sum of each of `sums` (name to column), rows in an order without ties; no task has all rows.

    Rows are dealt by ranges of the order and summed within; of each range only its totals are summed over the ranges, of which
    there are as many as partitions.
    """
    ranged = checkpointed(df.withColumns({f"__{n}": c for n, c in sums.items()}).repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    so_far = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("__range").agg(*(F.sum(f"__{n}").alias(f"__t_{n}") for n in sums))
    before = totals.select("__range", *(F.coalesce(F.sum(f"__t_{n}").over(so_far), F.lit(0)).alias(f"__b_{n}") for n in sums))
    inside = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = ranged.withColumns({n: F.sum(f"__{n}").over(inside) for n in sums}).join(F.broadcast(before), "__range")
    return out.withColumns({n: F.col(n) + F.col(f"__b_{n}") for n in sums}).select(*df.columns, *sums)


def text_of(column: str = "text") -> Column:
    """The text, a null one as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def freed() -> None:
    """Gives memory that a task no longer needs back to the system, as Python workers live on for the next stages."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


def freeing(run):
    """A function for mapInArrow that frees memory when its task ends."""

    def all_batches(stream):
        yield from run(stream)
        freed()

    return all_batches


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def most_cold(total: int, most_hot: int = 1000) -> int:
    """Rows up to which a key isn't hot; keys with more number most_hot at most."""
    return max(1000, -(-total // most_hot))


def join_unique(big: DataFrame, small: DataFrame, key: str, weight: str, total: int, how: str = "inner", most_hot: int = 1000) -> DataFrame:
    """Joins on a key that is unique in small although few keys may hold most rows of big.

    weight is small's column with the rows that the key has in big, total their sum. Keys with over a most_hot-th of all rows
    number most_hot at most: they alone are broadcast. The others are joined by a shuffle, where no key is large.
    """
    least = most_cold(total, most_hot)
    rest = [c for c in small.columns if c != key]
    hot = small.filter(F.col(weight) > least).select(key, F.struct(*rest).alias("_hot"))
    cold = small.filter(F.col(weight) <= least).select(key, F.struct(*rest).alias("_cold"))
    marked = big.join(F.broadcast(hot), key, "left")
    # a row that has found its hot key needs no other: a null key never matches, and null keys are dealt out by a random salt
    loose = marked.withColumn("_key", F.when(F.col("_hot").isNull(), F.col(key))).withColumn("_salt", F.when(F.col("_hot").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(*[c for c in big.columns if c != key]), F.lit(65536)).cast("int")))
    # always 0, but not a literal: with one, Spark would deal by the key alone and bring all null keys to one task
    zero = F.pmod(F.xxhash64("_key"), F.lit(1)).cast("int")
    joined = loose.join(cold.withColumnRenamed(key, "_key").withColumn("_salt", zero), ["_key", "_salt"], "left")
    found = F.coalesce(F.col("_hot"), F.col("_cold"))
    out = joined.withColumn("_found", found)
    if how == "inner":
        out = out.filter(F.col("_found").isNotNull())
    return out.select(*big.columns, *[F.col(f"_found.{c}").alias(c) for c in rest])


#: Edges that one task contracts at a time, 16 bytes each.
BLOCK_EDGES = 500_000


def least_reached(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each end of the edges (u, v), and the smallest end that it reaches by them."""
    ids, where = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = where[: len(u)], where[len(u) :]
    label = np.arange(len(ids))
    while True:
        low, new = np.minimum(label[a], label[b]), label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            return ids, ids[label]
        label = new


def contracted(edges: DataFrame, block: int) -> DataFrame:
    """(u, v): stars that connect what the edges (u, v) do. A task takes `block` of them at a time and makes them stars."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def stars() -> pa.RecordBatch:
            ids, least = least_reached(*(np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("u", "v")))
            leaf = ids != least
            return pa.RecordBatch.from_arrays([pa.array(ids[leaf]), pa.array(least[leaf])], ["u", "v"])

        for batch in stream:
            if held and n + len(batch) > block:
                yield stars()
                held, n = [], 0
            held.append(batch)
            n += len(batch)
        if held:
            yield stars()

    return edges.mapInArrow(freeing(run), "u long, v long")


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", block: int = BLOCK_EDGES) -> DataFrame:
    """(id, component): the smallest id that each end of an edge reaches. Ids without an edge are absent.

    Blocks of edges become stars, each within a task. If there is more than one block, large-star and small-star steps (each is one
    shuffle of at most as many edges as before) alternate until all edges are stars; every round is checkpointed. A hub's edges leave
    it in the first rounds, as all of them point at the smallest id.
    """
    e = checkpointed(edges.select(F.col(src).cast("long").alias("u"), F.col(dst).cast("long").alias("v")).filter("u <> v"))
    blocks = max(1, -(-e.count() // block))
    e = checkpointed(contracted(e.coalesce(blocks), block))
    last = None
    while blocks > 1:
        both = e.union(e.select(F.col("v"), F.col("u")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v")
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.*").filter("u <> v").distinct()
        e = checkpointed(small)
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    stars = e.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return stars.union(stars.select(F.col("component").alias("id"), "component").distinct())
