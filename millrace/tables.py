"""Tables in hash buckets of a key: a change writes the buckets that it touches, and nothing else.

A table's folder has `data/<change>/_bucket=<b>`, which never change once they are written, and `v<n>`, a list of the pieces that make
up version n. A version counts once its list is committed, so readers see the table before a change or after it; what a writer that
died has left in data is in no list. Of two writers of one version, the second one's list fails and nothing of it is seen.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import warehouse

#: Buckets of a table, and pieces that a bucket may have before an addition writes it anew.
BUCKETS, PIECES = 64, 8


class Tables:
    """schemas: columns of each table; keys: the column whose hash names a row's bucket."""

    def __init__(self, spark: SparkSession, root: str, schemas: dict[str, str], keys: dict[str, str], buckets: int = BUCKETS):
        self.spark, self.root, self.schemas, self.keys, self.buckets = spark, root.rstrip("/"), schemas, keys, buckets

    # -- versions --

    def _path(self, path: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self, name: str) -> list[int]:
        """Numbers of the versions whose list is whole: Spark's committer leaves _SUCCESS when all its files are there."""
        top, fs = self._path(f"{self.root}/{name}")
        if not fs.exists(top):
            return []
        folders = [x.getPath() for x in fs.listStatus(top)]
        return sorted(int(p.getName()[1:]) for p in folders if p.getName().startswith("v") and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def pieces(self, name: str, version: int | None = None) -> list[tuple[int, str]]:
        """(bucket, change) of a version, the last one if none is given."""
        known = self.versions(name)
        if not known:
            return []
        rows = self.spark.read.schema("bucket int, change string").parquet(f"{self.root}/{name}/v{version or known[-1]:012d}").collect()
        return sorted((r.bucket, r.change) for r in rows)  # as many as buckets, times PIECES at most

    def _read(self, name: str, pieces: list[tuple[int, str]]) -> DataFrame:
        if not pieces:
            return self.spark.createDataFrame([], self.schemas[name])
        return self.spark.read.schema(self.schemas[name]).parquet(*(f"{self.root}/{name}/data/{change}/_bucket={b}" for b, change in pieces))

    def table(self, name: str, version: int | None = None) -> DataFrame:
        """A table; an empty one if it was never written."""
        return self._read(name, self.pieces(name, version))

    def _bucket(self, name: str) -> Column:
        return F.pmod(F.xxhash64(self.keys[name]), F.lit(self.buckets)).cast("int")

    def _shaped(self, name: str, df: DataFrame) -> DataFrame:
        wanted = self.spark.createDataFrame([], self.schemas[name]).schema
        return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted))

    def _change(self, name: str, rows: DataFrame, others: list[tuple[int, str]]) -> None:
        """Writes rows as pieces of a new version, to which `others` belong too."""
        version = (self.versions(name) or [0])[-1] + 1
        change = f"{version:012d}-{uuid.uuid4().hex}"
        path = f"{self.root}/{name}/data/{change}"
        self._shaped(name, rows).withColumn("_bucket", self._bucket(name)).repartition("_bucket").write.partitionBy("_bucket").parquet(path)
        top, fs = self._path(path)
        written = [(int(x.getPath().getName().partition("=")[2]), change) for x in fs.listStatus(top) if x.getPath().getName().startswith("_bucket=")]
        self.spark.createDataFrame(sorted({*others, *written}), "bucket int, change string").coalesce(1).write.parquet(f"{self.root}/{name}/v{version:012d}")

    # -- changes --

    def write(self, name: str, df: DataFrame) -> None:
        """The whole table anew."""
        self._change(name, df, [])

    def append(self, name: str, df: DataFrame) -> None:
        """More rows. Buckets that have many pieces by now are written anew, the others get one more."""
        pieces = self.pieces(name)
        many = {b for b in range(self.buckets) if sum(x == b for x, _ in pieces) >= PIECES}
        rows = self._shaped(name, df)
        if many:
            rows = rows.unionByName(self._read(name, [p for p in pieces if p[0] in many]))
        self._change(name, rows, [p for p in pieces if p[0] not in many])

    def merge(self, name: str, new: DataFrame, change: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        """Replaces the buckets that new's keys are in by change(their rows, new). new is read several times: give what is written."""
        touched = {r[0] for r in new.select(self._bucket(name)).distinct().collect()}  # as many as buckets
        if not touched:
            return
        pieces = self.pieces(name)
        self._change(name, change(self._read(name, [p for p in pieces if p[0] in touched]), new), [p for p in pieces if p[0] not in touched])

    def upsert(self, name: str, df: DataFrame, keys: list[str], fixed: tuple[str, ...] = ()) -> None:
        """Rows of known keys get the values that aren't null, except of the columns in fixed; others are added. keys has the bucket's."""
        if self.keys[name] not in keys:
            raise ValueError(f"{name} is in buckets of {self.keys[name]}, which {keys} does not have")
        self.merge(name, self._shaped(name, df), lambda base, new: warehouse.upsert(base, new, keys, fixed=fixed))

    def vacuum(self, name: str, keep: int = 2) -> None:
        """Drops versions before the last `keep`, and the data that is in none of the rest."""
        known = self.versions(name)
        for v in known[:-keep]:
            path, fs = self._path(f"{self.root}/{name}/v{v:012d}")
            fs.delete(path, True)
        used = {c for v in known[-keep:] for _, c in self.pieces(name, v)}
        top, fs = self._path(f"{self.root}/{name}/data")
        if fs.exists(top):
            newest = known[-1] if known else 0
            for x in fs.listStatus(top):
                change = x.getPath().getName()
                # what is newer than the last list may be a change that is just being written
                if change not in used and int(change.partition("-")[0]) <= newest:
                    fs.delete(x.getPath(), True)
