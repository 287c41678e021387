"""Kept media: `root/<platform>/<raw id>/<md5 of the URL, 16 digits><extension>`, listed as a DataFrame, found by URL, and let go by age."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import media_key

#: Extensions in the order in which a kept file is looked for, the extension that a content type has, and that of others.
EXTENSIONS = (".jpg", ".png", ".webp", ".jpeg", ".gif")
OF_TYPE = (("png", ".png"), ("webp", ".webp"), ("jpeg", ".jpg"), ("jpg", ".jpg"), ("gif", ".gif"))
OTHER = ".jpg"
#: First bytes of files: at which place, in hexadecimal.
SIGNATURES = ((1, "89504E470D0A1A0A", ".png"), (1, "FFD8FF", ".jpg"), (1, "474946383761", ".gif"), (1, "474946383961", ".gif"), (9, "57454250", ".webp"))


def extension_of_type(content_type: Column) -> Column:
    """The extension that a content type stands for."""
    out = None
    for word, extension in OF_TYPE:
        has = F.contains(F.coalesce(content_type, F.lit("")), F.lit(word))
        out = F.when(has, extension) if out is None else out.when(has, extension)
    return out.otherwise(OTHER)


def extension_of_content(content: Column) -> Column:
    """The extension by a file's first bytes; null for bytes that are none of the known images."""
    head = F.hex(F.substring(content, 1, 16))
    out = None
    for at, signature, extension in SIGNATURES:
        starts = F.substring(head, 2 * at - 1, len(signature)) == signature
        out = F.when(starts, extension) if out is None else out.when(starts, extension)
    return out


def listing(spark: SparkSession, root: str, content: bool = False) -> DataFrame:
    """(platform, raw_id, key, extension, path, modified, length[, content]) of the files under root.

    Without content only the file system's listing is read. Files that don't stand in the layout have nulls; empty files, which Spark's
    source passes over, are not listed.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    layout = r"/([^/]+)/(\d+)/([0-9a-f]{16})(\.\w+)$"
    part = lambda i: F.nullif(F.regexp_extract("path", layout, i), F.lit(""))
    out = files.select(part(1).alias("platform"), part(2).cast("long").alias("raw_id"), part(3).alias("key"), part(4).alias("extension"), "path", F.col("modificationTime").alias("modified"), "length", *(["content"] if content else []))
    return out


def paths_of(posts: DataFrame, files: DataFrame) -> DataFrame:
    """(raw_id, n, url, path): the kept file of each URL of posts (platform, raw_id, media_urls), in their order; URLs without one are left out.

    Of files with several extensions the first by EXTENSIONS is taken; a URL that a post has twice has its file twice.
    """
    urls = posts.select("platform", "raw_id", F.posexplode("media_urls").alias("n", "url")).filter(F.coalesce("url", F.lit("")) != "").withColumn("key", media_key(F.col("url")))
    rank = F.array_position(F.array(*map(F.lit, EXTENSIONS)), F.col("extension"))
    known = files.withColumn("_rank", rank).filter("_rank > 0").groupBy("platform", "raw_id", "key").agg(F.min_by("path", "_rank").alias("path"))
    return urls.join(known, ["platform", "raw_id", "key"]).select("raw_id", "n", "url", "path")


def missing(posts: DataFrame, files: DataFrame) -> DataFrame:
    """(platform, raw_id, url, key): what has to be fetched, each URL of a post once."""
    urls = posts.select("platform", "raw_id", F.explode("media_urls").alias("url")).filter(F.coalesce("url", F.lit("")) != "").distinct().withColumn("key", media_key(F.col("url")))
    return urls.join(files.filter(F.col("extension").isin(*EXTENSIONS)).select("platform", "raw_id", "key").distinct(), ["platform", "raw_id", "key"], "left_anti").select("platform", "raw_id", "url", "key")


def expired(files: DataFrame, now: datetime.datetime, days: int = 30, platform: str | None = None) -> DataFrame:
    """Files that were last changed more than so many days before now; of one platform if it is given."""
    old = files.filter(F.col("modified") < F.lit(now - datetime.timedelta(days=days)))
    return old if platform is None else old.filter(F.col("platform") == platform)


def remove(files: DataFrame) -> int:
    """Deletes listed files by their paths and returns how many were there; only a partition's paths are in the driver at a time."""
    spark = files.sparkSession
    gone = 0
    for row in files.select("path").toLocalIterator():
        path = spark._jvm.org.apache.hadoop.fs.Path(row.path)
        gone += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, False)
    return gone
