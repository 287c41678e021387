"""File sources and sinks: partner JSON lines, JSON documents, dictionaries, tables over JDBC."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import PARTNER

REQUIRED = ("platform", "content_raw", "content_type", "collected_at")


def partner_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad rows) of a JSON-lines file; a bad row is no JSON or lacks a required field. Blank lines are no rows."""
    rows = spark.read.schema(PARTNER + ", _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    whole = F.col("_bad").isNull()
    for c in REQUIRED:
        whole = whole & (F.coalesce(F.col(c), F.lit("")) != "")
    return rows.filter(whole).drop("_bad"), rows.filter(~whole)


def json_documents(spark: SparkSession, path: str, item: str = "platform string, content_raw string, source_url string, author_username string") -> DataFrame:
    """Items of {items: [...]} or {messages: [...]} documents that have content."""
    body = f"array<struct<{item.replace(' string', ': string')}>>"
    rows = spark.read.schema(f"items {body}, messages {body}").option("multiLine", True).json(path)
    return rows.select(F.explode(F.coalesce("items", "messages")).alias("i")).select("i.*").filter(F.coalesce("content_raw", F.lit("")) != "")


def slang_dictionary(spark: SparkSession, path: str, form: str = "json") -> DataFrame:
    """(term, normalized_meaning, category, source) of a JSON array or a CSV file with `meaning` or `normalized_meaning`."""
    columns = "slang string, meaning string, normalized_meaning string, category string, source string"
    if form == "csv":
        rows = spark.read.option("header", True).csv(path)
        for c in ("slang", "meaning", "normalized_meaning", "category", "source"):
            if c not in rows.columns:
                rows = rows.withColumn(c, F.lit(None).cast("string"))
    else:
        rows = spark.read.schema(columns).option("multiLine", True).json(path)
    return rows.select(F.col("slang").alias("term"), F.coalesce("normalized_meaning", "meaning").alias("normalized_meaning"), "category", F.coalesce("source", F.lit("manual")).alias("source")).filter(F.coalesce("term", F.lit("")) != "")


def excel_dictionary(spark: SparkSession, paths: list[str]) -> DataFrame:
    """First three columns, by position, of small workbooks; needs an Excel reader for pandas."""
    import pandas as pd

    frames = [pd.read_excel(p).iloc[:, :3].set_axis(["term", "normalized_meaning", "category"], axis=1) for p in paths]
    return spark.createDataFrame(pd.concat(frames).astype(str))


def jdbc_table(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, parts: int, **options: str) -> DataFrame:
    """A table read in `parts` ranges of a numeric key."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=key, lowerBound=str(low), upperBound=str(high), numPartitions=str(parts), **options).load()


def write_by_platform(df: DataFrame, path: str) -> None:
    df.write.partitionBy("platform").mode("overwrite").json(path)


def media_key(url):
    """Name under which a medium is kept."""
    return F.substring(F.md5(url), 1, 16)


def new_rows(df: DataFrame, known: DataFrame) -> DataFrame:
    """Rows of df that known has neither by (platform, source_url) nor by (platform, message_id); of repeats in df one.

    Rows without a URL, such as chat messages, are told by message_id alone; those with neither are all new.
    """
    has = lambda d, c: F.coalesce(F.col(c), F.lit("")) != "" if c in d.columns else F.lit(False)
    left = df
    for c in ("source_url", "message_id"):
        if c in df.columns:
            named = left.filter(has(df, c)).dropDuplicates(["platform", c])
            if c in known.columns:
                named = named.join(known.filter(has(known, c)).select("platform", c).distinct(), ["platform", c], "left_anti").select(*df.columns)
            left = named.union(left.filter(~has(df, c)))
    return left
