"""Queries over streams that replay a table in parts, stopped and restarted in between, and over the vector index."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import vector_index, vectors
from ..streaming import dedup, ingest, jobs
from ..work import checkpointed, shared_folder
from . import operators
from .operators import table

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _replayed(rows: DataFrame, order: str, parts: int, run) -> None:
    """Adds the rows to a folder in `parts` parts of rising order, and calls run(a stream of the folder) after each of them."""
    spark = rows.sparkSession
    folder = _folder(spark, "replay")
    cuts = rows.approxQuantile(order, [k / parts for k in range(1, parts)], 0.01) if parts > 1 else []
    bounds = [None, *cuts, None]
    for low, high in zip(bounds, bounds[1:], strict=False):
        some = rows
        if low is not None:
            some = some.filter(F.col(order) >= low)
        if high is not None:
            some = some.filter(F.col(order) < high)
        some.write.mode("append").parquet(folder)
        run(spark.readStream.schema(rows.schema).parquet(folder))


@query(operators.ORACLE["author_aware_dedup"])
def author_aware_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents come in three parts; the decisions are those of one batch."""
    out, state = _folder(spark, "decided"), _folder(spark, "state")
    text = F.col("text")

    def run(stream: DataFrame) -> None:
        posts = stream.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("batch_seq"), T.simhash64(text).alias("simhash"), text.alias("clean_text"), (F.col("doc_id") % 37).cast("string").alias("author"), (F.col("doc_id") % 11 == 0).alias("is_noise"))
        dedup.decide(posts, out, state).awaitTermination()

    _replayed(table(spark, sf_dir, "documents"), "doc_id", 3, run)
    return dedup.decisions(spark, out).select("id", "dup_type", "similar_to", "similar_note")


_KIND = "CASE event_type WHEN 'signup' THEN 'submit' WHEN 'click' THEN 'start' WHEN 'view' THEN 'progress' WHEN 'purchase' THEN 'success' ELSE 'failure' END"
_JOBS = f"""WITH RECURSIVE e AS MATERIALIZED (SELECT user_id::VARCHAR AS job_id, event_id AS seq, {_KIND} AS kind, greatest(0, least(100, floor(value)::INTEGER)) AS progress, event_type AS detail, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events WHERE user_id IS NOT NULL),
w(job_id, i, seq, status, progress, attempt, detail, told) AS (
  SELECT DISTINCT job_id, 0::BIGINT, 0::BIGINT, '', 0, 0, '', false FROM e
  UNION ALL
  SELECT job_id, i, seq, CASE WHEN told THEN CASE kind WHEN 'submit' THEN 'pending' WHEN 'success' THEN 'success' WHEN 'failure' THEN 'failed' ELSE 'running' END ELSE status END,
    CASE kind WHEN 'submit' THEN 0 WHEN 'start' THEN 5 WHEN 'progress' THEN progress WHEN 'success' THEN 100 ELSE 0 END, CASE WHEN told AND kind = 'submit' THEN attempt + 1 ELSE attempt END, detail, told
  FROM (SELECT e.job_id, e.i, e.seq, e.kind, e.progress, e.detail, w.status, w.attempt,
      CASE e.kind WHEN 'submit' THEN w.status IN ('', 'success', 'failed') WHEN 'start' THEN w.status = 'pending' ELSE w.status = 'running' END AS told FROM w JOIN e ON e.job_id = w.job_id AND e.i = w.i + 1) x)
SELECT job_id, seq, status, progress, attempt, detail FROM w WHERE told"""


@query(_JOBS)
def job_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of a user as those of a job, in three parts of rising event_id."""
    out, state = _folder(spark, "jobs"), _folder(spark, "state")
    progress = F.greatest(F.lit(0), F.least(F.lit(100), F.floor("value").cast("int")))
    rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("job_id"), F.col("event_id").alias("seq"), F.expr(_KIND).alias("kind"), progress.alias("progress"), F.col("event_type").alias("detail"))
    _replayed(rows, "seq", 3, lambda stream: ingest.write_batches(jobs.transitions(stream), ingest.parquet_sink(out), state).awaitTermination())
    return spark.read.schema(jobs.TRANSITIONS).option("recursiveFileLookup", True).parquet(out)


def _indexed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, str]:
    """(stated queries, base, path): an index fitted on every second vector, to which the others are appended."""
    base = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    path = _folder(spark, "index")
    vector_index.build(base.filter("vec_id % 2 = 0"), path)
    vector_index.append(base.filter("vec_id % 2 = 1"), path)
    return base.filter("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id"), base, path


@query()
def vector_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, _, path = _indexed(spark, sf_dir)
    return vector_index.search(queries, path)


@query("SELECT count(*) AS queries, 5 * count(*) AS found, true AS recalled FROM embeddings WHERE vec_id % 100 = 0")
def vector_index_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether nine in ten of the exact five nearest of each stated query are among the five that the index gives."""
    queries, base, path = _indexed(spark, sf_dir)
    found = checkpointed(vector_index.search(queries, path))
    share: Column = F.lit(vector_index.recall(found, vectors.top_k(queries, base)) >= 0.9)
    return queries.agg(F.count(F.lit(1)).alias("queries")).join(found.agg(F.count(F.lit(1)).alias("found"))).select("queries", "found", share.alias("recalled"))
