"""An index for nearest neighbours: vectors in cells around centres, as a table partitioned by cell.

Centres are fitted on a bounded sample; every vector is in the table. A query looks into the cells whose centres are nearest to it and
compares with all vectors there. How many cells it takes is measured on the sample, and kept with the centres.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Vectors, at most, that centres and the number of probed cells are fitted on, and how many of them serve as queries for the latter.
SAMPLE, TRIED = 20_000, 200
#: Queries of a block, which the tasks are sent.
BLOCK = 4096
ROUNDS = 12


@dataclass(frozen=True)
class Fit:
    centres: np.ndarray
    probes: int


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; rows of zeros, to which nothing is similar, stay zeros."""
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _centres(x: np.ndarray, cells: int, seed: int = 7) -> np.ndarray:
    """Spherical k-means: the centre of a cell is the direction of its vectors' mean; an empty cell takes a vector of the largest."""
    r = np.random.default_rng(seed)
    centres = x[r.choice(len(x), cells, replace=False)]
    for _ in range(ROUNDS):
        cell = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, cell, x)
        counts = np.bincount(cell, minlength=cells)
        for empty in np.flatnonzero(counts == 0):
            sums[empty] = x[r.choice(np.flatnonzero(cell == counts.argmax()))]
        centres = _unit(sums)
    return centres


def _probes(x: np.ndarray, centres: np.ndarray, k: int, recall: float) -> int:
    """The fewest cells that must be looked into to find a share `recall` of the k nearest of the sample's own vectors."""
    tried = min(TRIED, len(x))
    near = x[:tried] @ x.T
    near[np.arange(tried), np.arange(tried)] = -2
    best = np.argsort(-near, axis=1)[:, : min(k, len(x) - 1)]
    cell = (x @ centres.T).argmax(axis=1)
    rank = np.argsort(np.argsort(-(x[:tried] @ centres.T), axis=1), axis=1)
    needed = np.sort(np.take_along_axis(rank, cell[best], axis=1).ravel()) + 1
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)]) if len(needed) else 1


def fit(base: DataFrame, k: int = 5, recall: float = 0.95, cells: int | None = None, sample: int = SAMPLE) -> Fit:
    """Centres, and how many cells a query needs. base: (vec_id, embedding); of at most `sample` of its vectors, drawn at random.

    By default there are as many cells as the square root of the number of vectors, at most an eighth of the sample.
    """
    n = base.filter("embedding is not null").count()
    drawn = base.select("embedding").filter("embedding is not null").sample(min(1.0, 1.1 * sample / max(n, 1)), 7).limit(sample).toArrow()
    if drawn.num_rows == 0:
        return Fit(np.zeros((0, 0)), 1)
    x = _unit(_matrix(drawn.column("embedding")))
    cells = max(1, min(cells or round(n**0.5), len(x) // 8))
    centres = _centres(x, cells)
    return Fit(centres, _probes(x, centres, k, recall))


def _in_cells(base: DataFrame, centres: np.ndarray) -> DataFrame:
    kind = base.schema["vec_id"].dataType.simpleString()

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            x = _unit(_matrix(batch.column("embedding")))
            cell = (x @ centres.T).argmax(axis=1).astype(np.int32) if len(x) else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("embedding"), pa.array(cell)], ["vec_id", "embedding", "cell"])

    rows = base.select("vec_id", F.col("embedding").cast("array<float>").alias("embedding")).filter("embedding is not null")
    return rows.mapInArrow(run, f"vec_id {kind}, embedding array<float>, cell int")


def build(base: DataFrame, path: str, **how) -> Fit:
    """Fits and writes the index of base (vec_id, embedding) under path; vectors that are null are not in it."""
    fitted = fit(base, **how)
    spark = base.sparkSession
    spark.createDataFrame([(json.dumps({"probes": fitted.probes, "shape": fitted.centres.shape}), fitted.centres.tobytes())], "meta string, centres binary").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")
    _written(base, path, fitted, "overwrite")
    return fitted


def _written(base: DataFrame, path: str, fitted: Fit, mode: str) -> None:
    if fitted.centres.size:
        # a cell's rows go to few files, and a large cell's to several: cells are dealt with a part of the key
        dealt = _in_cells(base, fitted.centres).repartition("cell", F.pmod(F.xxhash64("vec_id"), F.lit(4)))
        dealt.write.mode(mode).partitionBy("cell").parquet(f"{path}/cells")


def load(spark: SparkSession, path: str) -> Fit:
    row = spark.read.parquet(f"{path}/centres").first()
    meta = json.loads(row.meta)
    return Fit(np.frombuffer(row.centres, np.float64).reshape(meta["shape"]), meta["probes"])


def append(new: DataFrame, path: str) -> None:
    """Adds vectors to the cells of an index, which are not fitted again."""
    _written(new, path, load(new.sparkSession, path), "append")


def search(queries: DataFrame, path: str, k: int = 5, probes: int | None = None, block: int = BLOCK) -> DataFrame:
    """(query_id, vec_id, rank, similarity): for each query (query_id, embedding) the k nearest vectors of the cells it looks into.

    Only the files of those cells are read. The stated queries go in blocks, which tasks are sent; a task multiplies each batch of
    a cell's vectors by the queries that look into the cell and keeps k of each, which are all that is shuffled. A vector with the
    query's own id is left out. Ties go to the smaller id.
    """
    spark = queries.sparkSession
    fitted = load(spark, path)
    kinds = [queries.schema["query_id"].dataType.simpleString()]
    schema_of = lambda base: f"query_id {kinds[0]}, vec_id {base}, similarity double"
    if not fitted.centres.size:
        return spark.createDataFrame([], schema_of(kinds[0]) + ", rank int").select("query_id", "vec_id", "rank", "similarity")
    base = spark.read.parquet(f"{path}/cells")
    schema, out = schema_of(base.schema["vec_id"].dataType.simpleString()), None
    asked = queries.select("query_id", F.col("embedding").cast("array<float>").alias("embedding")).filter("embedding is not null")
    blocks = max(1, -(-asked.count() // block))
    for b in range(blocks):
        part = asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).toArrow()  # a block of the stated queries
        if not part.num_rows:
            continue
        q = _unit(_matrix(part.column("embedding")))
        ids = part.column("query_id").combine_chunks()
        cells = np.argsort(-(q @ fitted.centres.T), axis=1)[:, : probes or fitted.probes]
        found = base.filter(F.col("cell").isin([int(c) for c in np.unique(cells)])).mapInArrow(_scoring(q, ids, cells, k), schema)
        out = found if out is None else out.union(found)
    if out is None:
        return spark.createDataFrame([], schema + ", rank int").select("query_id", "vec_id", "rank", "similarity")
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "vec_id", "rank", "similarity")


def _scoring(q: np.ndarray, ids: pa.Array, cells: np.ndarray, k: int):
    names, number = ids.to_pylist(), {}
    for at, of in enumerate(cells):
        for c in of:
            number.setdefault(int(c), []).append(at)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            x, cell = _unit(_matrix(batch.column("embedding"))), batch.column("cell").to_numpy()
            vec = batch.column("vec_id").to_pylist()
            hits, rows, scores = [], [], []
            for c in np.unique(cell):
                at, asking = np.flatnonzero(cell == c), np.array(number.get(int(c), ()), np.int64)
                if not len(asking):
                    continue
                near = q[asking] @ x[at].T
                for i, one in zip(asking, near, strict=True):
                    # all that are as near as the k-th, but not the query itself
                    least = np.partition(one, -k - 1)[-k - 1] if len(one) > k + 1 else -2
                    for j in np.flatnonzero(one >= least):
                        if vec[at[j]] != names[i]:
                            hits.append(i)
                            rows.append(at[j])
                            scores.append(one[j])
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(hits, pa.int64())), batch.column("vec_id").take(pa.array(rows, pa.int64())), pa.array(scores, pa.float64())], ["query_id", "vec_id", "similarity"])

    return run


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of exact's (query_id, vec_id) that found has; 1 where there is nothing to find."""
    hit = exact.select("query_id", "vec_id").join(found.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left")
    return hit.agg(F.coalesce(F.avg(F.coalesce("hit", F.lit(0))), F.lit(1.0))).first()[0]
