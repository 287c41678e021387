"""Nearest neighbours by cosine similarity."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..work import checkpointed

#: Queries and vectors that are multiplied at once. Products tell similarities to within SLACK; what may count is then computed in order.
QUERIES_AT_ONCE, VECTORS_AT_ONCE, SLACK = 512, 4096, 1e-9
#: Parts of queries and of vectors, and most tasks that pairs of parts are dealt to.
PARTS, TASKS = 8, 256


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def _packed(df: DataFrame, name: str, most: int, prefix: str) -> DataFrame:
    """Rows of at most `most` vectors: {prefix}_ids and {prefix}_vectors, in PARTS parts, written once."""
    kinds = [df.schema[c].dataType.simpleString() for c in (name, "embedding")]

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in stream:
            for begin in range(0, whole.num_rows, most):
                part = whole.slice(begin, most)
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), c) for c in part.columns], [f"{prefix}_ids", f"{prefix}_vectors"])

    rows = df.select(name, "embedding").filter(F.col(name).isNotNull()).repartition(PARTS, name)
    return checkpointed(rows.mapInArrow(run, f"{prefix}_ids array<{kinds[0]}>, {prefix}_vectors array<{kinds[1]}>"))


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(vectors, norms) of a column of arrays; null vectors are rows of NaN."""
    known = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
    some = column.drop_null().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = np.full((len(column), len(some) // len(known) if len(known) else 1), np.nan)
    x[known] = some.reshape(len(known), x.shape[1])
    return x, np.sqrt(_in_order(x, x))


def _in_order(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row by row the scalar product, added from the first dimension to the last, as dot() does: equal vectors have equal ones."""
    out = np.zeros(len(x))
    for d in range(x.shape[1]):
        out += x[:, d] * y[:, d]
    return out


def _unit(x: np.ndarray, norm: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore", divide="ignore"):
        return x / norm[:, None]


def _similar(queries: DataFrame, base: DataFrame, least: Callable[[np.ndarray], np.ndarray], keep: Callable, block: int) -> DataFrame:
    """(query_id, vec_id, similarity) of what keep() leaves of the pairs whose product is at least least(products), less SLACK.

    Queries and vectors are in packed rows, and each two rows are read where they were written: neither goes through the driver.
    """
    kinds = [queries.schema["query_id"].dataType.simpleString(), base.schema["vec_id"].dataType.simpleString()]
    tiles = _packed(queries, "query_id", block, "q").crossJoin(_packed(base, "vec_id", VECTORS_AT_ONCE, "v").hint("shuffle_replicate_nl"))

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in stream:
            for r in range(whole.num_rows):
                q_ids, q_vectors, ids, vectors = (whole.slice(r, 1).column(c).flatten() for c in ("q_ids", "q_vectors", "v_ids", "v_vectors"))
                yield from _multiplied(q_ids, q_vectors, least, keep)(ids, vectors)

    return tiles.coalesce(TASKS).mapInArrow(run, f"query_id {kinds[0]}, vec_id {kinds[1]}, similarity double")


def _multiplied(ids: pa.Array, vectors: pa.Array, least: Callable[[np.ndarray], np.ndarray], keep: Callable) -> Callable[[pa.Array, pa.Array], Iterator[pa.RecordBatch]]:
    """What _similar() finds for these queries among a batch of vectors.

    A product is -2 where either vector is null or zero, and so is the similarity for keep(), which is null in the end; it is -3 where
    a vector has the query's id, and such pairs are left out.
    """
    q, q_norm = _matrix(vectors)
    unit = np.nan_to_num(_unit(q, q_norm), nan=0.0)
    q_null = np.isnan(q_norm) | (q_norm == 0)
    places: dict = {}
    for at, name in enumerate(ids.to_pylist()):
        places.setdefault(name, []).append(at)
    places = {name: np.array(at) for name, at in places.items()}

    def scored(names: list, x: np.ndarray, norm: np.ndarray, at: slice):
        null = np.isnan(norm) | (norm == 0)
        if x.shape[1] != q.shape[1] and not (null.all() or q_null.all()):
            raise ValueError("vectors have different lengths")
        if x.shape[1] == q.shape[1]:
            near = unit[at] @ np.nan_to_num(_unit(x, norm), nan=0.0).T
        else:
            near = np.zeros((len(unit[at]), len(x)))
        near[:, null] = -2
        near[q_null[at]] = -2
        for j, name in enumerate(names):
            if name in places:
                near[places[name][(places[name] >= at.start) & (places[name] < at.stop)] - at.start, j] = -3
        i, j = np.nonzero((near >= least(near)[:, None] - SLACK) & (near > -2.5))
        score = np.full(len(i), -2.0)
        for some in np.array_split(np.arange(len(i)), len(i) // 1_000_000 + 1):
            a, b = i[some] + at.start, j[some]
            told = ~(q_null[a] | null[b])
            a, b = a[told], b[told]
            score[some[told]] = _in_order(q[a], x[b]) / (q_norm[a] * norm[b])
        return i + at.start, j, score

    def run(vec: pa.Array, of: pa.Array) -> Iterator[pa.RecordBatch]:
        names, (x, norm) = vec.to_pylist(), _matrix(of)
        for start in range(0, len(ids), QUERIES_AT_ONCE):
            i, j, score = scored(names, x, norm, slice(start, min(start + QUERIES_AT_ONCE, len(ids))))
            kept = keep(i, vec.take(pa.array(j)), score)
            i, j, score = i[kept], j[kept], score[kept]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(i)), vec.take(pa.array(j)), pa.array(score, pa.float64(), mask=score == -2)], ["query_id", "vec_id", "similarity"])

    return run


def top_k(queries: DataFrame, base: DataFrame, k: int = 5, block: int = 10_000) -> DataFrame:
    """(query_id, vec_id, rank, similarity): for each query (query_id, embedding) the k nearest of base (vec_id, embedding), exact.

    Queries are in rows of at most `block`, vectors in batches. A task multiplies batches of vectors by rows of queries; what may be
    among the k best of a batch is computed as cosine() does, and only the k best are shuffled.
    """
    def least(near: np.ndarray) -> np.ndarray:
        return np.partition(near, -k, axis=1)[:, -k] if near.shape[1] > k else np.full(len(near), -2.0)

    def keep(i: np.ndarray, vec: pa.Array, score: np.ndarray) -> np.ndarray:
        names = np.unique(np.array(vec.to_pylist(), dtype=object if pa.types.is_string(vec.type) else None), return_inverse=True)[1].ravel() if len(vec) else i
        order = np.lexsort((names, -score, i))
        first = np.searchsorted(i[order], i[order])
        return order[np.arange(len(order)) - first < k]

    out = _similar(queries, base, least, keep, block)
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "vec_id", "rank", "similarity")


def within(queries: DataFrame, base: DataFrame, distance: float, block: int = 10_000) -> DataFrame:
    """(query_id, vec_id, distance) of all base vectors nearer to a query than a cosine distance; queries in rows as in top_k()."""
    def least(near: np.ndarray) -> np.ndarray:
        return np.full(len(near), max(1 - distance, -1.5))

    def keep(i: np.ndarray, vec: pa.Array, score: np.ndarray) -> np.ndarray:
        return np.flatnonzero((1 - score < distance) & (score > -2))

    out = _similar(queries, base, least, keep, block)
    return out.select("query_id", "vec_id", (1 - F.col("similarity")).alias("distance"))


def embedded(df: DataFrame, text: str, model: Callable[[pd.Series], list[list[float]]], characters: int | None = None, column: str = "embedding") -> DataFrame:
    """df with the vector that a model gives for a text (or its first `characters` characters), a null one as the empty text.

    model: a function from texts to vectors, run on Arrow batches; what the model reads of a text is its own limit.
    """

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([[float(x) for x in v] for v in model(texts)])

    whole = F.coalesce(text, F.lit(""))
    return df.withColumn(column, run(whole if characters is None else F.left(whole, F.lit(characters))))


def term_variants(words: DataFrame, terms: DataFrame, least: float = 0.75, k: int = 3, key: str = "id") -> DataFrame:
    """(key, word, similar_to, similarity): a text's words that are near a dictionary term, with the nearest.

    words: key, word, embedding, of whole texts. terms: term, embedding. Words that are terms themselves are no variants. Each distinct
    word is searched for once, as its embedding is the same wherever it stands.
    """
    others = words.join(terms.select(F.col("term").alias("word")).distinct(), "word", "left_anti")
    distinct = others.groupBy(F.col("word").alias("query_id")).agg(F.first("embedding").alias("embedding"))
    near = top_k(distinct, terms.select(F.col("term").alias("vec_id"), "embedding"), k).filter((F.col("rank") == 1) & (F.col("similarity") >= least))
    return others.select(key, "word").distinct().join(near.select(F.col("query_id").alias("word"), F.col("vec_id").alias("similar_to"), "similarity"), "word").select(key, "word", "similar_to", "similarity")
