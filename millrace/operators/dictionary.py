"""Terms of a dictionary in texts, in one pass over the texts whatever the number of terms.

A dictionary of few bytes is an Aho-Corasick automaton that every task builds for itself and runs over Arrow batches. One of more bytes
is dealt to a few automata, each with a pass of its own. Beyond that, no task could hold it: terms are joined by their first characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..work import checkpointed

#: Bytes of terms in an automaton, which takes some fifty times as much in a task; and how many automata at most.
PART_BYTES, PARTS = 4 << 20, 8
#: First characters that terms beyond that are looked up by, at most.
FIRST = 16


def _automaton(terms: list[str]):
    import ahocorasick

    machine = ahocorasick.Automaton()
    for i, term in enumerate(terms):
        machine.add_word(term, i)
    machine.make_automaton()
    return machine


def _by_automaton(texts: DataFrame, terms: list[str], kind: str) -> DataFrame:
    """(id, term) for the given terms, each once a text."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _automaton(terms)
        for batch in stream:
            rows, found = [], []
            for i, text in enumerate(batch.column("text")):
                hits = {at for _, at in machine.iter(text.as_py())}
                rows += [i] * len(hits)
                found += [terms[at] for at in sorted(hits)]
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(rows, pa.int64())), pa.array(found, pa.string())], ["id", "term"])

    return texts.mapInArrow(run, f"id {kind}, term string")


def _by_first_characters(texts: DataFrame, terms: DataFrame, kind: str) -> DataFrame:
    """(id, term): every place of a text is looked up by as many characters as terms have at first, FIRST at most; then compared.

    Texts go to the join as windows of FIRST characters, not whole. A term that is longer is compared in its text, to which only
    candidates come back; a term with very common first characters meets its places by adaptive execution's split joins.
    """
    first = F.left("term", F.lit(FIRST))
    known = terms.select("term", first.alias("first"), F.length(first).alias("n"))
    sizes = sorted(r.n for r in known.select("n").distinct().collect())  # FIRST at most
    # numbered once and for all: a lost task must not number rows anew
    numbered = checkpointed(texts.withColumn("row", F.monotonically_increasing_id()))

    def windows(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for row, text in zip(batch.column("row").to_pylist(), batch.column("text"), strict=True):
                t = text.as_py()
                for at in range(0, len(t), 50_000):
                    some = list(dict.fromkeys(t[i : i + n] for n in sizes for i in range(at, min(at + 50_000, len(t) - n + 1))))
                    if some:
                        yield pa.RecordBatch.from_arrays([pa.array([row] * len(some), pa.int64()), pa.array(some)], ["row", "first"])

    met = numbered.select("row", "text").mapInArrow(windows, "row long, first string").distinct().join(known, "first").select("row", "term", "n")
    sure = F.length("term") == F.col("n")
    rest = met.filter(~sure).join(numbered.select("row", "text"), "row").filter(F.contains("text", "term"))
    hits = met.filter(sure).select("row", "term").union(rest.select("row", "term"))
    return hits.join(numbered.select("row", F.col("id").cast(kind).alias("id")), "row").select("id", "term")


def occurrences(df: DataFrame, terms: DataFrame, key: str = "id", text: str = "text", part_bytes: int = PART_BYTES, parts: int = PARTS) -> DataFrame:
    """(key, term, meaning) for the terms (term, meaning) that occur in a text, each row of terms once a row of df.

    Empty and null terms occur nowhere, a null text has none. The terms are told by their bytes, not their number: up to part_bytes
    they are one automaton, up to `parts` times as many that number of automata; more are joined by their first characters.
    """
    kind = df.schema[key].dataType.simpleString()
    known = terms.select("term", "meaning").filter("term <> ''")
    distinct = known.select("term").distinct()
    size = distinct.agg(F.sum(F.octet_length("term"))).first()[0] or 0
    texts = df.select(F.col(key).alias("id"), F.col(text).alias("text")).filter("text is not null")
    n = -(-size // part_bytes)
    if n <= parts:
        found = None
        for i in range(max(1, n)):
            some = [r.term for r in distinct.filter(F.pmod(F.xxhash64("term"), F.lit(max(1, n))) == i).collect()]  # of checked size
            one = _by_automaton(texts, some, kind) if some else None
            found = one if found is None else found if one is None else found.union(one)
        if found is None:
            found = df.sparkSession.createDataFrame([], f"id {kind}, term string")
    else:
        found = _by_first_characters(texts, distinct, kind)
    return found.join(known, "term").select(F.col("id").alias(key), "term", "meaning")
