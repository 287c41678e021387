"""From documents to packed training sequences, in five stages.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next one's docs. All but
the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import exact_dedup, language_id, mixing, ngram_join, packing
from millrace.llm.common import drop_table, table, written_table
from millrace.llm.queries import tokenizer_path

#: A document's language must take this share of its words. Chance gives 1 / languages at least, so text in one of the learned
#: languages, switched or not, is far above it.
LEAST_SCORE = 0.3


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that can be told; those that are null, have no letter or no clear language go.

    Learns as op4 does from the labelled documents outside its held-out fifth. If none is labelled there is no language to tell,
    and only documents without a letter go.
    """
    model = language_id.train(docs.filter(~language_id.held_out()))
    if model is None:
        return docs.filter(F.rlike(F.coalesce("text", F.lit("")), F.lit(r"\p{L}")))
    judged = language_id.identify(docs, model, keep=tuple(docs.columns), names=("__lang", "__score"))
    return judged.filter((F.col("__lang") != language_id.NONE) & (F.col("__score") >= LEAST_SCORE)).select(*docs.columns)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the one with the largest doc_id."""
    return exact_dedup.survivors(docs, largest=True)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the row with the smallest doc_id; documents without words, which have no copies, all stay."""
    return ngram_join.survivors(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target weight takes them."""
    return mixing.mixed_rows(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences of 1024 tokens, as op2 gives them."""
    pieces = packing.token_pieces(docs, tokenizer_path()).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packing.pack(pieces)


STAGES = [
    ("language_id", known_language),
    ("exact_dedup", without_copies),
    ("near_duplicates", without_near_copies),
    ("mixing", mixed),
    ("packing", packed),
]

#: No SQL says what the conditional random field, the rounding or the packing do: tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs = written_table(stage(spark, docs, sf_dir))
        if before is not None:
            drop_table(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
