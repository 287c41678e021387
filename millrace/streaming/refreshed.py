"""A stream against a table that changes while it runs: every micro-batch takes the newest version there is."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import dictionary
from ..tables import Tables


def with_newest(tables: Tables, name: str, use: Callable[[DataFrame, DataFrame], DataFrame], write: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: writes use(the batch, the table's newest version), with the version's number in column `version`.

    The version is looked up once a batch, so all its rows see the same one. A batch that comes again after a failure may see a newer
    one; write overwrites by the batch's number, so its rows are those of one version, whichever.
    """

    def run(batch: DataFrame, number: int) -> None:
        version = (tables.versions(name) or [0])[-1]
        write(use(batch, tables.table(name, version or None)).withColumn("version", F.lit(version)), number)

    return run


def terms_in(batch: DataFrame, slang: DataFrame) -> DataFrame:
    """(id, term, meaning): the active terms of dim_slang_dict in a batch of (id, text)."""
    return dictionary.occurrences(batch, slang.filter("status = 'active'").select("term", F.col("normalized_meaning").alias("meaning")))
