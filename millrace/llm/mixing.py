"""Mixes sources to target weights by pivotal dependent rounding of copy numbers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, checkpointed, join_unique, one_of_each, running, written_table

WEIGHTS, TOTAL, MOST = (5, 2, 1), 1.5, 2.0


def words(text: str = "text"):
    """Words of a text; a null text has none."""
    return F.coalesce(F.expr(f"regexp_count(`{text}`, r'{WORD}')"), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, total: float = TOTAL, most: float = MOST) -> DataFrame:
    """(source, source_size, documents, target) for a table (source, size) of documents.

    Sources in order of code points, null last, take the weights in turn. Together they get `total` times all sizes; a target
    stops at `most` times its source's size and the excess goes to the others by weight, until none is above. So a target is
    min(most * size, weight * level) for one level: with sources in order of size / weight, those before some place are capped
    and the rest share what is left, which running sums find. The table has a row for each source; no task has all of them.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("documents"))
    # a null source is its own key, last in order; no string is equal to it
    keyed = by_source.withColumn("_null", F.col("source").isNull())
    ranked = running(keyed, [F.col("_null"), F.col("source")], {"_rank": F.lit(1).cast("long")})
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("_rank") - 1) % len(weights) + 1).cast("int")).cast("double")
    weighted = ranked.withColumn("_weight", weight).withColumn("_cap", F.lit(most) * F.col("source_size")).withColumn("_ratio", F.col("_cap") / F.col("_weight"))
    summed = checkpointed(running(weighted, [F.col("_ratio"), F.col("_rank")], {"_caps": F.col("_cap"), "_weights": F.col("_weight")}))
    sizes_all, weights_all = summed.agg(F.sum("source_size"), F.sum("_weight")).first()
    # the level if this source and all behind it shared what those before leave; of the first that its own level doesn't cap, it is the level
    left = F.lit(float(total * (sizes_all or 0))) - (F.col("_caps") - F.col("_cap"))
    levels = summed.withColumn("_level", left / (F.lit(float(weights_all or 0)) - F.col("_weights") + F.col("_weight")))
    level = levels.filter(F.col("_cap") > F.col("_weight") * F.col("_level")).agg(F.min_by("_level", F.struct("_ratio", "_rank"))).first()[0]
    target = F.col("_cap") if level is None else F.least(F.col("_cap"), F.col("_weight") * F.lit(level))
    return summed.select("source", "source_size", "documents", target.alias("target"))


def pivotal(p: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Pairs neighbours and moves mass between them until at most one p is left that is neither 0 nor 1."""
    p = p.copy()
    held = -1
    for i in range(len(p)):
        b = p[i]
        if b <= 0 or b >= 1:
            continue
        if held < 0:
            held = i
            continue
        a = p[held]
        total = a + b
        if total <= 1:  # one gets all, the other none
            if u[i] * total < a:
                p[held], p[i] = total, 0.0
            else:
                p[held], p[i] = 0.0, total
        elif u[i] * (2 - total) < 1 - b:  # one is taken, the other gets the rest
            p[held], p[i] = 1.0, total - 1
        else:
            p[held], p[i] = total - 1, 1.0
        for k in (held, i):
            if p[k] < 1e-9 or p[k] > 1 - 1e-9:
                p[k] = round(p[k])
        held = next((k for k in (held, i) if 0 < p[k] < 1), -1)
    return p


def _numbered(table: DataFrame) -> DataFrame:
    """The table with _same: 0 for a row that no other repeats in everything, else its number among those, from 1.

    Rows that are alike are counted in each part of the table, and the parts' counts are added up, so no task has all of them. Any
    one of them may have any of the numbers.
    """
    keyed = table.withColumn("_alike", F.sha2(F.to_json(F.struct(*table.columns)), 256))
    repeated = checkpointed(keyed.groupBy("_alike").agg(F.count(F.lit(1)).alias("_times")).filter("_times > 1"))
    if repeated.isEmpty():
        return table.withColumn("_same", F.lit(0).cast("long"))
    told = join_unique(keyed, repeated, "_alike", "_times", table.count(), "left")
    many = checkpointed(told.filter("_times is not null").drop("_times").withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))
    counts = many.groupBy("_alike", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_alike", "_part", F.coalesce(F.sum("_n").over(Window.partitionBy("_alike").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_alike", "_part").orderBy("_at"))
    numbered = many.withColumn("_within", within).join(before, ["_alike", "_part"]).withColumn("_same", (F.col("_before") + F.col("_within")).cast("long"))
    once = told.filter("_times is null").withColumn("_same", F.lit(0).cast("long"))
    return once.select(*table.columns, "_same").union(numbered.select(*table.columns, "_same"))


def mix(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, total: float = TOTAL, most: float = MOST, seed: int = 0, per_group: int = 4096) -> DataFrame:
    """(row, doc_id, source, size, source_size, target, copies) for a table (row, doc_id, source, size).

    A document of a source is due target / source_size copies: the whole part is given, the fraction is rounded. In groups of
    about `per_group` documents of one source, neighbours by size are paired; each group leaves at most one document undecided.
    Those meet again, `per_group` to a group, until a source has one group; its last document is decided by chance. So a
    source's words are off its target by about the gap between neighbours' sizes, and no step holds more than a group.
    All randomness is a hash of seed, row, and its number among rows that repeat it; so any number of those is dealt over all groups. Documents without words are taken as any other and count nothing.
    """
    due = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    sizes = _numbered(written_table(sizes))
    per_source = checkpointed(targets(sizes, weights, total, most))
    named = F.when(F.col("source").isNull(), "null").otherwise(F.concat(F.lit("="), F.col("source").cast("string")))
    rows = join_unique(sizes.withColumn("_source", named), per_source.withColumn("_source", named).drop("source"), "_source", "documents", sizes.count())
    rows = rows.withColumn("_due", due).withColumn("copies", F.floor("_due").cast("long")).withColumn("_p", F.col("_due") - F.floor("_due"))
    rows = rows.withColumn("_groups", F.ceil(F.col("documents") / per_group)).withColumn("_u", F.pmod(F.xxhash64("row", "_same", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30))
    kept = ["row", "doc_id", "source", "size", "source_size", "target", "copies"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*kept, "_same", "_p", "_u", "_groups").schema.fields)

    def decide(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "_u", "row", "_same"])
        p = pivotal(pdf["_p"].to_numpy(float), pdf["_u"].to_numpy(float))
        last = pdf["_groups"].iloc[0] <= 1
        if last:
            p = np.where((p > 0) & (p < 1), (pdf["_u"].to_numpy(float) < p).astype(float), p)
        return pdf.assign(_p=np.where(p >= 1, 0.0, p), copies=pdf["copies"] + (p >= 1).astype("int64"))

    decided = []
    todo, level = rows.select(*kept, "_same", "_p", "_u", "_groups"), 0
    while True:
        dealt = todo.withColumn("_group", F.pmod(F.xxhash64("row", "_same", F.lit(seed), F.lit(level)), F.col("_groups")))
        out = checkpointed(dealt.groupBy("source", "_groups", "_group").applyInPandas(lambda pdf: decide(pdf.drop(columns="_group")), schema))
        decided.append(out.filter("_p = 0"))
        todo = out.filter("_p > 0").withColumn("_groups", F.ceil(F.col("_groups") / per_group))
        level += 1
        if todo.isEmpty():
            break
    result = decided[0]
    for x in decided[1:]:
        result = result.union(x)
    return result.select(*kept)


def mixed_rows(df: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", **how) -> DataFrame:
    """The rows of df, each as often as the mix takes it; columns as before.

    Rows that repeat both doc_id and text count each, and their copies are given as copies of the one whose columns have the least
    hash.
    """
    marked = df.withColumn("__row", F.concat_ws(":", F.col(doc_id).cast("string"), F.sha2(F.coalesce(F.col(text), F.lit("")), 256)))
    sizes = marked.select(F.col("__row").alias("row"), F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), words(text).alias("size"))
    copies = mix(sizes, **how).groupBy(F.col("row").alias("__row")).agg(F.sum("copies").alias("__copies")).filter("__copies > 0")
    return one_of_each(marked, "__row").join(copies, "__row").withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), "__copies"))).select(*df.columns)
