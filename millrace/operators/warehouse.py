"""Keyed changes of tables: upserts, replacements, versions, status, annotations. Each returns the new table; nothing is collected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def replace_by_key(base: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """base without the keys of new, and new."""
    return base.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def upsert(base: DataFrame, new: DataFrame, keys: list[str], columns: list[str] | None = None, fixed: tuple[str, ...] = ()) -> DataFrame:
    """base with new's rows: of known keys the non-null values of `columns` (all others if None, never those in fixed)."""
    columns = [c for c in (columns or base.columns) if c not in keys and c not in fixed]
    renamed = new.select(*keys, *(F.col(c).alias(f"_{c}") for c in base.columns if c not in keys), F.lit(True).alias("_new"))
    joined = base.withColumn("_old", F.lit(True)).join(renamed, keys, "full")
    pick = lambda c: F.when(F.col("_old").isNull(), F.col(f"_{c}")).otherwise(F.coalesce(f"_{c}", c) if c in columns else F.col(c))
    return joined.select(*(F.col(c) if c in keys else pick(c).alias(c) for c in base.columns))


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the order given."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def versioned(df: DataFrame, key: str, *order: str) -> DataFrame:
    """df with version, from 1 in the order given, and is_latest."""
    up = Window.partitionBy(key).orderBy(*order)
    down = Window.partitionBy(key).orderBy(*(F.desc(c) for c in order))
    return df.withColumns({"version": F.row_number().over(up), "is_latest": (F.row_number().over(down) == 1).cast("int")})


def merge_maps(base: Column, new: Column, allowed: str = "^[A-Za-z0-9_]+$") -> Column:
    """base with the entries of new whose keys are allowed; new wins."""
    kept = F.map_filter(new, lambda k, v: F.rlike(k, F.lit(allowed)))
    return F.map_concat(F.map_filter(base, lambda k, v: ~F.array_contains(F.map_keys(kept), k)), kept)


def status_now(events: DataFrame, key: str, status: str, at: str) -> DataFrame:
    """The last status of each key and when it first and last changed."""
    return events.groupBy(key).agg(F.max_by(status, at).alias(status), F.min(at).alias("started"), F.max(at).alias("changed"))


def apply_annotations(base: DataFrame, log: DataFrame, key: str, field: str) -> DataFrame:
    """base with the last non-empty annotation (target_id, field_name, new_value, annotated_at) of a field in place of its value."""
    mine = log.filter((F.col("field_name") == field) & (F.coalesce("new_value", F.lit("")) != ""))
    last = mine.groupBy("target_id").agg(F.max_by("new_value", F.struct("annotated_at", "annotation_id")).alias("_value"))
    return base.join(last, base[key] == last.target_id, "left").withColumn(field, F.coalesce("_value", field)).drop("target_id", "_value")


def with_changes(base: DataFrame, changes: DataFrame, key: str, allowed: tuple[str, ...]) -> DataFrame:
    """base with the last change (key, field, value, at) of each field in `allowed`; changes of other fields and of unknown keys are dropped.

    Unlike an upsert's, a null value is a change. Of changes at the same time the greatest value stays.
    """
    mine = changes.filter(F.col("field").isin(*allowed))
    last = mine.groupBy(key).agg(*(F.max(F.when(F.col("field") == c, F.struct("at", "value"))).alias(f"_{c}") for c in allowed))
    kinds = {f.name: f.dataType for f in base.schema}
    new = lambda c: F.when(F.col(f"_{c}").isNotNull(), F.col(f"_{c}.value").cast(kinds[c])).otherwise(F.col(c)).alias(c)
    return base.join(last, key, "left").select(*(new(c) if c in allowed else F.col(c) for c in base.columns))


def relation_rows(new: DataFrame) -> DataFrame:
    """Rows of the entity relation table: what new (src_entity_id, dst_entity_id, relation_type, ...) leaves out has its default."""
    given = lambda c, kind, default: F.coalesce(F.col(c).cast(kind) if c in new.columns else F.lit(None).cast(kind), F.lit(default).cast(kind)).alias(c)
    return new.select("src_entity_id", "dst_entity_id", "relation_type", given("relation_source", "string", "neo4j_sync"), given("evidence_raw_id", "bigint", None), given("confidence", "double", 1.0))


def by_simhash(clean: DataFrame, raw: DataFrame, simhash: str, limit: int = 5) -> DataFrame:
    """The first `limit` cleaned rows (id, raw_id, simhash, ...) with this hash, with platform and content_raw of their raw row (id, ...)."""
    mine = clean.filter(F.col("simhash") == simhash).orderBy("id").limit(limit)
    return mine.join(raw.select(F.col("id").alias("raw_id"), F.col("platform").alias("source_platform"), "content_raw"), "raw_id", "left")


def recent_simhashes(clean: DataFrame, limit: int = 5000) -> DataFrame:
    """The hashes of the last `limit` cleaned rows that have one, by falling id."""
    return clean.filter(F.coalesce("simhash", F.lit("")) != "").orderBy(F.desc("id")).limit(limit).select("id", "simhash")
