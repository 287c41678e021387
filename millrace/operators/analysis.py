"""Classification by rules, entities, evidence, risk scores and screening."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.rules import DEFAULT, ENTITIES, ENTITY_SIEVES, ENTITY_STARTS, EXPANDABLE, RulePack, category_rules, needed_words
from . import dictionary


def classify(c: Column, pack: RulePack = DEFAULT) -> Column:
    """struct(label, sub_label, confidence, method) of the first rule, in order, that finds something; else the degraded default.

    Rules of a category are only tried on texts with a word that one of them needs, and a pattern on those with a word of its own, so
    most texts pay for few scans of each category, not for 140 patterns. Where no such words are told, one alternation of all stands for them.
    """

    def found(x) -> Column:
        if isinstance(x, str):
            needs, finds = needed_words(x), F.rlike(c, F.lit("(?d)" + x))
            return T.contains_any(c, needs) & finds if needs else finds
        return T.fold(F.lit(True), x, lambda b, w: b & F.contains(c, F.lit(w)))

    answer = lambda label, sub, conf, how: F.struct(F.lit(label).alias("label"), F.lit(sub).alias("sub_label"), F.lit(conf).cast("decimal(4,2)").alias("confidence"), F.lit(how).alias("method"))
    by_label: dict = {}
    for label, sub, rule in category_rules(pack):
        by_label.setdefault(label, []).append((sub, rule))
    out = []
    for label, rules in by_label.items():
        any_of = "(?d)" + "|".join(r if isinstance(r, str) else T.quote(r[0]) for _, r in rules)
        first = None
        for sub, rule in rules:
            a = answer(label, sub, "0.95", "keyword")
            first = F.when(found(rule), a) if first is None else first.when(found(rule), a)
        needs = [needed_words(r) if isinstance(r, str) else r[:1] for _, r in rules]
        some = T.contains_any(c, tuple(dict.fromkeys(w for ws in needs for w in ws))) if all(needs) else F.rlike(c, F.lit(any_of))
        out.append(F.when(some, first))
    return F.coalesce(*out, answer("作弊", "未分类", "0.30", "degraded"))


def cascade(df: DataFrame, text: str, model: Callable[[pd.Series], pd.DataFrame] | None = None, threshold: float = 0.7, pack: RulePack = DEFAULT) -> DataFrame:
    """df with the columns of classify(); rows that no rule labels go, and only they, to a model.

    model: a function from texts to a frame with label and confidence, run on Arrow batches; below threshold its answer is not used.
    """
    ruled = df.withColumn("_c", classify(F.col(text), pack)).select("*", "_c.*").drop("_c")
    if model is None:
        return ruled
    open_rows, done = ruled.filter("method = 'degraded'"), ruled.filter("method <> 'degraded'")

    @F.pandas_udf("label string, confidence double")
    def guess(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield model(texts)[["label", "confidence"]]

    told = open_rows.withColumn("_g", guess(F.col(text)))
    sure = F.col("_g.confidence") >= threshold
    told = told.withColumns({"label": F.when(sure, F.col("_g.label")).otherwise(F.col("label")), "sub_label": F.when(sure, F.col("_g.label")).otherwise(F.col("sub_label")), "confidence": F.when(sure, F.col("_g.confidence").cast("decimal(4,2)")).otherwise(F.col("confidence")), "method": F.when(sure, "model").otherwise(F.col("method"))})
    return done.unionByName(told.drop("_g"))


def entities(df: DataFrame, key: str = "id", text: str = "text", types=ENTITIES) -> DataFrame:
    """(key, entity_type, entity_value, ordinal, context): every match of every pattern, types in their order.

    A pattern of ENTITIES is only tried on texts that pass its sieve.
    """

    def of(kind: str, pattern: str, group: int) -> Column:
        begins, sieve = ENTITY_STARTS.get(pattern, ""), ENTITY_SIEVES.get(pattern)
        values = F.regexp_extract_all(F.col(text), F.lit(f"({begins}{pattern})" if group == 0 else pattern), F.lit(1))
        if sieve:
            passes = F.rlike(F.col(text), F.lit(sieve)) if isinstance(sieve, str) else T.contains_any(F.col(text), sieve)
            values = F.when(passes, values).otherwise(F.expr("cast(array() as array<string>)"))
        return F.transform(values, lambda v: F.struct(F.lit(kind).alias("entity_type"), F.trim(v).alias("entity_value")))

    found = [of(*t) for t in types]
    rows = df.select(key, F.col(text).alias("_text"), F.posexplode(F.concat(*found)).alias("ordinal", "_e"))
    return rows.select(key, "_e.entity_type", "_e.entity_value", "ordinal", T.context(F.col("_text"), F.col("_e.entity_value")).alias("context"))


def dictionary_entities(df: DataFrame, terms: DataFrame, key: str = "id", text: str = "text", **how) -> DataFrame:
    """(key, term, meaning) for the dictionary's terms that occur in a text, by dictionary.occurrences()."""
    return dictionary.occurrences(df, terms, key, text, **how)


def slang_meanings(df: DataFrame, terms: DataFrame, key: str = "id", text: str = "text", label: str = "label") -> DataFrame:
    """(key, term, meaning, risk_category): the dictionary's terms (term, meaning) in a text, each once, under the text's label.

    A term without a meaning has the characters around it instead.
    """
    found = dictionary_entities(df, terms, key, text).distinct().join(df.select(key, F.col(text).alias("_t"), F.col(label).alias("risk_category")), key)
    return found.select(key, "term", F.coalesce(F.nullif(F.col("meaning"), F.lit("")), T.context(F.col("_t"), F.col("term"))).alias("meaning"), "risk_category")


def first_entities(df: DataFrame, key: str = "id") -> DataFrame:
    """Of a text's entities with the same type and value the first."""
    w = Window.partitionBy(key, "entity_type", "entity_value").orderBy("ordinal")
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def evidence(df: DataFrame, key: str = "id", text: str = "text", label: str = "label", pack: RulePack = DEFAULT) -> DataFrame:
    """(key, start, end, evidence, risk): matches of the label's patterns (all patterns for another label).

    Patterns go in their order; a match that overlaps or touches one already kept is dropped. Offsets of all matches are what no
    built-in function gives, so this runs on Arrow batches.
    """
    import re

    by_label = {k: [(re.compile(p), k, needed_words(p)) for p in ps] for k, ps in pack.evidence}
    everything = [x for ps in by_label.values() for x in ps]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, t, lab in zip(pdf[key], pdf["_t"], pdf["_l"], strict=True):
                kept: list[tuple[int, int]] = []
                for pattern, risk, needs in by_label.get(lab, everything):
                    if needs and not any(w in (t or "") for w in needs):
                        continue
                    for m in pattern.finditer(t or ""):
                        a, b = m.span()
                        if not any(a <= y and b >= x for x, y in kept):
                            kept.append((a, b))
                            out.append((k, a, b, m.group(0), risk))
            yield pd.DataFrame(out, columns=[key, "start", "end", "evidence", "risk"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, F.col(text).alias("_t"), F.col(label).alias("_l")).mapInPandas(run, f"{key} {kind}, start long, end long, evidence string, risk string")


def risk_score(df: DataFrame) -> DataFrame:
    """df with base, contact, link, tool, slang, graph, risk_score (decimals) and risk_level.

    df: label, confidence, contacts, links, tools, slang (counts), related (accounts of the gang, 0 without).
    """
    d = lambda x, s=4: x.cast(f"decimal(18,{s})")
    one = F.lit(1).cast("decimal(18,4)")
    conf = d(F.col("confidence"))
    boosted = F.when(F.col("label").isin("诈骗", "账号黑产"), F.least(one, d(conf * F.lit("1.1").cast("decimal(3,1)"), 8))).otherwise(d(conf, 8))
    part = lambda count, each, weight: F.round(F.least(one, d(F.col(count) * F.lit(each).cast("decimal(4,2)"))) * F.lit(weight).cast("decimal(4,2)"), 4)
    out = df.withColumns({"base": F.round(boosted * F.lit("0.50").cast("decimal(4,2)"), 4), "contact": part("contacts", "0.30", "0.15"), "link": part("links", "0.35", "0.12"), "tool": part("tools", "0.50", "0.08"), "slang_part": part("slang", "0.25", "0.10"), "graph": part("related", "0.20", "0.05")})
    total = F.least(one, d(F.col("base") + F.col("contact") + F.col("link") + F.col("tool") + F.col("slang_part") + F.col("graph")))
    return out.withColumn("risk_score", d(total)).withColumn("risk_level", risk_level(F.col("risk_score")))


def risk_level(score: Column) -> Column:
    return F.when(score >= 0.85, "critical").when(score >= 0.65, "high").when(score >= 0.35, "normal").otherwise("low")


def screen(df: DataFrame, low: float = 0.2, standard: float = 0.45, graph: float = 0.55, confirm: float = 0.72) -> DataFrame:
    """df (risk_score, risk_level, confidence, method, entity_types array, candidates, evidence counts) with decision."""
    d = lambda x: F.lit(str(x)).cast("decimal(6,4)")
    s, high = F.col("risk_score"), F.col("risk_level").isin("high", "critical")
    expandable = F.arrays_overlap("entity_types", F.array(*map(F.lit, EXPANDABLE)))
    clue = F.col("evidence") > 0
    return df.withColumn(
        "decision",
        F.when(expandable & ((s >= d(graph)) | high), "NEED_GRAPH_ANALYSIS")
        .when(F.col("candidates") > 0, "NEED_STANDARD_ANALYSIS")
        .when((s >= d(confirm)) & (F.col("confidence") >= d(0.85)) & clue & F.col("method").isin("keyword", "regex", "degraded"), "CONFIRMED_RISK")
        .when((s >= d(standard)) | high | ((s >= d(low)) & (expandable | clue)), "NEED_STANDARD_ANALYSIS")
        .when((s < d(low)) & ~expandable & ~clue, "LOW_RISK_ARCHIVED")
        .otherwise("SCREENED_REVIEW"),
    )


def field_sets(df: DataFrame, key: str, *fields: str) -> DataFrame:
    """A row for each key with the sorted distinct values of each field, without nulls and empty strings; arrays count by their elements."""
    kinds = dict(df.dtypes)
    values = lambda f: F.col(f).cast("array<string>") if kinds[f].startswith("array") else F.array(F.col(f).cast("string"))
    tagged = lambda f: F.transform(F.coalesce(values(f), F.array(F.lit(None).cast("string"))), lambda v: F.struct(F.lit(f).alias("f"), v.alias("v")))
    # fields one below the other, so that the elements of several arrays are never multiplied
    long = df.select(key, F.explode_outer(F.concat(*(tagged(f) for f in fields))).alias("_x")).select(key, "_x.f", "_x.v").distinct()
    return long.groupBy(key).agg(*(F.array_sort(F.collect_list(F.when(F.col("f") == f, F.nullif("v", F.lit(""))))).alias(f) for f in fields))
