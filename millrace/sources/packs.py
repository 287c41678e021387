"""Rule packs from files: categories with their patterns, keywords, variants and combinations."""

from __future__ import annotations

import json
from dataclasses import replace

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from ..functions.rules import DEFAULT, Category, RulePack

REPORT = "category string, rule string, problem string"


def _parsed(path: str, text: str):
    if path.endswith((".yaml", ".yml")):
        import yaml  # where it is installed

        return yaml.safe_load(text)
    return json.loads(text)


def _problem(spark: SparkSession, pattern: str) -> str | None:
    """What the engine that will run a pattern says against it."""
    try:
        spark._jvm.java.util.regex.Pattern.compile(f"(?d){pattern}")
    except (PySparkException, Py4JJavaError) as bad:
        return str(bad).strip().split("\n")[0]
    return None


def rule_pack(spark: SparkSession, path: str, base: RulePack = DEFAULT) -> tuple[RulePack, DataFrame]:
    """base with the categories of a file, and a report (category, rule, problem) of what is left out.

    The file is a JSON object (or YAML, where its reader is installed) of categories, in their order, each an object with lists
    `regex`, `keywords`, `variants` and `combos` (lists of words that must all occur). A pattern that the engine can't compile, a rule that is no text or is
    empty and a category that is no object are left out and reported; if nothing is left, or the file can't be read, base stays
    as it is. Every read sees the file as it is then.
    """
    report: list[tuple[str | None, str | None, str]] = []
    try:
        rows = spark.read.text(path, wholetext=True).collect()  # a file of rules
        data = _parsed(path, "\n".join(r.value for r in rows))
    except Exception as bad:  # whatever the file is: the rules that are known stay in force
        return base, spark.createDataFrame([(None, None, f"not read: {str(bad).splitlines()[0][:200]}")], REPORT)
    categories = []
    for name, rules in data.items() if isinstance(data, dict) else ():
        if not isinstance(rules, dict):
            report.append((str(name), None, "no object"))
            continue

        def texts(kind: str, name=name, rules=rules) -> list[str]:
            out = []
            for rule in rules.get(kind) or []:
                if isinstance(rule, str) and rule:
                    out.append(rule)
                else:
                    report.append((name, json.dumps(rule, ensure_ascii=False), f"no text in {kind}"))
            return out

        patterns = []
        for pattern in texts("regex"):
            problem = _problem(spark, pattern)
            if problem is None:
                patterns.append(pattern)
            else:
                report.append((name, pattern, problem))
        combos = []
        for words in rules.get("combos") or []:
            if isinstance(words, list) and words and all(isinstance(w, str) and w for w in words):
                combos.append(tuple(words))
            else:
                report.append((name, json.dumps(words, ensure_ascii=False), "no texts in combos"))
        category = Category(str(name), tuple(patterns), tuple(texts("keywords")), tuple(texts("variants")), tuple(combos))
        if category != Category(category.label):
            categories.append(category)
    if not categories:
        report.append((None, None, "no rules"))
    return (replace(base, categories=tuple(categories)) if categories else base), spark.createDataFrame(report, REPORT)
