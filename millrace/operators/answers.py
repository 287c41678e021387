"""What models answer, as columns: labels, entities, slang candidates; evidence spans put in order; candidate n-grams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import DEFAULT, RulePack
from . import analysis

NO_STRINGS = "cast(array() as array<string>)"
#: Entity types that an answer may name, words that are no candidates, what is said where nothing is.
TYPES = ("phone", "wechat", "qq", "telegram", "email", "url", "domain", "ip", "bank_card", "alipay", "crypto_wallet", "tool", "slang", "feature")
COMMON = ("这个", "那个", "可以", "没有", "就是", "因为", "所以", "如果", "我们", "你们", "他们", "一个", "一些", "很多", "不是", "还是", "已经", "然后", "但是", "起来", "什么", "自己", "平台", "用户", "内容", "问题", "回答")
NO_REASON, NO_MEANING = "LLM从上下文中识别出的疑似黑话", "待人工确认"

#: What an entity of each type is evidence of, of any other type; confidence of evidence from rules and from entities.
RISK_OF = {"wechat": "站外导流", "qq": "站外导流", "phone": "联系方式暴露", "url": "外链分发", "domain": "外链分发", "ip": "基础设施暴露", "bank_card": "资金链路", "alipay": "资金链路", "tool": "工具交易", "slang": "黑话风险", "feature": "风险特征"}
OTHER_RISK = "实体线索"
RULE_CONFIDENCE, ENTITY_CONFIDENCE = 0.92, 0.90


def label(answer: Column) -> Column:
    """struct(label, sub_label, confidence) of a classifier's JSON; what is no such JSON gives the default with 0.5."""
    p = F.from_json(answer, "intent_label string, sub_label string, confidence double")
    out = lambda a, b, c: F.struct(a.alias("label"), b.alias("sub_label"), c.alias("confidence"))
    return F.when(p["intent_label"].isNotNull(), out(p["intent_label"], F.coalesce(p["sub_label"], F.lit("")), F.coalesce(p["confidence"], F.lit(0.8)))).otherwise(out(F.lit("作弊"), F.lit("未分类"), F.lit(0.5)))


def entities(answer: Column) -> Column:
    """array of struct(entity_type, entity_value) of an extractor's JSON: tags, tools, links, accounts (unknown types count as wechat)."""
    p = F.from_json(answer, "risk_tags array<string>, tools array<string>, links array<string>, accounts array<struct<type: string, value: string>>")
    of = lambda kind: lambda v: F.struct(F.lit(kind).alias("entity_type"), v.alias("entity_value"))
    account = lambda a: F.struct(F.when(a["type"].isin(*TYPES), a["type"]).otherwise("wechat").alias("entity_type"), F.coalesce(a["value"], F.lit("")).alias("entity_value"))
    none = F.expr("cast(array() as array<struct<entity_type: string, entity_value: string>>)")
    some = lambda c, use: F.coalesce(F.transform(c, use), none)
    return F.concat(some(p["risk_tags"], of("feature")), some(p["tools"], of("tool")), some(p["links"], of("url")), some(p["accounts"], account))


def slang_candidate(answer: Column, text: Column) -> Column:
    """struct(term, suggested_meaning, reason, confidence, evidence) of a candidate, a JSON object or a bare word; null without a term."""
    p = F.from_json(answer, "term string, word string, slang string, value string, suggested_meaning string, meaning string, normalized_meaning string, reason string, confidence string, evidence string")
    first = lambda *names: F.coalesce(*(F.nullif(p[n], F.lit("")) for n in names))
    is_object = F.startswith(F.trim(answer), F.lit("{"))
    term = F.trim(F.when(is_object, first("term", "word", "slang", "value")).otherwise(answer))
    at = F.instr(text, term)
    start = F.greatest(at - 24, F.lit(1))
    near = F.when(at > 0, F.substring(text, start, at + F.length(term) + 24 - start)).otherwise(F.left(text, F.lit(120)))
    confidence = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(p["confidence"].try_cast("double"), F.lit(0.6))))
    only = lambda c: F.when(is_object, c)
    out = F.struct(term.alias("term"), F.coalesce(only(first("suggested_meaning", "meaning", "normalized_meaning")), F.lit(NO_MEANING)).alias("suggested_meaning"), F.coalesce(only(first("reason")), F.lit(NO_REASON)).alias("reason"), F.when(is_object, confidence).otherwise(0.6).alias("confidence"), F.coalesce(only(first("evidence")), near).alias("evidence"))
    return F.when(F.coalesce(term, F.lit("")) != "", out)


def new_slang(candidates: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Candidates (term, ...) of 2 to 16 characters that the dictionary (term) doesn't have, each term once."""
    sized = candidates.filter((F.length("term") >= 2) & (F.length("term") <= 16))
    return sized.join(dictionary.select("term").distinct(), "term", "left_anti").dropDuplicates(["term"])


def merged_evidence(spans: Column) -> Column:
    """Spans (start, end, confidence, text) by start and falling confidence; of those that overlap or touch the last kept the surer stays."""
    order = F.array_sort(spans, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(F.signum(b["confidence"] - a["confidence"])).cast("int"))

    def step(kept: Column, s: Column) -> Column:
        last = F.element_at(kept, -1)
        meets = (F.size(kept) > 0) & (s["start"] <= last["end"]) & (s["end"] >= last["start"])
        swap = F.concat(F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0))), F.array(s))
        return F.when(meets & (s["confidence"] > last["confidence"]), swap).when(meets, kept).otherwise(F.concat(kept, F.array(s)))

    return F.aggregate(order, F.slice(order, 1, 0), step)


def valid_evidence(spans: Column, text: Column) -> Column:
    """Spans whose text is in the text, or three fifths of whose words are."""

    def holds(s: Column) -> Column:
        words = F.filter(F.split(s["text"], r"(?U)\s+"), lambda w: w != "")
        found = F.size(F.filter(words, lambda w: F.contains(text, w)))
        return (s["text"] != "") & (F.contains(text, s["text"]) | (found >= F.greatest(F.lit(1.0), F.size(words) * 0.6)))

    return F.filter(spans, holds)


def entity_evidence(found: DataFrame, df: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """(key, ordinal, start, end, text, risk, reason, confidence, method): the surroundings of each entity as evidence.

    found: key, entity_type, entity_value, ordinal, context. A context without the value gives way to `...value...`; without a
    context it is 30 characters to both sides, and an entity that the text does not have is left out. Of spans of a text with the
    same risk and the same first 40 characters the first stays. start and end are -1 for a value that the text does not have.
    """
    value, t = F.col("entity_value"), F.coalesce(F.col("_t"), F.lit(""))
    rows = found.filter(F.coalesce(value, F.lit("")) != "").join(df.select(key, F.col(text).alias("_t")), key)
    risk = F.create_map(*(F.lit(x) for kv in RISK_OF.items() for x in kv))[F.col("entity_type")]
    at, left = F.instr(t, value) - 1, F.greatest(F.instr(t, value) - 30, F.lit(1))
    near = F.when(at >= 0, F.substring(t, left, at + F.length(value) + 31 - left))
    given = F.nullif(F.col("context"), F.lit(""))
    span = F.when(given.isNull(), near).when(F.contains(given, value), given).otherwise(F.concat(F.lit("..."), value, F.lit("...")))
    rows = rows.select(key, "ordinal", at.alias("start"), F.when(at >= 0, at + F.length(value)).otherwise(-1).alias("end"), span.alias("_span"), F.coalesce(risk, F.lit(OTHER_RISK)).alias("risk"), F.concat(F.lit("提取到"), "entity_type", F.lit("实体: "), value).alias("reason"))
    first = Window.partitionBy(key, "risk", F.left("_span", F.lit(40))).orderBy("ordinal")
    kept = rows.filter("_span is not null").withColumn("_n", F.row_number().over(first)).filter("_n = 1")
    stripped = F.regexp_replace("_span", r"(?U)^\s+|\s+$", "")
    return kept.select(key, "ordinal", "start", "end", stripped.alias("text"), "risk", "reason", F.lit(ENTITY_CONFIDENCE).alias("confidence"), F.lit("entity_context").alias("method"))


def composed_evidence(df: DataFrame, found: DataFrame, key: str = "id", text: str = "text", label: str = "label", pack: RulePack = DEFAULT) -> DataFrame:
    """(key, n, start, end, text, risk, confidence, method): all evidence of a text, the surest first, from n = 0.

    Spans of the label's rules and those around entities are merged, checked against the text and put in order; what is gathered
    for a text is its own spans.
    """
    rules = analysis.evidence(df, key, text, label, pack).select(key, F.lit(0).alias("k"), "start", "end", F.col("evidence").alias("text"), "risk", F.lit(RULE_CONFIDENCE).alias("confidence"), F.lit("rule").alias("method"), F.lit(0).alias("ordinal"))
    around = entity_evidence(found, df, key, text).select(key, F.lit(1).alias("k"), F.col("start").cast("long"), F.col("end").cast("long"), "text", "risk", "confidence", "method", F.col("ordinal").cast("int"))
    lists = rules.union(around).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("k", "ordinal", "start", "end", "text", "risk", "confidence", "method"))).alias("_spans"))
    spans = valid_evidence(merged_evidence(F.col("_spans")), F.col("_t"))
    surest = F.array_sort(spans, lambda a, b: F.signum(b["confidence"] - a["confidence"]).cast("int"))
    out = lists.join(df.select(key, F.col(text).alias("_t")), key).select(key, F.posexplode(surest).alias("n", "_s"))
    return out.select(key, "n", *(F.col(f"_s.{c}").alias(c) for c in ("start", "end", "text", "risk", "confidence", "method")))


def candidate_grams(text: Column, tokens: Column | None = None, limit: int | None = 360, few: int = 12, most: int | None = 32) -> Column:
    """Distinct candidates for slang in order: tokens of 2 to 8 characters; if those are few, 2- and 3-grams until there are `most`.

    tokens: the words of the text's first `limit` characters by any tokenizer; without, there are none. None: the whole text, all of them.
    """
    text = F.coalesce(text, F.lit(""))
    head = text if limit is None else F.left(text, F.lit(limit))
    fits = lambda g: (g != "") & ~F.rlike(g, F.lit(r"(?U)^(?:[\W_]+|\d+)$")) & ~g.isin(*COMMON)
    words = F.expr(NO_STRINGS) if tokens is None else F.filter(F.transform(tokens, F.trim), lambda t: (F.length(t) >= 2) & (F.length(t) <= 8) & fits(t))
    n = F.length(head)
    places = F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.expr("cast(array() as array<int>)"))

    def grams_of(two: Column, three: Column) -> Column:
        return F.filter(F.array_compact(F.array(F.trim(two), F.trim(three))), fits)

    if most is None:  # letters one by one, as substring() would count from the beginning each time
        letters = F.split(head, "")
        rest = F.transform(places, lambda i: F.struct(F.get(letters, i - 1).alias("a"), F.get(letters, i).alias("b"), F.get(letters, i + 1).alias("c")))
        grams = F.concat(words, F.flatten(F.transform(rest, lambda x: grams_of(F.concat(x["a"], x["b"]), F.concat(x["a"], x["b"], x["c"])))))
    else:
        at = lambda i: grams_of(F.substring(head, i, F.lit(2)), F.when(i + 2 <= n, F.substring(head, i, F.lit(3))))
        grams = F.aggregate(places, words, lambda got, i: F.when(F.size(got) >= most, got).otherwise(F.concat(got, at(i))))
    return F.array_distinct(F.when(F.size(words) < few, grams).otherwise(words))
