"""Reports of analysed posts: conclusion, evidence, entities by type, advice, training samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let

#: Advice by label and for other labels, as (action, detail, priority).
ADVICE = {
    "直播违规": (("关键词监控", "将相关关键词加入直播平台风险词库", "high"), ("账号监控", "对涉及账号进行持续行为监控", "high")),
    "诈骗": (("诈骗模型更新", "将该样本加入诈骗识别模型训练集", "high"), ("资金链路追踪", "对涉及银行账号/支付账号进行关联排查", "critical")),
    "引流": (("渠道封堵", "对引流微信/QQ号进行标记和举报", "high"), ("域名监控", "将引流域名加入黑名单", "medium")),
    "作弊": (("行为特征入库", "提取作弊行为特征，更新风控规则", "high"), ("设备指纹", "关联作弊工具的设备指纹信息", "medium")),
    "账号黑产": (("批量账号识别", "对同批次注册账号进行回溯排查", "critical"), ("实名验证加强", "针对可疑注册模式加强实名验证", "high")),
    "工具交易": (("工具溯源", "对交易工具进行技术分析和特征提取", "high"), ("卖家追踪", "通过支付信息追踪工具卖家", "medium")),
    "内容违规": (("内容清除", "对违规内容进行下架处理", "high"), ("发布者处置", "对发布者账号进行警告或封禁", "medium")),
}
DEFAULT_ADVICE = (("持续监控", "将该情报涉及的实体加入监控清单", "medium"), ("样本积累", "将该情报作为训练样本积累", "low"))
LEVELS = {"high": "高危", "critical": "严重", "normal": "普通", "low": "低"}
#: Entities of a training sample at most, spans and slang terms of a report at most.
SAMPLE_ENTITIES, SPANS, SLANG = 20, 5, 10
_ADVICE_TYPE = "array<struct<action: string, detail: string, priority: string>>"


def entities_by_type(entities: DataFrame, key: str = "raw_id") -> DataFrame:
    """(key, entity_type, values): distinct values in the order in which they first occur."""
    first = entities.groupBy(key, "entity_type", "entity_value").agg(F.min("ordinal").alias("o"))
    return first.groupBy(key, "entity_type").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "entity_value"))), lambda x: x["entity_value"]).alias("values"))


def _item(action: Column, detail: Column, priority: str) -> Column:
    return F.struct(action.alias("action"), detail.alias("detail"), F.lit(priority).alias("priority"))


def advice(label: Column, entities: Column, gang: Column, case_id: Column) -> Column:
    """The label's advice, one item for each distinct wechat or url entity in order, one for a gang: (action, detail, priority)."""
    items = lambda xs: F.array(*(_item(F.lit(a), F.lit(d), p) for a, d, p in xs))
    known = F.create_map(*(x for k, v in ADVICE.items() for x in (F.lit(k), items(v))))
    mine = F.filter(F.coalesce(entities, F.expr("cast(array() as array<struct<type: string, value: string>>)")), lambda e: e["type"].isin("wechat", "url"))
    of = lambda e: F.when(e["type"] == "wechat", _item(F.concat(F.lit("微信号标记: "), e["value"]), F.lit("将微信号加入高风险账号库，查询历史关联"), "high")).otherwise(_item(F.concat(F.lit("URL黑名单: "), F.left(e["value"], F.lit(60))), F.lit("将链接加入URL风险库，阻断访问"), "critical"))
    more = F.transform(F.array_distinct(mine), of)
    wider = F.array(_item(F.lit("团伙扩线"), F.concat(F.lit("该实体已关联案件 "), F.coalesce(case_id, F.lit("")), F.lit("，建议对案件中所有实体进行扩线排查")), "critical"))
    return F.concat(F.coalesce(known[label], items(DEFAULT_ADVICE)), more, F.when(gang, wider).otherwise(F.expr(f"cast(array() as {_ADVICE_TYPE})")))


def two_decimals(score: Column) -> Column:
    """A score from 0 to 1 with two decimals, rounded as the nearest double of it is, which the formatting of most languages does.

    The double's bits times 100 fit into a long, so what lies below the second decimal is compared exactly. Scores under 2^-9 are 0.00.
    """
    x = score.cast("double")
    shift = (53 + F.least(F.lit(9), F.greatest(F.lit(0), F.floor(-F.log2(x))))).cast("int")
    one = F.lit(1).cast("long")
    return F.when(x < 2.0**-9, "0.00").otherwise(
        let(shift, lambda k: let((x * F.pow(F.lit(2.0), k)).cast("long") * 100, lambda bits: let(F.call_function("shiftright", bits, k), lambda whole: let(bits - F.call_function("shiftleft", whole, k), lambda rest: let(whole + F.when((rest > F.call_function("shiftleft", one, k - 1)) | ((rest == F.call_function("shiftleft", one, k - 1)) & (whole % 2 == 1)), 1).otherwise(0), lambda n: F.format_string("%d.%02d", F.floor(n / 100), n % 100))))))
    )


def report(posts: DataFrame, entities: DataFrame, evidence: DataFrame, slang: DataFrame | None = None, cases: DataFrame | None = None) -> DataFrame:
    """A report for each of posts (raw_id, label, sub_label, risk_score, risk_level).

    (raw_id, title, conclusion, evidence, entities, slang_terms, gang_detected, graph_summary, disposal_advice): the first SPANS
    spans in text order, entities (type, values) in the order of their first occurrence, the first SLANG of slang (raw_id, term,
    meaning, risk_category), the case that cases (raw_id, case_id, related) gives, if any. A report has a row for each post; what
    it holds of a post's evidence and entities is as much as the post has.
    """
    spans = evidence.groupBy("raw_id").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("start", "evidence", "risk"))), lambda x: F.struct(x["evidence"].alias("fragment"), x["risk"].alias("risk_dimension"))), 1, SPANS).alias("evidence"))
    ordered = entities.groupBy("raw_id").agg(F.array_sort(F.collect_list(F.struct("ordinal" if "ordinal" in entities.columns else "entity_value", F.col("entity_type").alias("type"), F.col("entity_value").alias("value")))).alias("_o"))
    listed = ordered.select("raw_id", F.transform("_o", lambda x: F.struct(x["type"].alias("type"), x["value"].alias("value"))).alias("_e"))
    out = posts.join(spans, "raw_id", "left").join(listed, "raw_id", "left")
    spark = posts.sparkSession
    slang = spark.createDataFrame([], "raw_id long, term string, meaning string, risk_category string") if slang is None else slang
    cases = spark.createDataFrame([], "raw_id long, case_id string, related long") if cases is None else cases
    terms = slang.groupBy("raw_id").agg(F.slice(F.array_sort(F.collect_set(F.struct("term", "meaning", "risk_category"))), 1, SLANG).alias("slang_terms"))
    out = out.join(terms, "raw_id", "left").join(cases.select("raw_id", "case_id", F.col("related").alias("_related")), "raw_id", "left")
    gang = F.col("case_id").isNotNull()
    level = F.coalesce(F.create_map(*(F.lit(x) for kv in LEVELS.items() for x in kv))[F.col("risk_level")], F.col("risk_level"))
    sub = F.when(F.coalesce("sub_label", F.lit("")) != "", F.concat(F.lit("（"), "sub_label", F.lit("）"))).otherwise("")
    conclusion = F.concat(F.lit("该情报经系统研判，判定为「"), "label", F.lit("」类黑灰产信息"), sub, F.lit("，风险等级为 "), level, F.lit("（评分 "), two_decimals(F.col("risk_score")), F.lit("）。"))
    linked = F.concat(F.lit("该情报涉及实体与 "), F.col("_related").cast("string"), F.lit(" 个历史实体存在关联，已归入案件 "), F.col("case_id"))
    types = F.array_distinct(F.transform("_e", lambda e: e["type"]))
    grouped = F.transform(types, lambda t: F.struct(t.alias("type"), F.array_distinct(F.transform(F.filter("_e", lambda e: e["type"] == t), lambda e: e["value"])).alias("values")))
    return out.select(
        "raw_id", F.concat(F.lit("风险研判报告 — "), "label").alias("title"), conclusion.alias("conclusion"), F.coalesce("evidence", F.expr("cast(array() as array<struct<fragment: string, risk_dimension: string>>)")).alias("evidence"),
        F.coalesce(grouped, F.expr("cast(array() as array<struct<type: string, values: array<string>>>)")).alias("entities"), F.coalesce("slang_terms", F.expr("cast(array() as array<struct<term: string, meaning: string, risk_category: string>>)")).alias("slang_terms"),
        gang.alias("gang_detected"), F.when(gang, linked).otherwise("未发现与历史情报的直接关联。该情报涉及的实体均为首次出现。").alias("graph_summary"), advice(F.col("label"), F.col("_e"), gang, F.col("case_id")).alias("disposal_advice"),
    )


def report_samples(posts: DataFrame, entities: DataFrame, evidence: DataFrame) -> DataFrame:
    """A training sample for each of posts (raw_id, text, label, sub_label): text, labels, what was found, in short."""
    found = entities.groupBy("raw_id").agg(F.slice(F.array_sort(F.collect_set(F.struct(F.col("entity_type").alias("type"), F.col("entity_value").alias("value")))), 1, SAMPLE_ENTITIES).alias("entities"), F.max(F.col("entity_type").isin("wechat", "qq", "phone")).alias("has_contact_entity"), F.max(F.col("entity_type") == "url").alias("has_url"))
    spans = evidence.groupBy("raw_id").agg(F.count(F.lit(1)).alias("evidence_count"))
    out = posts.join(found, "raw_id", "left").join(spans, "raw_id", "left")
    none = F.expr("cast(array() as array<struct<type: string, value: string>>)")
    return out.select("raw_id", F.coalesce("text", F.lit("")).alias("text"), F.concat_ws("_", F.coalesce("label", F.lit("")), F.coalesce("sub_label", F.lit(""))).alias("label"), F.col("label").alias("risk_label"), F.col("sub_label").alias("risk_sub_label"), F.coalesce("entities", none).alias("entities"), F.coalesce("evidence_count", F.lit(0)).alias("evidence_count"), F.coalesce("has_contact_entity", F.lit(False)).alias("has_contact_entity"), F.coalesce("has_url", F.lit(False)).alias("has_url"), F.lit("bgi_analysis").alias("source"))


def training_samples(posts: DataFrame, least: float = 0.85) -> DataFrame:
    """(text, label, source) of posts that are sure enough to teach."""
    return posts.filter((F.col("confidence") >= least) & F.col("label").isNotNull() & (F.coalesce("text", F.lit("")) != "")).select("text", "label", F.lit("rule").alias("source"))


def throughput(df: DataFrame, by: str, at: str, failed: Column | None = None) -> DataFrame:
    """(by, items, errors, elapsed_sec, items_per_sec): what each source brought over the whole time from the first row to the last.

    failed marks rows that are errors and no items. Without any time passed, nothing a second.
    """
    bad = F.lit(False) if failed is None else F.coalesce(failed, F.lit(False))
    t = F.col(at).cast("timestamp").cast("double")
    parts = df.groupBy(by).agg(F.count_if(~bad).alias("items"), F.count_if(bad).alias("errors"), F.min(t).alias("_a"), F.max(t).alias("_b"))
    span = parts.agg((F.max("_b") - F.min("_a")).alias("_span"))
    elapsed = F.round("_span", 1)
    return parts.join(F.broadcast(span)).select(by, "items", "errors", elapsed.alias("elapsed_sec"), F.when(F.col("_span") > 0, F.round(F.col("items") / F.col("_span"), 4)).otherwise(0.0).alias("items_per_sec"))
