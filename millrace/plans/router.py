"""Questions in plain language, each answered by one of a few fixed queries."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: platforms' names, and the words that tell an intent, in the order in which they are tried.
PLATFORMS = {"tieba": ("tieba", "贴吧"), "weibo": ("weibo", "微博"), "zhihu": ("zhihu", "知乎"), "douyin": ("douyin", "抖音"), "xiaohongshu": ("xiaohongshu", "小红书"), "xianyu": ("xianyu", "闲鱼"), "qq_group": ("qq", "qq群")}
HELP = ("帮助", "示例", "能问", "可以问")
INTENTS = (
    ("queue", ("待研判", "队列", "进度", "处理状态", "失败")),
    ("hot_slang", ("黑话", "暗语", "术语")),
    ("entities", ("实体", "线索", "账号", "联系方式", "链接")),
    ("platforms", ("平台", "来源", "渠道")),
    ("high_risk", ("高危", "严重", "典型", "样本", "例句", "案例", "top")),
    ("labels", ("风险", "分类", "类型", "活跃", "最多", "分布", "态势")),
)
SLANG_AND = ("风险", "分类", "活跃", "例句", "样本", "典型")


@dataclass(frozen=True)
class Question:
    intent: str
    platform: str | None
    days: int | None
    high: bool
    recognised: bool = True


def understand(question: str | None) -> Question:
    q = (question or "").strip() or "当前风险类型分布"
    low = q.lower()
    platform = next((p for p, names in PLATFORMS.items() if any(n in low for n in names)), None)
    m = re.search(r"(\d{1,3})\s*[天日]", low)
    days = max(1, min(int(m[1]), 365)) if m else 7 if any(x in low for x in ("上周", "最近一周", "近一周")) else 30 if any(x in low for x in ("本月", "最近一月", "近一月")) else None
    high = any(x in q for x in ("高危", "严重"))
    if any(x in q for x in HELP):
        return Question("help", platform, days, high)
    if "黑话" in q and any(x in q for x in SLANG_AND) and not any(x in q for x in INTENTS[0][1]):
        return Question("risk_slang_samples", platform, days, high)
    for intent, words in INTENTS:
        if any(x in q for x in words):
            return Question(intent, platform, days, high)
    return Question("labels", platform, days, high, recognised=False)


def answer(spark: SparkSession, question: str | None, raw: DataFrame, latest: DataFrame, entities: DataFrame, as_of) -> tuple[Question, DataFrame]:
    """The question as understood and the rows that answer it.

    raw: id, platform, collected_at, content, status; latest: raw_id, label, score, level; entities: raw_id, type, value. as_of: the
    date that the last days end with. A window without rows is widened to all time for risk_slang_samples.
    """
    asked = understand(question)
    rows = raw
    if asked.platform:
        rows = rows.filter(F.col("platform") == asked.platform)
    if asked.days:
        rows = rows.filter(F.col("collected_at") >= F.date_sub(F.lit(as_of), asked.days))
    judged = lambda r: r.join(latest, r.id == latest.raw_id)
    high = F.col("level").isin("high", "critical")
    stats = (F.count(F.lit(1)).alias("cnt"), F.round(F.avg("score"), 4).alias("avg_score"), F.count_if(high).alias("high_cnt"))
    if asked.intent == "help":
        return asked, spark.createDataFrame([(x,) for x in ("上周贴吧哪个风险分类最活跃？", "哪个平台高危情报最多？", "最近 30 天热门黑话有哪些？", "给我 10 条高危典型样本。", "当前待研判队列还有多少？")], "example string")
    if asked.intent == "queue":
        return asked, rows.groupBy("status").agg(F.count(F.lit(1)).alias("cnt")).orderBy(F.desc("cnt"), "status")
    if asked.intent == "hot_slang":
        return asked, rows.join(entities.filter("type = 'slang'"), rows.id == entities.raw_id).groupBy("value").agg(F.count(F.lit(1)).alias("cnt"), F.min("raw_id").alias("first_id")).orderBy(F.desc("cnt"), "value").limit(15)
    if asked.intent == "entities":
        return asked, rows.join(entities, rows.id == entities.raw_id).groupBy("type").agg(F.count(F.lit(1)).alias("cnt"), F.count_distinct("value").alias("distinct_values")).orderBy(F.desc("cnt"), "type").limit(15)
    if asked.intent == "platforms":
        order = [F.desc("high_cnt"), F.desc("cnt")] if asked.high else [F.desc("cnt")]
        return asked, judged(rows).groupBy("platform").agg(*stats).orderBy(*order, "platform").limit(12)
    if asked.intent == "high_risk":
        rank = F.when(F.col("level") == "critical", 4).when(F.col("level") == "high", 3).otherwise(1)
        return asked, judged(rows).orderBy(rank.desc(), F.desc("score"), F.desc("id")).select("id", "platform", "label", "level", "score").limit(10)
    by_label = lambda r: judged(r).groupBy("label").agg(*stats).orderBy(F.desc("cnt"), "label")
    if asked.intent == "risk_slang_samples":
        rows = rows if not judged(rows).isEmpty() else raw
        slang = rows.join(entities.filter("type = 'slang'"), rows.id == entities.raw_id).groupBy("value").agg(F.count(F.lit(1)).alias("cnt")).orderBy(F.desc("cnt"), "value").limit(5)
        some = judged(rows).orderBy(F.desc("score"), "id").limit(3).select(F.lit("sample").alias("kind"), F.col("id").cast("string").alias("name"), F.lit(1).cast("bigint").alias("cnt"))
        return asked, by_label(rows).limit(5).select(F.lit("risk").alias("kind"), F.col("label").alias("name"), "cnt").unionByName(slang.select(F.lit("slang").alias("kind"), F.col("value").alias("name"), "cnt")).unionByName(some)
    return asked, by_label(rows).limit(12)
