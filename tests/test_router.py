import datetime

import pytest

from millrace.plans.router import answer, understand


@pytest.mark.parametrize(
    ("text", "intent", "platform", "days"),
    [(None, "labels", None, None), ("帮助", "help", None, None), ("待研判队列还有多少", "queue", None, None), ("上周贴吧哪个风险分类最活跃？", "labels", "tieba", 7), ("最近 30 天热门黑话有哪些？", "hot_slang", None, 30), ("黑话典型样本", "risk_slang_samples", None, None), ("微博实体线索分布", "entities", "weibo", None), ("哪个平台高危情报最多", "platforms", None, None), ("给我 10 条高危典型样本", "high_risk", None, None), ("999天 风险", "labels", None, 365), ("天气", "labels", None, None)],
)
def test_understanding(text, intent, platform, days):
    q = understand(text)
    assert (q.intent, q.platform, q.days) == (intent, platform, days)
    assert q.recognised == (text != "天气")


def test_answers(spark):
    t = lambda d: datetime.datetime(2024, 1, d)
    raw = spark.createDataFrame([(1, "tieba", t(1), "x", "CLEANED"), (2, "weibo", t(20), "y", "RAW_COLLECTED"), (3, "weibo", t(21), "z", "CLEANED")], "id long, platform string, collected_at timestamp, content string, status string")
    latest = spark.createDataFrame([(1, "a", 0.9, "critical"), (2, "b", 0.4, "normal"), (3, "b", 0.7, "high")], "raw_id long, label string, score double, level string")
    entities = spark.createDataFrame([(1, "slang", "s"), (2, "slang", "s"), (2, "phone", "1"), (3, "slang", "t")], "raw_id long, type string, value string")
    ask = lambda q: [tuple(r) for r in answer(spark, q, raw, latest, entities, datetime.date(2024, 1, 21))[1].collect()]
    assert ask("队列") == [("CLEANED", 2), ("RAW_COLLECTED", 1)]
    assert ask("黑话") == [("s", 2, 1), ("t", 1, 3)]
    assert ask("最近7天实体") == [("slang", 2, 2), ("phone", 1, 1)]
    assert ask("哪个平台高危最多") == [("weibo", 2, 0.55, 1), ("tieba", 1, 0.9, 1)]
    assert [r[0] for r in ask("高危样本")] == [1, 3, 2]
    assert ask("微博风险分布") == [("b", 2, 0.55, 1)]
    assert {r[0] for r in ask("最近1天贴吧黑话样本")} == {"risk", "slang", "sample"}
    assert len(ask("帮助")) == 5
