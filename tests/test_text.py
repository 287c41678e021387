"""Values that must be exact, on short fixtures."""

import pytest
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import analysis, cleaning


def values(spark, use, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    return [r.v for r in df.select("i", use(F.col("text")).alias("v")).orderBy("i").collect()]


def test_defang(spark):
    assert values(spark, T.defang_url, ["http://evil.com/path", "https://bad.org", "ftp://files.example.com"]) == ["hxxp[://]evil[.]com/path", "hxxp[://]bad[.]org", "fxp[://]files[.]example[.]com"]
    assert values(spark, T.defang_ip, ["192.168.1.1"]) == ["192[.]168[.]1[.]1"]
    assert values(spark, T.defang_email, ["user@sub.example.org"]) == ["user@sub[.]example[.]org"]
    assert values(spark, T.refang, ["hxxp[://]evil[.]com"]) == ["http://evil.com"]
    assert values(spark, T.defang_text, ["Visit http://bad.com or ping 10.0.0.1", "mail a@b.co, see https://x.y/z?q=1.2.3.4", "", None]) == ["Visit hxxp[://]bad[.]com or ping 10[.]0[.]0[.]1", "mail a@b[.]co, see hxxp[://]x[.]y/z?q=1[.]2[.]3[.]4", "", None]


def test_simhash(spark):
    texts = ["刷单平台接码服务 联系wx abc123", "hello world hello", "！！", "短"]
    assert values(spark, lambda c: T.simhash_hex(T.simhash64(c)), texts) == ["0x5d86983ff693ebde", "0x5d41402abc4b2a76", "0xd7a1ea0d4372282d", "0xb58b94d8073cc245"]


def test_normalisation(spark):
    assert values(spark, T.apply_common, ["<p>Ａ　b&amp;c</p>\\u4f60 见http://www.x.com/y?z 完", "&lt;b&gt;t"]) == ["A b&c 你 见[链接:x.com] 完", "t"]
    assert values(spark, T.normalize, ["a​<i>b</i>&nbsp;c\\u0041"]) == ["a b cA"]
    assert values(spark, lambda c: T.truncate_bytes(c, 7), ["日本語", "abc", "a日本語"]) == ["日本", "abc", "a日本"]
    assert values(spark, lambda c: T.strip_boilerplate(c, "weibo"), ["转发微博#话题#内容"]) == [" [话题:话题]内容"]
    assert values(spark, lambda c: T.strip_boilerplate(c, "douyin"), ["x #a #b #c #d #e #f"]) == ["x [话题:a] [话题:b] [话题:c]   "]
    assert values(spark, T.emoji_density, ["\U0001f600\U0001f600ab", "", "ab"]) == pytest.approx([0.5, 0, 0])


def test_noise_and_priority(spark):
    assert [float(x) for x in values(spark, cleaning.noise_score, ["", "   ", "接码", "啊啊啊啊啊啊啊"])] == [1.0, 1.0, 0.1, 0.5]
    assert values(spark, cleaning.priority, ["出售实名银行卡四件套", "代理IP", "今天天气"]) == ["high", "normal", "normal"]
    assert values(spark, cleaning.low_value, ["???", "ab", "aaaaaaaaaaaa", "正常的内容"]) == ["无中文字符且过短", "无中文字符且过短", "单字符重复刷屏", None]
    assert values(spark, cleaning.ad_noise, ["免费领取大奖", "免费领取接码服务", "公交上车免费领取"]) == ["免费领取", None, None]


def test_classifier(spark):
    texts = ["出抖音千粉号 可开播", "刷播放量 包上热门", "代办贷款 无抵押 黑户可做", "菠菜平台 真人视讯 百家乐", "今天天气真好"]
    out = values(spark, analysis.classify, texts)
    assert [r.label for r in out] == ["账号黑产", "作弊", "诈骗", "引流", "作弊"]
    assert (out[4].method, float(out[4].confidence)) == ("degraded", 0.30) and all(r.method == "keyword" for r in out[:4])


POSTS = "id long, platform string, content_raw string, author_username string, source_keyword string"


def test_cleaning_decisions(spark):
    rows = [
        (1, "xiaohongshu", "【标题】华西黄牛", "a", "黄牛"), (2, "tieba", "长期提供接码服务 微信: abc12345 量大优惠", "a", ""), (3, "weibo", "警惕刷单诈骗，公安提醒市民注意防范", "平安北京", "刷单"),
        (4, "qq_group", "[image:abc]", "b", ""), (5, "weibo", "[图片]", "b", ""), (6, "qq_group", "随便说点什么", "Q群管家", ""), (7, "zhihu", "", "c", ""), (8, "tieba", "出售实名银行卡四件套 联系我", "d", ""), (9, "douyin", None, None, None),
    ]
    out = {r.id: r for r in cleaning.clean(spark.createDataFrame(rows, POSTS)).collect()}
    assert out[1].is_noise and "短文本仅命中弱风险词" in out[1].relevance_reason
    assert not out[2].is_noise and out[2].relevance_score >= 0.3
    assert out[3].is_noise and "媒体/警方提示类内容" in out[3].relevance_reason and out[3].content_role == "police"
    assert out[4].is_noise and out[6].is_noise and "QQ系统账号" in out[6].noise_reason
    assert out[5].is_media_only and not out[5].is_noise
    assert out[7].is_noise and out[9].is_noise
    assert not out[8].is_noise and out[8].priority == "high"


def test_evidence_drops_touching_matches(spark):
    df = spark.createDataFrame([(1, "刷单返利日结100元", "诈骗"), (2, "外挂脚本", "作弊"), (3, None, "诈骗")], "id long, text string, label string")
    got = sorted((r.id, r.start, r.end, r.evidence) for r in analysis.evidence(df).collect())
    assert got == [(1, 0, 4, "刷单返利"), (2, 0, 2, "外挂")]


def test_cascade_asks_the_model_only_where_no_rule_speaks(spark):
    import pandas as pd

    def model(texts):
        assert not texts.str.contains("接码").any()
        return pd.DataFrame({"label": ["工具交易"] * len(texts), "confidence": [0.9 if "x" in t else 0.5 for t in texts]})

    df = spark.createDataFrame([(1, "接码"), (2, "x"), (3, "y")], "id long, text string")
    out = {r.id: (r.label, r.method) for r in analysis.cascade(df, "text", model).collect()}
    assert out == {1: ("账号黑产", "keyword"), 2: ("工具交易", "model"), 3: ("作弊", "degraded")}


def test_simhash_of_very_many_tokens_takes_little_memory():
    import hashlib
    import tracemalloc

    import pandas as pd

    text = " ".join(f"t{i}" for i in range(200_000))
    ones = [0] * 64
    for t in text.split():
        h = int.from_bytes(hashlib.md5(t.encode()).digest()[:8], "big")
        for b in range(64):
            ones[b] += h >> b & 1
    want = sum(1 << b for b in range(64) if 2 * ones[b] > 200_000)
    tracemalloc.start()
    found = list(T._simhash().func(iter([pd.Series([text, None, "hello world hello"]), pd.Series([None, None])])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [int(x) & (1 << 64) - 1 for x in found[0].dropna()] == [want, 0x5D41402ABC4B2A76] and [len(x) for x in found] == [3, 2]
    assert peak < 90e6
