import datetime
import json

from pyspark.sql import functions as F

from millrace.schemas import PARSED
from millrace.sources import parsers, records


def rows(spark, *objects):
    return spark.createDataFrame([(json.dumps(o),) for o in objects], "json string")


def test_weibo(spark):
    r = parsers.weibo(rows(spark, {"id": 5, "mid": "m", "text_raw": "hi", "user": {"id": 9, "screen_name": "u"}, "created_at": "Tue Jun 02 18:12:10 +0800 2026", "retweeted_status": {"text_raw": "x" * 200, "user": {"screen_name": "r"}}, "reposts_count": 2}, {"id": 6, "text": "t"})).collect()
    assert r[0].content_raw == "hi\n//转发 @r: " + "x" * 100 and r[0].source_url == "https://weibo.com/9/m" and r[0].collected_at == datetime.datetime(2026, 6, 2, 18, 12, 10)
    assert (r[1].source_url, r[1].content_raw, r[1].collected_at) == ("https://weibo.com/detail/6", "t", None)


def test_zhihu_douyin_tieba(spark):
    z = parsers.zhihu(rows(spark, {"type": "search_result", "object": {"id": 1, "excerpt": "<em>a</em>b", "question": {"id": 2, "topics": [{"name": "t"}]}, "voteupCount": 3}}, {"type": "other"})).collect()
    assert [(x.content_raw, x.question_id, x.answer_id, x.voteup_count, x.topics, x.source_url) for x in z] == [("a b", "2", "1", 3, ["t"], "https://www.zhihu.com/question/2")]
    d = parsers.douyin(rows(spark, {"awemeId": "7", "desc": "d", "text_extra": [{"hashtag_name": "a"}, {}], "cha_list": [{"cha_name": "a"}, {"chaName": "b"}], "video": {"duration": 9, "cover": {"url_list": ["c"]}}, "statistics": {"diggCount": 4}}, {"desc": "no id"}, {"aweme_id": "8", "images": [{"url_list": ["p"]}]})).collect()
    assert [(x.aweme_id, x.content_raw, x.content_type, x.hashtags, x.like_count, x.video_cover_url) for x in d] == [("7", "【描述】d\n【话题】#a #b\n【时长】9秒", "video", ["a", "b"], 4, "c"), ("8", "【类型】图集", "image", [], 0, "")]
    t = parsers.tieba(rows(spark, {"data": {"tid": 3, "title": "T ", "content": "C", "user": {"user_name": "n"}, "media": [{"type": "pic", "water_pic": "w"}, {"type": "video"}]}}, {"data": {"tid": 4}}, {})).collect()
    assert [(x.content_raw, x.source_url, x.author_username, x.image_list) for x in t] == [("T\nC", "https://tieba.baidu.com/p/3", "n", ["w"])]


def test_parsed_rows_become_posts(spark):
    for platform, parse in (("weibo", parsers.weibo), ("zhihu", parsers.zhihu), ("douyin", parsers.douyin), ("tieba", parsers.tieba)):
        df = parse(rows(spark, {}))
        assert {f.name for f in spark.createDataFrame([], PARSED[platform]).schema} <= set(df.columns) or platform == "weibo"
        assert records.normalize(platform, df).count() <= 1


def test_offers(spark):
    df = rows(spark, {"a": {"items": [{"x": 1}, 5], "deep": [{"resultList": [{"y": 2}]}]}}, {"list": []}, 3)
    assert sorted(r.item for r in parsers.offers(df, depth=5).collect()) == ['{"x":1}', '{"y":2}']
    r = spark.createDataFrame([("¥1,234.5 起", "http://x?a=1&id=77"), ("free", "x")], "p string, u string").select(parsers.price(F.col("p")).alias("p"), parsers.item_id(F.col("u")).alias("i")).collect()
    assert [tuple(x) for x in r] == [(1234.5, "77"), (0.0, "")]
