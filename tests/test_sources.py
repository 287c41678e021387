import datetime
import json

from pyspark.sql import functions as F

from millrace.schemas import CHAT, PARSED, POST, WAREHOUSE
from millrace.sources import files, records


def parsed(spark, platform, **fields):
    schema = spark.createDataFrame([], PARSED[platform]).schema
    return spark.createDataFrame([tuple(fields.get(f.name) for f in schema)], schema)


def test_schemas_parse(spark):
    for s in (POST, CHAT, *PARSED.values(), *WAREHOUSE.values()):
        assert spark.createDataFrame([], s).columns


def test_posts_of_each_platform(spark):
    weibo = records.weibo(parsed(spark, "weibo", content_raw="t", weibo_id="9", attitudes_count=3, reposts_count=2, topics=["a"], comments=[("1", "u", "hi", 4)])).first()
    assert (weibo.platform, weibo.post_id, weibo.like_count, weibo.share_count, weibo.tags, weibo.content_type) == ("weibo", "9", 3, 2, ["a"], "text")
    assert weibo.comments[0].asDict() == {"id": "1", "author_uid": "", "author_username": "u", "content": "hi", "like_count": 4, "reply_to": "", "created_at": "", "type": "comment"}
    zhihu = records.zhihu(parsed(spark, "zhihu", content_raw="q", question_id="7", answer_id="", voteup_count=5, answers=[("1", "a", "x", 2, "t", [("2", ("b",), "y", 1, "u")]), ("3", "c", "z", None, None, None)])).first()
    assert zhihu.post_id == "7" and [(c.type, c.content, c.author_username) for c in zhihu.comments] == [("answer", "x", "a"), ("comment", "y", "b"), ("answer", "z", "c")]
    tieba = records.tieba(parsed(spark, "tieba", content_raw="p", thread_id="1", bar_name="吧", like_num=1, replies=[("u", "5", "r", "t")])).first()
    assert tieba.tags == ["吧"] and tieba.comments[0].type == "reply" and records.tieba(parsed(spark, "tieba")).first().tags == []
    xhs = records.xiaohongshu(parsed(spark, "xiaohongshu", note_id="n", source_url="http://x", xsec_token="T", tags=["a"])).first()
    assert xhs.source_url == "https://www.xiaohongshu.com/explore/n?xsec_token=T" and xhs.tags == ["a"]
    assert records.douyin(parsed(spark, "douyin", aweme_id="d", hashtags=["h"], share_count=2)).first().tags == ["h"]
    xianyu = records.xianyu(parsed(spark, "xianyu", item_id="i", keyword="k", price=9.5)).first()
    assert (xianyu.group_id, xianyu.price, xianyu.listing_status) == ("k", 9.5, "active")
    im = records.im(parsed(spark, "im", group_id="1", message_id="22", sender_uid="3")).first()
    assert (im.source_url, im.message_id, im.platform, im.metadata["is_im"]) == ("qq://group/1/msg/22", 22, "qq_group", "true")
    assert records.im(parsed(spark, "im", message_id="x1")).first().message_id is None
    both = records.normalize_all({"weibo": parsed(spark, "weibo", comments=[("1", "u", "hi", 4)], source_url="u"), "im": parsed(spark, "im")})
    assert both.count() == 2 and both.columns == spark.createDataFrame([], POST).columns
    assert [r.source_url for r in records.comment_rows(both).collect()] == ["u#comment_1"]


def test_media_keywords_and_times(spark):
    now = datetime.datetime(2024, 3, 10, 12, 30)
    texts = {"发布于 2023-5-6": (2023, 5, 6), "23-01-02 03:04": (2023, 1, 2, 3, 4), "12月31日 23:59": (2023, 12, 31, 23, 59), "3月1日 08:00": (2024, 3, 1, 8), "今天 07:05": (2024, 3, 10, 7, 5), "5分钟前": (2024, 3, 10, 12, 25), "13小时前": (2024, 3, 9, 23, 30), "昨天 20:00": (2024, 3, 9, 20), "30秒前": (2024, 3, 10, 12, 29, 30), "2022-02-03": (2022, 2, 3), "nothing": (2024, 3, 10, 12, 30)}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r.t: r.at for r in df.select("t", records.phrase_time(F.col("t"), F.lit(now).cast("timestamp_ntz")).alias("at")).collect()}
    assert got == {t: datetime.datetime(*v) for t, v in texts.items()}
    r = spark.createDataFrame([(["b", "a"], "c", "xay", ["q", "a"])], "u array<string>, c string, t string, k array<string>").select(records.media_hash(F.col("u")).alias("h"), records.media_hash(F.col("u"), 32, False).alias("g"), records.media_urls(F.col("u"), F.col("c")).alias("m"), records.keyword_of(F.col("t"), F.col("k")).alias("k")).first()
    import hashlib

    assert (r.h, r.g, r.m, r.k) == (hashlib.md5(b"a|b").hexdigest()[:12], hashlib.md5(b"b|a").hexdigest(), ["b", "a", "c"], "a")


EVENTS = [
    {"post_type": "message", "message_type": "group", "group_id": "1", "user_id": "2", "message_id": "m1", "time": 1700000000, "sender": {"nickname": "", "card": "C"}, "message": [{"type": "text", "data": {"text": "hi "}}, {"type": "image", "data": {"url": "u1"}}, {"type": "at", "data": {"qq": "9"}}]},
    {"post_type": "message", "message_type": "group", "group_id": "1", "user_id": "2", "message_id": "m2", "time": 1700000001, "sender": {"nickname": "N"}, "raw_message": "raw", "message": []},
    {"post_type": "message", "message_type": "private", "message_id": "m3", "raw_message": "x"},
    {"post_type": "notice"},
    {"post_type": "message", "message_type": "group", "message_id": "m4", "raw_message": "  ", "message": []},
]


def test_chat_and_files(spark, tmp_path):
    path = tmp_path / "chat.json"
    path.write_text("\n".join(json.dumps(e) for e in EVENTS))
    rows = sorted(records.chat_messages(spark.read.schema(CHAT).json(str(path))).collect(), key=lambda r: r.message_id)
    assert [(r.content_raw, r.sender_nickname, r.image_urls) for r in rows] == [("hi [image]@9", "C", ["u1"]), ("raw", "N", [])]
    lines = tmp_path / "p.jsonl"
    ok = {"platform": "weibo", "content_raw": "x", "content_type": "text", "collected_at": "2024-01-01", "source_url": "u", "message_id": "1"}
    lines.write_text("\n".join([json.dumps(ok), "", "{broken", json.dumps(ok | {"content_raw": ""}), json.dumps(ok | {"source_url": "v", "message_id": "2"})]))
    good, bad = files.partner_lines(spark, str(lines))
    assert (good.count(), bad.count()) == (2, 2)
    known = spark.createDataFrame([("weibo", "u", "7")], "platform string, source_url string, message_id string")
    assert [r.source_url for r in files.new_rows(good, known).collect()] == ["v"]
    doc = tmp_path / "d.json"
    doc.write_text(json.dumps({"messages": [{"platform": "a", "content_raw": "x"}, {"platform": "b", "content_raw": ""}]}, indent=1))
    assert [r.platform for r in files.json_documents(spark, str(doc)).collect()] == ["a"]
    slang = tmp_path / "s.json"
    slang.write_text(json.dumps([{"slang": "t", "meaning": "m", "category": "c"}, {"slang": ""}]))
    assert [tuple(r) for r in files.slang_dictionary(spark, str(slang)).collect()] == [("t", "m", "c", "manual")]
    table = tmp_path / "s.csv"
    table.write_text("slang,normalized_meaning\nt,m\n")
    assert [tuple(r) for r in files.slang_dictionary(spark, str(table), "csv").collect()] == [("t", "m", None, "manual")]


def test_raw_rows(spark):
    r = records.raw_rows(parsed(spark, "douyin", content_raw="c", aweme_id="9", like_count=0, share_count=2, hashtags=["h"], image_list=["i"], video_cover_url="v"), "douyin", "k").first()
    assert r.metadata == {"keyword": "k", "aweme_id": "9", "share_count": "2", "hashtags": '["h"]', "image_list": '["i"]'}
    assert (r.media_urls, r.source_channel, len(r.media_hash)) == (["i", "v"], "k", 12)
    assert records.raw_rows(parsed(spark, "tieba", bar_name="b"), "tieba").first().source_channel == "b"


def test_sql_functions(spark):
    from millrace.functions.sql import register

    register(spark)
    rows = spark.sql("SELECT e.* FROM VALUES ('mail a@b.co ip 1.2.3.4 微信: abcde1') p(t), LATERAL extract_entities(t) e").collect()
    assert [(r.entity_type, r.entity_value) for r in rows] == [("wechat", "abcde1"), ("email", "a@b.co"), ("domain", "b.co"), ("ip", "1.2.3.4")]
    assert spark.sql("SELECT defang_url('http://a.b/c') d, normalize_whitespace(' a　b ') n").first() == ("hxxp[://]a[.]b/c", "a b")


def test_new_rows_without_a_url_are_told_by_message(spark):
    known = spark.createDataFrame([("qq", "", "m0")], "platform string, source_url string, message_id string")
    rows = [("qq", "", "m0", "a"), ("qq", "", "m1", "b"), ("qq", None, "m2", "c"), ("qq", None, "m2", "c"), ("qq", "", "", "d"), ("qq", "", None, "e"), ("x", "u", None, "f"), ("x", "u", None, "f")]
    got = files.new_rows(spark.createDataFrame(rows, "platform string, source_url string, message_id string, text string"), known)
    assert sorted(r.text for r in got.collect()) == ["b", "c", "d", "e", "f"]


def test_fetched_comments_join_their_posts(spark):
    posts = records.tieba(parsed(spark, "tieba", content_raw="p", thread_id="1", reply_count=1, replies=[("u", "5", "own", "t")])).union(records.tieba(parsed(spark, "tieba", content_raw="q", thread_id="2", reply_count=9))).union(records.weibo(parsed(spark, "weibo", content_raw="w", weibo_id="1")))
    rows = [("tieba", "1", 2, "b", "late", None), ("tieba", "1", 1, "a", "first", 4), ("tieba", "3", 1, "c", "no post", 0), ("weibo", "1", 1, "d", "not fetched", 0), ("tieba", None, 1, "e", "", 0)]
    comments = spark.createDataFrame(rows, "platform string, post_id string, n int, id string, content string, like_count long").withColumns({c: F.lit("x") for c in ("author_uid", "author_username", "reply_to", "created_at", "type")})
    got = {(r.platform, r.post_id): r for r in records.with_comments(posts, comments).collect()}
    assert [(c.content, c.like_count) for c in got["tieba", "1"].comments] == [("own", 0), ("first", 4), ("late", 0)] and got["tieba", "1"].comment_count == 2
    assert got["tieba", "2"].comments == [] and got["tieba", "2"].comment_count == 9 and got["weibo", "1"].comments == [] and len(got) == 3
