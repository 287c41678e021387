"""JSON of platforms' pages and interfaces as parsed records, one row for each; fields that a record lacks take its defaults.

Each parser takes a DataFrame with a JSON text and gives the columns that sources.records expects of its platform.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_html
from ..schemas import COMMENT
from .records import comment

USER = "struct<id: string, screen_name: string>"
WEIBO = f"id string, mid string, text_raw string, text string, isLongText boolean, pic_num bigint, user {USER}, retweeted_status struct<text_raw: string, user: {USER}>, created_at string, reposts_count bigint, comments_count bigint, attitudes_count bigint"
ZHIHU_TARGET = "struct<id: string, url: string, excerpt: string, title: string, author: struct<id: string, name: string>, question: struct<id: string, title: string, topics: array<struct<name: string>>>, voteup_count: bigint, voteupCount: bigint, comment_count: bigint, commentCount: bigint, image_urls: array<string>>"
ZHIHU = f"type string, object {ZHIHU_TARGET}, target {ZHIHU_TARGET}"
DOUYIN = """aweme_id string, awemeId string, desc string, description string, media_type bigint, create_time bigint,
  author struct<nickname: string, short_id: string, uid: string, id: string>,
  statistics struct<digg_count: bigint, diggCount: bigint, comment_count: bigint, commentCount: bigint, share_count: bigint, shareCount: bigint, play_count: bigint, playCount: bigint>,
  video struct<duration: bigint, cover: struct<url_list: array<string>, url: string>>,
  text_extra array<struct<hashtag_name: string, hashtagName: string>>, cha_list array<struct<cha_name: string, chaName: string>>,
  images array<struct<url_list: array<string>, urlList: array<string>>>, image_infos array<struct<url_list: array<string>, urlList: array<string>>>"""
TIEBA = """data struct<tid: string, title: string, content: string, post_num: bigint, reply_num: bigint, forum_name: string, create_time: bigint,
  user: struct<show_nickname: string, user_name: string, user_id: string>, media: array<struct<type: string, big_pic: string, water_pic: string, small_pic: string>>, like_num: bigint>"""
#: Names of months in Weibo's times.
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")


def first(*columns: Column) -> Column:
    """The first text that is there and not empty, else the empty text."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns), F.lit(""))


def some(*columns: Column) -> Column:
    """The first number that is there and not 0, else 0."""
    return F.coalesce(*(F.nullif(c, F.lit(0)) for c in columns), F.lit(0))


def parsed(df: DataFrame, schema: str, json: str = "json") -> DataFrame:
    return df.select(F.from_json(json, schema).alias("_r")).select("_r.*")


def weibo_time(c: Column) -> Column:
    """`Tue Jun 02 18:12:10 +0800 2026` as it stands on the clock there; null if it is no such time."""
    g = lambda i: F.regexp_extract(c, r"^\w{3} (\w{3}) (\d{1,2}) (\d{2}):(\d{2}):(\d{2}) [+-]\d{4} (\d{4})$", i)
    month = F.array_position(F.array(*map(F.lit, MONTHS)), g(1)).cast("int")
    n = lambda i: F.nullif(g(i), F.lit("")).cast("int")
    return F.try_make_timestamp_ntz(n(6), month, n(2), n(3), n(4), n(5))


def weibo(df: DataFrame, json: str = "json") -> DataFrame:
    r = parsed(df, WEIBO, json)
    body = first(F.col("text_raw"), F.col("text"))
    again = F.concat(body, F.lit("\n//转发 @"), first(F.col("retweeted_status.user.screen_name")), F.lit(": "), F.left(first(F.col("retweeted_status.text_raw")), F.lit(100)))
    uid, key = first(F.col("user.id")), first(F.col("mid"), F.col("id"))
    return r.select(
        F.when(F.col("retweeted_status").isNotNull(), again).otherwise(body).alias("content_raw"), F.lit("text").alias("content_type"),
        F.when(uid != "", F.concat(F.lit("https://weibo.com/"), uid, F.lit("/"), key)).otherwise(F.concat(F.lit("https://weibo.com/detail/"), first(F.col("id")))).alias("source_url"),
        uid.alias("author_uid"), first(F.col("user.screen_name")).alias("author_username"), first(F.col("id")).alias("weibo_id"), weibo_time(F.col("created_at")).alias("collected_at"),
        *(some(F.col(c)).alias(c) for c in ("reposts_count", "comments_count", "attitudes_count")), F.expr("cast(null as array<string>)").alias("topics"), F.expr("cast(null as array<string>)").alias("image_list"), F.expr("cast(null as array<struct<id: string, author: string, text: string, like_count: bigint>>)").alias("comments"),
    )


def zhihu(df: DataFrame, json: str = "json") -> DataFrame:
    r = parsed(df, ZHIHU, json).filter("type = 'search_result'").withColumn("t", F.coalesce("object", "target"))
    question = first(F.col("t.question.id"))
    return r.select(
        first(clean_html(F.col("t.excerpt")), F.col("t.title"), F.col("t.question.title")).alias("content_raw"), F.lit("text").alias("content_type"), F.coalesce("t.url", F.concat(F.lit("https://www.zhihu.com/question/"), question)).alias("source_url"),
        first(F.col("t.author.id")).alias("author_uid"), first(F.col("t.author.name")).alias("author_username"), question.alias("question_id"), first(F.col("t.id")).alias("answer_id"),
        some(F.col("t.voteup_count"), F.col("t.voteupCount")).alias("voteup_count"), some(F.col("t.comment_count"), F.col("t.commentCount")).alias("comment_count"),
        F.transform("t.question.topics", lambda x: first(x["name"])).alias("topics"), F.filter("t.image_urls", lambda u: F.coalesce(u, F.lit("")) != "").alias("image_list"),
        F.expr("cast(null as array<struct<answer_id: string, author_name: string, content: string, voteup_count: bigint, created_time: string, comments: array<struct<id: string, author: struct<name: string>, content: string, vote_count: bigint, created_time: string>>>>)").alias("answers"),
    )


def douyin(df: DataFrame, json: str = "json") -> DataFrame:
    r = parsed(df, DOUYIN, json).withColumn("_id", first(F.col("aweme_id"), F.col("awemeId"))).filter("_id <> ''")
    none = F.expr("cast(array() as array<string>)")
    names = lambda c, *keys: F.coalesce(F.filter(F.transform(c, lambda x: first(*(x[k] for k in keys))), lambda n: n != ""), none)
    said = names("text_extra", "hashtag_name", "hashtagName")
    tags = F.concat(said, F.array_except(names("cha_list", "cha_name", "chaName"), said))
    pictures = F.coalesce(F.filter(F.transform(F.coalesce("images", "image_infos"), lambda i: F.get(F.coalesce(i["url_list"], i["urlList"]), F.lit(0))), lambda u: F.coalesce(u, F.lit("")) != ""), none)
    r = r.withColumns({"_tags": tags, "_pictures": pictures, "_text": first(F.col("desc"), F.col("description")), "_seconds": some(F.col("video.duration"))})
    kind = F.when((F.size("_pictures") > 0) | (F.col("media_type") == 4), "image").otherwise("video")
    parts = F.array_compact(F.array(
        F.when(F.col("_text") != "", F.concat(F.lit("【描述】"), "_text")), F.when(F.size("_tags") > 0, F.concat(F.lit("【话题】"), F.array_join(F.transform("_tags", lambda h: F.concat(F.lit("#"), h)), " "))),
        F.when(kind == "image", "【类型】图集"), F.when(F.col("_seconds") > 0, F.concat(F.lit("【时长】"), F.col("_seconds").cast("string"), F.lit("秒"))),
    ))
    s = lambda a, b: some(F.col(f"statistics.{a}"), F.col(f"statistics.{b}"))
    return r.select(
        F.when(F.size(parts) > 0, F.array_join(parts, "\n")).otherwise("【无文本内容】").alias("content_raw"), kind.alias("content_type"), F.concat(F.lit("https://www.douyin.com/video/"), "_id").alias("source_url"),
        first(F.col("author.uid"), F.col("author.id")).alias("author_uid"), first(F.col("author.nickname"), F.col("author.short_id")).alias("author_username"), F.col("_id").alias("aweme_id"),
        s("digg_count", "diggCount").alias("like_count"), s("comment_count", "commentCount").alias("comment_count"), s("share_count", "shareCount").alias("share_count"), s("play_count", "playCount").alias("play_count"), F.col("_seconds").alias("duration"),
        F.col("_tags").alias("hashtags"), F.col("_pictures").alias("image_list"), first(F.get("video.cover.url_list", F.lit(0)), F.col("video.cover.url")).alias("video_cover_url"),
    )


def tieba(df: DataFrame, json: str = "json") -> DataFrame:
    r = parsed(df, TIEBA, json).select("data.*")
    title, content = F.trim(first(F.col("title"))), F.trim(first(F.col("content")))
    body = F.array_join(F.array_compact(F.array(F.nullif(title, F.lit("")), F.when((content != "") & (content != title), content))), "\n")
    pictures = F.filter(F.transform(F.filter("media", lambda m: m["type"] == "pic"), lambda m: first(m["big_pic"], m["water_pic"], m["small_pic"])), lambda u: u != "")
    tid = first(F.col("tid"))
    return r.select(
        body.alias("content_raw"), F.lit("text").alias("content_type"), F.when(tid != "", F.concat(F.lit("https://tieba.baidu.com/p/"), tid)).otherwise("").alias("source_url"), first(F.col("user.user_id")).alias("author_uid"), first(F.col("user.show_nickname"), F.col("user.user_name")).alias("author_username"),
        tid.alias("thread_id"), first(F.col("forum_name")).alias("bar_name"), some(F.col("like_num")).alias("like_num"), some(F.col("post_num"), F.col("reply_num")).alias("reply_count"), F.lit("").alias("forum_id"), pictures.alias("image_list"),
        F.expr("cast(null as array<struct<author_username: string, author_uid: string, content: string, reply_time: string>>)").alias("replies"),
    ).filter("content_raw <> ''")


def price(c: Column) -> Column:
    return F.coalesce(F.regexp_extract(F.replace(c, F.lit(","), F.lit("")), r"([\d.]+)", 1).try_cast("double"), F.lit(0.0))


def item_id(url: Column) -> Column:
    return F.regexp_extract(url, r"[?&]id=(\d+)", 1)


#: Names of lists of offers, wherever they stand in an answer.
LISTS = ("items", "resultList", "list", "itemList")


def offers(df: DataFrame, json: str = "json", depth: int = 10) -> DataFrame:
    """(item): the objects, as JSON, in every list that has one of the names LISTS, at most `depth` levels down an answer."""
    level = df.select(F.try_parse_json(json).alias("v"))
    found = None
    for _ in range(depth):
        pairs = level.filter("v is not null").lateralJoin(df.sparkSession.tvf.variant_explode(F.col("v").outer())).select("key", F.col("value").alias("v"))
        pairs = pairs.withColumn("kind", F.schema_of_variant("v"))
        lists = pairs.filter(F.col("key").isin(*LISTS) & F.startswith("kind", F.lit("ARRAY")))
        here = lists.lateralJoin(df.sparkSession.tvf.variant_explode(F.col("v").outer())).select(F.col("value").alias("v")).filter(F.startswith(F.schema_of_variant("v"), F.lit("OBJECT"))).select(F.to_json("v").alias("item"))
        found = here if found is None else found.union(here)
        inner = F.rlike("kind", F.lit("^(ARRAY|OBJECT)"))
        level = pairs.filter(inner & ~(F.coalesce(F.col("key").isin(*LISTS), F.lit(False)) & F.startswith("kind", F.lit("ARRAY")))).select("v")
    return found


XHS_USER = "user_info: struct<user_id: string, nickname: string>"
XHS_COMMENT = f"id: string, content: string, like_count: bigint, create_time: string, {XHS_USER}"
XHS_PAGE = f"success boolean, data struct<comments: array<struct<{XHS_COMMENT}, sub_comments: array<struct<{XHS_COMMENT}, target_comment: struct<{XHS_USER}>>>>>>"
DOUYIN_COMMENT = "cid: string, text: string, digg_count: bigint, create_time: string, user: struct<uid: string, nickname: string>"
DOUYIN_PAGE = f"comments array<struct<{DOUYIN_COMMENT}, reply_comment: array<struct<{DOUYIN_COMMENT}>>>>"


def _thread(df: DataFrame, comments: Column, replies: str, of, *keep: str) -> DataFrame:
    """keep and a row for each comment and each reply to it, in their order."""
    rows = df.select(*keep, F.explode(comments).alias("_c"))
    empty = F.expr(f"cast(array() as array<{COMMENT}>)")
    both = F.concat(F.array(of(F.col("_c"), "comment").cast(COMMENT)), F.coalesce(F.transform(F.col(f"_c.{replies}"), lambda r: of(r, "reply").cast(COMMENT)), empty))
    return rows.select(*keep, F.explode(both).alias("_x")).select(*keep, "_x.*")


def xiaohongshu_comments(df: DataFrame, json: str = "json", keep: tuple[str, ...] = ()) -> DataFrame:
    """Comments and replies of comment pages that succeeded; a reply names whom it answers."""

    def of(c: Column, kind: str) -> Column:
        to = {"reply_to": c["target_comment"]["user_info"]["nickname"]} if kind == "reply" else {}
        return comment(id=c["id"], author_uid=c["user_info"]["user_id"], author_username=c["user_info"]["nickname"], content=c["content"], like_count=c["like_count"], created_at=c["create_time"], type=F.lit(kind), **to)

    page = df.withColumn("_p", F.from_json(json, XHS_PAGE)).filter("_p.success")
    return _thread(page, F.col("_p.data.comments"), "sub_comments", of, *keep)


def douyin_comments(df: DataFrame, json: str = "json", keep: tuple[str, ...] = ()) -> DataFrame:
    """Comments and replies of comment pages; replies have no time."""

    def of(c: Column, kind: str) -> Column:
        at = {"created_at": c["create_time"]} if kind == "comment" else {}
        return comment(id=c["cid"], author_uid=c["user"]["uid"], author_username=c["user"]["nickname"], content=c["text"], like_count=c["digg_count"], type=F.lit(kind), **at)

    return _thread(df.withColumn("_p", F.from_json(json, DOUYIN_PAGE)), F.col("_p.comments"), "reply_comment", of, *keep)
