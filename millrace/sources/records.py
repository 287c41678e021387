"""Parsed records of each platform as posts of one schema, and what follows from them: comment rows, media, chat messages, times."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import COMMENT, POST


def comment(**fields: Column) -> Column:
    """A comment; what isn't given is empty."""
    empty = {"id": "", "author_uid": "", "author_username": "", "content": "", "like_count": 0, "reply_to": "", "created_at": "", "type": "comment"}
    return F.struct(*(F.coalesce(fields[k], F.lit(v)).cast("bigint" if k == "like_count" else "string").alias(k) if k in fields else F.lit(v).cast("bigint" if k == "like_count" else "string").alias(k) for k, v in empty.items()))


def _comments(array: Column, use) -> Column:
    return F.coalesce(F.transform(array, use), F.expr(f"cast(array() as array<{COMMENT}>)"))


def _strings(c: Column) -> Column:
    return F.coalesce(c, F.expr("cast(array() as array<string>)"))


def _meta(df: DataFrame, *names: str) -> Column:
    return F.map_from_entries(F.array(*(F.struct(F.lit(n), F.coalesce(F.col(n).cast("string"), F.lit(""))) for n in names)))


def _post(df: DataFrame, platform: Column, **fields: Column) -> DataFrame:
    """The post schema, with defaults for what isn't given."""
    out = []
    import re

    for name, kind in re.findall(r"(\w+) ((?:array|map|struct)<.*?>(?=, \w+ |$)|\w+)", re.sub(r"\s+", " ", POST)):
        c = platform if name == "platform" else fields.get(name, F.col(name) if name in df.columns and name not in ("comments", "metadata") else None)
        if c is None:
            c = F.lit(None)
        if kind == "string":
            c = F.coalesce(c.cast("string"), F.lit("text" if name == "content_type" else ""))
        elif kind == "bigint" and name != "message_id":
            c = F.coalesce(c.cast("bigint"), F.lit(0).cast("bigint"))
        elif kind == "array<string>":
            c = _strings(c.cast(kind))
        elif kind == "double":
            c = F.coalesce(c.cast("double"), F.lit(0.0))
        elif name == "comments" and name not in fields:
            c = F.expr(f"cast(array() as array<{COMMENT}>)")
        out.append(c.cast(kind).alias(name))
    return df.select(*out)


def weibo(df: DataFrame) -> DataFrame:
    cs = _comments(F.col("comments"), lambda c: comment(id=c["id"], author_username=c["author"], content=c["text"], like_count=c["like_count"]))
    return _post(df, F.lit("weibo"), post_id=F.col("weibo_id"), like_count=F.col("attitudes_count"), comment_count=F.col("comments_count"), share_count=F.col("reposts_count"), comments=cs, tags=F.col("topics"), image_urls=F.col("image_list"), metadata=_meta(df, "weibo_id"))


def zhihu(df: DataFrame) -> DataFrame:
    """Answers and their comments become comments, in the order of the answers."""
    under = lambda a: _comments(a["comments"], lambda c: comment(id=c["id"], author_username=c["author"]["name"], content=c["content"], like_count=c["vote_count"], created_at=c["created_time"]))
    answer = lambda a: F.concat(F.array(comment(id=a["answer_id"], author_username=a["author_name"], content=a["content"], like_count=a["voteup_count"], created_at=a["created_time"], type=F.lit("answer"))), under(a))
    cs = F.coalesce(F.flatten(F.transform("answers", answer)), F.expr(f"cast(array() as array<{COMMENT}>)"))
    post_id = F.coalesce(F.nullif(F.col("answer_id"), F.lit("")), F.col("question_id"))
    return _post(df, F.lit("zhihu"), post_id=post_id, like_count=F.col("voteup_count"), comments=cs, tags=F.col("topics"), image_urls=F.col("image_list"), metadata=_meta(df, "question_id", "answer_id", "voteup_count"))


def tieba(df: DataFrame) -> DataFrame:
    cs = _comments(F.col("replies"), lambda r: comment(author_username=r["author_username"], author_uid=r["author_uid"], content=r["content"], created_at=r["reply_time"], type=F.lit("reply")))
    tags = F.when(F.coalesce("bar_name", F.lit("")) != "", F.array("bar_name"))
    return _post(df, F.lit("tieba"), post_id=F.col("thread_id"), like_count=F.col("like_num"), comment_count=F.col("reply_count"), comments=cs, tags=tags, image_urls=F.col("image_list"), metadata=_meta(df, "thread_id", "bar_name", "forum_id"))


def xiaohongshu(df: DataFrame) -> DataFrame:
    bare = F.coalesce("source_url", F.lit(""))
    url = F.when((F.coalesce("xsec_token", F.lit("")) != "") & ~F.contains(bare, F.lit("xsec_token")), F.concat(F.lit("https://www.xiaohongshu.com/explore/"), "note_id", F.lit("?xsec_token="), "xsec_token")).otherwise(bare)
    return _post(df, F.lit("xiaohongshu"), source_url=url, post_id=F.col("note_id"), image_urls=F.col("image_list"), metadata=_meta(df, "note_id", "xsec_token"))


def douyin(df: DataFrame) -> DataFrame:
    return _post(df, F.lit("douyin"), post_id=F.col("aweme_id"), tags=F.col("hashtags"), image_urls=F.col("image_list"), metadata=_meta(df, "aweme_id", "play_count", "duration"))


def xianyu(df: DataFrame) -> DataFrame:
    return _post(df, F.lit("xianyu"), post_id=F.col("item_id"), group_id=F.col("keyword"), listing_status=F.coalesce("listing_status", F.lit("active")), image_urls=F.col("image_list"), metadata=_meta(df, "item_id", "price", "location", "seller_rating", "listing_status", "keyword"))


def im(df: DataFrame) -> DataFrame:
    number = F.when(F.rlike("message_id", F.lit("^[0-9]+$")), F.col("message_id").cast("bigint"))
    url = F.concat(F.lit("qq://group/"), F.coalesce("group_id", F.lit("")), F.lit("/msg/"), F.coalesce("message_id", F.lit("")))
    return _post(df, F.coalesce("platform", F.lit("qq_group")), author_uid=F.col("sender_uid"), author_username=F.col("sender_nickname"), source_url=url, message_id=number, metadata=F.map_concat(_meta(df, "group_id", "group_name", "sender_uid", "sender_nickname", "message_id", "reply_to_id"), F.create_map(F.lit("is_im"), F.lit("true"))))


#: Source registry: platform to the function that makes posts of its records.
NORMALIZERS = {"weibo": weibo, "zhihu": zhihu, "tieba": tieba, "xiaohongshu": xiaohongshu, "douyin": douyin, "xianyu": xianyu, "im": im}


def normalize(platform: str, df: DataFrame) -> DataFrame:
    if platform not in NORMALIZERS:
        raise ValueError(f"unknown platform {platform!r}; known are {sorted(NORMALIZERS)}")
    return NORMALIZERS[platform](df)


def normalize_all(frames: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, (normalize(p, df) for p, df in frames.items()))


def comment_rows(posts: DataFrame) -> DataFrame:
    """Each comment as a post of its own."""
    rows = posts.select("platform", "source_url", "post_id", F.posexplode("comments").alias("at", "c")).filter(F.coalesce("c.content", F.lit("")) != "")
    key = F.coalesce(F.nullif(F.col("c.id"), F.lit("")), F.col("at").cast("string"))
    return rows.select("platform", F.lit("comment").alias("content_type"), F.concat("source_url", F.lit("#comment_"), key).alias("source_url"), F.col("c.content").alias("content_raw"), F.col("c.author_uid").alias("author_uid"), F.col("c.author_username").alias("author_username"), "post_id")


#: Fixed value: platforms whose comments are fetched apart from their posts.
COMMENTED = ("xiaohongshu", "douyin", "tieba")


def with_comments(posts: DataFrame, comments: DataFrame) -> DataFrame:
    """posts with the comments that were fetched for them behind their own; comment_count is at least the number of the fetched.

    comments: platform, post_id, n (their order) and the fields of a comment, such as parsers give. Posts of platforms whose comments
    come with them, posts without an id and posts for which none was fetched stay as they are. A post's comments are gathered into
    its row, which is what the schema holds.
    """
    named = [f.split(":")[0].strip() for f in COMMENT.removeprefix("struct<").removesuffix(">").split(",")]
    kinds = dict(x.strip().split(": ") for x in COMMENT.removeprefix("struct<").removesuffix(">").split(","))
    one = F.struct(*(F.coalesce(F.col(c).cast(kinds[c]), F.lit(0 if kinds[c] == "bigint" else "").cast(kinds[c])).alias(c) for c in named))
    fetched = comments.filter(F.col("platform").isin(*COMMENTED) & (F.coalesce("post_id", F.lit("")) != "")).select("platform", "post_id", F.struct("n", one.alias("c")).alias("_c"))
    lists = fetched.groupBy("platform", "post_id").agg(F.transform(F.array_sort(F.collect_list("_c")), lambda x: x["c"]).alias("_fetched"))
    out = posts.join(lists, ["platform", "post_id"], "left")
    own = F.coalesce("comments", F.expr(f"cast(array() as array<{COMMENT}>)"))
    some = F.col("_fetched").isNotNull()
    out = out.withColumns({"comments": F.when(some, F.concat(own, "_fetched")).otherwise(F.col("comments")), "comment_count": F.when(some, F.greatest(F.coalesce("comment_count", F.lit(0)), F.size("_fetched").cast("long"))).otherwise(F.col("comment_count"))})
    return out.select(*posts.columns)


def media_urls(images: Column, cover: Column) -> Column:
    return F.when((F.coalesce(cover, F.lit("")) != "") & ~F.array_contains(images, cover), F.array_append(images, cover)).otherwise(images)


def media_hash(urls: Column, digits: int = 12, ordered: bool = True) -> Column:
    return F.when(F.size(urls) > 0, F.substring(F.md5(F.array_join(F.array_sort(urls) if ordered else urls, "|")), 1, digits)).otherwise("")


def keyword_of(text: Column, keywords: Column) -> Column:
    """The first keyword in the text, else the first."""
    return F.coalesce(F.get(F.filter(keywords, lambda k: F.contains(text, k)), F.lit(0)), F.get(keywords, F.lit(0)))


def chat_messages(df: DataFrame) -> DataFrame:
    """Group messages of chat events: the text of their segments, their images, `(纯媒体消息)` where there is no text."""
    said = lambda s: F.struct(F.coalesce(F.nullif(s["data"]["summary"], F.lit("")), F.nullif(s["data"]["alt"], F.lit("")), s["type"]).alias("x"))["x"]
    part = lambda s: F.when(s["type"] == "text", F.coalesce(s["data"]["text"], F.lit(""))).when(s["type"].isin("image", "mface", "face"), F.concat(F.lit("["), said(s), F.lit("]"))).when(s["type"] == "video", "[视频]").when(s["type"] == "file", F.concat(F.lit("[文件:"), F.coalesce(s["data"]["name"], F.lit("")), F.lit("]"))).when(s["type"] == "at", F.concat(F.lit("@"), F.coalesce(s["data"]["qq"], F.lit("")))).when(s["type"] == "reply", "[回复]").when(s["type"] == "record", "[语音]").otherwise("")
    url = lambda s: F.coalesce(F.nullif(s["data"]["url"], F.lit("")), s["data"]["file"])
    images = F.filter(F.transform(F.filter("message", lambda s: s["type"].isin("image", "mface", "face")), url), lambda u: F.coalesce(u, F.lit("")) != "")
    text = F.trim(F.coalesce(F.nullif(F.col("raw_message"), F.lit("")), F.array_join(F.transform("message", part), ""), F.lit("")))
    rows = df.filter("post_type = 'message' and message_type = 'group'").withColumns({"_text": text, "image_urls": _strings(images)})
    rows = rows.filter((F.col("_text") != "") | (F.size("image_urls") > 0))
    return rows.select("group_id", F.col("user_id").alias("sender_uid"), F.coalesce(F.nullif(F.col("sender.nickname"), F.lit("")), F.col("sender.card"), F.lit("")).alias("sender_nickname"), F.when(F.col("_text") == "", "(纯媒体消息)").otherwise(F.col("_text")).alias("content_raw"), "message_id", F.timestamp_seconds("time").alias("sent_at"), "image_urls")


def phrase_time(c: Column, now: Column) -> Column:
    """The time that a phrase on a page tells; the first of these that is there, else now."""
    g = lambda p, i: F.regexp_extract(c, p, i)
    n = lambda p, i=1: F.nullif(g(p, i), F.lit("")).cast("int")
    ts = lambda y, mo, d, h=F.lit(0), mi=F.lit(0): F.try_make_timestamp_ntz(y, mo, d, h, mi, F.lit(0))
    back = lambda p, unit: F.when(n(p).isNotNull(), F.timestamp_add(unit, -n(p), now))
    pub, full, month = r"发布于\s*(\d{4})[-/](\d{1,2})[-/](\d{1,2})", r"(\d{2,4})[-/](\d{1,2})[-/](\d{1,2})\s+(\d{1,2}):(\d{2})", r"(\d{1,2})月(\d{1,2})日\s*(\d{1,2}):(\d{2})"
    today, yesterday, date = r"今天\s*(\d{1,2}):(\d{2})", r"昨天\s*(\d{1,2}):(\d{2})", r"(\d{4})-(\d{1,2})-(\d{1,2})"
    year = F.when(n(full) < 100, n(full) + 2000).otherwise(n(full))
    day = lambda t, p: ts(F.year(t), F.month(t), F.day(t), n(p), n(p, 2))
    return F.coalesce(
        ts(n(pub), n(pub, 2), n(pub, 3)), ts(year, n(full, 2), n(full, 3), n(full, 4), n(full, 5)),
        ts(F.when(n(month) > F.month(now) + 1, F.year(now) - 1).otherwise(F.year(now)), n(month), n(month, 2), n(month, 3), n(month, 4)),
        day(now, today), back(r"(\d+)分钟前", "MINUTE"), back(r"(\d+)小时前", "HOUR"), day(F.timestamp_add("DAY", F.lit(-1), now), yesterday), back(r"(\d+)秒前", "SECOND"), ts(n(date), n(date, 2), n(date, 3)), now,
    )


#: Identifiers, counts and lists of parsed records that go into a raw row's metadata.
META_IDS = ("thread_id", "weibo_id", "question_id", "note_id", "aweme_id", "bar_name")
META_COUNTS = ("reply_count", "reposts_count", "comments_count", "attitudes_count", "voteup_count", "like_count", "collect_count", "share_count", "comment_count", "play_count", "duration")
META_LISTS = ("topics", "tags", "image_list", "hashtags")


def raw_rows(df: DataFrame, platform: str, keyword: str = "") -> DataFrame:
    """Parsed records as raw rows; metadata has the keyword, the identifiers, counts other than 0 and lists that aren't empty (as JSON)."""
    there = set(df.columns)
    entries = [F.struct(F.lit("keyword").alias("k"), F.lit(keyword).alias("v"), F.lit(True).alias("ok"))]
    entries += [F.struct(F.lit(c).alias("k"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("v"), F.lit(True).alias("ok")) for c in META_IDS if c in there]
    entries += [F.struct(F.lit(c).alias("k"), F.col(c).cast("string").alias("v"), (F.coalesce(F.col(c), F.lit(0)) != 0).alias("ok")) for c in META_COUNTS if c in there]
    entries += [F.struct(F.lit(c).alias("k"), F.to_json(c).alias("v"), (F.coalesce(F.size(c), F.lit(0)) > 0).alias("ok")) for c in META_LISTS if c in there]
    metadata = F.map_from_entries(F.transform(F.filter(F.array(*entries), lambda e: e["ok"]), lambda e: F.struct(e["k"], e["v"])))
    channel = F.coalesce(F.col("bar_name"), F.lit("")) if platform == "tieba" and "bar_name" in there else F.lit(keyword)
    images = _strings(F.col("image_list")) if "image_list" in there else F.expr("cast(array() as array<string>)")
    media = media_urls(images, F.col("video_cover_url")) if "video_cover_url" in there else images
    return df.select(
        F.lit(platform).alias("source_platform"), F.coalesce("source_url", F.lit("")).alias("source_url"), channel.alias("source_channel"), F.lit(keyword).alias("source_keyword"), F.coalesce("author_uid", F.lit("")).alias("author_id"),
        F.coalesce("author_username", F.lit("")).alias("author_name"), F.coalesce("content_type", F.lit("text")).alias("content_type"), F.coalesce("content_raw", F.lit("")).alias("content_raw"), F.lit("RAW_COLLECTED").alias("raw_status"),
        media.alias("media_urls"), media_hash(media).alias("media_hash"), metadata.alias("metadata"),
    )
