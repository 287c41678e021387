"""Cleaning decisions for posts: platform filters, noise, role, relevance, priority, and what becomes of a post."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.emoji import emojis, has_emojis, translate
from ..functions.rules import BOILERPLATE, DEFAULT, LOW_VALUE, PENALTIES, RulePack

PLATFORMS = ("weibo", "zhihu", "tieba", "douyin", "xiaohongshu", "xianyu", "qq_group")
#: System messages, by platform, and what stands for media.
TIEBA_SYSTEM = ("由于用户举报", "因违反", "被删除", "被禁言", "联系贴吧客服", "贴吧安全局")
QQ_SYSTEM = (
    r"\[系统消息\][^\n]*", r"\[群通知\][^\n]*", r"\[公告\][^\n]*", r"你已加入[^\n]*", "已退出群聊", r"被管理员[^\n]*", r"被禁言[^\n]*", "开启了全员禁言", r"修改群名为[^\n]*", r"邀请[^\n]*加入了群聊", r"\[QQ红包\][^\n]*", r"\[戳一戳\][^\n]*", "Q群管家",
    "筹备中.*做兼职.*稍等", "投广告联系管理员", "想做兼职.*联系管理员", "联系管理员$", r"@\d{5,}.*筹备中", r"@\d{5,}.*做兼职", r"@\d{5,}.*想做兼职", "@所有人", r"发言请先[^\n]*",
)
QQ_AUTHORS = ("Q群管家", "QQ安全中心", "群助手", "系统消息")
MEDIA = ("[image]", "[视频]", "[video]", "[图片]", "[语音]", "[文件]", "[file]", "[audio]", "[表情]", "[sticker]", "[贴纸]", "(纯媒体消息)", "【无文本内容】", "【仅图片】", "【仅视频】")
MEDIA_PREFIXES = ("[image:", "[CQ:image", "[CQ:face", "[CQ:video", "[CQ:record", "[CQ:file", "[CQ:audio")


def low_value(c: Column) -> Column:
    """Why the stripped text has no value, or null."""
    stripped = F.trim(c)
    out = None
    for pattern, reason in LOW_VALUE:
        hit = F.rlike(stripped, F.lit(pattern))
        out = F.when(hit, reason) if out is None else out.when(hit, reason)
    return out


def ad_noise(c: Column, pack: RulePack = DEFAULT) -> Column:
    """The first advertising phrase, unless the text has a false context or a signal; else null."""
    false_context = F.lit(False)
    for word, pattern in pack.false_contexts:
        false_context = false_context | (F.contains(c, F.lit(word)) & F.rlike(c, F.lit(pattern)))
    first = F.get(T.hits(c, pack.hard_noise), F.lit(0))
    return F.when(~false_context & ~T.contains_any(c, pack.signals), first)


def platform_filter(platform: Column, c: Column, pack: RulePack = DEFAULT) -> Column:
    """struct(text, reason): the text without the platform's boilerplate, and why it is noise, or null."""

    def stripped(common: Column) -> Column:
        body = common
        for p in BOILERPLATE:
            body = F.when(platform == p, T.normalize_whitespace(T.strip_boilerplate(common, p))).otherwise(body)
        return body

    body = T.let(T.apply_common(c), stripped)

    def judged(t: Column) -> Column:
        system = (
            F.when((platform == "tieba") & T.contains_any(t, TIEBA_SYSTEM), "系统消息")
            .when((platform == "qq_group") & F.rlike(t, F.lit("^(?:" + "|".join(QQ_SYSTEM) + ")")), "系统消息")
            .when((platform == "qq_group") & F.rlike(t, F.lit("^[^一-鿿a-zA-Z0-9]+$")), "纯表情")
            .when(platform.isin("tieba", "douyin", "xiaohongshu") & (T.emoji_density(t) > 0.6), "表情刷屏")
            .when((platform == "weibo") & (F.length(t) < 5) & ~F.rlike(t, F.lit(T.CJK)), "内容过短")
        )
        return F.struct(t.alias("text"), F.coalesce(system, low_value(t), F.concat(F.lit("广告噪声: "), ad_noise(t, pack))).alias("reason"))

    return T.let(body, judged)


def noise_score(c: Column, pack: RulePack = DEFAULT) -> Column:
    """0 (clean) to 1 (noise), a decimal."""
    d = lambda x: F.lit(x).cast("decimal(5,2)")

    def judged(h: Column) -> Column:
        c, signal, density, bonus = (h[x] for x in ("text", "signal", "density", "bonus"))
        n = F.length(c)
        score = F.when(n < 5, F.when(signal, d("0.15")).otherwise(d("0.5"))).when((n < 15) & ~signal, d("0.2")).otherwise(d("0"))
        # without a Han character the share is 0 if anything is visible; only with some there is something to divide
        few = T.let(F.when(h["han"] > 0, h["han"] / T.visible_length(c)).when(F.rlike(c, F.lit("[^ \n]")), 0.0), lambda r: F.when(r < 0.1, d("0.3")).when(r < 0.3, d("0.1")).otherwise(d("0")))
        score = score + few
        score = score + F.when(density > 0.5, d("0.4")).when(density > 0.3, d("0.15")).otherwise(d("0"))
        for pattern, penalty, _ in PENALTIES:
            score = score + F.when(F.rlike(c, F.lit(pattern)), d(str(penalty))).otherwise(d("0"))
        score = score - F.when(bonus >= 3, d("0.15")).when(bonus >= 1, d("0.05")).otherwise(d("0"))
        score = score + F.when(F.rlike(c, F.lit("[一-鿿a-zA-Z0-9]")), d("0")).otherwise(d("0.6"))
        return F.when(F.trim(F.coalesce(c, F.lit(""))) == "", d("1")).otherwise(F.least(d("1"), F.greatest(d("0"), score))).cast("decimal(5,2)")

    found = F.struct(c.alias("text"), T.contains_any(c, pack.signals).alias("signal"), F.regexp_count(c, F.lit(T.CJK)).alias("han"), T.emoji_density(c).alias("density"), F.size(T.hits(c, pack.signals)).alias("bonus"))
    return T.let(found, judged)


def content_role(c: Column, author: Column | None = None, pack: RulePack = DEFAULT) -> Column:
    author = F.lit("") if author is None else F.coalesce(author, F.lit(""))
    return (
        F.when(T.contains_any(c, pack.police), "police")
        .when(T.contains_any(c, pack.victim), "victim")
        .when(T.contains_any(author, pack.media_authors) | (F.size(T.hits(c, pack.media)) >= 2), "media")
        .when(T.contains_any(c, pack.actors), "actor")
        .otherwise("unknown")
    )


def relevance(c: Column, role: Column, keyword: Column | None = None, pack: RulePack = DEFAULT) -> Column:
    """struct(relevant, score, reason): whether the post is worth an analysis."""
    d = lambda x: F.lit(x).cast("decimal(6,4)")
    keyword = F.lit("") if keyword is None else F.coalesce(keyword, F.lit(""))
    compact = F.regexp_replace(F.regexp_replace(c, r"(?U)\s+", ""), r"【标题】|【正文内容】|\[标题\]|\[正文内容\]", "")

    def judged(h: Column) -> Column:
        strong, weak, action, warning, contact = (h[x] for x in ("strong", "weak", "action", "warning", "contact"))
        s, w, a, k = F.size(strong) > 0, F.size(weak) > 0, F.size(action) > 0, contact > 0
        score = F.least(F.size(strong) * d("0.28"), d("0.70")) + F.least(F.size(action) * d("0.18"), d("0.45")) + F.least(F.size(weak) * d("0.10"), d("0.20")) + F.when(k, d("0.45")).otherwise(d("0"))
        score = score + F.when((keyword != "") & F.contains(c, keyword) & (s | a | k), d("0.08")).otherwise(d("0"))
        score = score.cast("decimal(6,4)")
        bounded = lambda x: F.greatest(d("0"), F.least(d("1"), x)).cast("decimal(6,4)")
        out = lambda ok, x, why: F.struct(ok.alias("relevant"), x.cast("decimal(6,4)").alias("score"), why.alias("reason"))
        warned = (F.size(warning) > 0) & ~k & ~a
        last = F.when(warned, score - d("0.25")).otherwise(score).cast("decimal(6,4)")
        some = lambda x: F.array_join(F.slice(x, 1, 4), "、")
        why = F.array_join(F.array_compact(F.array(F.when(warned, "含预警/新闻提示词但缺少行动线索"), F.when(s, F.concat(F.lit("命中核心风险词："), some(strong))), F.when(a, F.concat(F.lit("命中交易/招募动作："), some(action))), F.when(k, "发现联系方式/链接/资产线索"), F.when(w & ~s, F.concat(F.lit("仅命中弱风险词："), some(weak))))), "；")
        no = F.lit(False)
        return (
            F.when(role.isin("police", "media") & ~k & ~a, out(no, d("0.12"), F.lit("媒体/警方提示类内容，缺少可追踪实体或交易动作")))
            .when(w & ~s & ~a & ~k & (F.length(compact) <= 14), out(no, d("0.10"), F.lit("短文本仅命中弱风险词，缺少交易、联系、工具或引流信号")))
            .when(~s & ~a & ~k, out(no, d("0.08"), F.lit("未发现黑灰产核心词、交易动作或可追踪实体")))
            .when(~s & ~k & (score < d("0.28")), out(no, bounded(score), F.lit("仅命中弱动作词，缺少核心风险词或可追踪实体")))
            .otherwise(out((last >= d("0.28")) | k, bounded(last), F.when(why == "", "相关性规则通过").otherwise(why)))
        )

    contact = sum((F.rlike(c, F.lit(p)).cast("int") for p in pack.contacts), F.lit(0))
    found = F.struct(T.hits(c, pack.strong).alias("strong"), T.hits(c, pack.weak).alias("weak"), T.hits(c, pack.actions).alias("action"), T.hits(c, pack.warnings).alias("warning"), contact.alias("contact"))
    return T.let(found, judged)


def priority(c: Column, pack: RulePack = DEFAULT) -> Column:
    """The first high-risk word in the lower-cased text makes it high; words with capitals never match."""
    return F.when(T.contains_any(F.lower(c), pack.high_risk), "high").otherwise("normal")


def clean(df: DataFrame, pack: RulePack = DEFAULT) -> DataFrame:
    """df (platform, content_raw, author_username, source_keyword, ...) with what cleaning says of each post.

    Adds clean_text, simhash, content_md5, is_noise, is_media_only, content_role, noise_score, relevance_score, relevance_reason,
    priority and noise_reason. Duplicates are told by operators.dedup.author_aware().
    """
    raw = F.coalesce("content_raw", F.lit(""))
    stripped = F.trim(raw)
    prefix = F.lit(False)
    for p in MEDIA_PREFIXES:
        prefix = prefix | F.startswith(stripped, F.lit(p))
    placeholder, qq = stripped.isin(*MEDIA), F.col("platform") == "qq_group"
    rest = F.trim(T.let(stripped, lambda t: F.when(T.contains_any(t, MEDIA), T.fold(t, MEDIA, lambda x, m: F.replace(x, F.lit(m), F.lit("")))).otherwise(t)))
    embedded = F.when(qq, placeholder | prefix).otherwise(~placeholder & prefix)
    media = ~embedded & (placeholder | ((stripped != "") & (F.length(rest) <= 2)))
    system = qq & T.contains_any(F.coalesce("author_username", F.lit("")), QQ_AUTHORS)
    out = df.withColumns({"_embedded": embedded, "is_media_only": media & ~system, "_system": system, "_filtered": platform_filter(F.col("platform"), raw, pack)})
    said = F.when(F.col("_filtered.reason").isNull() & has_emojis(raw), translate(F.col("_filtered.text"))).otherwise(F.col("_filtered.text"))
    out = out.withColumn("clean_text", T.normalize(said))
    t = F.col("clean_text")
    out = out.withColumns({"simhash": T.simhash64(t), "content_md5": F.md5(t), "_score": noise_score(t, pack), "priority": priority(t, pack), "content_role": content_role(t, F.col("author_username"), pack)})
    out = out.withColumn("_relevance", relevance(t, F.col("content_role"), F.col("source_keyword"), pack))
    irrelevant = ~F.col("_relevance.relevant")
    short = F.length(F.trim(t)) < 3
    noise = F.when(F.col("_system") | F.col("_embedded"), True).when(F.col("is_media_only"), False).otherwise(F.col("_filtered.reason").isNotNull() | (F.col("_score") >= 0.6) | irrelevant | short)
    reason = F.when(F.col("_system"), F.concat(F.lit("QQ系统账号: "), "author_username")).otherwise(
        F.array_join(F.array_compact(F.array(F.col("_filtered.reason"), F.when(irrelevant & ~F.col("is_media_only"), F.col("_relevance.reason")), F.when(short & ~F.col("is_media_only"), "文本过短(<3字符)"), F.when(F.col("_embedded"), "QQ嵌入媒体(无法获取图片/视频内容)"))), " | ")
    )
    score = F.when(F.col("_system"), 1).when(irrelevant & ~F.col("is_media_only"), F.greatest(F.col("_score"), F.lit("0.85").cast("decimal(5,2)"))).otherwise(F.col("_score"))
    out = out.withColumns({"is_noise": noise, "noise_reason": reason, "noise_score": score.cast("decimal(5,2)"), "relevance_score": F.col("_relevance.score"), "relevance_reason": F.col("_relevance.reason")})
    return out.drop("_embedded", "_system", "_filtered", "_score", "_relevance")


def preview(df: DataFrame, key: str = "id", pack: RulePack = DEFAULT) -> DataFrame:
    """What cleaning does to each post, side by side: (key, platform, original, cleaned, simhash, noise_score, noise_reasons, priority, should_discard, emojis, emoji_count)."""
    raw = F.coalesce("content_raw", F.lit(""))
    reasons = F.when(F.col("noise_reason") == "", F.expr("cast(array() as array<string>)")).otherwise(F.split("noise_reason", r" \| "))
    return clean(df, pack).select(
        key, "platform", raw.alias("original"), F.col("clean_text").alias("cleaned"), T.simhash_hex(F.col("simhash")).alias("simhash"), "noise_score", reasons.alias("noise_reasons"), "priority",
        F.col("is_noise").alias("should_discard"), emojis(raw).alias("emojis"), F.size(emojis(raw)).alias("emoji_count"),
    )


def status(noise: Column, media: Column, duplicate: Column) -> Column:
    """What becomes of a post."""
    return F.when(media, "MEDIA_ONLY").when(noise, "DISCARDED").when(duplicate == "duplicate", "DISCARDED").when(duplicate == "similar", "SIMILAR").otherwise("CLEANED")
