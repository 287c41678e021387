"""Safety of conversations: what makes one end, and which replies must not be sent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.rules import EXIT_PATTERNS, EXIT_WORDS

#: What a reply must not contain, and the replies that end a conversation.
OUTPUT_PATTERNS = ("(我同意|我接受|好的.*付款|好的.*转账|好的.*打钱|可以.*付款)", "(我的.*身份证号?是|我的手机号是|我住在|我的真实姓名)", "(我的.*密码是|我的.*验证码是|我的.*账号是)", "(我帮你|我给你们|我来做|我可以做|我参与)", "(我先付|我先转|我先打|给你转|给你打钱)")

#: What is said in place of a reply that must not be sent, and at the end of a conversation by its reason.
FALLBACK_REPLY = "我再考虑考虑吧，谢谢。"
EXIT_REPLIES = ((("付款", "转账"), "不好意思，我现在不方便付款，回头再说吧。"), (("身份", "验证"), "我再考虑考虑吧，谢谢。"))
OTHER_EXIT_REPLY = "好的，我了解一下，有需要再联系你。"


def exit_reply(reason: Column) -> Column:
    """What ends a conversation for a reason; the first words found decide, a null reason has none."""
    out = F.lit(OTHER_EXIT_REPLY)
    for words, reply in reversed(EXIT_REPLIES):
        out = F.when(F.size(T.hits(F.coalesce(reason, F.lit("")), words)) > 0, reply).otherwise(out)
    return out


def safe_reply(c: Column) -> Column:
    """The reply itself if it may be sent, else the fixed one."""
    return F.when(allowed_reply(c), c).otherwise(FALLBACK_REPLY)


def incoming_flags(c: Column, words=EXIT_WORDS, patterns=EXIT_PATTERNS) -> Column:
    """The exit words in a message and `pattern:<n>` for each request pattern that it matches."""
    found = F.array_compact(F.array(*(F.when(F.rlike(c, F.lit(p)), F.lit(f"pattern:{i}")) for i, p in enumerate(patterns)), F.lit(None).cast("string")))
    return F.concat(T.hits(c, words), found)


def allowed_reply(c: Column) -> Column:
    return ~F.rlike(c, F.lit("|".join(OUTPUT_PATTERNS)))


def until_exit(turns: DataFrame, most_turns: int = 30, words=EXIT_WORDS, patterns=EXIT_PATTERNS, who: str = "user") -> DataFrame:
    """turns (conv_id, turn, role, text) up to each conversation's first exit and its first most_turns turns; exit marks that turn.

    The first exit of each conversation is an aggregate, joined back: no conversation is gathered.
    """
    flagged = F.size(incoming_flags(F.coalesce("text", F.lit("")), words, patterns)) > 0
    first = turns.filter((F.col("role") == who) & flagged).groupBy("conv_id").agg(F.min("turn").alias("_exit"))
    out = turns.filter(F.col("turn") < most_turns).join(first, "conv_id", "left").filter(F.col("_exit").isNull() | (F.col("turn") <= F.col("_exit")))
    return out.withColumn("exit", F.coalesce(F.col("turn") == F.col("_exit"), F.lit(False))).drop("_exit")
