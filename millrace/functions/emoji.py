"""Emoji and what they stand for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, quote, span

#: Emoji and meaning.
MEANINGS = {
    "💰": "[金钱/收益]", "💵": "[美元/现金]", "💴": "[日元/现金]", "💶": "[欧元/现金]", "💷": "[英镑/现金]", "💸": "[飞钱/快速赚钱]", "💳": "[银行卡/信用]", "💲": "[美元符号]", "🤑": "[暴富/贪婪]", "🧧": "[红包/转账]", "💎": "[钻石/高价值]", "🪙": "[硬币/代币]",
    "🏦": "[银行/金融机构]", "🤝": "[合作/交易]", "📱": "[手机/联系]", "📲": "[拨打电话]", "📞": "[电话联系]", "✉️": "[邮件/私信]", "📩": "[私信联系]", "📨": "[收件/消息]", "🔗": "[链接/跳转]", "📎": "[附件/文件]", "📋": "[清单/任务]", "✅": "[已完成/可做]",
    "❌": "[不可/拒绝]", "⭕": "[圈定/范围]", "🔴": "[红色警示]", "🟢": "[绿色/可用]", "🟡": "[黄色/注意]", "👤": "[个人账号]", "👥": "[多人/群组]", "👁️": "[观察/监控]", "🤫": "[保密/悄悄]", "🤐": "[封口/勿传]", "🔑": "[密钥/密码]", "🔒": "[锁定/安全]",
    "🔓": "[解锁/破解]", "🛡️": "[防护/盾牌]", "🎭": "[伪装/面具]", "👻": "[幽灵/隐身]", "🕵️": "[侦探/侦查]", "📊": "[数据/统计]", "📈": "[增长/上升]", "📉": "[下降/衰退]", "🔥": "[热门/火爆/紧急]", "💥": "[爆发/冲击]", "🚀": "[快速起飞/暴涨]", "⭐": "[星级/评分]",
    "🌟": "[明星/亮点]", "💯": "[满分/百分百]", "👍": "[点赞/好评]", "👎": "[差评/反对]", "❤️": "[喜欢/收藏]", "🔄": "[循环/转售]", "♻️": "[回收/复用]", "🐟": "[闲鱼/二手]", "📕": "[小红书]", "🎵": "[抖音/音乐]", "🐦": "[Twitter/X]", "💬": "[聊天/私信]",
    "📢": "[公告/广播]", "📣": "[扩音/宣传]", "🔔": "[通知/提醒]", "📌": "[置顶/固定]", "⚠️": "[警告/风险]", "🚫": "[禁止/封禁]", "🚨": "[警报/执法]", "💀": "[死亡/危险]", "☠️": "[有毒/危险]", "🗡️": "[攻击/武器]", "💣": "[炸弹/威胁]", "🧨": "[炸药/危险]",
    "🔪": "[刀具/威胁]", "😊": "[开心/友好]", "😢": "[悲伤/失望]", "😡": "[愤怒/不满]", "😱": "[震惊/恐惧]", "🤔": "[思考/怀疑]", "🙏": "[请求/感谢]", "💪": "[强力/靠谱]", "👏": "[鼓掌/赞许]", "🎉": "[庆祝/促销]", "🎁": "[礼物/福利]", "🤖": "[机器人/自动]",
    "💻": "[电脑/在线]", "🖥️": "[桌面端]", "📡": "[信号/传输]", "🌐": "[网络/全球]", "🔧": "[工具/配置]", "⚙️": "[设置/齿轮]", "🧲": "[吸引/引流]", "🎯": "[精准/目标]", "🏷️": "[标签/分类]",
}


def emojis(c: Column, meanings: dict[str, str] = MEANINGS) -> Column:
    """The known emoji of a text in their order, the longest first where one begins another."""
    return F.regexp_extract_all(c, F.lit(f"({_any(meanings)})"), F.lit(1))


def has_emojis(c: Column, meanings: dict[str, str] = MEANINGS) -> Column:
    return F.rlike(c, F.lit(_any(meanings)))


def _any(meanings: dict[str, str]) -> str:
    """Only where a character is among those that emoji begin with, each emoji is tried."""
    return f"(?=[{span(k[0] for k in meanings)}])(?:{'|'.join(quote(k) for k in sorted(meanings, key=len, reverse=True))})"


def _meaning(e: Column, meanings: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in meanings.items() for x in kv))[e]


def translate(c: Column, append: bool = True, meanings: dict[str, str] = MEANINGS) -> Column:
    """The text and ` [Emoji语义: ...]` with the distinct meanings in order, or the text with each emoji replaced."""
    if append:
        said = lambda t: F.array_join(F.array_distinct(F.transform(emojis(t, meanings), lambda e: _meaning(e, meanings))), " ")
        return let(c, lambda t: F.when(has_emojis(t, meanings), F.concat(t, F.lit(" [Emoji语义: "), said(t), F.lit("]"))).otherwise(t))
    return let(c, lambda t: F.aggregate(F.array_distinct(emojis(t, meanings)), t, lambda x, e: F.replace(x, e, _meaning(e, meanings))))
