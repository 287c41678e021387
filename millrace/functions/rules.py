"""Rule packs: the fixed word lists, patterns and weights that the text operators work with.

Every operator takes a pack, so that other vocabularies can be used; DEFAULT holds the values whose results must be reproduced.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Category:
    """Rules of one risk label, applied in the order regex, keywords, variants, combinations."""

    label: str
    regex: tuple[str, ...] = ()
    keywords: tuple[str, ...] = ()
    variants: tuple[str, ...] = ()
    combos: tuple[tuple[str, ...], ...] = ()


@dataclass(frozen=True)
class RulePack:
    hard_noise: tuple[str, ...]
    false_contexts: tuple[tuple[str, str], ...]
    signals: tuple[str, ...]
    strong: tuple[str, ...]
    weak: tuple[str, ...]
    actions: tuple[str, ...]
    warnings: tuple[str, ...]
    contacts: tuple[str, ...]
    police: tuple[str, ...]
    victim: tuple[str, ...]
    media: tuple[str, ...]
    media_authors: tuple[str, ...]
    actors: tuple[str, ...]
    high_risk: tuple[str, ...]
    categories: tuple[Category, ...]
    evidence: tuple[tuple[str, tuple[str, ...]], ...] = field(default=())


# ---- Fixed values: everything below must be as it is for right results ----

DEFAULT = RulePack(
    hard_noise=("免费领取", "扫码关注", "点击链接", "点击领取", "全网最低", "限时优惠", "名额有限", "马上行动", "复制到浏览器", "下载APP", "注册送", "在家就能", "手机就能", "免费带", "免费教", "招代理", "微商"),
    false_contexts=(("刷单", "刷题"), ("出号", "出号码"), ("跑分", "跑步"), ("搬砖", "搬砖块|搬砖头|游戏搬砖"), ("上车", "公交上车|地铁上车|上车请"), ("下车", "公交下车|地铁下车|下车请"), ("引流", "引流管|医学引流|手术引流"), ("羊头", "羊头肉|羊头汤|羊头火锅"), ("大肉", "大肉面|大肉饭|大肉包子")),
    signals=(
        "714高炮", "AB贷", "上车", "下车", "云手机", "人脸", "代下", "代理IP", "众包", "八件套", "养号", "出号", "刷单", "千粉", "卡商", "反卤", "发卡", "可开播", "号商", "四件套", "大肉", "引流", "打码", "报单",
        "挂机", "接码", "搬砖", "撞库", "数字人", "料商", "无人直播", "无损套", "日结", "模拟器", "水房", "洗号", "狗推", "猫池", "白户", "破盾", "羊头", "羊腿", "群控", "薅羊毛", "融车", "跑分", "车手", "黄牛",
        "U商", "USDT", "BTC", "ETH", "买号", "卖号", "假流量", "流量卡", "国际短信", "背锅侠", "实名", "身份证", "银行卡", "手机号", "支付宝", "微信", "QQ号", "密码", "验证码", "涨粉", "解封", "代收", "代付",
        "洗钱", "虚拟币", "交易所", "吸粉", "买粉", "刷量", "刷赞", "劫持", "木马", "病毒", "后门", "免杀", "壳", "肉鸡", "僵尸", "DDOS", "CC攻击", "脱库",
    ),
    strong=(
        "接码", "跑分", "刷单", "洗钱", "料子", "料商", "号商", "卡商", "猫池", "群控", "撞库", "脱库", "木马", "病毒", "免杀", "后门", "代理IP", "云手机", "无人直播", "打码", "养号", "解封", "代实名", "代下", "代收", "代付",
        "四件套", "八件套", "USDT", "虚拟币", "黑产", "灰产", "私彩", "盘口", "水房", "刷量", "涨粉", "真人粉", "DDoS", "DDOS", "C2", "肉鸡", "僵尸网络", "botnet", "Q号", "QQ号", "老号", "换绑", "实名账号",
    ),
    weak=("黄牛", "羊毛", "兼职", "车", "群", "粉", "流量", "红包", "返利", "活动", "福利", "挂号"),
    actions=(
        "出售", "收购", "买号", "卖号", "出号", "收号", "接单", "放单", "招聘", "招募", "日结", "一单", "每单", "佣金", "价格", "报价", "低价", "批发", "量大", "包教", "教程", "全套", "下载", "接单", "下单", "上车", "下车",
        "需要的来", "懂的来", "私我", "加我", "联系我", "看主页", "主页",
    ),
    warnings=("警惕", "提醒", "通报", "新闻", "警方", "公安", "检察", "法院", "反诈", "官方", "辟谣", "曝光", "记者", "本报讯", "近日"),
    contacts=(
        r"(?i)https?://|t\.me/|telegram|linktr\.ee|短链接|二维码",
        r"(微信|VX|vx|V信|加V|加v|QQ|扣扣|TG|tg|纸飞机)[:：]?\s*[@A-Za-z0-9_\-]{3,}",
        r"@[A-Za-z0-9_]{4,}",
        r"(?U)\b1[3-9]\d{9}\b",
        r"(?U)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b",
    ),
    police=("警方", "警察", "公安", "反诈", "网警", "检察院", "法院", "抓获", "破获", "打掉", "摧毁", "抓捕", "犯罪嫌疑人"),
    victim=("被骗", "被骗了", "上当", "亏了", "坑了", "血泪", "借钱", "还不上了", "逾期", "催收", "爆通讯录", "我该怎么办", "求助", "有没有人"),
    media=("记者", "据报道", "本报讯", "近日", "爆料", "曝光", "揭秘", "震惊", "扩散", "提醒", "警惕"),
    media_authors=("新闻", "日报", "晚报", "都市报", "财经", "传媒", "资讯", "警方", "警察", "公安", "检察院", "法院", "网警", "反诈", "律师", "法律", "律所", "司法", "记者", "编辑", "小编", "曝光", "揭秘", "警惕", "注意", "提醒", "预警"),
    actors=("出号", "接码", "出抖", "卖号", "收号", "刷单", "日结", "需要的来", "懂的来", "私我", "加我", "联系我", "一手", "批发", "低价", "量大", "出量", "价格", "料商", "号商", "卡商", "寻长期", "靠谱", "有嘛", "有吗", "千粉", "可开播", "涨粉", "解封", "代下", "代收", "代付"),
    high_risk=("刷单", "诈骗", "接码", "出号", "出抖号", "日结", "套现", "洗钱", "博彩", "赌博", "色情", "裸聊", "招嫖", "枪支", "毒品", "假币", "伪基站", "撞库", "盗号", "猫池", "卡商", "代理IP", "VPN翻墙", "暗网", "数据买卖", "隐私泄露", "薅羊毛", "批量注册", "群控", "云手机", "模拟器", "代收", "代付", "跑分", "四件套", "八件套"),
    categories=(
        Category("诈骗", ("代办.{0,5}(贷款|信用卡|签证)", "(无抵押|秒批|黑户).{0,3}贷", "(恭喜|中奖).{0,5}(领取|填写)"), ("代办贷款", "代办信用卡", "代办签证", "无抵押贷", "秒批贷", "黑户贷", "恭喜中奖", "领取奖品"), ("daikuan", "xinyongka", "heimanh"), (("贷款", "无抵押"), ("信用卡", "代办"), ("中奖", "手续费"))),
        Category("引流", ("(加.{0,3}[Qq薇微信]).{0,5}(看|视频|私密|福利)", r"[Qq薇微信]{1,2}.*\d{5,}", "(菠菜|博彩|百家乐|真人视讯)"), ("加微信看", "加Q看", "加薇信", "菠菜", "博彩", "百家乐", "真人视讯", "私密视频", "福利姬"), ("bocai", "baijiale", "fuliji"), (("微信", "看片"), ("QQ", "福利"), ("飞机", "群"))),
        Category("作弊", ("(刷|提升).{0,3}(播放量|点赞|粉丝|销量|评论)", "(薅羊毛|撸货|套券|新人券)", "(外挂|辅助|脚本|透视|自瞄)"), ("刷播放量", "刷点赞", "刷粉丝", "刷销量", "薅羊毛", "撸货", "套券", "新人券", "外挂", "辅助脚本", "透视", "自瞄"), ("haoyangmao", "wai gua", "fuzhu"), (("刷", "播放量"), ("外挂", "游戏"), ("薅羊毛", "平台"))),
        Category("账号黑产", ("(出|卖|售|收).{0,4}(号|账号)", "(接码|猫池|打码|验证码.{0,3}接收)", "(撞库|扫号|洗号|盗号)"), ("出售账号", "买卖账号", "收号", "接码", "猫池", "打码平台", "撞库", "扫号", "洗号", "盗号", "养号", "批发出号"), ("jiema", "maochi", "zhuangku"), (("账号", "出售"), ("接码", "注册"), ("批发出号", "微信"))),
        Category("内容违规", ("(裸|黄片|AV|色情|福利姬|约炮)",), ("裸聊", "黄片", "AV", "色情", "约炮", "成人"), ("se qing", "huangpian", "yuepao"), (("色情", "直播"), ("裸聊", "app"))),
        Category("工具交易", ("(接码平台|发卡平台|卡密|黑卡)", "(出售|购买).{0,4}(数据|名单|信息)"), ("接码平台", "发卡平台", "卡密", "黑卡", "出售数据", "购买名单", "信息买卖", "社工库", "料子", "跑分通道", "四方支付"), ("jiema", "heika", "paofen"), (("跑分", "银行卡"), ("接码", "注册"), ("飞机", "通道"), ("料子", "出售"))),
        Category("支付洗钱", ("(跑分|代收|通道|四方支付)",), ("跑分", "代收", "通道", "四方支付", "洗钱", "对敲", "U卡", "OTC"), ("paofen", "跑 fen", "PF"), (("跑分", "银行卡"), ("接码", "注册"), ("飞机", "通道"), ("代收", "USDT"))),
        Category("直播违规", ("(数字人|无人直播|录播).{0,4}(带货|直播)", "(挂机|挂播|循环).{0,3}直播"), ("数字人", "无人直播", "录播带货", "挂机直播", "挂播", "循环直播", "矩阵号"), ("wurenzhibo", "shuziren", "juzhenhao"), (("无人直播", "工具"), ("录播", "带货"), ("矩阵号", "直播"))),
    ),
    evidence=(
        ("直播违规", ("无人直播", "数字人.{0,5}(直播|带货)", "(录播|挂播|循环).{0,3}直播", "(挂机|矩阵).{0,3}(直播|号)", "AI.{0,3}(直播|数字人)")),
        ("诈骗", ("刷单.{0,5}(返利|返现|佣金)", r"(日赚|日结|时薪).{0,5}\d{2,4}", "(无抵押|秒批|黑户).{0,3}贷", "(恭喜|中奖).{0,5}(领取|填写)", "(保证金|押金|解冻费).{0,5}(缴纳|交)", "(征信|洗白|修复).{0,5}(信用|征信)")),
        ("引流", ("加.{0,3}(微信|QQ|薇信|V信|wx)", "(私信|主页|简介).{0,5}(有|看|联系)", "(菠菜|博彩|百家乐|真人视讯|棋牌)", "(色流|约炮|裸聊|招嫖|成人)", r"(进群|加群|私域).{0,5}\d{5,}")),
        ("作弊", ("(刷.{0,2}(播放|点赞|粉丝|评论|销量))", "(薅羊毛|撸货|套券|新人券)", "(外挂|辅助|脚本|透视|自瞄|科技)", "(自动化|全自动|批量).{0,3}(操作|下单|抢)")),
        ("账号黑产", ("(出|卖|售|收).{0,4}(号|账号|白号|老号)", "(接码|猫池|打码|验证码.{0,3}(接|收))", "(撞库|扫号|洗号|盗号|脱库)", "(实名|过人脸|过认证).{0,5}(服务|技术)", "(批量注册|日出).{0,4}(号|千号|万号)")),
        ("工具交易", ("(出售|购买|交易).{0,4}(数据|名单|信息|料子)", "(接码平台|发卡平台|卡密|黑卡)", "(代理IP|IP代理|IP池|代理池)", "(云手机|群控|一机.{0,2}控)", "(脚本|插件|工具包).{0,4}(下载|出售|购买)")),
        ("内容违规", ("(裸|黄片|AV|色情|福利姬|约炮|招嫖)", "(枪支|毒品|假币|伪基站)", "(谣言|造谣|假新闻)")),
    ),
)

#: Entity patterns in their order; the value is group 1 where there is one.
ENTITIES = (
    ("phone", r"1[3-9]\d{9}", 0),
    ("wechat", r"(?:微信|wx|vx|VX|薇信|微)[：:\s]*([a-zA-Z][a-zA-Z0-9_-]{4,19})", 1),
    ("qq", r"(?:QQ|qq|扣扣)[：:\s]*(\d{5,11})", 1),
    ("telegram", r"(?:TG|Telegram|飞机|电报)[：:\s]*(@?[a-zA-Z][a-zA-Z0-9_]{4,31})", 1),
    ("email", r"\b[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\b", 0),
    ("url", r"https?://[^\s]+|t\.me/[^\s]+|t\.cn/[^\s]+", 0),
    ("domain", r"(?:[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?\.)+[a-zA-Z]{2,}", 0),
    ("ip", r"(?:\d{1,3}\.){3}\d{1,3}", 0),
    ("bank_card", r"\b(?:62|60|55|52|53|54|43|42|45|46|47|48|49)\d{14,18}\b", 0),
    ("alipay", r"(?:支付宝|zfb)[：:\s]*([a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}|\d{11})", 1),
    ("crypto_wallet", r"\b(?:T[a-zA-Z0-9]{33}|0x[a-fA-F0-9]{40})\b", 0),
)

#: By entity pattern what a text with a match must have: one of some words, or a shorter pattern. It takes a fraction of the time to look for.
ENTITY_SIEVES = {
    p: {
        "wechat": ("微", "薇信", "wx", "vx", "VX"), "qq": ("QQ", "qq", "扣扣"), "telegram": ("TG", "Telegram", "飞机", "电报"), "email": ("@",), "url": ("http://", "https://", "t.me/", "t.cn/"),
        "domain": r"\.[a-zA-Z]{2}", "bank_card": r"\d{16}", "alipay": ("支付宝", "zfb"), "crypto_wallet": "[T0][a-zA-Z0-9]{33}",
    }.get(t)
    for t, p, _ in ENTITIES
}
#: By entity pattern what must follow where a match begins; without it, each place in a word would be tried with all lengths of it.
ENTITY_STARTS = {p: r"(?=[a-zA-Z0-9-]{1,63}+\.[a-zA-Z0-9])" for t, p, _ in ENTITIES if t == "domain"}

#: Types by which a graph can be expanded, and those that count for the risk score.
EXPANDABLE = ("wechat", "qq", "telegram", "phone", "email", "bank_card", "alipay", "url", "domain", "ip", "crypto_wallet", "tool")

EXIT_WORDS = ("先付款", "先转钱", "先打钱", "定金", "保证金", "诚意金", "押金", "预付", "发身份证", "实名认证", "人脸识别", "手持身份证", "加微信私聊", "加QQ私聊", "加我微信", "加我QQ", "下载APP", "下载app", "安装软件", "裸聊", "招嫖", "枪支", "毒品", "违禁品")
EXIT_PATTERNS = (
    "(先|立即|马上|现在|立刻).*(付款|转账|支付|打款|汇款|发红包)",
    "(提供|发送|上传|发|给|看看|看一下).*(身份证|护照|手持|照片|视频认证|自拍)",
    "(身份证|护照).*(发|给|提供|上传|看一下)",
    "(下载|安装).*(APP|软件|客户端|插件|程序)",
    "(加|添加|私聊|联系|转).*(微信|WeChat|QQ|QQ群|telegram|蝙蝠|Signal|Skype)",
    "(给|发|提供|说|告诉).*(手机号|电话号码|验证码|密码|账号密码)",
    "(线下|见面|当面).*(交易|交货|碰头)",
)

#: Boilerplate by platform: patterns and what replaces them.
BOILERPLATE = {
    "weibo": ((r"抱歉[，,][^\n]*没有[^\n]+", r"抱歉[，,]根据作者设置[^\n]+", "展开全文", "转发微博", "#微博辟谣#", "O网页链接", r"L[^\s]*的微博视频", r"//@[^:：]+:[^\n]*"), " "),
    "zhihu": (("谢邀[，。]?", r"谢邀@[^\s]+[，。]?", "以上[，。]?", "知乎用户[，。]?", r"发布于 [\d/]+", r"著作权归作者所有[^\n]*", r"转载[请需]联系作者[^\n]*", r"编辑于 [\d/: ]+", r"^#盐选[^\n]*", r"^本回答来自[^\n]*", r"^补充[：:][^\n]*"), ""),
    "tieba": ((r"该楼层疑似违规已被系统折叠[^\n]*", r"隐藏此楼[^\n]*", r"^回复\s*\d+楼[^\n]*", r"^来自[^\n]+客户端[^\n]*", r"^----[^-\n]*----"), ""),
    "douyin": ((r"在抖音[，,]?[^\n]{0,20}看全文", r"#抖音[^\s#]*", r"@抖音[^\s]+", r"点击[^\n]{0,10}链接[^\n]*", r"长按[^\n]{0,10}复制[^\n]*", r"打开抖音[^\n]*"), ""),
    "xiaohongshu": ((r"#小红书[^\s#]*", r"@小红书[^\s]+", r"图文来源[^\n]*", r"以上内容仅供参考[^\n]*", r"笔记分类[^\n]*", r"#笔记灵感[^\n]*"), ""),
    "xianyu": ((r"^我在闲鱼发布了[^\n]*", r"^在闲鱼搜[^\n]*", r"^本店[^\n]{0,10}出售"), ""),
    "qq_group": ((r"\[CQ:[^\]]+\]",), ""),
}
FULL_WIDTH = ("０１２３４５６７８９ＡＢＣＤＥＦＧＨＩＪＫＬＭＮＯＰＱＲＳＴＵＶＷＸＹＺａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ，。！？＂＃＄％＆＇（）＊＋－／：；＜＝＞＠［＼］＾＿｀｛｜｝～", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz,.!?\"#$%&'()*+-/:;<=>@[\\]^_`{|}~")
LOW_VALUE = (("^[^一-鿿]{0,5}$", "无中文字符且过短"), (r"^(.)\1{9,}$", "单字符重复刷屏"), ("^[?？]+$", "纯问号"), ("^[!！.。]+$", "纯标点符号"))
PENALTIES = ((r"^(.)\1{5,}$", 0.3, "单字符重复"), ("[!！?？]{3,}", 0.15, "过多标点"), ("http", 0.05, "含URL"), (r"(?U)@\w+", 0.05, "含@提及"))
EMOJI_RANGES = r"[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F700}-\x{1F8FF}\x{1F900}-\x{1F9FF}\x{1FA00}-\x{1FAFF}\x{2600}-\x{27BF}\x{24C2}-\x{24FF}\x{1F100}-\x{1F1FF}\x{2B05}-\x{2B07}\x{2934}-\x{2935}\x{25AA}-\x{25FE}\x{23CF}\x{23E9}-\x{23F3}\x{23F8}-\x{23FA}\x{FE00}-\x{FE0F}\x{200D}]"
HTML_ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&nbsp;", " "), ("&#39;", "'"), ("&ldquo;", '"'), ("&rdquo;", '"'), ("&hellip;", "..."), ("&mdash;", "—"), ("&ndash;", "–"))
#: Legacy statuses and what they are now.
LEGACY_STATUS = {"pending": "RAW_COLLECTED", "raw": "RAW_COLLECTED", "cleaned": "CLEANED", "running": "ANALYZING", "analyzing": "ANALYZING", "screened": "SCREENED", "initial_screened": "SCREENED", "success": "ANALYZED", "analyzed": "ANALYZED", "failed": "FAILED", "discarded": "DISCARDED"}
STATUSES = ("RAW_COLLECTED", "CLEANED", "DISCARDED", "ANALYZING", "SCREENED", "ANALYZED", "FAILED")


def category_rules(pack: RulePack = DEFAULT) -> list[tuple[str, str, tuple[str, ...] | str]]:
    """(label, sub label, pattern or words that must all occur), in order: of each category regex, keywords, variants, combinations."""
    out: list = []
    for c in pack.categories:
        out += [(c.label, c.label, r) for r in c.regex]
        out += [(c.label, c.label, (k,)) for k in (*c.keywords, *c.variants)]
        out += [(c.label, "高危组合", tuple(k)) for k in c.combos]
    return out


def needed_words(pattern: str) -> tuple[str, ...]:
    """Words of which any match of the pattern has one: its longest literal part, or those of a group that it begins with. () if not told."""
    if "(?" in pattern or "&&" in pattern or re.search(r"\\(?![dDwWsSbB\W])", pattern):
        return ()
    plain = re.sub(r"\\.|\[\^?\]?[^\]\[\\]*(?:\\.[^\]\[\\]*)*\]", "\0", pattern)
    flat, inner = plain, ""
    while flat != inner:
        flat, inner = re.sub(r"\([^()]*\)", "\0", flat), flat
    if re.search(r"[|()\[\]]", flat):
        return ()
    words = [""]
    for x, times in re.findall(r"(.)([*+?]+|\{[^}]*\}[+?]?)?", flat, re.DOTALL):
        if times or x in "\0.^$":
            words.append("")
        else:
            words[-1] += x
    if best := max(words, key=len):
        return (best,)
    if not plain.startswith("(") or re.match("\0[*?{]", flat):
        return ()
    parts, depth = [""], 0
    for x in plain:
        depth += (x == "(") - (x == ")")
        if not depth:
            break
        if x == "|" and depth == 1:
            parts.append("")
        elif parts != [""] or x != "(" or depth > 1:
            parts[-1] += x
    found = [needed_words(x) for x in parts]
    return tuple(dict.fromkeys(w for ws in found for w in ws)) if all(found) else ()
