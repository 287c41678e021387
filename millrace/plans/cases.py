"""Functions and the default rule pack on phrases of which each document brings one: the SQL gives what each must return, so it shares
nothing with the code. The same phrases are unit tests in tests/test_cases.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..functions import emoji
from ..functions import text as T
from ..operators import analysis, answers, cleaning

QUERIES: dict = {}
ORACLE: dict = {}


def _q(v) -> str:
    return "CAST(NULL AS VARCHAR)" if v is None else "'" + str(v).replace("'", "''") + "'"


#: What each query says of its phrases: name -> (function, {column: {phrase: what it must return}}).
CASES: dict = {}


def case(name: str, use: Callable[[Column], Column], **of: dict) -> None:
    """Registers a query of (doc_id, input, one string column for each of `of`): a document brings the phrase that its id picks."""
    inputs = list(next(iter(of.values())))
    CASES[name] = use, of

    def run(spark: SparkSession, sf_dir: str):
        picked = F.get(F.array(*(F.lit(x).cast("string") for x in inputs)), F.pmod("doc_id", F.lit(len(inputs))).cast("int"))
        out = use(F.col("input"))
        columns = [(out if len(of) == 1 else out[c]).cast("string").alias(c) for c in of]
        return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", picked.alias("input")).select("doc_id", "input", *columns)

    QUERIES[name] = run
    rows = ", ".join("(" + ", ".join([str(i), _q(x), *(_q(of[c][x]) for c in of)]) + ")" for i, x in enumerate(inputs))
    ORACLE[name] = f"SELECT doc_id, input, {', '.join(of)} FROM documents JOIN (VALUES {rows}) v(pick, input, {', '.join(of)}) ON pick = doc_id % {len(inputs)}"


case("defang_email_cases", T.defang_email, value={"user@sub.example.org": "user@sub[.]example[.]org"})
case("refang_cases", T.refang, value={"hxxp[://]evil[.]com": "http://evil.com"})
case("defang_text_cases", T.defang_text, value={"Visit http://bad.com or ping 10.0.0.1": "Visit hxxp[://]bad[.]com or ping 10[.]0[.]0[.]1", "mail a@b.co, see https://x.y/z?q=1.2.3.4": "mail a@b[.]co, see hxxp[://]x[.]y/z?q=1[.]2[.]3[.]4", "": "", None: None})
case("simhash_cases", lambda c: T.simhash_hex(T.simhash64(c)), value={"刷单平台接码服务 联系wx abc123": "0x5d86983ff693ebde", "hello world hello": "0x5d41402abc4b2a76", "！！": "0xd7a1ea0d4372282d", "短": "0xb58b94d8073cc245"})
case("apply_common_cases", T.apply_common, value={"<p>Ａ　b&amp;c</p>\\u4f60 见http://www.x.com/y?z 完": "A b&c 你 见[链接:x.com] 完", "&lt;b&gt;t": "t"})
case("normalize_cases", T.normalize, value={"a\u200b<i>b</i>&nbsp;c\\u0041": "a b cA"})
case("boilerplate_weibo_cases", lambda c: T.strip_boilerplate(c, "weibo"), value={"转发微博#话题#内容": " [话题:话题]内容"})
case("boilerplate_douyin_cases", lambda c: T.strip_boilerplate(c, "douyin"), value={"x #a #b #c #d #e #f": "x [话题:a] [话题:b] [话题:c]   "})
case("byte_truncation_cases", lambda c: T.truncate_bytes(c, 7), value={"日本語": "日本", "abc": "abc", "a日本語": "a日本", "": "", None: None})
case("emoji_density_cases", T.emoji_density, value={"\U0001f600\U0001f600ab": "0.5", "": "0.0", "ab": "0.0"})
case("emoji_meaning_cases", emoji.translate, value={"a💰b🛡️💰": "a💰b🛡️💰 [Emoji语义: [金钱/收益] [防护/盾牌]]", "plain": "plain"})
case("emoji_inline_cases", lambda c: emoji.translate(c, False), value={"a💰b💰": "a[金钱/收益]b[金钱/收益]"})
case("emoji_list_cases", lambda c: F.array_join(emoji.emojis(c), " "), value={"a💰b🛡️c💰": "💰 🛡️ 💰"})
case("noise_score_cases", lambda c: cleaning.noise_score(c).cast("double"), value={"": "1.0", "   ": "1.0", "接码": "0.1", "啊啊啊啊啊啊啊": "0.5"})
case("priority_cases", cleaning.priority, value={"出售实名银行卡四件套": "high", "代理IP": "normal", "今天天气": "normal"})
case("low_value_cases", cleaning.low_value, value={"???": "无中文字符且过短", "ab": "无中文字符且过短", "aaaaaaaaaaaa": "单字符重复刷屏", "正常的内容": None})
case("ad_noise_cases", cleaning.ad_noise, value={"免费领取大奖": "免费领取", "免费领取接码服务": None, "公交上车免费领取": None})
_LABELS = {"出抖音千粉号 可开播": "账号黑产", "刷播放量 包上热门": "作弊", "代办贷款 无抵押 黑户可做": "诈骗", "菠菜平台 真人视讯 百家乐": "引流", "今天天气真好": "作弊"}
case("classifier_cases", analysis.classify, label=_LABELS, method={x: "degraded" if x == "今天天气真好" else "keyword" for x in _LABELS})
_ANSWERS = {'{"intent_label": "诈骗", "confidence": 0.9}': ("诈骗", "", "0.9"), "sorry": ("作弊", "未分类", "0.5")}
case("model_label_cases", answers.label, label={k: v[0] for k, v in _ANSWERS.items()}, sub_label={k: v[1] for k, v in _ANSWERS.items()}, confidence={k: v[2] for k, v in _ANSWERS.items()})
