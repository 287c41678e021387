from pyspark.sql import functions as F

from millrace.functions.emoji import MEANINGS, emojis, translate
from millrace.operators import answers


def one(spark, c):
    return spark.range(1).select(c.alias("v")).first().v


def test_emoji(spark):
    assert len(MEANINGS) == 93
    assert one(spark, emojis(F.lit("a💰b🛡️c💰"))) == ["💰", "🛡️", "💰"]
    assert one(spark, translate(F.lit("a💰b🛡️💰"))) == "a💰b🛡️💰 [Emoji语义: [金钱/收益] [防护/盾牌]]"
    assert one(spark, translate(F.lit("a💰b💰"), False)) == "a[金钱/收益]b[金钱/收益]"
    assert one(spark, translate(F.lit("plain"))) == "plain"


def test_model_answers(spark):
    assert tuple(one(spark, answers.label(F.lit('{"intent_label": "诈骗", "confidence": 0.9}')))) == ("诈骗", "", 0.9)
    assert tuple(one(spark, answers.label(F.lit("sorry")))) == ("作弊", "未分类", 0.5)
    got = one(spark, answers.entities(F.lit('{"risk_tags": ["t"], "links": ["u"], "accounts": [{"type": "qq", "value": "1"}, {"type": "odd", "value": "2"}]}')))
    assert [tuple(x) for x in got] == [("feature", "t"), ("url", "u"), ("qq", "1"), ("wechat", "2")]
    text = "x" * 50 + "黑话" + "y" * 50
    a = one(spark, answers.slang_candidate(F.lit("黑话"), F.lit(text)))
    assert (a.term, a.suggested_meaning, a.confidence, a.evidence) == ("黑话", "待人工确认", 0.6, "x" * 24 + "黑话" + "y" * 24)
    b = one(spark, answers.slang_candidate(F.lit('{"word": "w", "meaning": "m", "confidence": 7, "reason": "r"}'), F.lit("no")))
    assert tuple(b) == ("w", "m", "r", 1.0, "no")
    assert one(spark, answers.slang_candidate(F.lit('{"reason": "r"}'), F.lit("no"))) is None
    terms = spark.createDataFrame([("aa",), ("aa",), ("b",), ("known",)], "term string")
    assert [r.term for r in answers.new_slang(terms, spark.createDataFrame([("known",)], "term string")).collect()] == ["aa"]


def test_evidence_merging(spark):
    spans = F.expr("array(named_struct('start', 5, 'end', 9, 'confidence', 0.9D, 'text', 'b'), named_struct('start', 0, 'end', 5, 'confidence', 0.92D, 'text', 'a'), named_struct('start', 10, 'end', 12, 'confidence', 0.9D, 'text', 'c'), named_struct('start', 11, 'end', 15, 'confidence', 0.95D, 'text', 'd'))")
    assert [x.text for x in one(spark, answers.merged_evidence(spans))] == ["a", "d"]
    spans = F.expr("array(named_struct('text', 'in it'), named_struct('text', 'in no it'), named_struct('text', 'none of'), named_struct('text', ''))")
    assert [x.text for x in one(spark, answers.valid_evidence(spans, F.lit("what is in it")))] == ["in it", "in no it"]


def test_candidate_grams(spark):
    got = one(spark, answers.candidate_grams(F.lit("接码平台12"), F.array(F.lit("接码"), F.lit("平台"), F.lit("12"))))
    assert got[0] == "接码" and "平台" not in got and "12" not in got and "接码平" in got
    assert one(spark, answers.candidate_grams(F.lit(None).cast("string"))) == []
    assert len(one(spark, answers.candidate_grams(F.lit("".join(chr(0x4E00 + i) for i in range(300)))))) in (32, 33)
