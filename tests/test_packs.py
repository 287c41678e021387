import json

from pyspark.sql import functions as F

from millrace.functions.rules import DEFAULT
from millrace.operators import analysis
from millrace.sources.packs import rule_pack


def labels(spark, pack, *texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", analysis.classify(F.col("t"), pack).alias("c"))
    return {r.t: (r.c.label, r.c.sub_label) for r in df.collect()}


def test_a_file_of_rules_and_its_next_edition(spark, tmp_path):
    path = tmp_path / "rules.json"
    put = lambda data: path.write_text(json.dumps(data, ensure_ascii=False), encoding="utf-8")
    put({"钓鱼": {"regex": ["假.{0,3}官网", "(没有结束", "a++b"], "keywords": ["验证码转发", 7, ""], "variants": ["diaoyu"], "combos": [["登录", "过期"], "登录", []]}, "坏": ["x"], "空": {}})
    pack, report = rule_pack(spark, str(path))
    assert [c.label for c in pack.categories] == ["钓鱼"] and pack.signals == DEFAULT.signals
    assert pack.categories[0].regex == ("假.{0,3}官网", "a++b") and pack.categories[0].combos == (("登录", "过期"),)
    assert sorted((r.category, r.rule) for r in report.collect() if r.rule) == sorted([("钓鱼", "(没有结束"), ("钓鱼", "7"), ("钓鱼", '""'), ("钓鱼", '"登录"'), ("钓鱼", "[]")])
    assert report.filter("category = '坏' and problem = 'no object'").count() == 1
    got = labels(spark, pack, "这是假的官网", "diaoyu", "登录已过期", "代办贷款")
    assert got["这是假的官网"][0] == got["diaoyu"][0] == "钓鱼" and got["登录已过期"] == ("钓鱼", "高危组合") and got["代办贷款"][0] != "诈骗"
    put({"诈骗": {"keywords": ["代办贷款"]}})
    pack, report = rule_pack(spark, str(path))
    assert labels(spark, pack, "代办贷款", "diaoyu") == {"代办贷款": ("诈骗", "诈骗"), "diaoyu": ("作弊", "未分类")} and report.count() == 0


def test_files_that_are_none(spark, tmp_path):
    for name, text in (("a.json", "{no json"), ("b.json", "[]"), ("c.json", "{}"), ("d.json", "")):
        (tmp_path / name).write_text(text)
        pack, report = rule_pack(spark, str(tmp_path / name))
        assert pack is DEFAULT and report.count() == 1
    pack, report = rule_pack(spark, str(tmp_path / "missing.json"))
    assert pack is DEFAULT and report.first().problem.startswith("not read")
