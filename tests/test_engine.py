import datetime

import pytest
from test_sources import parsed

from millrace.engine import Engine
from millrace.sources import records
from millrace.tables import Tables

NOW = datetime.datetime(2024, 5, 1, 12)


@pytest.fixture
def engine(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "house"))
    posts = [("1", "长期提供接码服务 微信: abc12345 量大优惠 需要的来"), ("2", "今天天气真好"), ("3", "出售实名银行卡四件套 联系我 QQ: 1234567"), ("1", "长期提供接码服务 微信: abc12345 量大优惠 需要的来")]
    df = None
    for i, (who, text) in enumerate(posts):
        x = records.tieba(parsed(spark, "tieba", content_raw=text, author_uid=who, author_username=who, source_url=f"http://t/{i}"))
        df = x if df is None else df.union(x)
    e.add_posts(df, 100, NOW)
    return e


def test_from_posts_to_reports(engine, spark):
    assert engine.table("ods_raw_intel").count() == 4
    counts = engine.clean(NOW)
    assert counts == {"CLEANED": 2, "DISCARDED": 2}
    assert engine.table("dwd_clean_intel").filter("is_duplicate").count() == 1
    engine.put_slang(spark.createDataFrame([("接码", "收短信"), ("四件套", "身份")], "term string, normalized_meaning string"), NOW)
    decisions = {r.decision for r in engine.analyse(NOW).collect()}
    assert decisions <= {"NEED_GRAPH_ANALYSIS", "NEED_STANDARD_ANALYSIS", "CONFIRMED_RISK"} and decisions
    assert {r.raw_status for r in engine.table("ods_raw_intel").collect()} == {"ANALYZED", "DISCARDED"}
    assert engine.entity("wechat", "abc12345").count() == 1
    s = engine.stats(NOW.date()).first()
    assert (s.raw_total, s.raw_today, s.pending, s.analysed) == (4, 4, 0, 2)
    assert engine.intel(keyword="接码").count() == 2 and engine.intel(limit=1, offset=1).count() == 1
    report = engine.report().collect()
    assert len(report) == 2 and all(r.title.startswith("风险研判") and r.disposal_advice for r in report)
    raw_id = report[0].raw_id
    engine.annotate(spark.createDataFrame([(1, "classification", raw_id, "risk_label", "", "诈骗", "me", "", 1)], "annotation_id long, target_type string, target_id long, field_name string, old_value string, new_value string, annotator string, reason string, annotated_at long"))
    assert engine.sync_annotations() == 1 and engine.sync_annotations() == 0
    assert engine.history(raw_id).first().risk_label == "诈骗"


def raw(spark, rows):
    columns = "id long, source_platform string, content_raw string, raw_status string"
    return spark.createDataFrame([(i, "weibo", t, "CLEANED") for i, t in rows], columns)


def test_screening_sends_posts_to_their_second_pass(spark, tmp_path):
    import pandas as pd

    e = Engine(spark, str(tmp_path / "w"), buckets=4)
    e.put_slang(spark.createDataFrame([("接码", "收短信")], "term string, normalized_meaning string"), NOW)
    shared = "出售实名银行卡四件套 接码 加微信: abc12345 电话13800138000 http://evil.example.com/x"
    e.append("ods_raw_intel", raw(spark, [(1, shared), (2, shared + " 再来"), (3, "今天天气真好，出去走走吧。"), (4, "今天的接玛行情"), (5, "刷播放量 包上热门")]))
    model = lambda texts: pd.DataFrame({"label": ["诈骗"] * len(texts), "confidence": [0.9] * len(texts)})
    embed = lambda texts: [[1.0, 0.0] if t in ("接码", "接玛") else [0.0, 1.0] for t in texts]
    got = {r.raw_id: r.decision for r in e.analyse(NOW, model, embed).collect()}
    assert got[1] == got[2] == "NEED_GRAPH_ANALYSIS" and got[4] == "NEED_STANDARD_ANALYSIS" and got[3] in ("LOW_RISK_ARCHIVED", "SCREENED_REVIEW")
    rows = {(r.raw_id, r.version): r for r in e.table("dwd_intel_analysis").collect()}
    # the graph adds to the score of posts that share their values; the model labels what no rule did
    assert rows[1, 2].risk_score > rows[1, 1].risk_score and rows[1, 2].is_latest == 1 and rows[1, 1].is_latest == 0
    assert (rows[4, 1].classification_method, rows[4, 2].classification_method, rows[4, 2].risk_label) == ("degraded", "model", "诈骗")
    assert (3, 2) not in rows and rows[1, 1].evidence_spans and all(s.evidence for s in rows[1, 1].evidence_spans)
    status = {r.id: r.raw_status for r in e.table("ods_raw_intel").collect()}
    assert status[1] == status[2] == status[4] == "ANALYZED" and status[3] == ("ANALYZED" if got[3] == "LOW_RISK_ARCHIVED" else "SCREENED")
    assert {r.term: r.status for r in e.table("dim_slang_dict").collect()} == {"接码": "active", "接玛": "candidate"}
    assert [p.name for p in (tmp_path / "w" / "_work").iterdir() if p.is_dir()].__len__() == 1
    e.append("ods_raw_intel", raw(spark, [(9, shared)]))
    assert {r.raw_id: r.decision for r in e.analyse(NOW + datetime.timedelta(days=1), auto=False).collect()} == {9: "NEED_GRAPH_ANALYSIS"}
    assert e.table("ods_raw_intel").filter("id = 9").first().raw_status == "SCREENED" and e.history(9).count() == 1


def test_dictionary_jobs_and_migration(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "w"))
    term = lambda *rows: spark.createDataFrame(rows, "term string, normalized_meaning string, source string")
    e.put_slang(term(("a", "m", "x")), NOW)
    e.put_slang(term(("a", "other", "y"), ("b", "n", "y")), NOW, "candidate")
    e.review_slang("b", True, "me", NOW, "better")
    got = {r.term: (r.normalized_meaning, r.status, r.source) for r in e.table("dim_slang_dict").collect()}
    assert got == {"a": ("m", "active", "x"), "b": ("better", "active", "y")}
    e.submit(spark.createDataFrame([("j1",), ("j2",)], "job_id string"), NOW)
    e.finish_jobs(spark.createDataFrame([("j1",)], "job_id string"), NOW)
    assert [r.job_id for r in e.unfinished_jobs().collect()] == ["j2"]
    old = spark.createDataFrame([(1, "weibo", "x", "pending", 1), (2, "weibo", "y", "odd", 0)], "id long, platform string, content string, status string, is_high_risk int")
    e.migrate(old)
    e.migrate(old)
    rows = {r.id: (r.raw_status, r.metadata["priority"]) for r in e.table("ods_raw_intel").collect()}
    assert rows == {1: ("RAW_COLLECTED", "high"), 2: ("RAW_COLLECTED", "normal")}


def test_half_a_version_is_no_table(spark, tmp_path):
    e = Engine(spark, str(tmp_path))
    e.put_slang(spark.createDataFrame([("a", "m")], "term string, normalized_meaning string"), NOW)
    (tmp_path / "dim_slang_dict" / "v000000000002").mkdir()
    (tmp_path / "dim_slang_dict" / "data" / "000000000002-lost" / "_bucket=1").mkdir(parents=True)
    assert [r.term for r in e.table("dim_slang_dict").collect()] == ["a"]


def test_changes_touch_their_buckets_only(spark, tmp_path):
    schema = "id long, v string"
    t = Tables(spark, str(tmp_path), {"t": schema}, {"t": "id"}, buckets=16)
    rows = lambda *pairs: spark.createDataFrame([*pairs], schema)
    files = lambda: {str(p): p.stat().st_mtime_ns for p in (tmp_path / "t").rglob("*.parquet") if "/data/" in str(p)}
    have = lambda: sorted(map(tuple, t.table("t").collect()))
    assert have() == []
    t.write("t", rows(*((i, "a") for i in range(200))))
    before, pieces = files(), t.pieces("t")
    assert {b for b, _ in pieces} == set(range(16))
    t.upsert("t", rows((3, "b"), (500, "new"), (4, None)), ["id"])
    assert have() == [(i, "b" if i == 3 else "a") for i in range(200)] + [(500, "new")]
    touched = len(set(t.pieces("t")) - set(pieces))
    assert 1 <= touched <= 3 and all(files()[f] == at for f, at in before.items())
    t.append("t", rows((501, "c")))
    assert len(t.pieces("t")) == 17 and have()[-1] == (501, "c")
    assert [tuple(r) for r in t.table("t", 1).filter("id = 3").collect()] == [(3, "a")]
    t.merge("t", rows((7, None)), lambda base, new: base.join(new.select("id"), "id", "left_anti"))
    assert not any(i == 7 for i, _ in have())
    with pytest.raises(ValueError, match="in buckets of id"):
        t.upsert("t", rows((1, "x")), ["v"])
    want = have()
    t.vacuum("t", keep=1)
    assert have() == want and t.versions("t") == [4]
    kept = {c for _, c in t.pieces("t")}
    assert {p.name for p in (tmp_path / "t" / "data").iterdir() if p.is_dir()} == kept


def test_a_second_writer_of_a_version_fails(spark, tmp_path, monkeypatch):
    t = Tables(spark, str(tmp_path), {"t": "id long"}, {"t": "id"}, buckets=4)
    t.write("t", spark.range(5))
    late = Tables(spark, str(tmp_path), {"t": "id long"}, {"t": "id"}, buckets=4)
    monkeypatch.setattr(late, "versions", lambda name: [])
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        late.write("t", spark.range(9))
    assert t.table("t").count() == 5


def test_buckets_with_many_pieces_are_written_anew(spark, tmp_path):
    t = Tables(spark, str(tmp_path), {"t": "id long"}, {"t": "id"}, buckets=1)
    for i in range(10):
        t.append("t", spark.range(i, i + 1))
    assert t.table("t").count() == 10 and len(t.pieces("t")) <= 8


def test_top_k_in_blocks(spark):
    from millrace.operators import vectors

    df = spark.createDataFrame([(i, [float(i % 7), 1.0 + i, 2.0]) for i in range(60)], "vec_id long, embedding array<float>")
    q = df.withColumnRenamed("vec_id", "query_id")
    rows = lambda block: sorted(map(tuple, vectors.top_k(q, df, 3, block).collect()))
    assert len(rows(10_000)) == 180 and rows(7) == rows(10_000)
