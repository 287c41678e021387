"""Windows over events, records made from turns, safety, reports, screening of whole posts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import analysis, graph, reports, safety, vectors
from ..sources import records
from ..streaming import ingest
from .operators import _SCORES, CORPUS, _scored, table

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _naive(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("start", "end")})


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(date_trunc('hour', ts) + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS \"end\", event_type, count(*) AS cnt FROM events GROUP BY 1, 2, 3")
def hourly_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _naive(ingest.windowed_counts(_events(spark, sf_dir), "ts", "1 hour", None, "10 minutes", "event_type"))


@query("WITH w AS (SELECT date_trunc('hour', ts) - INTERVAL 1 HOUR AS s FROM events UNION ALL SELECT date_trunc('hour', ts) FROM events) SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS start, strftime(s + INTERVAL 2 HOUR, '%Y-%m-%d %H:%M:%S') AS \"end\", count(*) AS cnt FROM w GROUP BY s")
def sliding_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _naive(ingest.windowed_counts(_events(spark, sf_dir), "ts", "2 hours", "1 hour"))


@query("WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(ts) + INTERVAL 6 HOUR, '%Y-%m-%d %H:%M:%S') AS \"end\", count(*) AS cnt FROM s GROUP BY user_id, k")
def session_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _naive(ingest.session_counts(_events(spark, sf_dir), "ts", "6 hours", "user_id"))


@query("WITH m AS (SELECT event_type, max(ts) AS mark FROM events WHERE event_id % 2 = 0 GROUP BY event_type) SELECT event_id FROM events e LEFT JOIN m ON e.event_type = m.event_type WHERE mark IS NULL OR ts > mark")
def hwm_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return ingest.incremental(e, e.filter("event_id % 2 = 0").groupBy("event_type").agg(F.max("ts").alias("mark")), "event_type", "ts").select("event_id")


@query("SELECT 'qq://group/' || conv_id || '/msg/' || turn AS source_url, turn AS message_id, role AS author_uid, text AS content_raw, 'qq_group' AS platform FROM conversations")
def im_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select(F.lit(None).cast("string").alias("platform"), F.col("text").alias("content_raw"), F.lit("text").alias("content_type"), F.col("role").alias("sender_uid"), F.lit("").alias("sender_nickname"), F.col("conv_id").cast("string").alias("group_id"), F.lit("").alias("group_name"), F.col("turn").cast("string").alias("message_id"), F.lit("").alias("reply_to_id"), F.expr("cast(array() as array<string>)").alias("image_urls"))
    return records.im(c).select("source_url", "message_id", "author_uid", "content_raw", "platform")


@query("SELECT p_brand, substr(md5(string_agg(p_name, '|' ORDER BY p_name)), 1, 12) AS media_hash FROM part GROUP BY p_brand")
def media_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(records.media_hash(F.collect_list("p_name")).alias("media_hash"))


@query("SELECT doc_id, CASE WHEN contains(text, 'queux') THEN 'queux' WHEN contains(text, 'heit') THEN 'heit' WHEN contains(text, 'tionth') THEN 'tionth' ELSE 'queux' END AS keyword FROM documents")
def keyword_backmatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", records.keyword_of(F.col("text"), F.array(*map(F.lit, ("queux", "heit", "tionth")))).alias("keyword"))


@query("WITH x AS (SELECT conv_id, min(turn) AS e FROM conversations WHERE role = 'user' AND (contains(text, 'reth') OR contains(text, 'Ouwh') OR regexp_matches(text, 'thn.{1,3}er')) GROUP BY conv_id) SELECT c.conv_id, c.turn, coalesce(c.turn = e, false) AS exit FROM conversations c LEFT JOIN x ON c.conv_id = x.conv_id WHERE c.turn < 5 AND (e IS NULL OR c.turn <= e)")
def turns_until_exit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return safety.until_exit(table(spark, sf_dir, "conversations"), 5, ("reth", "Ouwh"), ("thn.{1,3}er",)).select("conv_id", "turn", "exit")


@query("SELECT doc_id, octet_length(encode(text)) > 60 AS cut, left(text, (SELECT max(k) FROM range(0, 61) t(k) WHERE octet_length(encode(left(text, k))) <= 60)::INTEGER) AS whole FROM documents")
def byte_truncation(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").withColumn("t", T.truncate_bytes(F.col("text"), 60))
    return d.select("doc_id", (F.col("t") != F.col("text")).alias("cut"), F.col("t").alias("whole"))


@query()
def analysed_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole chain: classify, extract, score, screen, report."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("raw_id"), "text")
    posts = analysis.cascade(d, "text", pack=CORPUS)
    found = analysis.first_entities(analysis.entities(d, "raw_id"), "raw_id")
    counts = found.groupBy("raw_id").agg(F.count_if(F.col("entity_type").isin("wechat", "qq", "phone")).alias("contacts"), F.count_if(F.col("entity_type").isin("url", "domain", "ip")).alias("links"), F.count_if(F.col("entity_type") == "tool").alias("tools"), F.count_if(F.col("entity_type") == "slang").alias("slang"))
    scored = analysis.risk_score(posts.join(counts, "raw_id", "left").na.fill(0, ["contacts", "links", "tools", "slang"]).withColumn("related", F.lit(0)))
    spans = analysis.evidence(scored, "raw_id", "text", "label")
    out = reports.report(scored, found, spans)
    return out.select("raw_id", "title", "conclusion", F.size("evidence").alias("spans"), F.to_json("disposal_advice").alias("advice"), "graph_summary")


@query(
    f"""WITH {_SCORES}, l AS (SELECT *, CASE WHEN risk_score >= 0.85 THEN '严重' WHEN risk_score >= 0.65 THEN '高危' WHEN risk_score >= 0.35 THEN '普通' ELSE '低' END AS level FROM r)
    SELECT doc_id AS raw_id, '风险研判报告 — ' || label AS title, '该情报经系统研判，判定为「' || label || '」类黑灰产信息' || CASE WHEN doc_id % 3 = 0 THEN '（高危组合）' ELSE '' END || '，风险等级为 ' || level || '（评分 ' || printf('%.2f', risk_score) || '）。' AS conclusion,
      CASE label WHEN '诈骗' THEN '诈骗模型更新:high;资金链路追踪:critical' ELSE '渠道封堵:high;域名监控:medium' END || CASE WHEN doc_id % 5 = 1 THEN ';微信号标记: wx' || doc_id || ':high' ELSE '' END || CASE WHEN doc_id % 7 = 0 THEN ';团伙扩线:critical' ELSE '' END AS advice,
      CASE WHEN doc_id % 7 = 0 THEN '该情报涉及实体与 3 个历史实体存在关联，已归入案件 case-' || doc_id ELSE '未发现与历史情报的直接关联。该情报涉及的实体均为首次出现。' END AS graph_summary,
      array_to_string([k || '=e' || k || ':' || label FOR k IN range(1, least(doc_id % 9, 5) + 1)], ';') AS evidence, CASE WHEN doc_id % 5 = 1 THEN 'wechat=wx' || doc_id ELSE '' END AS entities, CASE WHEN doc_id % 4 = 1 THEN 's' || doc_id || '=m:' || label ELSE '' END AS slang FROM l"""
)
def report_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    posts = _scored(spark, sf_dir).withColumns({"raw_id": i, "sub_label": F.when(i % 3 == 0, "高危组合")})
    ids = table(spark, sf_dir, "documents").select(i.alias("raw_id"))
    found = ids.filter("raw_id % 5 = 1").select("raw_id", F.lit("wechat").alias("entity_type"), F.concat(F.lit("wx"), "raw_id").alias("entity_value"), F.lit(0).alias("ordinal"))
    cases = ids.filter("raw_id % 7 = 0").select("raw_id", F.concat(F.lit("case-"), "raw_id").alias("case_id"), F.lit(3).alias("related"))
    k = F.col("k").cast("string")
    spans = posts.select("raw_id", "label", F.explode(F.sequence(F.lit(0), F.col("raw_id") % 9)).alias("k")).filter("k > 0").select("raw_id", F.col("k").cast("int").alias("start"), F.concat(k, F.lit("=e"), k).alias("evidence"), F.col("label").alias("risk"))
    slang = posts.filter("raw_id % 4 = 1").select("raw_id", F.concat(F.lit("s"), "raw_id").alias("term"), F.lit("m").alias("meaning"), F.col("label").alias("risk_category"))
    out = reports.report(posts, found, spans, slang, cases=cases)
    joined = lambda c, use, by=";": F.array_join(F.transform(c, use), by)
    return out.select(
        "raw_id", "title", "conclusion", joined("disposal_advice", lambda a: F.concat_ws(":", a["action"], a["priority"])).alias("advice"), "graph_summary", joined("evidence", lambda e: F.concat_ws(":", e["fragment"], e["risk_dimension"])).alias("evidence"),
        joined("entities", lambda e: F.concat_ws("=", e["type"], F.array_join(e["values"], ","))).alias("entities"), joined("slang_terms", lambda t: F.concat(t["term"], F.lit("="), t["meaning"], F.lit(":"), t["risk_category"])).alias("slang"),
    )


@query("WITH t AS (SELECT 'licensed' AS term, 'l' AS meaning UNION ALL SELECT 'reserved', '') SELECT doc_id AS id, term, CASE WHEN meaning <> '' THEN meaning ELSE substring(text, greatest(instr(text, term) - 20, 1), instr(text, term) + length(term) + 20 - greatest(instr(text, term) - 20, 1)) END AS meaning, lang AS risk_category FROM documents JOIN t ON contains(text, term)")
def slang_meanings(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = spark.createDataFrame([("licensed", "l"), ("reserved", "")], "term string, meaning string")
    return analysis.slang_meanings(table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "id"), terms, label="lang")


@query("SELECT doc_id AS raw_id, text, coalesce(lang, '') || '_s' AS label, regexp_matches(text, '[a-z]') AS has_url, doc_id % 4 AS evidence_count FROM documents")
def report_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("raw_id"), "text", F.col("lang").alias("label"), F.lit("s").alias("sub_label"))
    found = d.filter(F.rlike("text", F.lit("[a-z]"))).select("raw_id", F.lit("url").alias("entity_type"), F.lit("u").alias("entity_value"))
    spans = d.select("raw_id", F.explode(F.sequence(F.lit(0), F.col("raw_id") % 4)).alias("k")).filter("k > 0")
    return reports.report_samples(d, found, spans).select("raw_id", "text", "label", "has_url", "evidence_count")


@query("SELECT doc_id AS raw_id, string_agg(v, ',' ORDER BY o) AS domains FROM (SELECT doc_id, v, min(o) AS o FROM (SELECT doc_id, unnest(l) AS v, unnest(range(len(l))) AS o FROM (SELECT doc_id, regexp_extract_all(text, '(?:[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?\\.)+[a-zA-Z]{2,}') AS l FROM documents) a) b GROUP BY doc_id, v) c GROUP BY doc_id")
def entities_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "raw_id")
    e = analysis.entities(d, "raw_id", types=tuple(x for x in analysis.ENTITIES if x[0] == "domain"))
    return reports.entities_by_type(e).select("raw_id", F.array_join("values", ",").alias("domains"))


@query("WITH q AS (SELECT vec_id AS query_id, embedding AS e FROM embeddings) SELECT query_id, count(*) AS similar FROM q JOIN embeddings b ON q.query_id <> b.vec_id AND 1 - list_cosine_similarity(CAST(q.e AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) < 0.65 GROUP BY query_id")
def vector_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    near = vectors.within(e.withColumnRenamed("vec_id", "query_id"), e, 0.65)
    return near.groupBy("query_id").agg(F.count(F.lit(1)).alias("similar"))


@query("SELECT src, dst, count(*) AS together FROM (SELECT DISTINCT l_orderkey, l_returnflag || l_linestatus AS src FROM lineitem) a JOIN (SELECT DISTINCT l_orderkey, l_returnflag || l_linestatus AS dst FROM lineitem) b USING (l_orderkey) WHERE src < dst GROUP BY src, dst")
def edge_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("raw_id"), F.concat("l_returnflag", "l_linestatus").alias("value")).distinct().withColumn("ordinal", F.col("value"))
    return graph.cooccurrences(i).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("together"))
