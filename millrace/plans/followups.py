"""What follows an analysis: second passes, tools, evidence around entities, typed graph, cases and relations, comment threads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import analysis, answers, cleaning, followup, graph, reports, safety, vectors, warehouse
from ..sources import parsers
from .cases import case
from .operators import table

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


_DECISIONS = ("NEED_GRAPH_ANALYSIS", "NEED_STANDARD_ANALYSIS", "CONFIRMED_RISK")


@query(
    """WITH d AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'NEED_GRAPH_ANALYSIS' WHEN 1 THEN 'NEED_STANDARD_ANALYSIS' ELSE 'CONFIRMED_RISK' END AS decision, doc_id % 5 <> 0 AS auto FROM documents)
    SELECT doc_id, CASE WHEN auto AND decision = 'NEED_GRAPH_ANALYSIS' THEN '自动扩线研判' WHEN auto AND decision = 'NEED_STANDARD_ANALYSIS' THEN '自动标准研判' END AS mode,
      CASE WHEN auto AND decision = 'NEED_GRAPH_ANALYSIS' THEN true WHEN auto AND decision = 'NEED_STANDARD_ANALYSIS' THEN false END AS deep FROM d"""
)
def followup_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    o = followup.followup_options(F.get(F.array(*map(F.lit, _DECISIONS)), (i % 3).cast("int")), i % 5 != 0)
    return table(spark, sf_dir, "documents").select("doc_id", o["analysis_mode"].alias("mode"), o["enable_graph_expand"].alias("deep"))


@query(
    """WITH d AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '快速初筛' WHEN 1 THEN '分层研判' WHEN 2 THEN '标准' END AS mode, CASE WHEN doc_id % 7 <> 0 THEN doc_id % 2 = 0 END AS a, CASE WHEN doc_id % 11 <> 0 THEN doc_id % 3 = 0 END AS b FROM documents)
    SELECT doc_id, CASE WHEN mode LIKE '%快速%' OR mode LIKE '%初筛%' OR mode LIKE '%分层%' OR (a = false AND (b IS NULL OR b = false) AND a IS NOT NULL) THEN 'SCREENED' ELSE 'ANALYZED' END AS worker,
      CASE WHEN mode LIKE '%快速%' OR (a = false AND (b IS NULL OR b = false) AND a IS NOT NULL) THEN 'SCREENED' ELSE 'ANALYZED' END AS analysis FROM d"""
)
def target_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    mode = F.get(F.array(F.lit("快速初筛"), F.lit("分层研判"), F.lit("标准"), F.lit(None)), (i % 4).cast("int"))
    a, b = F.when(i % 7 != 0, i % 2 == 0), F.when(i % 11 != 0, i % 3 == 0)
    return table(spark, sf_dir, "documents").select("doc_id", *(followup.target_status(mode, a, a, b, a, who).alias(who) for who in ("worker", "analysis")))


_TYPES = ("wechat", "telegram", "crypto_wallet", "slang", "feature")
_TOOLS_SQL = "WITH d AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'wechat' WHEN 1 THEN 'telegram' WHEN 2 THEN 'crypto_wallet' WHEN 3 THEN 'slang' ELSE 'feature' END AS t, doc_id % 10 / 10.0 AS c FROM documents)"


def _typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", F.array(F.get(F.array(*map(F.lit, _TYPES)), (i % 5).cast("int"))).alias("entity_types"), (i % 10 / 10).alias("confidence"))


@query(_TOOLS_SQL + " SELECT doc_id, t = 'wechat' AS graph_8, t IN ('wechat', 'crypto_wallet') AS graph_9, t IN ('wechat', 'crypto_wallet', 'telegram') AS graph_12, t = 'slang' AS slang, c >= 0.6 AS similar_on FROM d")
def decide_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _typed(spark, sf_dir)
    for name, who in (("graph_8", "analysis"), ("graph_9", "expansion"), ("graph_12", "screening")):
        d = followup.with_tools(d, embedding=F.lit(True), who=who).withColumnRenamed("run_graph", name)
    return d.select("doc_id", "graph_8", "graph_9", "graph_12", F.col("run_slang").alias("slang"), F.col("run_similar").alias("similar_on"))


@query(_TOOLS_SQL + " SELECT doc_id, CASE WHEN c >= 0.9 THEN 'fast' WHEN c >= 0.7 AND t IN ('wechat', 'crypto_wallet', 'slang') THEN 'skip_model' ELSE 'full' END AS path FROM d")
def extraction_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _typed(spark, sf_dir).select("doc_id", followup.extraction_path(F.col("entity_types"), F.col("confidence")).alias("path"))


_MAIL = "[a-z0-9]+@[a-z]+"
_MAILS = f"SELECT doc_id, text, unnest(regexp_extract_all(text, '{_MAIL}')) AS v, unnest(range(len(regexp_extract_all(text, '{_MAIL}')))) AS o FROM documents"


def _mails(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("raw_id"), F.posexplode(F.regexp_extract_all("text", F.lit(f"({_MAIL})"), F.lit(1))).alias("ordinal", "entity_value"))
    return d.withColumns({"entity_type": F.when(F.col("ordinal") % 3 == 0, "qq").when(F.col("ordinal") % 3 == 1, "email").otherwise("other"), "context": F.lit("")})


@query(
    rf"""WITH m AS ({_MAILS}), s AS (SELECT doc_id, v, o, instr(text, v) - 1 AS p, CASE o % 3 WHEN 0 THEN 'qq' WHEN 1 THEN 'email' ELSE 'other' END AS t,
      substring(text, greatest(instr(text, v) - 30, 1), instr(text, v) + length(v) + 30 - greatest(instr(text, v) - 30, 1)) AS e FROM m),
    n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, t = 'qq', left(e, 40) ORDER BY o) AS k FROM s)
    SELECT doc_id AS raw_id, CAST(p AS INTEGER) AS "start", CAST(p + length(v) AS INTEGER) AS "end", regexp_replace(e, '^\s+|\s+$', '', 'g') AS text, CASE t WHEN 'qq' THEN '站外导流' ELSE '实体线索' END AS risk, '提取到' || t || '实体: ' || v AS reason FROM n WHERE k = 1"""
)
def entity_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "raw_id")
    return answers.entity_evidence(_mails(spark, sf_dir), d, "raw_id").select("raw_id", "start", "end", "text", "risk", "reason")


@query("SELECT doc_id AS id, n, s AS \"start\", e AS \"end\", t AS text, r AS risk, c AS confidence, m AS method FROM documents, (VALUES (0, 0, 6, '保证金先缴纳', '诈骗', 0.92::DOUBLE, 'rule'), (1, 9, 14, 'wx123', '站外导流', 0.9::DOUBLE, 'entity_context')) v(n, s, e, t, r, c, m) WHERE doc_id % 3 = 0")
def composed_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    d = table(spark, sf_dir, "documents").select(i.alias("id"), F.when(i % 3 == 0, "保证金先缴纳 加 wx123").when(i % 3 == 1, "").alias("text"), F.when(i % 3 < 2, "诈骗").alias("label"))
    entities = F.array(*(F.struct(*(F.lit(x).alias(c) for x, c in zip(e, ("entity_type", "entity_value", "ordinal", "context"), strict=True))) for e in (("wechat", "wx123", 0, "wx123"), ("wechat", "", 1, ""), ("phone", "gone", 2, ""))))
    found = d.filter("id % 3 = 0").select("id", F.inline(entities))
    out = answers.composed_evidence(d, found)
    return out.withColumns({"start": F.col("start").cast("int"), "end": F.col("end").cast("int")})


_PARTS = "SELECT l_orderkey AS raw_id, CASE l_partkey % 5 WHEN 0 THEN 'wechat' WHEN 1 THEN 'url' WHEN 2 THEN 'phone' WHEN 3 THEN 'tool' ELSE 'odd' END AS t, l_partkey::VARCHAR AS v FROM lineitem"


def _part_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("l_partkey")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("raw_id"), F.get(F.array(*map(F.lit, ("wechat", "url", "phone", "tool", "odd"))), (i % 5).cast("int")).alias("entity_type"), i.cast("string").alias("entity_value"))


@query(
    f"""WITH e AS (SELECT DISTINCT * FROM ({_PARTS}) x) SELECT raw_id::VARCHAR AS src, CASE t WHEN 'wechat' THEN 'USES_ACCOUNT' WHEN 'url' THEN 'PROMOTES_LINK' WHEN 'phone' THEN 'USES_CONTACT' WHEN 'tool' THEN 'PROMOTES_TOOL' ELSE 'MENTIONS' END AS relation,
      CASE t WHEN 'wechat' THEN 'Account' WHEN 'url' THEN 'Link' WHEN 'tool' THEN 'Tool' ELSE 'Contact' END AS label, v AS dst FROM e UNION ALL SELECT t || ':' || v, 'EXTRACTED_FROM', 'Intel', raw_id::VARCHAR FROM e"""
)
def typed_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.typed_edges(_part_entities(spark, sf_dir))


@query(f"SELECT DISTINCT CASE t WHEN 'wechat' THEN 'Account' WHEN 'url' THEN 'Link' WHEN 'tool' THEN 'Tool' ELSE 'Contact' END AS label, v AS value, t AS type, t || ':' || v AS uuid FROM ({_PARTS}) e")
def entity_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.entity_nodes(_part_entities(spark, sf_dir))


@query("SELECT doc_id AS raw_id, source AS platform, left(coalesce(text, ''), 200) AS content_preview FROM documents")
def intel_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.intel_nodes(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("raw_id"), F.col("source").alias("platform"), "text"))


_DRAWN = f"WITH e AS (SELECT DISTINCT * FROM ({_PARTS}) x WHERE v LIKE '%7%'), g AS (SELECT raw_id::VARCHAR AS f, v, 'EXTRACTED_FROM' AS l, t, t AS grp FROM e UNION ALL SELECT raw_id::VARCHAR, v, 'MENTIONS', t, 'contact' FROM e WHERE t = 'odd')"


@query(_DRAWN + ' SELECT f AS "from", v AS "to", l AS label FROM g')
def subgraph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drawn(spark, sf_dir)[1]


@query(_DRAWN + ", n AS (SELECT f AS id, 0 AS k, '' AS label, 'intel' AS grp FROM g UNION ALL SELECT v, 1, t || ':' || v, grp FROM g) SELECT id, arg_min(label, (k, label, grp)) AS label, arg_min(grp, (k, label, grp)) AS \"group\" FROM n GROUP BY id")
def subgraph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drawn(spark, sf_dir)[0]


def _drawn(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    posts = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("raw_id"), F.lit("").alias("text"))
    return graph.subgraph(posts, _part_entities(spark, sf_dir), "7", None)


@query("SELECT DISTINCT 'Account' AS labels, 'USES_ACCOUNT' AS relation, '微信号' AS clue_type, o_custkey::VARCHAR AS clue_value, CAST(1 + o_orderkey % 2 AS INTEGER) AS hops FROM orders WHERE o_orderkey % 3 > 0")
def neighbour_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, o = F.col("o_orderkey"), table(spark, sf_dir, "orders")
    rows = o.select(F.when(i % 3 > 0, F.array(F.lit("Account"))).otherwise(F.array(F.lit("Intel"))).alias("labels"), F.lit("wechat").alias("type"), F.col("o_custkey").cast("string").alias("value"), F.lit(None).cast("string").alias("uuid"), F.lit(None).cast("bigint").alias("raw_id"), F.lit("USES_ACCOUNT").alias("relation"), (1 + i % 2).cast("int").alias("hops"))
    return graph.neighbour_table(rows)


@query("WITH p AS (SELECT o_custkey AS m, l_suppkey AS t FROM orders JOIN lineitem ON l_orderkey = o_orderkey), n AS (SELECT m, t, count(*) AS n FROM p GROUP BY m, t) SELECT x.m AS a, y.m AS b, CAST(sum(x.n * y.n) AS BIGINT) AS shared FROM n x JOIN n y ON x.t = y.t AND x.m < y.m GROUP BY x.m, y.m HAVING sum(x.n * y.n) >= 8")
def gang_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return graph.gang_paths(pairs.select(F.col("o_custkey").alias("member"), F.col("l_suppkey").alias("target")), 8)


@query("WITH c AS (SELECT user_id, arg_max(event_type, (ts, event_type)) AS s FROM events WHERE event_type <> 'view' GROUP BY user_id) SELECT c_custkey, coalesce(s, c_mktsegment) AS c_mktsegment, c_nationkey FROM customer LEFT JOIN c ON user_id = c_custkey")
def changed_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))
    of = lambda name: e.select(F.col("user_id").alias("c_custkey"), F.lit(name).alias("field"), F.col("event_type").alias("value"), "at")
    changes = of("c_mktsegment").filter("value <> 'view'").union(of("c_nationkey"))
    return warehouse.with_changes(table(spark, sf_dir, "customer"), changes, "c_custkey", ("c_mktsegment",)).select("c_custkey", "c_mktsegment", "c_nationkey")


@query("SELECT l_orderkey AS src_entity_id, l_partkey AS dst_entity_id, 'CO_OCCURS' AS relation_type, 'neo4j_sync' AS relation_source, CAST(NULL AS BIGINT) AS evidence_raw_id, coalesce(nullif(l_quantity, 1), 1)::DOUBLE AS confidence FROM lineitem")
def relation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("src_entity_id"), F.col("l_partkey").alias("dst_entity_id"), F.lit("CO_OCCURS").alias("relation_type"), F.nullif(F.col("l_quantity").cast("double"), F.lit(1.0)).alias("confidence"))
    return warehouse.relation_rows(new)


def _clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("raw_id"), F.when(F.col("doc_id") % 3 > 0, F.md5("text")).alias("simhash"))


@query("SELECT doc_id AS id, md5(text) AS simhash FROM documents WHERE doc_id % 3 > 0 AND text IS NOT NULL ORDER BY doc_id DESC LIMIT 5000")
def recent_simhashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warehouse.recent_simhashes(_clean(spark, sf_dir))


@query("WITH w AS (SELECT min(md5(text)) AS simhash FROM documents WHERE doc_id % 3 > 0) SELECT doc_id AS id, doc_id AS raw_id, simhash, source AS source_platform, text AS content_raw FROM documents JOIN w ON md5(text) = simhash WHERE doc_id % 3 > 0 ORDER BY doc_id LIMIT 5")
def rows_by_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("platform"), F.col("text").alias("content_raw"))
    wanted = table(spark, sf_dir, "documents").filter("doc_id % 3 > 0").agg(F.min(F.md5("text"))).first()[0]
    return warehouse.by_simhash(_clean(spark, sf_dir), raw, wanted)


@query(
    """WITH w AS (SELECT vec_id % 10 AS id, 'w' || vec_id AS word, embedding AS e FROM embeddings WHERE vec_id % 100 = 0), t AS (SELECT 't' || vec_id AS term, embedding AS e FROM embeddings WHERE vec_id % 100 <> 0),
    s AS (SELECT id, word, term, list_cosine_similarity(CAST(w.e AS DOUBLE[]), CAST(t.e AS DOUBLE[])) AS c FROM w, t), b AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY c DESC, term) AS k FROM s)
    SELECT id, word, term AS similar_to FROM b WHERE k = 1 AND c >= 0.3"""
)
def term_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, i = table(spark, sf_dir, "embeddings"), F.col("vec_id")
    words = e.filter(i % 100 == 0).select((i % 10).alias("id"), F.concat(F.lit("w"), i).alias("word"), "embedding")
    return vectors.term_variants(words, e.filter(i % 100 != 0).select(F.concat(F.lit("t"), i).alias("term"), "embedding"), 0.3).drop("similarity")


_XHS = '{"success":true,"data":{"comments":[{"id":"TURN","content":"c","like_count":2,"create_time":5,"user_info":{"user_id":"u","nickname":"n"},"sub_comments":[{"id":"2","content":"r","user_info":null,"target_comment":{"user_info":{"nickname":"n"}}}]}]}}'
_DOUYIN = '{"comments":[{"cid":7,"text":"c","digg_count":3,"create_time":9,"user":{"uid":1,"nickname":"TURN"},"reply_comment":[{"cid":8,"text":"r","digg_count":1,"user":{"uid":2,"nickname":"b"}}]},{"cid":9,"reply_comment":null}]}'
_COLUMNS = "v(id, author_uid, author_username, content, like_count, reply_to, created_at, type)"


def _answers(spark: SparkSession, sf_dir: str, *answers) -> DataFrame:
    """(json): the platform's answers, of which each conversation's turn brings one, about the turn itself where it has a comment."""
    c = table(spark, sf_dir, "conversations")
    picked = F.get(F.array(*(F.lit(x).cast("string") for x in answers)), F.pmod("turn", F.lit(len(answers))).cast("int"))
    return c.select(F.replace(picked, F.lit("TURN"), F.concat_ws("-", "conv_id", "turn")).alias("json"))


@query(f"SELECT replace(id, 'TURN', conv_id || '-' || turn) AS id, author_uid, author_username, content, like_count::BIGINT AS like_count, reply_to, created_at, type FROM conversations, (VALUES ('TURN', 'u', 'n', 'c', 2, '', '5', 'comment'), ('2', '', '', 'r', 0, 'n', '', 'reply')) {_COLUMNS} WHERE turn % 4 = 0")
def xiaohongshu_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsers.xiaohongshu_comments(_answers(spark, sf_dir, _XHS, '{"success":false}', "no json", None))


@query(f"SELECT id, author_uid, replace(author_username, 'TURN', conv_id || '-' || turn) AS author_username, content, like_count::BIGINT AS like_count, reply_to, created_at, type FROM conversations, (VALUES ('7', '1', 'TURN', 'c', 3, '', '9', 'comment'), ('8', '2', 'b', 'r', 1, '', '', 'reply'), ('9', '', '', '', 0, '', '', 'comment')) {_COLUMNS} WHERE turn % 3 = 0")
def douyin_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsers.douyin_comments(_answers(spark, sf_dir, _DOUYIN, "{}", None))


@query("SELECT event_type, count(*) FILTER (WHERE value >= 5) AS items, count(*) FILTER (WHERE value < 5) AS errors, round(s, 1) AS elapsed_sec, round(count(*) FILTER (WHERE value >= 5) / s, 4) AS items_per_sec FROM events, (SELECT epoch(max(ts)) - epoch(min(ts)) AS s FROM events) t GROUP BY event_type, s")
def throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.throughput(table(spark, sf_dir, "events"), "event_type", "ts", F.col("value") < 5)


@query("SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS types, string_agg(DISTINCT strftime(ts, '%Y-%m-%d'), ',' ORDER BY strftime(ts, '%Y-%m-%d')) AS days FROM events GROUP BY user_id")
def collected_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_type", F.array(F.date_format("ts", "yyyy-MM-dd")).alias("days"))
    return analysis.field_sets(e, "user_id", "event_type", "days").select("user_id", F.array_join("event_type", ",").alias("types"), F.array_join("days", ",").alias("days"))


@query("SELECT doc_id AS id, CASE WHEN doc_id % 2 = 1 THEN '出售接码平台💰 加微信 ' || coalesce(text, '') ELSE coalesce(text, '') END AS original, doc_id::INTEGER % 2 AS emoji_count FROM documents")
def cleaning_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, text = F.col("doc_id"), F.coalesce("text", F.lit(""))
    raw = F.when(i % 2 == 1, F.concat(F.lit("出售接码平台💰 加微信 "), text)).otherwise(F.col("text"))
    posts = table(spark, sf_dir, "documents").select(i.alias("id"), F.lit("weibo").alias("platform"), raw.alias("content_raw"), F.lit("a").alias("author_username"), F.when(i % 2 == 1, "接码").alias("source_keyword"))
    return cleaning.preview(posts).select("id", "original", "emoji_count")


case("exit_reply_cases", safety.exit_reply, value={"pattern:付款": "不好意思，我现在不方便付款，回头再说吧。", "要求身份证": "我再考虑考虑吧，谢谢。", "其他": "好的，我了解一下，有需要再联系你。", "": "好的，我了解一下，有需要再联系你。"})
case("safe_reply_cases", safety.safe_reply, value={"好的马上转账": "我再考虑考虑吧，谢谢。", "在吗": "在吗"})
case("contains_emoji_cases", T.contains_emoji, value={"a💰": "true", "abc": "false", "☀": "true", "": "false"})
case("excessive_emoji_cases", T.excessive_emojis, value={"💰💰a": "true", "💰ab": "false", "": "false", " \n": "false"})
