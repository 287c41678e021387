"""Queries that apply the engine's own operators to the tables, with SQL that says the same where it can."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.rules import DEFAULT, ENTITIES, LEGACY_STATUS, STATUSES, Category
from ..operators import analysis, cleaning, dedup, graph, vectors, warehouse

#: The supplied corpus is invented prose in Latin script: a pack of its frequent pieces puts the same operators to work on it.
CORPUS = replace(
    DEFAULT,
    hard_noise=("All rights", "Released under"), false_contexts=(("onthe", "thonthe"),), signals=("tionth", "erthat", "licensed", "ndtion"),
    strong=("licens", "idiot", "@"), weak=("that ", "with "), actions=("Released", "thereon"), warnings=("rights", "were "), contacts=(r"[0-9]{3}\.[0-9]{2,3}\.", "[a-z]@[a-z]"),
    police=("rights reserved",), victim=("stupid",), media=("edth", "wher", "anat"), actors=("onon", "erer"), high_risk=("licensed", "released", "AKIA"),
    categories=(Category("license", ("[Ll]icensed? .{0,12}under",), ("Released", "rights reserved"), (), (("work", "General"),)), Category("contact", ("[a-z0-9]+@[a-z]+",), (), ("akia",), (("example", "com"),)), Category("prose", ("(tion|ment).{0,4}(the|la)",), ("chen",), (), ())),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def any_sql(c: str, words) -> str:
    return "(" + " OR ".join(f"contains({c}, {q(w)})" for w in words) + ")"


def count_sql(c: str, words) -> str:
    return "(" + " + ".join(f"CAST(contains({c}, {q(w)}) AS INTEGER)" for w in words) + ")"


QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def _text(name: str, use, sql: str, of: str = "documents", key: str = "doc_id", column: str = "text") -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(spark, sf_dir, of).select(key, use(F.col(column)).alias("result"))

    QUERIES[name], ORACLE[name] = run, f"SELECT {key}, {sql} AS result FROM {of}"


def _html_sql(c: str) -> str:
    from ..functions.rules import HTML_ENTITIES

    for a, b in HTML_ENTITIES:
        c = f"replace({c}, {q(a)}, {q(b)})"
    return f"regexp_replace(regexp_replace({c}, '<[^>]+>', ' ', 'g'), '&[a-zA-Z]+;|&#[0-9]+;', ' ', 'g')"


def _clean_html_sql(c: str) -> str:
    for p, by in ((r"(?i)<br\s*/?>|</p>|</div>", "\n"), (r'<img[^>]*alt="([^"]*)"[^>]*>', r"[\1]"), (r"<img[^>]*>", "[图片]"), (r"<a[^>]*>([^<]*)</a>", r"\1"), (r"<[^>]+>", " ")):
        c = f"regexp_replace({c}, {q(p)}, {q(by)}, 'g')"
    for a, b in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"')):
        c = f"replace({c}, {q(a)}, {q(b)})"
    return f"trim(regexp_replace({c}, '\\s+', ' ', 'g'))"


_text("norm_whitespace", T.normalize_whitespace, r"trim(regexp_replace(text, '\s+', ' ', 'g'))")
_text("norm_unicode", T.normalize_unicode, f"translate(replace(text, chr(13) || chr(10), chr(10)), {q(T.FULL_WIDTH[0])}, {q(T.FULL_WIDTH[1])})")
_text("url_simplify", T.simplify_urls, r"regexp_replace(url, 'https?://(?:www\.)?([^/?#\s]*)\S*', '[链接:\1]', 'g')", "pages", "page_id", "url")
_text("html_plain", T.html_to_plain, _html_sql("html"), "pages", "page_id", "html")
_text("html_clean", T.clean_html, _clean_html_sql("html"), "pages", "page_id", "html")
_text("defang_url", T.defang_url, r"replace(replace(regexp_replace(regexp_replace(url, '(?i)^https?', 'hxxp'), '(?i)^ftp', 'fxp'), '://', '[://]'), '.', '[.]')", "pages", "page_id", "url")
_text("refang_url", lambda c: T.refang(T.defang_url(c)), "regexp_replace(url, '^https', 'http')", "pages", "page_id", "url")
_text("defang_ip", T.defang_ip, r"regexp_replace(text, '\b(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})\b', '\1[.]\2[.]\3[.]\4', 'g')")
_text("text_preview", lambda c: T.preview(c, 150), "CASE WHEN length(trim(replace(text, chr(10), ' '))) > 150 THEN left(trim(replace(text, chr(10), ' ')), 150) || '...' ELSE trim(replace(text, chr(10), ' ')) END")
_text("priority_mark", lambda c: cleaning.priority(c, CORPUS), f"CASE WHEN {any_sql('lower(text)', CORPUS.high_risk)} THEN 'high' ELSE 'normal' END")
_text("low_value", lambda c: F.coalesce(cleaning.low_value(c), F.lit("")), "CASE WHEN regexp_full_match(trim(text), '[^一-鿿]{0,5}') THEN '无中文字符且过短' WHEN regexp_full_match(trim(text), '[?？]+') THEN '纯问号' WHEN regexp_full_match(trim(text), '[!！.。]+') THEN '纯标点符号' WHEN length(trim(text)) > 9 AND replace(trim(text), left(trim(text), 1), '') = '' THEN '单字符重复刷屏' ELSE '' END")
_text("ad_noise", lambda c: F.coalesce(cleaning.ad_noise(c, CORPUS), F.lit("")), f"CASE WHEN {any_sql('text', CORPUS.signals)} OR (contains(text, 'onthe') AND regexp_matches(text, 'thonthe')) THEN '' WHEN contains(text, 'All rights') THEN 'All rights' WHEN contains(text, 'Released under') THEN 'Released under' ELSE '' END")

ROLE_SQL = f"CASE WHEN {any_sql('text', CORPUS.police)} THEN 'police' WHEN {any_sql('text', CORPUS.victim)} THEN 'victim' WHEN {count_sql('text', CORPUS.media)} >= 2 THEN 'media' WHEN {any_sql('text', CORPUS.actors)} THEN 'actor' ELSE 'unknown' END"
_text("content_role", lambda c: cleaning.content_role(c, pack=CORPUS), ROLE_SQL)

_NOISE = f"""CAST(greatest(0, least(1, CASE WHEN length(text) < 5 THEN CASE WHEN {any_sql('text', CORPUS.signals)} THEN 0.15 ELSE 0.5 END WHEN length(text) < 15 AND NOT {any_sql('text', CORPUS.signals)} THEN 0.2 ELSE 0 END
 + CASE WHEN length(replace(replace(text, ' ', ''), chr(10), '')) = 0 THEN 0 ELSE 0.3 END
 + CASE WHEN regexp_matches(text, '[!！?？]{{3,}}') THEN 0.15 ELSE 0 END + CASE WHEN contains(text, 'http') THEN 0.05 ELSE 0 END + CASE WHEN regexp_matches(text, '@[\\w\\p{{L}}]') THEN 0.05 ELSE 0 END
 - CASE WHEN {count_sql('text', CORPUS.signals)} >= 3 THEN 0.15 WHEN {count_sql('text', CORPUS.signals)} >= 1 THEN 0.05 ELSE 0 END
 + CASE WHEN regexp_matches(text, '[一-鿿a-zA-Z0-9]') THEN 0 ELSE 0.6 END)) AS DOUBLE)"""
_text("noise_score", lambda c: cleaning.noise_score(c, CORPUS).cast("double"), _NOISE)


@query(
    f"""WITH h AS (SELECT doc_id, text, {ROLE_SQL} AS role, {count_sql('text', CORPUS.strong)} AS s, {count_sql('text', CORPUS.weak)} AS w, {count_sql('text', CORPUS.actions)} AS a, {count_sql('text', CORPUS.warnings)} AS n,
      CAST(regexp_matches(text, '[0-9]{{3}}\\.[0-9]{{2,3}}\\.') AS INTEGER) + CAST(regexp_matches(text, '[a-z]@[a-z]') AS INTEGER) AS k, length(regexp_replace(text, '\\s+', '', 'g')) AS m FROM documents),
    p AS (SELECT *, least(s * 28, 70) + least(a * 18, 45) + least(w * 10, 20) + CASE WHEN k > 0 THEN 45 ELSE 0 END + CASE WHEN contains(text, 'tion') AND (s > 0 OR a > 0 OR k > 0) THEN 8 ELSE 0 END AS x FROM h),
    r AS (SELECT *, CASE WHEN role IN ('police', 'media') AND k = 0 AND a = 0 THEN 1 WHEN m <= 14 AND w > 0 AND s = 0 AND a = 0 AND k = 0 THEN 2 WHEN s = 0 AND a = 0 AND k = 0 THEN 3 WHEN s = 0 AND k = 0 AND x < 28 THEN 4 ELSE 5 END AS c, CASE WHEN n > 0 AND k = 0 AND a = 0 THEN x - 25 ELSE x END AS y FROM p)
    SELECT doc_id, c = 5 AND (y >= 28 OR k > 0) AS relevant, CAST(CASE c WHEN 1 THEN 12 WHEN 2 THEN 10 WHEN 3 THEN 8 WHEN 4 THEN greatest(0, least(100, x)) ELSE greatest(0, least(100, y)) END AS DOUBLE) / 100 AS score FROM r"""
)
def relevance_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").withColumn("role", cleaning.content_role(F.col("text"), pack=CORPUS))
    d = d.withColumn("r", cleaning.relevance(F.col("text"), F.col("role"), F.lit("tion"), CORPUS))
    return d.select("doc_id", "r.relevant", F.col("r.score").cast("double").alias("score"))


@query(
    """SELECT doc_id, CASE WHEN regexp_matches(text, '[Ll]icensed? .{0,12}under') OR contains(text, 'Released') OR contains(text, 'rights reserved') OR (contains(text, 'work') AND contains(text, 'General')) THEN 'license'
      WHEN regexp_matches(text, '[a-z0-9]+@[a-z]+') OR contains(text, 'akia') OR (contains(text, 'example') AND contains(text, 'com')) THEN 'contact' WHEN regexp_matches(text, '(tion|ment).{0,4}(the|la)') OR contains(text, 'chen') THEN 'prose' ELSE '作弊' END AS label,
      CASE WHEN regexp_matches(text, '[Ll]icensed? .{0,12}under') OR contains(text, 'Released') OR contains(text, 'rights reserved') THEN 'license' WHEN contains(text, 'work') AND contains(text, 'General') THEN '高危组合'
      WHEN regexp_matches(text, '[a-z0-9]+@[a-z]+') OR contains(text, 'akia') THEN 'contact' WHEN contains(text, 'example') AND contains(text, 'com') THEN '高危组合' WHEN regexp_matches(text, '(tion|ment).{0,4}(the|la)') OR contains(text, 'chen') THEN 'prose' ELSE '未分类' END AS sub_label FROM documents"""
)
def classify_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").withColumn("c", analysis.classify(F.col("text"), CORPUS)).select("doc_id", "c.label", "c.sub_label")


@query()
def clean_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    platforms = F.array(*map(F.lit, cleaning.PLATFORMS))
    posts = d.select(F.col("doc_id").alias("id"), F.get(platforms, (F.col("doc_id") % len(cleaning.PLATFORMS)).cast("int")).alias("platform"), F.col("text").alias("content_raw"), F.col("source").alias("author_username"), F.lit("tion").alias("source_keyword"))
    return cleaning.clean(posts, CORPUS).select("id", "platform", "is_noise", "is_media_only", "content_role", "noise_score", "relevance_score", "priority", "content_md5")


_ENTITY_TYPES = ENTITIES
_ENTITY_SQL = " UNION ALL ".join(f"SELECT doc_id AS id, '{t}' AS entity_type, unnest(regexp_extract_all(text, {q(p)}, {g})) AS entity_value FROM documents" for t, p, g in _ENTITY_TYPES)


def _entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.entities(table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "id"), types=_ENTITY_TYPES)


@query(f"SELECT entity_type, count(*) AS matches, count(DISTINCT entity_value) AS distinct_values FROM ({_ENTITY_SQL}) e GROUP BY entity_type ORDER BY matches DESC, entity_type LIMIT 15")
def entity_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entities(spark, sf_dir).groupBy("entity_type").agg(F.count(F.lit(1)).alias("matches"), F.count_distinct("entity_value").alias("distinct_values")).orderBy(F.desc("matches"), "entity_type").limit(15)


@query(f"SELECT id, entity_type, entity_value FROM ({_ENTITY_SQL}) e GROUP BY ALL")
def distinct_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.first_entities(_entities(spark, sf_dir)).select("id", "entity_type", "entity_value")


@query("WITH t AS (SELECT 'licensed' AS term UNION ALL SELECT 'Released' UNION ALL SELECT 'reserved' UNION ALL SELECT 'AKIA') SELECT doc_id AS id, term FROM documents JOIN t ON contains(text, term)")
def dictionary_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = spark.createDataFrame([("licensed", "l"), ("Released", "r"), ("reserved", "s"), ("AKIA", "k")], "term string, meaning string")
    return analysis.dictionary_entities(table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "id"), terms).select("id", "term")


@query("SELECT p.doc_id AS id, b.item_id FROM documents p JOIN benchmark b ON contains(p.text, b.text)")
def benchmark_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = table(spark, sf_dir, "benchmark").select(F.col("text").alias("term"), F.col("item_id").alias("meaning"))
    return analysis.dictionary_entities(table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "id"), terms).select("id", F.col("meaning").alias("item_id"))


@query(f"SELECT doc_id AS id, e AS entity_value, substring(text, greatest(instr(text, e) - 20, 1), instr(text, e) + length(e) + 20 - greatest(instr(text, e) - 20, 1)) AS context FROM (SELECT DISTINCT doc_id, text, unnest(regexp_extract_all(text, {q(ENTITIES[4][1])})) AS e FROM documents) x")
def entity_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "id")
    return analysis.entities(d, types=(ENTITIES[4],)).select("id", "entity_value", "context").distinct()


_EVIDENCE = (("license", ("[Ll]icensed? .{0,12}under", "rights reserved")), ("prose", ("tion.{0,3}the", "thethe")))
_PATTERNS = ", ".join(f"({o}, {q(risk)}, {q(p)})" for o, (risk, p) in enumerate((risk, p) for risk, ps in _EVIDENCE for p in ps))


# a match begins behind the pieces and the matches before it; of all in order, each stays that meets none that stays
@query(
    f"""WITH c AS (SELECT doc_id, label FROM ({ORACLE["classify_first_match"]}) x), p(o, risk, pattern) AS (VALUES {_PATTERNS}),
    h AS (SELECT doc_id, o, risk, regexp_extract_all(text, pattern) AS hits, regexp_split_to_array(text, pattern) AS pieces FROM documents JOIN c USING (doc_id) JOIN p ON risk = label OR label NOT IN ('license', 'prose')),
    k AS (SELECT *, unnest(generate_series(1, len(hits))) AS k FROM h),
    m AS (SELECT doc_id, o, risk, hits[k] AS t, (list_sum([length(x) FOR x IN pieces[1:k]]) + coalesce(list_sum([length(x) FOR x IN hits[1:k - 1]]), 0))::BIGINT AS s FROM k),
    l AS (SELECT doc_id, list([{{'s': s, 'e': s + length(t), 't': t, 'r': risk}}] ORDER BY o, s) AS l FROM m GROUP BY doc_id),
    f AS (SELECT doc_id, unnest(list_reduce(l, lambda kept, x: CASE WHEN len(list_filter(kept, lambda y: x[1].s <= y.e AND x[1].e >= y.s)) > 0 THEN kept ELSE list_concat(kept, x) END)) AS e FROM l)
    SELECT doc_id, e.s AS "start", e.e AS "end", e.t AS evidence, e.r AS risk FROM f"""
)
def evidence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    pack = replace(CORPUS, evidence=_EVIDENCE)
    d = table(spark, sf_dir, "documents").withColumn("label", analysis.classify(F.col("text"), CORPUS)["label"])
    return analysis.evidence(d, "doc_id", "text", "label", pack)


_SCORES = """e AS (SELECT doc_id, doc_id % 5 AS contacts, doc_id % 4 AS links, doc_id % 3 AS tools, doc_id % 6 AS slang, doc_id % 7 AS related, CASE WHEN doc_id % 4 = 0 THEN '诈骗' ELSE '引流' END AS label, CAST(CASE WHEN doc_id % 2 = 0 THEN 0.95 ELSE 0.30 END AS DECIMAL(18,4)) AS confidence FROM documents),
 p AS (SELECT *, round(least(1.0, CASE WHEN label = '诈骗' THEN CAST(confidence * 1.1 AS DECIMAL(18,8)) ELSE confidence END) * 0.5, 4) + round(least(1.0, contacts * 0.30) * 0.15, 4) + round(least(1.0, links * 0.35) * 0.12, 4) + round(least(1.0, tools * 0.5) * 0.08, 4) + round(least(1.0, slang * 0.25) * 0.10, 4) + round(least(1.0, related * 0.2) * 0.05, 4) AS s FROM e),
 r AS (SELECT *, CAST(least(1.0, s) AS DOUBLE) AS risk_score FROM p)"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    d = table(spark, sf_dir, "documents").select("doc_id", (i % 5).alias("contacts"), (i % 4).alias("links"), (i % 3).alias("tools"), (i % 6).alias("slang"), (i % 7).alias("related"), F.when(i % 4 == 0, "诈骗").otherwise("引流").alias("label"), F.when(i % 2 == 0, F.lit("0.95")).otherwise("0.30").cast("decimal(18,4)").alias("confidence"))
    return analysis.risk_score(d)


@query(f"WITH {_SCORES} SELECT doc_id, risk_score, CASE WHEN risk_score >= 0.85 THEN 'critical' WHEN risk_score >= 0.65 THEN 'high' WHEN risk_score >= 0.35 THEN 'normal' ELSE 'low' END AS risk_level FROM r")
def risk_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("doc_id", F.col("risk_score").cast("double").alias("risk_score"), "risk_level")


@query(
    f"""WITH {_SCORES}, l AS (SELECT *, risk_score >= 0.65 AS high, contacts > 2 AS clue_type, doc_id % 9 AS candidates, links AS evidence FROM r)
    SELECT doc_id, CASE WHEN clue_type AND (risk_score >= 0.55 OR high) THEN 'NEED_GRAPH_ANALYSIS' WHEN candidates = 1 THEN 'NEED_STANDARD_ANALYSIS' WHEN risk_score >= 0.72 AND confidence >= 0.85 AND evidence > 0 THEN 'CONFIRMED_RISK'
      WHEN risk_score >= 0.45 OR high OR (risk_score >= 0.2 AND (clue_type OR evidence > 0)) THEN 'NEED_STANDARD_ANALYSIS' WHEN risk_score < 0.2 AND NOT clue_type AND evidence = 0 THEN 'LOW_RISK_ARCHIVED' ELSE 'SCREENED_REVIEW' END AS decision FROM l"""
)
def screen_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _scored(spark, sf_dir).withColumns({"method": F.lit("keyword"), "entity_types": F.when(F.col("contacts") > 2, F.array(F.lit("phone"))).otherwise(F.array(F.lit("slang"))), "candidates": (F.col("doc_id") % 9 == 1).cast("int"), "evidence": F.col("links")})
    return analysis.screen(d).select("doc_id", "decision")


_SIM = "s AS (SELECT doc_id, CASE WHEN len(regexp_extract_all(text, '[a-zA-Z0-9]+')) > 0 THEN regexp_extract_all(text, '[a-zA-Z0-9]+') ELSE [text] END AS ts FROM documents), u AS (SELECT doc_id, CAST('0x' || substr(md5(unnest(ts)), 1, 16) AS UBIGINT) AS h FROM s), g AS (SELECT doc_id, count(*) AS n, " + ", ".join(f"sum((h >> {i}) & 1) AS b{i}" for i in range(64)) + " FROM u GROUP BY doc_id), f AS (SELECT doc_id, " + " | ".join(f"(CASE WHEN 2 * b{i} > n THEN CAST(1 AS UBIGINT) << {i} ELSE CAST(0 AS UBIGINT) END)" for i in range(64)) + " AS h FROM g)"


@query(f"WITH {_SIM} SELECT doc_id, '0x' || lower(to_hex(h)) AS simhash FROM f")
def simhash64(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.simhash_hex(T.simhash64(F.col("text"))).alias("simhash"))


_NEAR = f"WITH {_SIM}, c AS (SELECT h, min(doc_id) AS doc_id FROM f GROUP BY h), p AS (SELECT a.h AS x, b.h AS y, least(a.doc_id, b.doc_id) AS id_a, greatest(a.doc_id, b.doc_id) AS id_b, CAST(bit_count(xor(a.h, b.h)) AS INTEGER) AS distance FROM c a JOIN c b ON a.h < b.h AND bit_count(xor(a.h, b.h)) <= 3 AND length(to_hex(a.h)) = length(to_hex(b.h)))"


def _hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), T.simhash64(F.col("text")).alias("simhash"))


@query(f"{_NEAR} SELECT id_a, id_b, distance FROM p UNION ALL SELECT c.doc_id, f.doc_id, 0 FROM f JOIN c USING (h) WHERE f.doc_id <> c.doc_id")
def near_dup_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.similar_pairs(_hashed(spark, sf_dir))


@query(f"{_NEAR} SELECT f.doc_id AS id, c.doc_id AS class_id, (SELECT count(*) FROM p WHERE p.x = f.h OR p.y = f.h) AS links FROM f JOIN c USING (h)")
def near_dup_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.classes(_hashed(spark, sf_dir))


# the fold itself, a document at a time: `seen` has the remembered hashes in order, each with its authors and their first documents
_AUTHORS = f"""WITH RECURSIVE {_SIM},
d AS MATERIALIZED (SELECT row_number() OVER (ORDER BY doc_id) AS i, doc_id, h, CASE WHEN length(text) < 30 THEN 0 WHEN length(text) < 80 THEN 1 ELSE 3 END AS t, CAST(doc_id % 37 AS VARCHAR) AS a, doc_id % 11 = 0 AS noise, left(text, 80) AS quote FROM documents JOIN f USING (doc_id)),
w(i, id, dup_type, similar_to, similar_note, seen) AS (
  SELECT CAST(0 AS BIGINT), CAST(NULL AS BIGINT), '', CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), CAST([] AS STRUCT(h UBIGINT, a VARCHAR[], ids BIGINT[], quotes VARCHAR[])[])
  UNION ALL
  SELECT i, id, kind, CASE kind WHEN 'duplicate' THEN m.ids[list_position(m.a, a)] WHEN 'similar' THEN m.ids[1] END, CASE kind WHEN 'duplicate' THEN m.quotes[list_position(m.a, a)] WHEN 'similar' THEN 'author(s): ' || array_to_string(m.a[1:3], ', ') END,
    CASE WHEN kind NOT IN ('new', 'similar') THEN seen WHEN len(list_filter(seen, lambda x: x.h = h)) = 0 THEN list_append(seen, {{'h': h, 'a': [a], 'ids': [id], 'quotes': [quote]}})
      ELSE list_transform(seen, lambda x: CASE WHEN x.h = h AND NOT list_contains(x.a, a) THEN {{'h': x.h, 'a': list_append(x.a, a), 'ids': list_append(x.ids, id), 'quotes': list_append(x.quotes, quote)}} ELSE x END) END
  FROM (SELECT *, CASE WHEN noise THEN 'noise' WHEN m IS NULL THEN 'new' WHEN list_contains(m.a, a) THEN 'duplicate' ELSE 'similar' END AS kind
    FROM (SELECT d.i, d.doc_id AS id, d.h, d.a, d.noise, d.quote, w.seen, list_filter(w.seen, lambda x: bit_count(xor(x.h, d.h)) <= d.t AND length(to_hex(x.h)) = length(to_hex(d.h)))[1] AS m FROM w JOIN d ON d.i = w.i + 1) y) z)
SELECT id, dup_type, similar_to, similar_note FROM w WHERE i > 0"""


@query(_AUTHORS)
def author_aware_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("batch_seq"), T.simhash64(F.col("text")).alias("simhash"), F.col("text").alias("clean_text"), (F.col("doc_id") % 37).cast("string").alias("author"), (F.col("doc_id") % 11 == 0).alias("is_noise"))
    return dedup.author_aware(d).select("id", "dup_type", "similar_to", "similar_note")


@query("SELECT md5(text) AS content_md5, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def md5_exact_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.groupBy(F.md5("text").alias("content_md5")).agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_id")).filter("copies > 1")


_EDGES = "e AS (SELECT o_orderkey AS edge, o_custkey AS src, 1000000 + o_orderkey % 997 AS dst FROM orders)"


def _edges(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("edge"), F.col("o_custkey").alias("src"), (1000000 + F.col("o_orderkey") % 997).alias("dst"))
    return e, e.select(F.col("src").alias("seed")).filter("seed % 100 = 0").distinct()  # the stated seeds


_BOTH = f"{_EDGES}, b AS (SELECT edge, src AS a, dst AS z FROM e UNION ALL SELECT edge, dst, src FROM e), s AS (SELECT DISTINCT src AS seed FROM e WHERE src % 100 = 0)"


@query(f"WITH {_BOTH}, p AS (SELECT seed, z AS node, edge, 1 AS hops FROM s JOIN b ON a = seed), p2 AS (SELECT p.seed, b.z AS node, 2 AS hops FROM p JOIN b ON b.a = p.node AND b.edge <> p.edge) SELECT seed, node, min(hops) AS hops FROM (SELECT seed, node, hops FROM p UNION ALL SELECT * FROM p2) x WHERE seed <> node GROUP BY seed, node")
def neighbourhood_2hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.neighbourhood(*_edges(spark, sf_dir), hops=2)


@query(f"WITH RECURSIVE {_BOTH}, w AS (SELECT seed, seed AS node, 0 AS length FROM s UNION SELECT w.seed, b.z, w.length + 1 FROM w JOIN b ON b.a = w.node WHERE w.length < 6) SELECT seed, node, min(length) AS length FROM w GROUP BY seed, node")
def shortest_path_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.shortest_lengths(*_edges(spark, sf_dir), most=6)


@query("WITH p AS (SELECT DISTINCT o_custkey AS member, l_partkey AS target FROM orders JOIN lineitem ON l_orderkey = o_orderkey) SELECT x.member AS a, y.member AS b, count(*) AS shared FROM p x JOIN p y ON x.target = y.target AND x.member < y.member GROUP BY 1, 2 HAVING count(*) >= 4")
def shared_target_gangs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, i = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    return graph.gangs(o.join(i, o.o_orderkey == i.l_orderkey).select(F.col("o_custkey").alias("member"), F.col("l_partkey").alias("target")), 4)


@query("SELECT a.l_orderkey AS raw_id, a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber")
def cooccur_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.cooccurrences(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("raw_id"), F.col("l_linenumber").alias("ordinal"), F.col("l_partkey").alias("value")))


@query("SELECT l_orderkey, CAST(count(DISTINCT l_suppkey) AS INTEGER) AS members, substr(md5(string_agg(DISTINCT CAST(l_suppkey AS VARCHAR), ',' ORDER BY CAST(l_suppkey AS VARCHAR))), 1, 12) AS cluster FROM lineitem GROUP BY l_orderkey")
def cluster_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.cluster_ids(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_suppkey")


@query("WITH q AS (SELECT vec_id AS query_id, embedding AS e FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT query_id, b.vec_id, row_number() OVER (PARTITION BY query_id ORDER BY list_cosine_similarity(CAST(q.e AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) DESC, b.vec_id) AS rank FROM q JOIN embeddings b ON q.query_id <> b.vec_id) SELECT query_id, vec_id, CAST(rank AS INTEGER) AS rank FROM s WHERE rank <= 5")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return vectors.top_k(e.filter("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id"), e).select("query_id", "vec_id", "rank")


def _pair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    new = o.filter("o_orderkey % 3 = 0").select((F.col("o_orderkey") * 2).alias("o_orderkey"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey") + 1).alias("o_custkey"), F.lit("N").alias("o_orderstatus"))
    return o, new


_PAIR = "o AS (SELECT o_orderkey, o_custkey, o_orderstatus FROM orders), n AS (SELECT o_orderkey * 2 AS o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey + 1 END AS o_custkey, 'N' AS o_orderstatus FROM orders WHERE o_orderkey % 3 = 0)"


@query(f"WITH {_PAIR} SELECT * FROM o WHERE o_orderkey NOT IN (SELECT o_orderkey FROM n) UNION ALL SELECT * FROM n")
def replace_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warehouse.replace_by_key(*_pair(spark, sf_dir), ["o_orderkey"])


@query(f"WITH {_PAIR} SELECT coalesce(o.o_orderkey, n.o_orderkey) AS o_orderkey, coalesce(n.o_custkey, o.o_custkey) AS o_custkey, coalesce(n.o_orderstatus, o.o_orderstatus) AS o_orderstatus FROM o FULL JOIN n ON o.o_orderkey = n.o_orderkey")
def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warehouse.upsert(*_pair(spark, sf_dir), ["o_orderkey"])


@query(f"WITH {_PAIR} SELECT coalesce(o.o_orderkey, n.o_orderkey) AS o_orderkey, CASE WHEN o.o_orderkey IS NULL THEN n.o_custkey ELSE o.o_custkey END AS o_custkey, coalesce(n.o_orderstatus, o.o_orderstatus) AS o_orderstatus FROM o FULL JOIN n ON o.o_orderkey = n.o_orderkey")
def upsert_keeping_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warehouse.upsert(*_pair(spark, sf_dir), ["o_orderkey"], fixed=("o_custkey",))


@query("SELECT user_id, arg_max(event_type, ts) AS event_type, min(ts) AS started, max(ts) AS changed FROM events GROUP BY user_id")
def status_now(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warehouse.status_now(table(spark, sf_dir, "events"), "user_id", "event_type", "ts")


@query("WITH l AS (SELECT user_id % 300 AS t, arg_max(event_type, event_id) AS v FROM events WHERE value >= 20 AND event_type <> 'view' GROUP BY 1) SELECT c_custkey, coalesce(v, c_mktsegment) AS c_mktsegment FROM customer LEFT JOIN l ON c_custkey = t")
def hitl_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").select(F.col("event_id").alias("annotation_id"), (F.col("user_id") % 300).alias("target_id"), F.when(F.col("value") >= 20, "c_mktsegment").otherwise("c_name").alias("field_name"), F.when(F.col("event_type") != "view", F.col("event_type")).alias("new_value"), F.col("event_id").alias("annotated_at"))
    return warehouse.apply_annotations(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), log, "c_custkey", "c_mktsegment")


@query("SELECT raw_id, CAST(version AS INTEGER) AS version, is_latest FROM (SELECT user_id AS raw_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS version, CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1 THEN 1 ELSE 0 END AS is_latest FROM events) x")
def versioned_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warehouse.versioned(table(spark, sf_dir, "events"), "user_id", "ts", "event_id").select(F.col("user_id").alias("raw_id"), "version", "is_latest")


@query("SELECT event_id, 'event' AS kind, event_type AS risk, 'z' AS extra, 'extra,kind,risk' AS keys FROM events")
def metadata_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.create_map(F.lit("kind"), F.lit("event"), F.lit("risk"), F.lit("none"))
    new = F.create_map(F.lit("risk"), F.col("event_type"), F.lit("extra"), F.lit("z"), F.lit("bad key!"), F.lit("x"))
    m = table(spark, sf_dir, "events").withColumn("m", warehouse.merge_maps(base, new))
    return m.select("event_id", F.col("m")["kind"].alias("kind"), F.col("m")["risk"].alias("risk"), F.col("m")["extra"].alias("extra"), F.array_join(F.array_sort(F.map_keys("m")), ",").alias("keys"))


@query("SELECT o_orderkey, CASE lower(trim(s)) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LEGACY_STATUS.items()) + f" ELSE CASE WHEN upper(trim(s)) IN ({', '.join(map(q, STATUSES))}) THEN upper(trim(s)) ELSE 'RAW_COLLECTED' END END AS status FROM (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN ' Pending' WHEN 1 THEN 'success' WHEN 2 THEN 'Failed' WHEN 3 THEN 'odd' END AS s FROM orders) x")
def legacy_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 5
    s = F.when(k == 0, " Pending").when(k == 1, "success").when(k == 2, "Failed").when(k == 3, "odd")
    mapping = F.create_map(*(F.lit(x) for kv in LEGACY_STATUS.items() for x in kv))
    known = F.coalesce(mapping[F.lower(F.trim(s))], F.upper(F.trim(s)))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.when(known.isin(*STATUSES), known).otherwise("RAW_COLLECTED").alias("status"))
