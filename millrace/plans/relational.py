"""BI, joins, windows, top-k, set operations and filters over the warehouse's tables.

These are plain declarative queries. Each is one SQL text with the tables as parameters, which Spark plans as it would the same
DataFrame expression; the same text, with the names of the views, is what the other engine runs, but for what SPARK has. Limits have a key as a tie-break.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("documents", "labels", "events", "orders", "lineitem", "customer", "supplier", "part", "nation", "region", "pages", "embeddings", "conversations", "benchmark")

#: Stand-ins for the warehouse's layers.
ANALYSIS = """analysis AS (
  SELECT doc_id * 10 + 2 AS id, doc_id AS raw_id, CASE WHEN toxic = 1 THEN 'fraud' WHEN quality = 0 THEN 'cheat' END AS risk_label,
         CAST(toxic * 60 + (1 - quality) * 25 + doc_id % 11 AS DOUBLE) / 100 AS risk_score, 2 AS version, 1 AS is_latest, toxic, quality FROM {labels}
  UNION ALL
  SELECT doc_id * 10 + 1, doc_id, CASE WHEN toxic = 1 THEN 'spam' END, CAST(doc_id % 7 AS DOUBLE) / 10, 1, 0, toxic, quality FROM {labels} WHERE doc_id % 3 = 0)"""
LATEST = f"{ANALYSIS}, latest AS (SELECT *, CASE WHEN risk_score >= 0.85 THEN 'critical' WHEN risk_score >= 0.65 THEN 'high' WHEN risk_score >= 0.35 THEN 'normal' ELSE 'low' END AS risk_level FROM analysis WHERE is_latest = 1)"
RAW = "raw AS (SELECT doc_id AS id, source AS platform, lang AS channel, doc_id % 37 AS author, doc_id * 60 AS collected, text AS content FROM {documents})"
DAY = "CAST(ts AS DATE)"

SHARED = {
    # aggregates
    "overview_counters": f"WITH {LATEST}, {RAW} SELECT (SELECT count(*) FROM raw) AS raw_total, (SELECT count(*) FROM raw WHERE platform = 'src0') AS raw_src0, count(*) AS analysed, count(*) FILTER (WHERE risk_level IN ('high', 'critical')) AS high, count(*) FILTER (WHERE risk_label IS NULL) AS unlabelled FROM latest",
    "label_counts": f"WITH {LATEST} SELECT risk_label, count(*) AS cnt FROM latest GROUP BY risk_label",
    "label_distribution": f"WITH {LATEST} SELECT coalesce(risk_label, 'unclassified') AS label, count(*) AS cnt FROM latest GROUP BY risk_label",
    "platform_distribution": f"WITH {RAW} SELECT platform, count(*) AS cnt FROM raw GROUP BY platform ORDER BY cnt DESC, platform LIMIT 12",
    "label_risk_stats": f"WITH {LATEST} SELECT risk_label AS label, count(*) AS cnt, round(avg(risk_score), 4) AS avg_score, CAST(sum(CASE WHEN risk_level IN ('high', 'critical') THEN 1 ELSE 0 END) AS BIGINT) AS high_cnt FROM latest GROUP BY risk_label ORDER BY cnt DESC, label LIMIT 12",
    "platform_stats": f"WITH {LATEST}, {RAW} SELECT platform, count(*) AS cnt, round(avg(coalesce(risk_score, 0)), 4) AS avg_score, CAST(sum(CASE WHEN risk_level IN ('high', 'critical') THEN 1 ELSE 0 END) AS BIGINT) AS high_cnt FROM raw LEFT JOIN latest ON latest.raw_id = raw.id GROUP BY platform ORDER BY high_cnt DESC, cnt DESC, platform LIMIT 12",
    "daily_trend": f"SELECT CAST({DAY} AS VARCHAR(10)) AS day, count(*) AS cnt, count(*) FILTER (WHERE value >= 50) AS high_cnt FROM {{events}} WHERE {DAY} > DATE '2024-01-16' AND {DAY} <= DATE '2024-01-30' GROUP BY {DAY}",
    "hot_terms": "SELECT event_type AS term, count(*) AS cnt, coalesce(max(CASE WHEN value > 90 THEN props END), '') AS meaning, min(event_id) AS first_id FROM {events} GROUP BY event_type ORDER BY cnt DESC, term LIMIT 15",
    "status_counts": "SELECT o_orderstatus AS status, count(*) AS cnt FROM {orders} GROUP BY o_orderstatus",
    "derived_totals": "SELECT CAST(sum(cnt) AS BIGINT) AS total, CAST(sum(CASE WHEN status IN ('O', 'P') THEN cnt ELSE 0 END) AS BIGINT) AS pending, count(*) AS statuses FROM (SELECT o_orderstatus AS status, count(*) AS cnt FROM {orders} GROUP BY o_orderstatus) s",
    "olap_stats": f"WITH {LATEST} SELECT count(*) AS total, count(*) FILTER (WHERE raw_id % 30 = 0) AS today, count(*) FILTER (WHERE risk_level IN ('high', 'critical')) AS high, CAST(sum(version) AS BIGINT) AS entity_sum FROM latest",
    "level_breakdown": f"WITH {LATEST} SELECT risk_level, count(*) AS cnt, round(avg(risk_score), 4) AS avg_score FROM latest GROUP BY risk_level",
    "max_version": f"WITH {ANALYSIS} SELECT raw_id, max(version) AS version FROM analysis GROUP BY raw_id",
    "entity_pivot": "SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS clicks, count(*) FILTER (WHERE event_type = 'view') AS views, count(*) FILTER (WHERE event_type = 'purchase') AS purchases FROM {events} GROUP BY user_id",
    "most_common": "SELECT user_id, count(*) AS cnt FROM {events} GROUP BY user_id ORDER BY cnt DESC, user_id LIMIT 20",
    "field_sets": "SELECT user_id, count(DISTINCT event_type) AS types, count(DISTINCT CAST(ts AS DATE)) AS days FROM {events} GROUP BY user_id",
    "category_counts": "SELECT p_brand AS category, count(*) AS terms FROM {part} GROUP BY p_brand ORDER BY terms DESC, category",
    "classifier_accuracy": "WITH c AS (SELECT quality AS truth, CASE WHEN doc_id % 5 = 0 THEN 1 - quality ELSE quality END AS guess FROM {labels}), k AS (SELECT truth, guess, count(*) AS n FROM c GROUP BY truth, guess), f AS (SELECT t.truth, 2.0 * sum(CASE WHEN k.truth = t.truth AND k.guess = t.truth THEN n ELSE 0 END) / sum(CASE WHEN k.truth = t.truth AND k.guess = t.truth THEN 2 * n WHEN k.truth = t.truth OR k.guess = t.truth THEN n ELSE 0 END) AS f1 FROM (SELECT DISTINCT truth FROM k) t, k WHERE k.truth = t.truth OR k.guess = t.truth GROUP BY t.truth) SELECT (SELECT round(CAST(sum(CASE WHEN truth = guess THEN n ELSE 0 END) AS DOUBLE) / sum(n), 6) FROM k) AS accuracy, round(CAST(avg(CAST(f1 AS DOUBLE)) AS DOUBLE), 6) AS macro_f1 FROM f",
    "cleaning_counters": f"WITH {RAW} SELECT CASE WHEN length(content) < 200 THEN 'DISCARDED' WHEN id % 10 = 0 THEN 'SIMILAR' ELSE 'CLEANED' END AS status, count(*) AS cnt FROM raw GROUP BY 1",
    # joins
    "recent_left_join": f"WITH {LATEST}, {RAW} SELECT raw.id, platform, risk_label, risk_score FROM raw LEFT JOIN latest ON latest.raw_id = raw.id ORDER BY collected DESC, raw.id DESC LIMIT 50",
    "latest_inner_join": f"WITH {LATEST}, {RAW} SELECT raw.id, platform, risk_label, risk_level, risk_score FROM raw JOIN latest ON latest.raw_id = raw.id",
    "entity_raw_join": "SELECT e.event_id, e.event_type, c.c_mktsegment AS segment FROM {events} e JOIN {customer} c ON e.user_id = c.c_custkey",
    "latest_by_time_per_row": f"WITH {ANALYSIS}, {RAW}, n AS (SELECT raw_id, risk_label, risk_score, row_number() OVER (PARTITION BY raw_id ORDER BY version DESC, id DESC) AS k FROM analysis) SELECT raw.id, n.risk_label, n.risk_score FROM raw LEFT JOIN n ON n.raw_id = raw.id AND n.k = 1",
    "id_list_rows": f"WITH {RAW} SELECT id, platform, CAST(length(content) AS BIGINT) AS n FROM raw WHERE id IN (3, 5, 8, 13, 21, 34, 55, 89, 144)",
    "wide_mart": f"WITH {LATEST}, {RAW}, e AS (SELECT o_custkey % 1000 AS raw_id, count(*) FILTER (WHERE o_orderstatus = 'F') AS phones, count(*) FILTER (WHERE o_orderstatus = 'O') AS urls, count(*) AS entities FROM {{orders}} GROUP BY 1) SELECT raw.id, platform, channel, risk_label, risk_score, coalesce(phones, 0) AS phones, coalesce(urls, 0) AS urls, coalesce(entities, 0) AS entities FROM raw LEFT JOIN latest ON latest.raw_id = raw.id LEFT JOIN e ON e.raw_id = raw.id",
    "unseen_import_rows": "SELECT e.event_id, e.user_id FROM {events} e WHERE NOT EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = e.user_id AND o.o_orderkey < e.event_id) AND NOT EXISTS (SELECT 1 FROM {labels} l WHERE l.doc_id = e.event_id)",
    "known_import_rows": "SELECT e.event_id FROM {events} e WHERE EXISTS (SELECT 1 FROM {labels} l WHERE l.doc_id = e.event_id)",
    "star_revenue": "SELECT n.n_name AS nation, count(*) AS lines, CAST(sum(CAST(l.l_extendedprice AS DECIMAL(18, 2)) * CAST(1 - l.l_discount AS DECIMAL(4, 2))) AS DOUBLE) AS revenue FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey JOIN {customer} c ON o.o_custkey = c.c_custkey JOIN {nation} n ON c.c_nationkey = n.n_nationkey JOIN {region} r ON n.n_regionkey = r.r_regionkey GROUP BY n.n_name",
    "supplier_part_levels": "SELECT s.s_name AS supplier, count(DISTINCT l.l_partkey) AS parts, max(p.p_size) AS largest FROM {lineitem} l JOIN {supplier} s ON l.l_suppkey = s.s_suppkey JOIN {part} p ON l.l_partkey = p.p_partkey GROUP BY s.s_name",
    # windows
    "version_history": f"WITH {ANALYSIS} SELECT raw_id, id, CAST(row_number() OVER (PARTITION BY raw_id ORDER BY version, id) AS BIGINT) AS new_version, CASE WHEN row_number() OVER (PARTITION BY raw_id ORDER BY version DESC, id DESC) = 1 THEN 1 ELSE 0 END AS latest FROM analysis",
    "latest_per_key": "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM {events}) x WHERE k = 1",
    "earlier_counts": "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM {events}",
    "first_exit_turn": "WITH x AS (SELECT conv_id, min(turn) AS first_exit FROM {conversations} WHERE lower(text) LIKE '%reth%' AND role = 'user' GROUP BY conv_id) SELECT c.conv_id, c.turn, c.role FROM {conversations} c LEFT JOIN x ON c.conv_id = x.conv_id WHERE x.first_exit IS NULL OR c.turn <= x.first_exit",
    # sort, limit, top-k
    "page_of_rows": f"WITH {RAW} SELECT id, platform FROM raw ORDER BY collected DESC, id DESC LIMIT 20 OFFSET 40",
    "high_risk_topk": f"WITH {LATEST} SELECT raw_id, risk_level, risk_score FROM latest ORDER BY CASE risk_level WHEN 'critical' THEN 4 WHEN 'high' THEN 3 ELSE 1 END DESC, risk_score DESC, id DESC LIMIT 10",
    "coalesced_order": f"WITH {LATEST}, {RAW} SELECT raw.id, coalesce(latest.id, raw.collected) AS shown FROM raw LEFT JOIN latest ON latest.raw_id = raw.id ORDER BY coalesce(latest.id, raw.collected) DESC, raw.id DESC LIMIT 30",
    "aggregate_topk": "SELECT o_custkey AS customer, count(*) AS cnt, CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS total FROM {orders} GROUP BY o_custkey ORDER BY cnt DESC, customer LIMIT 15",
    "unfinished_fifo": "SELECT o_orderkey AS job FROM {orders} WHERE o_orderstatus IN ('O', 'P') ORDER BY o_orderdate, o_orderkey LIMIT 25",
    "recent_not_discarded": f"WITH {RAW} SELECT id, platform FROM raw WHERE platform <> 'src3' ORDER BY id DESC LIMIT 10",
    "distinct_targets": f"WITH {RAW} SELECT platform, channel, author, max(id) AS last_id FROM raw GROUP BY platform, channel, author ORDER BY last_id DESC LIMIT 25",
    # sets
    "distinct_rows": f"WITH {RAW} SELECT DISTINCT platform, channel, author FROM raw",
    "union_report": f"WITH {LATEST} SELECT * FROM (SELECT 'risk' AS kind, coalesce(risk_label, 'none') AS name, count(*) AS n FROM latest GROUP BY risk_label ORDER BY n DESC, name LIMIT 5) a UNION ALL SELECT * FROM (SELECT 'term', event_type, count(*) AS n FROM {{events}} GROUP BY event_type ORDER BY n DESC, event_type LIMIT 5) b UNION ALL SELECT * FROM (SELECT 'sample', CAST(raw_id AS VARCHAR(20)), version AS n FROM latest ORDER BY risk_score DESC, raw_id LIMIT 3) c",
    "message_merge": "WITH old AS (SELECT event_id, ts, value FROM {events} WHERE event_id % 3 <> 0), new AS (SELECT event_id, ts, value + 1000 AS value FROM {events} WHERE event_id % 2 = 0) SELECT event_id, value FROM old UNION ALL SELECT n.event_id, n.value FROM new n WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.event_id = n.event_id)",
    # filters
    "conjunct_filter": f"WITH {RAW} SELECT id FROM raw WHERE platform IN ('src0', 'src1', 'src2') AND channel = 'en' AND author BETWEEN 3 AND 20",
    "keyword_search": f"WITH {RAW} SELECT id, platform FROM raw WHERE (lower(content) LIKE '%license%' OR lower(platform) LIKE '%license%' OR lower(channel) LIKE '%license%') AND channel = 'en'",
    "json_property_filter": "SELECT event_id, user_id FROM {events} WHERE props LIKE '%\"k\"%' AND event_type = 'click' AND value > 10",
    "last_days_by_platform": "SELECT event_type AS platform, count(*) AS cnt FROM {events} WHERE CAST(ts AS DATE) >= DATE '2024-01-24' AND CAST(ts AS DATE) <= DATE '2024-01-30' GROUP BY event_type",
    "today_rows": "SELECT event_id FROM {events} WHERE CAST(ts AS DATE) = DATE '2024-01-15'",
    "not_system_authors": f"WITH {RAW} SELECT DISTINCT author, platform FROM raw WHERE author NOT IN (0, 1, 2) AND platform <> '' AND channel IN ('en', 'fr')",
    "either_end": "SELECT l_orderkey, l_linenumber FROM {lineitem} WHERE l_partkey = 17 OR l_suppkey = 3",
    "incremental_rows": "WITH seen AS (SELECT event_type, max(ts) AS mark FROM {events} WHERE CAST(ts AS DATE) <= DATE '2024-01-20' GROUP BY event_type) SELECT e.event_id FROM {events} e LEFT JOIN seen s ON e.event_type = s.event_type WHERE e.ts IS NULL OR s.mark IS NULL OR e.ts > s.mark",
    # projections
    "preferred_text": f"WITH {RAW}, c AS (SELECT doc_id AS raw_id, CASE WHEN toxic = 1 THEN '' ELSE 'clean' END AS clean_text, CASE WHEN quality = 0 THEN 'merged' END AS merged_text FROM {{labels}}) SELECT id, coalesce(nullif(merged_text, ''), nullif(clean_text, ''), substr(content, 1, 40)) AS preferred FROM raw LEFT JOIN c ON c.raw_id = raw.id",
    "status_normalise": "SELECT o_orderkey AS id, CASE lower(trim(o_orderstatus)) WHEN 'f' THEN 'ANALYZED' WHEN 'o' THEN 'RAW_COLLECTED' WHEN 'p' THEN 'ANALYZING' ELSE 'RAW_COLLECTED' END AS status FROM {orders}",
    "preview_rows": f"WITH {RAW} SELECT id, CASE WHEN length(trim(replace(content, chr(10), ' '))) > 120 THEN concat(left(trim(replace(content, chr(10), ' ')), 120), '...') ELSE trim(replace(content, chr(10), ' ')) END AS preview FROM raw",
    "level_labels": f"WITH {LATEST}, names AS (SELECT 'critical' AS code, 'Critical' AS label UNION ALL SELECT 'high', 'High' UNION ALL SELECT 'normal', 'Normal') SELECT raw_id, coalesce(label, risk_level) AS level_label FROM latest LEFT JOIN names ON names.code = latest.risk_level",
    "slang_or_risk_or": f"WITH {LATEST} SELECT raw_id, risk_score >= 0.55 AND risk_level IN ('high', 'critical') AS expand_graph, risk_score >= 0.6 AS search_similar FROM latest",
    # graphs
    "shared_contact_accounts": "WITH p AS (SELECT DISTINCT o_custkey AS account, l_partkey AS contact, o_orderkey AS item FROM {orders} JOIN {lineitem} ON l_orderkey = o_orderkey) SELECT a.account AS a1, b.account AS a2, a.contact, count(DISTINCT a.item) + count(DISTINCT b.item) AS strength FROM p a JOIN p b ON a.contact = b.contact AND a.account < b.account GROUP BY a.account, b.account, a.contact ORDER BY strength DESC, a1, a2, contact LIMIT 100",
    "gang_members": "WITH p AS (SELECT DISTINCT o_custkey AS member, l_partkey AS contact FROM {orders} JOIN {lineitem} ON l_orderkey = o_orderkey) SELECT member, contact FROM p WHERE contact IN (SELECT contact FROM p GROUP BY contact HAVING count(*) >= 3)",
    "merged_entities": "SELECT concat(event_type, ':', CAST(user_id AS VARCHAR(20))) AS uuid, event_type AS type, user_id AS value, min(ts) AS first_seen, count(*) AS source_count FROM {events} GROUP BY event_type, user_id",
    "conversation_shape": "SELECT conv_id, count(*) AS turns, count(*) FILTER (WHERE role = 'user') AS user_turns, max(turn) AS last_turn, CAST(sum(length(text)) AS BIGINT) AS chars FROM {conversations} GROUP BY conv_id",
}


def _query(sql: str):
    names = sorted(set(re.findall(r"\{(\w+)\}", sql)))

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(sql, **{n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names})

    return run


#: Queries whose text for Spark is another, with the same rows.
SPARK = {
    # Spark names a cast after its column, so ORDER BY would take the text for the number: here the cast has a name of its own
    "union_report": SHARED["union_report"].replace("CAST(raw_id AS VARCHAR(20)),", "CAST(raw_id AS VARCHAR(20)) AS name,"),
    # items are counted before accounts meet. A pair with an account behind 101 others of its contact, by items and then by account, has
    # 100 pairs of that contact before it (one of the 101 in its place), so only the first 101 of a contact are paired
    "shared_contact_accounts": "WITH n AS (SELECT o_custkey AS account, l_partkey AS contact, count(DISTINCT o_orderkey) AS n FROM {orders} JOIN {lineitem} ON l_orderkey = o_orderkey GROUP BY o_custkey, l_partkey), r AS (SELECT *, row_number() OVER (PARTITION BY contact ORDER BY n DESC, account) AS r FROM n WHERE account IS NOT NULL AND contact IS NOT NULL), p AS (SELECT account, contact, n FROM r WHERE r <= 101) SELECT a.account AS a1, b.account AS a2, a.contact, a.n + b.n AS strength FROM p a JOIN p b ON a.contact = b.contact AND a.account < b.account ORDER BY strength DESC, a1, a2, contact LIMIT 100",
}

QUERIES = {name: _query(SPARK.get(name, sql)) for name, sql in SHARED.items()}
ORACLE = {name: sql.format(**{t: t for t in TABLES}) for name, sql in SHARED.items()}
