"""The registered queries of the training-data operators and, where SQL can say the same, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, fingerprints, language_id, licenses, mixing, ngram_join, packing, quality_rules, spelling, suffix_dedup, tool_calls, turn_repair, url_filter
from .common import table, text_of


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fingerprints.with_next(table(spark, sf_dir, "documents"))
    edited = docs.withColumn("edited", fingerprints.half_edited(F.col("text"), F.col("next_text")))
    signed = edited.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "signature", "next_signature", fingerprints.fingerprint(F.col("edited")).alias("edited_signature"))
    return signed.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        fingerprints.written(F.col("signature")).alias("fingerprint"),
        fingerprints.written(F.col("edited_signature")).alias("edited_fingerprint"),
        fingerprints.likeness(F.col("signature"), F.col("edited_signature")).alias("near_edited"),
        fingerprints.likeness(F.col("signature"), F.col("next_signature")).alias("near_next"),
    )


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    pieces = packing.token_pieces(docs, tokenizer_path()).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packing.pack(pieces)


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", language_id.held_out())
    model = language_id.train(docs.filter("not held_out"))
    return language_id.identify(docs, model, keep=("doc_id", "held_out"))


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = tool_calls.turns_as_calls(table(spark, sf_dir, "conversations"))
    return tool_calls.link(calls, results, tool_calls.TURN_TOOLS)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    # over 50 words of a passage that documents share have 256 bytes at least, unless they are shorter than five letters on average
    out = suffix_dedup.cleaned(table(spark, sf_dir, "documents"), shape=suffix_dedup.Shape(passage=256))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["behind"] - x["first"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), "shares_passage")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.memberships(table(spark, sf_dir, "documents"), largest=True)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"), licenses.known(spark))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sizes = docs.select(F.concat_ws(":", "doc_id", F.xxhash64(text_of())).alias("row"), "doc_id", "source", mixing.words().alias("size"))
    mixed = mixing.mix(sizes)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.repair(turn_repair.damaged(table(spark, sf_dir, "conversations")), gone=F.col("gone"))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.judge(table(spark, sf_dir, "documents"), columns=("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "kept")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.vocabulary(table(spark, sf_dir, "documents"), doc_id="doc_id")).select("word", "form", "root", "n", "n_near", "form_n")


def queries() -> dict:
    return {f.__name__: f for f in (op1_order_minhash, op2_best_fit_packing, op3_url_filter, op4_language_id, op5_chat_formatting, op6_suffix_dedup, op7_exact_dedup, op8_license_scan, op9_ngram_jaccard, op10_mixing, op11_turn_repair, op12_quality_rules, op13_spelling_variants)}


OP5_SQL = """
WITH m AS (SELECT conv_id, turn, role, coalesce(text, '') AS t, coalesce(role, '') = 'assistant' AS answers FROM conversations),
r AS (
  SELECT m.conv_id, m.turn, CASE WHEN m.answers THEN 'result' ELSE 'call' END AS kind, m.role, m.t,
         'turn-' || (CASE WHEN m.answers THEN m.turn - 1 ELSE m.turn END)::varchar AS call_id,
         CASE WHEN m.answers THEN coalesce(NOT p.answers, false) ELSE coalesce(n.answers, false) END AS linked,
         row_number() OVER (PARTITION BY m.conv_id ORDER BY m.turn) - 1 AS position
  FROM m LEFT JOIN m p ON m.conv_id = p.conv_id AND p.turn = m.turn - 1 LEFT JOIN m n ON m.conv_id = n.conv_id AND n.turn = m.turn + 1)
SELECT conv_id, turn, kind, call_id, linked, CASE WHEN kind = 'result' AND NOT linked THEN 'no call' ELSE '' END AS problems, position,
       CASE WHEN kind = 'result' THEN '{"content":' || to_json(t)::varchar || ',"id":"' || call_id || '","turn":' || turn || ',"type":"result"}'
            WHEN role = 'user' THEN '{"arguments":{"text":' || to_json(t)::varchar || ',"words":' || len(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+')) || '},"id":"' || call_id || '","tool":"ask","turn":' || turn || ',"type":"call"}'
            ELSE '{"arguments":{"text":' || to_json(t)::varchar || '},"id":"' || call_id || '","tool":"configure","turn":' || turn || ',"type":"call"}' END AS json
FROM r
"""

OP7_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d
"""


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _canonical_sql(text: str) -> str:
    body = f"regexp_replace(lower({text}), {_quoted(licenses.BODY_LINES)}, ' copyright\\1', 'g')"
    sql = f"trim(regexp_replace(regexp_replace({body}, {_quoted(licenses.COPYRIGHT_LINES)}, ' ', 'g'), {_quoted(licenses.NO_WORD)}, ' ', 'g'))"
    edges = r"(^|[^\p{L}\p{N}_])", r"($|[^\p{L}\p{N}_])"
    equal = f"replace({sql}, ' ', '  ')"
    for variant, word in licenses.SPELLINGS:
        equal = f"regexp_replace({equal}, {_quoted(edges[0] + variant.replace(' ', '  ') + edges[1])}, {_quoted(chr(92) + '1' + word.replace(' ', '  ') + chr(92) + '2')}, 'g')"
    return f"replace({equal}, '  ', ' ')"


OP8_SQL = f"""
WITH k AS (SELECT sha256({_canonical_sql('t')}) AS digest, min(license) AS license FROM (VALUES {', '.join(f'({_quoted(a)}, {_quoted(b)})' for a, b in licenses.forms())}) v(license, t) GROUP BY 1),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
u AS (SELECT r, doc_id, 0 AS line, t FROM d UNION ALL SELECT r, doc_id, 1, unnest(string_split(t, chr(10))) FROM d),
c AS (SELECT r, doc_id, line, {_canonical_sql('t')} AS t FROM u WHERE line = 0 OR trim(t) <> ''),
f AS (SELECT r, doc_id, line, sha256(t) AS digest, CASE WHEN t <> '' THEN license END AS license FROM c LEFT JOIN k ON sha256(t) = digest)
SELECT doc_id, max(digest) FILTER (line = 0) AS canonical_sha256, max(license) FILTER (line = 0) AS license, count(license) FILTER (line = 1) AS license_lines,
       coalesce(string_agg(DISTINCT license, ',' ORDER BY license) FILTER (line = 1), '') AS line_licenses
FROM f GROUP BY r, doc_id
"""


def crc32_sql(s: str) -> str:
    """The unsigned crc32 of a string's UTF-8, eight steps to a byte."""
    steps = f"flatten([[c, 0, 0, 0, 0, 0, 0, 0] FOR c IN {s}])"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {steps}), lambda c, b: xor(xor(c, b) >> 1, CASE WHEN xor(c, b) & 1 = 1 THEN 3988292384 ELSE 0 END)), 4294967295)"


_BYTES = "[ord(c)::BIGINT FOR c IN string_split({}, '')]"  # of a string in ASCII
OP11_SQL = f"""
WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc32_sql(_BYTES.format("coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')"))} % 20 AS kind FROM conversations),
d AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text FROM k, range(2) copies(copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM d),
f AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS seen, left(role, 1) AS r, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\\z') AS cut, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS p FROM o),
c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (seen AND NOT blank) AS duplicate, count(*) FILTER (cut AND NOT blank AND NOT seen) AS truncated, count(*) FILTER (p || r NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM f GROUP BY conv_id),
-- turns put in first, then what is done with a row; the roles 0 nothing, 1 system, 2 user, 3 assistant
put(s, t, ins) AS (VALUES (0, 0, ''), (1, 1, ''), (2, 2, ''), (3, 3, ''), (0, 2, 'I'), (1, 2, 'I'), (3, 2, 'I'), (2, 3, 'I'), (0, 3, 'II'), (1, 3, 'II')),
op(t, u, op, initial, price) AS (VALUES (0, 0, 'D', NULL, 4), (1, 1, 'D', NULL, 4), (2, 2, 'D', NULL, 4), (3, 3, 'D', NULL, 4), (0, 1, 'K', 's', 0), (0, 2, 'K', 'u', 0), (1, 2, 'K', 'u', 0), (3, 2, 'K', 'u', 0), (2, 3, 'K', 'a', 0), (0, 2, 'R', NULL, 3), (1, 2, 'R', NULL, 3), (3, 2, 'R', NULL, 3), (2, 3, 'R', NULL, 3)),
w(conv_id, i, s, best) AS (
  SELECT conv_id, 0::BIGINT, 0, {{'c': 0::BIGINT, 'a': '', 'said': ''}} FROM c
  UNION ALL
  SELECT w.conv_id, f.i, u, min({{'c': best.c + 3 * length(ins) + price + CASE WHEN op <> 'D' AND f.cut THEN 3 ELSE 0 END, 'a': best.a || ins || op,
    'said': best.said || CASE ins WHEN '' THEN '' WHEN 'II' THEN chr(10) || 'user:' || chr(10) || 'assistant:' ELSE chr(10) || CASE w.s WHEN 2 THEN 'assistant:' ELSE 'user:' END END || CASE op WHEN 'D' THEN '' WHEN 'K' THEN chr(10) || f.role || ':' || f.text ELSE chr(10) || CASE u WHEN 2 THEN 'user:' ELSE 'assistant:' END || f.text END}})
  FROM w JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1 JOIN put USING (s) JOIN op USING (t)
  WHERE (initial IS NULL OR initial = f.r) AND (op = 'D' OR NOT (f.blank OR f.seen)) GROUP BY w.conv_id, f.i, u),
e AS (SELECT w.conv_id, min({{'c': best.c + 3 * length(ins), 'a': best.a || ins, 'said': best.said || CASE ins WHEN '' THEN '' WHEN 'II' THEN chr(10) || 'user:' || chr(10) || 'assistant:' ELSE chr(10) || CASE w.s WHEN 2 THEN 'assistant:' ELSE 'user:' END END}}) AS best
  FROM w JOIN c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.n = w.i JOIN put USING (s) WHERE t IN (0, 3) GROUP BY w.conv_id),
a AS (SELECT DISTINCT conv_id FROM conversations)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(best.c, 0) AS cost, coalesce(best.a, '') AS audit, sha256(substr(coalesce(best.said, ''), 2)) AS repaired_sha256
FROM a LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM a.conv_id
"""


OP12_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
l AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d) x WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
s AS (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
w AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM s),
n AS (SELECT r, count(*) AS n_words, sum(length(w)) AS word_chars, count(*) FILTER (regexp_matches(w, '\\p{L}')) AS n_lettered, count(*) FILTER (regexp_matches(w, '\\p{Lu}[^\\p{Ll}]*\\p{Lu}') AND NOT regexp_matches(w, '\\p{Ll}')) AS n_shouted FROM w GROUP BY r),
p AS (SELECT r, max(c) AS n_top_pair FROM (SELECT r, w, v, count(*) AS c FROM (SELECT r, w, lead(w) OVER (PARTITION BY r ORDER BY i) AS v FROM w) y WHERE v IS NOT NULL GROUP BY r, w, v) z GROUP BY r),
g AS (SELECT r, i, w AS a, lead(w) OVER o AS b, lead(w, 2) OVER o AS c FROM w WINDOW o AS (PARTITION BY r ORDER BY i)),
h AS (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM g WHERE c IS NOT NULL),
q AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM h, range(3) x(k) WHERE n > 1 GROUP BY r),
m AS (SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
  coalesce(n_lines, 0) AS n_lines, coalesce(n_lettered, 0) AS n_lettered, coalesce(n_shouted, 0) AS n_shouted, coalesce(n_top_pair, 0) AS n_top_pair
  FROM d LEFT JOIN l USING (r) LEFT JOIN n USING (r) LEFT JOIN p USING (r) LEFT JOIN q USING (r)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR 2 * n_dup_lines > n_lines OR 10 * n_lettered < 7 * n_words OR 10 * n_shouted > 3 * n_words OR 5 * n_top_pair > n_words) AS kept
FROM f
"""


# bytes of a letter in ASCII or up to U+00FF, two in UTF-8
_LETTER_BYTES = "flatten([CASE WHEN ord(c) < 128 THEN [ord(c)::BIGINT] ELSE [(192 + (ord(c) >> 6))::BIGINT, (128 + (ord(c) & 63))::BIGINT] END FOR c IN string_split({}, '')])"
OP13_SQL = f"""
WITH RECURSIVE r AS (SELECT coalesce(doc_id::varchar, '') || ':' AS d, unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')) AS w FROM documents),
c AS (SELECT d, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS n FROM r GROUP BY ALL),
h AS (SELECT w, n, {crc32_sql(_LETTER_BYTES.format("d || w"))} AS h FROM c),
m AS (SELECT CASE WHEN h % 31 = 0 THEN left(w, (h % length(w))::INTEGER) || substr(w, (h % length(w))::INTEGER + 2) ELSE w END AS word, n FROM h),
v AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM m WHERE length(word) >= 7 GROUP BY word HAVING sum(n) > 1),
x AS MATERIALIZED (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1))::INTEGER AS i FROM v) y),
p AS (SELECT a.word AS a, a.n AS a_n, b.word AS b, b.n AS b_n FROM x a JOIN x b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT x.word, x.n, v.word, v.n FROM x JOIN v ON x.rest = v.word UNION SELECT v.word, v.n, x.word, x.n FROM x JOIN v ON x.rest = v.word),
s AS (SELECT a, a_n, count(*) AS n_near, min({{'less': -b_n, 'b': b}}) AS best FROM p GROUP BY a, a_n),
f AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.less >= 10 * n THEN best.b END AS form, CASE WHEN -best.less >= 10 * n THEN -best.less END AS form_n FROM v LEFT JOIN s ON a = word),
t(word, root, step) AS (SELECT word, word, 0 FROM f UNION ALL SELECT t.word, f.form, step + 1 FROM t JOIN f ON f.word = t.root WHERE f.form IS NOT NULL)
SELECT word, form, (SELECT arg_max(root, step) FROM t WHERE t.word = f.word) AS root, n, n_near, form_n FROM f
"""


def oracle_sql() -> dict:
    return {"op5_chat_formatting": OP5_SQL, "op7_exact_dedup": OP7_SQL, "op8_license_scan": OP8_SQL, "op11_turn_repair": OP11_SQL, "op12_quality_rules": OP12_SQL, "op13_spelling_variants": OP13_SQL}
