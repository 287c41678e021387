"""What is looked for in whole texts costs about a scan of them, and finds the same as plain patterns do."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.functions.emoji import MEANINGS, emojis
from millrace.functions.rules import DEFAULT, EMOJI_RANGES, ENTITIES, needed_words
from millrace.operators import analysis, cleaning


@pytest.fixture(scope="module")
def prose(spark, tmp_path_factory):
    random.seed(1)
    words = ["".join(random.choices("etaoinshrdlué", k=random.randint(2, 12))) for _ in range(500)]
    path = str(tmp_path_factory.mktemp("prose") / "texts")
    spark.createDataFrame([(i, " ".join(random.choices(words, k=12_000)) + ".") for i in range(80)], "id long, text string").repartition(4).write.parquet(path)
    return spark.read.parquet(path)


def seconds(df):
    def once():
        began = time.perf_counter()
        df.write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    return min(once() for _ in range(3))


def scan(prose):
    return seconds(prose.select(F.regexp_count("text", F.lit(T.CJK)).alias("n")))


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_emojis_of_prose_cost_a_scan(spark, prose):
    assert seconds(prose.select(F.size(emojis(F.col("text"))).alias("n"))) < 5 * scan(prose)
    known = {"ab": "1", "*️⃣": "2", "😀x": "3", "😀": "4", "é": "5"}
    assert spark.range(1).select(emojis(F.lit("zab😀x😀*️⃣éb"), known).alias("e")).first().e == ["ab", "😀x", "😀", "*️⃣", "é"]
    assert spark.range(1).select(emojis(F.lit("".join(MEANINGS))).alias("e")).first().e == list(MEANINGS)


def test_a_text_is_cleaned_once_for_all_that_is_asked_of_it(prose):
    assert plan(prose.select(T.apply_common(F.col("text")).alias("t"))).count("&hellip;") == 1
    posts = prose.select("id", F.lit("qq_group").alias("platform"), F.col("text").alias("content_raw"), F.lit("a").alias("author_username"), F.lit("x").alias("source_keyword"))
    assert plan(cleaning.clean(posts).select("id", "is_noise")).count("&hellip;") == 1


def test_one_of_many_words_finds_what_each_word_finds(spark):
    random.seed(2)
    words = [*DEFAULT.signals, *DEFAULT.media_authors, "😀", "\U0001faff.", "a|b", "é"]
    texts = [None, "", *words, *(w[:-1] + random.choice("xA号") for w in words), *("".join(random.choices("".join(words), k=6)) for _ in range(500))]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", T.contains_any(F.col("t"), words).alias("any"), T.hits(F.col("t"), words).alias("hits"), T.contains_any(F.col("t"), words[-4:]).alias("few"), T.contains_any(F.col("t"), ("a", "")).alias("all")).collect()
    for r in rows:
        assert r.any == (None if r.t is None else any(w in r.t for w in words)) and r.few == (None if r.t is None else any(w in r.t for w in words[-4:]))
        assert r.hits == [w for w in words if w in (r.t or "")] and r["all"] == (None if r.t is None else True)


def test_translated_is_translate(spark):
    df = spark.createDataFrame([(t,) for t in ("ab", "ａ。b", "x\xa0y​", "\r​\n", "中文，é", "", None)], "t string")
    old, new = T.FULL_WIDTH[0] + "\xa0​", T.FULL_WIDTH[1] + " "
    assert all(r.a == r.b for r in df.select(T.translated(F.col("t"), old, new).alias("a"), F.translate("t", old, new).alias("b")).collect())


def test_noise_score_of_prose_looks_for_emoji_once(spark, prose):
    score = prose.select(cleaning.noise_score(F.col("text")).alias("s"))
    assert plan(score).count("1FA00") == 1
    assert seconds(score) < 10 * scan(prose)
    df = spark.createDataFrame([(t,) for t in ("a\U0001f600\U0001f600", "", " \n", "中a \U0001faff☀‍", "⬈⭐️", None)], "t string")
    old = F.regexp_count("t", F.lit(EMOJI_RANGES)) / F.nullif(F.length(F.translate("t", " \n", "")), F.lit(0))
    assert all(r.a == r.b for r in df.select(T.emoji_density(F.col("t")).alias("a"), F.coalesce(old, F.lit(0.0)).alias("b")).collect())


def test_entities_of_prose_cost_few_scans(prose):
    assert seconds(analysis.entities(prose)) < 5 * scan(prose)


def test_sieves_lose_no_entity(spark):
    random.seed(3)
    parts = [
        "a.com", "x-.com", "-a.b.cd", "a" * 63 + ".org", "b" * 64 + ".org", "c" * 130 + ".net", "a.bc1.d2", "a.com1.net", "1.2.3.4", "a..b.com", "http://x.com/y", "t.me/abc", "t.cn/", "u@v.co", "微信: abc12345", "wx abcde", "薇信:q_w-e1", "微：abcde", "VX vx_12", "QQ：12345", "扣扣 123456", "qq9999999",
        "TG @abcde", "Telegram:abcde", "飞机 xyzzy1", "电报abcde", "13812345678", "6222021234567890", "62220212345678", "支付宝 13812345678", "zfb:a@b.cd", "T" + "a1" * 16 + "b", "0x" + "ab" * 20, "x0x" + "ab" * 20, "127.0.0.1", " ", " ", ".", "the", "-", "9",
    ]
    texts = ["".join(random.choices(parts, k=random.choice([1, 2, 5, 12]))) for _ in range(3000)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    plain = df.select("id", *(F.transform(F.regexp_extract_all("text", F.lit(f"({p})" if g == 0 else p), F.lit(1)), lambda v: F.trim(v)).alias(t) for t, p, g in ENTITIES)).orderBy("id").collect()
    want = [(r.id, t, v) for r in plain for t, _, _ in ENTITIES for v in r[t]]
    got = analysis.entities(df).orderBy("id", "ordinal").collect()
    assert {t for _, t, _ in want} == {t for t, _, _ in ENTITIES}
    assert [(r.id, r.entity_type, r.entity_value) for r in got] == want


def test_needed_words_are_in_every_match():
    told = {
        "[Ll]icensed? .{0,12}under": ("icense",), "[a-z0-9]+@[a-z]+": ("@",), "(tion|ment).{0,4}(the|la)": ("tion", "ment"), "(接码|验证码.{0,3}(接|收))": ("接码", "验证码"), "ab|cd": (), "(a|b)?c*": (), "(a|b)?cd*": ("c",), r"\d{4}": (), r"\x41b": (), r"\Qab\E": (), "(?i)ab": (), "(a|)b?": (), r"\.x+\[ab": ("ab",),
        "[]a]b": ("b",), "(a(b|c)|[x(])": (), "((ab|cd)e|f)": ("e", "f"), "a{0,2}": (), "(ab|cd){0,1}": (), "(ab)+": ("ab",), "(刷.{0,2}(播放|点赞))": ("刷",),
    }
    assert {p: needed_words(p) for p in told} == told
    random.seed(4)
    patterns = [*(p for c in DEFAULT.categories for p in c.regex), *(p for _, ps in DEFAULT.evidence for p in ps)]
    assert [p for p in patterns if not needed_words(p)] == [r"[Qq薇微信]{1,2}.*\d{5,}"]
    for p in filter(needed_words, patterns):
        letters = re.sub(r"[\\(){}\[\]*+?,]", "", p) + "12345"
        for _ in range(300):
            x = "".join(random.choices([*letters.replace("|", ""), *re.findall(r"\w+", letters)], k=random.randint(2, 9)))
            assert not re.search(p, x) or any(w in x for w in needed_words(p))


def test_evidence_of_prose_costs_few_scans(prose):
    assert seconds(analysis.evidence(prose.withColumn("label", F.lit("x")))) < 6 * scan(prose)
