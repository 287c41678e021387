import random
import re
from collections import Counter

import numpy as np
import oracle
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.llm import quality_rules, queries
from millrace.llm.quality_rules import RULES, Rule, Text, ordered

COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_lettered", "n_shouted", "n_top_pair")
WORD = r"[^\x20\x09-\x0D]+"


def plain(text):
    text = text or ""
    words = re.findall(WORD, text)
    threes = Counter(zip(words, words[1:], words[2:], strict=False))
    again = {i + k for i in range(len(words) - 2) if threes[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    pairs = Counter(zip(words, words[1:], strict=False))
    shouted = [w for w in words if len(regex.findall(r"\p{Lu}", w)) > 1 and not regex.search(r"\p{Ll}", w)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(again), len(lines), sum(bool(regex.search(r"\p{L}", w)) for w in words), len(shouted), max(pairs.values(), default=0))


def plain_kept(m):
    n, chars, symbols, dup, rep, lines, lettered, shouted, top = m
    return not (n < 50 or 100 * rep > 50 * n or 10 * symbols > n or chars < 2 * n or chars > 20 * n or 2 * dup > lines or 10 * lettered < 7 * n or 10 * shouted > 3 * n or 5 * top > n)


@given(st.text(alphabet="aAbÉß1#| \n\t \x0b\xa0", max_size=120))
@settings(max_examples=300)
def test_measures_against_plain_counts(text):
    t = Text(text.encode())
    assert tuple(t[c] for c in COLUMNS) == plain(text)


def test_measures_over_slices(monkeypatch):
    monkeypatch.setattr(quality_rules, "SLICE", 5)
    r = random.Random(3)
    for _ in range(50):
        text = "".join(r.choice(["a", "bb", "longer-word", " ", "\n", "é", "# "]) for _ in range(60))
        t = Text(text.encode())
        assert tuple(t[c] for c in COLUMNS) == plain(text)


def texts():
    r = random.Random(5)
    words = ["the", "of", "Éaux", "word", "A1", "thing", "over", "under", "and", "some", "more", "far", "long", "short"]
    fine = lambda n: " ".join(r.choice(words) + str(r.randint(0, 99)) + "x" for _ in range(n))
    return [fine(80), fine(49), "", None, " \n ", "same line here\n" * 30 + fine(60), fine(60).upper(), " ".join("12 34 56".split() * 30), "# " * 20 + fine(60), fine(55) + " a b" * 40, "x" * 3000, fine(30000), "日本語" * 40 + " " + fine(50)]


def test_judge_against_plain_rules_in_any_order(make):
    given_texts = texts()
    docs = make([*enumerate(given_texts), (0, given_texts[0]), (None, given_texts[1])])
    want = {i: plain(t) for i, t in enumerate(given_texts)}
    for rules in (RULES, RULES[::-1]):
        out = quality_rules.judge(docs, rules, columns=COLUMNS, keep=("doc_id", "size")).collect()
        assert len(out) == len(given_texts) + 2 and {r["size"] for r in out} == {"z"}
        for r in out:
            m = want[r.doc_id] if r.doc_id is not None else want[1]
            assert tuple(r[c] for c in COLUMNS) == m and r.kept == plain_kept(m) == (r.rejected_by is None)
    assert {r.kept for r in out} == {True, False}
    assert quality_rules.judge(docs.limit(0)).collect() == []


def test_order_is_by_rejection_for_cost():
    rules = tuple(Rule(n, needs, None) for n, needs in (("dear", ("a",)), ("cheap", ("b",)), ("shares", ("a", "c")), ("idle", ())))
    seconds = np.array([[9.0, 1.0, 1.0]] * 4)
    rejects = np.array([[1, 1, 0, 0], [1, 0, 0, 0], [1, 0, 1, 0], [0, 0, 1, 0]], bool)
    assert ordered(seconds, rejects, rules, ("a", "b", "c")) == [1, 0, 2, 3]  # a quarter for 1, then two thirds for 9, the rest for 1 more
    assert ordered(seconds, rejects, rules, ("a", "b", "c"), paid=("a",)) == [0, 2, 1, 3]


def test_later_rules_measure_only_what_is_left(make, monkeypatch):
    """A rule behind one that rejects all measures nothing but on the sample."""
    asked = Rule("asked", ("n_top_pair",), lambda t: 1 / 0 if t["n_words"] == 77 else False)
    monkeypatch.setattr(quality_rules, "plan", lambda docs, rules, *_: rules)
    all_fail = Rule("all", (), lambda t: True)
    docs = make([(1, "w " * 77)])
    assert [r.rejected_by for r in quality_rules.judge(docs, (all_fail, asked)).collect()] == ["all"]


def test_the_query_is_its_sql(spark, sf_dir):
    assert oracle.rows_of_frame(queries.op12_quality_rules(spark, sf_dir)) == oracle.rows_of(queries.OP12_SQL, sf_dir)


def test_good_documents_stay_and_bad_ones_go(spark, sf_dir):
    judged = queries.op12_quality_rules(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").filter("not base_failed")
    share = {r.quality: r.share for r in judged.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("share")).collect()}
    assert share[1] > 0.99 and share[0] < 0.1
