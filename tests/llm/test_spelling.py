import random
import zlib
from collections import Counter

import oracle
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import queries, spelling


def edits(word, letters):
    out = {word[:k] + word[k + 1 :] for k in range(len(word))}
    for c in letters:
        out |= {word[:k] + c + word[k:] for k in range(len(word) + 1)} | {word[:k] + c + word[k + 1 :] for k in range(len(word))}
    return out - {word}


def plain(counts):
    letters = sorted({c for w in counts for c in w})
    out = {}
    for w, n in counts.items():
        near = [v for v in edits(w, letters) if v in counts] if len(w) < 40 else [v for v in counts if spelling.one_edit(w, v)]
        best = min(near, key=lambda v: (-counts[v], v), default=None)
        out[w] = (best if best is not None and counts[best] >= 10 * n else None, n, len(near))
    def root(w):
        return w if out[w][0] is None else root(out[w][0])
    return {w: (form, root(w), n, near, counts[form] if form is not None else None) for w, (form, n, near) in out.items()}


def found(df):
    rows = df.select("word", "form", "root", "n", "n_near", "form_n").collect()
    out = {r[0]: tuple(r[1:]) for r in rows}
    assert len(out) == len(rows)
    return out


@given(st.text(alphabet="aAÉß×", max_size=9), st.text(alphabet="aAÉß×", max_size=9))
@settings(max_examples=400)
def test_one_edit(a, b):
    assert spelling.one_edit(a, b) == (b in edits(a, "aAÉß×"))


@given(st.lists(st.lists(st.integers(0, 30), unique=True).map(sorted), max_size=9), st.integers(1, 5))
@settings(max_examples=400)
def test_heap_merge_with_look_ups(postings, enough):
    counts = Counter(x for one in postings for x in one)
    assert list(spelling.in_enough([*postings], enough)) == sorted(x for x, n in counts.items() if n >= enough)


def invented(seed, alphabet, n, least, most):
    r = random.Random(seed)
    words = {"".join(r.choice(alphabet) for _ in range(r.randint(least, most))) for _ in range(n)}
    for w in [*words]:
        for _ in range(r.randint(0, 3)):
            words.add(r.choice(sorted(edits(w, alphabet[:2]))))
    return {w: r.choice([2, 3, 5, 25, 300, 4000]) for w in words}


@pytest.mark.parametrize(("alphabet", "least", "most", "crowd"), [("abcdé", 7, 9, 4096), ("ab", 7, 10, 4096), ("ab", 7, 10, 8), ("abc", 62, 67, 4096), ("abc", 62, 67, 2), ("ab÷", 3, 8, 4096)])
def test_variants_are_those_of_all_edits(spark, monkeypatch, alphabet, least, most, crowd):
    monkeypatch.setattr(spelling, "MOST", crowd)
    counts = invented(crowd + most, alphabet, 60, least, most)
    words = spark.createDataFrame([(w, n, "x", "y") for w, n in counts.items()], "word string, n long, key string, root string")
    assert found(spelling.variants(words)) == plain(counts)


def test_chains_lead_to_their_end(spark):
    chain = ["aaaaaaa", "aaaaaab", "aaaaabb", "aaaabbb", "aaabbbb", "aabbbbb"]
    counts = {w: 2 * 10**k for k, w in enumerate(chain)}
    out = found(spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long")))
    assert {r[1] for r in out.values()} == {chain[-1]} and out == plain(counts)


def test_vocabulary_against_plain_counts(make, monkeypatch):
    monkeypatch.setattr(spelling, "SLICE", 7)
    monkeypatch.setattr(spelling, "HELD", 3)
    texts = ["Spelling spelling SPELLING, Éclairs éclairs", "can't misspelt-words over_under words9words", None, "", "×÷ " + "letters " * 40, "a" * 5000, "letters" * 30 + " ſtrange ﬁnally"]
    docs = make([*enumerate(texts), (None, texts[0]), (0, texts[0])])
    for doc_id in ("doc_id", None):
        want = Counter()
        for i, text in [*enumerate(texts), (None, texts[0]), (0, texts[0])]:
            run = ""
            for c in (text or "") + " ":
                if "A" <= c <= "Z" or "a" <= c <= "z" or "À" <= c <= "ÿ":
                    run += c.lower() if c < "\x7f" else c
                elif run:
                    h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
                    want[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 and doc_id else run] += 1
                    run = ""
        got = {r.word: r.n for r in spelling.vocabulary(docs, doc_id=doc_id, least_length=1, least_n=1).collect()}
        assert got == {w: n for w, n in want.items() if w}
    assert spelling.vocabulary(docs, doc_id="doc_id").filter("length(word) < 7 or n < 2").count() == 0


def test_no_words(spark, make):
    assert found(spelling.variants(spelling.vocabulary(make([(1, "a b"), (2, None)])))) == {}
    assert found(spelling.variants(spelling.vocabulary(make([(1, "x")]).limit(0), doc_id="doc_id"))) == {}


def test_the_query_is_its_sql(spark, sf_dir):
    assert oracle.rows_of_frame(queries.op13_spelling_variants(spark, sf_dir)) == oracle.rows_of(queries.OP13_SQL, sf_dir)
