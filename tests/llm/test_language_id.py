import itertools
import zlib

import numpy as np

from millrace.llm import queries
from millrace.llm.language_id import chains, fit, forward_backward, identify, labelled, spans, train


def test_forward_backward_against_all_paths():
    r = np.random.default_rng(3)
    e, t = r.normal(size=(9, 3)), r.normal(size=(3, 3))
    starts, lengths = np.array([0, 4]), np.array([4, 5])
    post, pairs = forward_backward(e, t, starts, lengths, edges=True)
    want, moves = np.zeros_like(e), np.zeros((3, 3))
    for s, n in zip(starts, lengths, strict=True):
        weights = {}
        for path in itertools.product(range(3), repeat=int(n)):
            weights[path] = np.exp(sum(e[s + i, y] for i, y in enumerate(path)) + sum(t[a, b] for a, b in itertools.pairwise(path)))
        z = sum(weights.values())
        for path, w in weights.items():
            for i, y in enumerate(path):
                want[s + i, y] += w / z
            for a, b in itertools.pairwise(path):
                moves[a, b] += w / z
    assert np.allclose(post, want) and np.allclose(pairs, moves)


def test_chains():
    starts, lengths = chains(np.array([0] * 5 + [2] * 2), 3, 2)
    assert starts.tolist() == [0, 2, 4, 5] and lengths.tolist() == [2, 2, 1, 2]


def test_code_switched_text(spark, make):
    a, b = "the cat and this dog are with that man there ", "der hund und diese katze sind nicht hier mit dem mann "
    model = fit([a * 30, b * 30], ["en", "de"])
    docs = make([(1, a * 3 + b * 3), (2, None), (3, "12 !?"), (4, ""), (5, a * 20000), (6, "katze"), (6, "katze")])
    got = {(r.first_word, r.words): r.lang for r in spans(docs, model).filter("doc_id = 1").collect()}
    assert got == {(0, 30): "en", (30, 33): "de"}
    out = {r.doc_id: (r.lang_pred, r.score) for r in identify(docs, model).collect()}
    assert out[2] == out[3] == out[4] == ("und", 0.0) and out[5][0] == "en" and out[6][0] == "de" and 0.45 < out[1][1] < 0.6
    assert identify(docs, model).count() == 7 and identify(make([]), model).count() == 0
    assert identify(docs, train(make([]))).filter("lang_pred <> 'und'").count() == 0


def test_sample_is_of_distinct_texts(make):
    distinct = {"en": ["the word %d" % i for i in range(6)], "de": ["das Wort %d" % i for i in range(3)], "fr": ["le mot"], "it": ["una parola %d" % i for i in range(8)]}
    rows = [(0, t, lang) for lang, texts in distinct.items() for t in texts for _ in range(200 if lang != "it" or t == texts[0] else 1)]
    got = [(r.lang, r.text) for r in labelled(make(rows), per_language=4).collect()]
    assert len(got) == len(set(got)) and all(t in distinct[lang] for lang, t in got)
    assert {lang: sum(x == lang for x, _ in got) for lang in distinct} == {"en": 4, "de": 3, "fr": 1, "it": 4}


def test_sample_is_bounded_in_characters_too(make):
    rows = [(i, f"word{i} " * 500, "en") for i in range(9)] + [(20, "wort " * 100_000, "de"), (21, "ohne", None), (22, None, "de")]
    got = labelled(make(rows), characters=20_000).collect()
    assert all(len(r.text) <= 10_000 for r in got) and {r.lang for r in got} == {"en", "de"}
    assert sum(len(r.text) for r in got if r.lang == "en") < 20_000
    assert train(make(rows), characters=20_000).languages == ["de", "en"]


def test_ties_give_the_first_language(make):
    model = fit(["word here", "word here"], ["en", "de"])
    (row,) = identify(make([(1, "word here")]), model).collect()
    assert row.lang_pred == "de" and row.score >= 0.5 - 1e-9


def test_query_on_held_out_documents(spark, sf_dir):
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang").collect()}
    rows = queries.op4_language_id(spark, sf_dir).collect()
    assert {r.doc_id for r in rows} == set(langs) and len(rows) == len(langs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == langs[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)
