import random
import re

import numpy as np
import pyarrow as pa

from millrace.llm import queries
from millrace.llm.ngram_join import bitmaps, candidates, cross_pairs, most_shared, near_duplicates, probe_length, shingle_sets, survivors


def direct_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def direct(rows):
    """(doc_id, n, smallest doc_id reachable), comparing all pairs."""
    sets = [direct_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    by_shingle = {}
    for i, s in enumerate(sets):
        for x in s:
            by_shingle.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        for j in {k for x in s for k in by_shingle[x] if k < i}:
            both = len(s & sets[j])
            if 100 * both >= 75 * (len(s) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return sorted((d, len(s), least[root(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def family(seed=1):
    """Near copies around the limit, chains, shared passages, copies, short texts."""
    r = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(4000)]
    passage = r.choices(vocabulary, k=60)
    texts = []
    for _ in range(12):
        base = r.choices(vocabulary, k=r.randint(5, 160))
        for _ in range(r.randint(1, 8)):
            words = base[:]
            for _ in range(r.randint(0, 5)):
                words[r.randrange(len(words))] = r.choice(vocabulary)
            if r.random() < 0.3:
                words = words[: r.randint(1, len(words))]
            texts.append(" ".join(words))
            base = words if r.random() < 0.4 else base
    for _ in range(25):
        texts.append(" ".join(r.choices(vocabulary, k=r.randint(5, 60)) + passage + r.choices(vocabulary, k=r.randint(0, 30))))
    texts += ["", " \n", "one", "One", "one two", "a b c d e", "A  B c D\te", "x " * 300, "x " * 4, texts[0].upper(), texts[0] + "\n", "É é \U0001f600 q r s t"]
    order = list(range(len(texts)))
    r.shuffle(order)
    return [(10 + 7 * i, texts[k]) for i, k in enumerate(order)]


def test_sets():
    texts = [t for _, t in family()] + [None, "longword" * 50 + " b c d e f"]
    hashes, starts = shingle_sets(pa.array([t or "" for t in texts]))
    sets = [direct_set(t) for t in texts]
    assert np.diff(starts).tolist() == [len(s) for s in sets]
    named = {}
    for i, s in enumerate(sets):
        for x in s:
            named.setdefault(x, set()).add(i)
    where = {}
    for i in range(len(texts)):
        for h in hashes[starts[i] : starts[i + 1]].tolist():
            where.setdefault(h, set()).add(i)
    assert sorted(map(sorted, where.values())) == sorted(map(sorted, named.values()))


def test_sets_of_few_words():
    for words in range(6):
        text = " ".join("abcde"[:words])
        for texts in ([text], [text, ""], ["", text], [text, "a b"], ["x" * (1 << 20), text, "y" * (1 << 20)]):
            assert np.diff(shingle_sets(pa.array(texts))[1]).tolist() == [len(direct_set(t)) for t in texts]


def test_bitmaps_bound_and_prefixes_suffice():
    r = random.Random(4)
    for _ in range(300):
        n, m = r.choice(((1, 60), (1, 60), (90, 400), (400, 90), (300, 700)))
        n, m = r.randint(1, n), r.randint(1, m)
        shared = r.randint(0, min(n, m))
        a = np.array(sorted(r.sample(range(1 << 62), n)), np.uint64)
        b = np.unique(np.concatenate([a[:shared], np.array(r.sample(range(1 << 62), m - shared), np.uint64)]))
        x, y = bitmaps(np.concatenate([a, b]), np.array([0, n, n + m]))
        assert shared <= most_shared(x, n, y, m) <= min(n, m)
        if 100 * shared >= 75 * (n + m - shared):
            (small, large) = (a, b) if n <= m else (b, a)
            assert set(small[: probe_length(len(small))].tolist()) & set(large[: probe_length(len(large))].tolist())


def test_cross_pairs_find_every_pair_that_links_across_labels():
    r = random.Random(5)
    for trial in range(60):
        base = r.sample(range(1, 10**6), 90)
        sets = [sorted({*r.sample(base, r.randint(20, 90)), *r.sample(range(10**6, 2 * 10**6), r.randint(0, 9))}) for _ in range(r.choice((5, 30, 90)))]
        labels = [r.choice((0, 0, 0, i)) for i in range(len(sets))]
        rows = sorted((t, -1, i, len(x), k, labels[i], *[x[k - b] if k >= b else 0 for b in (1, 2, 3, 4)]) for i, x in enumerate(sets) for k, t in enumerate(x[: probe_length(len(x))]))
        got = [tuple(x) for x in cross_pairs(*(np.array(c, np.int64) for c in zip(*rows, strict=True))).tolist()]
        assert len(got) == len(set(got)) and all(a < b and labels[a] != labels[b] for a, b in got)
        for b, y in enumerate(sets):
            for a, x in enumerate(sets[:b]):
                same = len({*x} & {*y})
                if labels[a] != labels[b] and 100 * same >= 75 * (len(x) + len(y) - same):
                    assert (a, b) in got


def test_candidates_with_classes_on_both_sides_of_16(spark):
    for low, high in ((10, 16), (3, 31), (15, 20), (2, 9), (17, 30)):
        rows = []
        for node in (1, 2):
            tokens = sorted([*(1 << 59 | 1000 * node + k for k in range(14)), *(low << 59 | k + 1 for k in range(10)), *(high << 59 | k + 1 for k in range(76))])
            shared = [(t, place) for place, t in enumerate(tokens[: probe_length(100)]) if t >> 59 > 1]
            rows += [(t - (t >> 63 << 64), node, 100, place, node) for t, place in shared]
        assert [tuple(r) for r in candidates(spark.createDataFrame(rows, "token long, node long, n long, place int, label long")).collect()] == [(1, 2)]


def test_tiles_of_any_size_give_the_same_pairs(spark):
    r = random.Random(9)
    base = r.sample(range(1, 10**6), 40)
    sets = [sorted(r.sample(base, r.randint(25, 40))) for _ in range(40)]
    rows = [(t, i, len(x), k, r.choice((0, 0, i)) if i % 3 else 0) for i, x in enumerate(sets) for k, t in enumerate(x[: probe_length(len(x))])]
    label = {i: c for _, i, _, _, c in rows}
    df = spark.createDataFrame([(t, i, n, k, label[i]) for t, i, n, k, _ in rows], "token long, node long, n long, place int, label long")
    whole = sorted(map(tuple, candidates(df).collect()))
    assert whole and all(sorted(map(tuple, candidates(df, most).collect())) == whole for most in (1, 3, 16))


def test_survivors_are_told_by_row(make):
    same, other = "a b c d e f g", "q r s t u v w"
    docs = make([(None, same), (4, same), (None, other), (6, None), (6, " "), (6, same + " h"), (8, other), (8, other), (8, "1 2 3 4 5 6"), (9, "1 2 3 4 5 6")])
    left = survivors(docs)
    assert left.columns == docs.columns
    assert sorted((str(r.doc_id), str(r.text)) for r in left.collect()) == [("4", same), ("6", " "), ("6", "None"), ("8", "1 2 3 4 5 6"), ("8", other)]
    assert survivors(docs.limit(0)).count() == 0


def test_against_all_pairs(spark, make):
    for seed in (1, 2):
        rows = family(seed)
        assert sorted(map(tuple, near_duplicates(make(rows), counters=1 << 12).collect())) == direct(rows)


def test_odd_rows(make):
    rows = [(5, None), (5, None), (None, "a b c"), (4, "a b c"), (None, "q"), (7, "z " * 9), (7, "z " * 9), (9, "w%d " * 3), (3, " ".join(map(str, range(30000)))), (2, " ".join(map(str, range(29000))))]
    got = sorted(map(str, map(tuple, near_duplicates(make(rows), counters=1 << 12).collect())))
    assert got == sorted(map(str, [(5, 0, 5), (5, 0, 5), (None, 1, 4), (4, 1, 4), (None, 1, None), (7, 1, 7), (7, 1, 7), (9, 1, 9), (3, 29996, 2), (2, 28996, 2)]))
    assert near_duplicates(make([]), counters=1 << 12).count() == 0


def test_query(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = sorted(map(tuple, queries.op9_ngram_jaccard(spark, sf_dir).collect()))
    assert got == direct(rows)
    assert len({c for *_, c in got}) < len(got)
