import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from millrace.llm import queries
from millrace.llm.suffix_dedup import IndexFamily, Shape, blocks, cleaned


def direct(rows, length):
    """(doc_id, bytes, spans, kept): counts every string of the length."""
    bodies = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(b[i : i + length] for _, b in bodies for i in range(len(b) - length + 1))
    out = []
    for d, b in bodies:
        gone = np.zeros(len(b) + 2, bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i + 1 : i + length + 1] = True
        edge = np.flatnonzero(np.diff(gone.astype(int)))
        out.append((d, len(b), [tuple(x) for x in edge.reshape(-1, 2).tolist()], b"".join(bytes([x]) for x, g in zip(b, gone[1:], strict=False) if not g)))
    return sorted(out, key=str)


def found(df):
    return sorted(((r.doc_id, r.n_bytes, [tuple(x) for x in r.spans], bytes(r.kept)) for r in df.collect()), key=str)


def corpus(seed, scale):
    r = random.Random(seed)
    text = lambda n: "".join(r.choices("abcdé \n", k=n))
    shared = [text(r.randint(scale // 2, 4 * scale)) for _ in range(4)]
    rows = []
    for _ in range(40):
        parts = [text(r.randint(0, 3 * scale)) if r.random() < 0.6 else r.choice(shared)[r.randint(0, scale) : r.randint(scale, 4 * scale)] for _ in range(r.randint(0, 5))]
        rows.append("".join(parts))
    rows += [rows[3], rows[3], "ab" * scale * 2, "x" * 3 * scale, "", None, rows[5] + rows[5], "é" * scale]
    return [(i, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("shape", [Shape(24, 4), Shape(25, 8), Shape(9, 2)])
def test_equal_strings_have_equal_keys_and_every_string_one_owner(shape):
    r = random.Random(1)
    raw = bytes(r.choices(b"ab", k=700))
    bounds = np.array([0, 5, 5, 300, 300 + shape.length, 700])
    b = blocks(np.frombuffer(raw, np.uint8), bounds, shape)
    owner = {}
    for q, low, high, key in zip(b.q.tolist(), b.low.tolist(), b.high.tolist(), b.key.tolist(), strict=True):
        for e in range(low, high + 1):
            assert q - e not in owner
            owner[q - e] = (key, e)
    starts = [s for d in range(5) for s in range(bounds[d], bounds[d + 1] - shape.length + 1)]
    assert sorted(owner) == starts
    by = {}
    for s in starts:
        by.setdefault(raw[s : s + shape.length], set()).add(owner[s])
    assert all(len(x) == 1 for x in by.values())


@pytest.mark.parametrize(("shape", "batches", "most"), [(Shape(24, 4), 4, 20000), (Shape(24, 4), 1, 3), (Shape(25, 8), 7, 2), (Shape(40, 6), 3, 20000)])
def test_against_counting_all_strings(make, shape, batches, most):
    rows = corpus(shape.length + batches, shape.length)
    assert found(cleaned(make(rows), shape=shape, batches=batches, most=most)) == direct(rows, shape.length)


@pytest.mark.parametrize(("shape", "batches", "most"), [(Shape(40, 4, 24), 2, 20000), (Shape(40, 4, 24), 3, 2), (Shape(31, 8, 20), 1, 20000)])
def test_passages_that_documents_share(make, shape, batches, most):
    r = random.Random(shape.length)
    text = lambda n: "".join(r.choices("abcdefgh", k=n))
    passages = [text(n) for n in (shape.passage - 1, shape.passage, shape.passage + 1, shape.length - 1, shape.length, 3 * shape.length)]
    rows = corpus(3, shape.passage) + [(100 + 2 * i + j, text(r.randint(0, 60)) + f"<{j}" + p + f"{j}>" + text(r.randint(0, 60))) for i, p in enumerate(passages) for j in range(2)]
    own = text(50)
    rows += [(300, own + text(9) + own), (301, passages[3][: shape.passage] + text(5) + passages[3][: shape.passage])]
    out = cleaned(make(rows), shape=shape, batches=batches, most=most)
    assert found(out) == direct(rows, shape.length)
    holders = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - shape.passage + 1):
            holders.setdefault(b[i : i + shape.passage], set()).add(d)
    want = {d for x in holders.values() if len(x) > 1 for d in x}
    assert {x.doc_id for x in out.collect() if x.shares_passage} == want and {102, 103, 301} <= want and not {100, 300} & want


def test_planted_strings_of_399_400_and_401_bytes(make):
    r = random.Random(8)
    text = lambda n: "".join(r.choices("abcdefghij ", k=n))
    planted = {n: text(n) for n in (255, 256, 399, 400, 401)}
    rows = [(n * 10 + j, f"{j}" + text(700) + f"<{j}" + p + f"{j}>" + text(300)) for n, p in planted.items() for j in (1, 2)]
    got = {x.doc_id: (x.n_bytes - len(x.kept), x.shares_passage) for x in cleaned(make(rows), shape=Shape(passage=256)).collect()}
    assert got == {n * 10 + j: (n if n >= 400 else 0, n >= 256) for n in planted for j in (1, 2)}


def test_levels_are_those_of_a_binary_counter(spark):
    docs = spark.createDataFrame([(i, "abcdefgh" * 9 + str(i)) for i in range(10)], "doc_id long, text string")
    family = IndexFamily(spark, Shape(24, 4))
    for i in range(5):
        family.add(docs.filter(f"doc_id % 5 = {i}"))
    assert [x is not None for x in family.levels] == [True, False, True]
    family.close()


def test_odd_rows(make):
    rows = [(1, "q" * 500), (2, None), (3, ""), (None, "z" * 399), (None, "é" * 199 + "a"), (7, "once " * 90000), (8, "k%d " * 3), (8, "".join(map(str, range(2000)))), (8, "".join(map(str, range(2000))))]
    out = cleaned(make(rows)).collect()
    got = sorted((str(r.doc_id), r.n_bytes, len(r.kept)) for r in out)
    n = len("".join(map(str, range(2000))))
    assert got == sorted([("1", 500, 0), ("2", 0, 0), ("3", 0, 0), ("None", 399, 399), ("None", 399, 399), ("7", 450000, 0), ("8", 12, 12), ("8", n, 0), ("8", n, 0)])
    assert cleaned(make([])).count() == 0


def test_query(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    bodies = {d: (t or "").encode() for d, t in rows}
    count, power = Counter(), pow(257, 400, (1 << 61) - 1)
    hashes = {}
    for d, b in bodies.items():
        h, out = 0, []
        for i, c in enumerate(b):
            h = (h * 257 + c + 1) % ((1 << 61) - 1)
            if i >= 400:
                h = (h - (b[i - 400] + 1) * power) % ((1 << 61) - 1)
            if i >= 399:
                out.append(h)
        hashes[d] = out
        count.update(out)
    got = {r.doc_id: r for r in queries.op6_suffix_dedup(spark, sf_dir).collect()}
    for d, b in bodies.items():
        gone, end, spans = bytearray(len(b)), 0, 0
        for i, h in enumerate(hashes[d]):
            if count[h] > 1:
                spans += i > end or not end
                gone[max(i, end) : i + 400] = b"\1" * (i + 400 - max(i, end))
                end = i + 400
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        r = got[d]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()), d
    assert sum(r.n_removed for r in got.values()) > 0
