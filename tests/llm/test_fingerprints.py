import hashlib
import random

import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from millrace.llm import queries
from millrace.llm.fingerprints import fingerprint, half_edited, likeness, neighbours, with_next

M = (1 << 64) - 1


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def xx(values, seed=42):
    for v in values:
        raw = v.encode() if isinstance(v, str) else (v[0] & M).to_bytes(8, "little") if isinstance(v, tuple) else v.to_bytes(4, "little", signed=True)
        seed = xxhash.xxh64_intdigest(raw, seed)
    return signed(seed)


def direct(text, k=5, bins=64, width=2):
    """From the definition: every numbered k-mer, its bin and rank, the least of each bin in text order."""
    letters = regex.findall(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]|[^ \t\n\x0b\f\r\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]{1,24}", text)
    hashes = [(xx([t]),) for t in letters]
    if not hashes:
        return []
    kmers = [xx(hashes)] if len(hashes) < k else [xx(hashes[i : i + k]) for i in range(len(hashes) - k + 1)]
    seen, items = {}, []
    for i, x in enumerate(kmers):
        number = seen.get(x, 0)
        seen[x] = number + 1
        h = xx([(x,), number])
        items.append((((h >> 31) << 31) | i, i))
    out = []
    by = {}
    for item, i in sorted(items):
        by.setdefault(item >> 58, []).append(i)
    for b in sorted(by):
        chosen = sorted(by[b][:width])
        out.append(((b + bins // 2) << 32) | (xx([(kmers[i],) for i in chosen]) & 0xFFFFFFFF))
    return out


def texts():
    r = random.Random(2)
    words = ["".join(r.choices("abcdeé", k=r.randint(1, 5))) for _ in range(300)]
    out = ["", " \n", "one", "a b c d", "a b c d e", "x " * 3000, "x y z q w " * 60, "日本語のテキストです。" * 20, "a" * 500, "\U0001f600 b " * 40]
    return out + [" ".join(r.choices(words, k=n)) for n in (3, 30, 300, 3000)] + ["\n".join(" ".join(r.choices(words[:6], k=7)) for _ in range(40))]


def test_signatures_against_the_definition(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts())], "id int, text string")
    for r in df.select("text", fingerprint(F.col("text")).alias("s")).collect():
        assert r.s == direct(r.text), r.text[:40]


def test_order_counts(spark):
    r = random.Random(3)
    words = ["".join(r.choices("abcdefgh", k=4)) for _ in range(400)]
    moved = words[200:] + words[:200]
    swapped = words[:]
    for i in range(0, 400, 8):
        swapped[i : i + 4], swapped[i + 4 : i + 8] = swapped[i + 4 : i + 8], swapped[i : i + 4]
    near = lambda x: spark.range(1).select(likeness(fingerprint(F.lit(" ".join(words))), fingerprint(F.lit(" ".join(x)))).alias("n")).first().n
    assert near(words) == 1 and 0.3 < near(moved) < 0.75 and near(swapped) < 0.1
    assert 0.6 < near([*words[:200], "zzzz", *words[200:]]) < 1


def test_neighbours(spark):
    ids = [5, -3, 100, 2**62, 7]
    df = spark.createDataFrame([(x, x) for x in ids], "key long, n long")
    got = {r.key: (r.before, r.before_n) for r in neighbours(df.repartition(7)).collect()}
    order = sorted(ids, reverse=True)
    assert got == {k: (order[i - 1], order[i - 1]) for i, k in enumerate(order)}
    assert neighbours(df.limit(0)).count() == 0


def test_odd_rows(make):
    rows = [(3, "abcde"), (9, None), (None, "zz"), (1, "é\U0001f600xyzw"), (3, "abcde"), (3, "b"), (8, "w " * 60000)]
    out = with_next(make(rows)).withColumn("e", half_edited(F.col("text"), F.col("next_text"))).collect()
    edits = sorted((str(r.doc_id), r.text[:6], r.e[:6]) for r in out)
    assert edits == sorted([("9", "", ""), ("8", "w w w ", "w w w "), ("3", "abcde", "abcé\U0001f600"), ("3", "abcde", "abcé\U0001f600"), ("3", "b", "b"), ("1", "é\U0001f600xyzw", "é\U0001f600xzz"), ("None", "zz", "z")])
    single = with_next(make([(4, "abcd")])).collect()
    assert [(r.next_text, r.signature == r.next_signature) for r in single] == [("ab", True)]
    assert with_next(make([])).count() == 0


def test_many_rows_without_an_id(make):
    many = [(None, f"w{i} " * 8) for i in range(600)]
    out = with_next(make([*many, (5, "abcd"), (7, "efgh")])).collect()
    assert len(out) == 602
    by = {r.doc_id: r for r in out if r.doc_id is not None}
    # after 7 comes 5, after 5 one of the rows without an id, after each of those the first document again
    assert by[7].next_text == "ab" and by[5].next_text in {t[:2] for _, t in many}
    assert {r.next_text for r in out if r.doc_id is None} == {"efgh"}


def test_query(spark, sf_dir):
    docs = sorted(((r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()), reverse=True)
    got = {r.doc_id: r for r in queries.op1_order_minhash(spark, sf_dir).collect()}
    assert len(got) == len(docs)
    write = lambda s: "".join(f"{x:010x}" for x in s)
    for i, (doc, text) in enumerate(docs):
        r, after = got[doc], docs[(i + 1) % len(docs)][1]
        n = len(text) // 2
        edited = text[: len(text) - n] + after[:n]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        if i % 10 == 0:
            a, b, c = direct(text), direct(edited), direct(after)
            near = lambda x, y: 1.0 if not x and not y else len(set(x) & set(y)) / len({v >> 32 for v in [*x, *y]})
            assert (r.fingerprint, r.edited_fingerprint) == (write(a), write(b))
            assert (r.near_edited, r.near_next) == pytest.approx((near(a, b), near(a, c)))
    assert sum(r.near_edited > r.near_next for r in got.values()) > 0.97 * len(got)
