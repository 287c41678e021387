import random

import pytest

from millrace.operators import dedup

KIND = "id long, batch_seq long, simhash long, clean_text string, author string, is_noise boolean, is_media_only boolean, h string, at string, a string, t string"


def direct(rows, most=3, remember_noise=False):
    """The decisions one after the other; rows: (id, seq, hash, length, author, noise, media)."""
    seen, out = {}, {}
    for i, _, h, n, author, noise, media in sorted(rows, key=lambda r: r[1]):
        u, author = h & (1 << 64) - 1, author.strip() or "__unknown__"
        if media:
            seen.setdefault(u, {}).setdefault(author, (i, n))
            out[i] = ("media", None, None)
            continue
        if noise and not remember_noise:
            out[i] = ("noise", None, None)
            continue
        limit = 0 if n < 30 else max(1, most // 2) if n < 80 else most
        k = next((k for k in seen if len(f"{k:x}") == len(f"{u:x}") and (k ^ u).bit_count() <= limit), None)
        if k is None:
            out[i] = ("new", None, None)
        elif author in seen[k]:
            out[i] = ("duplicate", seen[k][author][0], "x" * min(80, seen[k][author][1]))
            continue
        else:
            others = [a for a in seen[k] if a != "__unknown__"][:3]
            out[i] = ("similar", next(iter(seen[k].values()))[0], f"author(s): {', '.join(others)}" if others else "cross-author match")
        seen.setdefault(u, {}).setdefault(author, (i, n))
    return out


def invented(seed, n, bases=12, authors="abcdef "):
    r = random.Random(seed)
    starts = [r.getrandbits(64) for _ in range(bases)] + [r.getrandbits(50)]
    rows = []
    for i in range(n):
        h = r.choice(starts)
        for _ in range(r.choice((0, 0, 1, 2, 4))):
            h ^= 1 << r.randrange(64)
        h -= (1 << 64) * (h >> 63)
        rows.append((i, r.randrange(10**6) * 1000 + i, h, r.choice((10, 50, 200)), r.choice(authors), r.random() < 0.1, r.random() < 0.05))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, s, h, "x" * n, a, z, m, *"wxyz") for i, s, h, n, a, z, m in rows], KIND)


def found(df):
    rows = df.collect()
    out = {r.id: (r.dup_type, r.similar_to, r.similar_note) for r in rows}
    assert len(out) == len(rows) and all(r["h"] == "w" for r in rows)
    return out


@pytest.mark.parametrize(("seed", "n", "bases", "noisy"), [(1, 150, 12, False), (2, 200, 2, False), (3, 80, 40, True)])
def test_decisions_are_those_of_the_fold(spark, seed, n, bases, noisy):
    rows = invented(seed, n, bases)
    assert found(dedup.author_aware(frame(spark, rows), remember_noise=noisy)) == direct(rows, remember_noise=noisy)


def test_a_chain_in_which_each_post_decides_about_the_next(spark):
    h, rows = 0, []
    for i in range(14):  # a bit more each: a post is near the two or three before it
        h |= 1 << (63 - 2 * i)
        rows.append((i, i, h - (1 << 64), 200, "ab"[i % 3 == 0], False, False))
    assert found(dedup.author_aware(frame(spark, rows))) == direct(rows)


def test_a_third_of_all_posts_is_one_text_of_many_authors(spark):
    rows = [(i, i, 5 if i % 3 == 0 else (i * 0x9E3779B97F4A7C15 >> 1) & (1 << 62) - 1, 200, f"author {i % 500}" if i % 2 else "robot", False, False) for i in range(3000)]
    assert found(dedup.author_aware(frame(spark, rows))) == direct(rows)


def test_posts_in_parts_are_decided_as_at_once(spark):
    rows = sorted(invented(6, 160, 4), key=lambda r: r[1])
    want, told, remembered = direct(rows), {}, None
    for part in (rows[:60], rows[60:61], rows[61:]):
        out, added = dedup.decided(frame(spark, part), remembered=remembered)
        told |= found(out)
        added = spark.createDataFrame(added.collect(), added.schema)
        remembered = added if remembered is None else remembered.union(added)
    assert told == want


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, 1, None, None, None, None), (2, 2, None, "", " ", False), (3, 3, 7, "y" * 90, None, None), (4, 4, 7, "y" * 90, "", None), (4, 4, 7, "y" * 90, "", None)], "id long, batch_seq long, simhash long, clean_text string, author string, is_noise boolean")
    rows = sorted((r.id, r.dup_type, r.similar_to) for r in dedup.author_aware(df).collect())
    assert rows == [(1, "new", None), (2, "new", None), (3, "new", None), (4, "duplicate", 3), (4, "duplicate", 3)]
    assert dedup.author_aware(df.limit(0)).count() == 0 and dedup.classes(df.limit(0)).count() == 0
    assert sorted(map(tuple, dedup.classes(df).select("id", "class_id", "links").collect())) == [(1, 1, 0), (2, 1, 0), (3, 3, 0), (4, 3, 0), (4, 3, 0)]


@pytest.mark.parametrize("equal", [1, 2, 3])
def test_pairs_of_hashes_by_any_number_of_blocks(spark, equal):
    hashes = sorted({h for _, _, h, *_ in invented(9, 300, 8)})
    want = {(x, y) for x in hashes for y in hashes if x < y and ((x ^ y) & (1 << 64) - 1).bit_count() <= 3 and len(f"{x & (1 << 64) - 1:x}") == len(f"{y & (1 << 64) - 1:x}")}
    df = spark.createDataFrame([(h,) for h in hashes], "simhash long")
    assert {(r.x, r.y) for r in dedup.similar_hashes(df, equal=equal).collect()} == want
    old, new = df.filter("simhash % 3 = 0"), df.filter("simhash % 3 <> 0")
    assert {(r.x, r.y) for r in dedup.similar_hashes(new, equal=equal, old=old).collect()} == {(x, y) for x, y in want if x % 3 or y % 3}


def test_pairs_have_the_copies_too(spark):
    df = spark.createDataFrame([(1, 7), (2, 7), (3, 5), (4, 5), (5, 1 << 40), (6, None)], "id long, simhash long")
    assert sorted(map(tuple, dedup.similar_pairs(df).collect())) == [(1, 2, 0), (1, 3, 1), (3, 4, 0)]


def test_hashes_are_computed_once(spark):
    counted = spark.sparkContext.accumulator(0)

    def hashed(i):
        counted.add(1)
        return i % 5

    from pyspark.sql.functions import udf

    df = spark.range(40).select("id", udf(hashed, "long")("id").alias("simhash"))
    for use in (dedup.classes, dedup.similar_pairs):
        counted.value = 0
        use(df).collect()
        assert counted.value == 40
