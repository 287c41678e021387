import hashlib
import heapq
import random

import oracle
import pytest
from pyspark.sql import functions as F

from millrace.llm import queries, turn_repair

KIND = "conv_id long, turn long, role string, text string, conv string, range string, block string, at string, same string, first string, turns string, split string"


@pytest.fixture(scope="module")
def talks(spark):
    return lambda rows: spark.createDataFrame([(*r, *"abcdefgh") for r in rows], KIND)


def plain(rows):
    """One conversation's (role, text) rows in order: cost, audit and text of its repair, by a search over all edits."""
    solid = [t.strip(" \t\n\x0b\f\r") for _, t in rows]
    seen, bad, cut = set(), [], []
    for (role, text), s in zip(rows, solid, strict=True):
        bad.append(not s or (role, text) in seen)
        seen.add((role, text))
        cut.append(bool(s) and s[-1] not in ".!?")
    heap, done = [(0, "", 0, 0, ())], set()
    while True:
        cost, audit, i, state, said = heapq.heappop(heap)
        if i == len(rows) and state in (0, 3):
            return cost, audit, "\n".join(said)
        if (i, state) in done:
            continue
        done.add((i, state))
        name = "assistant" if state == 2 else "user"
        after = 3 if state == 2 else 2
        heapq.heappush(heap, (cost + 3, audit + "I", i, after, (*said, f"{name}:")))
        if i < len(rows):
            role, text = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, state, said))
            if not bad[i]:
                more = 3 * cut[i]
                heapq.heappush(heap, (cost + 3 + more, audit + "R", i + 1, after, (*said, f"{name}:{text}")))
                to = {"s": 1, "u": 2, "a": 3}.get(role[:1])
                if (state, to) in {(0, 1), (0, 2), (1, 2), (3, 2), (2, 3)}:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, to, (*said, f"{role}:{text}")))


def faults(rows):
    seen, out = set(), [0, 0, 0]
    for role, text in rows:
        s = text.strip(" \t\n\x0b\f\r")
        which = 0 if not s else 1 if (role, text) in seen else 2 if s[-1] not in ".!?" else None
        seen.add((role, text))
        if which is not None:
            out[which] += 1
    return out


def expected(talks):
    out = {}
    for conv, rows in talks.items():
        said = [(role if role is not None else " ", text if text is not None else " ") for _, role, text in rows]
        turns = [t for t, _, _ in rows if t is not None]
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(said, said[1:], strict=False))
        cost, audit, text = plain(said)
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *faults(said), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def found(df):
    rows = df.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()
    out = {r[0]: tuple(r[1:]) for r in rows}
    assert len(out) == len(rows)
    return out


def invented(seed, n, most):
    r = random.Random(seed)
    roles = ["user", "assistant", "system", "tool", "", None, "ux"]
    texts = ["Yes.", "No", "", " \n", "What?", "Sure!\t", "a. ", "é", None, "..", "Hm "]
    out = {}
    for c in range(n):
        turns = sorted(r.sample(range(-5, 60), r.randint(1, most)))
        rows = [(t, r.choices(roles, (5, 5, 2, 1, 1, 1, 1))[0], f"{r.choice(texts)}" if r.random() < 0.4 else f"t{r.randint(0, 9)}{r.choice('.!?x')}") for t in turns]
        if r.random() < 0.2:
            rows = [(None, "system", "Be brief."), *rows]
        out[c if c else None] = rows
    return out


@pytest.mark.parametrize(("rows", "fan"), [(512, 32), (2, 2), (5, 3)])
def test_repairs_are_the_cheapest_of_all_edits(talks, monkeypatch, rows, fan):
    monkeypatch.setattr(turn_repair, "BLOCK_ROWS", rows)
    monkeypatch.setattr(turn_repair, "FAN", fan)
    given = invented(rows, 60, 14)
    flat = [(c, *row) for c, each in given.items() for row in each]
    random.Random(1).shuffle(flat)
    assert found(turn_repair.repair(talks(flat).repartition(3))) == expected(given)


def test_the_turns_themselves(talks, monkeypatch):
    given = {1: [(0, "system", "Be brief."), (1, "user", "Hi."), (2, "user", "There?"), (3, "assistant", "Yes")], 2: [(5, "assistant", "")]}
    flat = [(c, *row) for c, each in given.items() for row in each]
    for rows in (512, 1):
        monkeypatch.setattr(turn_repair, "BLOCK_ROWS", rows)
        out = turn_repair.repaired_turns(talks(flat)).orderBy("conv_id", "part", "position").select("conv_id", "role", "text").collect()
        said = "\n".join(f"{r.role}:{r.text}" for r in out)
        assert all(r.conv_id == 1 for r in out) and said == plain([x[1:] for x in given[1]])[2]


def test_one_conversation_with_very_many_turns(talks, spark, monkeypatch):
    monkeypatch.setattr(turn_repair, "FAN", 4)
    n = 9000
    rows = spark.range(n).select(F.lit(7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 11 == 3, "user").when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.when(F.col("id") % 5 == 0, "again.").otherwise(F.concat(F.lit("t"), F.col("id").cast("string"), F.when(F.col("id") % 13 == 0, "").otherwise("."))).alias("text"))
    given = {7: [tuple(r)[1:] for r in rows.orderBy("turn").collect()]}
    assert found(turn_repair.repair(rows)) == expected(given)


def test_rows_that_are_alike_or_gone_or_absent(talks):
    alike = talks([(1, None, None, None)] * 3000 + [(2, 1, "user", "A."), (2, 1, "user", "A."), (2, 2, "assistant", "B.")])
    out = found(turn_repair.repair(alike))
    assert out[1][:6] == (0, 3000, 0, 0, 2999, 12000) and out[1][6] == "D" * 3000
    assert out[2] == (0, 0, 1, 0, 1, 4, "KDK", hashlib.sha256(b"user:A.\nassistant:B.").hexdigest())
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert found(turn_repair.repair(alike, gone=F.lit(True))) == {1: nothing, 2: nothing}
    assert found(turn_repair.repair(alike.limit(0))) == {}


def test_the_query_is_its_sql(spark, sf_dir, monkeypatch):
    want = oracle.rows_of(queries.OP11_SQL, sf_dir)
    assert oracle.rows_of_frame(queries.op11_turn_repair(spark, sf_dir)) == want
    monkeypatch.setattr(turn_repair, "BLOCK_ROWS", 3)
    monkeypatch.setattr(turn_repair, "FAN", 2)
    assert oracle.rows_of_frame(queries.op11_turn_repair(spark, sf_dir)) == want


def test_damage(spark):
    import zlib

    rows = [(c, t, "assistant", "A! b? c.") for c in (*range(12), None) for t in (*range(8), None)]
    got = {}
    for r in turn_repair.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect():
        got.setdefault((r.conv_id, r.turn), []).append((r.role, r.text, r.gone))
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        want = ("user" if kind == 4 else role, "" if kind == 1 else "A b c" if kind == 2 else text, kind == 0)
        assert got[c, t] == [want] * (2 if kind == 3 else 1)
