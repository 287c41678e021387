import hashlib
import random

import duckdb

from millrace.llm import queries
from millrace.llm.exact_dedup import Trie, memberships, survivors


def test_trie_against_a_dictionary_with_and_without_spills():
    r = random.Random(5)
    keys = [bytes(r.choice(b"ab") for _ in range(r.randint(0, 12))) for _ in range(3000)]
    for budget in (1 << 40, 4000, 300):
        for largest in (False, True):
            trie, expected = Trie(budget, largest), {}
            for i, k in enumerate(keys):
                owner = None if i % 7 == 0 else i
                trie.insert(k, owner, 1)
                expected.setdefault(k, []).append(owner)
            found = {k: (o, n) for k, o, n in trie.entries()}
            best = max if largest else min
            assert found == {k: (best([x for x in v if x is not None], default=None), len(v)) for k, v in expected.items()}
            assert bool(trie.spills) == (budget < 1 << 40)


def test_edge_rows(make):
    docs = make([(1, "a"), (2, "a"), (3, None), (4, ""), (None, "b"), (None, "a"), (7, "c"), (7, "c"), (8, "x" * 300000), (9, "x" * 300000)])
    rows = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in memberships(docs, largest=True).collect()), key=str)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    expected = [(1, 2, 3, False, sha("a")), (2, 2, 3, True, sha("a")), (None, 2, 3, False, sha("a")), (3, 4, 2, False, sha("")), (4, 4, 2, True, sha("")), (None, None, 1, True, sha("b")), (7, 7, 2, True, sha("c")), (7, 7, 2, True, sha("c")), (8, 9, 2, False, sha("x" * 300000)), (9, 9, 2, True, sha("x" * 300000))]
    assert rows == sorted(expected, key=str)
    left = survivors(docs, largest=True)
    assert left.columns == docs.columns
    assert sorted((str(r.doc_id), r.text) for r in left.collect()) == sorted([("2", "a"), ("4", ""), ("None", "b"), ("7", "c"), ("9", "x" * 300000)])
    assert memberships(docs.limit(0)).count() == 0


def test_query_against_sql(spark, sf_dir):
    got = sorted(map(tuple, queries.op7_exact_dedup(spark, sf_dir).collect()))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    assert got == sorted(con.execute(queries.OP7_SQL).fetchall())
