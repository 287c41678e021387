import random

import numpy as np
import pytest

from millrace.llm.common import connected_components, least_reached


def direct(edges):
    least = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(least[a], least[b])
            changed |= least[a] != low or least[b] != low
            least[a] = least[b] = low
    return {x: c for x, c in least.items() if any(a != b and x in (a, b) for a, b in edges)}


def some_edges():
    random.seed(4)
    chain = [(k, k + 1) for k in range(100, 160)]
    hub = [(7, k) for k in range(1000, 1090)]
    loose = [(random.randrange(-500, 0), random.randrange(-500, 0)) for _ in range(150)]
    out = chain + hub + loose + [(2**63 - 1, -(2**63)), (5, 5), (101, 100), (7, 1000)]
    random.shuffle(out)
    return out


def test_least_reached():
    edges = [e for e in some_edges() if e[0] != e[1]]
    ids, least = least_reached(*(np.array(x, np.int64) for x in zip(*edges, strict=True)))
    assert dict(zip(ids.tolist(), least.tolist(), strict=True)) == direct(edges)


@pytest.mark.parametrize("block", [20, 500_000])
def test_components_in_one_block_and_in_many(spark, block):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10)
    try:
        found = connected_components(spark.createDataFrame(some_edges(), "src long, dst long").repartition(4), block=block).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(found) == len({r.id for r in found})
    assert {r.id: r.component for r in found} == direct(some_edges())


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([(3, 3), (None, 4)], "src long, dst long")).collect() == []
