import pytest
from test_dedup import KIND, direct, frame, found, invented

from millrace.streaming import dedup


def replay(spark, rows, folder, sizes):
    """Writes the rows in their order as files, one after the other."""
    at = 0
    for k, n in enumerate(sizes):
        frame(spark, rows[at : at + n]).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{k:03d}")
        at += n


def stream(spark, folder):
    return spark.readStream.schema(KIND).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(folder)


def test_decisions_are_those_of_one_batch_over_restarts_and_failures(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(dedup, "TOGETHER", 2)
    rows = sorted(invented(11, 120, 4), key=lambda r: r[1])
    folder, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    replay(spark, rows[:50], folder, (30, 20))
    dedup.decide(stream(spark, folder), out, state).awaitTermination()
    want = direct(rows)
    assert found(dedup.decisions(spark, out)) == {r[0]: want[r[0]] for r in rows[:50]}
    frame(spark, rows[50:90]).coalesce(1).write.parquet(f"{folder}/002")
    real = dedup.deciding

    def failing(path, **how):
        def write(posts, batch):
            real(path, **how)(posts, batch)
            raise RuntimeError("lost after all was written")

        return write

    monkeypatch.setattr(dedup, "deciding", failing)
    with pytest.raises(Exception, match="lost after all was written"):
        dedup.decide(stream(spark, folder), out, state).awaitTermination()
    monkeypatch.setattr(dedup, "deciding", real)
    frame(spark, rows[90:]).coalesce(1).write.parquet(f"{folder}/003")
    dedup.decide(stream(spark, folder), out, state).awaitTermination()
    assert found(dedup.decisions(spark, out)) == want


def test_what_is_too_old_is_forgotten(spark, tmp_path):
    posts = [(1, 0, 5, 200, "a", False, False), (2, 100, 5, 200, "b", False, False), (3, 1000, 5, 200, "a", False, False)]
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    replay(spark, posts, folder, (1, 1, 1))
    dedup.decide(stream(spark, folder), out, str(tmp_path / "state"), keep=500).awaitTermination()
    assert {k: v[0] for k, v in found(dedup.decisions(spark, out)).items()} == {1: "new", 2: "similar", 3: "new"}
