import zlib

import numpy as np
from hypothesis import given
from hypothesis import strategies as st

from millrace.llm import queries
from millrace.llm.packing import best_fit, encoder, pack, token_pieces


@given(st.lists(st.integers(1, 64), max_size=200), st.integers(1, 9))
def test_best_fit_against_a_scan_of_all_open_bins(sizes, most):
    bins, offsets = best_fit(sizes, 64, most)
    fill, open_bins = {}, []
    for size, b, offset in zip(sizes, bins, offsets, strict=True):
        fits = [64 - fill[x] for x in open_bins if 64 - fill[x] >= size]
        if fits:
            assert b in open_bins and 64 - fill[b] == min(fits)
        else:
            assert b not in fill
            if len(open_bins) == most:
                fullest = max(fill[x] for x in open_bins)
                gone = [x for x in open_bins if fill[x] == fullest and x not in bins[len(fill) :]] or [x for x in open_bins if fill[x] == fullest]
                open_bins.remove(gone[0]) if len(gone) == 1 else open_bins.remove(max(gone))
            open_bins.append(b)
        assert offset == fill.get(b, 0)
        fill[b] = offset + size
        if fill[b] == 64:
            open_bins.remove(b)
    assert all(x <= 64 for x in fill.values())


def test_ids_are_those_of_tokenizers():
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    slow, fast = Tokenizer.from_file(path), encoder(path)
    slow.encode_special_tokens = True
    for text in ("", " ", "It's  a test.\n\n  x", "Éaux çé ß 123 4", "日本語 текст \U0001f600", "a<|endoftext|>b", "  x\t\r\n", "'S don't I'LL", "a" * 5000):
        assert fast(text) == slow.encode(text, add_special_tokens=False).ids


def test_ids_with_added_tokens_are_those_of_tokenizers(make):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    slow, fast = Tokenizer.from_file(path), encoder(path, added=True)
    texts = ["", "a b", "a<|endoftext|>b", "a <|endoftext|> b", "<|endoftext|><|endoftext|>", "<|endoftext|", "\n <|endoftext|>'s", "x  <|endoftext|>", "É<|endoftext|>日本語" * 900]
    want = [slow.encode(t, add_special_tokens=False).ids for t in texts]
    assert want[2] == [64, 50256, 65] and [fast(t) for t in texts] == want
    got = {}
    for r in token_pieces(make(list(enumerate(texts))), path).orderBy("doc_id", "piece").collect():
        got.setdefault(r.doc_id, []).extend(np.frombuffer(r.ids, "<u4").tolist())
    assert [got[i] for i in range(len(texts))] == [[*ids, 2] for ids in want]


def test_very_long_runs_get_the_ids_of_tokenizers(make):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    slow = Tokenizer.from_file(path)
    texts = ["x" + " " * 1_100_000 + "a", "x" + "\n" * 1_100_000 + "<|endoftext|>a", "a" * 300_000, "!?" * 100_000]
    got = {}
    for r in token_pieces(make(list(enumerate(texts))), path).orderBy("doc_id", "piece").collect():
        got.setdefault(r.doc_id, []).append(np.frombuffer(r.ids, "<u4"))
    for i, text in enumerate(texts):
        assert np.concatenate(got[i]).tolist() == [*slow.encode(text, add_special_tokens=False).ids, 2]


def test_files_with_another_split_are_left_to_tokenizers(tmp_path):
    import json

    from tokenizers import Tokenizer

    spec = json.load(open(queries.tokenizer_path(), encoding="utf-8"))
    spec["pre_tokenizer"]["add_prefix_space"] = True
    path = str(tmp_path / "prefixed.json")
    json.dump(spec, open(path, "w", encoding="utf-8"))
    assert encoder(path, added=True)("the end") == Tokenizer.from_file(path).encode("the end", add_special_tokens=False).ids != encoder(queries.tokenizer_path())("the end")


def test_round_trip(make):
    from tokenizers import Tokenizer

    decode = Tokenizer.from_file(queries.tokenizer_path()).decode
    texts = {1: "a b c", 2: None, 3: "", 4: "word " * 3000, 5: "xy " * 1023, 6: "a b c"}
    docs = make([*texts.items(), (6, "a b c")])
    rows = pack(token_pieces(docs, queries.tokenizer_path())).collect()
    assert len([r for r in rows if r.doc_id == 6]) == 2
    for doc, text in texts.items():
        mine = sorted((r for r in rows if r.doc_id == doc), key=lambda r: r.piece)[: None if doc != 6 else 1]
        ids = np.concatenate([np.frombuffer(r.ids, "<u4") for r in mine])
        assert ids[-1] == 2 and decode(ids[:-1].tolist()) == (text or "")
        assert [r.start for r in mine] == np.cumsum([0, *[r.length for r in mine]])[:-1].tolist()
        assert all(r.length == 1024 for r in mine[1:]) and all(4 * r.length == len(r.ids) for r in mine)
    full_places(rows)
    assert pack(token_pieces(docs.limit(0), queries.tokenizer_path())).count() == 0


def test_rows_without_identifier_are_dealt_over_groups(spark, make):
    docs = make([(None, f"text {i % 3} " * (i % 50)) for i in range(400)] + [(None, "long " * 4000)] * 3)
    rows = pack(token_pieces(docs, queries.tokenizer_path()), per_group=50).collect()
    short = [r for r in rows if r.length < 1024]
    assert len({r.sequence_id >> 32 for r in short}) > 4 and all(r.sequence_id < 0 and r.offset == 0 for r in rows if r.length == 1024)
    assert sum(r.piece == 0 for r in rows) == 403 and len({r.sequence_id for r in rows if r.length == 1024}) == len(rows) - len(short)
    full_places(rows)


def full_places(rows):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 1024
    return len(by)


def test_query_is_gapless_tight_and_repeats(spark, sf_dir):
    from tokenizers import Tokenizer

    rows = queries.op2_best_fit_packing(spark, sf_dir).collect()
    again = queries.op2_best_fit_packing(spark, sf_dir).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    sequences = full_places(rows)
    assert sequences <= 1.02 * -(-sum(r.length for r in rows) // 1024)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    slow = Tokenizer.from_file(queries.tokenizer_path())
    ids = {d: np.array([*slow.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for d, t in texts.items()}
    assert {r.doc_id for r in rows} == set(texts)
    for r in rows:
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32
    assert sum(r.length for r in rows) == sum(map(len, ids.values()))
