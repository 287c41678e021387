"""Token sequences of fixed length, packed by bounded-space online best fit."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import freeing, text_of, written_table

LENGTH, END = 1024, 2


#: How a plain byte-level BPE file splits its text; a file that says anything else is left to `tokenizers`.
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def encoder(path: str, added: bool = False):
    """text -> ids of the byte-level BPE in a tokenizers JSON file.

    With added, the ids are those of `tokenizers` with add_special_tokens=False, which gives the file's added tokens their own ids
    where their strings stand in the text. Without, they are those with encode_special_tokens=True too: such strings are ordinary
    text (tests compare both). The file's vocabulary is run by tiktoken, four times as fast: ids of a byte-level BPE are its merge
    ranks. `tokenizers` itself takes what tiktoken can't: files with another split, a normalizer, or added tokens that are more than
    a plain string or begin with another one; and each text on which tiktoken's split gives up, as it does on some million white
    space characters in a row.
    """
    import tiktoken
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    slow.encode_special_tokens = not added

    def whole(text: str) -> list[int]:
        return slow.encode(text, add_special_tokens=False).ids

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    tokens, model = spec.get("added_tokens") or (), spec["model"]
    special = {x["content"]: x["id"] for x in tokens}
    odd = any(x.get(k) for x in tokens for k in ("single_word", "lstrip", "rstrip", "normalized")) or any(x != y and x.startswith(y) for x in special for y in special)
    split = {k: (spec.get("pre_tokenizer") or {}).get(k) for k in BYTE_LEVEL}
    if split != BYTE_LEVEL or spec.get("normalizer") or model.get("type", "BPE") != "BPE" or model.get("ignore_merges") or added and odd:
        return whole
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    ranks = {bytes(byte_of[c] for c in token): rank for token, rank in model["vocab"].items() if token not in special}
    fast = tiktoken.Encoding("bpe", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special if added else {})
    run = partial(fast.encode, allowed_special="all") if added and special else fast.encode_ordinary

    def ids(text: str) -> list[int]:
        try:
            return run(text)
        except ValueError:
            return whole(text)

    return ids


def token_pieces(df: DataFrame, tokenizer: str, text: str = "text", doc_id: str = "doc_id", length: int = LENGTH, end: int | None = END) -> DataFrame:
    """(doc_id, piece, start, length, ids): documents as pieces of at most `length` tokens; ids is a binary of little-endian uint32.

    A document is its text's ids and the id `end`. Longer ones are cut into pieces of `length`, of which the first is shorter
    unless the document is a multiple; so the short one is the one that shares a sequence. Every piece is whole in one sequence.
    Null texts count as empty and give one piece, the end alone. Rows with the same doc_id are packed each for itself. A run of one
    character may be of any length.
    """

    def tokenize(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, added=True)
        for batch in stream:
            out, held = [[], [], [], [], []], 0
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = np.asarray([*encode(text.as_py()), *([] if end is None else [end])], "<u4")
                cuts = [0, *range(len(ids) % length or min(length, len(ids)), len(ids) + 1, length)]
                for piece, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    for column, value in zip(out, (doc, piece, a, b - a, ids[a:b].tobytes()), strict=True):
                        column.append(value)
                held += 4 * len(ids)
                if held > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=True)], names)
                    out, held = [[], [], [], [], []], 0
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=True)], names)

    types, names = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()], ["doc_id", "piece", "start", "length", "ids"]
    return df.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text")).mapInArrow(freeing(tokenize), "doc_id long, piece int, start long, length long, ids binary")


def best_fit(sizes: list[int], capacity: int, open_bins: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each size, in order of arrival.

    Bit f of `free` says that an open bin has f tokens left; the lowest bit from the size upwards is the best fit. If none fits
    and `open_bins` are open, the fullest closes.
    """
    free, stacks, used = 0, [[] for _ in range(capacity + 1)], 0
    open_now, bins, offsets = 0, [], []
    for size in sizes:
        fits = free >> size
        if fits:
            left = size + (fits & -fits).bit_length() - 1
            at = stacks[left].pop()
            if not stacks[left]:
                free ^= 1 << left
        else:
            if open_now == open_bins:
                fullest = (free & -free).bit_length() - 1
                stacks[fullest].pop()
                if not stacks[fullest]:
                    free ^= 1 << fullest
                open_now -= 1
            at, left = used, capacity
            used += 1
            open_now += 1
        bins.append(at)
        offsets.append(capacity - left)
        left -= size
        if left:
            stacks[left].append(at)
            free |= 1 << left
        else:
            open_now -= 1
    return bins, offsets


def pack(pieces: DataFrame, size: str = "length", capacity: int = LENGTH, open_bins: int = 1024, per_group: int = 16384) -> DataFrame:
    """pieces with sequence_id and offset: a place in a sequence of `capacity`, gapless from 0.

    The pieces are written once. A full one needs no bin and is a sequence of its own, numbered below 0. Every other is dealt by
    its row, not by any of its columns, to one of groups of about `per_group`, whatever rows repeat or are null; in a group they
    arrive in a random order, as best fit likes.
    """
    pieces = written_table(pieces).withColumn("_row", F.monotonically_increasing_id())
    full, short = pieces.filter(F.col(size) >= capacity), pieces.filter(F.col(size) < capacity)
    groups = max(1, -(-short.count() // per_group))
    fields = [f.name for f in pieces.schema.fields if f.name != "_row"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields if f.name != "_row")
    dealt = short.withColumn("_order", F.xxhash64("_row")).withColumn("_group", F.pmod(F.xxhash64(F.lit("group"), "_row"), F.lit(groups)))

    def place(table: pa.Table) -> pa.Table:
        table = table.sort_by([("_order", "ascending"), ("_row", "ascending")])
        group = table.column("_group")[0].as_py()
        bins, offsets = best_fit(table.column(size).to_pylist(), capacity, open_bins)
        out = table.select(fields)
        return out.append_column("sequence_id", pa.array([group << 32 | b for b in bins], pa.int64())).append_column("offset", pa.array(offsets, pa.int64()))

    alone = full.select(*fields, (-1 - F.col("_row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return alone.union(dealt.groupBy("_group").applyInArrow(place, f"{schema}, sequence_id long, offset long"))
