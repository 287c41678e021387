"""Exact duplicates by Patricia tries that own the texts of a (length, content hash) partition."""

from __future__ import annotations

import hashlib
import os
import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, freeing, join_unique, one_of_each, text_of, written_table


def common(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix."""
    if a == b[: len(a)]:
        return len(a)
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[:mid] == b[:mid] else (low, mid - 1)
    return low


class Trie:
    """Compressed radix trie from byte strings to [owner, copies].

    A node is [label, children by first byte, terminal or None]. Over `budget` bytes, the largest subtree under the root goes to
    a temporary file, as do later strings that belong there; entries() then reads each file into a trie of its own, which
    branches behind the prefix that all of the file's strings share.
    """

    def __init__(self, budget: int, largest: bool = False, depth: int = 0):
        self.budget, self.depth, self.better = budget, depth, max if largest else min
        self.children: dict[bytes, list] = {}
        self.bytes: dict[bytes, int] = {}
        self.spilled: dict[bytes, list] = {}  # first byte: file, prefix that its strings share
        self.spills = 0

    def insert(self, key: bytes, owner: int | None, copies: int) -> None:
        first = key[self.depth : self.depth + 1]
        if first in self.spilled:
            return self.append(first, key, owner, copies)
        self.bytes[first] = self.bytes.get(first, 0) + self.put(self.children, first, key, self.depth, owner, copies)
        if sum(self.bytes.values()) > self.budget and len(key) > self.depth:
            self.spill(max(self.bytes, key=self.bytes.get))

    def merge(self, terminal: list, owner: int | None, copies: int) -> None:
        known = [x for x in (terminal[0], owner) if x is not None]
        terminal[0] = self.better(known) if known else None
        terminal[1] += copies

    def put(self, children: dict, first: bytes, key: bytes, at: int, owner: int | None, copies: int) -> int:
        """Walks down to the key's node; returns the bytes added."""
        while True:
            node = children.get(first)
            if node is None:
                children[first] = [key[at:], {}, [owner, copies]]
                return len(key) - at + 200
            n = common(node[0], key[at : at + len(node[0])])
            added = 0
            if n < len(node[0]):  # the label parts here
                low = [node[0][n:], node[1], node[2]]
                node[0], node[1], node[2] = node[0][:n], {low[0][:1]: low}, None
                added = 200
            at += n
            if at == len(key):
                if node[2] is None:
                    node[2] = [owner, copies]
                else:
                    self.merge(node[2], owner, copies)
                return added
            children, first = node[1], key[at : at + 1]

    def append(self, first: bytes, key: bytes, owner: int | None, copies: int) -> None:
        file, shared = self.spilled[first]
        self.spilled[first][1] = key if shared is None else shared[: common(shared, key)]
        pickle.dump((key, owner, copies), file)

    def spill(self, first: bytes) -> None:
        self.spilled[first] = [tempfile.TemporaryFile(), None]
        self.spills += 1
        for key, owner, copies in self.walk(self.children.pop(first), b""):
            self.append(first, self.prefix + key, owner, copies)
        del self.bytes[first]

    prefix = b""

    def walk(self, node: list, above: bytes) -> Iterator[tuple[bytes, int | None, int]]:
        stack = [(node, above)]
        while stack:
            (label, children, terminal), path = stack.pop()
            path += label
            if terminal is not None:
                yield path, *terminal
            stack += [(child, path) for child in children.values()]

    def entries(self) -> Iterator[tuple[bytes, int | None, int]]:
        for node in self.children.values():
            for key, owner, copies in self.walk(node, b""):
                yield self.prefix + key, owner, copies
        self.children, self.bytes = {}, {}
        for file, shared in self.spilled.values():
            file.seek(0, os.SEEK_SET)
            inner = Trie(self.budget, self.better is max, len(shared))
            inner.prefix = shared
            with file:
                while True:
                    try:
                        inner.insert(*pickle.load(file))
                    except EOFError:
                        break
            yield from inner.entries()


OWNED = "n int, h long, body binary, owner long, copies long"


def owners(df: DataFrame, text: str = "text", owner: str = "doc_id", largest: bool = False, budget: int = 96 << 20) -> DataFrame:
    """(text_sha256, owner, copies), a row for each distinct text; owner is the smallest (or largest) identifier of its copies.

    Copies that one task reads meet in a first trie, so a text that makes up a third of the corpus leaves each task a few times
    at most. The survivors are dealt out by length and content hash and inserted, whole, into the tries that own them. Tries hold
    `budget` bytes and spill subtrees beyond. Null texts count as empty; null identifiers own a text only if it has no other.
    """
    rows = df.select(F.length(F.encode(text_of(text), "UTF-8")).alias("n"), F.xxhash64(text_of(text)).alias("h"), F.encode(text_of(text), "UTF-8").alias("body"), F.col(owner).cast("long").alias("owner"), F.lit(1).cast("long").alias("copies"))

    def batches(found: Iterator[tuple], row, fields: list[tuple]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for x in found:
            held.append(row(x))
            size += len(x[0])
            if size > 16 << 20:
                yield pa.RecordBatch.from_pylist(held, pa.schema(fields))
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, pa.schema(fields))

    def columns(batch: pa.RecordBatch):
        return zip(batch.column("n").to_pylist(), batch.column("h").to_pylist(), batch.column("body"), batch.column("owner").to_pylist(), batch.column("copies").to_pylist(), strict=True)

    partial_fields = [("n", pa.int32()), ("h", pa.int64()), ("body", pa.binary()), ("owner", pa.int64()), ("copies", pa.int64())]

    def combine(stream):
        """Copies within a task; the trie is emptied whenever it is full, as later copies meet at their owner anyway."""
        trie, hashes, size = Trie(1 << 62, largest), {}, 0
        flush = lambda: batches(trie.entries(), lambda x: {"n": len(x[0]), "h": hashes[x[0]], "body": x[0], "owner": x[1], "copies": x[2]}, partial_fields)
        for batch in stream:
            for _, h, body, mine, copies in columns(batch):
                key = body.as_py()
                if key not in hashes:
                    hashes[key] = h
                    size += len(key)
                trie.insert(key, mine, copies)
            if size > budget // 2:
                yield from flush()
                trie, hashes, size = Trie(1 << 62, largest), {}, 0
        yield from flush()

    def own(stream):
        trie = Trie(budget, largest)
        for batch in stream:
            for _, _, body, mine, copies in columns(batch):
                trie.insert(body.as_py(), mine, copies)
        yield from batches(trie.entries(), lambda x: {"text_sha256": hashlib.sha256(x[0]).hexdigest(), "owner": x[1], "copies": x[2]}, [("text_sha256", pa.string()), ("owner", pa.int64()), ("copies", pa.int64())])

    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.mapInArrow(freeing(combine), OWNED).repartition(partitions, "n", "h").mapInArrow(freeing(own), "text_sha256 string, owner long, copies long")


def memberships(df: DataFrame, text: str = "text", doc_id: str = "doc_id", largest: bool = False) -> DataFrame:
    """A row for each row of df: doc_id, keep_id, group_size, kept, text_sha256.

    kept holds for the rows whose doc_id is the group's keep_id; rows that repeat both text and doc_id are therefore all kept
    here, and survivors() leaves one of them. A group in which every doc_id is null has keep_id null and is kept.
    """
    groups = written_table(owners(df, text, doc_id, largest).select("text_sha256", F.col("owner").alias("keep_id"), F.col("copies").alias("group_size")))
    docs = df.select(F.col(doc_id).alias("doc_id"), F.sha2(text_of(text), 256).alias("text_sha256"))
    joined = join_unique(docs, groups, "text_sha256", "group_size", df.count())
    return joined.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def survivors(df: DataFrame, text: str = "text", doc_id: str = "doc_id", largest: bool = False) -> DataFrame:
    """The rows of df that stay, one for each distinct text, all columns untouched.

    Of rows that repeat both text and doc_id, the one whose columns have the least hash stays, on every run.
    """
    groups = owners(df, text, doc_id, largest).select(F.coalesce("owner", F.lit(NULL_ID)).alias("__id"), F.col("text_sha256").alias("__sha"))
    marked = df.withColumns({"__id": F.coalesce(F.col(doc_id).cast("long"), F.lit(NULL_ID)), "__sha": F.sha2(text_of(text), 256)})
    return one_of_each(marked, "__id", "__sha").join(groups, ["__id", "__sha"], "left_semi").select(*df.columns)
