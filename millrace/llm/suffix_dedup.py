"""Removes byte strings that occur more than once, found by a logarithmic family of sparse suffix arrays."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import NULL_ID, checkpointed, drop_table, freeing, text_of, written_table
from .filters import bitset, has

CHUNK = 1 << 20  # bytes of text at a time
BATCHES, HOT = 4, 20_000

_random = np.random.default_rng(77)
ODD = _random.integers(0, 1 << 63, 4096, np.uint64) * np.uint64(2) + np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(32))


@dataclass(frozen=True)
class Shape:
    """Strings that repeat have `length` bytes, passages that documents share `passage`; samples are chosen by `gram` bytes.

    Of the grams in the first `passage` bytes of a string the one with the least hash (the first of equals) is its sample. Equal
    strings have equal samples at equal distances x from their start, so strings need only be compared with those of the same
    sample and x. The suffixes at samples are all that is indexed: about one in passage / 2. x is split into two blocks of `half`:
    all strings of a sample whose x is in block j contain the `core` bytes from place q = sample - j * half on. So the suffixes at
    q, compared by their first `core` bytes, are what the suffix arrays hold, in the order of their first `head` bytes; a string is
    that core with e = x - j * half bytes before it and the rest behind.
    """

    length: int = 400
    gram: int = 16
    passage: int = 0
    head: int = 24

    def __post_init__(self):
        object.__setattr__(self, "passage", self.passage or self.length)

    @property
    def window(self) -> int:
        return self.passage - self.gram + 1

    @property
    def half(self) -> int:
        return (self.window + 1) // 2

    @property
    def core(self) -> int:
        return self.passage - self.half + 1

    @property
    def margin(self) -> int:
        """Bytes before a core that its strings have at most."""
        return self.half - 1

    @property
    def behind(self) -> int:
        """Bytes behind a core that its strings have at most."""
        return self.length - self.core


@dataclass
class Blocks:
    """Suffixes of a chunk: document, place q, range of e of the passages, key of the core."""

    doc: np.ndarray
    q: np.ndarray
    low: np.ndarray
    high: np.ndarray
    key: np.ndarray


def words64(raw: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on (zeros behind the end)."""
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    return np.ndarray((len(raw),), "<u8", padded, strides=(1,)).copy()


def string_hash(words: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Hash of the strings of a length at some places."""
    h = np.full(len(at), length, np.uint64)
    for i in range(0, length - 7, 8):
        h += mix(words[at + i] + ODD[i]) * ODD[i + 1]
    if length % 8:
        tail = words[at + length - length % 8] & np.uint64((1 << 8 * (length % 8)) - 1)
        h += mix(tail + ODD[length]) * ODD[length + 1]
    return mix(h)


def blocks(raw: np.ndarray, bounds: np.ndarray, shape: Shape) -> Blocks:
    n, w = len(raw), shape.window
    ends = np.repeat(bounds[1:], np.diff(bounds))
    if n < shape.passage:
        return Blocks(*(np.zeros(0, np.int64) for _ in range(4)), np.zeros(0, np.uint64))
    words = words64(raw)
    grams = n - shape.gram + 1
    g = string_hash(words, np.arange(grams), shape.gram)
    bits = np.uint64(max(24, int(n).bit_length()))
    v = ((g >> bits) << bits) | np.arange(grams, dtype=np.uint64)
    v = np.concatenate([v, np.full(-grams % w + w, np.uint64(2**64 - 1))]).reshape(-1, w)
    ahead = np.minimum.accumulate(v, axis=1).ravel()
    behind = np.minimum.accumulate(v[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = np.flatnonzero(np.arange(n - shape.passage + 1) + shape.passage <= ends[: n - shape.passage + 1])
    if not len(starts):
        return Blocks(*(np.zeros(0, np.int64) for _ in range(4)), np.zeros(0, np.uint64))
    least = np.minimum(behind[starts], ahead[starts + w - 1])
    sample = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    new = np.flatnonzero(np.r_[True, (np.diff(sample) != 0) | (np.diff(starts) != 1)])
    first, last, sample = starts[new], starts[np.r_[new[1:], len(starts)] - 1], sample[new]
    parts = []
    for j in range(2):
        q = sample - j * shape.half
        low, high = np.maximum(q - last, 0), np.minimum(q - first, shape.margin)
        ok = low <= high
        q, low, high = q[ok], low[ok], high[ok]
        key = string_hash(words, q, shape.core) + np.uint64(j) * ODD[7]
        parts.append((np.searchsorted(bounds, first[ok], "right") - 1, q, low, high, mix(key)))
    return Blocks(*(np.concatenate(x) for x in zip(*parts, strict=True)))


def chunks(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, bytes, bounds) of whole texts, about CHUNK bytes at a time."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    buffer = texts.buffers()[2]
    raw = np.frombuffer(buffer, np.uint8) if buffer is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, "right")) - 1)
        yield at, raw[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def suffix_array(docs: DataFrame, shape: Shape) -> DataFrame:
    """(head, key, n, doc_id, place), a batch's sparse suffix array: suffixes that agree in their core are one row, their number and one place.

    It is in the order of the suffixes' first bytes, the head; those with equal heads are in the order of their cores' 64-bit hash.
    """

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            ids = batch.column("doc_id").to_numpy()
            for at, raw, bounds in chunks(batch.column("text")):
                b = blocks(raw, bounds, shape)
                key, first, n = np.unique(b.key, return_index=True, return_counts=True)
                q = b.q[first]
                width = min(shape.head, shape.core)
                head = raw[q[:, None] + np.arange(width)]
                heads = pa.Array.from_buffers(pa.binary(width), len(q), [None, pa.py_buffer(np.ascontiguousarray(head))]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([heads, pa.array(key.view(np.int64)), pa.array(n), pa.array(ids[at + b.doc[first]]), pa.array(q - bounds[b.doc[first]])], ["head", "key", "n", "doc_id", "place"])

    return merged(docs.select("doc_id", "text").mapInArrow(freeing(run), "head binary, key long, n long, doc_id long, place long"))


def merged(rows: DataFrame) -> DataFrame:
    """Suffixes of one or more arrays as one, dealt by ranges and sorted in them."""
    sums = rows.groupBy("head", "key").agg(F.sum("n").alias("n"), F.min(F.struct("doc_id", "place")).alias("_first"))
    return sums.select("head", "key", "n", F.col("_first.doc_id").alias("doc_id"), F.col("_first.place").alias("place")).repartitionByRange("head", "key").sortWithinPartitions("head", "key")


class IndexFamily:
    """Suffix arrays of 1, 2, 4, ... batches, at most one of each size.

    add() scans a new batch's suffix array against every level for common cores, a merge join in the arrays' order, and returns
    those that have turned out to be shared: (key, n), n being the suffixes seen with it so far. Then it merges the batch with
    levels 0, 1, ... as long as there is one, and the result becomes the first free level; so a suffix is merged once for each
    doubling. The levels are tables in the shared folder and stay until close(): later batches may be added at any time.
    """

    def __init__(self, spark: SparkSession, shape: Shape = Shape()):
        self.spark, self.shape, self.levels = spark, shape, []

    def add(self, docs: DataFrame, last: bool = False) -> DataFrame:
        """last: no batch will follow, so the batch needn't be kept."""
        fresh = written_table(suffix_array(docs, self.shape))
        seen, shared = fresh.select("head", "key", "n"), fresh.filter("n > 1").select("key", "n")
        for level in self.levels:
            if level is not None:
                found = seen.join(level.select("head", "key", F.col("n").alias("m")).hint("merge"), ["head", "key"]).select("key", (F.col("n") + F.col("m")).alias("n"))
                shared = shared.union(found)
        total = shared.groupBy("key").agg(F.sum("n").alias("n"))
        # a core that is in several levels counts in each; its own suffixes of this batch are in all sums, so this is an upper bound
        shared = written_table(total)
        if last:
            drop_table(fresh)
            return shared
        old, at = [fresh], 0
        while at < len(self.levels) and self.levels[at] is not None:
            old.append(self.levels[at])
            self.levels[at] = None
            at += 1
        if at == len(self.levels):
            self.levels.append(None)
        if len(old) == 1:
            self.levels[at] = fresh
        else:
            rows = old[0]
            for x in old[1:]:
                rows = rows.union(x)
            self.levels[at] = written_table(merged(rows))
            for x in old:
                drop_table(x)
        return shared

    def close(self) -> None:
        for level in self.levels:
            if level is not None:
                drop_table(level)
        self.levels = []


#: context: the bytes around a core, null in rows that give a span or a document that shares a passage, whose kind is 0 and 1.
CONTEXT = "key long, doc_id long, h long, q long, low int, high int, room int, context binary"
FOUND = "kind int, string long, again boolean, doc_id long, h long, first long, behind long"


def contexts(docs: DataFrame, bits: np.ndarray, shape: Shape) -> DataFrame:
    """The suffixes whose core may be shared, with the bytes around it that their strings have: `margin` before, `behind` after it.

    room is what the document has from q on, `length` at most. Suffixes of one chunk with the same context and range share all
    their strings: one of them goes on. Each is also given as a span, a row without context whose low and high are its first byte
    and the byte behind it, relative to q (room 0), and, if they are of several documents, as a sharer of a passage (room 1).
    """
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    m, rest = shape.margin, shape.behind
    offsets = np.r_[np.arange(-m, 0), np.arange(shape.core, shape.core + rest)]

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            ids, hashes = batch.column("doc_id").to_numpy(), batch.column("h").to_numpy()
            for at, raw, bounds in chunks(batch.column("text")):
                b = blocks(raw, bounds, shape)
                some = np.flatnonzero(has(shared.value, b.key))
                some = some[np.argsort(b.key[some])]
                for i in range(0, len(some), 20_000):
                    k = some[i : i + 20_000]
                    q, low, high, doc = b.q[k], b.low[k], b.high[k], b.doc[k]
                    room = np.minimum(bounds[doc + 1] - q, shape.length)
                    least = np.maximum(low, shape.length - room)  # e of the strings; none if it is above high
                    end = np.where(least <= high, shape.length - least, 0)
                    inside = (offsets >= -high[:, None]) & (offsets < np.maximum(end, shape.passage - low)[:, None])
                    around = np.where(inside, raw[np.clip(q[:, None] + offsets, 0, len(raw) - 1)], 0).astype(np.uint8)
                    whole = [x.tobytes() for x in around]
                    groups: dict = {}
                    for r, c in enumerate(zip(b.key[k].tolist(), low.tolist(), high.tolist(), least.tolist(), whole, strict=True)):
                        groups.setdefault(c, []).append(r)
                    ones = [g[0] for g in groups.values()]
                    many = [g for g in groups.values() if len(g) > 1]
                    cut = [r for g in many if least[g[0]] <= high[g[0]] for r in g]
                    sharers = [r for g in many if len({(ids[at + doc[r]], hashes[at + doc[r]]) for r in g}) > 1 for r in g]
                    rows = np.array([*ones, *cut, *sharers], np.int64)
                    kind = np.repeat([2, 0, 1], [len(ones), len(cut), len(sharers)])
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(b.key[k][rows].view(np.int64)), pa.array(ids[at + doc[rows]]), pa.array(hashes[at + doc[rows]]), pa.array(q[rows] - bounds[doc[rows]]),
                            pa.array(np.where(kind == 2, low[rows], -high[rows]).astype(np.int32)), pa.array(np.where(kind == 2, high[rows], end[rows]).astype(np.int32)),
                            pa.array(np.where(kind == 2, room[rows], kind).astype(np.int32)), pa.array([whole[r] if one == 2 else None for r, one in zip(rows.tolist(), kind.tolist(), strict=True)], pa.binary()),
                        ],
                        ["key", "doc_id", "h", "q", "low", "high", "room", "context"],
                    )

    return docs.mapInArrow(freeing(run), CONTEXT)


def string_keys(left: np.ndarray, right: np.ndarray, key: np.ndarray, rows: np.ndarray, e: np.ndarray, length: int, shape: Shape) -> np.ndarray:
    """Hashes of strings of a length, by row and e; left and right are the rows' running sums of bytes' hashes."""
    return mix(mix(left[rows, e] + ODD[1]) * ODD[2] + mix(right[rows, length - shape.core - e] + ODD[3]) + key[rows] * ODD[4] + e.astype(np.uint64) + ODD[5 + (length == shape.length)])


def repeated(rows: DataFrame, hot: DataFrame, shape: Shape, most: int = HOT) -> DataFrame:
    """(kind, doc_id, h, first, behind), rows as of contexts().

    kind 0: for each suffix the bytes of those of its strings that occur again; kind 1: a document with a passage that another one
    has. Suffixes with a common core meet in one task, which hashes each of their strings and looks for equal ones. Those of the
    cores in hot (key, n) are dealt to n / most tasks instead; every task then also gives the hashes of its distinct strings,
    which meet, one row a string, in a second step that finds those that are alone in their task but not in all.
    """
    m, rest = shape.margin, shape.behind
    bytes_before, bytes_behind = np.random.default_rng(m).integers(0, 1 << 63, (m, 256), np.uint64), np.random.default_rng(m + 1).integers(0, 1 << 63, (rest, 256), np.uint64)
    dealing = F.pmod(F.xxhash64("doc_id", "h", "q"), F.when(F.col("context").isNull(), 4096).otherwise(F.ceil(F.coalesce("n", F.lit(1)) / most)))
    dealt = rows.join(F.broadcast(hot), "key", "left").withColumn("salt", dealing).withColumn("hot", F.col("n").isNotNull()).drop("n")
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(partitions, "key", "salt").sortWithinPartitions("key", "salt")
    names = ["kind", "string", "again", "doc_id", "h", "first", "behind"]

    def batch(kind: int, ids: np.ndarray, hashes: np.ndarray, a: np.ndarray, b: np.ndarray, string=None, again=None) -> pa.RecordBatch:
        n = len(ids)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, kind, np.int32)), pa.nulls(n, pa.int64()) if string is None else pa.array(string.view(np.int64)), pa.nulls(n, pa.bool_()) if again is None else pa.array(again), pa.array(ids), pa.array(hashes), pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64))], names
        )

    def resolve(t: pa.Table) -> Iterator[pa.RecordBatch]:
        get = lambda t, c: t.column(c).to_numpy()
        done = t.filter(pa.compute.is_null(t.column("context")))
        for kind in (0, 1):
            x = done.filter(pa.compute.equal(done.column("room"), kind))
            if len(x):
                yield batch(kind, get(x, "doc_id"), get(x, "h"), get(x, "q") + get(x, "low"), get(x, "q") + get(x, "high"))
        t = t.filter(pa.compute.is_valid(t.column("context")))
        if not len(t):
            return
        key, q, low, high, room, is_hot = get(t, "key").view(np.uint64), get(t, "q"), get(t, "low"), get(t, "high"), get(t, "room"), np.asarray(t.column("hot"))
        ids, hashes = get(t, "doc_id"), get(t, "h")
        document = mix(ids.view(np.uint64) * ODD[8] + hashes.view(np.uint64))
        around = np.frombuffer(b"".join(t.column("context").to_pylist()), np.uint8).reshape(len(t), m + rest)
        left, right = np.zeros((len(t), m + 1), np.uint64), np.zeros((len(t), rest + 1), np.uint64)
        np.cumsum(bytes_before[np.arange(m), around[:, :m][:, ::-1]], axis=1, out=left[:, 1:])
        np.cumsum(bytes_behind[np.arange(rest), around[:, m:]], axis=1, out=right[:, 1:])
        shares = np.zeros(len(t), bool)
        most_e, least_e = np.full(len(t), -1), np.full(len(t), m + 1)
        step = max(1, (1 << 21) // len(t))  # strings with another e are others, so only so many are held at a time
        for length in {shape.length, shape.passage}:
            for e0 in range(0, m + 1, step):
                es = np.arange(e0, min(e0 + step, m + 1))
                r, e = np.nonzero((es >= np.maximum(low, length - room)[:, None]) & (es <= high[:, None]))
                if not len(r):
                    continue
                e += e0
                s = string_keys(left, right, key, r, e, length, shape)
                order = np.argsort(s)
                s, r, e = s[order], r[order], e[order]
                same = s[1:] == s[:-1]
                first = np.r_[True, ~same]
                if length == shape.length:
                    again = np.r_[same, False] | ~first
                    np.maximum.at(most_e, r[again], e[again])
                    np.minimum.at(least_e, r[again], e[again])
                    once = np.flatnonzero(first & is_hot[r])
                    if len(once):
                        yield batch(0, ids[r[once]], hashes[r[once]], q[r[once]] - e[once], q[r[once]] - e[once] + length, s[once], again[once])
                if length == shape.passage:
                    head = np.flatnonzero(first)
                    several = np.minimum.reduceat(document[r], head) != np.maximum.reduceat(document[r], head)
                    shares[r[np.repeat(several, np.diff(np.r_[head, len(r)]))]] = True
                    once = head[is_hot[r[head]]]
                    if len(once):
                        yield batch(1, ids[r[once]], hashes[r[once]], np.zeros(len(once)), np.zeros(len(once)), s[once], np.zeros(len(once), bool))
        k = np.flatnonzero(most_e >= 0)
        if len(k):
            yield batch(0, ids[k], hashes[k], q[k] - most_e[k], q[k] - least_e[k] + shape.length)
        k = np.flatnonzero(shares)
        if len(k):
            k = k[np.unique(document[k], return_index=True)[1]]
            yield batch(1, ids[k], hashes[k], np.zeros(len(k)), np.zeros(len(k)))

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in stream:
            held.append(batch)
            n += len(batch)
            if n >= 4096:
                t = pa.Table.from_batches(held)
                key, salt = t.column("key").to_numpy(), t.column("salt").to_numpy()
                last = np.flatnonzero((key != key[-1]) | (salt != salt[-1]))  # the last group may go on
                whole = int(last[-1]) + 1 if len(last) else 0
                if whole:
                    yield from resolve(t.slice(0, whole).combine_chunks())
                rest = t.slice(whole)
                held, n = rest.to_batches(), len(rest) if whole else 0
        if held:
            t = pa.Table.from_batches(held)
            if len(t):
                yield from resolve(t)

    found = dealt.mapInArrow(freeing(run), FOUND)
    plain = ["kind", "doc_id", "h", "first", "behind"]
    if hot.isEmpty():
        return found.select(*plain)
    found = written_table(found)
    across = Window.partitionBy("string", "kind").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    document = F.xxhash64("doc_id", "h")
    singles = found.filter("string is not null").withColumns({"_n": F.count(F.lit(1)).over(across), "_several": F.min(document).over(across) != F.max(document).over(across)})
    return found.filter("string is null").select(*plain).union(singles.filter("case when kind = 0 then _n > 1 and not again else _several end").select(*plain))


def cleaned(df: DataFrame, text: str = "text", doc_id: str = "doc_id", shape: Shape = Shape(), batches: int = BATCHES, most: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, spans, kept, shares_passage), a row for each row of df: the bytes left when all that repeats is removed.

    A byte is removed if a string of shape.length bytes that covers it also starts anywhere else, in the same or another text. spans
    are the removed runs, array of (first, behind); kept is a binary, which may cut UTF-8 sequences. shares_passage: a string of
    shape.passage bytes of the text is also in another document, one with another doc_id or another text. Null texts are empty;
    rows that repeat each other are each other's copies.

    The documents come in `batches` to an index family, which finds the shared cores. A second scan takes the suffixes with such
    cores and their contexts; those with the same core are compared, string by string, and give spans; spans are joined with the
    texts. Cores that very many suffixes share are spread over tasks.
    """
    docs = df.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NULL_ID)).alias("doc_id"), text_of(text).alias("text")).withColumn("h", F.xxhash64("text"))
    family = IndexFamily(df.sparkSession, shape)
    shared = None
    for i in range(batches):
        found = family.add(docs.filter(F.pmod(F.xxhash64("doc_id", "h"), F.lit(batches)) == i), last=i == batches - 1)
        shared = found if shared is None else shared.union(found)
    family.close()
    shared = checkpointed(shared.groupBy("key").agg(F.max("n").alias("n")))
    number, total = shared.agg(F.count(F.lit(1)), F.sum("n")).first()
    # a million hot cores at most are broadcast, 16 MB; a core below is compared a few e at a time, so its task's memory is bounded
    hot = shared.filter(F.col("n") > max(most, (total or 0) // 1_000_000))
    found = repeated(contexts(docs, bitset(shared, number), shape), hot, shape, most).distinct()
    by_row = found.groupBy("doc_id", "h").agg(F.collect_list(F.when(F.col("kind") == 0, F.struct("first", "behind"))).alias("found"), F.max("kind").alias("shares"))

    def cut(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                sizes, spans, kept = [], [], []
                for body, found in zip(part.column("body"), part.column("found").to_pylist(), strict=True):
                    raw = body.as_py()
                    runs: list[list[int]] = []
                    for a, b in sorted((x["first"], x["behind"]) for x in found or ()):
                        if runs and a <= runs[-1][1]:
                            runs[-1][1] = max(runs[-1][1], b)
                        else:
                            runs.append([a, b])
                    edges = [0, *(x for r in runs for x in r), len(raw)]
                    sizes.append(len(raw))
                    spans.append([{"first": a, "behind": b} for a, b in runs])
                    kept.append(b"".join(raw[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("behind", pa.int64())]))), pa.array(kept, pa.binary()), part.column("shares_passage")], ["doc_id", "n_bytes", "spans", "kept", "shares_passage"])

    joined = docs.join(by_row, ["doc_id", "h"], "left").select(F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")).alias("doc_id"), F.encode("text", "UTF-8").alias("body"), "found", F.coalesce(F.col("shares") == 1, F.lit(False)).alias("shares_passage"))
    return joined.mapInArrow(freeing(cut), "doc_id long, n_bytes long, spans array<struct<first: long, behind: long>>, kept binary, shares_passage boolean")
