"""Near duplicates: an exact Jaccard self-join of n-gram sets by size-banded tiles and bitmap signatures."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, checkpointed, connected_components, drop_table, freeing, join_unique, one_of_each, text_of, written_table
from .filters import bitset, has

#: Words of a shingle; sets link if 100 * intersection >= LEAST * union.
N, LEAST = 5, 75
#: Bits of a set's bitmap at least; counters of the frequency sketch and counters of a block of it.
LEAST_BITS, COUNTERS, BLOCK = 256, 1 << 22, 1 << 12
#: Rows up to which a set of documents or groups is broadcast (24 bytes each); beyond, it is shuffled.
MOST_BROADCAST = 200_000
#: Stands for a null doc_id, which is larger than any other.
LAST_ID = 2**63 - 1
#: Sets of a token that meet in one tile.
TILE = 512
CHUNK = 1 << 20  # bytes of text at a time

_random = np.random.default_rng(20240229)
#: By place in a word (modulo 64) and byte; upper-case ASCII letters as lower-case ones, white space as nothing.
TABLE = _random.integers(0, 1 << 63, (64, 256), np.uint64) * np.uint64(2) + np.uint64(1)
TABLE[:, 65:91] = TABLE[:, 97:123]
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
TABLE[:, SPACE] = 0
TABLE = TABLE.ravel()
TURNS = _random.integers(0, 1 << 63, N + 1, np.uint64) * np.uint64(2) + np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(32))


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's distinct shingles, sorted, one text after another, and where each text's begin (one more at the end).

    Shingles are hashed to 64 bits. A text of fewer words than N has one shingle, its words; one without any has none.
    """
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if texts.buffers()[2] is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    bounds = offsets - offsets[0]
    out, sizes = [], np.zeros(len(texts), np.int64)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + CHUNK, "right")) - 1)
        hashes, counts = _sets(raw[bounds[at] : bounds[to]], bounds[at : to + 1] - bounds[at])
        out.append(hashes)
        sizes[at:to] = counts
        at = to
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(sizes)])


def _sets(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    docs = len(bounds) - 1
    word = ~SPACE[raw]
    first = word.copy()
    first[1:] &= ~word[:-1]
    inner = bounds[1:-1]
    inner = inner[inner < len(raw)]
    first[inner] = word[inner]  # a word ends with its text
    start = np.flatnonzero(first)
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(docs, np.int64)
    here = np.arange(len(raw), dtype=np.int32)
    place = here - np.maximum.accumulate(np.where(first, here, 0))
    h = TABLE[((place & 63) << 8) | raw]
    long = word & (place > 63)
    if long.any():
        h[long] *= (place[long] >> 6).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    words = mix(np.add.reduceat(h, start))
    doc = np.searchsorted(bounds, start, "right") - 1
    counts = np.bincount(doc, minlength=docs)
    ends = np.cumsum(counts)
    n = len(words)
    left = np.repeat(ends, counts) - np.arange(n)  # words from here to the end of the text
    shingle = words * TURNS[0]
    for j in range(1, N):
        shingle[: max(0, n - j)] += words[j:] * TURNS[j]
    keep = left >= N
    for d in np.flatnonzero((counts > 0) & (counts < N)).tolist():
        head = ends[d] - counts[d]
        keep[head] = True
        shingle[head : head + 1] = (words[head : ends[d]] * TURNS[: counts[d]]).sum() + counts[d : d + 1].astype(np.uint64) * TURNS[N]
    shingle, counts = mix(shingle[keep]), np.bincount(doc[keep], minlength=docs)
    ends = np.cumsum(counts)
    for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True):
        shingle[a:b].sort()
    new = np.ones(len(shingle), bool)
    new[1:] = shingle[1:] != shingle[:-1]
    heads = (ends - counts)[counts > 0]
    new[heads] = True
    return shingle[new], np.bincount(np.repeat(np.arange(docs), counts)[new], minlength=docs)


def set_keys(hashes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set (0, 0 of an empty one)."""
    sums = []
    for salt in (np.uint64(0x1234567), np.uint64(0x89ABCDE)):
        total = np.concatenate([[np.uint64(0)], np.cumsum(mix(hashes ^ salt), dtype=np.uint64)])
        sums.append(mix(total[starts[1:]] - total[starts[:-1]]))
    return sums[0].view(np.int64), sums[1].view(np.int64)


def bitmaps(hashes: np.ndarray, starts: np.ndarray) -> list[bytes]:
    """A bitmap of each set, of a power of 2 of bits: at least LEAST_BITS and three to an element."""
    out = []
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        bits = np.zeros(max(LEAST_BITS, 1 << (3 * (b - a)).bit_length()), bool)
        bits[(hashes[a:b] >> np.uint64(20)) % np.uint64(len(bits))] = True
        out.append(np.packbits(bits).tobytes())
    return out


def most_shared(x: bytes, n: int, y: bytes, m: int) -> int:
    """Elements that sets of n and m can have in common by their bitmaps; a longer one is folded to the other's length.

    An element whose bit the other set lacks is in no intersection, so as many elements at least as such bits are missing.
    """
    p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    while len(p) > len(q):
        p = p[: len(p) // 2] | p[len(p) // 2 :]
    while len(q) > len(p):
        q = q[: len(q) // 2] | q[len(q) // 2 :]
    return min(n - int(np.bitwise_count(p & ~q).sum()), m - int(np.bitwise_count(q & ~p).sum()))


def probe_length(n):
    """Elements, in any order that all sets share, of which one is common to a set of n and each smaller one that links with it."""
    return n - -(-LEAST * n // 100) + 1


def sets_of(docs: DataFrame, counters: int) -> DataFrame:
    """(kind, doc_id, h, n, a, b, bitmap): a row of kind 0 for each document, and of kind 1 for blocks of each task's frequency sketch.

    A block counts, for BLOCK counters, the shingles that hash to them; doc_id is its number and bitmap the packed counts.
    """
    names = ["kind", "doc_id", "h", "n", "a", "b", "bitmap"]

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, held, waiting = np.zeros(counters, np.uint32), [], 0
        for batch in stream:
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                hashes, starts = shingle_sets(part.column("text"))
                n = np.diff(starts)
                a, b = set_keys(hashes, starts)
                held.append((hashes & np.uint64(counters - 1)).astype(np.int64))
                waiting += len(hashes)
                if waiting > counters // 4:
                    sketch += np.bincount(np.concatenate(held), minlength=counters).astype(np.uint32)
                    held, waiting = [], 0
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(n), np.int8)), part.column("doc_id"), part.column("h"), pa.array(n), pa.array(a), pa.array(b), pa.array(bitmaps(hashes, starts), pa.binary())], names)
        if held:
            sketch += np.bincount(np.concatenate(held), minlength=counters).astype(np.uint32)
        full = np.flatnonzero(sketch.reshape(-1, BLOCK).any(axis=1))
        for i in range(0, len(full), 64):
            some = full[i : i + 64]
            packed = [zlib.compress(sketch[k * BLOCK : (k + 1) * BLOCK].tobytes(), 1) for k in some]
            zero = pa.array(np.zeros(len(some), np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(some), np.int8)), pa.array(some.astype(np.int64)), zero, zero, zero, zero, pa.array(packed, pa.binary())], names)

    return docs.mapInArrow(freeing(run), "kind byte, doc_id long, h long, n long, a long, b long, bitmap binary")


def frequency_classes(blocks: DataFrame, counters: int) -> np.ndarray:
    """For each counter the log2 of its count: one byte each, however much text was counted."""

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(BLOCK, np.uint64)
        for packed in table.column("bitmap"):
            total += np.frombuffer(zlib.decompress(packed.as_py()), np.uint32)
        levels = np.ceil(np.log2(total.astype(float) + 1)).astype(np.uint8).tobytes()
        return pa.table({"doc_id": table.column("doc_id").slice(0, 1), "levels": pa.array([levels], pa.binary())})

    merged = blocks.select("doc_id", "bitmap").groupBy("doc_id").applyInArrow(add, "doc_id long, levels binary")
    out = np.zeros(counters, np.uint8)
    for r in merged.collect():  # a byte for each counter, in one job
        out[r.doc_id * BLOCK : (r.doc_id + 1) * BLOCK] = np.frombuffer(r.levels, np.uint8)
    return out


def prefixes(docs: DataFrame, levels: np.ndarray, wanted: np.ndarray | None = None) -> DataFrame:
    """(token, node, n, place, weight): the shingles of each set's probe prefix and their places in it, from 0.

    All sets order their shingles alike, rare ones first: by the sketch's class, then by hash. So a passage that many documents
    share comes into a prefix only if there is hardly anything else. A token is the class (5 bits) and 59 bits of the hash, so it
    sorts in that order. weight is 100 times the mean class of all the set's shingles: in a family of near copies it is highest for
    the set that the others were made from. A task gives a set that it meets again only once. wanted is a bit set of the tokens
    to give, all if there is none.
    """
    shared, bits = docs.sparkSession.sparkContext.broadcast(levels), docs.sparkSession.sparkContext.broadcast(wanted)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, mask, seen = np.minimum(shared.value, 31).astype(np.uint64) << np.uint64(59), np.uint64(len(shared.value) - 1), set()
        for batch in stream:
            for at in range(0, len(batch), 500):
                hashes, starts = shingle_sets(batch.column("text").slice(at, 500))
                a, _ = set_keys(hashes, starts)
                n = np.diff(starts)
                fresh = []
                for i, key in enumerate(a.tolist()):
                    if n[i] and key not in seen:
                        fresh.append(i)
                        seen.add(key)
                if len(seen) > 1_000_000:
                    seen = set()
                tokens = classes[(hashes & mask).astype(np.int64)] | (hashes >> np.uint64(5))
                fresh = np.array(fresh, np.int64)
                many = probe_length(n[fresh])
                total = np.concatenate([[0], np.cumsum(tokens >> np.uint64(59), dtype=np.int64)])
                weight = (100 * (total[starts[fresh + 1]] - total[starts[fresh]]) // np.maximum(n[fresh], 1)).astype(np.int32)
                parts = []
                for s, e, k in zip(starts[fresh].tolist(), starts[fresh + 1].tolist(), many.tolist(), strict=True):
                    tokens[s:e].sort()
                    parts.append(tokens[s : s + k])
                if parts:
                    place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                    token, node, size, weight = np.concatenate(parts), np.repeat(a[fresh], many), np.repeat(n[fresh], many), np.repeat(weight, many)
                    if bits.value is not None:
                        some = has(bits.value, token)
                        token, node, size, place, weight = token[some], node[some], size[some], place[some], weight[some]
                    yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(node), pa.array(size), pa.array(place.astype(np.int32)), pa.array(weight)], ["token", "node", "n", "place", "weight"])

    return docs.mapInArrow(freeing(run), "token long, node long, n long, place int, weight int")


#: Shared tokens before a token that its row names, so that a pair is found at the first token it shares and rarely once more.
BEFORE = 4


def cross_pairs(tile: np.ndarray, side: np.ndarray, node: np.ndarray, n: np.ndarray, place: np.ndarray, label: np.ndarray, *before: np.ndarray) -> np.ndarray:
    """Pairs (a, b), a < b, of nodes with different labels that share a tile and may link; rows are sorted by tile.

    All rows of a tile have the same token. Those of sides 0 and 1 are only paired across, those of side -1 with each other.

    The first token that a pair shares leaves it no more than the rest of either set, so the pair is dropped where a rest is too
    small. It is also dropped if it shares one of the tokens before, as it has been found there. Within a token, nodes of the
    commonest label are only paired with the others: a family of near copies that is one group already costs nothing.
    """
    none = np.zeros((0, 2), np.int64)
    if not len(tile):
        return none
    head = np.flatnonzero(np.r_[True, tile[1:] != tile[:-1]])
    size = np.diff(np.r_[head, len(tile)])
    mixed = np.minimum.reduceat(label, head) != np.maximum.reduceat(label, head)
    out = []

    def found(i: np.ndarray, j: np.ndarray) -> None:
        least = LEAST * (n[i] + n[j])
        ok = (label[i] != label[j]) & ((side[i] < 0) | (side[i] != side[j])) & ((100 + LEAST) * (n[i] - place[i]) >= least) & ((100 + LEAST) * (n[j] - place[j]) >= least)
        i, j = i[ok], j[ok]
        again = np.zeros(len(i), bool)
        for x in before:
            for y in before:
                again |= (x[i] == y[j]) & (x[i] != 0)
        i, j = i[~again], j[~again]
        out.append(np.stack([np.minimum(node[i], node[j]), np.maximum(node[i], node[j])], 1))

    few = np.repeat(mixed & (size <= 64), size)
    rows = np.flatnonzero(few)
    for d in range(1, int(size[mixed & (size <= 64)].max(initial=1))):
        rows = rows[rows + d < len(tile)]
        rows = rows[tile[rows] == tile[rows + d]]
        found(rows, rows + d)
    for s, m in zip(head[mixed & (size > 64)].tolist(), size[mixed & (size > 64)].tolist(), strict=True):
        _, which, counts = np.unique(label[s : s + m], return_inverse=True, return_counts=True)
        main = which == counts.argmax()
        most, rest = s + np.flatnonzero(main), s + np.flatnonzero(~main)
        for left, right, later in ((rest, most, False), (rest, rest, True)):
            step = max(1, (1 << 20) // max(1, len(right)))
            for k in range(0, len(left), step):
                i = np.repeat(left[k : k + step], len(right))
                j = np.tile(right, len(left[k : k + step]))
                if later:
                    i, j = i[i < j], j[i < j]
                found(i, j)
            if len(out) > 64:
                out[:] = [np.unique(np.concatenate(out), axis=0)]
    return np.unique(np.concatenate(out), axis=0) if out else none


def tiled(rows: DataFrame, most: int = TILE) -> DataFrame:
    """rows (token, node, n, place, label) of tokens that several labels have, with BEFORE such tokens before, tile and side.

    A token's rows are one tile if they number `most` at most. Else those of its commonest label, which aren't compared with each
    other, are cut into blocks, as are the rest; a tile is a block of the first kind and one of the second (sides 1 and 0), or two
    of the second (or one with itself: side -1). So every pair of labels meets in exactly one tile, and no tile is large.
    """
    by_label = rows.groupBy("token", "label").agg(F.count(F.lit(1)).alias("c"))
    tokens = by_label.groupBy("token").agg(F.sum("c").alias("m"), F.max(F.struct("c", "label")).alias("top"), F.count(F.lit(1)).alias("labels")).filter("labels > 1")
    tokens = checkpointed(tokens.select("token", "m", F.col("top.label").alias("main"), F.col("top.c").alias("c")))
    total = tokens.agg(F.sum("m")).first()[0] or 0
    blocks = lambda n: F.greatest(F.lit(1), F.ceil(n / most)).cast("int")
    # shared tokens before a row's own: tokens sort as unsigned numbers, which a long of Spark's does not, so by place
    own = Window.partitionBy("node").orderBy("place")
    before = {f"before{k}": F.coalesce(F.lag("token", k).over(own), F.lit(0)) for k in range(1, BEFORE + 1)}
    dealt = join_unique(rows, tokens, "token", "m", total).withColumns(before).withColumns({"_a": blocks(F.col("c")), "_b": blocks(F.col("m") - F.col("c"))})
    hashed = F.xxhash64("node", F.lit("tile"))
    i, j = F.pmod(hashed, F.col("_a")).cast("int"), F.pmod(hashed, F.col("_b")).cast("int")
    tile = lambda number, side: F.struct(number.cast("long").alias("tile"), side.cast("int").alias("side"))
    of_main = F.transform(F.sequence(F.lit(0), F.col("_b") - 1), lambda k: tile(i * F.col("_b") + k, F.lit(1)))
    with_main = F.transform(F.sequence(F.lit(0), F.col("_a") - 1), lambda k: tile(k * F.col("_b") + j, F.lit(0)))
    among = F.transform(F.sequence(F.lit(0), F.col("_b") - 1), lambda k: tile(-1 - F.least(j, k) * F.col("_b") - F.greatest(j, k), F.when(j == k, -1).when(j < k, 0).otherwise(1)))
    where = F.when(F.col("m") <= most, F.array(tile(F.lit(0), F.lit(-1)))).when(F.col("label") == F.col("main"), of_main).otherwise(F.concat(with_main, among))
    return dealt.withColumn("_t", F.explode(where)).select(*rows.columns, *before, "_t.tile", "_t.side")


def candidates(rows: DataFrame, most: int = TILE) -> DataFrame:
    """Pairs (a, b) that cross_pairs() finds in rows (token, node, n, place, label)."""
    names = ["token", "tile", "side", "node", "n", "place", "label", *(f"before{k}" for k in range(1, BEFORE + 1))]

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def found(columns):
            token, tile, *rest = columns
            new = np.r_[False, (token[1:] != token[:-1]) | (tile[1:] != tile[:-1])] if len(token) else np.zeros(0, bool)
            pairs = cross_pairs(np.cumsum(new), *rest)
            for i in range(0, len(pairs), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(pairs[i : i + (1 << 16), 0]), pa.array(pairs[i : i + (1 << 16), 1])], ["a", "b"])

        for batch in stream:
            held.append([batch.column(c).to_numpy(zero_copy_only=False) for c in names])
            n += len(batch)
            if n >= 100_000:
                columns = [np.concatenate(x) for x in zip(*held, strict=True)]
                other = np.flatnonzero((columns[0] != columns[0][-1]) | (columns[1] != columns[1][-1]))
                whole = int(other[-1]) + 1 if len(other) else 0  # the last tile may go on
                yield from found([c[:whole] for c in columns])
                held = [[c[whole:] for c in columns]]
                n = len(columns[0]) - whole if whole else 0
        if held:
            yield from found([np.concatenate(x) for x in zip(*held, strict=True)])

    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = tiled(rows, most).select(*names).repartition(partitions, "token", "tile").sortWithinPartitions("token", "tile")
    return dealt.mapInArrow(freeing(run), "a long, b long").distinct()


def attach(pairs: DataFrame, key: str, table: DataFrame, columns: dict[str, str]) -> DataFrame:
    """pairs with columns of a table that has each key once. Where a key has many pairs, adaptive execution splits its partition."""
    return pairs.join(table.select(F.col("node").alias(key), *(F.col(a).alias(b) for a, b in columns.items())), key)


def bounded(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Those pairs (a, b) whose sizes and bitmaps allow a link."""
    both = attach(attach(pairs, "a", nodes, {"n": "n_a", "bitmap": "bits_a"}), "b", nodes, {"n": "n_b", "bitmap": "bits_b"})

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            rows = zip(batch.column("bits_a"), batch.column("n_a").to_pylist(), batch.column("bits_b"), batch.column("n_b").to_pylist(), strict=True)
            ok = [(100 + LEAST) * most_shared(x.as_py(), n, y.as_py(), m) >= LEAST * (n + m) for x, n, y, m in rows]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return both.mapInArrow(freeing(run), "a long, b long")


def texts_of(docs: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, text) for the wanted nodes, each once."""
    need = checkpointed(wanted.join(nodes.select("node", F.col("owner.doc_id").alias("doc_id"), F.col("owner.h").alias("h")), "node"))
    few = need.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    found = docs.join(F.broadcast(need) if few else need, ["doc_id", "h"])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:  # a doc_id may have several texts
            keys = set_keys(*shingle_sets(batch.column("text")))[0]
            yield batch.filter(pa.array(keys == batch.column("node").to_numpy()))

    return found.select("node", "text").mapInArrow(freeing(run), "node long, text string").groupBy("node").agg(F.min("text").alias("text"))


def linked(pairs: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Those pairs (a, b) of nodes that link: bitmaps first, then the intersection of the sorted sets themselves."""
    left = checkpointed(bounded(pairs, nodes))
    texts = texts_of(docs, nodes, left.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    both = attach(attach(left, "a", texts, {"text": "text_a"}), "b", texts, {"text": "text_b"})

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                sets = []
                for node, text in (("a", "text_a"), ("b", "text_b")):  # each node's set once
                    _, first, which = np.unique(part.column(node).to_numpy(), return_index=True, return_inverse=True)
                    hashes, starts = shingle_sets(part.column(text).take(pa.array(first)))
                    sets.append([hashes[starts[k] : starts[k + 1]] for k in which.tolist()])
                ok = []
                for p, q in zip(*sets, strict=True):
                    place = np.searchsorted(q, p)
                    same = int((q[np.minimum(place, len(q) - 1)] == p).sum()) if len(q) else 0
                    ok.append((100 + LEAST) * same >= LEAST * (len(p) + len(q)))
                yield part.select(["a", "b"]).filter(pa.array(ok))

    return both.mapInArrow(freeing(run), "a long, b long")


def classes(df: DataFrame, text: str = "text", doc_id: str = "doc_id", counters: int = COUNTERS) -> tuple[DataFrame, DataFrame]:
    """(doc_id, h, n, a) for each row of df, and (node, owner, component) for each distinct set; see near_duplicates().

    h is a hash of the text, a the node of a set that isn't empty; owner is the least (doc_id, h) of a node's rows. A null doc_id is
    2^63 - 1.
    """
    docs = df.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST_ID)).alias("doc_id"), F.xxhash64(text_of(text)).alias("h"), text_of(text).alias("text"))
    found = written_table(sets_of(docs, counters))
    own = found.filter("kind = 0").select("doc_id", "h", "n", "a", "b", "bitmap")
    levels = frequency_classes(found.filter("kind = 1"), counters)
    nodes = checkpointed(own.filter("n > 0").groupBy(F.col("a").alias("node"), "b", "n").agg(F.min(F.struct("doc_id", "h")).alias("owner"), F.first("bitmap").alias("bitmap")).drop("b"))
    # which tokens several nodes have, by partial sums; their rows, few, are then cut anew
    common = checkpointed(prefixes(docs, levels).groupBy("token").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low <> high").select(F.col("token").alias("key")))
    band = F.floor(F.log("n") / F.log(F.lit(100 / LEAST)) + 1e-9)
    # by node, as its columns then take next to no room in the table
    table = written_table(prefixes(docs, levels, bitset(common, common.count())).distinct().sortWithinPartitions("node", "place"))
    rows = table.withColumn("tile", F.xxhash64("token", band))
    tiles = rows.groupBy("tile").agg(F.max(F.struct("weight", "node")).alias("top"), F.count(F.lit(1)).alias("m")).filter("m > 1").select("tile", "m", F.col("top.node").alias("pivot"))
    stars = join_unique(rows.select("node", "tile"), tiles, "tile", "m", rows.count()).filter("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()
    first = checkpointed(linked(checkpointed(stars), docs, nodes))
    groups = checkpointed(connected_components(first.select(F.col("a").alias("src"), F.col("b").alias("dst"))).select(F.col("id").alias("node"), F.col("component").alias("_label")))
    few = groups.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    labelled = written_table(table.join(F.broadcast(groups) if few else groups, "node", "left").select("token", "node", "n", "place", F.coalesce("_label", "node").alias("label")))
    drop_table(table)
    second = checkpointed(linked(checkpointed(candidates(labelled)), docs, nodes))
    drop_table(labelled)
    components = connected_components(first.union(second).select(F.col("a").alias("src"), F.col("b").alias("dst")))
    placed = nodes.select("node", "owner").join(components.select(F.col("id").alias("node"), "component"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    return own.select("doc_id", "h", "n", F.when(F.col("n") > 0, F.col("a")).alias("a")), checkpointed(placed)


def near_duplicates(df: DataFrame, text: str = "text", doc_id: str = "doc_id", counters: int = COUNTERS) -> DataFrame:
    """(doc_id, n_shingles, component_id), a row for each row of df; exact: no link between sets is missed, none is added.

    1. Equal sets become one node (128 bits tell them apart), with its size and bitmap, so that copies are never paired.
    2. Each set's prefix, rare shingles first, goes to the tiles (shingle, size band): sets that link share one.
    3. In a tile every set is compared with one of them, its pivot, likely the one that the others were made from; links found make
       groups. Families of near copies, whatever their size, collapse here with as many comparisons as members.
    4. What shares a shingle across groups, with sizes and places in the prefix that allow a link, is compared: bitmaps bound the
       overlap from above, the survivors' sorted sets are intersected. A shingle that many sets share is cut into tiles of blocks.
    5. The links' connected components; each gets its smallest doc_id.

    Texts without words are empty sets and linked with nothing, so a row's component is its own doc_id. A null doc_id is larger
    than any other and null again in the result. Rows with the same doc_id are judged each by its own text.
    """
    own, placed = classes(df, text, doc_id, counters)
    least = placed.groupBy("component").agg(F.min("owner.doc_id").alias("component_id"))
    by_node = placed.join(least, "component").select(F.col("node").alias("a"), "component_id").join(own.groupBy("a").agg(F.count(F.lit(1)).alias("_w")), "a")
    out = join_unique(own.select("doc_id", "n", "a"), by_node, "a", "_w", df.count(), how="left")
    component = F.coalesce("component_id", "doc_id")
    null = lambda c: F.when(c != LAST_ID, c)
    return out.select(null(F.col("doc_id")).alias("doc_id"), F.col("n").alias("n_shingles"), null(component).alias("component_id"))


def survivors(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row of df for each group of near copies, and every row without words.

    The row with the smallest doc_id stays, a null one being larger than any other; of its rows with different texts that with the
    least hash of the text, and of those that repeat both the one whose columns have the least hash. Rows are told by doc_id and
    text, so that nothing stays because it shares the doc_id of another row that does.
    """
    _, placed = classes(df, text, doc_id)
    stay = placed.groupBy("component").agg(F.min("owner").alias("one")).select(F.col("one.doc_id").alias("__id"), F.col("one.h").alias("__h"))
    has_words = F.rlike(text_of(text), F.lit(WORD))
    marked = df.withColumns({"__id": F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST_ID)), "__h": F.xxhash64(text_of(text))})
    one = one_of_each(marked.filter(has_words), "__id", "__h").join(stay, ["__id", "__h"], "left_semi")
    return one.select(*df.columns).union(df.filter(~has_words))
