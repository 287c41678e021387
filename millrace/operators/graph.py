"""Graphs as node and edge tables: neighbourhoods, shortest paths, gangs."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..work import checkpointed

#: Node label and edge type of each entity type, and those of all others; edges that the drawn graph shows.
LABELS = {"wechat": "Account", "qq": "Account", "alipay": "Account", "telegram": "Account", "phone": "Contact", "email": "Contact", "bank_card": "Contact", "url": "Link", "domain": "Link", "ip": "Link", "tool": "Tool", "slang": "Slang", "crypto_wallet": "Wallet"}
RELATIONS = {"wechat": "USES_ACCOUNT", "qq": "USES_ACCOUNT", "alipay": "USES_ACCOUNT", "telegram": "USES_ACCOUNT", "phone": "USES_CONTACT", "email": "USES_CONTACT", "bank_card": "USES_CONTACT", "url": "PROMOTES_LINK", "domain": "PROMOTES_LINK", "ip": "PROMOTES_LINK", "tool": "PROMOTES_TOOL", "slang": "USES_SLANG", "crypto_wallet": "USES_CONTACT"}
OTHER_LABEL, OTHER_RELATION = "Contact", "MENTIONS"
DRAWN = ("MENTIONS", "PROMOTES", "EXTRACTED_FROM")
#: What a type is called in tables of neighbours; other types go by their own name.
TYPE_NAMES = {"phone": "手机号", "wechat": "微信号", "qq": "QQ号", "email": "邮箱", "url": "链接", "domain": "域名", "ip": "IP地址", "bank_card": "银行卡", "alipay": "支付宝", "slang": "黑话", "tool": "工具/脚本", "crypto_wallet": "加密钱包", "feature": "风险特征"}
PREVIEW = 200
#: Pairs of members and targets of a block of members, blocks of a part, tasks, and pairs up to which blocks are dealt; meetings that a
#: task holds at once, most cells of a table of sums, and the power of two of sums by which most meetings are left out where cells are more.
PAIRS_OF_BLOCK, BLOCKS_OF_PART, TASKS, FEW_PAIRS = 2_000_000, 4, 256, 1_000_000
MET, CELLS, BUCKETS = 4_000_000, 16_000_000, 22
#: Words of 64 seeds in a row of a search, and such rows that become (seed, node) rows at once.
WORDS, ROWS_AT_ONCE = 8, 1024
#: Neighbours from which on a node is of the cover; nodes of a cover up to which a tile has all words of a block; most parts of blocks.
HEAVY, NARROW, TILES = 64, 250_000, 32
#: Parts of members, and of the nodes outside of the cover; edges of a row of those; nodes that a task works out at once.
PARTS, EDGES, NODES = 32, 500_000, 8192


def _named(kind: Column, names: dict[str, str], other: Column) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for kv in names.items() for x in kv))[kind], other)


def intel_nodes(posts: DataFrame, key: str = "raw_id", text: str = "text") -> DataFrame:
    """(key, platform, content_preview), a row for each row of posts."""
    return posts.select(key, "platform", F.left(F.coalesce(text, F.lit("")), F.lit(PREVIEW)).alias("content_preview"))


def entity_nodes(entities: DataFrame) -> DataFrame:
    """(label, value, type, uuid) of entities (entity_type, entity_value): one node a label and value, under the last of its types by name."""
    kind = F.col("entity_type")
    nodes = entities.groupBy(_named(kind, LABELS, F.lit(OTHER_LABEL)).alias("label"), F.col("entity_value").alias("value")).agg(F.max(kind).alias("type"))
    return nodes.withColumn("uuid", F.concat_ws(":", "type", "value"))


def typed_edges(entities: DataFrame, key: str = "raw_id") -> DataFrame:
    """(src, relation, label, dst), all strings: post to entity by the entity's type, and entity (type:value) back to post; each edge once."""
    kind, post = F.col("entity_type"), F.col(key).cast("string")
    there = entities.select(post.alias("src"), _named(kind, RELATIONS, F.lit(OTHER_RELATION)).alias("relation"), _named(kind, LABELS, F.lit(OTHER_LABEL)).alias("label"), F.col("entity_value").alias("dst"))
    back = entities.select(F.concat_ws(":", "entity_type", "entity_value").alias("src"), F.lit("EXTRACTED_FROM").alias("relation"), F.lit("Intel").alias("label"), post.alias("dst"))
    return there.union(back).distinct()


def subgraph(posts: DataFrame, entities: DataFrame, search: str = "", limit: int | None = 50, key: str = "raw_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) to draw: nodes (id, label, group) and edges (from, to, label) of the relations in DRAWN.

    Typed edges are not among those, so only entities of unknown types have a second edge. search keeps entities whose value has
    it; the first `limit` edges by post, value and relation are drawn (None: all). An id has one node, a post's before an entity's.
    """
    kind, post = F.col("entity_type"), F.col(key).cast("string")
    legacy = entities.select(post.alias("from"), F.col("entity_value").alias("to"), F.lit("EXTRACTED_FROM").alias("label"), kind.alias("type"), kind.alias("group"))
    unknown = entities.filter(~kind.isin(*RELATIONS)).select(post.alias("from"), F.col("entity_value").alias("to"), F.lit(OTHER_RELATION).alias("label"), kind.alias("type"), F.lit(OTHER_LABEL.lower()).alias("group"))
    shown = legacy.union(unknown).distinct().filter(F.contains("to", F.lit(search)) & F.col("label").isin(*DRAWN))
    shown = shown if limit is None else shown.orderBy("from", "to", "label", "type").limit(limit)
    ids = shown.select(F.col("from").alias("id")).distinct()
    intel = posts.select(post.alias("id"), F.left(F.coalesce(text, F.lit("")), F.lit(25)).alias("label"), F.lit("intel").alias("group")).join(ids, "id", "left_semi")
    ends = shown.select(F.col("to").alias("id"), F.concat_ws(":", "type", "to").alias("label"), "group")
    both = intel.withColumn("_k", F.lit(0)).union(ends.withColumn("_k", F.lit(1)))
    nodes = both.groupBy("id").agg(F.min(F.struct("_k", "label", "group")).alias("_n")).select("id", "_n.label", "_n.group")
    return nodes, shown.select("from", "to", "label")


def neighbour_table(related: DataFrame) -> DataFrame:
    """(labels, relation, clue_type, clue_value, hops) of related nodes (labels array, type, value, uuid, raw_id, relation, hops).

    Posts are left out; of rows that agree in all five one stays. What is unknown is `-`.
    """
    dash = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("-"))
    labels = F.array_join("labels", ",")
    kind = F.coalesce(F.nullif("type", F.lit("")), F.get("labels", F.lit(0)), F.lit("-"))
    value = F.coalesce(F.nullif("value", F.lit("")), F.nullif("uuid", F.lit("")), F.lit("-"))
    clues = related.filter(~F.array_contains("labels", "Intel") & (kind != "Intel") & (value != "-") & (F.coalesce(F.col("raw_id"), F.lit(0)) == 0))
    return clues.select(dash(labels).alias("labels"), dash(F.col("relation")).alias("relation"), _named(kind, TYPE_NAMES, kind).alias("clue_type"), value.alias("clue_value"), "hops").distinct()


def undirected(edges: DataFrame) -> DataFrame:
    """(edge, a, b) both ways, edge being the edge's identifier."""
    return edges.select("edge", F.col("src").alias("a"), F.col("dst").alias("b")).union(edges.select("edge", F.col("dst").alias("a"), F.col("src").alias("b")))


def neighbourhood(edges: DataFrame, seeds: DataFrame, hops: int = 2) -> DataFrame:
    """(seed, node, hops): nodes that a path of at most `hops` (1 to 3) different edges reaches, with the fewest hops.

    The shortest way to a node uses no edge twice, so these are the lengths of shortest paths.
    """
    return shortest_lengths(edges, seeds, max(1, min(3, hops))).withColumnRenamed("length", "hops").filter("seed <> node")


def _numbered(seeds: DataFrame) -> DataFrame:
    """(seed, block, bit): distinct seeds in blocks of at most 64 * WORDS."""
    one = seeds.select("seed").filter("seed is not null").distinct()
    parts = max(1, -(-one.count() // (52 * WORDS)))  # about four fifths of a block, so that few parts take a second one
    at = F.row_number().over(Window.partitionBy("part").orderBy("seed")) - 1
    placed = one.withColumn("part", F.pmod(F.xxhash64("seed"), F.lit(parts)).cast("int")).withColumn("at", at)
    return placed.select("seed", (F.col("part") + parts * F.floor(F.col("at") / (64 * WORDS)).cast("int")).alias("block"), (F.col("at") % (64 * WORDS)).alias("bit"))


def shortest_lengths(edges: DataFrame, seeds: DataFrame, most: int = 6) -> DataFrame:
    """(seed, node, length) of shortest paths of at most `most` edges: breadth first, each node once a seed.

    Seeds go in blocks of 64 * WORDS, one bit each. Only nodes of a cover, of which every edge has one at an end, get rows a block:
    the ends of edges on the side that has fewer nodes, and others with more than HEAVY neighbours. Any other node has its neighbours
    there, so its lengths are theirs and one more; they are worked out where rows are made, and written nowhere.
    """
    ends = checkpointed(edges.select("src", "dst").distinct())
    seeds = seeds.select("seed").filter("seed is not null").distinct()
    kinds = [seeds.schema["seed"].dataType.simpleString(), edges.schema["dst"].dataType.simpleString()]
    sides = ends.agg(F.approx_count_distinct("src"), F.approx_count_distinct("dst")).first()
    if sides[0] < sides[1]:
        ends = ends.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    heavy = ends.groupBy("src").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HEAVY)
    cover = checkpointed(ends.select(F.col("dst").alias("a")).union(heavy.select("src")).filter("a is not null").distinct())
    # a null is reached, but no path goes on from it
    inside = ends.join(cover, ends.src == cover.a, "left_semi").union(ends.filter("src is null"))
    arcs = inside.filter("src is not null").union(inside.filter("dst is not null").select("dst", "src")).toDF("a", "b")
    arcs = checkpointed(arcs.distinct())
    packed = checkpointed(_adjacency(ends.filter("src is not null").join(cover, ends.src == cover.a, "left_anti")))
    found, numbered, blocks = _cover_lengths(ends, arcs, cover, packed, seeds, most)
    names = numbered.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("bit", "seed"))).alias("s")).select("block", F.col("s.seed").alias("seeds"))
    by_block = found.join(F.broadcast(names), "block")
    inner = by_block.filter("length > 0").select("node", "length", "seeds", *_words(WORDS)).mapInArrow(_rows, f"node {kinds[1]}, length int, seeds array<{kinds[0]}>")
    parts = [seeds.select("seed", F.col("seed").cast(kinds[1]).alias("node"), F.lit(0).alias("length")), _exploded(inner)]
    wide = WORDS if cover.count() <= NARROW else 1  # of a large cover, lengths of fewer seeds are held at once
    from_cover = by_block.filter((F.col("length") < most) & F.col("node").isNotNull())
    for first in range(0, WORDS, wide):
        some = from_cover.select("block", "node", "length", F.slice("seeds", 64 * first + 1, 64 * wide).alias("seeds"), *(F.col(f"w{first + i}").alias(f"w{i}") for i in range(wide)))
        some = some.filter(reduce(lambda x, y: x | y, (F.col(w) != 0 for w in _words(wide))))
        held = some.repartition(min(blocks, TILES), "block").groupBy("block").applyInArrow(_held, f"seeds array<{kinds[0]}>, ends array<{kinds[1]}>, lengths binary, words binary")
        tiles = packed.crossJoin(checkpointed(held).hint("shuffle_replicate_nl"))
        parts.append(_exploded(tiles.coalesce(PARTS * TILES).mapInArrow(_one_more, f"node {kinds[1]}, length int, seeds array<{kinds[0]}>")))
    return reduce(DataFrame.union, parts)


def _words(n: int) -> list[str]:
    return [f"w{i}" for i in range(n)]


def _exploded(df: DataFrame) -> DataFrame:
    return df.select(F.explode("seeds").alias("seed"), "node", "length")


def _cover_lengths(ends: DataFrame, arcs: DataFrame, cover: DataFrame, packed: DataFrame, seeds: DataFrame, most: int) -> tuple[DataFrame, DataFrame, int]:
    """(block, node, length, words) of nodes of the cover, (seed, block, bit), and how many blocks there are.

    From one node of the cover to another a shortest path takes an edge, or two over a node outside of it; pairs of nodes with such
    a node are made once, without the seeds.
    """
    words = _words(WORDS)
    any_bit = reduce(lambda x, y: x | y, (F.col(w) != 0 for w in words))
    numbered = checkpointed(_numbered(seeds))
    blocks = max(1, numbered.select("block").distinct().count())
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("bit") % 64).cast("int"))
    first = numbered.select("block", F.col("seed").alias("node"), *(F.when(F.floor(F.col("bit") / 64) == i, bit).otherwise(0).alias(w) for i, w in enumerate(words)))
    before, front = None, checkpointed(first.join(cover, first.node == cover.a, "left_semi"))
    seen, found, over = front, front.withColumn("length", F.lit(0)), None

    def stepped(of: DataFrame, by: DataFrame) -> DataFrame:
        return of.join(by, of.node == by.a).select("block", F.col("b").alias("node"), *words)

    for k in range(1, most + 1):
        near = stepped(front, arcs)
        if k == 1:
            near = near.union(stepped(first, ends.toDF("a", "b")))
        elif not before.isEmpty():
            if over is None:
                kind = ends.schema["dst"].dataType.simpleString()
                over = checkpointed(packed.mapInArrow(_two_apart, f"a {kind}, b {kind}").distinct())
            near = near.union(stepped(before, over))
        near = near.groupBy("block", "node").agg(*(F.bit_or(w).alias(w) for w in words))
        old = seen.select(F.col("block").alias("_block"), F.col("node").alias("_node"), *(F.col(w).alias(f"_{w}") for w in words))
        new = near.join(old, (F.col("block") == F.col("_block")) & F.col("node").eqNullSafe(F.col("_node")), "left")
        new = new.select("block", "node", *(F.col(w).bitwiseAND(F.bitwise_not(F.coalesce(f"_{w}", F.lit(0).cast("long")))).alias(w) for w in words))
        before, front = front, checkpointed(new.filter(any_bit))
        found = found.union(front.withColumn("length", F.lit(k)))
        if k < most:
            seen = checkpointed(seen.union(front).groupBy("block", "node").agg(*(F.bit_or(w).alias(w) for w in words)))
    return found, numbered, blocks


def _adjacency(ends: DataFrame) -> DataFrame:
    """Rows of about EDGES edges (src, dst) each, of whole nodes src: nodes, begins of their edges, and edges as places in `ends`."""
    src, dst = (ends.schema[c].dataType.simpleString() for c in ("src", "dst"))

    def row(run: pa.Table) -> pa.RecordBatch:
        run = run.combine_chunks()
        node = run.column("src").combine_chunks().dictionary_encode()
        end = run.column("dst").combine_chunks().dictionary_encode("encode")
        begins = np.flatnonzero(np.diff(node.indices.to_numpy(), prepend=-1)).astype("<i4")
        one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
        edges = end.indices.to_numpy().astype("<i4")
        return pa.RecordBatch.from_arrays([one(node.dictionary), pa.array([begins.tobytes()]), one(end.dictionary), pa.array([edges.tobytes()])], ["nodes", "begins", "targets", "edges"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held, rows = [*held, batch], rows + batch.num_rows
            if rows >= EDGES:
                whole = pa.Table.from_batches(held)
                src = whole.column("src")
                last = pc.index(src, src[-1]).as_py()  # the last node may go on in the next batch
                if last:
                    yield row(whole.slice(0, last))
                held, rows = whole.slice(last).to_batches(), rows - last
        if rows:
            yield row(pa.Table.from_batches(held))

    return ends.repartition(PARTS, "src").sortWithinPartitions("src").mapInArrow(run, f"nodes array<{src}>, begins binary, targets array<{dst}>, edges binary")


def _lists(row: pa.RecordBatch) -> tuple[pa.Array, np.ndarray, pa.Array, np.ndarray]:
    numbers = lambda c: np.frombuffer(row.column(c)[0].as_buffer(), "<i4")
    return row.column("nodes").flatten(), numbers("begins"), row.column("targets").flatten(), numbers("edges")


def _two_apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b), distinct within a row: neighbours of a node, a not null."""
    for whole in batches:
        for r in range(whole.num_rows):
            nodes, begins, targets, edges = _lists(whole.slice(r, 1))
            known = targets.is_valid().to_numpy(zero_copy_only=False)
            starts = np.append(begins, len(edges)).astype(np.int64)
            held, pairs, step = [], np.empty(0, np.int64), max(1, MET // HEAVY**2)
            for at in range(0, len(nodes), step):
                stop = min(at + step, len(nodes))
                degree = np.diff(starts[at : stop + 1])
                each = np.repeat(degree, degree)  # of an edge, the edges of its node
                a = np.repeat(edges[starts[at] : starts[stop]].astype(np.int64), each)
                behind = np.repeat(np.cumsum(each) - each, each)
                b = edges[np.repeat(np.repeat(starts[at:stop], degree), each) + np.arange(len(a)) - behind]
                held.append(a * len(targets) + b)
                if sum(map(len, held)) >= MET or stop == len(nodes):
                    held, pairs = [], np.unique(np.concatenate([pairs, *held]))
            a, b = pairs // len(targets), pairs % len(targets)
            told = known[a] & (a != b)
            a, b = a[told], b[told]
            for some in range(0, len(a), MET):
                yield pa.RecordBatch.from_arrays([targets.take(pa.array(a[some : some + MET])), targets.take(pa.array(b[some : some + MET]))], ["a", "b"])


def _held(table: pa.Table) -> pa.Table:
    """One row of what a block's seeds reach in the cover."""
    table = table.combine_chunks()
    seeds = table.column("seeds").combine_chunks()[:1].flatten()
    ends = table.column("node").combine_chunks()
    words = np.stack([table.column(w).to_numpy() for w in table.column_names if w[0] == "w"], axis=1).astype("<u8")
    one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
    return pa.Table.from_arrays([one(seeds), one(ends), pa.array([table.column("length").to_numpy().astype("<i4").tobytes()]), pa.array([words.tobytes()])], ["seeds", "ends", "lengths", "words"])


def _spelled(masks: np.ndarray, node: pa.Array, length: pa.Array, seeds: pa.Array, begin: np.ndarray | int = 0) -> pa.RecordBatch:
    """(node, length, seeds): the seeds whose bits are set in a node's mask; those of a node begin at `begin`."""
    bits = np.unpackbits(np.ascontiguousarray(masks, "<u8").view(np.uint8), bitorder="little").view(bool)
    at, bit = np.divmod(np.flatnonzero(bits), 64 * masks.shape[1])
    offsets = np.searchsorted(at, np.arange(len(masks) + 1)).astype(np.int32)
    of = pa.ListArray.from_arrays(pa.array(offsets), seeds.take(pa.array(bit + (begin[at] if isinstance(begin, np.ndarray) else begin))))
    return pa.RecordBatch.from_arrays([node, length, of], ["node", "length", "seeds"])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for start in range(0, whole.num_rows, ROWS_AT_ONCE):
            batch = whole.slice(start, ROWS_AT_ONCE)
            masks = np.stack([batch.column(w).to_numpy() for w in _words(batch.num_columns - 3)], axis=1)
            of = batch.column("seeds")  # bits of a block are numbered from 0 without gaps
            yield _spelled(masks, batch.column("node"), batch.column("length"), of.values, of.offsets.to_numpy()[:-1].astype(np.int64))


def _one_more(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What seeds reach outside of the cover: the shortest of the neighbours' lengths, and one more."""
    for whole in batches:
        for r in range(whole.num_rows):
            row = whole.slice(r, 1)
            nodes, begins, targets, edges = _lists(row)
            seeds, ends = row.column("seeds").flatten(), row.column("ends").flatten()
            lengths = np.frombuffer(row.column("lengths")[0].as_buffer(), "<i4")
            words = np.frombuffer(row.column("words")[0].as_buffer(), "<u8").reshape(len(lengths), -1)
            tables = []
            for length in np.unique(lengths):
                at = np.flatnonzero(lengths == length)
                place = pc.index_in(targets, value_set=ends.take(pa.array(at))).fill_null(-1).to_numpy()
                table = np.zeros((len(targets), words.shape[1]), np.uint64)
                table[place >= 0] = words[at[place[place >= 0]]]
                if table.any():
                    tables.append((int(length) + 1, table))
            own = pc.index_in(nodes, value_set=seeds.cast(nodes.type)).fill_null(-1).to_numpy()
            starts = np.append(begins, len(edges)).astype(np.int64)
            for at in range(0, len(nodes), NODES):
                stop = min(at + NODES, len(nodes))
                seen = np.zeros((stop - at, words.shape[1]), np.uint64)
                is_seed = np.flatnonzero(own[at:stop] >= 0)
                bit = own[at:stop][is_seed]
                seen[is_seed, bit // 64] = np.uint64(1) << (bit % 64).astype(np.uint64)
                some = edges[starts[at] : starts[stop]]
                for length, table in tables:
                    new = np.bitwise_or.reduceat(table[some], starts[at:stop] - starts[at], axis=0) & ~seen
                    seen |= new
                    reached = np.flatnonzero(new.any(axis=1))
                    for i in range(0, len(reached), ROWS_AT_ONCE):
                        of = reached[i : i + ROWS_AT_ONCE]
                        yield _spelled(new[of], nodes.take(pa.array(at + of)), pa.array(np.full(len(of), length, np.int32)), seeds)


#: A block of members: their names, places of their targets among `targets` (member by member, from own_begins on), and the members of
#: each target (from begins on), as numbers of 4 bytes; own_n and n are the weights in both orders, or nothing where all are 1.
_OWN, _OTHER = ("names", "targets", "own_begins", "own", "own_n"), ("names", "targets", "begins", "members", "n")


def _met(pairs: DataFrame, least: int) -> DataFrame:
    """(a, b, shared), a < b: the sum of x.n * y.n over targets that both have, where it is at least `least`; pairs: distinct (member,
    target) with n, in PARTS parts by member.

    Pairs of members are never shuffled, as they are many more than the pairs of members and targets: members are in packed blocks, and
    a task multiplies two blocks, a run of members at a time. Few pairs are dealt to the tiles; of more, each tile reads its two blocks
    from where they were written once, so that what is on disk follows the pairs.
    """
    kind, of = (pairs.schema[c].dataType.simpleString() for c in ("member", "target"))
    numbers = isinstance(pairs.schema["target"].dataType, IntegralType)
    schema = f"block long, pairs long, names array<{kind}>, targets {'binary' if numbers else f'array<{of}>'}, own_begins binary, own binary, own_n binary, begins binary, members binary, n binary"
    blocks = checkpointed(pairs.sortWithinPartitions("member").mapInArrow(_packed(numbers), schema))
    total, many = blocks.agg(F.coalesce(F.sum("pairs"), F.lit(0)), F.count(F.lit(1))).first()
    found = f"a {kind}, b {kind}, shared long"
    if total <= FEW_PAIRS:
        dealt = blocks.crossJoin(F.broadcast(blocks.select(F.col("block").alias("other"))))
        dealt = dealt.withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")}).drop("pairs", "other")

        def grouped(table: pa.Table) -> pa.Table:
            rows = table.combine_chunks().to_batches()[0]
            ids = [rows.column(c)[0].as_py() for c in ("lo", "hi")]
            lo, hi = (_block(rows.slice(rows.column("block").to_pylist().index(i), 1), numbers) for i in ids)
            return pa.Table.from_batches(_meetings(lo, hi, ids[0] == ids[1], least), pa.schema([("a", lo["names"].type), ("b", lo["names"].type), ("shared", pa.int64())]))

        return dealt.groupBy("lo", "hi").applyInArrow(grouped, found)
    if many > BLOCKS_OF_PART * PARTS:  # a task holds the blocks of one part
        blocks = checkpointed(blocks.repartition(-(-many // BLOCKS_OF_PART)))
    lo = blocks.select(F.col("block").alias("lo"), *(F.col(c).alias(f"lo_{c}") for c in _OWN))
    hi = blocks.select(F.col("block").alias("hi"), *(F.col(c).alias(f"hi_{c}") for c in _OTHER))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for r in range(whole.num_rows):
                row = whole.slice(r, 1)
                same = row.column("lo")[0].as_py() == row.column("hi")[0].as_py()
                yield from _meetings(_block(row, numbers, "lo_"), _block(row, numbers, "hi_"), same, least)

    once = F.expr("lo = hi or (lo < hi) = (pmod(lo + hi, 2) = 0)")  # of two blocks, either is the first as often
    return lo.join(hi.hint("shuffle_replicate_nl"), once).coalesce(TASKS).mapInArrow(run, found)


def _packed(numbers: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks of about PAIRS_OF_BLOCK rows (member, target, n) in the order of members, each of whole members."""

    def row(number: int, held: pa.Table) -> pa.RecordBatch:
        names = held.column("member").combine_chunks().dictionary_encode()
        member = names.indices.to_numpy().astype("<i4")
        if numbers:
            targets, own = np.unique(held.column("target").to_numpy().astype("<i8"), return_inverse=True)
            targets = pa.array([targets.tobytes()])
        else:
            coded = held.column("target").combine_chunks().dictionary_encode()
            own, targets = coded.indices.to_numpy(), pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary)
        own, n = own.ravel().astype("<i4"), held.column("n").to_numpy().astype("<i8")
        order = np.argsort(own, kind="stable")
        begins = np.concatenate([[0], np.cumsum(np.bincount(own))])
        weights = [x.tobytes() if (n != 1).any() else b"" for x in (n, n[order])]
        bytes_of = lambda x: pa.array([x.astype("<i4").tobytes()])
        columns = {"block": pa.array([number]), "pairs": pa.array([len(n)]), "names": pa.ListArray.from_arrays(pa.array([0, len(names.dictionary)], pa.int32()), names.dictionary), "targets": targets}
        columns |= {"own_begins": bytes_of(np.concatenate([[0], np.cumsum(np.bincount(member))])), "own": bytes_of(own), "own_n": pa.array(weights[:1]), "begins": bytes_of(begins), "members": bytes_of(member[order]), "n": pa.array(weights[1:])}
        return pa.RecordBatch.from_pydict(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId()
        held, rows, blocks = [], 0, 0
        for batch in batches:
            held, rows = [*held, batch], rows + batch.num_rows
            if rows >= PAIRS_OF_BLOCK:
                whole = pa.Table.from_batches(held)
                member = whole.column("member")
                last = pc.index(member, member[-1]).as_py()  # the last member may go on in the next batch
                if last:
                    yield row(first + (blocks << 32), whole.slice(0, last))
                    blocks += 1
                held, rows = whole.slice(last).to_batches(), rows - last
        if rows:
            yield row(first + (blocks << 32), pa.Table.from_batches(held))

    return run


def _block(row: pa.RecordBatch, numbers: bool, prefix: str = "") -> dict:
    out = {}
    for name in {*_OWN, *_OTHER} & {c.removeprefix(prefix) for c in row.schema.names}:
        column = row.column(prefix + name)
        if name == "names" or (name == "targets" and not numbers):
            out[name] = column.flatten()
        else:
            out[name] = np.frombuffer(column[0].as_buffer(), "<i8" if name in ("targets", "own_n", "n") else "<i4")
    return out


def _meetings(lo: dict, hi: dict, same: bool, least: int) -> Iterator[pa.RecordBatch]:
    """(a, b, shared) of a member of one block and one of the other, or of two of the same."""
    own, begins = lo["own"], hi["begins"].astype(np.int64)
    if isinstance(lo["targets"], np.ndarray):
        place = np.minimum(np.searchsorted(hi["targets"], lo["targets"]), len(hi["targets"]) - 1)
        met = hi["targets"][place] == lo["targets"]
    else:
        place = pc.index_in(lo["targets"], value_set=hi["targets"]).fill_null(-1).to_numpy()
        met = place >= 0
    begin, end = begins[place][own], np.where(met, begins[place + 1], begins[place])[own]
    if same:  # only members behind
        begin[np.argsort(own, kind="stable")] = np.arange(1, len(own) + 1)
    many = end - begin
    some = np.flatnonzero(many > 0)
    member = np.repeat(np.arange(len(lo["names"])), np.diff(lo["own_begins"]))[some]
    begin, many = begin[some], many[some]
    own_n = lo["own_n"][some] if len(lo["own_n"]) else np.ones(1 if not len(hi["n"]) else len(some), np.int64)
    weighted = bool(len(lo["own_n"]) or len(hi["n"]))
    width = max(1, len(hi["names"]))
    starts = np.flatnonzero(np.diff(member, prepend=-1))  # rows at which a member begins
    behind = np.concatenate([[0], np.cumsum(many)])
    row, k = 0, 0
    while row < len(member):
        # whole members: as many as have about MET meetings, one at least
        upto = np.searchsorted(behind, behind[row] + MET, "right") - 1
        next_k = max(k + 1, int(np.searchsorted(starts, upto, "right")) - 1 if upto < len(member) else len(starts))
        stop = starts[next_k] if next_k < len(starts) else len(member)
        count = many[row:stop]
        at = np.repeat(begin[row:stop] - (behind[row:stop] - behind[row]), count) + np.arange(count.sum())
        line = np.repeat(np.arange(next_k - k), np.diff(np.append(starts[k:next_k], stop)))  # of a row, its member
        cell = np.repeat(line * width, count) + hi["members"][at]
        weight = None
        if weighted:
            weight = np.repeat(own_n[row:stop], count)
            weight = weight * hi["n"][at] if len(hi["n"]) else weight
        if (next_k - k) * width <= min(CELLS, 4 * len(cell)):
            total = np.bincount(cell, weight, (next_k - k) * width)
            found = np.flatnonzero(total >= max(least, 1))
            total = total[found]
        else:
            if least > 1:  # what falls into one of 2 ** BUCKETS has its sum at most
                bucket = (cell.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BUCKETS)).astype(np.int64)
                enough = np.flatnonzero((np.bincount(bucket, weight, 1 << BUCKETS) >= least)[bucket])
                cell, weight = cell[enough], weight if weight is None else weight[enough]
            found, inverse = np.unique(cell, return_inverse=True)
            total = np.bincount(inverse.ravel(), weight, len(found))
            found, total = found[total >= least], total[total >= least]
        if len(found):
            a, b = lo["names"].take(pa.array(member[starts[k:next_k]][found // width])), hi["names"].take(pa.array(found % width))
            less = pc.less(a, b)
            yield pa.RecordBatch.from_arrays([pc.if_else(less, a, b), pc.if_else(less, b, a), pa.array(total.astype(np.int64))], ["a", "b", "shared"])
        row, k = stop, next_k


def _parted(edges: DataFrame) -> DataFrame:
    return edges.select("member", "target").filter("member is not null and target is not null").repartition(PARTS, "member").groupBy("member", "target")


def gang_paths(edges: DataFrame, least: int = 3) -> DataFrame:
    """(a, b, shared), a < b: members with at least `least` paths over a common target; edges (member, target) count as often as they occur.

    Edges are counted for each member and target before they meet, so parallel ones are never paired.
    """
    return _met(_parted(edges).agg(F.count(F.lit(1)).alias("n")), least)


def gangs(pairs: DataFrame, least: int = 3) -> DataFrame:
    """(a, b, shared), a < b: members that share at least `least` distinct targets of pairs (member, target)."""
    return _met(_parted(pairs).agg(F.first(F.lit(1).cast("long")).alias("n")), least)


def cooccurrences(df: DataFrame, key: str = "raw_id") -> DataFrame:
    """(key, src, dst) of entities (key, ordinal, value) of one text, in their order."""
    a, b = df.alias("a"), df.alias("b")
    return a.join(b, (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a.ordinal") < F.col("b.ordinal"))).select(F.col(f"a.{key}").alias(key), F.col("a.value").alias("src"), F.col("b.value").alias("dst"))


def cluster_ids(df: DataFrame, key: str, member: str) -> DataFrame:
    """(key, members, cluster): number of distinct members and the first 12 digits of the MD5 of their sorted list."""
    sets = df.groupBy(key).agg(F.array_sort(F.collect_set(F.col(member).cast("string"))).alias("_m"))
    return sets.select(key, F.size("_m").alias("members"), F.substring(F.md5(F.array_join("_m", ",")), 1, 12).alias("cluster"))
