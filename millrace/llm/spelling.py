"""Spelling variants: words one edit apart, found by a positional q-gram inverted index with a count filter.

A word of L code points, padded, has L + Q - 1 grams of Q code points. One edit changes Q of them at most, so of two words that are one
edit apart, the longer one with L code points, L - 1 grams at least are in both, at the same place or one further on behind a letter
put in. The index is dealt to tasks by posting lists: of a word, those of its Q + 1 rarest grams, one of which must be shared. In each
list, an index over all grams of its words finds for a word the lists of its own grams at the places allowed, merges the short ones
with a heap, looks candidates up in the long ones, and keeps those in L - 1 lists; these are then compared letter by letter.
"""

from __future__ import annotations

import heapq
import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import batched, compress, count, groupby
from operator import ne

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, freeing, text_of
from .filters import bitset, has

Q = 4
#: Buckets of the sketch that says how frequent a gram is. It only orders grams, so any size gives the same pairs.
BUCKETS = 1 << 16
#: Words in a posting list up to which a task indexes them. Those of longer lists are found by what is left of them without one letter.
MOST = 4096
#: Code points up to which words have grams. Of longer ones, all but one of PARTS parts must be equal.
LONG, PARTS = 64, 8
#: Code points of a text that are read together, and words that a task counts before it hands them on.
SLICE, HELD = 1 << 20, 200_000
LETTERS = "[A-Za-zÀ-ÿ]"
NO_LETTER = re.compile("[^A-Za-zÀ-ÿ]")
LOWER = {c: c + 32 for c in range(65, 91)}
FRONT, BACK = "\x02" * (Q - 1), "\x03" * (Q - 1)


@lru_cache
def _run(least: int) -> re.Pattern:
    return re.compile(f"{LETTERS}{{{least},}}")


def runs(text: str, least: int = 1) -> Counter:
    """The text's runs of at least so many letters, A-Z in lower case, and how often each is there."""
    raw, at, run = Counter(), 0, _run(least)
    while at < len(text):
        gap = NO_LETTER.search(text, at + SLICE)  # a slice ends behind a run
        end = gap.start() if gap else len(text)
        raw.update(run.findall(text, at, end))
        at = end
    out: Counter = Counter()
    for word, n in raw.items():
        out[word if word.islower() else word.translate(LOWER)] += n
    return out


def misspelt(text: str, doc_id: str, least: int = 1) -> Iterator[tuple[str, int]]:
    """The text's runs and how often; of those whose crc32(doc_id:run) 31 divides, one code point is gone."""
    before = zlib.crc32(f"{doc_id}:".encode())
    for run, n in runs(text, least).items():
        h = zlib.crc32(run.encode(), before)
        if h % 31 == 0:
            k = h % len(run)
            run = run[:k] + run[k + 1 :]
        yield run, n


def vocabulary(docs: DataFrame, text: str = "text", doc_id: str | None = None, least_length: int = 7, least_n: int = 2) -> DataFrame:
    """(word, n): the words of all texts with so many code points that are there so often. With doc_id, the misspelt ones of misspelt().

    A null text has no words, a null doc_id counts as empty. Tasks add up what they read before it is dealt, so a word that very many
    texts have is a row a task.
    """

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for batch in stream:
            for i, x in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                said = x.as_py()
                for word, n in runs(said, least_length).items() if i is None else misspelt(said, i, least_length):
                    if len(word) >= least_length:
                        held[word] += n
                if len(held) > HELD:
                    yield out()
                    held.clear()
        if held:
            yield out()

    named = F.lit(None).cast("string") if doc_id is None else F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    counted = docs.select(named.alias("doc_id"), text_of(text).alias("text")).mapInArrow(freeing(run), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_n)


def grams(word: str) -> list[str]:
    padded = FRONT + word + BACK
    return [padded[k : k + Q] for k in range(len(word) + Q - 1)]


def _hash(text: str) -> int:
    """64 bits, the same everywhere; the last 16 are free for a place and a length."""
    return (xxhash.xxh3_64_intdigest(text.encode()) - (1 << 63)) & ~0xFFFF


def gram_counts(words: DataFrame) -> np.ndarray:
    """How many of the words' grams fall into each of BUCKETS buckets: half a megabyte, whatever the number of words."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, np.int64)
        for batch in stream:
            for word in batch.column("word").to_pylist():
                if len(word) <= LONG:
                    for g in grams(word):
                        counts[zlib.crc32(g.encode()) % BUCKETS] += 1
        at = counts.nonzero()[0]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["bucket", "n"])

    out = np.zeros(BUCKETS, np.int64)
    found = words.select("word").mapInArrow(freeing(run), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return out


class Lists:
    """The posting lists that words are in, by how frequent grams are."""

    def __init__(self, counts: np.ndarray):
        self.counts, self.known = counts.tolist(), {}

    def _gram(self, gram: str) -> tuple[int, str, int]:
        if len(self.known) > HELD:
            self.known.clear()
        found = self.known[gram] = (self.counts[zlib.crc32(gram.encode()) % BUCKETS], gram, _hash(gram))
        return found

    def of(self, word: str) -> Iterator[tuple[int, bool]]:
        """The names of a word's lists, and whether it only visits: those of words longer by one, where it looks for partners.

        A list is named by a gram, its place and its words' length. Of two words that differ in length, the shorter one has its
        gram at the same place or one before; one with padding can only be at the same place from that end. Lists of words longer
        than LONG are named by what is left without one of PARTS parts, which the shorter word of a pair cuts.
        """
        size, known = len(word), self.known
        if size <= LONG:
            rare = sorted(((known.get(g) or self._gram(g)), p) for p, g in enumerate(grams(word)))[: Q + 1]
            for (_, _, name), p in rare:
                yield name | p << 8 | size, False
            if size < LONG:
                # a letter put in spoils Q - 1 grams of the shorter word, so one of Q is left
                for (_, _, name), p in rare[:Q]:
                    if p < size:
                        yield name | p << 8 | size + 1, True
                    if p >= Q - 1:
                        yield name | p + 1 << 8 | size + 1, True
        for length, visits in ((size, False), (size + 1, True)):
            if length > LONG:
                for short in (length - 1,) if visits else (length - 1, length):
                    width = -(-short // PARTS)
                    for k in range(0, short, width):
                        behind = max(0, short - k - width)
                        yield _hash(f"{length} {short} {k} {xxhash.xxh3_64_intdigest(word[:k].encode())} {xxhash.xxh3_64_intdigest(word[size - behind :].encode())}"), visits


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one code point put in, taken out or replaced makes a into b."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next(compress(count(), map(ne, a, b)), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def in_enough(postings: list[list[int]], enough: int) -> Iterator[int]:
    """The numbers that are in `enough` of the ascending lists: a heap merges the short lists, the longest are looked up."""
    if len(postings) < enough:
        return
    postings.sort(key=len)
    short, long = postings[: len(postings) - enough + 1], postings[len(postings) - enough + 1 :]
    for at, same in groupby(heapq.merge(*short) if len(short) > 1 else short[0]):
        have = sum(1 for _ in same) if len(short) > 1 else 1
        spare = have + len(long) - enough
        for one in long:
            i = bisect_left(one, at)
            if i == len(one) or one[i] != at:
                spare -= 1
                if spare < 0:
                    break
        else:
            yield at


def near_in_list(words: list[str], visitors: list[str]) -> Iterator[tuple[int, int, bool]]:
    """Of a posting list: (i, j, False) for words i > j one edit apart, (i, j, True) for visitor i and word j."""
    if not words or len(words) + len(visitors) < 2:
        return
    size = len(words[0])
    if size > LONG:
        for i, word in enumerate(words):
            yield from ((i, j, False) for j in range(i) if one_edit(word, words[j]))
        for i, word in enumerate(visitors):
            yield from ((i, j, True) for j in range(len(words)) if one_edit(word, words[j]))
        return
    index: list[dict[str, list[int]]] = [{} for _ in range(size + Q)]
    behind, enough = index[1:], size - 1
    for i, word in enumerate(words):
        own = grams(word)
        if i:
            found = [x for x in map(dict.get, index, own) if x]
            if len(found) >= enough:
                yield from ((i, j, False) for j in in_enough(found, enough) if one_edit(word, words[j]))
        for at, g in zip(index, own, strict=False):
            if g in at:
                at[g].append(i)
            else:
                at[g] = [i]
    for i, word in enumerate(visitors):
        own = grams(word)
        found = [(x or y) if not (x and y) else sorted({*x, *y}) for x, y in zip(map(dict.get, index, own), map(dict.get, behind, own), strict=False) if x or y]
        if len(found) >= enough:
            yield from ((i, j, True) for j in in_enough(found, enough) if one_edit(word, words[j]))


_PAIR = "a string, a_n long, b string, b_n long"


def _pairs_of(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["a", "a_n", "b", "b_n"])


def _by_key(stream: Iterator[pa.RecordBatch], find) -> Iterator[pa.RecordBatch]:
    """Hands the rows of each key, which come together, to find(rows), and yields the pairs (a, a_n, b, b_n) that it gives."""

    def rows():
        for batch in stream:
            yield from zip(*(batch.column(c).to_pylist() for c in ("key", "word", "n", "visits")), strict=True)

    out = []
    for _, same in groupby(rows(), key=lambda r: r[0]):
        out.extend(find(list(same)))
        if len(out) > 20_000:
            yield _pairs_of(out)
            out = []
    if out:
        yield _pairs_of(out)


def _indexed(rows: list[tuple]) -> Iterator[tuple]:
    own, visitors = [r for r in rows if not r[3]], [r for r in rows if r[3]]
    for i, j, visits in near_in_list([r[1] for r in own], [r[1] for r in visitors]):
        x, y = (visitors if visits else own)[i], own[j]
        yield x[1], x[2], y[1], y[2]


def _left_over(rows: list[tuple]) -> Iterator[tuple]:
    """Of words that are alike without one letter, or of which one is the others without a letter: those one edit apart."""
    words = list(dict.fromkeys((r[1], r[2]) for r in rows))
    for i, (a, n) in enumerate(words):
        yield from ((a, n, b, m) for b, m in words[:i] if one_edit(a, b))


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n): each pair of the words (word, n) that are one edit apart, both ways.

    A posting list of over MOST words, which a large vocabulary over few letters may give, isn't indexed in one task: its words are
    dealt by what they leave without one letter. No such group has more words than letters fit into the places of one word.
    """
    counts = gram_counts(words)

    def deal(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = Lists(counts)
        for batch in stream:
            out, size = [], 0
            for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist(), strict=True):
                for key, visits in lists.of(word):
                    out.append((key, word, n, visits))
                    size += len(word) + 20
                if size > 4 << 20:
                    yield _listed(out)
                    out, size = [], 0
            if out:
                yield _listed(out)

    def variants(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist(), strict=True):
                left = {word, *(word[:k] + word[k + 1 :] for k in range(len(word)))}
                yield _listed([(_hash(x), word, n, False) for x in left])

    schema = "key long, word string, n long, visits boolean"
    def keys(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = Lists(counts)
        for batch in stream:
            for some in batched((key for word in batch.column("word").to_pylist() for key, _ in lists.of(word)), HELD):
                key, n = np.unique(np.array(some, np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], ["key", "n"])

    dealt = words.select("word", "n").mapInArrow(freeing(deal), schema)
    listed = words.select("word").mapInArrow(freeing(keys), "key long, n long")
    crowded = checkpointed(listed.groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") > MOST).select("key"))
    n = crowded.count()
    pairs = []
    if n:
        bits = bitset(crowded, n)  # of bounded size; lists that it takes for crowded ones are only found another way

        def part(crowd: bool):
            def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in stream:
                    yield batch.filter(pa.array(has(bits, batch.column("key").to_numpy().view(np.uint64)) == crowd))

            return dealt.mapInArrow(freeing(run), schema)

        left = part(True).select("word", "n").distinct().mapInArrow(freeing(variants), schema)
        pairs.append(left.repartition("key").sortWithinPartitions("key").mapInArrow(freeing(lambda s: _by_key(s, _left_over)), _PAIR))
        dealt = part(False)
    pairs.append(dealt.repartition("key").sortWithinPartitions("key").mapInArrow(freeing(lambda s: _by_key(s, _indexed)), _PAIR))
    found = pairs[0] if len(pairs) == 1 else pairs[0].union(pairs[1])
    one, other = F.struct(F.col("a").alias("word"), F.col("a_n").alias("n")), F.struct(F.col("b").alias("word"), F.col("b_n").alias("n"))
    # found in several lists, and then said both ways
    found = found.select(F.least(one, other).alias("x"), F.greatest(one, other).alias("y")).distinct()
    ways = F.explode(F.array(F.struct("x", "y"), F.struct(F.col("y").alias("x"), F.col("x").alias("y"))))
    return found.select(ways.alias("p")).select(F.col("p.x.word").alias("word"), F.col("p.x.n").alias("n"), F.col("p.y.word").alias("near"), F.col("p.y.n").alias("near_n"))


def _listed(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["key", "word", "n", "visits"])


def variants(words: DataFrame, times: int = 10) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for each of the words (word, n), which are distinct.

    A word's form is the most frequent word one edit away, of equally frequent ones the first in the order of code points, if it
    is there `times` as often; root is where following forms ends, the word itself if it has none. Each form is `times` as frequent
    as the word, so chains are short; a round of joins halves them.
    """
    words = checkpointed(words.select("word", "n"))
    best = near_pairs(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    told = words.join(best, "word", "left")
    fits = -F.col("best.less") >= times * F.col("n")
    told = checkpointed(told.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("best.near")).alias("form"), F.when(fits, -F.col("best.less")).alias("form_n")))
    links, going = checkpointed(told.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))), True
    while going:
        on = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        links = checkpointed(links.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        going = links.filter("moved").limit(1).count() > 0
        links = links.select("word", "root")
    return told.join(links, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
