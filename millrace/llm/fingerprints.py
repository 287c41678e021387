"""Document fingerprints by Order MinHash, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import NULL_ID, checkpointed, text_of

#: Words of a k-mer, elements of a signature, k-mers of an element's tuple.
K, BINS, TUPLE = 5, 64, 2
#: A letter is a run of at most 24 code points without white space; of scripts without spaces, a code point.
LETTERS = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}]|[^\s\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}]{1,24}"

#: The bits of an item that hold a k-mer's place in its text, enough for any array; those above hold the hash.
PLACE = (1 << 31) - 1
#: Parts that the rows without a doc_id are dealt to.
SALTS = 256


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def at(a: Column, i: Column | int) -> Column:
    """Element of an array, from 0."""
    return F.get(a, i if isinstance(i, Column) else F.lit(i))


def fingerprint(text: Column, k: int = K, bins: int = BINS, width: int = TUPLE) -> Column:
    """The text's Order MinHash signature: an array of longs, each `bin << 32 | 32 bits`, at most one for each bin, in their order.

    The text's k-mers of words are numbered by occurrence, so that a repeated one counts as often as it occurs. A hash of
    (k-mer, number) gives each its bin (its first bits) and its rank there. Of each bin the `width` least are selected; put back
    into text order, the hash of that tuple of k-mers is the bin's element. Equal texts have equal signatures; a moved passage
    changes the order in tuples, which plain MinHash does not see. A text of fewer than k words is one k-mer, one without any
    word has an empty signature. bins is a power of 2.
    """
    top = bins.bit_length() - 1

    def from_kmers(kmers: Column) -> Column:
        place = lambda x: x.bitwiseAND(F.lit(PLACE)).cast("int")
        marked = lambda x, i: x.bitwiseAND(F.lit(~PLACE)).bitwiseOR(i.cast("long"))

        def numbered() -> Column:
            once = F.transform(kmers, lambda x, i: marked(F.xxhash64(x, F.lit(0)), i))

            def runs(s: Column) -> Column:
                kmer = lambda j: at(kmers, place(at(s, j)))
                first = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda j: (j == 0) | (kmer(j) != kmer(j - 1)))
                of_run = lambda a, b: F.transform(F.sequence(a, b - 1), lambda j: marked(F.xxhash64(kmer(j), j - a), place(at(s, j))))
                return let(first, lambda f: F.flatten(F.zip_with(f, F.concat(F.slice(f, 2, F.size(f)), F.array(F.size(s))), of_run)))

            repeats = let(F.sort_array(F.transform(kmers, marked)), runs)
            return F.when(F.size(F.array_distinct(kmers)) == F.size(kmers), once).otherwise(repeats)

        def select(items: Column) -> Column:
            bin_of = lambda x: F.call_function("shiftright", x, F.lit(64 - top))

            def elements(least: Column) -> Column:
                first = F.filter(F.sequence(F.lit(0), F.size(least) - 1), lambda j: (j == 0) | (bin_of(at(least, j)) != bin_of(at(least, j - 1))))
                mine = lambda j: F.filter(F.slice(least, j + 1, F.lit(width)), lambda x: bin_of(x) == bin_of(at(least, j)))
                ordered = lambda j: F.transform(F.sort_array(F.transform(mine(j), place)), lambda p: at(kmers, p))
                return F.transform(first, lambda j: F.call_function("shiftleft", bin_of(at(least, j)) + bins // 2, F.lit(32)).bitwiseOR(F.xxhash64(ordered(j)).bitwiseAND(F.lit(0xFFFFFFFF))))

            chosen = lambda s: F.filter(s, lambda x, j: (j < width) | (bin_of(x) != bin_of(at(s, j - width))))
            return let(F.sort_array(items), lambda s: let(chosen(s), elements))

        return select(numbered())

    def from_letters(hashes: Column) -> Column:
        kmer = lambda i: F.xxhash64(*[at(hashes, i + j) for j in range(k)])
        kmers = F.when(F.size(hashes) < k, F.array(F.xxhash64(hashes))).otherwise(F.transform(F.sequence(F.lit(0), F.size(hashes) - k), kmer))
        return F.when(F.size(hashes) == 0, F.expr("cast(array() as array<bigint>)")).otherwise(let(kmers, from_kmers))

    return let(F.transform(F.regexp_extract_all(text, F.lit(LETTERS), F.lit(0)), lambda t: F.xxhash64(t)), from_letters)


def likeness(a: Column, b: Column) -> Column:
    """Share of equal elements among the bins that either signature has; 1 for two empty ones."""
    bins = F.size(F.array_union(F.transform(a, lambda x: F.call_function("shiftright", x, F.lit(32))), F.transform(b, lambda x: F.call_function("shiftright", x, F.lit(32)))))
    return F.when(bins == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / bins)


def written(signature: Column) -> Column:
    """A signature as a string: ten hexadecimal digits an element."""
    return F.array_join(F.transform(signature, lambda x: F.lpad(F.lower(F.hex(x)), 10, "0")), "")


def neighbours(ids: DataFrame) -> DataFrame:
    """ids, a table (key, n, ...) without repeats, with before and before_n: the next higher key and its n; the highest has the lowest.

    Keys are sorted by ranges; a key's neighbour is in its range, or it is the last of the range before, of which there are as many
    as partitions.
    """
    ranged = checkpointed(ids.repartitionByRange(F.desc("key")).withColumn("_range", F.spark_partition_id()))
    ends = ranged.groupBy("_range").agg(F.min(F.struct("key", "n")).alias("last"))
    order, everything = Window.orderBy("_range"), Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select("_range", F.coalesce(F.lag("last").over(order), F.last("last").over(everything)).alias("_end"))
    inside = Window.partitionBy("_range").orderBy(F.desc("key"))
    found = ranged.withColumn("_own", F.lag(F.struct("key", "n")).over(inside)).join(F.broadcast(ends), "_range").withColumn("_before", F.coalesce("_own", "_end"))
    return found.select(*(c for c in ids.columns if c != "n"), F.col("_before.key").alias("before"), F.col("_before.n").alias("before_n"))


def with_next(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, text, signature, next_text, next_signature): each row with the next document in descending doc_id.

    next_text is the next text's first floor(n / 2) code points, n being those of the row's text. After the last comes the first,
    so a single document is its own next. Null texts count as empty; a null doc_id comes last. Of rows with the same doc_id each
    has the next lower doc_id's document as next, which is the least of its texts if it has several. Rows without a doc_id, however
    many, are dealt by their text to SALTS parts; the next that they are is the least text of the first part that has any.

    A text is shuffled once, by doc_id, and its half once more, to the document before: the first shuffle serves both sides.
    """
    base = df.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NULL_ID)).alias("key"), F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text"))
    base = base.withColumn("salt", F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("text"), F.lit(SALTS))).otherwise(0))
    edges = neighbours(base.groupBy("key").agg(F.max(F.length("text")).alias("n"), F.min("salt").alias("salt")))
    base = base.withColumn("signature", fingerprint(F.col("text")))
    one = Window.partitionBy("key", "salt").orderBy("text", "doc_id", "signature")
    # a lag, not a rank: before a filter on ranks Spark would sort the texts on the map side too, and shuffle them twice
    heads = base.withColumn("_later", F.lag(F.lit(True)).over(one)).filter("_later is null").join(edges, ["key", "salt"])
    parts = F.when(F.col("before") == NULL_ID, F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    heads = heads.select(F.col("before").alias("key"), F.expr("left(text, cast(before_n / 2 as int))").alias("_head"), F.col("signature").alias("next_signature"), F.explode(parts).alias("salt"))
    joined = base.join(heads, ["key", "salt"])
    return joined.select("doc_id", "text", "signature", F.expr("left(_head, cast(length(text) / 2 as int))").alias("next_text"), "next_signature")


def half_edited(text: Column, next_text: Column) -> Column:
    """The text with its last floor(n / 2) code points replaced."""
    n = F.length(text)
    return F.concat(F.left(text, n - F.floor(n / 2)), next_text)
