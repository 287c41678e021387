"""Near duplicates of short posts by SimHash: classes of equal hashes, pairs between them, and the order-dependent author-aware decision."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..work import checkpointed

#: Hashes up to which a pair is looked for by so many equal blocks, of 16, 25 and 32 bits in all. Bits of texts in one language are far from
#: even, so few blocks leave many candidates: 43,808 hashes of check_s have 20.9, 6.2 and 3.5 million by one, two and three blocks.
KEY_BLOCKS = ((20_000, 1), (1_000_000, 2))
UNKNOWN = "__unknown__"
#: Authors that a note names, characters of a text that it quotes.
NAMED, QUOTED = 3, 80


def _masks(most: int, equal: int) -> list[int]:
    """Bits that a pair within `most` bits must share in full, at least one of them: any `equal` of most + equal blocks."""
    blocks = most + equal
    edges = [64 * i // blocks for i in range(blocks + 1)]
    parts = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:], strict=False)]
    masks = [sum(c) for c in combinations(parts, equal)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def similar_hashes(hashes: DataFrame, most: int = 3, column: str = "simhash", equal: int | None = None, old: DataFrame | None = None) -> DataFrame:
    """(x, y, distance), x < y: distinct hashes at most `most` bits apart, as T.hamming() counts; of `old` ones only with one of hashes.

    Of most + equal blocks of bits, such hashes have `equal` in common: an equi-join by each choice of so many. More hashes take
    more blocks, so that few meet without being near. Candidates are compared within the join.
    """
    new = hashes.select(F.col(column).alias("h"), F.lit(True).alias("new"))
    both = new if old is None else new.union(old.select(F.col(column), F.lit(False)))
    one = checkpointed(both.filter("h is not null").groupBy("h").agg(F.max("new").alias("new")))
    if equal is None:
        n = one.count()
        equal = next((k for limit, k in KEY_BLOCKS if n <= limit), 3)
    keys = F.array(*(F.col("h").bitwiseAND(F.lit(m).cast("long")) for m in _masks(most, equal)))
    cut = one.select("h", "new", F.posexplode(keys).alias("i", "key"))
    a, b = cut.filter("new").alias("a"), cut.alias("b")
    near = F.bit_count(F.col("a.h").bitwiseXOR(F.col("b.h"))) <= most
    met = a.join(b, (F.col("a.i") == F.col("b.i")) & (F.col("a.key") == F.col("b.key")) & ((F.col("a.h") < F.col("b.h")) | ~F.col("b.new")) & near)
    found = met.select(F.least("a.h", "b.h").alias("x"), F.greatest("a.h", "b.h").alias("y")).distinct()
    return found.withColumn("distance", T.hamming(F.col("x"), F.col("y")).cast("int")).filter(F.col("distance") <= most)


def classes(df: DataFrame, key: str = "id", simhash: str = "simhash", most: int = 3) -> DataFrame:
    """(key, class_id, links): for every row the least key with an equal hash, and how many other classes are within `most` bits.

    Rows of a class stand for each other, so copies are never paired. A null hash is a class without links.
    """
    rows = checkpointed(df.select(F.col(key).alias("id"), F.col(simhash).alias("h")))  # hashes are computed once
    named = rows.groupBy("h").agg(F.min("id").alias("class_id"))
    pairs = similar_hashes(named, most, "h")
    links = pairs.select(F.explode(F.array("x", "y")).alias("near")).groupBy("near").agg(F.count(F.lit(1)).alias("links"))
    told = named.join(links, named.h == links.near, "left").select(F.col("h").alias("of"), "class_id", F.coalesce("links", F.lit(0)).cast("long").alias("links"))
    return rows.join(told, F.col("h").eqNullSafe(F.col("of"))).select(F.col("id").alias(key), "class_id", "links")


def similar_pairs(df: DataFrame, key: str = "id", simhash: str = "simhash", most: int = 3) -> DataFrame:
    """(id_a, id_b, distance): pairs of near classes of equal hashes, id_a < id_b, named by their least keys, and who is in a class:

    a row at distance 0 from the class's name for each other key that it stands for. So every row with a near one or a copy is there,
    and what copies link to is what their class does.
    """
    rows = checkpointed(df.select(F.col(key).alias("id"), F.col(simhash).alias("h")))  # hashes are computed once
    named = rows.groupBy("h").agg(F.min("id").alias("id"))
    x, y = (named.select(F.col("h").alias(c), F.col("id").alias(f"id_{c}")) for c in "xy")
    met = similar_hashes(named, most, "h").join(x, "x").join(y, "y")
    of = named.select(F.col("h").alias("of"), F.col("id").alias("class_id"))
    copies = rows.join(of, F.col("h").eqNullSafe(F.col("of"))).filter("id <> class_id").select(F.col("class_id").alias("id_a"), F.col("id").alias("id_b"), F.lit(0).alias("distance"))
    return met.select(F.least("id_x", "id_y").alias("id_a"), F.greatest("id_x", "id_y").alias("id_b"), "distance").union(copies)


def effective_threshold(length: Column, most: int = 3) -> Column:
    """By the new text's length: under 30 only equal hashes, under 80 half."""
    return F.when(length < 30, 0).when(length < 80, max(1, most // 2)).otherwise(most)


def _posts(df: DataFrame, order: str, most: int, remember_noise: bool) -> DataFrame:
    """(at, h, t, a, kind): place in order, hash, threshold, author and kind of each post; at also has what a note quotes."""
    author = F.trim(F.coalesce(F.col("author").cast("string"), F.lit("")))
    noise = F.lit(False) if remember_noise else F.coalesce("is_noise", F.lit(False))
    media = F.coalesce("is_media_only", F.lit(False)) if "is_media_only" in df.columns else F.lit(False)
    text = F.coalesce("clean_text", F.lit(""))
    at = F.struct(F.col(order).alias("seq"), F.col("id").alias("id"), F.coalesce(F.left(text, F.lit(QUOTED)), F.lit("")).alias("quote"))
    kind = F.when(media, "media").when(noise, "noise").otherwise("text")
    return df.select(at.alias("at"), F.col("simhash").alias("h"), effective_threshold(F.length(text), most).alias("t"), F.when(author == "", UNKNOWN).otherwise(author).alias("a"), kind.alias("kind"))


def _settled(firsts: DataFrame, balls: DataFrame) -> DataFrame:
    """firsts with what became of each: 1 remembered, 2 a duplicate. balls: (h, t, k), hashes k that can decide about posts (h, t).

    A round settles every first post about which nothing open can decide: the hash that was remembered first within its reach is
    known, and so is whether its author is remembered under that hash. At least the earliest open one is settled in each round; how
    many rounds it takes is the longest chain of posts that each wait for the one before.
    """
    posts = checkpointed(firsts.withColumn("state", F.when(F.col("kind") == "media", 1).otherwise(0)))
    while posts.filter("state = 0").limit(1).count():
        could = posts.filter("state < 2").groupBy("h").agg(F.min(F.struct("at", "state")).alias("first")).withColumnRenamed("h", "k")
        ball = balls.join(could, "k").groupBy("h", "t").agg(F.min(F.struct("first.at", "first.state", "k")).alias("ball"))
        by_author = posts.filter("state < 2").groupBy(F.col("h").alias("m"), "a").agg(F.min(F.when(F.col("state") == 1, F.col("at"))).alias("known"), F.min(F.when(F.col("state") == 0, F.col("at"))).alias("unsure"))
        waiting = posts.filter("state = 0").join(ball, ["h", "t"]).withColumn("m", F.when((F.col("ball.state") == 1) & (F.col("ball.at") < F.col("at")), F.col("ball.k")))
        told = waiting.join(by_author, ["m", "a"], "left")
        no = lambda c: F.coalesce(c, F.lit(False))
        state = F.when(F.col("ball.at") == F.col("at"), 1).when(F.col("m").isNull(), 0).when(no(F.col("known") < F.col("at")), 2).when(no(F.col("unsure") < F.col("at")), 0).otherwise(1)
        posts = checkpointed(posts.filter("state > 0").unionByName(told.withColumn("state", state).select(*posts.columns)))
    return posts


def _decided(posts: DataFrame, most: int, remembered: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """What is said of each post (at, dup_type, similar_to, similar_note), and what is remembered then: (h, a, at)."""
    firsts = posts.filter("kind <> 'noise' and h is not null").groupBy("h", "t", "a", "kind").agg(F.min("at").alias("at"))
    old = None
    if remembered is not None:
        at = F.struct("seq", "id", F.coalesce("quote", F.lit("")).alias("quote"))
        old = remembered.select(F.col("simhash").alias("h"), F.lit(0).alias("t"), F.col("author").alias("a"), F.lit("media").alias("kind"), at.alias("at"))
    pairs = checkpointed(similar_hashes(firsts, most, "h", old=old))
    near = pairs.select(F.col("x").alias("h"), F.col("y").alias("k"), "distance").union(pairs.select("y", "x", "distance"))
    linked = near.select("h").distinct()
    if old is not None:  # only what new posts are near to, or copies of
        firsts = firsts.unionByName(old.join(linked.union(firsts.select("h")).distinct(), "h", "left_semi"))
    firsts = checkpointed(firsts)
    apart, chained = firsts.join(linked, "h", "left_anti"), firsts.join(linked, "h", "left_semi")
    of = chained.filter("kind = 'text'").select("h", "t").distinct()
    balls = checkpointed(of.join(near, "h").filter(F.col("distance") <= F.col("t")).select("h", "t", "k").union(of.select("h", "t", "h")))
    sure = _settled(chained, balls).filter("state = 1").select("h", "a", "at")
    known = checkpointed(apart.select("h", "a", "at").union(sure).groupBy("h", "a").agg(F.min("at").alias("at")))
    begun = known.groupBy("h").agg(F.min("at").alias("began"))
    decides = balls.join(begun.withColumnRenamed("h", "k"), "k").groupBy("h", "t").agg(F.min(F.struct("began", "k"))["k"].alias("m"))
    early = F.row_number().over(Window.partitionBy("h").orderBy("at"))
    named = known.filter(F.col("a") != UNKNOWN).withColumn("n", early).filter(F.col("n") <= NAMED).groupBy("h").agg(F.array_sort(F.collect_list(F.struct("at", "a"))).alias("names"))
    by_hash = begun.join(named, "h", "left").withColumnRenamed("h", "m")
    by_author = known.select(F.col("h").alias("m"), "a", F.col("at").alias("own"))
    told = posts.filter("kind = 'text'").join(decides, ["h", "t"], "left").withColumn("m", F.coalesce("m", "h")).join(by_hash, "m", "left").join(by_author, ["m", "a"], "left")
    before = lambda c: F.coalesce(F.col(c) < F.col("at"), F.lit(False))
    said = F.when(~before("began"), "new").when(before("own"), "duplicate").otherwise("similar")
    names = F.transform(F.filter(F.coalesce("names", F.array()), lambda x: x["at"] < F.col("at")), lambda x: x["a"])
    note = F.when(F.col("dup_type") == "duplicate", F.col("own.quote")).when(F.col("dup_type") == "similar", F.when(F.size(names) > 0, F.concat(F.lit("author(s): "), F.array_join(names, ", "))).otherwise("cross-author match"))
    first = F.when(F.col("dup_type") == "duplicate", F.col("own.id")).when(F.col("dup_type") == "similar", F.col("began.id"))
    told = told.withColumn("dup_type", said).select("at", "dup_type", first.alias("similar_to"), note.alias("similar_note"))
    rest = posts.filter("kind <> 'text'").select("at", F.col("kind").alias("dup_type"), F.lit(None).cast(told.schema["similar_to"].dataType).alias("similar_to"), F.lit(None).cast("string").alias("similar_note"))
    return told.unionByName(rest), known


def author_aware(df: DataFrame, order: str = "batch_seq", most: int = 3, remember_noise: bool = False) -> DataFrame:
    """df with dup_type (new, duplicate, similar, noise or media), similar_to and similar_note, by the posts before it in order.

    A post is compared with the remembered hashes, the one remembered first before the others; the first within the threshold of
    the post's own length decides: if its author is remembered under that hash it is a duplicate, else similar. New and similar
    posts are remembered under their own hash, media posts always, noise only if remember_noise. similar_to is the post remembered
    first, of the author if it is a duplicate; similar_note names up to three authors, or quotes the text's beginning.

    df: id, order, simhash, clean_text, author, is_noise, and is_media_only if there is one; other columns are kept. Posts of equal
    order go by id; rows that repeat both are decided alike. A blank author counts as one unknown author. A post without a hash is
    new and not remembered.

    No group of posts meets in one task. Only the first post of each (hash, threshold, author) can change what is remembered: if it
    is a duplicate, the later ones are. A hash without near ones is decided by its own firsts; the others are settled in rounds.
    """
    return decided(df, order, most, remember_noise)[0]


def decided(df: DataFrame, order: str = "batch_seq", most: int = 3, remember_noise: bool = False, remembered: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """author_aware() of df, and what it adds to what is remembered: (simhash, author, seq, id, quote), one row a hash and author.

    remembered: such rows of posts before all of df.
    """
    told, known = _decided(checkpointed(_posts(df, order, most, remember_noise)), most, remembered)
    told = told.select(F.col("at.seq").alias("_seq"), F.col("at.id").alias("_id"), "dup_type", "similar_to", "similar_note").dropDuplicates(["_seq", "_id"])
    out = df.join(told, F.col("id").eqNullSafe(F.col("_id")) & F.col(order).eqNullSafe(F.col("_seq")), "left").drop("_seq", "_id")
    added = known.select(F.col("h").alias("simhash"), F.col("a").alias("author"), "at.*")
    if remembered is not None:
        added = added.join(remembered.select("simhash", "author"), ["simhash", "author"], "left_anti")
    return out, added
