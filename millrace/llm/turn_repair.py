"""Conversations brought into the form (system? (user assistant)+)? by the cheapest edits, in a fold of Spark's higher-order functions.

The fold carries four (cost, audit) structs, one for each state of the form: nothing yet, after the system's turn, after a user's, after
an assistant's. An audit spells the edits: K keeps a turn, R gives it the role that comes next, D deletes it, I puts an empty turn in.

Conversations of any length: rows are dealt by ranges of (conversation, turn) and cut into blocks of about BLOCK_ROWS rows. Nearly all
conversations are one block, folded from the first state. Of one that is split, every block is folded from each state; levels of FAN
blocks then join what their blocks say, and from the top down every block learns the states it begins and ends in.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

DELETE, REROLE, INSERT, TRUNCATED = 4, 3, 3, 3
#: A block ends after so many rows, or after rows that count as many: each 8 KB of text count as one more.
BLOCK_ROWS, ROW_BYTES = 512, 8192
#: Blocks that one of the next level joins.
FAN = 32
#: More than any cost: what can't be reached.
NEVER = 10**15
STATES = 4
SOLID = r"[^\x20\x09-\x0D]"
_STEP = "struct<c:bigint,a:string>"
_FOUR = f"struct<s0:{_STEP},s1:{_STEP},s2:{_STEP},s3:{_STEP}>"


def _let(value: Column, use) -> Column:
    """use(value), with the value worked out once."""
    return F.transform(F.array(value), use)[0]


def _go(s: Column, cost, op) -> Column:
    return F.struct((s["c"] + cost).alias("c"), F.concat(s["a"], op).alias("a"))


def _four(*states: Column) -> Column:
    return F.struct(*(s.alias(f"s{k}") for k, s in enumerate(states)))


def _inserting(acc: Column) -> Column:
    """The states with turns put in where that is cheaper: two at most, as a third comes back to where the first led."""
    user = _let(acc, lambda m: F.struct(m["s0"].alias("s0"), m["s1"].alias("s1"), F.least(m["s2"], _go(F.least(m["s0"], m["s1"], m["s3"]), INSERT, F.lit("I"))).alias("s2"), m["s3"].alias("s3")))
    return _let(user, lambda m: _four(m["s0"], m["s1"], m["s2"], F.least(m["s3"], _go(m["s2"], INSERT, F.lit("I")))))


def _after(acc: Column, t: Column) -> Column:
    """The states after one more turn, whose costs t has: of keeping it as the system's, and of making it a user's or an assistant's."""
    return _let(
        _inserting(acc),
        lambda m: _four(
            _go(m["s0"], DELETE, F.lit("D")),
            F.least(_go(m["s1"], DELETE, F.lit("D")), _go(m["s0"], t["system"], F.lit("K"))),
            F.least(_go(m["s2"], DELETE, F.lit("D")), _go(F.least(m["s0"], m["s1"], m["s3"]), t["user"], t["user_op"])),
            F.least(_go(m["s3"], DELETE, F.lit("D")), _go(m["s2"], t["assistant"], t["assistant_op"])),
        ),
    )


def _from(start: Column) -> Column:
    """The states before any turn, if the first one begins in state `start`."""
    return _four(*(F.struct(F.when(start == k, F.lit(0)).otherwise(F.lit(NEVER)).cast("long").alias("c"), F.lit("").alias("a")) for k in range(STATES))).cast(_FOUR)


def _folded(turns: Column, starts: Column) -> Column:
    return F.transform(starts, lambda s: F.aggregate(turns, _from(s), lambda acc, t: _after(acc, t).cast(_FOUR)))


def _ended(four: Column) -> Column:
    """(c, a, e): the cheapest whole way, and the state e that it is in before the turns put in at the end."""
    s = [F.struct(four[f"s{k}"]["c"].alias("c"), four[f"s{k}"]["a"].alias("a"), F.lit(k).alias("e")) for k in range(STATES)]

    def more(x: Column, n: int) -> Column:
        return F.struct((x["c"] + n * INSERT).alias("c"), F.concat(x["a"], F.lit("I" * n)).alias("a"), x["e"].alias("e"))

    return F.least(s[0], more(s[0], 2), more(s[1], 2), more(s[2], 1), s[3])


def _lines(turns: Column, audit: Column, start: Column) -> Column:
    """The turns that the audit leaves, as an array of (role, text)."""
    kind = "struct<i:int,s:int,lines:array<struct<role:string,text:string>>>"
    ops = F.filter(F.split(audit, ""), lambda op: op != "")

    def apply(acc: Column, op: Column) -> Column:
        turn = F.get(turns, acc["i"])
        first = F.substring(turn["role"], 1, 1)
        role = F.when(op == "K", turn["role"]).otherwise(F.when(acc["s"] == 2, "assistant").otherwise("user"))
        state = F.when((op == "K") & (first == "s"), 1).otherwise(F.when(acc["s"] == 2, 3).otherwise(2))
        line = F.struct(role.alias("role"), F.when(op == "I", "").otherwise(turn["text"]).alias("text"))
        gone = F.struct((acc["i"] + 1).alias("i"), acc["s"].alias("s"), acc["lines"].alias("lines"))
        kept = F.struct((acc["i"] + F.when(op == "I", 0).otherwise(1)).alias("i"), state.alias("s"), F.array_append(acc["lines"], line).alias("lines"))
        return F.when(op == "D", gone).otherwise(kept).cast(kind)

    begin = F.struct(F.lit(0).alias("i"), start.cast("int").alias("s"), F.array().cast("array<struct<role:string,text:string>>").alias("lines")).cast(kind)
    return F.aggregate(ops, begin, apply)["lines"]


def _placed(rows: DataFrame, conv: str, turn: str, role: str, text: str, gone: Column | None) -> DataFrame:
    """Rows in order, in blocks, with what one look at each and at its block tells."""
    tight = rows.select(
        F.col(conv).alias("conv"),
        F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text), F.lit(" ")).alias("text"),
        (F.lit(False) if gone is None else F.coalesce(gone, F.lit(False))).alias("gone"),
    )
    tight = tight.withColumn("same", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    # rows that are alike in everything may stand in any order: the last key only keeps them from meeting in one task
    tight = tight.withColumns({"r1": F.substring("role", 1, 32), "t1": F.substring("text", 1, 32), "any": F.monotonically_increasing_id()})
    order = ["conv", "turn", "r1", "t1", "same", "any"]
    ranged = tight.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    rows = checkpointed(ranged.drop("r1", "t1", "any").withColumns({"range": F.shiftright("at", 33).cast("int"), "local": F.col("at").bitwiseAND(F.lit((1 << 33) - 1))}))
    inside = Window.partitionBy("conv", "range")
    weight = F.lit(1) + (F.octet_length("text") + F.octet_length("role")) / ROW_BYTES
    before = F.coalesce(F.sum(weight).over(inside.orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("block", F.floor(before / BLOCK_ROWS).cast("int"))
    # a conversation in two ranges is the first one of the later: there are no more of these than ranges
    opens = rows.filter("local = 0").select(F.col("conv").alias("open")).distinct()
    rows = rows.join(F.broadcast(opens.withColumn("opened", F.lit(True))), F.col("conv").eqNullSafe(F.col("open")), "left").withColumn("opened", F.coalesce("opened", F.lit(False))).drop("open")
    rows = rows.withColumn("split", F.col("opened") | (F.max("block").over(inside) > 0))
    blank = ~F.rlike("text", F.lit(SOLID))
    first = F.row_number().over(Window.partitionBy("conv", "range", "block", "same", "gone").orderBy("at")) == 1
    cut = ~F.rlike("text", F.lit(r"[.!?][\x20\x09-\x0D]*\z"))
    return rows.withColumns({"blank": blank & ~F.col("gone"), "first": first, "cut": cut})


def _once(rows: DataFrame) -> DataFrame:
    """`first` said of whole conversations that are split: only the first of each block's firsts is one.

    The rows that are not first in their block are dealt by block, so a turn that is said over and over meets itself once a block.
    """
    apart = F.when(F.col("first"), F.lit(-1)).otherwise(F.col("block"))
    w = Window.partitionBy("conv", "same", "gone", "first", apart, F.when(~F.col("first"), F.col("range"))).orderBy("at")
    return rows.withColumn("first", F.col("first") & (F.row_number().over(w) == 1))


def _blocks(rows: DataFrame) -> DataFrame:
    """A row for each block: its turns in order, and what the rows' faults, roles and turn numbers add up to."""
    repeated = ~F.col("blank") & ~F.col("first")
    bad, cut = F.col("blank") | repeated, F.col("cut")
    initial, more = F.substring("role", 1, 1), F.when(cut, TRUNCATED).otherwise(0)
    to = {r: F.when(bad, F.lit(NEVER)).otherwise(more + F.when(initial == r[0], 0).otherwise(REROLE)).cast("long").alias(r) for r in ("user", "assistant")}
    op = {f"{r}_op": F.when(initial == r[0], "K").otherwise("R").alias(f"{r}_op") for r in ("user", "assistant")}
    keep = F.when(bad | (initial != "s"), F.lit(NEVER)).otherwise(more).cast("long").alias("system")
    turn = F.struct("at", initial.alias("initial"), keep, to["user"], op["user_op"], to["assistant"], op["assistant_op"], "turn", "role", "text")
    there = ~F.col("gone")

    def count(c: Column) -> Column:
        return F.count_if(there & c)

    grouped = rows.groupBy("conv", "range", "block", "split").agg(
        F.array_sort(F.collect_list(F.when(there, turn))).alias("turns"),
        count(F.col("blank")).alias("blank"), count(repeated).alias("duplicate"), count(~bad & cut).alias("truncated"),
    )
    n = F.size("turns")
    pairs = F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.struct(F.get("turns", i - 1).alias("a"), F.get("turns", i).alias("b")))).otherwise(F.array())
    illegal = F.size(F.filter(pairs, lambda p: ~F.concat(p["a"]["initial"], p["b"]["initial"]).isin("su", "ua", "au")))
    numbered = F.filter("turns", lambda t: t["turn"].isNotNull())
    ends = [F.get("turns", F.lit(0)), F.get("turns", n - 1)]
    return grouped.withColumns({
        "illegal": illegal.cast("long"),
        "distinct": F.size(F.array_distinct(F.transform(numbered, lambda t: t["turn"]))).cast("long"),
        # the turns' numbers rise
        "low": F.get(numbered, F.lit(0))["turn"], "high": F.get(numbered, F.size(numbered) - 1)["turn"],
        "head": ends[0]["initial"], "tail": ends[1]["initial"],
    })


_SUMS = ("blank", "duplicate", "truncated", "illegal", "distinct")


def _joined(children: DataFrame, up: dict) -> DataFrame:
    """The next level: `up` gives range and block of the level above; a row has its children in order and the ways through them."""
    one = F.struct(F.col("range").alias("r"), F.col("block").alias("b"), *_SUMS, "low", "high", "head", "tail", "ways")
    grouped = children.groupBy("conv", *(c.alias(f"up_{n}") for n, c in up.items())).agg(F.array_sort(F.collect_list(one)).alias("kids"))
    kind = f"struct<{','.join(f'{c}:bigint' for c in _SUMS)},low:bigint,high:bigint,head:string,tail:string>"

    def add(x: Column, y: Column) -> Column:
        bad = x["tail"].isNotNull() & y["head"].isNotNull() & ~F.concat(x["tail"], y["head"]).isin("su", "ua", "au")
        twice = F.coalesce(x["high"] == y["low"], F.lit(False))
        extra = {"illegal": bad.cast("long"), "distinct": -twice.cast("long")}
        sums = [(x[c] + y[c] + extra.get(c, F.lit(0))).alias(c) for c in _SUMS]
        return F.struct(*sums, F.coalesce(x["low"], y["low"]).alias("low"), F.coalesce(y["high"], x["high"]).alias("high"), F.coalesce(x["head"], y["head"]).alias("head"), F.coalesce(y["tail"], x["tail"]).alias("tail")).cast(kind)

    nothing = F.struct(*(F.lit(0).cast("long").alias(c) for c in _SUMS), F.lit(None).cast("long").alias("low"), F.lit(None).cast("long").alias("high"), F.lit(None).cast("string").alias("head"), F.lit(None).cast("string").alias("tail")).cast(kind)
    step = "struct<c:bigint,a:string,p:string>"
    four = f"struct<{','.join(f's{k}:{step}' for k in range(STATES))}>"

    def through(acc: Column, kid: Column) -> Column:
        """The ways to each state by way of each state before the child, whose number the path p notes."""

        def way(k: int, e: int) -> Column:
            a, b = acc[f"s{k}"], kid["ways"][k][f"s{e}"]
            return F.struct(F.least(a["c"] + b["c"], F.lit(NEVER)).alias("c"), F.concat(a["a"], b["a"]).alias("a"), F.concat(a["p"], F.lit(str(k))).alias("p"))

        return _four(*(F.least(*(way(k, e) for k in range(STATES))) for e in range(STATES))).cast(four)

    def begin(s: int) -> Column:
        return _four(*(F.struct(F.lit(0 if k == s else NEVER).cast("long").alias("c"), F.lit("").alias("a"), F.lit("").alias("p")) for k in range(STATES))).cast(four)

    full = [F.aggregate("kids", begin(s), through) for s in range(STATES)]
    out = grouped.select("conv", *(F.col(f"up_{n}").alias(n) for n in up), F.aggregate("kids", nothing, add).alias("sums"), F.array(*full).alias("full"), F.transform("kids", lambda k: F.struct(k["r"].alias("r"), k["b"].alias("b"))).alias("kids"))
    ways = F.transform("full", lambda f: _four(*(F.struct(f[f"s{k}"]["c"].alias("c"), f[f"s{k}"]["a"].alias("a")) for k in range(STATES))))
    paths = F.transform("full", lambda f: F.array(*(f[f"s{k}"]["p"] for k in range(STATES))))
    return out.select("conv", *up, "sums.*", ways.alias("ways"), paths.alias("paths"), "kids")


_WHOLE = ("conv", "blank", "duplicate", "truncated", "illegal", "distinct", "low", "high", "cost", "audit")


def _split(rows: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """Conversations in several blocks: (what is found of each, the lines of each block in order), or None if there are none."""
    leaves = checkpointed(_blocks(_once(rows)).withColumn("ways", _folded(F.col("turns"), F.array(*map(F.lit, range(STATES))))))
    levels, level = [], leaves
    while True:
        most = level.agg(F.max("range"), F.max("block")).first()
        if most[0] is None:
            return None
        if levels and most[0] == 0 and most[1] == 0:
            break
        inside = most[1] > 0
        up = {"range": F.col("range") if inside else F.floor(F.col("range") / FAN).cast("int"), "block": F.floor(F.col("block") / FAN).cast("int")}
        level = checkpointed(_joined(level, up))
        levels.append(level)
    top = level.withColumn("end", _ended(F.col("ways")[0]))
    found = top.withColumns({"cost": F.col("end.c"), "audit": F.col("end.a")}).select(*_WHOLE)
    ahead = F.get(F.array(*(F.col("ways")[0][f"s{k}"]["a"] for k in range(STATES))), F.col("end.e"))
    inserted = F.length("end.a") - F.length(ahead)
    last = top.select("conv", F.lit(2**31 - 1).alias("range"), F.lit(0).alias("block"), _lines(F.array().cast("array<struct<role:string,text:string>>"), F.repeat(F.lit("I"), inserted), F.col("end.e")).alias("lines"))
    chosen = top.select("conv", "range", "block", F.lit(0).alias("begin"), F.col("end.e").alias("end"))
    for level in reversed(levels):
        p = level.alias("p").join(chosen.alias("c"), F.col("p.conv").eqNullSafe(F.col("c.conv")) & (F.col("p.range") == F.col("c.range")) & (F.col("p.block") == F.col("c.block")))
        path = F.concat(F.col("p.paths")[F.col("c.begin")][F.col("c.end")], F.col("c.end").cast("string"))
        below = p.select(F.col("p.conv").alias("conv"), path.alias("path"), F.posexplode("p.kids").alias("i", "kid"))
        state = lambda at: F.substring("path", at, F.lit(1)).cast("int")
        chosen = below.select("conv", F.col("kid.r").alias("range"), F.col("kid.b").alias("block"), state(F.col("i") + 1).alias("begin"), state(F.col("i") + 2).alias("end"))
    leaf = leaves.alias("p").join(chosen.alias("c"), F.col("p.conv").eqNullSafe(F.col("c.conv")) & (F.col("p.range") == F.col("c.range")) & (F.col("p.block") == F.col("c.block")))
    ways = F.col("p.ways")[F.col("c.begin")]
    audit = F.get(F.array(*(ways[f"s{k}"]["a"] for k in range(STATES))), F.col("c.end"))
    parts = leaf.select("p.conv", "p.range", "p.block", _lines(F.col("p.turns"), audit, F.col("c.begin")).alias("lines"))
    return found, parts.union(last)


def _one_block(rows: DataFrame) -> DataFrame:
    whole = _blocks(rows).withColumn("end", _ended(_folded(F.col("turns"), F.array(F.lit(0)))[0]))
    return whole.withColumns({"cost": F.col("end.c"), "audit": F.col("end.a"), "lines": _lines(F.col("turns"), F.col("end.a"), F.lit(0))})


def _spoken(lines: Column) -> Column:
    return F.array_join(F.transform(lines, lambda x: F.concat(x["role"], F.lit(":"), x["text"])), "\n")


def _digests(parts: DataFrame) -> DataFrame:
    """(conv, repaired_sha256) of conversations in several blocks; a task reads their lines in order and keeps only the hash."""
    schema = parts.schema

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, begun, digest = None, False, None
        for batch in stream:
            kind, out = batch.schema.field("conv").type, []
            for conv, n, said in zip(batch.column("conv"), batch.column("n").to_pylist(), batch.column("said").to_pylist(), strict=True):
                if digest is None or not conv.equals(now):
                    if digest is not None:
                        out.append((now, digest.hexdigest()))
                    now, begun, digest = conv, False, hashlib.sha256()
                if n:
                    digest.update(("\n" if begun else "").encode() + said.encode())
                    begun = True
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x.as_py() for x, _ in out], kind), pa.array([x for _, x in out])], ["conv", "repaired_sha256"])
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now.as_py()], now.type), pa.array([digest.hexdigest()])], ["conv", "repaired_sha256"])

    said = parts.select("conv", "range", "block", F.size("lines").alias("n"), _spoken(F.col("lines")).alias("said"))
    ordered = said.repartition("conv").sortWithinPartitions("conv", "range", "block").select("conv", "n", "said")
    return ordered.mapInArrow(run, f"conv {schema['conv'].dataType.simpleString()}, repaired_sha256 string")


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", gone: Column | None = None) -> DataFrame:
    """A row for each conversation: (conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256).

    Rows stand in the order of their turn, nulls first; rows of one turn in the order of the first 32 characters of role and text, then
    of a hash of both. `gone` tells rows that are not there any more: a conversation of such rows alone has zeros and an empty audit.
    Null roles and texts count as one space; a null conversation is one of its own. A blank turn has no solid character, a duplicate's
    role and text were seen earlier, a truncated one ends in none of .!?; the first of these is a turn's fault. gaps is how many
    numbers are missing between the lowest and the highest turn. illegal counts neighbours whose roles don't follow each other.
    Blank turns and duplicates must go. Of the cheapest audits, the least by its letters is taken. repaired_sha256 is the hash of
    the repaired turns as role:text, in lines. Other columns are of no account, whatever their names.
    """
    placed = _placed(rows, conv, turn, role, text, gone)
    whole = _one_block(placed.filter(~F.col("split"))).select(*_WHOLE, F.sha2(_spoken(F.col("lines")), 256).alias("repaired_sha256"))
    split = _split(placed.filter("split"))
    if split is not None:
        found, parts = split
        hashes = _digests(parts).withColumnRenamed("conv", "of")
        whole = whole.unionByName(found.join(hashes, F.col("conv").eqNullSafe(F.col("of"))).drop("of"))
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("distinct"), F.lit(0)).alias("gaps")
    return whole.select(F.col("conv").alias(conv), gaps, "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def repaired_turns(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", gone: Column | None = None) -> DataFrame:
    """(conv, part, position, role, text): the turns of the repaired conversations, in the order of part and position."""
    placed = _placed(rows, conv, turn, role, text, gone)
    parts = _one_block(placed.filter(~F.col("split"))).select("conv", F.lit(0).cast("long").alias("part"), "lines")
    split = _split(placed.filter("split"))
    if split is not None:
        parts = parts.union(split[1].select("conv", F.shiftleft(F.col("range").cast("long"), 31) + F.col("block"), "lines"))
    return parts.select(F.col("conv").alias(conv), "part", F.posexplode("lines").alias("position", "line")).select(conv, "part", "position", F.col("line.role").alias(role), F.col("line.text").alias(text))


def damaged(rows: DataFrame) -> DataFrame:
    """Rows of conversations, damaged by crc32(conv_id:turn) % 20, with `gone` for those that it drops.

    1 empties the text, 2 takes its .!? out, 3 repeats the row, 4 makes it the user's; nulls are one space, in the key too.
    """
    said = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    kind = F.crc32(F.concat(said[0], F.lit(":"), said[1])) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(said[3], ".!?", "")).otherwise(said[3])
    out = rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(said[2]).alias("role"), text.alias("text"), (kind == 0).alias("gone"), F.when(kind == 3, 2).otherwise(1).alias("times"))
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), "times"))).drop("times", "copy")
