"""Links tool calls with their results, orders them, checks their arguments and writes canonical JSON."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

#: Turns a bucket of a conversation's order has.
BUCKET = 1024
#: Stands for the turn of rows without one; buckets of such rows for each level.
NO_TURN, SALTS = 2**62, 1024


@dataclass(frozen=True)
class Field:
    """A field of a tool's arguments; kind is string, integer, number, boolean, object or array."""

    tool: str
    name: str
    kind: str
    required: bool = True


KINDS = {"string": r"^STRING$", "integer": r"^BIGINT$", "number": r"^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$", "boolean": r"^BOOLEAN$", "object": r"^OBJECT<.*$", "array": r"^ARRAY<.*$"}


def problems(tool: Column, arguments: Column, fields: tuple[Field, ...]) -> Column:
    """What is wrong with a call's arguments, sorted and joined with `; `: empty if they fit the tool's schema."""
    parsed = F.try_parse_json(arguments)
    keys = F.json_object_keys(arguments)
    found = [F.when(~tool.isin(*sorted({f.tool for f in fields})) | tool.isNull(), F.lit("unknown tool")), F.when(parsed.isNull() | keys.isNull(), F.lit("arguments are no JSON object"))]
    for f in fields:
        value = F.try_variant_get(parsed, f"$['{f.name}']", "variant")
        mine = (tool == f.tool) & keys.isNotNull()
        absent = ~F.array_contains(keys, f.name)
        if f.required:
            found.append(F.when(mine & absent, F.lit(f"{f.name} is missing")))
        found.append(F.when(mine & ~absent & ~F.coalesce(F.rlike(F.schema_of_variant(value), F.lit(KINDS[f.kind])), F.lit(False)), F.lit(f"{f.name} is no {f.kind}")))
    for t in sorted({f.tool for f in fields}):
        more = F.array_except(keys, F.array(*[F.lit(f.name) for f in fields if f.tool == t]))
        found.append(F.when((tool == t) & (F.size(more) > 0), F.concat(F.lit("not in the schema: "), F.array_join(F.array_sort(more), ", "))))
    return F.array_join(F.array_sort(F.array_compact(F.array(*found))), "; ")


def levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, level, place) for nodes (node, turn); nodes on or behind a cycle of needs are absent.

    level is 0 without needs, else one more than the highest of what the node needs; place is the greatest turn among the node
    and all that it needs, near and far. So order by (place, level) is topological, and the turns' own order where that is.
    edges: (node, needs), both in nodes. Each round settles the nodes all of whose needs are settled and drops the edges to them,
    so an edge is joined once after its end is settled. Rounds: the longest chain of needs.
    """
    left = checkpointed(edges.distinct())
    ready = checkpointed(nodes.join(left.select("node").distinct(), "node", "left_anti").select("node", F.lit(0).alias("level"), F.col("turn").alias("place")))
    settled, met, level = [ready], None, 0
    while not left.isEmpty():
        ends = left.join(ready.select(F.col("node").alias("needs"), "place"), "needs", "left")
        now = checkpointed(ends)
        found = now.filter("place is not null").groupBy("node").agg(F.max("place").alias("place"))
        met = checkpointed(found if met is None else found.union(met).groupBy("node").agg(F.max("place").alias("place")))
        rest = checkpointed(now.filter("place is null").select("node", "needs"))
        level += 1
        free = left.select("node").distinct().join(rest.select("node").distinct(), "node", "left_anti")
        ready = checkpointed(free.join(nodes, "node").join(met.withColumnRenamed("place", "_met"), "node").select("node", F.lit(level).alias("level"), F.greatest("turn", "_met").alias("place")))
        if ready.isEmpty():
            break
        settled.append(ready)
        left = rest
    out = settled[0]
    for x in settled[1:]:
        out = out.union(x)
    return out


def link(calls: DataFrame, results: DataFrame, fields: tuple[Field, ...]) -> DataFrame:
    """A row for each call and each result of the conversations.

    calls: conv_id, turn, call_id, tool, arguments (JSON text), needs (array of call_ids whose results it uses).
    results: conv_id, turn, call_id, content. Out: conv_id, turn, kind (call or result), call_id, linked, problems, position, json.

    Calls and results meet by a hash join on (conv_id, call_id); a null or repeated identifier links nothing beyond its first
    call (lowest turn), and later calls with it are `repeated id`. A result comes after its call, a call after the results that
    it needs; position numbers a conversation's rows from 0 in such an order, which is that of the turns as far as can be. Rows
    on a cycle of needs come last (`needs itself`), those without a turn before them. Rows without a conv_id are of no conversation
    and their position is null. json has sorted keys and no spaces: for calls arguments, id, tool, type, turn; for results content, id, type, turn.
    No step gathers a conversation: ranks are taken in buckets of BUCKET turns, of which only the counts are summed. Rows without a
    turn are ranked by level and within it by hash, in SALTS buckets a level.
    """
    c = calls.select("conv_id", "turn", F.lit("call").alias("kind"), "call_id", "tool", "arguments", F.lit(None).cast("string").alias("content"), F.coalesce("needs", F.expr("cast(array() as array<string>)")).alias("needs"))
    r = results.select("conv_id", "turn", F.lit("result").alias("kind"), "call_id", F.lit(None).cast("string").alias("tool"), F.lit(None).cast("string").alias("arguments"), "content", F.expr("cast(array() as array<string>)").alias("needs"))
    rows = checkpointed(c.union(r).withColumn("_row", F.monotonically_increasing_id()))
    named = rows.filter("conv_id is not null and call_id is not null")
    first = named.filter("kind = 'call'").groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "_row")).alias("_first")).select("conv_id", "call_id", F.col("_first._row").alias("_call"))
    answers = named.filter("kind = 'result'").select("conv_id", "call_id", F.col("_row").alias("_result"))
    pairs = checkpointed(first.join(answers, ["conv_id", "call_id"]))
    wanted = named.filter("kind = 'call'").select("conv_id", F.col("_row").alias("node"), F.explode("needs").alias("call_id"))
    edges = pairs.select(F.col("_result").alias("node"), F.col("_call").alias("needs")).union(wanted.join(pairs.select("conv_id", "call_id", F.col("_result").alias("needs")), ["conv_id", "call_id"]).select("node", "needs"))
    level = levels(rows.select(F.col("_row").alias("node"), F.coalesce("turn", F.lit(NO_TURN)).alias("turn")), edges)
    linked = pairs.select(F.col("_result").alias("_row")).union(pairs.select(F.col("_call").alias("_row"))).distinct().withColumn("linked", F.lit(True))
    out = rows.join(level.withColumnRenamed("node", "_row"), "_row", "left").join(linked, "_row", "left").join(first.select(F.col("_call").alias("_row"), F.lit(True).alias("_first")), "_row", "left")
    faults = F.when(F.col("kind") == "call", F.array_join(F.array_compact(F.array(F.nullif(problems(F.col("tool"), F.col("arguments"), fields), F.lit("")), F.when(F.col("call_id").isNull(), "no id").when(F.col("_first").isNull() & F.col("conv_id").isNotNull(), "repeated id"), F.when(F.col("level").isNull(), "needs itself"))), "; ")).otherwise(F.when(F.col("linked").isNull(), "no call").otherwise(""))
    salt = F.pmod(F.xxhash64("kind", "call_id", "tool", "arguments", "content"), F.lit(SALTS))
    # buckets rise with (place, level), so that an order of buckets is one of their rows
    of_turn = F.when(F.col("place") < NO_TURN, F.floor(F.col("place") / BUCKET)).when(F.col("level").isNotNull(), F.lit(NO_TURN // BUCKET) + F.col("level") * SALTS + salt).otherwise(F.lit(NO_TURN // BUCKET * 2) + salt)
    bucket = F.when(F.col("conv_id").isNull(), F.pmod("_row", F.lit(SALTS))).otherwise(of_turn)
    out = out.withColumns({"linked": F.coalesce("linked", F.lit(False)), "problems": faults, "_place": F.coalesce("place", F.lit(2**63 - 1)), "_bucket": bucket})
    keys = ["conv_id", "_bucket"]
    sums = Window.partitionBy("conv_id").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = out.groupBy(*keys).count().withColumn("_before", F.coalesce(F.sum("count").over(sums), F.lit(0))).drop("count")
    rank = Window.partitionBy(*keys).orderBy("_place", "level", "turn", "kind", "call_id", "_row")
    out = out.withColumn("_n", F.row_number().over(rank) - 1)
    k = [out[x].eqNullSafe(before[x]) for x in keys]
    out = out.join(before, k[0] & k[1]).select(*[out[x] for x in out.columns], "_before")
    position = F.when(F.col("conv_id").isNotNull(), F.col("_n") + F.col("_before")).cast("long")
    body = F.when(F.col("kind") == "call", F.to_json(F.struct(F.coalesce(F.try_parse_json("arguments"), F.to_variant_object(F.struct(F.col("arguments").alias("text")))).alias("arguments"), F.col("call_id").alias("id"), "tool", "turn", F.col("kind").alias("type")))).otherwise(F.to_json(F.struct("content", F.col("call_id").alias("id"), "turn", F.col("kind").alias("type"))))
    return out.select("conv_id", "turn", "kind", "call_id", "linked", "problems", position.alias("position"), body.alias("json"))


#: Schemas of the two tools that turns of plain conversations call.
TURN_TOOLS = (Field("ask", "text", "string"), Field("ask", "words", "integer"), Field("configure", "text", "string"))


def turns_as_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results that plain turns stand for.

    A user's turn calls `ask`, a system's `configure`; an assistant's turn is the result of the turn before it. Every other role
    is a call of a tool of that name, which no schema knows. A call's identifier is `turn-<turn>`. Null texts count as empty.
    """
    text = F.coalesce("text", F.lit(""))
    tool = F.when(F.col("role") == "user", "ask").when(F.col("role") == "system", "configure").otherwise(F.coalesce("role", F.lit("")))
    answers = F.coalesce(F.col("role") == "assistant", F.lit(False))
    arguments = F.when(tool == "ask", F.to_json(F.struct(F.expr(r"cast(regexp_count(coalesce(text, ''), r'[^\x20\x09-\x0D]+') as bigint)").alias("words"), text.alias("text")))).otherwise(F.to_json(F.struct(text.alias("text"))))
    calls = conversations.filter(~answers).select("conv_id", "turn", F.concat(F.lit("turn-"), "turn").alias("call_id"), tool.alias("tool"), arguments.alias("arguments"), F.expr("cast(array() as array<string>)").alias("needs"))
    results = conversations.filter(answers).select("conv_id", "turn", F.concat(F.lit("turn-"), F.col("turn") - 1).alias("call_id"), text.alias("content"))
    return calls, results
