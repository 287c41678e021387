"""Filters URLs by rules and, where none fits, by two variable-order Markov models of their characters."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, checkpointed, join_unique

ORDER, FOLDS, STEP = 5, 5, 0.01


@dataclass(frozen=True)
class Rule:
    """action is allow or block; text is `host/path`, split at its first slash."""

    action: str
    text: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2]


RULES = (Rule("allow", "org/"), Rule("block", "example.org/es/"), Rule("block", "example.org/en/1"), Rule("allow", "com/fr/"), Rule("block", "com/de/"))


def parts(url: str = "url"):
    """Columns host and path of a url; both empty if it is null or has no `://`."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    c = F.coalesce(F.col(url), F.lit(""))
    return ascii_lower(F.regexp_extract(c, pattern, 1)), F.regexp_extract(c, pattern, 2)


def ruled(df: DataFrame, rules: tuple[Rule, ...], url: str = "url") -> DataFrame:
    """df with host, path, rule and action of the longest rule that fits (of equals, the first), or nulls."""
    host, path = parts(url)
    out = df.withColumns({"host": host, "path": path})
    rule = action = None
    for r in sorted(rules, key=lambda r: -len(r.text)):
        fits = ((F.col("host") == r.host) | F.endswith(F.col("host"), F.lit("." + r.host))) & F.startswith(F.col("path"), F.lit(r.path))
        rule = F.when(fits, r.text) if rule is None else rule.when(fits, r.text)
        action = F.when(fits, r.action) if action is None else action.when(fits, r.action)
    none = F.lit(None).cast("string")
    return out.withColumns({"rule": none if rule is None else rule, "action": none if action is None else action})


def gram_scores(grams: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, n, score) for (gram, n, allow, block): log P(last character | those before) for allow less that for block.

    Witten-Bell smoothing: P_o = (c(context, x) + T(context) P_{o-1}) / (c(context) + T(context)), T being the characters seen
    after the context; P_0 mixes with the uniform distribution over Unicode's first 256 code points and so never is 0. The counts
    of each order are sums of those of the next; a level's table has a row for each distinct string, never for an occurrence.
    """
    levels = {order: grams.select("gram", "allow", "block")}
    for o in range(order - 1, -1, -1):
        longer = levels[o + 1]
        levels[o] = longer.groupBy(F.expr("substring(gram, 2)").alias("gram")).agg(F.sum("allow").alias("allow"), F.sum("block").alias("block"))
    below = None
    for o in range(order + 1):
        level = levels[o].withColumn("context", F.expr("left(gram, length(gram) - 1)"))
        totals = level.groupBy("context").agg(*(f(c).alias(x) for c in ("allow", "block") for f, x in ((F.sum, f"c_{c}"), (lambda c: F.count_if(F.col(c) > 0), f"t_{c}"))))
        level = level.join(totals, "context")
        if below is None:
            level = level.withColumns({f"q_{c}": F.lit(1 / 256) for c in ("allow", "block")})
        else:
            level = level.withColumn("shorter", F.expr("substring(gram, 2)")).join(below, "shorter")
        p = {f"p_{c}": F.when(F.col(f"c_{c}") > 0, (F.col(c) + F.col(f"t_{c}") * F.col(f"q_{c}")) / (F.col(f"c_{c}") + F.col(f"t_{c}"))).otherwise(F.col(f"q_{c}")) for c in ("allow", "block")}
        level = checkpointed(level.select("gram", *(v.alias(k) for k, v in p.items())))
        below = level.select(F.col("gram").alias("shorter"), F.col("p_allow").alias("q_allow"), F.col("p_block").alias("q_block"))
    return grams.join(level, "gram").select("gram", "n", (F.log("p_allow") - F.log("p_block")).alias("score"))


def threshold(histogram: list[tuple[float, str, int]]) -> float:
    """The score at and above which a url is allowed: it gives the best mean of both classes' shares of right verdicts.

    Of equally good ones, the middle of those nearest to 0. Without either class it is minus infinity: nothing is known to reject,
    so everything is kept. judge() leaves a class out only if no url at all is of it.
    """
    total = {a: sum(n for _, x, n in histogram if x == a) for a in ("allow", "block")}
    if not all(total.values()):
        return -math.inf
    cuts = sorted({s for s, _, _ in histogram} | {max(s for s, _, _ in histogram) + STEP})
    right = {c: sum(n for s, a, n in histogram if a == "allow" and s >= c) / total["allow"] + sum(n for s, a, n in histogram if a == "block" and s < c) / total["block"] for c in cuts}
    best = max(right.values())
    ties = [c for c in cuts if right[c] >= best - 1e-12]
    below = {c: max((s for s in cuts if s < c), default=c) for c in ties}
    middles = [(c + below[c] + STEP) / 2 if below[c] < c else c for c in ties]
    return min(middles, key=abs)


def judge(df: DataFrame, rules: tuple[Rule, ...] = RULES, url: str = "url", order: int = ORDER, keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """The columns in keep, host, path, rule, verdict and score for each row.

    The urls that a rule judges teach the two models: all but a fifth, by hash, give counts, and that fifth sets the threshold. To
    the fifth, at any size, comes one url of each class on its side of 0, where both models find a url equally likely: so few urls
    that none of a class is in the fifth leave the threshold there. If no url at all is of one class, all others are allowed.
    score is the difference of log likelihoods per character, of every url, also where a rule gives the verdict; a url that no rule fits is allowed at or above the threshold. What is scored is host and path, without scheme,
    query and fragment; a url without `://` is scored as it is, a null one as the empty string. Every distinct string is scored
    once, and its grams are joined with the distinct grams of the corpus; a gram or string that many rows share is joined apart.
    """
    judged = ruled(df.select(*keep, F.col(url).alias("_url")), rules, "_url")
    string = F.when(F.contains(F.col("_url"), F.lit("://")), F.concat(F.lit("//"), "host", "path")).otherwise(F.coalesce("_url", F.lit("")))
    judged = judged.withColumn("_string", string)
    held = F.pmod(F.xxhash64("_string"), F.lit(FOLDS)) == 0
    strings = checkpointed(judged.groupBy("_string").agg(F.count(F.lit(1)).alias("n"), *(F.count_if((F.col("action") == a) & ~held).alias(a) for a in ("allow", "block")), *(F.count_if((F.col("action") == a) & held).alias(f"held_{a}") for a in ("allow", "block"))))
    padded = F.concat(F.lit("\x02" * order), "_string", F.lit("\x03"))
    # every string gives some forty rows, so the few partitions that it was gathered in become as many as a shuffle has
    dealt = strings.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_string")
    # by pieces, as finding a place in a string takes as long as the string is up to there
    n, piece = F.length("_string") + 1, 256
    inside = lambda c: F.sequence(F.lit(1), F.least(F.lit(piece), n - c + 1))
    cut = lambda c: F.element_at(F.transform(F.array(F.substr(padded, c, F.lit(piece + order))), lambda s: F.transform(inside(c), lambda i: F.substr(s, i, F.lit(order + 1)))), 1)
    # a digest stands for the string, which would else be repeated with each of its grams
    places = dealt.select(F.md5("_string").alias("_digest"), "n", "allow", "block", F.explode(F.flatten(F.transform(F.sequence(F.lit(1), n, F.lit(piece)), cut))).alias("gram"))
    grams = checkpointed(places.groupBy("gram").agg(F.count(F.lit(1)).alias("rows"), *(F.sum(c).alias(c) for c in ("n", "allow", "block"))))
    scores = gram_scores(grams, order).join(grams.select("gram", "rows"), "gram").select("gram", "rows", "score")
    total = grams.agg(F.sum("rows")).first()[0] or 0
    by_place = join_unique(places.select("_digest", "gram"), scores, "gram", "rows", total)
    scored = checkpointed(by_place.groupBy("_digest").agg(F.avg("score").alias("score")).join(strings.withColumn("_digest", F.md5("_string")), "_digest"))
    bins = scored.withColumn("_bin", F.round(F.greatest(F.lit(-20.0), F.least(F.lit(20.0), F.col("score"))) / STEP)).groupBy("_bin").agg(F.sum("held_allow").alias("allow"), F.sum("held_block").alias("block")).collect()
    known = [a for a in ("allow", "block") if strings.filter((F.col(a) > 0) | (F.col(f"held_{a}") > 0)).limit(1).count()]
    neutral = [(0.0, "allow", 1), (-STEP, "block", 1)] if len(known) == 2 else []
    least = threshold([*neutral, *((r["_bin"] * STEP, a, r[a]) for r in bins for a in known if r[a])])
    rows = df.count()
    out = join_unique(judged, scored.select("_string", "n", "score"), "_string", "n", rows)
    verdict = F.coalesce("action", F.when(F.col("score") >= F.lit(least), "allow").otherwise("block"))
    return out.select(*keep, "host", "path", "rule", verdict.alias("verdict"), "score")
