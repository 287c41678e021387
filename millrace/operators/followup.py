"""What follows a post's screening: its status, the second pass it is sent to, the tools that run on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import EXPANDABLE

#: Types whose find makes a model needless; types that the graph expands, by who asks; modes that end as screened.
HIGH_VALUE = ("wechat", "qq", "phone", "url", "domain", "bank_card", "alipay", "email", "crypto_wallet", "slang", "tool")
GRAPH_TYPES = {
    "analysis": ("wechat", "qq", "phone", "url", "domain", "bank_card", "alipay", "tool"),
    "expansion": ("wechat", "qq", "phone", "url", "domain", "bank_card", "alipay", "tool", "crypto_wallet"),
    "screening": EXPANDABLE,
}
SCREENED_MODES = {"analysis": ("快速",), "worker": ("快速", "初筛", "分层")}
GRAPH_MODE, STANDARD_MODE = "自动扩线研判", "自动标准研判"
MODEL_SKIPPED_FROM, FAST_FROM, SIMILAR_FROM = 0.7, 0.9, 0.6


def _any_of(types: Column, names) -> Column:
    return F.coalesce(F.arrays_overlap(types, F.array(*map(F.lit, names))), F.lit(False))


def followup_options(decision: Column, auto: Column) -> Column:
    """The options of the second pass that a screening decision asks for; null where there is none or auto is not true."""

    def options(deep: bool, mode: str) -> Column:
        flags = {"enable_llm": True, "enable_roberta": True, "enable_embedding": deep, "enable_graph_expand": deep, "enable_report": False, "analysis_mode": mode, "auto_escalate": False}
        return F.struct(*(F.lit(v).alias(k) for k, v in flags.items()))

    graph, standard = decision == "NEED_GRAPH_ANALYSIS", decision == "NEED_STANDARD_ANALYSIS"
    return F.when(F.coalesce(auto, F.lit(False)), F.when(graph, options(True, GRAPH_MODE)).when(standard, options(False, STANDARD_MODE)))


def target_status(mode: Column, llm: Column, roberta: Column, embedding: Column, graph: Column, who: str = "worker") -> Column:
    """SCREENED for a screening mode or with every deep step off, else ANALYZED. Null flags are at their defaults: only embedding is off."""
    off = lambda c, default: ~F.coalesce(c, F.lit(default))
    fast = off(llm, True) & off(roberta, True) & off(embedding, False) & off(graph, True)
    for word in SCREENED_MODES[who]:
        fast = fast | F.contains(F.coalesce(mode, F.lit("")), F.lit(word))
    return F.when(fast, "SCREENED").otherwise("ANALYZED")


def with_tools(df: DataFrame, types: str = "entity_types", confidence: str = "confidence", graph: Column | None = None, embedding: Column | None = None, who: str = "analysis") -> DataFrame:
    """df with run_graph, run_slang, run_similar: which tools its entity types and confidence call for.

    graph and embedding switch the first and the last off or on (by default on and off). Null types count as none, a null
    confidence as 0.
    """
    t, sure = F.col(types), F.coalesce(F.col(confidence), F.lit(0.0))
    on = lambda c, default: F.lit(default) if c is None else F.coalesce(c, F.lit(default))
    return df.withColumns({"run_graph": on(graph, True) & _any_of(t, GRAPH_TYPES[who]), "run_slang": _any_of(t, ("slang",)), "run_similar": on(embedding, False) & (sure >= SIMILAR_FROM)})


def extraction_path(types: Column, confidence: Column) -> Column:
    """fast: what rules and dictionary found is all; skip_model: embedding too, but no model; full. Null types and confidence as above."""
    sure = F.coalesce(confidence, F.lit(0.0))
    some = F.coalesce(F.size(types), F.lit(0)) > 0
    return F.when(some & (sure >= FAST_FROM), "fast").when(_any_of(types, HIGH_VALUE) & (sure >= MODEL_SKIPPED_FROM), "skip_model").otherwise("full")
