"""Quality rules as a short-circuit cascade: what each rule costs and rejects is estimated on a sample, and rules then run in the
order of what they reject for their cost. A rule is only asked of documents that all rules before it have passed, and what it
measures is only measured then. The verdict is the same in any order.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import freeing, text_of

#: Documents, about, on which costs and rejections are estimated. They only set the order.
SAMPLE = 1000
#: Bytes of a text whose words are looked at together.
SLICE = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[*b" \t\n\x0b\x0c\r"]] = True
SYMBOL = np.zeros(256, bool)
SYMBOL[[*b"#*$%&|<>"]] = True
BLANK = regex.compile(rb"[ \t\n\x0b\x0c\r]")
LETTER, SHOUTED = regex.compile(r"\p{L}"), regex.compile(r"^[^\p{Ll}]*\p{Lu}[^\p{Ll}]*\p{Lu}[^\p{Ll}]*$")


class Text:
    """A text's measures, each worked out when it is first asked for."""

    def __init__(self, data: bytes):
        self.data, self.known = data, {}

    def __getitem__(self, name: str):
        if name not in self.known:
            self.known[name] = MEASURES[name](self)
        return self.known[name]


def _letters(t: Text) -> tuple[int, int, int]:
    """Words, code points in words, symbols."""
    b = np.frombuffer(t.data, np.uint8)
    space = SPACE[b]
    words = int(np.count_nonzero(~space[1:] & space[:-1])) + int(len(b) > 0 and not space[0])
    return words, int(np.count_nonzero((b & 0xC0) != 0x80)) - int(np.count_nonzero(space)), int(np.count_nonzero(SYMBOL[b]))


def _words(t: Text) -> tuple[dict[bytes, int], np.ndarray]:
    """The different words with their numbers, and the numbers of the text's words in order."""
    numbers: dict[bytes, int] = {}
    at, out, data = 0, [], t.data
    while at < len(data):
        gap = BLANK.search(data, at + SLICE)  # a slice ends at white space
        end = gap.start() if gap else len(data)
        out.append(np.fromiter((numbers.setdefault(w, len(numbers)) for w in data[at:end].split()), np.int64))
        at = end
    return numbers, np.concatenate(out) if out else np.zeros(0, np.int64)


def _twice(keys: np.ndarray) -> np.ndarray:
    """Which keys are there more than once."""
    ordered = np.sort(keys)
    more = ordered[1:][ordered[1:] == ordered[:-1]]
    at = np.searchsorted(more, keys)
    return (at < len(more)) & (more[np.minimum(at, len(more) - 1)] == keys) if len(more) else np.zeros(len(keys), bool)


def _pairs(t: Text) -> np.ndarray:
    numbers, ids = t["words"]
    return ids[:-1] * len(numbers) + ids[1:]


def _repeat_words(t: Text) -> int:
    numbers, ids = t["words"]
    if len(ids) < 4:
        return 0
    pairs, n = t["pairs"], len(numbers)
    if n >= 1 << 21:  # a number for each pair, so that three words have one below 2^63
        pairs = np.unique(pairs, return_inverse=True)[1]
    again = _twice(pairs[:-1] * n + ids[2:])
    covered = np.zeros(len(ids), bool)
    for k in range(3):
        covered[k : len(ids) - 2 + k] |= again
    return int(covered.sum())


def _lines(t: Text) -> tuple[int, int]:
    """Lines with a word, and how many of these are equal to an earlier one."""
    lines = [x for x in t.data.split(b"\n") if x.strip(b" \t\n\x0b\x0c\r")]
    return len(lines), len(lines) - len(set(lines))


def _words_like(pattern) -> Callable[[Text], int]:
    def count(t: Text) -> int:
        numbers, ids = t["words"]
        like = np.fromiter((bool(pattern.search(w.decode())) for w in numbers), bool, len(numbers))
        return int(like[ids].sum())

    return count


def _top_pair(t: Text) -> int:
    pairs = t["pairs"]
    return int(np.unique(pairs, return_counts=True)[1].max()) if len(pairs) else 0


#: name -> how a text is measured. One that uses others asks the text for them.
MEASURES: dict[str, Callable] = {
    "letters": _letters, "words": _words, "pairs": _pairs, "lines": _lines, "n_repeat_words": _repeat_words,
    "n_words": lambda t: t["letters"][0], "word_chars": lambda t: t["letters"][1], "n_symbols": lambda t: t["letters"][2],
    "n_lines": lambda t: t["lines"][0], "n_dup_lines": lambda t: t["lines"][1],
    "n_lettered": _words_like(LETTER), "n_shouted": _words_like(SHOUTED), "n_top_pair": _top_pair,
}


@dataclass(frozen=True)
class Rule:
    """Rejects a text if `fails` says so; `needs` are the measures it asks for, those first that others are made of."""

    name: str
    needs: tuple[str, ...]
    fails: Callable[[Text], bool]


BASE = (
    Rule("few_words", ("letters",), lambda t: t["n_words"] < 50),
    Rule("repeated_words", ("letters", "words", "pairs", "n_repeat_words"), lambda t: 100 * t["n_repeat_words"] > 50 * t["n_words"]),
)
#: Bounds of web text filters in common use, wide where languages differ.
RULES = (
    *BASE,
    Rule("symbols", ("letters",), lambda t: 10 * t["n_symbols"] > t["n_words"]),
    Rule("word_length", ("letters",), lambda t: not 2 * t["n_words"] <= t["word_chars"] <= 20 * t["n_words"]),
    Rule("repeated_lines", ("lines",), lambda t: 2 * t["n_dup_lines"] > t["n_lines"]),
    Rule("no_letters", ("letters", "words", "n_lettered"), lambda t: 10 * t["n_lettered"] < 7 * t["n_words"]),
    Rule("shouting", ("letters", "words", "n_shouted"), lambda t: 10 * t["n_shouted"] > 3 * t["n_words"]),
    Rule("one_phrase", ("letters", "words", "pairs", "n_top_pair"), lambda t: 5 * t["n_top_pair"] > t["n_words"]),
)


def ordered(seconds: np.ndarray, rejects: np.ndarray, rules: tuple[Rule, ...], measures: tuple[str, ...], paid: tuple[str, ...] = ()) -> list[int]:
    """The rules' order, always the one next that rejects most for its cost of the sampled documents that are left.

    seconds[i, j] is what measure j took for document i, rejects[i, k] whether rule k rejects it. A measure that an earlier rule has
    made, or that is paid for anyway, costs nothing more. Ties, and rules that reject none, stand as they were given.
    """
    left, have, out = np.ones(len(rejects), bool), set(paid), []
    while len(out) < len(rules):

        def worth(k: int) -> float:
            cost = 1e-9 + sum(float(seconds[left, measures.index(m)].sum()) for m in rules[k].needs if m not in have)
            return float(rejects[left, k].sum()) / cost

        best = max((k for k in range(len(rules)) if k not in out), key=lambda k: (worth(k), -k))
        out.append(best)
        have.update(rules[best].needs)
        left &= ~rejects[:, best]
    return out


def plan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, paid: tuple[str, ...] = (), text: str = "text", sample: int = SAMPLE) -> tuple[Rule, ...]:
    """The rules in the order of what they reject for their cost, by about `sample` documents of all. Without documents, as given."""
    measures = tuple(dict.fromkeys(m for r in rules for m in r.needs))
    n = docs.count()
    if not n:
        return rules

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            spent, failed = [], []
            for x in batch.column("text"):
                t, each = Text(x.as_py().encode()), []
                for m in measures:
                    began = time.perf_counter()
                    t[m]
                    each.append(time.perf_counter() - began)
                spent.append(each)
                failed.append([bool(r.fails(t)) for r in rules])
            yield pa.RecordBatch.from_arrays([pa.array(spent, pa.list_(pa.float64())), pa.array(failed, pa.list_(pa.bool_()))], ["spent", "failed"])

    drawn = docs.select(text_of(text).alias("text")).sample(min(1.0, sample / n), 0)
    seen = drawn.mapInArrow(freeing(run), "spent array<double>, failed array<boolean>").collect()  # of the sample, two short lists a document
    if not seen:
        return rules
    return tuple(rules[k] for k in ordered(np.array([r.spent for r in seen]), np.array([r.failed for r in seen]), rules, measures, paid))


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, columns: tuple[str, ...] = (), keep: tuple[str, ...] = ("doc_id",), text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """docs' columns `keep`, the measures `columns` of every text, `kept`, and `rejected_by`: the rule that rejected it, or null.

    `columns` are measured for all documents, the rest only as far as the cascade asks. A null text has no words. Every row is judged
    by itself, whatever others repeat it; where a document fails several rules, which one says so depends on the sample's order.
    """
    paid = [m for m in ("letters", "words", "pairs", "lines") if any(c == m or c in {"letters": ("n_words", "word_chars", "n_symbols"), "lines": ("n_lines", "n_dup_lines")}.get(m, ()) or c == "n_repeat_words" and m in ("words", "pairs") for c in columns)]
    cascade = plan(docs, rules, (*paid, *columns), text, sample)
    names = [f"m{k}" for k in range(len(columns))]
    given = [f"k{k}" for k in range(len(keep))]

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            measured, by = [[] for _ in columns], []
            for x in batch.column("text"):
                t = Text(x.as_py().encode())
                for out, c in zip(measured, columns, strict=True):
                    out.append(t[c])
                by.append(next((r.name for r in cascade if r.fails(t)), None))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in given), *(pa.array(m, pa.int64()) for m in measured), pa.array(by, pa.string())], [*given, *names, "by"])

    inside = docs.select(*(F.col(f"`{c}`").alias(k) for c, k in zip(keep, given, strict=True)), text_of(text).alias("text"))
    schema = ", ".join([*(f"{k} {inside.schema[k].dataType.simpleString()}" for k in given), *(f"{m} long" for m in names), "by string"])
    out = inside.mapInArrow(freeing(run), schema)
    return out.select(*(F.col(k).alias(c) for k, c in zip(given, keep, strict=True)), *(F.col(m).alias(c) for m, c in zip(names, columns, strict=True)), F.col("by").isNull().alias("kept"), F.col("by").alias("rejected_by"))
