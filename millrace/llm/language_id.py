"""Language identification by a linear-chain conditional random field over words."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import freeing, text_of

#: Hashed n-gram and affix features, words of a chain, documents a language to learn from (at most), languages (at most): with more
#: labels, the rarest are not learned and never predicted.
BUCKETS, CHAIN, PER_LANGUAGE, LANGUAGES = 1 << 17, 128, 200, 256
#: Characters of all texts to learn from; a language has an equal part of them.
CHARACTERS = 4_000_000
#: Words times languages that learning holds at a time.
CELLS = 1 << 21
#: No language: the text is null or has no letter.
NONE = "und"
CHUNK = 1 << 18  # characters at a time


@lru_cache(1)
def letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


@dataclass
class Words:
    """Words (runs of letters) of some texts, lower-cased: text and place of each, and its features."""

    doc: np.ndarray  # index of the text
    length: np.ndarray  # letters
    grams: np.ndarray  # (2, letters): buckets of the n-grams around each letter
    affixes: np.ndarray  # (4, words): buckets of prefixes and suffixes
    key: np.ndarray  # hash of the whole word


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def analyse(texts: list[str]) -> Words:
    low = [t.lower() for t in texts]
    codes = np.frombuffer(("\n" + "\n".join(low) + "\n\n").encode("utf-32-le", "surrogatepass"), "<u4")
    is_letter = letters()[np.minimum(codes, 0x10FFFF)]
    x = np.where(is_letter, codes, 0).astype(np.uint64)
    step = np.diff(is_letter.astype(np.int8))
    start, end = np.flatnonzero(step == 1) + 1, np.flatnonzero(step == -1) + 1
    bounds = 1 + np.concatenate([[0], np.cumsum([len(t) + 1 for t in low])])
    doc = np.repeat(np.arange(len(low)), np.diff(np.searchsorted(start, bounds)))
    at = np.flatnonzero(is_letter)
    length = end - start
    b, c = np.uint64(1_000_003), np.uint64(998_244_353)
    two = x[at] * b + x[at + 1]
    three = (x[at - 1] * b + x[at]) * c + x[at + 1]
    mask = np.uint64(BUCKETS - 1)
    grams = np.stack([_mix(two + np.uint64(1 << 60)) & mask, _mix(three + np.uint64(2 << 60)) & mask]).astype(np.int32)
    part = lambda i, ok: np.where(ok, x[np.clip(i, 0, len(x) - 1)], 0)
    prefix = part(start, length > 0) * b + part(start + 1, length > 1)
    suffix = part(end - 1, length > 0) * b + part(end - 2, length > 1)
    affixes = np.stack([_mix(h + np.uint64(k << 60)) & mask for k, h in ((3, prefix), (4, prefix * c + part(start + 2, length > 2)), (5, suffix), (6, suffix * c + part(end - 3, length > 2)))]).astype(np.int32)
    if len(start):
        place = (np.arange(len(at)) - np.repeat(np.cumsum(length) - length, length)) & 63
        powers = np.cumprod(np.full(64, c, np.uint64))
        key = _mix(np.add.reduceat(_mix(x[at] * b) * powers[place], np.cumsum(length) - length))
    else:
        key = np.zeros(0, np.uint64)
    return Words(doc, length, grams, affixes, key)


@dataclass
class Model:
    """languages, weights of n-grams and affixes (BUCKETS, languages), lexicon's word hashes (sorted) and weights, transitions."""

    languages: list[str]
    weights: np.ndarray
    lexicon: np.ndarray
    lexicon_weights: np.ndarray
    transitions: np.ndarray

    def in_lexicon(self, key: np.ndarray) -> np.ndarray:
        """Rows of lexicon_weights; the last row, of zeros, is for other words."""
        at = np.searchsorted(self.lexicon, key)
        known = at < len(self.lexicon)
        known[known] = self.lexicon[at[known]] == key[known]
        return np.where(known, at, len(self.lexicon))

    def emissions(self, w: Words) -> np.ndarray:
        n = len(self.languages)
        if not len(w.length):
            return np.zeros((0, n), np.float32)
        by_letter = self.weights[w.grams[0]] + self.weights[w.grams[1]]
        out = np.add.reduceat(by_letter, np.cumsum(w.length) - w.length, axis=0)
        for a in w.affixes:
            out += self.weights[a]
        return out + self.lexicon_weights[self.in_lexicon(w.key)]


def forward_backward(emissions: np.ndarray, transitions: np.ndarray, starts: np.ndarray, lengths: np.ndarray, edges: bool = False):
    """Marginals of all words of chains that lie one after another; with edges, also the sum of the marginals of transitions."""
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    e = np.exp(emissions - emissions.max(axis=1, keepdims=True)).astype(np.float64) + 1e-30
    move = np.exp(transitions - transitions.max()).astype(np.float64)
    n, k = len(starts), e.shape[1]
    alpha, post, pairs = np.empty_like(e), np.empty_like(e), np.zeros((k, k))
    longest = int(lengths[0]) if n else 0
    active = [int(np.searchsorted(-lengths, -t, "left")) for t in range(longest)]  # chains longer than t
    before = None
    for t in range(longest):
        at = starts[: active[t]] + t
        now = e[at] if before is None else e[at] * (before[: active[t]] @ move)
        now /= now.sum(axis=1, keepdims=True)
        alpha[at] = before = now
    beta = np.ones((n, k))
    for t in range(longest - 1, -1, -1):
        m = active[t]
        at = starts[:m] + t
        p = alpha[at] * beta[:m]
        post[at] = p / p.sum(axis=1, keepdims=True)
        right = e[at] * beta[:m]
        right /= right.sum(axis=1, keepdims=True)
        if edges and t:
            left = alpha[at - 1]
            z = ((left @ move) * right).sum(axis=1, keepdims=True)
            pairs += move * (left.T @ (right / z))
        beta[:m] = right @ move.T
    return (post, pairs) if edges else post


def chains(doc: np.ndarray, n_docs: int, size: int = CHAIN) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of chains: each document's words, cut after every `size`."""
    counts = np.bincount(doc, minlength=n_docs)
    first = np.cumsum(counts) - counts
    each = -(-counts // size)
    k = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
    starts = np.repeat(first, each) + k * size
    return starts, np.minimum(size, np.repeat(first + counts, each) - starts)


def fit(texts: list[str], langs: list[str], rounds: int = 60, rate: float = 0.15, decay: float = 1e-6, most_words: int = 20_000, seed: int = 7) -> Model | None:
    """Learns from whole labelled texts.

    Their words are dealt into chains that switch language as code-switched text does: runs of 5 to 40 words of one text, in
    random order. Full-batch Adam on the chains' log likelihood; expectations come from forward-backward. Features are worked
    out once for each distinct word.
    """
    names = sorted(set(langs))
    w = analyse(texts)
    if not names or not len(w.length):
        return None
    label = np.array([names.index(x) for x in langs])[w.doc]
    r = np.random.default_rng(seed)
    counts = np.bincount(w.doc, minlength=len(texts))
    runs, at = [], 0
    for c in counts:
        cuts = np.cumsum(r.integers(5, 41, c // 5 + 1))
        runs += [x for x in np.split(np.arange(at, at + c), cuts[cuts < c]) if len(x)]
        at += c
    r.shuffle(runs)
    order = np.concatenate(runs)
    label = label[order]
    keys, first, word, seen = np.unique(w.key, return_index=True, return_inverse=True, return_counts=True)
    word = word[order]
    offsets = np.cumsum(w.length) - w.length
    spans = w.length[first]
    at = np.repeat(offsets[first] - (np.cumsum(spans) - spans), spans) + np.arange(spans.sum())
    distinct = Words(np.arange(len(keys)), spans, w.grams[:, at], w.affixes[:, first], keys)
    lexicon = np.sort(keys[np.argsort(-seen, kind="stable")[:most_words]])
    k = len(names)
    model = Model(names, np.zeros((BUCKETS, k), np.float32), lexicon, np.zeros((len(lexicon) + 1, k), np.float32), np.zeros((k, k)))
    in_lexicon = model.in_lexicon(keys)
    inner = np.arange(len(order)) % CHAIN != 0
    observed = np.zeros((k, k))
    np.add.at(observed, (label[np.flatnonzero(inner) - 1], label[inner]), 1)
    params = [model.weights, model.lexicon_weights, model.transitions]
    moments = [(np.zeros(p.shape, np.float32), np.zeros(p.shape, np.float32)) for p in params]
    owner = np.repeat(np.arange(len(keys)), spans)
    block = max(1, CELLS // (k * CHAIN)) * CHAIN  # words of whole chains
    for step in range(1, rounds + 1):
        emissions = model.emissions(distinct)
        per_word, pairs = np.zeros((len(keys), k), np.float32), np.zeros((k, k))
        for a in range(0, len(order), block):
            some = word[a : a + block]
            post, moved = forward_backward(emissions[some], model.transitions, *chains(np.zeros(len(some), int), 1), edges=True)
            post[np.arange(len(some)), label[a : a + block]] -= 1
            pairs += moved
            for j in range(k):
                per_word[:, j] += np.bincount(some, post[:, j], len(keys))
        slope, by_word = np.zeros((BUCKETS, k), np.float32), np.zeros((len(lexicon) + 1, k), np.float32)
        for j in range(k):
            for buckets in distinct.grams:
                slope[:, j] += np.bincount(buckets, per_word[owner, j], BUCKETS)
            for buckets in distinct.affixes:
                slope[:, j] += np.bincount(buckets, per_word[:, j], BUCKETS)
            by_word[:, j] = np.bincount(in_lexicon, per_word[:, j], len(lexicon) + 1)
        by_word[-1] = 0
        for p, g, (m, v) in zip(params, (slope, by_word, pairs - observed), moments, strict=True):
            g = g / len(order) + decay * p
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)).astype(p.dtype)
    return model


def labelled(df: DataFrame, per_language: int = PER_LANGUAGE, languages: int = LANGUAGES, characters: int = CHARACTERS) -> DataFrame:
    """(text, lang): at most per_language distinct texts of each of the `languages` commonest labels, drawn by a hash of the text.

    Copies count once, so that they neither thin out a language's sample nor fill it. A language's texts end with the one that
    brings them to its part of `characters`; of a text longer than that part, so much is learned from. This bounds what the
    classifier is fitted on, in texts and in characters; nothing else is sampled.
    """
    known = df.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", F.xxhash64("text").alias("_h"))
    texts = known.groupBy("lang", "_h").count()
    counts = texts.groupBy("lang").agg(F.sum("count").alias("_rows"), F.count(F.lit(1)).alias("_texts")).orderBy(F.desc("_rows"), "lang").limit(languages)
    counts = counts.withColumn("_part", F.floor(F.lit(characters) / F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))).cast("int"))
    drawn = known.join(F.broadcast(counts), "lang").withColumn("_u", F.pmod("_h", F.lit(1 << 30)))
    drawn = drawn.filter(F.col("_u") < F.lit(2.0 * per_language * (1 << 30)) / F.col("_texts")).select("lang", F.expr("left(text, _part)").alias("text"), "_u", "_part").distinct()
    order = Window.partitionBy("lang").orderBy("_u", "text")
    first = drawn.withColumn("_n", F.row_number().over(order)).filter(f"_n <= {per_language}")
    before = F.coalesce(F.sum(F.length("text")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return first.withColumn("_before", before).filter("_before < _part").select("text", "lang")


def train(df: DataFrame, **how) -> Model | None:
    """A model from the rows of df that have text and lang, or None if there are none.

    The sample, which labelled() bounds, is fitted in one task; the driver gets the model alone.
    """

    def learn(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample = sorted((t, x) for batch in stream for t, x in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True))
        model = fit([t for t, _ in sample], [x for _, x in sample])
        if model is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    found = labelled(df, **how).repartition(1).mapInArrow(freeing(learn), "model binary").collect()
    return pickle.loads(found[0].model) if found else None


def _parts(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Slices of about CHUNK characters."""
    at, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held > CHUNK:
            yield at, i + 1
            at, held = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def marginals(model: Model, texts: list[str]) -> tuple[Words, np.ndarray]:
    w = analyse(texts)
    if not len(w.doc):
        return w, np.zeros((0, len(model.languages)))
    return w, forward_backward(model.emissions(w), model.transitions, *chains(w.doc, len(texts)))


def identify(df: DataFrame, model: Model | None, text: str = "text", keep: tuple[str, ...] = ("doc_id",), names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns in keep, lang_pred and score (by the names given) for each row of df, from the text alone.

    Every word of the text gets a language by forward-backward; lang_pred has most of the words' marginals, score is its share.
    Of equally probable languages the first by name is given. A text that is null or has no letter is `und` with score 0, as is
    every text if there is no model.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    source = text if text in keep else "__text"
    extra = [] if text in keep else [F.col(text).alias("__text")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema.fields)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in stream:
            texts = [t or "" for t in batch.column(source).to_pylist()]
            langs, scores = [NONE] * len(texts), [0.0] * len(texts)
            for a, b in _parts(texts) if model else ():
                w, post = marginals(model, texts[a:b])
                total = np.stack([np.bincount(w.doc, p, b - a) for p in post.T], 1)
                words = np.bincount(w.doc, minlength=b - a)
                best = total.argmax(axis=1)
                for i in np.flatnonzero(words):
                    langs[a + i], scores[a + i] = model.languages[best[i]], float(min(1.0, total[i, best[i]] / words[i]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*keep, *names])

    return df.select(*keep, *extra).mapInArrow(freeing(run), f"{schema}, `{names[0]}` string, `{names[1]}` double")


def spans(df: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, first_word, words, lang, probability): the runs of words of one language in code-switched text."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in stream:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            for a, b in _parts(texts):
                w, post = marginals(model, texts[a:b])
                best = post.argmax(axis=1) if len(post) else np.zeros(0, int)
                new = np.flatnonzero(np.r_[True, (np.diff(best) != 0) | (np.diff(w.doc) != 0)]) if len(best) else np.zeros(0, int)
                counts = np.bincount(w.doc, minlength=b - a)
                first = np.cumsum(counts) - counts
                size = np.diff(np.r_[new, len(best)])
                mean = np.add.reduceat(post.max(axis=1), new) / size if len(new) else []
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array([ids[a + d] for d in w.doc[new]], pa.int64()), "first_word": pa.array(new - first[w.doc[new]], pa.int64()), "words": pa.array(size, pa.int64()), "lang": pa.array([model.languages[x] for x in best[new]], pa.string()), "probability": pa.array(mean, pa.float64())})

    return df.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text")).mapInArrow(freeing(run), "doc_id long, first_word long, words long, lang string, probability double")


def held_out(doc_id: str = "doc_id"):
    """Whether a document is kept from learning: crc32 of its identifier, as text, divides by 5. A null identifier is kept out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))
