"""Text functions, Column to Column: all but simhash64 run inside the JVM."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import BOILERPLATE, EMOJI_RANGES, FULL_WIDTH, HTML_ENTITIES

TAG, ENTITY = r"<[^>]+>", r"&[a-zA-Z]+;|&#\d+;"
CJK = "[一-鿿]"
HAN, ASCII_WORD = re.compile(CJK), re.compile("[a-zA-Z0-9]+")


def fold(c: Column, steps, use: Callable) -> Column:
    return reduce(use, steps, c)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


#: Words up to which each is looked for by itself.
FEW = 8


def contains_any(c: Column, words) -> Column:
    """Whether any of the words occurs: one scan of the text for each of few, one pattern for many."""
    if not words or "" in words:
        return F.rlike(c, F.lit("|".join(quote(w) for w in words)))
    if len(words) <= FEW:
        return let(c, lambda t: reduce(lambda found, w: found | F.contains(t, F.lit(w)), words[1:], F.contains(t, F.lit(words[0]))))
    return F.rlike(c, F.lit(one_of(words)))


def one_of(words) -> str:
    """A pattern for any of the words that tries at a place few of them: it halves them by their first characters, ASCII by itself."""
    firsts = sorted({w[0] for w in words})
    ascii_ones = [x for x in firsts if x < "\x80"]
    at = len(ascii_ones) if 0 < len(ascii_ones) < len(firsts) else len(firsts) // 2 if len(firsts) > 3 and not ascii_ones else 0
    if not at:
        return f"(?=[{span(firsts)}])(?:{'|'.join(quote(w) for w in words)})"
    halves = "|".join(one_of([w for w in words if w[0] in part]) for part in (firsts[:at], firsts[at:]))
    return halves if ascii_ones else f"(?=[{span(firsts)}])(?:{halves})"


def span(chars) -> str:
    """What a class in a pattern holds to let the characters through: ASCII itself, of others all from the first to the last, beyond the BMP too."""
    codes = sorted(set(map(ord, chars)))
    wide = [part for part in ([x for x in codes if 0x80 <= x < 0x10000], [x for x in codes if x >= 0x10000]) if part]
    return "".join(f"\\x{{{x:X}}}" for x in codes if x < 0x80) + "".join(f"\\x{{{p[0]:X}}}-\\x{{{p[-1]:X}}}" for p in wide)


def translated(c: Column, old: str, new: str) -> Column:
    """translate(), which takes long, for texts that have any of the characters."""
    each = lambda xs: "".join(f"\\x{{{ord(x):X}}}" for x in xs)
    low, high = [x for x in old if x < "\u0100"], [x for x in old if x >= "\u0100"]
    some = f"[{each(low)}" + (f"[{span(high)}&&[{each(high)}]]" if high else "") + "]"
    return let(c, lambda t: F.when(F.rlike(t, F.lit(some)), F.translate(t, old, new)).otherwise(t))


def quote(word: str) -> str:
    return "".join("\\" + x if x in r"\.^$|?*+()[]{}" else x for x in word)


def hits(c: Column, words) -> Column:
    """The words that occur, in the order of the list; each of many is looked for only in texts that have one."""
    found = lambda t: F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(t, w))
    return found(c) if len(words) <= FEW else let(c, lambda t: F.when(contains_any(t, words), found(t)).otherwise(F.expr("cast(array() as array<string>)")))


def normalize_whitespace(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def normalize_unicode(c: Column) -> Column:
    return F.replace(translated(c, FULL_WIDTH[0] + " ​‎‏﻿", FULL_WIDTH[1] + " "), F.lit("\r\n"), F.lit("\n"))


def simplify_urls(c: Column) -> Column:
    return F.regexp_replace(c, r"https?://(?:www\.)?([^/?#\s]*)\S*", "[链接:$1]")


def html_to_plain(c: Column) -> Column:
    """Entities first, then tags: an escaped tag goes as a tag does."""
    plain = lambda t: fold(t, HTML_ENTITIES, lambda x, e: F.replace(x, F.lit(e[0]), F.lit(e[1])))
    # without an & there is no entity, and none comes about
    return let(c, lambda t: F.when(F.contains(t, F.lit("&")), F.regexp_replace(F.regexp_replace(plain(t), TAG, " "), ENTITY, " ")).otherwise(F.regexp_replace(t, TAG, " ")))


def unescape_unicode(c: Column) -> Column:
    def plain(c: Column) -> Column:
        found = F.array_distinct(F.regexp_extract_all(c, F.lit(r"(\\u[0-9a-fA-F]{4})"), F.lit(1)))
        return F.aggregate(found, c, lambda t, m: F.replace(t, m, F.decode(F.unhex(F.substring(m, 3, 4)), "UTF-16BE")))

    return let(c, lambda t: F.when(F.contains(t, F.lit("\\u")), plain(t)).otherwise(t))


def apply_common(c: Column) -> Column:
    return normalize_whitespace(simplify_urls(normalize_unicode(unescape_unicode(html_to_plain(c)))))


def normalize(c: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(c, TAG, " "), ENTITY, " ")
    return normalize_whitespace(translated(unescape_unicode(translated(plain, "​‌‍", "")), " ", " "))


def clean_html(c: Column) -> Column:
    """Block ends to new lines, images to their text, anchors to theirs, then one line."""
    steps = ((r"(?i)<br\s*/?>|</p>|</div>", "\n"), (r'<img[^>]*alt="([^"]*)"[^>]*>', "[$1]"), (r"<img[^>]*>", "[图片]"), (r"<a[^>]*>([^<]*)</a>", "$1"), (TAG, " "))
    plain = fold(c, steps, lambda x, s: F.regexp_replace(x, *s))
    plain = fold(plain, (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"')), lambda x, e: F.replace(x, F.lit(e[0]), F.lit(e[1])))
    return normalize_whitespace(plain)


def strip_boilerplate(c: Column, platform: str) -> Column:
    patterns, by = BOILERPLATE.get(platform, ((), ""))
    out = fold(c, patterns, lambda x, p: F.regexp_replace(x, p, by))
    if platform == "weibo":
        return F.regexp_replace(out, "#([^#]+)#", "[话题:$1]")
    most = {"douyin": 3, "xiaohongshu": 5}.get(platform)
    if not most:
        return out

    def capped(found: Column) -> Column:
        tags, body = found["tags"], found["body"]
        fewer = F.aggregate(F.slice(tags, most + 1, F.greatest(F.size(tags) - most, F.lit(0))), body, lambda t, h: F.replace(t, h, F.lit("")))
        return F.regexp_replace(F.when(F.size(tags) > 5, fewer).otherwise(body), r"#([^\s#]+)", "[话题:$1]")

    return let(out, lambda t: let(F.struct(t.alias("body"), F.regexp_extract_all(t, F.lit(r"(#[^\s#]+)"), F.lit(1)).alias("tags")), capped))


#: Ranges of code points that make a text one with emoji.
ANY_EMOJI = "[\\x{1F600}-\\x{1F64F}\\x{1F300}-\\x{1F5FF}\\x{1F680}-\\x{1F6FF}\\x{1F1E0}-\\x{1F1FF}\\x{2600}-\\x{27BF}]"


#: EMOJI_RANGES behind three wide ranges, as most characters are outside of these and need no look at each range.
EMOJI = r"[\x{200D}-\x{2B07}\x{FE00}-\x{FE0F}\x{1F100}-\x{1FAFF}&&" + EMOJI_RANGES + "]"


def visible_length(c: Column) -> Column:
    return F.length(F.replace(F.replace(c, F.lit(" "), F.lit("")), F.lit("\n"), F.lit("")))


def emoji_density(c: Column) -> Column:
    return let(F.struct(c.alias("t"), F.regexp_count(c, F.lit(EMOJI)).alias("n")), lambda x: F.when(x["n"] > 0, x["n"] / visible_length(x["t"])).otherwise(0.0))


def excessive_emojis(c: Column, threshold: float = 0.5) -> Column:
    """Whether more than this share of a text's characters are emoji; false for a null text."""
    return F.coalesce(emoji_density(c) > threshold, F.lit(False))


def contains_emoji(c: Column) -> Column:
    return F.rlike(c, F.lit(ANY_EMOJI))


def preview(c: Column, n: int = 120) -> Column:
    line = F.trim(F.replace(c, F.lit("\n"), F.lit(" ")))
    return F.when(F.length(line) > n, F.concat(F.left(line, F.lit(n)), F.lit("..."))).otherwise(line)


def truncate_bytes(c: Column, most: int) -> Column:
    """The longest prefix of whole characters of at most `most` UTF-8 bytes."""
    # no more characters than bytes can fit, so of a long text only its first `most` are looked at
    head = F.left(c, F.lit(most))
    fits = F.filter(F.sequence(F.lit(0), F.least(F.length(head), F.lit(most))), lambda k: F.octet_length(F.left(head, k)) <= most)
    return F.when(F.octet_length(c) <= most, c).otherwise(F.left(head, F.array_max(fits)))


def context(c: Column, match: Column, around: int = 20) -> Column:
    at = F.instr(c, match)
    start = F.greatest(at - around, F.lit(1))
    return F.when(at > 0, F.substring(c, start, at + F.length(match) + around - start))


def defang_url(c: Column) -> Column:
    scheme = F.regexp_replace(F.regexp_replace(c, "(?i)^https?", "hxxp"), "(?i)^ftp", "fxp")
    return F.replace(F.replace(scheme, F.lit("://"), F.lit("[://]")), F.lit("."), F.lit("[.]"))


def defang_ip(c: Column) -> Column:
    return F.regexp_replace(c, r"\b(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})\b", "$1[.]$2[.]$3[.]$4")


def defang_email(c: Column) -> Column:
    at = F.instr(c, F.lit("@"))
    return F.concat(F.left(c, at), F.replace(F.substring(c, at + 1, F.length(c)), F.lit("."), F.lit("[.]")))


def each_match(c: Column, pattern: str, use: Callable[[Column], Column]) -> Column:
    """Every match replaced by use(match), the longest first so that one within another is left."""
    found = F.array_distinct(F.regexp_extract_all(c, F.lit(f"({pattern})"), F.lit(1)))
    longest = F.array_sort(found, lambda a, b: F.length(b) - F.length(a))
    return F.aggregate(longest, c, lambda t, m: F.replace(t, m, use(m)))


def defang_text(c: Column) -> Column:
    urls = each_match(c, r"""(?i)\b(?:https?|ftp)://[^\s<>"'\]\[\{\}\|\\^`]+""", defang_url)
    ips = F.regexp_replace(urls, r"(?<!\[://\])(?<!\[\.\].{0,2})\b(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})\b", "$1[.]$2[.]$3[.]$4")
    return each_match(ips, r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", defang_email)


def refang(c: Column) -> Column:
    plain = F.replace(F.replace(c, F.lit("[://]"), F.lit("://")), F.lit("[.]"), F.lit("."))
    return F.regexp_replace(F.regexp_replace(plain, "^hxxp", "http"), "^fxp", "ftp")


#: Characters of the texts whose tokens are held at once, and tokens of a text whose bits are.
CHARACTERS, TOKENS = 2_000_000, 16_384


@lru_cache(maxsize=1)
def _simhash():
    def hashed(texts: pd.Series) -> list[int | None]:
        known: dict[str, int] = {}
        places = []
        for text in texts:
            tokens = None if text is None else tokens_of(text)
            places.append(None if tokens is None else np.fromiter((known.setdefault(t, len(known)) for t in tokens), np.int32, len(tokens)))
        digests = np.frombuffer(b"".join(hashlib.md5(t.encode()).digest()[:8] for t in known), np.uint8).reshape(-1, 8)
        out: list[int | None] = []
        for at in places:
            if at is None:
                out.append(None)
                continue
            of, n = np.unique(at, return_counts=True)
            ones = np.zeros(64)
            for low in range(0, len(of), TOKENS):  # a text of very many tokens, some at once
                ones += n[low : low + TOKENS] @ np.unpackbits(digests[of[low : low + TOKENS]], axis=1).astype(np.float64)
            out.append(int.from_bytes(np.packbits(2 * ones > len(at)).tobytes(), "big", signed=True))
        return out

    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            # by few characters at once, as each different token takes some 200 bytes and its digest
            of = np.cumsum([0 if text is None else len(text) for text in texts]) // CHARACTERS
            cuts = [0, *np.flatnonzero(np.diff(of)) + 1, len(texts)]
            yield pd.Series([h for low, high in zip(cuts, cuts[1:], strict=False) for h in hashed(texts.iloc[low:high])], dtype="Int64")

    return run


def tokens_of(text: str) -> list[str]:
    """Bigrams of the Han characters, put together, and the ASCII words; the whole text if it has neither."""
    han = "".join(HAN.findall(text))
    return [*(han[i : i + 2] for i in range(len(han) - 1)), *ASCII_WORD.findall(text)] or [text]


def simhash64(c: Column) -> Column:
    """64 bits by the MD5 of a text's tokens, of which more have the bit than not; null for a null text.

    Built-in functions would fold over all tokens once for each bit; Arrow batches hash every different token of a batch once.
    """
    return _simhash()(c)


def simhash_hex(h: Column) -> Column:
    return F.concat(F.lit("0x"), F.lower(F.hex(h)))


def hamming(a: Column, b: Column) -> Column:
    """Bits that differ; hashes whose hexadecimal forms have different lengths are as far apart as the longer form allows."""
    n, m = F.length(F.hex(a)), F.length(F.hex(b))
    return F.when(n == m, F.bit_count(a.bitwiseXOR(b))).otherwise(F.greatest(n, m) * 4)
