"""Text rules: HTML to text, sections, chunks, normalisation, similarity, lenient JSON."""

from __future__ import annotations

import html
import itertools
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import vocabulary
from tidemark.functions.stems import stem
from tidemark.operators.small import small

# --- HTML and sections -------------------------------------------------------------------------


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.mute = 0

    def handle_starttag(self, tag, attrs):
        self.mute += tag in ("script", "style")

    def handle_endtag(self, tag):
        self.mute -= self.mute > 0 and tag in ("script", "style")

    def handle_data(self, data):
        if not self.mute:
            self.parts.append(data)


def plain_text(page: str | None) -> str:
    """Text nodes without a separator, unescaped once more; no-break spaces become spaces, zero-width ones go."""
    p = _Text()
    p.feed(page or "")
    p.close()
    return html.unescape("".join(p.parts)).replace("\xa0", " ").replace("​", "")


@F.pandas_udf(T.StringType())
def html_to_text(s: pd.Series) -> pd.Series:
    return s.map(plain_text)


def looks_like_toc(c: Column) -> Column:
    """More than ten word-number pairs, as in tables of contents, in the first 2000 characters."""
    return F.size(F.regexp_extract_all(F.substring(c, 1, 2000), F.lit(r"([A-Za-z]{3,}\s*\d{1,3})(?=[A-Z]|\s|$)"), F.lit(1))) > 10


# Where sections begin, in the order in which the patterns are tried; case does not matter.
SECTIONS: dict[str, tuple[str, ...]] = {
    "risk_factors": (
        r"STRATEGIC\s+RISKS\.?\s*Strategic\s+risk",
        r"ITEM\s+1A[.\s:\-–—]+RISK\s+FACTORS",
        r"ITEM\s+1A[.\s:\-–—]+\(?RISK\s+FACTORS",
        r"Item\s+1A[.\s:\-–—]+Business\s+Risk",
        r"(?:^|\s{2,})RISK\s+FACTORS(?:\s*$|\s{2,})",
        r"Risk\s+Factors\s+and\s+Cautionary\s+Statements",
    ),
    "mda": (
        r"ITEM\s*7[.\s:\-]+MANAGEMENT.{0,5}S?\s+DISCUSSION\s+AND\s+ANALYSIS",
        r"ITEM\s*2[.\s:\-]+MANAGEMENT.{0,5}S?\s+DISCUSSION\s+AND\s+ANALYSIS",
        r"Management.{0,5}s?\s+Discussion\s+and\s+Analysis\s+of\s+Financial",
        r"FINANCIAL\s+REVIEW\s+Results\s+of\s+Operations",
    ),
    "liquidity": (r"Liquidity\s+and\s+Capital\s+Resources", r"Financial\s+Condition,?\s+Liquidity"),
    "business": (r"ITEM\s*1[.\s:\-]+BUSINESS",),
}
_NEXT = re.compile(r"(?:^|\n)\s*ITEM\s+\d+[A-Z]?\.\s*[A-Z]", re.I)
_TOC = re.compile(r"[A-Za-z]{3,}\s*\d{1,3}(?=[A-Z]|\s|$)")


def section(text: str, name: str, least: int = 1500, skip: int = 500, most: int = 80_000) -> str | None:
    """The longest part that begins at a match of the first pattern that gives ``least`` characters, tables of contents last.

    A part ends at the next item heading after ``skip`` characters, or after ``most``.
    """
    for pattern in SECTIONS.get(name, (name,)):
        found = []
        for m in re.finditer(pattern, text, re.I):
            end = _NEXT.search(text, m.start() + skip)
            part = text[m.start() : end.start() if end else m.start() + most].strip()
            found.append((len(_TOC.findall(part[:2000])) <= 10, len(part), part))
        if found:
            best = max(found, key=lambda x: x[:2])
            if best[1] >= least:
                return best[2]
    return None


@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def sections(s: pd.Series) -> pd.Series:
    """All sections that are there."""
    return s.map(lambda t: {k: v for k in SECTIONS if (v := section(t or "", k)) is not None})


def missing_sections(form: Column, year: Column, found: Column) -> Column:
    """mda always; risk factors in annual reports from 2006 on."""
    want = F.when(form.startswith("10-K") & (year >= 2006), F.array(F.lit("mda"), F.lit("risk_factors"))).otherwise(F.array(F.lit("mda")))
    return F.array_except(want, F.map_keys(found))


def clean_text(c: Column, most: int | None = None) -> Column:
    v = F.regexp_replace(F.regexp_replace(c, r"\s+", " "), r"(?i)\d+\s*Table of Contents", "")
    if most is not None:
        v = F.when(F.length(v) > most, F.concat(F.substring(v, 1, most), F.lit("..."))).otherwise(v)
    return F.trim(v)


#: Comments, scripts and styles; tags; and the strings between them.
_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<(?:script|style)\b.*?(?:</(?:script|style)\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)[^>]*>|[^<]+|<", re.S | re.I)


@F.pandas_udf(T.ArrayType(T.StringType()))
def html_tables(s: pd.Series) -> pd.Series:
    """The strings of each table, trimmed and joined by `` | ``, where that is over 50 characters; a table within a table is part of it and
    one of its own, after it."""

    def one(page: str | None) -> list[str]:
        open_: list[list[str]] = []
        every: list[list[str]] = []
        for m in _MARKUP.finditer(page or ""):
            name, string = (m[2] or "").lower(), m[0]
            if name == "table":
                if not m[1]:
                    every.append([])
                    open_.append(every[-1])
                elif open_:
                    open_.pop()
            elif open_ and string[0] != "<":
                string = html.unescape(string).strip()
                for t in open_ if string else ():
                    t.append(string)
        return [x for t in every if len(x := " | ".join(t)) > 50]

    return s.map(one)


# --- Chunks ------------------------------------------------------------------------------------


def char_chunks(text: str, size: int = 4000, overlap: int = 200) -> list[str]:
    """Pieces cut at the last sentence end of their last 200 characters; each begins ``overlap`` before the end of the one before.

    A text of ``size`` or less, the empty one too, is one piece. A piece that would end less than ``overlap`` beyond the text's end is
    followed by the tail that lies in its overlap.
    """
    if len(text) <= size:
        return [text]
    out, start = [], 0
    while start < len(text):
        end = start + size
        if end < len(text):
            dot = text.rfind(". ", max(0, end - 200), end)
            if dot > start:
                end = dot + 1
        out.append(text[start:end])
        start = max(end - overlap, start + 1)
    return out


def n_tokens(text: str) -> int:
    """Four characters a token: the estimate where no vocabulary is at hand."""
    return len(text) // 4


def token_chunks(text: str, size: int = 4000, overlap: int = 200) -> list[str]:
    """As ``char_chunks`` in tokens of four characters, cut at the last sentence end of a piece's last fifth. A text within one piece, the empty one too, is returned as it is; pieces are stripped."""
    out, start, total = [], 0, n_tokens(text)
    if total <= size:
        return [text]
    while start < total:
        piece = text[4 * start : 4 * min(start + size, total + 1)]
        if start + size < total:
            dot = piece.rfind(". ", int(len(piece) * 0.8))
            if dot > 0:
                piece = piece[: dot + 1]
        out.append(piece.strip())
        start += max(1, n_tokens(piece) - overlap)
        if start >= total - overlap:
            break
    return out


#: Sections in the order in which a budget goes to them.
PRIORITY = ("mda", "risk_factors", "liquidity", "business")


def chunk_sections(parts: dict[str, str], budget: int | None = None, size: int = 4000, overlap: int = 200, least: int = 500) -> list[str]:
    """The token chunks of all sections by priority, each section's first with a marker. Within a budget a section that does not fit is cut to what is left of it;
    below ``least`` it ends there. What is used counts the chunks, with their overlaps and markers."""
    out: list[str] = []
    used = 0
    for name in PRIORITY:
        if name not in parts:
            continue
        text = parts[name]
        if budget and used + n_tokens(text) > budget:
            if budget - used < least:
                break
            text = text[: 4 * (budget - used)]
        own = token_chunks(text, size, overlap)
        own[0] = f"[SECTION: {name.upper()}]\n\n{own[0]}"
        out += own
        used += sum(map(n_tokens, own))
        if budget and used >= budget:
            break
    return out


def section_chunks(df: DataFrame, key: str, sections_: str, budget: int, size: int = 4000, overlap: int = 200) -> DataFrame:
    """key, pos, chunk of the sections (a map) of each row."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in it:
            rows = [(k, i, c) for k, m in zip(p[key], p[sections_], strict=True) for i, c in enumerate(chunk_sections(dict(m or {}), budget, size, overlap))]
            yield pd.DataFrame(rows, columns=[key, "pos", "chunk"])

    kind = dict(df.dtypes)[key]
    return df.select(key, sections_).mapInPandas(run, f"{key} {kind}, pos int, chunk string")


def chunked(df: DataFrame, key: str, text: str, size: int = 4000, overlap: int = 200, tokens: bool = False, path: str | None = None) -> DataFrame:
    """key, pos, chunk: by characters, by ``tokens`` of four characters, or by those of the vocabulary file ``path``."""
    cut = token_chunks if tokens else char_chunks
    if path is not None:
        cut = lambda x, n, m: vocabulary.chunks(x, path, n, m)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in it:
            rows = [(k, i, c) for k, t in zip(p[key], p[text], strict=True) for i, c in enumerate(cut(t or "", size, overlap))]
            yield pd.DataFrame(rows, columns=[key, "pos", "chunk"])

    kind = dict(df.dtypes)[key]
    return df.select(key, text).mapInPandas(run, f"{key} {kind}, pos int, chunk string")


def budgeted(parts: DataFrame, key: str, budget: int, order: tuple[str, ...] = PRIORITY, least: int = 500) -> DataFrame:
    """Rows (key, section, tokens) with ``take``: tokens in the order of sections while the budget lasts. A section that does not fit is cut
    to what is left; where that is below ``least``, the section and all after it go."""
    from pyspark.sql.window import Window

    rank = F.lit(len(order))
    for i, s in enumerate(order):
        rank = F.when(F.col("section") == s, i).otherwise(rank)
    w = Window.partitionBy(key).orderBy("__o", "section")
    used = F.coalesce(F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = parts.withColumn("__o", rank).withColumn("left", F.lit(budget) - used)
    ends = F.max(((F.col("tokens") > F.col("left")) & (F.col("left") < least)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)) == 1
    take = F.when(ends, 0).otherwise(F.least("tokens", "left"))
    return own.withColumn("take", F.greatest(take, F.lit(0)).cast("long")).drop("__o", "left")


# --- Normalisation and similarity --------------------------------------------------------------

# Characters that count as plain ones, and those that are dropped.
PLAIN = {
    "\u2018": "'", "\u2019": "'", "\u201a": "'", "\u201b": "'",
    "\u201c": '"', "\u201d": '"', "\u201e": '"', "\u201f": '"',
    "\u2013": "-", "\u2014": "-", "\u2012": "-", "\u2015": "-", "\u2212": "-",
    "\u00a0": " ", "\u2007": " ", "\u202f": " ", "\u2009": " ",
}
DROPPED = "\u00ad\u200b"
#: White space, beside what NFKC makes a blank.
BLANKS = r"[\s\x1c-\x1f\x85\u1680\u2028\u2029]+"
_REPLACED = tuple((PLAIN | dict.fromkeys(DROPPED, "")).items())


def normalised(text: str | None) -> str:
    x = text or ""
    if not x.isascii():  # ASCII is composed, and holds nothing to replace
        if not unicodedata.is_normalized("NFKC", x):
            x = unicodedata.normalize("NFKC", x)
        for old, new in _REPLACED:
            x = x.replace(old, new)
    return " ".join(x.lower().split())


@lru_cache(1)
def uncomposed() -> str:
    """Every code point that NFKC changes, puts into another order or joins with the one before: a text without any is in that form already."""
    points = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    odd = {c for c in points if unicodedata.combining(x := chr(c)) or unicodedata.normalize("NFKC", x) != x or 0x1161 <= c <= 0x1175 or 0x11A8 <= c <= 0x11C2}
    # what joins without a class of its own: the second half of a pair that composes
    odd |= {ord(d[1]) for c in points if len(d := unicodedata.normalize("NFD", chr(c))) == 2 and unicodedata.normalize("NFC", d) == chr(c)}
    return "".join(map(chr, sorted(odd)))


def nfkc(c: Column) -> Column:
    """NFKC. Texts that are in that form already, as nearly all are, are told in the JVM, ASCII by its length in bytes and others by one look-up a character, and stay there;
    Python is handed the others only, and nulls in place of these."""

    @F.pandas_udf("string")
    def compose(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))

    odd = F.when(F.octet_length(c) == F.length(c), False).otherwise(F.length(F.translate(c, uncomposed(), "")) < F.length(c))
    return F.when(odd, compose(F.when(odd, c))).otherwise(c)


def normalise(c: Column, compose: bool = False) -> Column:
    """``normalised`` as a column, for texts that are composed already, or with ``compose`` for any; null stays null."""
    v = F.translate(nfkc(c) if compose else c, "".join(PLAIN) + DROPPED, "".join(PLAIN.values()))
    return F.trim(F.regexp_replace(F.lower(v), BLANKS, " "))


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | (1 << i)
    full, v = (1 << len(a)) - 1, (1 << len(a)) - 1
    for ch in b:
        u = v & where.get(ch, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def ratio(a: str, b: str) -> float:
    """Indel similarity, 0 to 100."""
    return 100.0 if not a and not b else 200.0 * lcs(a, b) / (len(a) + len(b))


def _codes(a: str, b: str) -> tuple[np.ndarray, np.ndarray]:
    """Both texts as numbers; characters of ``b`` that ``a`` lacks are -1."""
    x, y = (np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in (a, b))
    known, own = np.unique(x, return_inverse=True)
    at = np.minimum(np.searchsorted(known, y), len(known) - 1)
    return own.astype(np.int32), np.where(known[at] == y, at, -1).astype(np.int32)


def window_lcs(pairs: list[tuple[str, str]]) -> list[np.ndarray]:
    """For each (a, b), where every ``a`` has one length: length of the longest common subsequence of ``a`` with each window of ``b`` as long
    as ``a``; the first window holds only the first character of ``b``, the last one only its last.

    Semi-local LCS by combing: strands run from the top of the grid of ``a`` and ``b`` to its bottom, two that have crossed or meet at equal
    characters turn, and a window's LCS is its length less the strands that begin and end inside it. A window lies in one block of 2n - 1
    characters; all blocks of all pairs are combed at once, one antidiagonal a step.
    """
    n = len(pairs[0][0])
    size, kind = 2 * n - 1, np.int16 if 3 * n < 32_000 else np.int32
    counts = [-(-(len(b) + n - 1) // n) for _, b in pairs]
    text, word, at, blocks = np.empty((size, sum(counts)), kind), np.empty((n, sum(counts)), kind), 0, sum(counts)
    for (a, b), k in zip(pairs, counts, strict=True):
        x, y = _codes(a, b)
        padded = np.full((k + 1) * n, -1, np.int32)
        padded[n - 1 : n - 1 + len(b)] = y
        text[:, at : at + k] = np.lib.stride_tricks.sliding_window_view(padded, size)[: k * n : n].T
        word[:, at : at + k] = x[::-1, None]
        at += k
    text, word = text.ravel(), word.ravel()
    h, v = np.repeat(np.arange(n, dtype=kind), blocks), np.repeat(np.arange(n, n + size, dtype=kind), blocks)
    for d in range(n + size - 1):
        last, first = min(n - 1, d), max(0, d - size + 1)
        i, j = slice((n - 1 - last) * blocks, (n - first) * blocks), slice((d - last) * blocks, (d - first + 1) * blocks)
        left, top = h[i], v[j]
        turned = np.minimum(left, top)
        np.copyto(turned, top, where=word[i] == text[j])
        top += left
        top -= turned
        left[:] = turned
    begin, low = v.reshape(size, blocks).astype(np.int64) - n, np.maximum(np.arange(size)[:, None] - n + 1, 0)
    e, k = np.nonzero(begin >= low)
    inside = np.bincount(k * (size + 2) + low[e, 0], minlength=blocks * (size + 2)) - np.bincount(k * (size + 2) + begin[e, k] + 1, minlength=blocks * (size + 2))
    found = (n - np.cumsum(inside.reshape(blocks, size + 2), axis=1)[:, :n]).ravel()
    ends = np.cumsum(counts) * n
    return [found[end - c * n :][: len(b) + n - 1] for (_, b), c, end in zip(pairs, counts, ends, strict=True)]


#: Bits of a machine word that hold characters; the one above takes the carry.
BITS = 63
#: Length up to which the shorter text is compared by bits; beyond, combing costs less.
BY_BITS = 4 * BITS
#: Windows that are bounded together, by the stretch that holds them all.
STRIDE = 8
#: Characters of longer texts, and windows, that are worked on at once: small enough for the caches, large enough to outweigh a step's fixed cost.
CHARACTERS, WINDOWS = 150_000, 16_000


@lru_cache(1)
def _rows() -> np.ndarray:
    """For each code point the row of a pair's table of bits; all 0 between calls."""
    return np.zeros(0x110000, np.int16)


def _bits(pairs: list[tuple[str, str]], rooms: list[int]) -> np.ndarray:
    """(words, sum of ``rooms``): for each character of each ``b`` the places at which its ``a`` has it, as bits; none in the rest of its room."""
    n, rows, at = len(pairs[0][0]), _rows(), 0
    place = np.arange(n)
    word, bit, number = place // BITS, np.uint64(1) << (place % BITS).astype(np.uint64), (place + 1).astype(np.int16)
    out = np.zeros((-(-n // BITS), sum(rooms)), np.uint64)
    for (a, b), room in zip(pairs, rooms, strict=True):
        x, y = (np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in (a, b))
        rows[x] = number
        table = np.zeros((len(out), n + 1), np.uint64)
        np.bitwise_or.at(table, (word, rows[x]), bit)
        own = rows[y].astype(np.intp)
        for w, t in enumerate(table):
            np.take(t, own, out=out[w, at : at + len(b)], mode="clip")
        rows[x] = 0
        at += room
    return out


def _advance(v: np.ndarray, steps: Iterable[Iterable[np.ndarray]]) -> Iterator[None]:
    """Hyyrö's rows of the longest common subsequence for many pairs at once: ``steps`` gives, for each next character, the bits of each word. The zeros in ``v`` are the length so far."""
    full, shift = np.uint64((1 << BITS) - 1), np.uint64(BITS)
    u, x, carry = (np.empty_like(v[0]) for _ in range(3))
    for masks in steps:
        for w, m in enumerate(masks):
            np.bitwise_and(v[w], m, out=u)
            np.bitwise_xor(v[w], u, out=x)
            np.add(v[w], u, out=u)
            if w:
                np.add(u, carry, out=u)
            if w + 1 < len(v):
                np.right_shift(u, shift, out=carry)
                np.bitwise_and(u, full, out=u)
            np.bitwise_or(u, x, out=v[w])
        yield


def _start(words: int, n: int) -> np.ndarray:
    v = np.full((words, n), (1 << BITS) - 1, np.uint64)
    v[-1] = (1 << BITS + 1) - 1
    return v


def _found(v: np.ndarray) -> np.ndarray:
    return BITS * len(v) + 1 - np.bitwise_count(v).sum(axis=0, dtype=np.int64)


def _ends(pairs: list[tuple[str, str]]) -> np.ndarray:
    """For each (a, b) the best ratio of ``a``, all of one length, with a part of ``b`` that is shorter and stands at its beginning or end."""
    n, best = len(pairs[0][0]), np.zeros(len(pairs))
    if n > 1:
        for side in ([(a, b[: n - 1]) for a, b in pairs], [(a[::-1], b[: -n : -1]) for a, b in pairs]):
            m = _bits(side, [n - 1] * len(side)).reshape(-1, len(side), n - 1).transpose(2, 0, 1).copy()
            v = _start(m.shape[1], len(side))
            for i, _ in enumerate(_advance(v, m), 1):
                np.maximum(best, 200.0 * _found(v) / (n + i), out=best)
    return best


def _best(pairs: list[tuple[str, str]], best: np.ndarray) -> np.ndarray:
    """For each (a, b), where every ``a`` has one length and no ``b`` is shorter, the best ratio of ``a`` with a window of ``b`` as long as it, or ``best`` if that is more.

    ``STRIDE`` windows that follow each other lie in one stretch, whose longest common subsequence with ``a`` bounds theirs. All stretches are
    measured; then each pair's best one is, window by window, and after that those that may hold more than what is found.
    """
    n = len(pairs[0][0])
    windows = np.array([len(b) - n + 1 for _, b in pairs])
    rooms = [-(-(len(b) + STRIDE - 1) // STRIDE) * STRIDE for _, b in pairs]
    bits = _bits(pairs, rooms)
    columns = bits.reshape(len(bits), -1, STRIDE).transpose(0, 2, 1).copy()
    steps = n + STRIDE - 1
    size = columns.shape[2] - (steps - 1) // STRIDE
    v = _start(len(bits), size)
    for _ in _advance(v, (columns[:, t % STRIDE, t // STRIDE : t // STRIDE + size] for t in range(steps))):
        pass
    counts = -(-windows // STRIDE)
    begin = np.cumsum([0, *rooms[:-1]])
    pair = np.repeat(np.arange(len(pairs)), counts)
    offset = np.arange(len(pair)) - np.repeat(np.cumsum(counts) - counts, counts)
    bound = _found(v)[begin[pair] // STRIDE + offset]

    def measure(some: np.ndarray) -> None:
        for at in range(0, len(some), WINDOWS // STRIDE):
            part = some[at : at + WINDOWS // STRIDE]
            first = (offset[part, None] * STRIDE + np.arange(STRIDE)).ravel()
            own = np.repeat(pair[part], STRIDE)
            own, first = own[there := first < windows[own]], first[there]
            where, v = begin[own] + first, _start(len(bits), len(own))
            for _ in _advance(v, ([word[where + t] for word in bits] for t in range(n))):
                pass
            np.maximum.at(best, own, 200.0 * _found(v) / (2 * n))

    order = np.lexsort((-bound, pair))
    top = order[np.cumsum(counts) - counts]
    first = np.zeros(len(pair), bool)
    first[top] = True
    for some in (first, ~first):
        measure(np.flatnonzero(some & (200.0 * bound / (2 * n) > best[pair])))
    return best


#: Cells of an antidiagonal that are combed at once: small enough for the caches, large enough to outweigh a step's fixed cost.
CELLS = 60_000


def partial_ratios(pairs: list[tuple[str, str]], floor: float = 0.0) -> list[float]:
    """``partial_ratio`` of each pair, those of one length together; what is at most ``floor`` may be given as any number up to it."""
    out, by = [0.0] * len(pairs), {}
    for i, (a, b) in enumerate(pairs):
        a, b = (b, a) if len(a) > len(b) else (a, b)
        if a in b:
            out[i] = 100.0 if a or not b else 0.0
        else:
            by.setdefault(len(a), []).append((i, a, b))
    for n, own in by.items():
        if n <= BY_BITS:
            ends = np.concatenate([_ends([x[1:] for x in own[i : i + 1000]]) for i in range(0, len(own), 1000)])
            ends = np.maximum(ends, floor)
            sizes = np.cumsum([len(x[2]) for x in own]) // CHARACTERS
            cuts = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), len(own)]
            for x, y in itertools.pairwise(cuts):
                for (i, _, _), score in zip(own[x:y], _best([z[1:] for z in own[x:y]], ends[x:y]).tolist(), strict=True):
                    out[i] = score
            continue
        while own:
            take, cells = [], 0
            while own and (not take or cells < CELLS):
                take.append(own.pop())
                cells += len(take[-1][2]) + n
            for (i, _, b), lcs_ in zip(take, window_lcs([x[1:] for x in take]), strict=True):
                start = np.arange(1 - n, len(b))
                sizes = np.minimum(start + n, len(b)) - np.maximum(start, 0)
                out[i] = float((200.0 * lcs_ / (n + sizes)).max())
    return out


def partial_ratio(a: str, b: str) -> float:
    """The best ``ratio`` of the shorter string with a window of the longer, of its length or cut off at an end."""
    return partial_ratios([(a, b)])[0]


def token_set_ratio(a: str, b: str) -> float:
    """The best ratio between the sorted common words and either side's words."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    if both and (not x - y or not y - x):
        return 100.0
    left = " ".join([both, *sorted(x - y)]).strip()
    right = " ".join([both, *sorted(y - x)]).strip()
    return max(ratio(both, left) if both else 0.0, ratio(both, right) if both else 0.0, ratio(left, right))


# --- Lenient JSON, lexicon ---------------------------------------------------------------------


def lenient_json(c: Column, schema: str) -> Column:
    """The text itself, what stands in a code fence, or what stands between the outermost braces; NULL where none parses."""
    fence = F.regexp_extract(c, r"(?s)```(?:json)?\s*(.*?)```", 1)
    braces = F.regexp_extract(c, r"(?s)(\{.*\})", 1)
    whole = lambda x: F.when(F.trim(x).startswith("{") & F.trim(x).endswith("}") & F.expr("true"), F.from_json(x, schema, {"mode": "PERMISSIVE"}))
    return F.coalesce(whole(c), whole(fence), whole(braces))


#: Distinct words with a listed stem that may be broadcast; counted before.
STEMMED = 200_000


def stemmed(words: DataFrame, word: str = "word", out: str = "stem") -> DataFrame:
    """The distinct ``word`` with their stems: Python sees each word once, however often it stands."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            yield p.assign(**{out: [stem(x) for x in p[word]]})

    return words.select(word).where(F.col(word).isNotNull()).distinct().mapInPandas(run, f"{word} string, {out} string")


def lexicon_counts(df: DataFrame, key: str, text: str, lexicon: DataFrame, stems: bool = False) -> DataFrame:
    """key, n_words, pos, neg: words (runs of letters) that the lexicon (word, polarity 1 or -1) lists; with ``stems``, words whose stems are a listed word's (of two polarities
    of one stem the positive). The lexicon is a small dimension."""
    words = df.select(key, F.explode_outer(F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0))).alias("word"))
    if stems:
        listed = lexicon.join(stemmed(lexicon), "word").groupBy("stem").agg(F.max("polarity").alias("polarity"))
        hits = stemmed(words).join(small(listed), "stem").select("word", "polarity")
        hit = words.join(F.broadcast(hits) if hits.limit(STEMMED + 1).count() <= STEMMED else hits, "word", "left")
    else:
        hit = words.join(small(lexicon), "word", "left")
    return hit.groupBy(key).agg(F.count("word").alias("n_words"), F.count(F.when(F.col("polarity") > 0, 1)).alias("pos"), F.count(F.when(F.col("polarity") < 0, 1)).alias("neg"))
