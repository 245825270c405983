"""Periodic runs of words: a Lyndon stack under both orders, extended by rolling-hash comparison.

A run is a stretch of words with smallest period ``q`` that no neighbouring word extends, here at least ``LEAST`` words and ``TIMES``
periods long. Every run has, under one of two opposite orders of the words, a root that is the longest Lyndon word at
its place. So the text is scanned right to left under each order; a stack holds the Lyndon words found so far, and a suffix takes over those that are
greater than itself. Two suffixes are compared by their longest common extension (LCE): some words directly, then by binary search over
equal rolling hashes, and the words so found to agree are compared themselves, so that a chance meeting of hashes costs time and never a
result. What is known of a distance is kept: further left only the new words are compared. Roots that repeat twice are extended both
ways in the same manner, which gives the run. No suffix array is built. Time is some n log n for n words.

One map over whole texts, without a shuffle. A text is worked on whole, with some 200 bytes a word.

Cases: null and empty texts have no words, no runs and the digests of nothing; a null id rewrites nothing (see ``rewritten``); repeated rows are
judged alike; of runs with the greatest exponent the first, then the one of the least period is named; an empty table gives an empty result;
further columns are ignored, and kept by ``collapsed``.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import table, widened
from tidemark.llm.textbuf import mix, trimmed, utf8

#: Least words of a run, and least whole periods.
LEAST, TIMES = 6, 4
#: Words of an extension that are compared one by one before hashes are asked.
DIRECT = 8
_BASE, _MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1
_BACK = pow(_BASE, -1, 1 << 64)


class Extensions:
    """Longest common extensions between positions of one sequence of word numbers."""

    def __init__(self, words: list[int]) -> None:
        self.words, self.n = words, len(words)
        self.array = np.array(words, np.int64)
        self.sums: list[int] | None = None
        self.known: dict[int, tuple[int, int]] = {}  # distance: the leftmost place that was asked, and the end of its agreement

    def _hashed(self) -> None:
        up, down = np.full(self.n, _BASE, np.uint64), np.full(self.n + 1, _BACK, np.uint64)
        up[:1] = down[0] = 1
        sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(mix(self.array.astype(np.uint64) + np.uint64(_BASE)) * np.cumprod(up, dtype=np.uint64), out=sums[1:])
        self.sums, self.down = sums.tolist(), np.cumprod(down, dtype=np.uint64).tolist()

    def _same(self, i: int, j: int, k: int) -> bool:
        s, d = self.sums, self.down
        return ((s[i + k] - s[i]) * d[i] - (s[j + k] - s[j]) * d[j]) & _MASK == 0

    def _verified(self, a: np.ndarray, b: np.ndarray, k: int, most: int) -> int:
        """The true extension of two views, where the hashes say ``k`` of ``most``."""
        if np.array_equal(a[:k], b[:k]) and (k == most or a[k] != b[k]):
            return k
        other = np.flatnonzero(a[:most] != b[:most])
        return int(other[0]) if len(other) else most

    def _search(self, same, most: int) -> int:
        """The greatest k of at most ``most`` with ``same(k)``: steps double, then halve."""
        low, high = 0, 2 * DIRECT
        while high < most and same(high):
            low, high = high, 2 * high
        high = min(high, most + 1)
        while high - low > 1:
            mid = (low + high) // 2
            if same(mid):
                low = mid
            else:
                high = mid
        return low

    def ahead(self, i: int, j: int) -> int:
        """How many words from ``i`` and from ``j`` on agree (i < j)."""
        w, n = self.words, self.n
        stop = min(j + DIRECT, n)
        k = j
        while k < stop and w[i + k - j] == w[k]:
            k += 1
        if k < stop or k == n:
            return k - j
        d = j - i
        at, end = self.known.get(d, (n, n))
        if at <= i <= end:
            return end - i
        if self.sums is None:
            self._hashed()
        most = min(n - j, at - i) if at > i else n - j
        got = self._verified(self.array[i:], self.array[j:], self._search(lambda m: self._same(i, j, m), most), most)
        if at > i and got == at - i:
            got = end - i
        self.known[d] = (i, i + got)
        return got

    def behind(self, i: int, j: int) -> int:
        """How many words before ``i`` and before ``j`` agree (i < j)."""
        w, k = self.words, 0
        while k < i and k < DIRECT and w[i - 1 - k] == w[j - 1 - k]:
            k += 1
        if k < DIRECT or k == i:
            return k
        if self.sums is None:
            self._hashed()
        found = self._search(lambda m: self._same(i - m, j - m, m), i)
        return self._verified(self.array[:i][::-1], self.array[j - i : j][::-1], found, i)


def lyndon(words: list[int], ext: Extensions) -> np.ndarray:
    """Length of the longest Lyndon word at each place. Of ``words`` the last is less than all others and stands behind the text."""
    n = len(words) - 1
    out, stack = [0] * n, [n]
    ahead, pop, push = ext.ahead, stack.pop, stack.append
    for i in range(n - 1, -1, -1):
        a = words[i]
        while True:
            j = stack[-1]
            b = words[j]
            if a < b:
                pop()
            elif a > b:
                break
            else:
                k = ahead(i, j)
                if words[i + k] < words[j + k]:
                    pop()
                else:
                    break
        out[i] = j - i
        push(i)
    return np.array(out, np.int64)


def runs(words: list[int], least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of at least ``least`` words and ``times`` periods (two at least), by start, then period. ``words``: numbers from 0 on, equal for equal words."""
    n = len(words)
    if n < max(least, times):
        return []
    ext, most = Extensions(words), max(words)
    found: dict[tuple[int, int], int] = {}
    array = ext.array
    at = np.arange(n)
    for order in (words, [most - x for x in words]):
        size = lyndon([*order, -1], ext)
        again = at + size
        ok = again < n
        ok[ok] = array[again[ok]] == array[at[ok]]  # the root's first word comes again
        if times >= 3:
            ok[ok] = size[again[ok]] == size[ok]  # the root itself does
        past: dict[int, int] = {}
        for i, q in zip(np.flatnonzero(ok).tolist(), size[ok].tolist(), strict=True):
            if i + q <= past.get(q, 0):
                continue  # a root of the run before
            right = ext.ahead(i, i + q)
            left = ext.behind(i, i + q)
            past[q] = i + q + right
            if left + q + right >= max(least, times * q):
                found[i - left, q] = left + q + right
    return [(s, found[s, q], q) for s, q in sorted(found)]


def numbered(words: list[bytes]) -> list[int]:
    """Numbers from 0 on in order of first sight, equal for equal words."""
    number = {x: k for k, x in enumerate(dict.fromkeys(words))}
    return [number[x] for x in words]


def rewritten(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The contract's test pattern: where crc32 of the id ends in 0, the words from some place on repeat."""
    n = len(words)
    h = 0 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a : a + p]
    return words[:a] + (unit * ((n - a) // p + 1))[: n - a]


def kept(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that repeat a run's first period."""
    if not found:
        return words
    gone = np.zeros(len(words), bool)
    for s, size, q in found:
        gone[s + q : s + size] = True
    return [w for w, out in zip(words, gone.tolist(), strict=True) if not out]


def texts(col: pa.Array) -> Iterator[list[bytes]]:
    """The words of each text: runs of bytes other than ASCII white space."""
    data, off = utf8(col)
    for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
        yield data[a:b].tobytes().split()


def collapsed(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """``docs`` with every run of words cut to its first period, words joined by one space; a text without runs and a null stay as they are, and so do all other columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            out = []
            for text, words in zip(batch.column(at), texts(batch.column(at)), strict=True):
                found = runs(numbered(words), least, times)
                out.append(b" ".join(kept(words, found)).decode("utf-8", "replace") if found else text.as_py())
            yield batch.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type))

    return docs.mapInArrow(trimmed(run), docs.schema)


_REPORT = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, rows = batch.column("doc_id").to_pylist(), []
        for i, words in zip(ids, texts(batch.column("text")), strict=True):
            words = rewritten(words, i)
            found = runs(numbered(words))
            best: tuple[int | None, ...] = (None,) * 3
            for run in found:  # by start, then period: only a greater exponent takes over
                if best[0] is None or run[1] * best[2] > best[1] * run[2]:
                    best = run
            lines = hashlib.sha256("".join(f"{s},{size},{q}\n" for s, size, q in found).encode()).hexdigest()
            text = hashlib.sha256(b" ".join(kept(words, found))).hexdigest()
            rows.append((len(found), *best, None if best[0] is None else 1000 * best[1] // best[2], lines, text))
        cols = list(zip(*rows, strict=True)) or [()] * 7
        kinds = [pa.int64()] * 5 + [pa.string()] * 2
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=["doc_id", *(x.split()[0] for x in _REPORT.split(", "))])


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256 of the texts as ``rewritten``."""
    own = docs.select("doc_id", "text")
    return own.mapInArrow(trimmed(_report), widened(own.select("doc_id"), _REPORT))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))
