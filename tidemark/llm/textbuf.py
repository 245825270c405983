"""Arrow string columns as numpy arrays: whole batches are hashed at once, without a Python loop over words."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import lru_cache, wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes that are worked on at a time; a longer text is one piece of its own.
PIECE = 1 << 18


def trim() -> None:
    """Gives memory that the process has freed back to the system: a worker lives on, and executors have little beside their heap."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # another C library: it keeps what it keeps
        pass


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, a map over batches, with ``trim`` before and after."""

    @wraps(run)
    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        yield from run(batches)
        trim()

    return own


def utf8(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All texts' UTF-8 bytes end to end, and the offsets (one more than texts). Null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_string()), "")
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = col.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), off


def pieces(off: np.ndarray, most: int = PIECE) -> Iterator[tuple[int, int]]:
    """Runs of texts [a, b) of at most ``most`` bytes together, one text at least."""
    a, n = 0, len(off) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + most, side="right")) - 1)
        yield a, min(b, n)
        a = b


@lru_cache(2)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    n, base = 1 << bits, 0x9E3779B97F4A7C15
    up, down = np.full(n, base, np.uint64), np.full(n, pow(base, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


@lru_cache(1)
def _byte_values() -> np.ndarray:
    return np.random.default_rng(20240229).integers(1, 1 << 63, 256, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Words:
    """The words of texts [a, b) of a batch: spans in bytes, 64-bit hashes, and the words of each text.

    ``kind`` has a byte's value as it is hashed, or 0 for bytes that separate words.
    """

    def __init__(self, data: np.ndarray, off: np.ndarray, a: int, b: int, kind: np.ndarray, latin: bool = False) -> None:
        raw = data[off[a] : off[b]]
        val = kind[raw]
        if latin:  # À to Þ in UTF-8
            up = (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[:-1] == 0xC3) & (raw[1:] != 0x97)
            val[1:][up] += 0x20
        n, ends = len(raw), (off[a : b + 1] - off[a]).astype(np.int64)
        word = val != 0
        begins = word.copy()
        begins[1:] &= ~word[:-1]
        heads = ends[:-1][ends[:-1] < n]
        begins[heads] = word[heads]  # a word never spans two texts
        stops = word.copy()
        stops[:-1] &= ~word[1:]
        last = ends[1:][ends[1:] > 0] - 1
        stops[last] = word[last]
        self.start, self.stop = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        self.up, self.down = _powers(max(19, int(n).bit_length()))
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_byte_values()[val] * self.up[:n], out=self.sums[1:])
        self.hash = self.span(self.start, self.stop)
        self.first = np.searchsorted(self.start, ends)  # words of text i: first[i] to first[i + 1]
        self.texts = b - a

    def span(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Hashes of byte spans: equal spans have equal hashes wherever they stand."""
        return mix((self.sums[stop] - self.sums[start]) * self.down[start])

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.texts), np.diff(self.first))


def ascii_lower(separators: bytes) -> np.ndarray:
    """Byte values with A-Z lower-cased; separators are 0."""
    t = np.arange(256).astype(np.uint8)
    t[65:91] += 32
    t[list(separators)] = 0
    return t
