"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

The pre-tokeniser's pattern (contractions, letters, digits, other characters, white space) is run as an automaton without
a regex. Every code point has a class; every class is a function from states to states; and since composition
of functions is associative, a text is cut into equal blocks whose functions are composed side by side, a column of
all blocks at a time. As soon as every block's function is constant (it is after a character or two), only its value is
carried on. The blocks' entry states follow from their predecessors, and a second, short pass fills in the columns before
that point. The states, with one character of look-ahead, give all token starts of a piece at once.

The slices between starts are looked up in a bounded cache. Those that are missing are merged together, one leftmost
lowest-ranked pair of each slice a round, over flat arrays; slices over ``LONG`` bytes by a heap. Ids, and
their byte offsets in the text, come out; decoding joins the ids' bytes.

Cases: null and empty texts have no ids and decode to no bytes; bytes are never lost, so decoding gives every text back
exactly; bytes that are no UTF-8 are read as U+FFFD; repeated texts encode alike; very long texts are a piece of their own; an empty table gives an empty result;
further columns are ignored, and kept by ``encoded``.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import table, widened
from tidemark.llm.textbuf import pieces, trimmed, utf8

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Slices that a worker remembers, and the bytes from which a slice is merged by a heap.
CACHE, LONG = 250_000, 48

# Classes of code points. Letters that contractions need have classes of their own.
OTHER, LETTER, DIGIT, BLANK, SPACE, QUOTE, STDM, RV, E, L_, BREAK = range(11)
# States after a character: in which token it stands. APOS: an apostrophe that begins a token; AP_RV, AP_L: it is
# followed by r or v, or by l, and a contraction if e, or l, comes next; DONE: a contraction has ended; NONE: text begins.
S_OTHER, S_LETTER, S_DIGIT, S_BLANK, S_SPACE, APOS, AP_RV, AP_L, DONE, NONE = range(10)


@lru_cache(1)
def classes() -> np.ndarray:
    """Class of every code point. White space is the Unicode property (so not U+001C to U+001F)."""
    t = np.zeros(0x110000, np.uint8)
    kinds = {"L": LETTER, "N": DIGIT}
    t[:] = [kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)]
    t[[9, 10, 11, 12, 13, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = SPACE
    t[32], t[39] = BLANK, QUOTE
    for ch, k in (("stdm", STDM), ("rv", RV), ("e", E), ("l", L_)):
        t[[ord(x) for x in ch]] = k
    return t


def _functions() -> np.ndarray:
    """f[class, state] = next state; 16 columns, of which 10 are used."""
    f = np.zeros((11, 16), np.uint8)
    for c, s in ((OTHER, S_OTHER), (LETTER, S_LETTER), (DIGIT, S_DIGIT), (BLANK, S_BLANK), (SPACE, S_SPACE), (BREAK, NONE)):
        f[c] = s
    f[QUOTE] = APOS
    f[QUOTE, [S_OTHER, S_BLANK, APOS]] = S_OTHER
    for c in (STDM, RV, E, L_):
        f[c] = S_LETTER
    f[STDM, APOS] = DONE
    f[RV, APOS], f[L_, APOS] = AP_RV, AP_L
    f[E, AP_RV] = f[L_, AP_L] = DONE
    return f


F_ = _functions()


def states(cls: np.ndarray, width: int = 64) -> np.ndarray:
    """The state after every character, from NONE, by a blocked scan of composed transition functions."""
    n = len(cls)
    blocks = -(-n // width)
    if not blocks:
        return np.zeros(0, np.uint8)
    padded = np.full(blocks * width, BREAK, np.uint8)
    padded[:n] = cls
    by = np.ascontiguousarray(padded.reshape(blocks, width).T).astype(np.intp) * 16  # a column of all blocks is a row here
    flat = F_.ravel()
    out = np.empty((width, blocks), np.uint8)
    fn = np.tile(np.arange(10, dtype=np.intp), (blocks, 1))
    t = 0
    while t < width and not (fn == fn[:, :1]).all():
        fn = flat[by[t][:, None] + fn].astype(np.intp)
        t += 1
    rest, cur = t, fn[:, 0]
    if rest < width or (fn == fn[:, :1]).all():
        for t in range(rest, width):
            cur = flat[by[t] + cur].astype(np.intp)
            out[t] = cur
        entry = np.concatenate([[NONE], cur[:-1]]).astype(np.intp)
    else:  # some block's function is not constant: compose over the blocks
        entry = np.empty(blocks, np.intp)
        s = NONE
        for b in range(blocks):
            entry[b] = s
            s = int(fn[b, s])
    for t in range(rest):
        entry = flat[by[t] + entry].astype(np.intp)
        out[t] = entry
    return np.ascontiguousarray(out.T).ravel()[:n]


def starts(codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Positions at which tokens start in texts laid end to end; ``first``: where texts start."""
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64)
    cls = classes()[codes]
    # a break stands before every text, so that nothing reaches over from the one before it
    where = np.unique(first[first < n])
    wide = np.insert(cls, where, BREAK)
    at = np.ones(len(wide), bool)
    at[where + np.arange(len(where))] = False
    st = states(wide)
    prev = np.concatenate([[NONE], st[:-1]]).astype(np.uint8)
    prev_in = prev[at]
    now = st[at]
    kind = np.array([S_OTHER, S_LETTER, S_DIGIT, S_BLANK, S_SPACE, S_OTHER, S_LETTER, S_LETTER, S_LETTER, S_LETTER, NONE], np.uint8)[cls]
    white = (cls == BLANK) | (cls == SPACE)
    was_white = (prev_in == S_BLANK) | (prev_in == S_SPACE)
    head = prev_in == NONE
    follows = np.zeros(n, bool)  # a character of the same text that is not white comes next
    follows[:-1] = ~white[1:] & ~head[1:]
    out = head.copy()
    out |= white & (~was_white | follows)
    letter, digit, other = kind == S_LETTER, kind == S_DIGIT, kind == S_OTHER
    pending = (now == AP_RV) | (now == AP_L)
    joins = (prev_in == S_LETTER) | (prev_in == AP_RV) | (prev_in == AP_L) | (prev_in == S_BLANK)
    joins |= (prev_in == APOS) & ((now == DONE) | pending)
    out |= letter & ~joins
    out |= digit & ~((prev_in == S_DIGIT) | (prev_in == S_BLANK))
    out |= other & ~((prev_in == S_OTHER) | (prev_in == APOS) | (prev_in == S_BLANK))
    # 'r, 'v or 'l that did not become a contraction: the letter began a token
    nxt = np.full(n, NONE, np.uint8)
    nxt[:-1] = np.where(head[1:], NONE, now[1:])
    out |= pending & (nxt != DONE)
    return np.flatnonzero(out)


class Codec:
    """Ranks of a vocabulary file, its merges, and a bounded cache of encoded slices."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        size = max(self.ranks.values()) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for k, v in self.ranks.items():
            self.bytes_of[v] = k
        self.decimal = {str(v).encode(): k for k, v in self.ranks.items()}
        self.byte_ids = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)
        keys, ranks = [], []
        for word, rank in self.ranks.items():
            for cut in range(1, len(word)):
                a, b = self.ranks.get(word[:cut]), self.ranks.get(word[cut:])
                if a is not None and b is not None:
                    keys.append((a << 20) | b)
                    ranks.append(rank)
        order = np.argsort(np.array(keys, np.int64))
        self.keys, self.key_ranks = np.array(keys, np.int64)[order], np.array(ranks, np.int64)[order]
        self.cache: dict[str, bytes] = {}

    def _pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left << 20) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.key_ranks[at], np.iinfo(np.int64).max)

    def _pair_rank(self, left: int, right: int) -> int | None:
        key = (left << 20) | right
        at = int(np.searchsorted(self.keys, key))
        return int(self.key_ranks[at]) if at < len(self.keys) and self.keys[at] == key else None

    def merge_all(self, words: Sequence[bytes]) -> list[list[int]]:
        """Ids of every word: all words at once, one merge of each a round."""
        out: list[list[int] | None] = [None] * len(words)
        live = []
        for i, w in enumerate(words):
            whole = self.ranks.get(w)
            if whole is not None:
                out[i] = [whole]
            elif len(w) > LONG:
                out[i] = self.merge_long(w)
            else:
                live.append(i)
        if live:
            lens = np.array([len(words[i]) for i in live])
            ids = self.byte_ids[np.frombuffer(b"".join(words[i] for i in live), np.uint8)]
            word = np.repeat(np.arange(len(live)), lens)
            none = np.iinfo(np.int64).max
            while len(ids):
                rank = np.full(len(ids), none)
                same = word[1:] == word[:-1]
                rank[:-1][same] = self._pair_ranks(ids[:-1][same], ids[1:][same])
                begin = np.flatnonzero(np.concatenate([[True], ~same]))
                least = np.minimum.reduceat(rank, begin)
                ends = np.append(begin[1:], len(ids))
                done = least == none
                for j in np.flatnonzero(done):
                    out[live[word[begin[j]]]] = ids[begin[j] : ends[j]].tolist()
                sizes = ends - begin
                hit = (rank == np.repeat(least, sizes)) & ~np.repeat(done, sizes)
                pos = np.flatnonzero(hit)
                _, one = np.unique(word[pos], return_index=True)  # the leftmost of each word
                pos = pos[one]
                ids[pos] = rank[pos]
                keep = ~np.repeat(done, sizes)
                keep[pos + 1] = False
                ids, word = ids[keep], word[keep]
        return out  # type: ignore[return-value]

    def merge_long(self, w: bytes) -> list[int]:
        """Ids of one word, by a heap of pairs: n log n steps."""
        ids = [int(self.byte_ids[b]) for b in w]
        n = len(ids)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        every = np.array(ids, np.int64)
        first = self._pair_ranks(every[:-1], every[1:]).tolist()
        none = np.iinfo(np.int64).max
        heap = [(r, i, ids[i], ids[i + 1]) for i, r in enumerate(first) if r != none]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j], after[i] = r, False, after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if 0 <= x and y < n and (q := self._pair_rank(ids[x], ids[y])) is not None:
                    heapq.heappush(heap, (q, x, ids[x], ids[y]))
        return [ids[i] for i in range(n) if alive[i]]

    def learn(self, slices: Sequence[str]) -> dict[str, bytes]:
        """The decimal ids, joined by blanks, of slices that the cache lacks; the cache stays bounded."""
        new = {s: " ".join(map(str, ids)).encode() for s, ids in zip(slices, self.merge_all([s.encode() for s in slices]), strict=True)}
        if len(self.cache) + len(new) > CACHE:
            self.cache.clear()
        if len(new) <= CACHE:
            self.cache.update(new)
        return new

    def encode_column(self, col: pa.Array) -> Iterator[bytes]:
        """The decimal ids of every text of a column, joined by blanks."""
        data, off = utf8(col)
        for a, b in pieces(off):
            raw, own = data[off[a] : off[b]], off[a : b + 1] - off[a]
            try:
                text = raw.tobytes().decode("utf-8")
            except UnicodeDecodeError:  # what is no UTF-8 is read as U+FFFD
                fixed = [raw[s:e].tobytes().decode("utf-8", "replace").encode() for s, e in zip(own.tolist(), own.tolist()[1:], strict=False)]
                raw, own = np.frombuffer(b"".join(fixed), np.uint8), np.cumsum([0, *map(len, fixed)])
                text = raw.tobytes().decode("utf-8")
            chars = np.zeros(len(raw) + 1, np.int64)
            np.cumsum((raw & 0xC0) != 0x80, out=chars[1:])
            at = chars[own]
            begin = starts(np.frombuffer(text.encode("utf-32-le"), np.uint32), at[:-1])
            cuts = [*begin.tolist(), len(text)]
            slices = [text[i:j] for i, j in zip(cuts, cuts[1:], strict=False)]
            found = list(map(self.cache.get, slices))
            if None in found:
                lack = list({s for s, v in zip(slices, found, strict=True) if v is None})
                new = self.learn(lack)
                found = [v if v is not None else new[s] for s, v in zip(slices, found, strict=True)]
            first = np.searchsorted(begin, at).tolist()
            for i in range(b - a):
                yield b" ".join(found[first[i] : first[i + 1]])

    def encode(self, text: str | None) -> list[int]:
        return [int(x) for x in next(iter(self.encode_column(pa.array([text], pa.string())))).split()]

    def offsets(self, ids: Sequence[int]) -> list[tuple[int, int]]:
        """Byte spans of ids in their text."""
        ends = np.cumsum([len(self.bytes_of[i]) for i in ids]).tolist()
        return list(zip([0, *ends[:-1]], ends, strict=True)) if ids else []

    def decode(self, ids: Sequence[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decode_decimal(self, joined: bytes) -> bytes:
        return b"".join(map(self.decimal.__getitem__, joined.split()))


@lru_cache(2)
def codec(path: str) -> Codec:
    """One codec a worker process; the file is read where the task runs."""
    return Codec(path)


def vocabulary(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoded(docs: DataFrame, path: str | None = None, digests: bool = False) -> DataFrame:
    """``docs`` with ids (array of int); or, with ``digests``, n_tokens and the SHA-256 of the decimal ids and of the decoded bytes; in place of columns of these names."""
    docs = docs.drop(*(("n_tokens", "ids_sha256", "decoded_sha256") if digests else ("ids",)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path or vocabulary())
        for batch in batches:
            n, ids, back, lists = [], [], [], []
            for joined in own.encode_column(batch.column("text")):
                if digests:
                    n.append(joined.count(b" ") + 1 if joined else 0)
                    ids.append(hashlib.sha256(joined).hexdigest())
                    back.append(hashlib.sha256(own.decode_decimal(joined)).hexdigest())
                else:
                    lists.append(np.array(joined.split(), np.int32) if joined else np.zeros(0, np.int32))
            new = [pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())] if digests else [pa.array(lists, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *added.names])

    added = widened(docs.select(), "n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>")
    return docs.mapInArrow(trimmed(run), widened(docs, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in added.fields)))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encoded(docs, digests=True).drop("text")
