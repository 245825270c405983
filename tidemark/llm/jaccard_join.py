"""N-gram Jaccard self-join by PartEnum signatures: exact, without pairing groups out.

Texts become sets of hashed word shingles; equal sets are one class. Sizes fall in bands whose bounds differ by the
threshold, so that linked sets lie in one band or two neighbouring ones, and differ by at most ``k`` members
(symmetric difference). For each such pair of bands the feature domain is split by a hash into ``k // 2 + 1``
groups of ``parts`` parts. By pigeonhole one group of a linked pair holds at most one differing member, hence all but one of
its parts agree: each subset that leaves one part out is hashed with its features, and linked sets share
a signature. Some groups are spare: with ``s`` of them a linked pair shares ``s + 1`` signatures or more. So a set with at most ``s``
signatures of no feature leaves these out, with at most ``s`` of one or none all those, and so on: they would throw unrelated
texts together. A shared signature has the same features on both sides, so what either side leaves out is what the one that
leaves out more does: at most ``s`` of the shared ones. No pair above the threshold is missed.

Signatures travel packed: a task sorts some hundred thousand (signature, class) entries and sends each slice of the hash
space one row of byte planes, with as many bytes of either as keep chance meetings rare. A chance meeting of signatures costs a check. Classes whose cut keys
meet are a bucket of their own: a signature that only they share has one key, and its bucket would look like one class's. A signature that
many classes of one task share is dealt to other tasks, and a mark is left in its slice. A slice gives its buckets: the classes of one signature,
and buckets of equal members once only.

Classes that share a bucket are candidates, and a bucket may hold very many. Buckets are never paired out:

1. every set is checked against one member only, the centre of most of its buckets (the member whose buckets are
   largest); linked components are formed;
2. buckets whose members are all of one component are finished. In the others, members of different components are compared by parity
   sketches: bit ``j`` tells whether an odd number of features hash to ``j``, so two sketches differ in at most as many
   bits as the sets do in features, and a pair that differs in more is no link;
3. what may still link forms clusters, whose sets meet in blocks of ``BLOCK``; all intersections of a pair of blocks are one product of 0/1
   matrices. Of the links, as of the pairs of step 2, only a spanning forest leaves a task: fewer rows than it read.

So all pairs that share an unfinished bucket have been compared, and components are exact, while copies that link to
their origin cost one check each. Sets are recomputed from the texts of those classes alone that a check needs. Scratch tables go when the
result is written, and shuffle files when their job ends.

Cases: null and empty texts, and texts without a word, have an empty set and link with nothing; a text with fewer words
than a shingle is one shingle; repeated rows are one class; null ids take part in no class and come out alone, with a null
component; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import Work, dealt_join, materialise, table
from tidemark.llm.graph import components
from tidemark.llm.textbuf import Words, ascii_lower, mix, pieces, trimmed, utf8

#: Bytes that separate words, and the byte that stands for NUL, which is a character of words.
KIND = ascii_lower(b"\t\n\x0b\x0c\r ")
KIND[0] = 0xFF
#: One group in so many is spare: a set leaves out signatures of fewest features, as many whole sizes as there are spare groups for.
SPARE = 8
#: Candidate classes that may be broadcast to the texts' scan (counted first); more are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Sets, and bytes of sets, of a block; entries of the 0/1 matrix that a block's sets are spread into at a time.
BLOCK, BLOCK_BYTES, COLUMNS = 1024, 8 << 20, 4 << 20
#: Classes that a task remembers, so that copies in one task give their signatures once.
SEEN = 100_000
#: Entries that a task packs at a time, entries of a slice (about), and classes of one packing from which a signature is dealt to other slices.
PACK, SLICE, MANY = 1 << 18, 1 << 19, 32
#: Bytes of sets or sketches that one pass shuffles, about: work on more is cut into passes, whose shuffle files go one after the other.
PASS = 1 << 30
#: Bits of a parity sketch for each feature of the set, and their least number.
SKETCH, SKETCH_LEAST = 2, 128


def shingles(words: Words, n: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every text."""
    h = words.hash
    out = []
    mult = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]
    full = np.zeros(max(0, len(h) - n + 1), np.uint64)
    for j in range(n):
        full += h[j : j + len(full)] * mult[j % 8] * np.uint64(2 * (j // 8) + 1)
    full = mix(full)
    first = words.first.tolist()
    none = np.zeros(0, np.uint64)
    for i in range(words.texts):
        s, e = first[i], first[i + 1]
        if e - s >= n:
            out.append(np.unique(full[s : e - n + 1]))
        elif e > s:
            short = e - s
            for j in range(s, e):
                short = (short * 0xC2B2AE3D27D4EB4F + int(h[j])) & 0xFFFFFFFFFFFFFFFF
            out.append(mix(np.array([short ^ 0x27D4EB2F165667C5], np.uint64)))
        else:
            out.append(none)
    return out


def fingerprint(s: np.ndarray) -> int:
    """A signed 64-bit hash of a set; 0 is the empty set alone."""
    if not len(s):
        return 0
    f = int(mix(np.array([np.add.reduce(mix(s ^ np.uint64(0x5DEECE66D)))], np.uint64) ^ np.uint64(len(s)))[0].astype(np.int64))
    return f or 1


@lru_cache(4)
def bands(num: int, den: int, upto: int = 1 << 31) -> np.ndarray:
    """Upper bounds of the size bands; the sizes of linked sets lie in one band or two neighbouring ones."""
    out, low = [], 1
    while low <= upto:
        out.append(low * den // num)
        low = out[-1] + 1
    return np.array(out, np.int64)


def differing(high: np.ndarray, num: int, den: int) -> np.ndarray:
    """The largest symmetric difference of linked sets of at most ``high`` members each."""
    return 2 * high * (den - num) // (den + num)


def signatures(sets: list[np.ndarray], num: int, den: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """(set, signature) of all sets, two bands each. Bands in which sets must be equal to link need none."""
    sizes = np.array([len(s) for s in sets], np.int64)
    band = np.searchsorted(bands(num, den), sizes)
    whose, sigs = [], []
    for up in (0, 1):
        tag = band + up
        most = differing(bands(num, den)[tag], num, den)
        live = np.flatnonzero((sizes > 0) & (most > 0))
        if not len(live):
            continue
        spare = (most[live] // 2 + 1) // SPARE
        g, t = most[live] // 2 + 1 + spare, tag[live].astype(np.uint64)
        start = np.concatenate([[0], np.cumsum(g * parts)])
        each = np.repeat(np.arange(len(live)), sizes[live])
        values = np.concatenate([sets[i] for i in live])
        place = start[:-1][each] + (mix(values + (t * np.uint64(0x9E3779B97F4A7C15))[each]) % (g * parts).astype(np.uint64)[each]).astype(np.int64)
        sums = np.zeros(start[-1], np.uint64)
        np.add.at(sums, place, mix(values ^ np.uint64(0xA5A5A5A5A5A5A5A5)))
        held = np.bincount(place, minlength=start[-1]).reshape(-1, parts)
        by = sums.reshape(-1, parts)
        rest = by.sum(1, dtype=np.uint64)[:, None] - by  # of the group, all but one part
        left = held.sum(1)[:, None] - held
        owner = np.repeat(np.arange(len(live)), g)
        drop = np.zeros(left.shape, bool)
        for few in (1, 2, 3):  # as far as the spare groups allow, those of no feature, then those of one, then of two
            drop |= (left < few) & (np.bincount(owner, (left < few).sum(1), minlength=len(live)) <= spare)[owner][:, None]
        within = (np.arange(len(rest)) - (start[:-1] // parts)[owner]).astype(np.uint64)
        salt = (t[owner] << np.uint64(40)) + (within << np.uint64(8))
        sigs.append(mix(rest + mix(salt[:, None] + np.arange(parts, dtype=np.uint64)[None, :]))[~drop])
        whose.append(np.repeat(live[owner], parts).reshape(-1, parts)[~drop])
    if not sigs:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(whose), np.concatenate(sigs)


def linked(common: int, a: int, b: int, num: int, den: int) -> bool:
    return den * common >= num * (a + b - common)


def _sets(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[pa.RecordBatch, int, int, list[np.ndarray]]]:
    for batch in batches:
        data, off = utf8(batch.column("text"))
        for a, b in pieces(off):
            yield batch, a, b, shingles(Words(data, off, a, b, KIND), n)


def sized(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, digest (of the text), n, fp: the size and the class of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, a, b, sets in _sets(batches, n):
            ids, digests = (batch.column(c).slice(a, b - a) for c in ("doc_id", "digest"))
            yield pa.RecordBatch.from_arrays([ids, digests, pa.array([len(s) for s in sets], pa.int64()), pa.array([fingerprint(s) for s in sets], pa.int64())], names=["doc_id", "digest", "n", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("digest")).mapInArrow(trimmed(run), "doc_id long, digest long, n long, fp long")


class Packing:
    """How entries (signature, class) are packed: slices of the hash space, bytes of a signature below its slice, bytes of a class."""

    def __init__(self, classes: int, features: int, num: int, den: int, parts: int) -> None:
        entries = max(1, features) * 4 * parts * (den - num) // (den + num) + 1
        self.bits = max(4, (entries // SLICE).bit_length())
        self.sig_bytes = min(8, max(1, -(-(entries.bit_length() + 12 - self.bits) // 8)))
        self.key_bytes = min(8, max(1, -(-(classes.bit_length() + 7) // 8)))
        self.kept = min(64, self.bits + 8 * self.sig_bytes)

    def key(self, fp: np.ndarray) -> np.ndarray:
        """The low bytes of a class; never 0, which marks a signature that was dealt out."""
        return (fp.astype(np.int64).view(np.uint64) & np.uint64((1 << 8 * self.key_bytes) - 1)) | np.uint64(1)

    def key_column(self, fp: Column) -> Column:
        return fp.bitwiseAND(F.lit((1 << 8 * self.key_bytes) - 1 if self.key_bytes < 8 else -1)).bitwiseOR(F.lit(1))

    def rows(self, sigs: np.ndarray, keys: np.ndarray, salt: int) -> pa.RecordBatch:
        """slice, sigs, keys: one row for each slice. Signatures of many classes go, whole, to slices of their own number and ``salt``."""
        top, cut = np.uint64(64 - self.bits), np.uint64(64 - self.kept)
        sigs = (sigs >> cut) << cut
        order = np.lexsort((keys, sigs))
        sigs, keys = sigs[order], keys[order]
        begin = np.flatnonzero(np.concatenate([[True], sigs[1:] != sigs[:-1]]))
        size = np.diff(np.append(begin, len(sigs)))
        many = np.repeat(size > MANY, size)
        heads = sigs[begin[size > MANY]]
        where = np.concatenate([sigs[~many] >> top, heads >> top, (mix(sigs[many] ^ np.uint64(salt)) >> top) + np.uint64(1 << self.bits)])
        sigs, keys = np.concatenate([sigs[~many], heads, sigs[many]]), np.concatenate([keys[~many], np.zeros(len(heads), np.uint64), keys[many]])
        order = np.argsort(where, kind="stable")
        where, sigs, keys = where[order], sigs[order], keys[order]
        edge = np.append(np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]])), len(where)).tolist()
        own, packed, classes = [], [], []
        for s, e in zip(edge, edge[1:], strict=False):
            at = int(where[s])
            own.append(at)
            packed.append(planes(sigs[s:e], 8) if at >> self.bits else planes((sigs[s:e] << np.uint64(self.bits)) >> np.uint64(64 - 8 * self.sig_bytes), self.sig_bytes))
            classes.append(planes(keys[s:e], self.key_bytes))
        return pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(packed, pa.binary()), pa.array(classes, pa.binary())], names=["slice", "sigs", "keys"])

    def buckets(self, at: int, sigs: list[bytes], keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(bucket, class) of a slice. Buckets of equal members have one number; a signature that was dealt out numbers its own."""
        dealt = bool(at >> self.bits)
        if dealt:
            s = np.concatenate([unplanes(x, 8) for x in sigs])
        else:
            s = np.concatenate([unplanes(x, self.sig_bytes) for x in sigs])
            s = ((s << np.uint64(64 - 8 * self.sig_bytes)) >> np.uint64(self.bits)) | (np.uint64(at) << np.uint64(64 - self.bits))
            s = (s >> np.uint64(64 - self.kept)) << np.uint64(64 - self.kept)
        k = np.concatenate([unplanes(x, self.key_bytes) for x in keys])
        order = np.lexsort((k, s))
        s, k = s[order], k[order]
        keep = np.concatenate([[True], (s[1:] != s[:-1]) | (k[1:] != k[:-1])])
        s, k = s[keep], k[keep]
        begin = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        size = np.diff(np.append(begin, len(s)))
        marked = (k[begin] == 0) | dealt
        number = np.where(marked, mix(s[begin] ^ np.uint64(0x3C6EF372FE94F82B)), mix(np.add.reduceat(mix(k), begin) ^ size.astype(np.uint64)))
        first = np.zeros(len(begin), bool)
        first[np.unique(number, return_index=True)[1]] = True
        goes = np.repeat((marked | (size > 1)) & first, size) & (k != 0)
        return np.repeat(number, size)[goes], k[goes]


def planes(x: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of all values, highest first, plane by plane: sorted values leave the first planes to the shuffle's compression."""
    return np.ascontiguousarray(x.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - width :].T).tobytes()


def unplanes(data: bytes, width: int) -> np.ndarray:
    by = np.frombuffer(data, np.uint8).reshape(width, -1)
    full = np.zeros((by.shape[1], 8), np.uint8)
    full[:, 8 - width :] = by.T
    return full.view(">u8").ravel().astype(np.uint64)


def signed(docs: DataFrame, n: int, num: int, den: int, parts: int, packing: Packing) -> DataFrame:
    """slice, sigs, keys: the packed signatures of every class, once or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[tuple[np.ndarray, np.ndarray]] = []
        count, salt = 0, 0

        def flush() -> pa.RecordBatch:
            sigs, fps = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            return packing.rows(sigs, packing.key(fps), salt)

        for _, _, _, sets in _sets(batches, n):
            new, fps = [], []
            for s in sets:
                f = fingerprint(s)
                if f and f not in seen:
                    seen.add(f)
                    new.append(s)
                    fps.append(f)
            if len(seen) > SEEN:
                seen.clear()
            if not new:
                continue
            whose, sigs = signatures(new, num, den, parts)
            if len(sigs):
                held.append((sigs, np.array(fps, np.int64)[whose]))
                count, salt = count + len(sigs), (salt * 31 + fps[0]) & 0xFFFFFFFFFFFFFFFF
            if count >= PACK:
                yield flush()
                count = 0
        if held:
            yield flush()

    return docs.where("doc_id is not null").select("text").mapInArrow(trimmed(run), "slice int, sigs binary, keys binary")


def buckets(rows: DataFrame, packing: Packing) -> DataFrame:
    """bucket, key: the members of buckets of two classes or more, and of signatures that were dealt out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sigs, keys = -1, [], []

        def done() -> Iterator[pa.RecordBatch]:
            if sigs:
                number, key = packing.buckets(at, sigs, keys)
                if len(number):
                    yield pa.RecordBatch.from_arrays([pa.array(number.view(np.int64)), pa.array(key.view(np.int64))], names=["bucket", "key"])

        for batch in batches:
            for a, s, k in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if a != at:
                    yield from done()
                    at, sigs, keys = a, [], []
                sigs.append(s)
                keys.append(k)
        yield from done()

    return rows.repartition("slice").sortWithinPartitions("slice").mapInArrow(trimmed(run), "bucket long, key long")


def met(short: DataFrame) -> DataFrame:
    """bucket, fp: the classes (fp, key) that share a cut key; a few in a thousand at most."""
    keys = short.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key", F.xxhash64(F.lit("key"), "key").alias("bucket"))
    return short.join(keys, "key").select("bucket", "fp")


def sketch(s: np.ndarray) -> bytes:
    """Parities of the number of features that hash to each bit; a power of two of bits."""
    bits = max(SKETCH_LEAST, 1 << int(SKETCH * len(s) - 1).bit_length())
    at = mix(s ^ np.uint64(0x9B05688C2B3E6C1F)) & np.uint64(bits - 1)
    return np.packbits(np.bincount(at.astype(np.int64), minlength=bits) & 1).tobytes()


def folded(data: bytes, size: int) -> np.ndarray:
    """A sketch of ``size`` bytes from a longer one: the halves' parities added, again and again."""
    x = np.frombuffer(data, np.uint8)
    while len(x) > size:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def near(x: bytes, y: bytes, both: int, num: int, den: int) -> bool:
    """Whether sets of ``both`` members together can link by their sketches. False is sure."""
    size = min(len(x), len(y))
    return int(np.bitwise_count(folded(x, size) ^ folded(y, size)).sum()) * (den + num) <= both * (den - num)


def described(docs: DataFrame, wanted: DataFrame, n: int, what: str) -> DataFrame:
    """fp, n, ``what`` (``sketch``, or ``members``: the set's hashes) of the classes ``wanted`` (fp, rep), from their representatives' texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, a, b, sets in _sets(batches, n):
            fp = batch.column("fp").slice(a, b - a).to_numpy()
            own = [i for i, s in enumerate(sets) if fingerprint(s) == fp[i]]
            out = [sketch(sets[i]) if what == "sketch" else sets[i].tobytes() for i in own]
            if own:
                yield pa.RecordBatch.from_arrays([pa.array(fp[own]), pa.array([len(sets[i]) for i in own], pa.int64()), pa.array(out, pa.binary())], names=["fp", "n", what])

    wanted = wanted.select("rep.*", "fp")
    count, twice = wanted.agg(F.count(F.lit(1)), F.count(F.when(F.col("twice"), 1))).first()
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("digest"))
    texts = texts.join(F.broadcast(wanted) if count <= BROADCAST_ROWS else wanted, ["doc_id", "digest"])
    if twice:  # a representative's row is repeated
        texts = texts.where("not twice").unionByName(texts.where("twice").dropDuplicates(["fp"]))
    return texts.select("fp", "text").mapInArrow(trimmed(run), f"fp long, n long, {what} binary")


def _pairs(pairs: DataFrame, sets: DataFrame, col: str, num: int, den: int) -> DataFrame:
    """a, b, both, x, y: ``pairs`` whose sizes may link, with ``col`` of either; ``pairs`` is a written table."""
    left = sets.select(F.col("fp").alias("a"), F.col("n").alias("na"), F.col(col).alias("x"))
    right = sets.select(F.col("fp").alias("b"), F.col("n").alias("nb"), F.col(col).alias("y"))
    fits = F.lit(den) * F.least("na", "nb") >= F.lit(num) * F.greatest("na", "nb")
    return dealt_join(pairs.select("a", "b"), right, "b").join(left, "a").where(fits).select("a", "b", (F.col("na") + F.col("nb")).alias("both"), "x", "y")


def promising(pairs: DataFrame, sketches: DataFrame, num: int, den: int) -> DataFrame:
    """a, b of those ``pairs`` that can link by their sketches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [near(x, y, n, num, den) for x, y, n in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), batch.column("both").to_pylist(), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return _pairs(pairs, sketches, "sketch", num, den).mapInArrow(trimmed(run), "a long, b long")


def checked(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """a, b of those ``pairs`` whose sets (fp, n, members) link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(p) > len(q):
                    p, q = q, p
                at = np.searchsorted(q, p)
                keep.append(linked(int((q[np.minimum(at, len(q) - 1)] == p).sum()), len(p), len(q), num, den))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return _pairs(pairs, sets, "members", num, den).mapInArrow(trimmed(run), "a long, b long")


def spanning(link: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the graph with adjacency matrix ``link``."""
    left, out = np.ones(len(link), bool), []
    for root in range(len(link)):
        if not left[root]:
            continue
        left[root] = False
        todo = [root]
        while todo:
            i = todo.pop()
            new = np.flatnonzero(link[i] & left)
            left[new] = False
            out += [(i, int(j)) for j in new]
            todo += new.tolist()
    return out


def possible(t: pa.Table, num: int, den: int) -> list[tuple[int, int]]:
    """Pairs of rows (n, sketch, comp) of different components that can link by their sketches, as a spanning forest."""
    n, comp = t.column("n").to_numpy().astype(np.float64), t.column("comp").to_numpy()
    raw = t.column("sketch").to_pylist()
    size = min(map(len, raw))
    by = np.stack([folded(x, size) for x in raw])
    apart = np.zeros((len(raw), len(raw)), np.float32)
    width = max(64, COLUMNS // (8 * len(raw)))
    for low in range(0, size, width):
        one = np.unpackbits(by[:, low : low + width], axis=1).astype(np.float32)
        count = one.sum(1)
        apart += count[:, None] + count[None, :] - 2 * (one @ one.T)
    both = n[:, None] + n[None, :]
    fits = (den * np.minimum(n[:, None], n[None, :]) >= num * np.maximum(n[:, None], n[None, :])) & (comp[:, None] != comp[None, :])
    return spanning(fits & (apart.astype(np.float64) * (den + num) <= both * (den - num)))


def forest(sets: list[np.ndarray], blk: np.ndarray | None, num: int, den: int) -> list[tuple[int, int]]:
    """Links (i, j) that span the components of all links; with ``blk``, of the links between different blocks only.

    Intersections of all pairs are a product of 0/1 matrices over the features that two sets or more have, some thousand columns at a
    time; of the links only a spanning forest leaves, fewer than there are sets.
    """
    m, sizes = len(sets), np.array([len(s) for s in sets], np.float64)
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(m), sizes.astype(np.int64))
    shared = count > 1
    column, owner = (np.cumsum(shared) - 1)[column[shared[column]]], owner[shared[column]]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    common = np.zeros((m, m), np.float32)
    width = max(256, COLUMNS // max(m, 1))
    for low in range(0, int(shared.sum()), width):
        s, e = np.searchsorted(column, [low, low + width])
        a = np.zeros((m, width), np.float32)
        a[owner[s:e], column[s:e] - low] = 1
        common += a @ a.T
    link = common.astype(np.float64) * (den + num) >= num * (sizes[:, None] + sizes[None, :])
    if blk is not None:
        link &= blk[:, None] != blk[None, :]
    np.fill_diagonal(link, False)
    return spanning(link)


def in_groups(rows: DataFrame, keys: list[str], links) -> DataFrame:
    """a, b: ``links`` (pairs of row numbers) of every group of ``rows`` by ``keys``. A group is a block or a pair of blocks; none is cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def found(t: pa.Table) -> list[tuple[int, int]]:
            fp = t.column("fp").to_numpy()
            return [(int(fp[i]), int(fp[j])) for i, j in links(t)] if len(fp) > 1 else []

        def out(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.int64()), pa.array([y for _, y in pairs], pa.int64())], names=["a", "b"])

        for batch in batches:  # the last group's rows wait for the next batch
            if not batch.num_rows:
                continue
            t = pa.concat_tables([*held, pa.Table.from_batches([batch])])
            key = np.stack([t.column(c).to_numpy() for c in keys], 1)
            edge = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(1)])).tolist()
            pairs = [x for s, e in zip(edge, edge[1:], strict=False) for x in found(t.slice(s, e - s))]
            if pairs:
                yield out(pairs)
            held = [t.slice(edge[-1])]
        if held:
            yield out(found(held[0]))

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(trimmed(run), "a long, b long")


def passes(amount: DataFrame) -> int:
    """How many passes ``amount`` (one row, bytes) takes."""
    return max(1, -(-int(amount.first()[0] or 0) // PASS))


def share(k: int, count: int, *keys: str) -> Column:
    """Whether a row's keys belong to pass ``k`` of ``count``."""
    return F.lit(True) if count == 1 else F.pmod(F.xxhash64(*keys), F.lit(count)) == k


def in_turn(work: Work, name: str, count: int, one) -> DataFrame:
    """The union of ``one(0)`` to ``one(count - 1)``, each written before the next begins."""
    out = None
    for k in range(count):
        own = work.save(one(k), f"{name}-{k}")
        out = own if out is None else out.unionByName(own)
    return out


def parts_of(size: Column) -> Column:
    """Blocks of a cluster: of ``BLOCK`` sets at most, and up to eight smaller ones, so that a middling cluster's work is spread too."""
    return F.greatest(F.ceil(size / BLOCK), F.least(F.lit(8), F.ceil(8 * size / BLOCK))).cast("int")


def blocked(rows: DataFrame, key: str, sizes: DataFrame) -> DataFrame:
    """``rows`` with their block of the group ``key``, once for each pair of blocks (p, q); ``sizes``: ``key`` and the number of blocks, nb."""
    rows = dealt_join(rows, sizes, key).withColumn("blk", F.pmod(F.xxhash64("fp"), F.col("nb")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    return rows.withColumn("p", F.least("blk", "other")).withColumn("q", F.greatest("blk", "other")).drop("other", "nb")


def _split(t: pa.Table) -> np.ndarray | None:
    """The blocks of a pair's rows; None for a block with itself."""
    return None if t.column("p")[0] == t.column("q")[0] else t.column("blk").to_numpy()


def by_sketch(t: pa.Table, num: int, den: int) -> list[tuple[int, int]]:
    return possible(t, num, den)


def by_members(t: pa.Table, num: int, den: int) -> list[tuple[int, int]]:
    return forest([np.frombuffer(x, np.uint64) for x in t.column("members").to_pylist()], _split(t), num, den)


def unresolved_bytes(rows: DataFrame, sketches: DataFrame) -> DataFrame:
    """One row: the bytes of sketches that ``unresolved`` brings together."""
    each = rows.join(sketches.select("fp", F.length("sketch").alias("bytes")), "fp").groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("size"), F.sum("bytes").alias("bytes"))
    return each.where("lo <> hi").agg(F.sum(F.col("bytes") * F.ceil(F.col("size") / BLOCK)))


def unresolved(rows: DataFrame, sketches: DataFrame, num: int, den: int, k: int = 0, count: int = 1) -> DataFrame:
    """a, b: pairs of different components that share a bucket and can link by their sketches, as spanning forests. ``rows``: bucket, fp, comp. Of ``count`` passes the ``k``-th."""
    stats = rows.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("size")).where("lo <> hi")
    nb = stats.select("bucket", F.ceil(F.col("size") / BLOCK).cast("int").alias("nb"))
    out = in_groups(blocked(rows, "bucket", nb).where(share(k, count, "bucket", "p", "q")).join(sketches, "fp"), ["bucket", "p", "q"], partial(by_sketch, num=num, den=den))
    return out.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def cluster_blocks(clusters: DataFrame, sets: DataFrame) -> DataFrame:
    """cluster, nb, bytes: the blocks of each cluster (node, comp), and the bytes of its sets."""
    own = clusters.select(F.col("node").alias("fp"), F.col("comp").alias("cluster")).join(sets.select("fp", "n"), "fp")
    return own.groupBy("cluster").agg(F.greatest(parts_of(F.count(F.lit(1))), F.ceil(F.sum("n") * 8 / BLOCK_BYTES).cast("int")).alias("nb"), (F.sum("n") * 8).alias("bytes"))


def resolved(clusters: DataFrame, sets: DataFrame, num: int, den: int, k: int = 0, count: int = 1) -> DataFrame:
    """a, b: the links of each cluster (node, comp) by whole sets, as spanning forests of blocks. ``clusters`` is a written table. Sets join their blocks last. Of ``count`` passes the ``k``-th."""
    own = clusters.select(F.col("node").alias("fp"), F.col("comp").alias("cluster"))
    rows = blocked(own, "cluster", cluster_blocks(clusters, sets).select("cluster", "nb")).where(share(k, count, "cluster", "p", "q")).join(sets, "fp")
    return in_groups(rows, ["cluster", "p", "q"], partial(by_members, num=num, den=den))


def grouped(work: Work, docs: DataFrame, words: int, num: int, den: int, parts: int) -> DataFrame:
    """doc_id, digest, n, root: every row of ``docs`` with its component's least (doc_id, digest), and whether rows repeat it (twice); null for empty sets and null ids."""
    base = work.save(sized(docs, words), "sized")
    each = base.where("n > 0 and doc_id is not null").groupBy("fp", "doc_id", "digest").agg(F.max("n").alias("n"), (F.count(F.lit(1)) > 1).alias("twice"))
    classes = work.save(each.groupBy("fp").agg(F.min(F.struct("doc_id", "digest", "twice")).alias("rep"), F.max("n").alias("n")), "classes")
    count, features = classes.agg(F.count(F.lit(1)), F.sum("n")).first()
    packing = Packing(count, features or 0, num, den, parts)
    short = classes.select("fp", packing.key_column(F.col("fp")).alias("key"))
    # the signatures' shuffle files go before anything else is shuffled
    multi = work.save(buckets(signed(docs, words, num, den, parts, packing), packing), "slices").distinct().join(short, "key").select("bucket", "fp")
    multi = work.save(multi.unionByName(met(short)), "buckets")
    work.drop("slices")
    sketches = work.save(described(docs, multi.select("fp").distinct().join(classes, "fp"), words, "sketch"), "sketches")

    # a bucket's centre: the member whose buckets are largest, as a rule the text that the others were made from
    size = multi.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"))
    pop = dealt_join(multi, size, "bucket").groupBy("fp").agg(F.sum("size").alias("pop"))
    known = work.save(multi.join(pop, "fp"), "known")
    centre = known.groupBy("bucket").agg(F.max(F.struct("pop", "fp")).alias("c"))
    votes = dealt_join(known, centre, "bucket").where("fp <> c.fp").groupBy("fp", F.col("c.fp").alias("centre")).agg(F.count(F.lit(1)).alias("c"), F.max("c.pop").alias("pop"))
    best = votes.groupBy("fp").agg(F.max(F.struct("c", "pop", "centre")).alias("s"))
    first = work.save(best.select(F.col("fp").alias("a"), F.col("s.centre").alias("b")), "first")
    first = work.save(promising(first, sketches, num, den), "promising")
    ends = first.select(F.explode(F.array("a", "b")).alias("fp"))
    turns = passes(ends.join(classes.select("fp", "n"), "fp").agg(F.sum("n") * 8))

    def centres(k: int) -> DataFrame:  # copies of one centre are one pass's
        work.drop("sets")
        pairs = first.where(share(k, turns, "b"))
        own = pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct()
        return checked(pairs, work.save(described(docs, own.join(classes, "fp"), words, "members"), "sets"), num, den)

    label = components(in_turn(work, "linked", turns, centres), keep=work, name="components")
    work.drop("sets", "known", "first", "promising")

    rows = multi.join(label.select(F.col("node").alias("fp"), "comp"), "fp", "left").select("bucket", "fp", F.coalesce("comp", "fp").alias("comp"))
    rows = work.save(rows, "rows")
    turns_ = passes(unresolved_bytes(rows, sketches))
    clusters = components(in_turn(work, "possible", turns_, lambda k: unresolved(rows, sketches, num, den, k, turns_)), keep=work, name="clusters")
    work.drop("rows", "buckets", "sketches")
    sets = work.save(described(docs, clusters.select(F.col("node").alias("fp")).join(classes, "fp"), words, "members"), "sets")
    blocks = passes(cluster_blocks(clusters, sets).agg(F.sum(F.col("bytes") * F.col("nb"))))
    second = in_turn(work, "second", blocks, lambda k: resolved(clusters, sets, num, den, k, blocks))
    work.drop("sets", "clusters")
    up = label.select(F.col("node").alias("a"), F.col("comp").alias("ca"))
    contracted = second.join(up, "a", "left").join(up.select(F.col("a").alias("b"), F.col("ca").alias("cb")), "b", "left")
    again = components(contracted.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")), keep=work, name="again")

    whole = classes.join(label.withColumnRenamed("node", "fp"), "fp", "left").withColumn("c1", F.coalesce("comp", "fp")).drop("comp")
    whole = whole.join(again.select(F.col("node").alias("c1"), "comp"), "c1", "left").withColumn("c2", F.coalesce("comp", "c1"))
    whole = work.save(whole.select("fp", "rep", "c2"), "whole")
    found = dealt_join(whole, whole.groupBy("c2").agg(F.min("rep").alias("root")), "c2").select("fp", "root")
    live = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("fp"))
    return dealt_join(work.save(base.withColumn("fp", live), "live"), found, "fp", "left").select("doc_id", "digest", "n", "root")


def jaccard_components(docs: DataFrame, words: int = 3, num: int = 90, den: int = 100, parts: int = 3) -> DataFrame:
    """doc_id, n_shingles, component_id: documents link when ``den * common >= num * union``."""
    with Work(docs.sparkSession) as work:
        out = grouped(work, docs.select("doc_id", "text"), words, num, den, parts)
        return materialise(out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("root.doc_id", "doc_id").alias("component_id")), "jaccard")


def one_of_each(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, parts: int = 3) -> DataFrame:
    """``docs`` with one row of each group of near copies, that of the least id (of its texts, that of the least digest); all columns stay.

    Rows are judged by their own texts, so a text that is alone stays though its id is repeated. Of rows with one id and one text that
    are kept, one stays. Rows with a null id or an empty set all stay.
    """
    with Work(docs.sparkSession) as work:
        rows = work.save(grouped(work, docs.select("doc_id", "text"), words, num, den, parts).where("root is not null").select("doc_id", "digest", "root"), "rows")
        first = (F.col("doc_id") == F.col("root.doc_id")) & (F.col("digest") == F.col("root.digest"))
        marks = rows.where(~first | F.col("root.twice")).select(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest"), first.alias("__twice")).distinct()
        marks = materialise(marks, "copies")
    seen = docs.join(marks, (F.col("doc_id") == F.col("__id")) & (F.xxhash64("text") == F.col("__digest")), "left")
    own = [F.col(f"`{c}`") for c in docs.columns]
    if marks.where("__twice").isEmpty():
        return seen.where("__twice is null").select(*own)
    return seen.where("__twice is null").unionByName(seen.where("__twice").dropDuplicates(["__id", "__digest"])).select(*own)


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))
