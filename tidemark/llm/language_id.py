"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

A text's letters are lower-cased, all other characters become one blank class; runs of 1 to 3 are hashed into ``2**BITS`` features. A
feature's value is its share of the text's n-grams times its inverse document frequency, which is counted over every
learnable text. The weights are trained by follow-the-regularised-leader (per-coordinate rates, L1 and L2 penalties: the elastic net) on a
bounded sample: of each language the distinct learnable texts that hash lowest, about ``SAMPLE`` in all, and ``LEAST`` of a language where it has
them, as far as ``MOST`` in all allows, so that a rare language is learnt too, however its ids repeat; a fifth of it is left out and fits the one temperature that
divides the scores before the softmax. The model holds ``CELLS`` weights at most: with many languages neighbouring features are one. As a text's value is a mean over its n-grams, prediction adds weights over positions and needs no
table of counts: one map over whole texts, no shuffle.

Rows with crc32(doc_id) mod 4 = 2 are never learnt from. Cases: null texts and texts without a letter are ``und`` with score 0; null languages are not
learnt from; repeated rows are predicted alike; ties go to the language first in order; without learnable rows all is
``und``; an empty table gives an empty result; further columns are ignored, and kept by ``accept``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import Work, fold, table, widened
from tidemark.llm.textbuf import pieces, trimmed, utf8

BITS = 16
ORDERS = (1, 2, 3)
#: Learnable texts that are fitted: about so many, an equal number of each language; so many of each at least, where it has them; and so many in all at most.
SAMPLE, LEAST, MOST = 4_000, 50, 20_000
#: How often a text counts, at most, where its language has fewer than ``LEAST``.
AGAIN = 20
#: Languages that are learnt, at most (more raise an error); weights of a model, at most.
LANGS, CELLS = 8_192, 1 << 24
EPOCHS, ALPHA, BETA, L1, L2 = 3, 0.5, 1.0, 0.02, 0.1
#: Values are shares of a text's n-grams; this brings a typical text's length near 1.
SCALE = 10.0
#: A document is accepted in the pipeline from this calibrated score on.
ACCEPT = 0.4


@lru_cache(1)
def _letters() -> np.ndarray:
    """Code point -> its lower-case letter, or 0 where it is none."""
    t = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():  # the Unicode categories of letters
            low = ch.lower()
            t[c] = ord(low) if len(low) == 1 else c
    return t


def grams(data: np.ndarray, off: np.ndarray, a: int, b: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Of texts [a, b): feature by position for each order, the texts' offsets in characters, and letters."""
    raw = data[off[a] : off[b]]
    codes = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    chars = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=chars[1:])
    at = chars[off[a : b + 1] - off[a]]
    c = _letters()[codes]
    out = []
    h = np.zeros(len(c), np.uint32)
    for k in range(max(ORDERS)):
        if k:
            h = h[:-1] if len(h) else h
        part = c[k:] if k else c
        h = (h[: len(part)] ^ part) * np.uint32(0x9E3779B1) + np.uint32(0x85EBCA6B * (k + 1) & 0xFFFFFFFF)
        h ^= h >> np.uint32(15)
        if k + 1 in ORDERS:
            out.append(((h * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - BITS)).astype(np.uint16 if BITS <= 16 else np.uint32))
    return out, at, c != 0


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, bool]]:
    """Row, features (with repeats) and whether it has a letter."""
    data, off = utf8(batch.column("text"))
    for a, b in pieces(off):
        by, at, letter = grams(data, off, a, b)
        for i in range(b - a):
            s, e = int(at[i]), int(at[i + 1])
            yield a + i, np.concatenate([g[s : max(s, e - n + 1)] for n, g in zip(ORDERS, by, strict=True)]), bool(letter[s:e].any())


def _df(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df, n = np.zeros(1 << BITS, np.int64), 0
    for batch in batches:
        for _, feats, letter in _texts(batch):
            if letter:
                seen = np.zeros(1 << BITS, bool)
                seen[feats] = True
                df += seen
                n += 1
    if n:
        live = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"feature": pa.array(np.append(live, -1), pa.int32()), "n": pa.array(np.append(df[live], n), pa.int64())})


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep, idx, cnt = [], [], []
        for i, feats, letter in _texts(batch):
            if letter:
                f, n = np.unique(feats, return_counts=True)
                keep.append(i)
                idx.append(f.astype(np.uint16).tobytes())
                cnt.append((n / len(feats)).astype(np.float32).tobytes())
        if keep:
            got = batch.take(pa.array(keep))
            yield pa.RecordBatch.from_arrays([got.column("h"), got.column("lang"), pa.array(idx, pa.binary()), pa.array(cnt, pa.binary())], names=["h", "lang", "idx", "tf"])


def bits_for(langs: int) -> int:
    """Bits of a feature, so that a model of so many languages has ``CELLS`` weights at most."""
    return min(BITS, (CELLS // max(1, langs)).bit_length() - 1)


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], k: int, epochs: int = EPOCHS, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Multinomial FTRL-proximal: weights (features x languages) and intercepts. ``rows``: distinct features, their values, the language's number."""
    d = 1 << bits
    z, n = np.zeros((d + 1, k)), np.zeros((d + 1, k))

    def weights(zi: np.ndarray, ni: np.ndarray, pen: np.ndarray | float) -> np.ndarray:
        return np.where(np.abs(zi) <= pen, 0.0, (np.sign(zi) * pen - zi) / ((BETA + np.sqrt(ni)) / ALPHA + L2))

    for _ in range(epochs):
        for idx, x, y in rows:
            i, v = np.append(idx, d), np.append(x, 1.0)
            pen = np.full((len(i), 1), L1)
            pen[-1] = 0
            zi, ni = z[i], n[i]
            w = weights(zi, ni, pen)
            s = v @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1
            g = v[:, None] * p
            n2 = ni + g * g
            z[i] = zi + g - (np.sqrt(n2) - np.sqrt(ni)) / ALPHA * w
            n[i] = n2
    pen = np.full((d + 1, 1), L1)
    pen[-1] = 0
    w = weights(z, n, pen)
    return w[:-1], w[-1]


def temperature(scores: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the scores that makes the left-out rows likeliest, from a fixed grid."""
    if not len(y):
        return 1.0

    def loss(t: float) -> float:
        s = scores / t
        s = s - s.max(1, keepdims=True)
        return float(np.mean(np.log(np.exp(s).sum(1)) - s[np.arange(len(y)), y]))

    return min((float(t) for t in np.geomspace(0.1, 10, 81)), key=loss)


class Model:
    """What is broadcast: for each language the features whose weights are not 0, and their weights."""

    def __init__(self, langs: list[str], weights: np.ndarray, bias: np.ndarray, temp: float, bits: int = BITS) -> None:
        self.langs, self.bias, self.temp, self.bits = langs, bias, temp, bits
        self.live = [np.flatnonzero(w).astype(np.uint32) for w in weights.T]
        self.weights = [w[i].astype(np.float32) for w, i in zip(weights.T, self.live, strict=True)]

    def dense(self) -> np.ndarray:
        out = np.zeros((len(self.langs), 1 << self.bits), np.float32)
        for row, i, w in zip(out, self.live, self.weights, strict=True):
            row[i] = w
        return out


def picked(own: DataFrame, work: Work, sample: int) -> tuple[DataFrame, int]:
    """h, lang, text of the sample of ``own`` (lang, text), and the number of languages."""
    own = own.where(F.col("text").rlike(r"\p{L}"))
    keys = work.save(own.select("lang", F.xxhash64("text").alias("h")).distinct(), "keys")
    sizes = keys.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    langs = sizes.count()
    if langs > LANGS:
        raise ValueError(f"{langs} languages; a model learns {LANGS} at most")
    need = min(max(LEAST, sample // max(1, langs)), max(2, MOST // max(1, langs)))
    # the lowest of every language, among some four times as many that hash low enough: hashes of distinct texts are spread evenly
    low = keys.join(F.broadcast(sizes), "lang").where(F.col("h") / float(1 << 64) + 0.5 <= F.lit(4.0 * max(need, LEAST)) / F.col("n"))
    last = low.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("r") <= need).groupBy("lang").agg(F.max("h").alias("last"))
    mine = own.select("lang", "text", F.xxhash64("text").alias("h")).join(F.broadcast(last), "lang")  # ``LANGS`` rows at most
    return mine.where("h <= last").dropDuplicates(["lang", "h"]).select("h", "lang", "text"), langs


def train(docs: DataFrame, learnable=None, sample: int = SAMPLE) -> Model:
    """Learns from text and non-null lang of the learnable rows."""
    own = docs.where("lang is not null and text is not null and doc_id is not null").where(learnable if learnable is not None else fold("doc_id", 4) != 2)
    counts = own.select("text").mapInArrow(trimmed(_df), "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()  # 2**BITS rows at most
    with Work(docs.sparkSession) as work:
        texts, n_langs = picked(own.select("lang", "text"), work, sample)
        rows = sorted(texts.mapInArrow(trimmed(_sparse), "h long, lang string, idx binary, tf binary").collect(), key=lambda r: (r["lang"], r["h"]))  # ``MOST`` rows at most
    langs = sorted({r["lang"] for r in rows})
    if not langs:
        return Model([], np.zeros((1 << BITS, 0)), np.zeros(0), 1.0)
    bits = bits_for(n_langs)
    df = np.zeros(1 << bits)
    total = max((r["n"] for r in counts if r["feature"] < 0), default=0)
    for r in counts:
        if r["feature"] >= 0:
            df[r["feature"] >> (BITS - bits)] += r["n"]
    idf = SCALE * np.log((1 + total) / (1 + np.minimum(df, total)))
    at = {x: i for i, x in enumerate(langs)}
    left, fitted, seen = [], [], dict.fromkeys(langs, 0)
    for r in rows:
        if bits < BITS:
            idx, back = np.unique(np.frombuffer(r["idx"], np.uint16).astype(np.int64) >> (BITS - bits), return_inverse=True)
            tf = np.bincount(back, np.frombuffer(r["tf"], np.float32))
        else:
            idx, tf = np.frombuffer(r["idx"], np.uint16).astype(np.int64), np.frombuffer(r["tf"], np.float32)
        row = (r["h"], (idx, tf * idf[idx], at[r["lang"]]))
        seen[r["lang"]] += 1
        (left if seen[r["lang"]] % 5 == 0 else fitted).append(row)
    own = np.bincount([x[1][2] for x in fitted], minlength=len(langs))
    most = min(LEAST, int(own.max()))
    # texts of a language that has few come again in every round, up to ``AGAIN`` times, spread over it
    fitted += [((h + r * 0x9E3779B97F4A7C15 + (1 << 63)) % (1 << 64) - (1 << 63), x) for h, x in fitted for r in range(1, min(AGAIN, most // own[x[2]]))]
    fitted, left = [x for _, x in sorted(fitted, key=lambda x: x[0])], [x for _, x in left]
    w, bias = fit(fitted, len(langs), bits=bits)
    temp = temperature(np.array([x @ w[i] + bias for i, x, _ in left]), np.array([y for *_, y in left])) if left else 1.0
    return Model(langs, w * idf[:, None], bias, temp, bits)


def identified(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred and score, in place of columns of these names: one map, whole texts."""
    docs = docs.drop("lang_pred", "score")
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        k, weights, shift = len(m.langs), m.dense(), BITS - m.bits
        names = np.array([*m.langs, "und"], object)
        for batch in batches:
            data, off = utf8(batch.column("text"))
            best, score = np.full(batch.num_rows, k), np.zeros(batch.num_rows)
            for a, b in pieces(off) if k else ():
                by, at, letter = grams(data, off, a, b)
                lens = np.diff(at)
                total = sum(np.maximum(0, lens - n + 1) for n in ORDERS)
                sums = np.zeros((b - a, k))
                for n, g in zip(ORDERS, by, strict=True):
                    g = g >> shift if shift else g
                    for j in range(k):
                        run_ = np.zeros(len(g) + 1)
                        np.cumsum(weights[j][g], out=run_[1:], dtype=np.float64)
                        hi = np.maximum(at[:-1], at[1:] - n + 1)
                        sums[:, j] += run_[np.minimum(hi, len(g))] - run_[np.minimum(at[:-1], len(g))]
                s = (sums / np.maximum(total, 1)[:, None] + m.bias) / m.temp
                s = np.exp(s - s.max(1, keepdims=True))
                s /= s.sum(1, keepdims=True)
                has = np.zeros(len(letter) + 1, np.int64)
                np.cumsum(letter, out=has[1:])
                ok = has[at[1:]] > has[at[:-1]]
                best[a:b] = np.where(ok, s.argmax(1), k)
                score[a:b] = np.where(ok, s.max(1), 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names[best], pa.string()), pa.array(score)], names=[*batch.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(trimmed(run), widened(docs, "lang_pred string, score double"))


def accept(docs: DataFrame, least: float = ACCEPT) -> DataFrame:
    """``docs`` whose language is told with a score of ``least`` or more; all columns stay."""
    own = {c: f"__own_{c}" for c in ("lang_pred", "score") if c in docs.columns}
    kept = identified(docs.withColumnsRenamed(own), train(docs)).where((F.col("lang_pred") != "und") & (F.col("score") >= least)).drop("lang_pred", "score")
    return kept.withColumnsRenamed({v: k for k, v in own.items()})


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = identified(docs.select("doc_id", "text"), train(docs.select("doc_id", "text", "lang")))
    return out.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
