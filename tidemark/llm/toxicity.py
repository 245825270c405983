"""Toxicity: logistic regression by FTRL-proximal over hashed word n-grams and skip-grams.

Features of a text: its words (lower-cased runs of letters and digits), longer words cut to their first ``STEMS`` bytes, neighbouring
pairs, and pairs with one word skipped, hashed into ``2**BITS`` weights; a feature's value is its count, at most 3. FTRL-proximal keeps two numbers a
coordinate, gives each its own learning rate, and sets a weight to exactly 0 until its gradients outgrow ``L1``: what is
broadcast is the short list of weights that are left (its length is bounded by ``2**BITS`` and by the training sample).

Training reads a bounded sample: the ``SAMPLE`` learnable labelled rows whose ids hash lowest, one task,
in the order of the hash; of the texts of a repeated id the one whose digest is least. Rows with crc32(doc_id) mod 5 = 0 are never learnt from. Scoring is one map over all
texts, whole, and needs no shuffle.

Cases: null and empty texts score as the intercept alone; repeated rows score alike; null labels
are not learnt from, an id labelled twice counts as toxic if any label says so; with no labelled rows, or
one class only, the score is that class's smoothed share; an empty table gives an empty result; further columns are ignored, and kept by ``reject``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import fold, table, widened
from tidemark.llm.textbuf import Words, mix, pieces, trimmed, utf8

BITS = 20
#: Learnable labelled rows that are fitted, at most.
SAMPLE = 20_000
#: ``L1`` and ``STEMS`` have the least log loss of a 4-fold cross-validation within learnable rows alone (see the README).
EPOCHS, ALPHA, BETA, L1, L2 = 4, 0.3, 1.0, 8.0, 1.0
#: Words over so many bytes also count cut to them: inflected and compounded forms share a weight.
STEMS = (4, 6)
MOST = 3


def _kinds() -> np.ndarray:
    t = np.zeros(256, np.uint8)
    for a, b in ((48, 58), (65, 91), (97, 123), (128, 256)):
        t[a:b] = np.arange(a, b)
    t[65:91] += 32
    return t


KINDS = _kinds()


def features(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of every word, stem, pair and skip-pair."""
    h, of = w.hash, w.text_of_word()
    out, texts = [h], [of]
    for k in STEMS:
        longer = w.stop - w.start > k
        out.append(mix(w.span(w.start[longer], w.start[longer] + k) + np.uint64(k)))
        texts.append(of[longer])
    for gap, salt in ((1, 0x5851F42D4C957F2D), (2, 0x14057B7EF767814F)):
        same = of[gap:] == of[:-gap]
        out.append(mix(h[:-gap] * np.uint64(3) + h[gap:] * np.uint64(salt))[same])
        texts.append(of[gap:][same])
    return np.concatenate(texts), (np.concatenate(out) >> np.uint64(64 - BITS)).astype(np.int64)


def counted(texts: np.ndarray, feats: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, feature) with their counts, at most ``MOST``, by text."""
    keys, n = np.unique((texts << BITS) | feats, return_counts=True)
    return keys >> BITS, keys & ((1 << BITS) - 1), np.minimum(n, MOST).astype(np.float64)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS, alpha: float = ALPHA, l1: float = L1) -> tuple[float, np.ndarray, np.ndarray]:
    """Intercept, and the indices and values of the weights that are not 0."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    at0 = np.array([1 << BITS])
    for _ in range(epochs):
        for idx, x, y in rows:
            i, v = np.concatenate([idx, at0]), np.append(x, 1.0)
            zi, ni = z[i], np.sqrt(n[i])
            pen = np.where(i == 1 << BITS, 0.0, l1)
            w = np.where(np.abs(zi) <= pen, 0.0, (np.sign(zi) * pen - zi) / ((BETA + ni) / alpha + L2))
            p = 1 / (1 + np.exp(-np.clip(w @ v, -35, 35)))
            g = (p - y) * v
            n2 = np.sqrt(ni * ni + g * g)
            z[i] = zi + g - (n2 - ni) / alpha * w
            n[i] = n2 * n2
    pen = np.full(len(z), l1)
    pen[-1] = 0
    w = np.where(np.abs(z) <= pen, 0.0, (np.sign(z) * pen - z) / ((BETA + np.sqrt(n)) / alpha + L2))
    keep = np.flatnonzero(w[:-1])
    return float(w[-1]), keep, w[keep]


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """idx, cnt: each text's features and counts, in place of the text."""
    for batch in batches:
        data, off = utf8(batch.column("text"))
        idx, cnt = [], []
        for a, b in pieces(off):
            t, f, x = counted(*features(Words(data, off, a, b, KINDS, latin=True)))
            cut = np.searchsorted(t, np.arange(b - a + 1)).tolist()
            idx += [f[s:e].astype(np.int32).tobytes() for s, e in zip(cut, cut[1:], strict=False)]
            cnt += [x[s:e].astype(np.uint8).tobytes() for s, e in zip(cut, cut[1:], strict=False)]
        yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("doc_id"), batch.column("toxic"), pa.array(idx, pa.binary()), pa.array(cnt, pa.binary())], names=["h", "doc_id", "toxic", "idx", "cnt"])


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fits the rows in the order of h, doc_id; one task, ``SAMPLE`` rows of features at most."""
    rows = []
    for batch in batches:
        for h, i, y, idx, cnt in zip(*(batch.column(c).to_pylist() for c in ("h", "doc_id", "toxic", "idx", "cnt")), strict=True):
            rows.append((h, i, np.frombuffer(idx, np.int32), np.frombuffer(cnt, np.uint8), y))
    rows.sort(key=lambda r: r[:2])
    ones = sum(r[4] for r in rows)
    if 0 < ones < len(rows):
        bias, idx, w = ftrl([r[2:] for r in rows])
    else:  # one class only, or nothing to learn from
        p = (ones + 0.5) / (len(rows) + 1)
        bias, idx, w = float(np.log(p / (1 - p))) if rows else -4.0, np.zeros(0, np.int64), np.zeros(0)
    yield pa.RecordBatch.from_pydict({"feature": pa.array(np.append(idx, -1), pa.int64()), "weight": pa.array(np.append(w, bias), pa.float64())})


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[tuple[int, float]]:
    """The weights that are not 0; feature -1 is the intercept."""
    own = labels.where("toxic is not null and doc_id is not null").where(fold("doc_id", 5) != 0)
    own = own.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    lowest = own.select("doc_id", F.col("toxic").cast("int").alias("toxic"), F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").limit(sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(lowest), "doc_id").select("h", "doc_id", "text", F.least(F.greatest("toxic", F.lit(0)), F.lit(1)).alias("toxic"))
    # of an id's texts the one of the least digest, so that ``sample`` rows are an upper bound
    one = rows.groupBy("h", "doc_id", "toxic").agg(F.min(F.struct(F.xxhash64("text").alias("digest"), "text")).alias("t")).select("h", "doc_id", "toxic", "t.text")
    feats = one.mapInArrow(trimmed(_sparse), "h long, doc_id long, toxic int, idx binary, cnt binary")
    got = feats.repartition(1).mapInArrow(trimmed(_train), "feature long, weight double").collect()
    return [(r["feature"], r["weight"]) for r in got] or [(-1, -4.0)]


def scored(docs: DataFrame, weights: list[tuple[int, float]]) -> DataFrame:
    """``docs`` with a column ``score``, in place of one of this name: one map, whole texts."""
    docs = docs.drop("score")
    spark = docs.sparkSession
    bias = dict(weights).get(-1, 0.0)
    idx = np.array([i for i, _ in weights if i >= 0], np.int64)
    val = np.array([w for i, w in weights if i >= 0])
    sent = spark.sparkContext.broadcast((bias, idx, val))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bias, idx, val = sent.value
        dense = np.zeros(1 << BITS)
        dense[idx] = val
        for batch in batches:
            data, off = utf8(batch.column("text"))
            out = np.full(batch.num_rows, bias)
            for a, b in pieces(off):
                t, f = features(Words(data, off, a, b, KINDS, latin=True))
                live = dense[f] != 0
                t, f, x = counted(t[live], f[live])
                out[a:b] += np.bincount(t, dense[f] * x, minlength=b - a)
            score = 1 / (1 + np.exp(-np.clip(out, -35, 35)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], names=[*batch.schema.names, "score"])

    return docs.mapInArrow(trimmed(run), widened(docs, "score double"))


def reject(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without what scores 0.5 or more; all columns stay."""
    clash = [c for c in docs.columns if c == "score"]
    named = docs.withColumnsRenamed({c: "__own_score" for c in clash})
    kept = scored(named, train(docs, labels)).where("score < 0.5").drop("score")
    return kept.withColumnsRenamed({"__own_score": c for c in clash})


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = scored(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
