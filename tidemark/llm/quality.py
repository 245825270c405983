"""Quality rules: an isolation forest over rule statistics, its threshold calibrated from labelled rows.

Fixed rules come first: a text of fewer than ``MIN_WORDS`` words, or with more than ``REPEATS`` per cent of its words in repeated windows,
fails whatever the forest says. For the others ratios that these rules do not judge (``RATIOS``) are measured on the whole text, and, so that short texts
are not odd by chance, drawn towards the mean of all texts as if that had stood in ``PRIOR`` more words. A tree splits a
draw of ``PSI`` rows at random: a random ratio, a random value between the least and the greatest, until rows stand alone. Odd rows
stand alone early; the mean path length over ``TREES`` trees, as a share of what a draw of that size would need, gives a score between 0
and 1, higher for odder rows.

The forest is fitted on the distinct vectors of ratios whose hashes are least, ``SAMPLE`` at most, so that copies count once. The threshold is calibrated on
every labelled row that passes the fixed rules: at most ``SPOILED`` of the good ones may lie above it, and of all such thresholds it is the one that gains
most, a bad row above it counting 1 and a good one above it ``-COST``. Counts by score (at most ``STEPS`` of them) are all that is collected.

Two passes of Python: one over texts, which writes the statistics (some 150 bytes a row) to the shared folder, one over these numbers.

Cases: null and empty texts have no words and fail; repeated rows are judged alike; an id labelled more than once counts as good if any label says so;
null labels and null ids calibrate nothing; without labels, or with labels of one class, nothing is odd enough to go, and the rules alone
decide; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import Work, dealt_join, materialise, table, widened
from tidemark.llm.textbuf import trimmed, utf8

MIN_WORDS, REPEATS, WINDOW = 20, 30, 8
#: Fixed set of characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
TREES, PSI = 128, 256
#: Vectors that the forest is fitted on, at most; every tree draws ``PSI`` of them.
SAMPLE = 16_384
#: Share of labelled good rows that may lie above the threshold; what one of them costs beside a bad row's 1; distinct scores that are counted.
SPOILED, COST, STEPS = 0.005, 4.0, 1_000
SEED = 20240229
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Mean length of words; symbols a word; share of lines that repeat; of words without a letter; of capitals among ASCII letters; of the most frequent
#: word; other punctuation a word.
RATIOS = ("word_length", "symbols", "dup_lines", "wordless", "capitals", "top_word", "punctuation")
#: Words of mean ratios that every text gets besides its own.
PRIOR = 50


def _table(chars: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars)] = True
    return t


_SPACE, _SYMBOL = _table(b" \t\n\x0b\x0c\r"), _table(SYMBOLS)
_CAPITAL, _SMALL = _table(bytes(range(65, 91))), _table(bytes(range(97, 123)))
_PUNCT = _table(bytes(c for c in range(33, 127) if not chr(c).isalnum() and c not in SYMBOLS))
_LETTERS = bytes([*range(65, 91), *range(97, 123), *range(128, 256)])


def repeated(ids: np.ndarray, window: int = WINDOW) -> int:
    """Words in windows of ``window`` (a power of two) that stand in the sequence twice or more. Windows are numbered by doubling, so that no hash decides."""
    n = len(ids) - window + 1
    if n < 2:
        return 0
    name, span = ids.astype(np.int64), 1
    while span < window:
        pair = (name[:-span] << 32) | name[span:]
        _, name = np.unique(pair, return_inverse=True)
        span *= 2
    hit = np.bincount(name)[name] > 1
    if not hit.any():
        return 0
    edge = np.zeros(len(ids) + 1, np.int64)
    edge[:n] += hit
    edge[window:] -= hit
    return int((np.cumsum(edge[:-1]) > 0).sum())


def statistics(raw: np.ndarray) -> tuple[tuple[int, ...], tuple[float, ...]]:
    """``COUNTS`` and ``RATIOS`` of a text's UTF-8 bytes."""
    text = raw.tobytes()
    words = text.split()
    n = len(words)
    if not n:
        return (0, 0, int(_SYMBOL[raw].sum()), 0, 0), (0.0,) * len(RATIOS)
    number = {w: k for k, w in enumerate(dict.fromkeys(words))}
    ids = np.fromiter((number[w] for w in words), np.int64, n)
    lines = [x for x in text.split(b"\n") if x.strip()]
    dup = len(lines) - len(set(lines))
    chars = int(((raw & 0xC0) != 0x80).sum() - _SPACE[raw].sum())
    symbols, again = int(_SYMBOL[raw].sum()), repeated(ids)
    capitals, small = int(_CAPITAL[raw].sum()), int(_SMALL[raw].sum())
    often = np.bincount(ids)
    bare = int(often[[k for w, k in number.items() if len(w.translate(None, _LETTERS)) == len(w)]].sum())
    ratios = (chars / n, symbols / n, dup / len(lines), bare / n, capitals / max(1, capitals + small), int(often.max()) / n, int(_PUNCT[raw].sum()) / n)
    return (n, chars, symbols, dup, again), ratios


_MEASURED = ", ".join([*(f"{c} long" for c in COUNTS), *(f"{c} double" for c in RATIOS)])


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, off = utf8(batch.column("text"))
        rows = [statistics(data[a:b]) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
        counts, ratios = np.array([r[0] for r in rows], np.int64).reshape(-1, len(COUNTS)), np.array([r[1] for r in rows]).reshape(-1, len(RATIOS))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c) for c in counts.T), *(pa.array(c) for c in ratios.T)], names=["doc_id", *COUNTS, *RATIOS])


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, counts, ratios and base_failed of every whole text."""
    own = docs.select("doc_id", "text")
    out = own.mapInArrow(trimmed(_measure), widened(own.select("doc_id"), _MEASURED))
    return out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEATS * F.col("n_words")))


def _needed(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of a search that does not end in a tree of n rows."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


class Forest:
    """Trees as arrays: ``ratio`` (-1 in leaves), ``value``, ``child`` (the left one; the right one follows), ``length`` (of the path that ends there)."""

    def __init__(self, rows: np.ndarray, trees: int = TREES, psi: int = PSI, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        self.size = min(psi, len(rows))
        self.trees = [self._tree(rows[rng.choice(len(rows), self.size, replace=False)], rng) for _ in range(trees)] if self.size > 1 else []

    def _tree(self, rows: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
        most = int(np.ceil(np.log2(len(rows))))
        nodes, queue = [[-1, 0.0, 0, 0.0]], [(0, rows, 0)]
        for k, own, depth in queue:  # grows while it is read
            low, high = own.min(0), own.max(0)
            split = np.flatnonzero(high > low)
            if depth == most or not len(split):
                nodes[k] = [-1, 0.0, 0, depth + float(_needed(len(own)))]
                continue
            j = int(rng.choice(split))
            at = float(rng.uniform(low[j], high[j]))
            left = own[:, j] <= at
            nodes[k] = [j, at, len(nodes), 0.0]
            queue += [(len(nodes), own[left], depth + 1), (len(nodes) + 1, own[~left], depth + 1)]
            nodes += [[-1, 0.0, 0, 0.0], [-1, 0.0, 0, 0.0]]
        ratio, value, child, length = zip(*nodes, strict=True)
        return np.array(ratio), np.array(value), np.array(child), np.array(length)

    def score(self, rows: np.ndarray) -> np.ndarray:
        """0 to 1 for each row; higher is odder. Without trees 0."""
        if not self.trees or not len(rows):
            return np.zeros(len(rows))
        total, own = np.zeros(len(rows)), np.arange(len(rows))
        for ratio, value, child, length in self.trees:
            at = np.zeros(len(rows), np.int64)
            while (ratio[at] >= 0).any():
                inner = ratio[at] >= 0
                j = np.maximum(ratio[at], 0)
                at = np.where(inner, child[at] + (rows[own, j] > value[at]), at)
            total += length[at]
        return 2 ** (-total / len(self.trees) / max(float(_needed(self.size)), 1e-9))


def drawn(stats: DataFrame, prior: int = PRIOR) -> DataFrame:
    """``stats`` with the ratios drawn towards their means over the rows that pass the fixed rules (sums of millionths, the same in any order), and the hash ``h`` of those measured."""
    sums = stats.where("not base_failed").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.round(F.col(c) * 1e6).cast("long")).alias(c) for c in RATIOS]).first()
    mean = {c: (sums[c] or 0) / 1e6 / max(sums["n"], 1) for c in RATIOS}
    own = {c: (F.col("n_words") * F.col(c) + F.lit(prior * mean[c])) / (F.col("n_words") + prior) for c in RATIOS}
    return stats.withColumn("h", F.xxhash64("n_words", *RATIOS)).withColumns(own)


def fit(stats: DataFrame, sample: int = SAMPLE) -> Forest:
    """A forest over the distinct vectors of lowest hash among rows that pass the fixed rules."""
    vectors = stats.where("not base_failed").select("h", *RATIOS)
    n = vectors.count()
    few = vectors.where(F.col("h") / float(1 << 64) + 0.5 <= F.lit(8.0 * sample / max(n, 1))).dropDuplicates(["h"]).orderBy("h").limit(sample).collect()
    if len(few) < sample and n > 8 * sample:  # many copies: the distinct vectors are fewer
        few = vectors.dropDuplicates(["h"]).orderBy("h").limit(sample).collect()
    return Forest(np.array([r[1:] for r in few], float).reshape(-1, len(RATIOS)))


def scored(stats: DataFrame, forest: Forest) -> DataFrame:
    """``stats`` with ``oddness`` in steps of 1 / ``STEPS``."""
    sent = stats.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in RATIOS]).reshape(-1, len(RATIOS))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.round(sent.value.score(rows) * STEPS) / STEPS)], names=[*batch.schema.names, "oddness"])

    return stats.mapInArrow(run, widened(stats, "oddness double"))


def threshold(rows: DataFrame, labels: DataFrame, spoiled: float = SPOILED, cost: float = COST) -> float:
    """The oddness from which a row goes, by all labelled rows; 2 where none does."""
    good = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    held = dealt_join(rows.where("not base_failed").select("doc_id", "oddness"), good, "doc_id").groupBy("oddness").agg(F.sum((F.col("quality") > 0).cast("long")), F.sum((F.col("quality") <= 0).cast("long"))).collect()
    counts = sorted(map(tuple, held), reverse=True)
    total, best, gain, above = sum(r[1] for r in counts), 2.0, 0.0, [0, 0]
    for odd, n_good, n_bad in counts:
        above = [above[0] + n_good, above[1] + n_bad]
        if above[0] > spoiled * total:
            break
        if total and above[1] - cost * above[0] > gain:
            best, gain = odd, above[1] - cost * above[0]
    return best


def judged(docs: DataFrame, labels: DataFrame, work: Work) -> DataFrame:
    """doc_id, counts, ratios, base_failed, oddness, kept."""
    stats = work.save(measured(docs), "statistics")
    stats = drawn(stats)
    rows = work.save(scored(stats, fit(stats)).drop("h"), "scored")
    least = threshold(rows, labels)
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("oddness") < F.lit(least)))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    with Work(spark) as work:
        out = judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), work)
        return materialise(out.select("doc_id", *COUNTS, "base_failed", "kept", "oddness"), "quality")
