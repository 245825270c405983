"""Benchmark decontamination by spaced seeds, on DataFrame functions alone.

A text is a sequence of lower-cased words (runs of letters and digits). A seed is a fixed mask over
consecutive words, such as ``1101``: the words under a 1 are hashed, those under a 0 are ignored. The six masks
are all choices of three words out of five that begin with the first. Every window of every document is hashed
under every mask and joined with the hashes of the benchmark's windows. A hit gives a diagonal (window in the
document minus window in the item). Around it the whole item is laid along the document, and its words are
compared one by one. A document is contaminated by an item where

* at least ``min_share`` of the item's words, and at least ``min_words``, agree on one diagonal, or
* a stretch of one diagonal scores ``overlap`` or more: its agreeing words less ``MISS`` for each other word, or
* the item has fewer words than ``min_words``, and all of them stand in the document in a row.

Every such alignment is hit. Where 60 % of ten words or more agree, some five in a row hold three that agree; 8 of 8
or 9 do so too, and so does a stretch of the second kind. Of hits, only those are compared whose word before disagrees:
the first hit of a diagonal is one, as three agreeing words of five with an agreeing word before them hit one word earlier.
Diagonals are not joined: an item with a word inserted or dropped counts where one side of it passes alone.

Scale: words are hashed once; a document's windows are exploded, hashed, probed and dropped in one code-generated stage,
and a hit is verified where it is found, so that only passages over the rule leave the stage. Broadcast are the benchmark's seeds
(three numbers each) and its hashed words, where they are at most ``BROADCAST_ROWS`` together (counted first). Beyond, seeds are
joined by a shuffle, with the benchmark's repeated for ``SPREAD`` tasks each, so that a frequent seed does not meet in one.

Cases: null and empty texts have no windows and give no rows; null and repeated ids are judged row by row, by ``clean`` too. Items of fewer than
``min_words`` words are hashed by one solid mask of their own length. Repeated documents and repeated items give one row for
each pair of ids and length of the item. Very long texts are worked on whole. Empty tables give an empty result. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import dealt_join, table

#: Fixed masks: three words out of five, the first among them.
MASKS = ("111", "1101", "11001", "1011", "10101", "10011")
#: Of an item's words, the share that must agree on one diagonal, and their least number.
MIN_SHARE, MIN_WORDS = 0.6, 8
#: Least score of a stretch, and what a word that differs takes from it.
OVERLAP, MISS = 13, 4
#: Benchmark seeds and words that may be broadcast (some 30 bytes each); counted before the join.
BROADCAST_ROWS = 2_000_000
#: Tasks that a benchmark seed is sent to, where seeds are joined by a shuffle.
SPREAD = 8


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits, hashed."""
    return F.transform(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda w: F.xxhash64(w))


def seeds(df: DataFrame, toks: str, masks: Sequence[str], at: str, out: str) -> DataFrame:
    """A row for each window and mask: the window's position and the hash of the words under the mask; none where the mask passes the text's end.
    No expression here falls back from code generation: the words stay one array in the generated loop, and are copied for no window."""
    span = max(map(len, masks))
    each = df.withColumn(at, F.explode(F.when(F.size(toks) > 0, F.sequence(F.lit(0), F.size(toks) - 1))))
    each = each.withColumns({f"__w{k}": F.get(toks, F.col(at) + k) for k in range(span)})
    own = [F.when(F.col(f"__w{len(m) - 1}").isNotNull(), F.xxhash64(F.lit(m), *[f"__w{k}" for k, bit in enumerate(m) if bit == "1"])) for m in masks]
    each = each.withColumn("__seeds", F.array(*own)).drop(*[f"__w{k}" for k in range(span)])
    return each.withColumn(out, F.explode("__seeds")).drop("__seeds").where(F.col(out).isNotNull())


def covered(toks: Column, item: Column, at: Column) -> Column:
    """The document's words that the item lies on, from the item's word ``max(0, -at)`` on."""
    return F.slice(toks, F.greatest(at, F.lit(0)) + 1, F.size(item) - F.greatest(F.lit(0), -at))


def agreeing(cover: Column, item: Column, at: Column) -> Column:
    """For each word of ``cover``, whether the item's agrees."""
    back = F.greatest(F.lit(0), -at)
    return F.zip_with(cover, F.slice(item, back + 1, F.size(item)), lambda a, b: F.coalesce(a == b, F.lit(False)))


def score(same: Column) -> Column:
    """The best stretch: its agreeing words less ``MISS`` for each other one."""
    zero = F.struct(F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(s: Column, x: Column) -> Column:
        run = F.greatest(F.lit(0), s["run"] + F.when(x, 1).otherwise(-MISS))
        return F.struct(run.alias("run"), F.greatest(s["best"], run).alias("best"))

    return F.aggregate(same, zero, step, lambda s: s["best"])


def diagonals(texts: DataFrame, items: DataFrame, masks: Sequence[str], short: Sequence[int], min_words: int) -> DataFrame:
    """doc_id, item_id, item, cover, at of the diagonals that a seed hits, some more than once. ``short``: the sizes of items below ``min_words``."""
    every = [*masks, *["1" * n for n in short if "1" * n not in masks]]
    items = items.dropDuplicates(["item_id", "item"]).withColumn("item_row", F.xxhash64("item_id", "item"))
    tests = seeds(items.where(F.size("item") >= min_words), "item", masks, "j", "seed").select("seed", "item_row", "j")
    for n in short:
        tests = tests.unionByName(seeds(items.where(F.size("item") == n), "item", ["1" * n], "j", "seed").select("seed", "item_row", "j"))
    windows = seeds(texts, "toks", every, "i", "seed")
    at = F.col("i") - F.col("j")
    cover = covered(F.col("toks"), F.col("item"), at)
    if tests.limit(BROADCAST_ROWS + 1).count() + (items.agg(F.sum(F.size("item"))).first()[0] or 0) <= BROADCAST_ROWS:
        # whole texts must not leave the generated loop: it holds all rows of a text at once
        begins = (F.col("i") == 0) | (F.col("j") == 0) | (F.get("toks", F.col("i") - 1) != F.get("item", F.col("j") - 1))
        found = windows.join(F.broadcast(tests), "seed").join(F.broadcast(items), "item_row").where(begins)
        return found.select("doc_id", "item_id", "item", cover.alias("cover"), at.alias("at"))
    # by a key of the row: ids may be null or repeated
    texts = texts.withColumn("row", F.xxhash64("doc_id", "toks"))
    windows = seeds(texts, "toks", every, "i", "seed").select("row", "i", "seed", F.pmod(F.xxhash64("row", "i"), F.lit(SPREAD)).cast("int").alias("salt"))
    tests = tests.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    pairs = windows.join(tests, ["seed", "salt"]).select("row", "item_row", at.alias("at")).distinct()
    return pairs.join(items, "item_row").join(texts.dropDuplicates(["row"]), "row").select("doc_id", "item_id", "item", covered(F.col("toks"), F.col("item"), F.col("at")).alias("cover"), "at")


def contamination(docs: DataFrame, benchmark: DataFrame, masks: Sequence[str] = MASKS, min_share: float = MIN_SHARE, min_words: int = MIN_WORDS, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, item_id, item_words, matched_words, share, at (first word of the item in the document, from
    0; negative where the document begins inside the item), overlap (score of the diagonal's best stretch): one row for each document and item."""
    items = benchmark.select("item_id", words(F.col("text")).alias("item")).where(F.size("item") > 0)
    texts = docs.select("doc_id", words(F.col("text")).alias("toks"))
    short = sorted(r["n"] for r in items.where(F.size("item") < min_words).select(F.size("item").alias("n")).distinct().collect())  # fewer than ``min_words``
    same = diagonals(texts, items, masks, short, min_words).withColumn("same", agreeing(F.col("cover"), F.col("item"), F.col("at")))
    same = same.select("doc_id", "item_id", F.size("item").alias("item_words"), F.size(F.filter("same", lambda x: x)).alias("matched_words"), score(F.col("same")).alias("overlap"), "at")
    whole = (F.col("matched_words") >= min_words) & (F.col("matched_words") >= F.lit(min_share) * F.col("item_words")) | (F.col("overlap") >= overlap)
    kept = same.where(F.when(F.col("item_words") < min_words, F.col("matched_words") == F.col("item_words")).otherwise(whole))
    best = kept.groupBy("doc_id", "item_id", "item_words").agg(F.max(F.struct("matched_words", (-F.col("at")).alias("back"), "overlap")).alias("b"))
    share = F.round(F.col("b.matched_words") / F.col("item_words"), 6)
    return best.select("doc_id", "item_id", "item_words", "b.matched_words", share.alias("share"), (-F.col("b.back")).alias("at"), "b.overlap")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs``, a written table, without the rows whose text is contaminated; all columns stay. A row is judged by its own text alone, told by 128 bits of hashes: null and
    repeated ids keep their clean rows. Rows of a text that very many share are dealt to several tasks."""
    own = docs.withColumn("__text", F.concat_ws("-", F.xxhash64("text"), F.xxhash64(F.lit("text"), "text")))
    bad = contamination(own.select(F.col("__text").alias("doc_id"), "text"), benchmark).select(F.col("doc_id").alias("__text")).distinct()
    return dealt_join(own, bad, "__text", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: The same rule by brute force: every pair of equal words gives a diagonal, and every diagonal is judged. Items of fewer than ``MIN_WORDS`` words must agree
#: word for word; a stretch's best score is the greatest rise of the running score.
ORACLE = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents), b AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM benchmark),
dw AS (SELECT doc_id, unnest(w) AS x, unnest(range(len(w))) AS i FROM d), bw AS (SELECT item_id, len(w) AS n, unnest(w) AS x, unnest(range(len(w))) AS j FROM b),
m AS (SELECT doc_id, item_id, n, i - j AS diagonal, j FROM dw JOIN bw USING (x)),
many AS (SELECT doc_id, item_id, n, diagonal, count(*) AS matched FROM m GROUP BY ALL HAVING count(*) >= least(n, {MIN_WORDS})),
r AS (SELECT *, row_number() OVER w AS k FROM m JOIN many USING (doc_id, item_id, n, diagonal) WINDOW w AS (PARTITION BY doc_id, item_id, n, diagonal ORDER BY j)),
s AS (SELECT *, k - {MISS} * (j + 1 - k) AS after, k - 1 - {MISS} * (j + 1 - k) AS before FROM r),
t AS (SELECT doc_id, item_id, n, diagonal, matched, after - min(before) OVER (PARTITION BY doc_id, item_id, n, diagonal ORDER BY j) AS score FROM s),
g AS (SELECT doc_id, item_id, n, diagonal, matched, max(score) AS overlap FROM t GROUP BY ALL),
kept AS (SELECT * FROM g WHERE CASE WHEN n < {MIN_WORDS} THEN matched = n ELSE matched >= {MIN_SHARE} * n OR overlap >= {OVERLAP} END),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id, n ORDER BY matched DESC, diagonal, overlap DESC) AS place FROM kept)
SELECT doc_id, item_id, n::INT AS item_words, matched::INT AS matched_words, round(matched / n, 6) AS share, diagonal::INT AS at, overlap::INT AS overlap FROM best WHERE place = 1"""

#: ``clean`` in SQL: the rows whose text no item contaminates.
CLEAN = f"WITH bad AS (SELECT DISTINCT doc_id AS text FROM ({ORACLE.replace('doc_id, regexp', 'text AS doc_id, regexp')})) SELECT * FROM documents WHERE text IS NULL OR text NOT IN (SELECT text FROM bad)"
