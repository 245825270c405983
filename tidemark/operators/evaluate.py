"""Matching of events to a gold standard, precision and recall, agreement of repeated runs."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import text as t
from tidemark.operators.rounds import checkpointed


def greedy(scores: list[tuple[float, int, int]], threshold: float = 60.0, look: tuple[float, float] | None = None) -> list[tuple]:
    """One-to-one pairs (i, j, score), best first; ties go to the higher i, then the higher j.

    With a range ``look`` they are (i, j, score, matched, look), and pairs below the threshold come too, where neither side is matched yet and the
    score is in the range.
    """
    left, right, out = set(), set(), []
    for s, i, j in sorted(scores, reverse=True):
        if i in left or j in right:
            continue
        near = look is not None and look[0] <= s <= look[1]
        if s >= threshold:
            left.add(i)
            right.add(j)
        if s >= threshold or near:
            out.append((i, j, s) if look is None else (i, j, s, s >= threshold, near))
    return out


#: Tasks that a document's events are dealt to, if it has more than ``PAIRS`` pairs; bins of a histogram of characters.
SPREAD, BINS, PAIRS = 16, 32, 4096


def _measured(df: DataFrame, number: str, side: str) -> DataFrame:
    """doc, ``number`` and a struct ``side``: normalised text and quote, the text's distinct words, and histograms of the characters of both."""

    def one(text: str | None, quote: str | None) -> dict:
        x, q = t.normalised(text), t.normalised(quote)
        words = sorted({*x.split()})
        hist = lambda v: np.bincount(np.frombuffer(v.encode("utf-32-le", "surrogatepass"), np.uint32) % BINS, minlength=BINS).tolist()
        return {"x": x, "q": q, "words": words, "hx": hist(" ".join(words)), "hq": hist(q)}

    @F.pandas_udf("x string, q string, words array<string>, hx array<int>, hq array<int>")
    def measure(text: pd.Series, quote: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(a, b) for a, b in zip(text, quote, strict=True)], columns=["x", "q", "words", "hx", "hq"])

    return df.select("doc", number, *[c for c in df.columns if c == "__hot"], measure("text", "quote").alias(side))


def _bound(a: str, b: str) -> Column:
    """No less than the pair's score. Two strings have no longer common subsequence than they have characters in common, bin by bin; the ratios with the common words alone are exact."""
    shared = lambda h: F.aggregate(F.zip_with(f"{a}.{h}", f"{b}.{h}", lambda p, q: F.least(p, q)), F.lit(0), lambda n, x: n + x)
    letters = lambda words: F.aggregate(words, F.lit(0), lambda n, x: n + F.length(x) + 1) - 1
    both, left, right = F.array_intersect(f"{a}.words", f"{b}.words"), F.col(f"{a}.words"), F.col(f"{b}.words")
    some, la, lb, lc = F.size(both) > 0, letters(left), letters(right), letters(both)
    whole = some & ((F.size(both) == F.size(left)) | (F.size(both) == F.size(right)))
    ratio = lambda hit, size: F.coalesce(F.try_divide(200.0 * hit, size), F.lit(100.0))
    words = F.when(whole, 100.0).otherwise(F.greatest(ratio(shared("hx"), la + lb), F.when(some, F.greatest(ratio(lc, lc + la), ratio(lc, lc + lb))).otherwise(0.0)))
    words = F.when((F.size(left) > 0) & (F.size(right) > 0), words).otherwise(0.0)
    short, hit = F.least(F.length(f"{a}.q"), F.length(f"{b}.q")), shared("hq")
    return F.greatest(words, F.when(short > 0, ratio(hit, short + hit)).otherwise(0.0))


def scored_pairs(events: DataFrame, gold: DataFrame, least: float) -> DataFrame:
    """doc, i, j, score of the pairs of a document's events and gold events that score ``least`` or more: the larger of the texts' ``token_set_ratio`` and the quotes' ``partial_ratio``, 0 where
    either is missing. Pairs that cannot, by an upper bound that is found in the JVM, are never scored. The events of a document with more than ``PAIRS`` pairs are dealt to ``SPREAD`` tasks, and only its gold events
    are repeated for them."""

    @F.pandas_udf("double")
    def score(x: pd.Series, y: pd.Series, q: pd.Series, r: pd.Series) -> pd.Series:
        quotes = t.partial_ratios(list(zip(q, r, strict=True)))
        return pd.Series([max(t.token_set_ratio(a, b), s if c and d else 0.0) for a, b, c, d, s in zip(x, y, q, r, quotes, strict=True)], dtype=float)

    sizes = events.groupBy("doc").agg(F.count(F.lit(1)).alias("m")).join(gold.groupBy("doc").agg(F.count(F.lit(1)).alias("n")), "doc")
    hot = checkpointed(sizes.where(F.col("m") * F.col("n") > PAIRS).select("doc", F.lit(True).alias("__hot")))
    known = lambda df: df.join(hot, "doc", "left") if not hot.isEmpty() else df.withColumn("__hot", F.lit(None).cast("boolean"))
    salt = F.when(F.col("__hot"), F.pmod(F.xxhash64("i", "a.x"), F.lit(SPREAD))).otherwise(0)
    left = _measured(known(events), "i", "a").withColumn("__salt", salt).drop("__hot")
    salts = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(SPREAD - 1))).otherwise(F.array(F.lit(0))).cast("array<long>")
    right = _measured(known(gold), "j", "b").withColumn("__salt", F.explode(salts)).drop("__hot")
    likely = left.join(right, ["doc", "__salt"]).where(_bound("a", "b") >= least - 1e-9)
    return likely.select("doc", "i", "j", score("a.x", "b.x", "a.q", "b.q").alias("score")).where(F.col("score") >= least)


def best_first(pairs: DataFrame, threshold: float) -> DataFrame:
    """doc, i, j, score: what ``greedy`` keeps of ``pairs``, without a document in one group.

    In each round the pairs that are the best of their event and of their gold event, in the order of ``greedy``, are kept, and all others of either go. The best pair of all is one of them, so it
    ends, after a few rounds as a rule. Rounds are cut by checkpoints.
    """
    own = F.struct("score", "i", "j")
    left, out = checkpointed(pairs.where(F.col("score") >= threshold)), None
    while not left.isEmpty():
        ranked = left.withColumns({"__a": F.max(own).over(Window.partitionBy("doc", "i")), "__b": F.max(own).over(Window.partitionBy("doc", "j"))})
        won = ranked.where((own == F.col("__a")) & (own == F.col("__b"))).select("doc", "i", "j", "score").distinct()
        out = won if out is None else out.unionByName(won)
        left = checkpointed(left.join(won.select("doc", "i"), ["doc", "i"], "left_anti").join(won.select("doc", "j"), ["doc", "j"], "left_anti"))
    return left.select("doc", "i", "j", "score") if out is None else out


def match_events(events: DataFrame, gold: DataFrame, threshold: float = 60.0, look: tuple[float, float] | None = None) -> DataFrame:
    """doc, i, j, score of one-to-one pairs, best first (see ``greedy``), and with a range ``look`` matched and look: pairs below the threshold whose score is in the range come too, where neither
    side is matched. ``events``: doc, i, text, quote; ``gold``: doc, j, text, quote."""
    scored = checkpointed(scored_pairs(events, gold, threshold if look is None else min(threshold, look[0])))
    found = best_first(scored, threshold)
    kinds = {"doc": "long", "i": "long", "j": "long"}
    if look is not None:
        near = F.col("score").between(*look)
        open_ = scored.where((F.col("score") < threshold) & near).distinct()
        open_ = open_.join(found.select("doc", "i"), ["doc", "i"], "left_anti").join(found.select("doc", "j"), ["doc", "j"], "left_anti")
        found = found.select("*", F.lit(True).alias("matched"), near.alias("look")).unionByName(open_.select("doc", "i", "j", "score", F.lit(False).alias("matched"), F.lit(True).alias("look")))
    return found.withColumns({c: F.col(c).cast(k) for c, k in kinds.items()})


def borderline(pairs: DataFrame, n: int = 30) -> DataFrame:
    """The ``n`` pairs of lowest score that should be looked at; the limit is the list."""
    return pairs.where("look").orderBy("score", "doc", "i", "j").limit(n)


def extras(events: DataFrame, matched: DataFrame) -> DataFrame:
    """Events (doc, i) that match nothing."""
    return events.join(matched.select("doc", "i"), ["doc", "i"], "left_anti")


#: Tiers that no one tuned on (fixed values).
BLIND = ("tier1a_tuning", "tier1b_eval")


def most_extras(extra: DataFrame, docs: DataFrame, tiers: Sequence[str] = BLIND) -> DataFrame:
    """model, doc, n: of each model the document of a blind tier with the most events without a partner, the least of equals; failed documents, and models
    without such events, are left out. ``docs``: model, doc, tier, failed; ``extra``: model, doc, one row an event."""
    own = docs.where(~F.col("failed") & F.col("tier").isin(*tiers)).select("model", "doc")
    n = extra.groupBy("model", "doc").agg(F.count(F.lit(1)).alias("n")).join(own, ["model", "doc"])
    first = n.groupBy("model").agg(F.min(F.struct((-F.col("n")).alias("less"), "doc")).alias("m"))
    return first.select("model", "m.doc", (-F.col("m.less")).alias("n"))


def leaderboard(board: DataFrame) -> DataFrame:
    """model, f1, place over all tiers; no F1 counts as 0. A row a model."""
    own = board.where("scope = 'all'").select("model", "f1")
    return own.withColumn("place", F.row_number().over(Window.orderBy(F.coalesce("f1", F.lit(0.0)).desc(), "model")).cast("int"))


def scoreboard(docs: DataFrame) -> DataFrame:
    """model, scope, n_docs, success, precision, recall, grounding, f1 and f1_grounding, for each tier and all of them.

    ``docs``: model, tier, failed, n_events, n_gold, n_matched, n_quotes, n_grounded. Failed documents add to the gold events only.
    """
    ok = ~F.col("failed")
    add = lambda c: F.sum(F.when(ok, F.col(c)).otherwise(0))
    both = docs.select("*", F.explode(F.array(F.col("tier"), F.lit("all"))).alias("scope"))
    g = both.groupBy("model", "scope").agg(
        F.count(F.lit(1)).alias("n_docs"), F.avg(ok.cast("double")).alias("success"), F.try_divide(add("n_matched"), add("n_events")).alias("precision"), F.try_divide(add("n_matched"), F.sum("n_gold")).alias("recall"), F.try_divide(add("n_grounded"), add("n_quotes")).alias("grounding")
    )
    f = lambda a: F.try_divide(2 * F.col(a) * F.col("recall"), F.col(a) + F.col("recall"))
    return g.withColumn("f1", f("precision")).withColumn("f1_grounding", f("grounding"))


def jaccard(a, b):
    """Of two arrays; 1 where both are empty."""
    n = F.size(F.array_union(a, b))
    return F.when(n == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / n)


def run_pairs(runs: DataFrame, key: str, run: str, items: str) -> DataFrame:
    """key, run_a, run_b, jaccard of every pair of a key's runs."""
    b = runs.select(key, F.col(run).alias("run_b"), F.col(items).alias("__b"))
    return runs.select(key, F.col(run).alias("run_a"), F.col(items).alias("__a")).join(b, key).where("run_a < run_b").select(key, "run_a", "run_b", jaccard(F.col("__a"), F.col("__b")).alias("jaccard"))


def agreement(runs: DataFrame, key: str, col: str, n_runs: int) -> DataFrame:
    """n_docs and the share of keys with all runs there on which they agree."""
    per = runs.groupBy(key).agg(F.count(col).alias("__n"), F.count_distinct(col).alias("__k")).where(F.col("__n") == n_runs)
    return per.agg(F.count(F.lit(1)).alias("n_docs"), F.avg((F.col("__k") == 1).cast("double")).alias("agreement"))
