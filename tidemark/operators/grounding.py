"""Whether quoted evidence occurs in its source: exactly, or else by similarity."""

from __future__ import annotations

import math
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as t

#: Quotes that may be broadcast; counted before.
QUOTES = 100_000
RESULT = "grounded boolean, score double, method string"


def checks(quotes: Iterable[str | None], docs: Iterable[str], least: int = 30, threshold: float = 90.0, floor: float = 0.0) -> list[tuple[bool, float, str]]:
    """``docs`` are normalised already. Similarities of all quotes are found together; of one that is at most ``floor`` no more than that is found out."""
    out, open_ = [], {}
    for quote, doc in zip(quotes, docs, strict=True):
        q = t.normalised(quote)
        if q and q not in doc and len(q) >= least:
            open_[len(out)] = (q, doc)
        out.append((False, 0.0, "empty") if not q else (True, 100.0, "exact") if q in doc else (False, 0.0, "none"))
    for i, s in zip(open_, t.partial_ratios(list(open_.values()), floor), strict=True):
        out[i] = (True, s, "fuzzy") if s >= threshold else (False, s, "none")
    return out


def check(quote: str | None, doc: str, least: int = 30, threshold: float = 90.0) -> tuple[bool, float, str]:
    """``doc`` is normalised already."""
    return checks([quote], [doc], least, threshold)[0]


def exact(df: DataFrame, quote: str = "quote", doc: str = "doc") -> DataFrame:
    """Adds ``exact``: the normalised quote stands in the normalised text. Python sees only texts that are not composed."""
    both = df.withColumns({"__q": t.normalise(F.col(quote), True), "__d": t.normalise(F.col(doc), True)})
    return both.withColumn("exact", (F.length("__q") > 0) & F.contains("__d", "__q")).drop("__q", "__d")


def grounded(df: DataFrame, quote: str = "quote", doc: str = "doc", least: int = 30, threshold: float = 90.0, scores: bool = True) -> DataFrame:
    """Adds grounded, score, method; without ``scores`` only grounded and method, which cost less. Each text is normalised once."""
    floor = 0.0 if scores else math.nextafter(threshold, 0.0)  # less than any score that grounds

    @F.pandas_udf(RESULT)
    def check_all(q: pd.Series, d: pd.Series) -> pd.DataFrame:
        docs = (t.normalised(y) if x else "" for x, y in zip(q, d, strict=True))
        return pd.DataFrame(checks(q, docs, least, threshold, floor), columns=["grounded", "score", "method"])

    own = df.repartition(df.sparkSession.sparkContext.defaultParallelism * 4).withColumn("__r", check_all.asNondeterministic()(quote, doc))  # so that no filter repeats it
    return own.select(*df.columns, *[f"__r.{c}" for c in ("grounded", "score", "method") if scores or c != "score"])


def kept_facts(facts: DataFrame) -> DataFrame:
    """Risk factors and events without grounded evidence go; guidance stays, its quote does not. ``facts``: kind, quote, grounded, ..."""
    ok = F.coalesce(F.col("grounded"), F.lit(False))
    return facts.where((F.col("kind") == "guidance") | ok).withColumn("quote", F.when(ok, F.col("quote")))


def summary(facts: DataFrame, by: str) -> DataFrame:
    """by, total_facts, grounded, dropped, rate."""
    ok = F.coalesce(F.col("grounded"), F.lit(False)).cast("long")
    return facts.groupBy(by).agg(F.count(F.lit(1)).alias("total_facts"), F.sum(ok).alias("grounded"), F.sum(1 - ok).alias("dropped"), F.avg(ok.cast("double")).alias("rate"))


def containing(docs: DataFrame, quotes: DataFrame) -> DataFrame:
    """doc_id, item_id: normalised documents (doc_id, x) that hold a normalised quote (item_id, y). Rows that are equal altogether count once.

    A quote's second to fourth words are whole words of any text that holds it, if it has five or more: their hash joins the two,
    and ``contains`` verifies. Shorter quotes are held against every text; their number is bounded before they are broadcast.
    """
    words = F.split("y", " ")
    own = quotes.where(F.length("y") > 0).withColumn("n", F.size(words))
    keyed = own.where("n >= 5").select("item_id", "y", F.xxhash64(words[1], words[2], words[3]).alias("key"))
    at = docs.withColumn("w", F.split("x", " ")).withColumn("i", F.explode(F.expr("if(size(w) > 2, sequence(0, size(w) - 3), array())")))
    at = at.select("doc_id", "x", F.xxhash64(*[F.get("w", F.col("i") + k) for k in range(3)]).alias("key"))
    small = keyed.limit(QUOTES + 1).count() <= QUOTES
    long_ = at.join(F.broadcast(keyed) if small else keyed, "key").where(F.contains("x", "y")).select("doc_id", "item_id", F.xxhash64("x").alias("d")).distinct().drop("d")
    short = own.where("n < 5").select("item_id", "y")
    n = short.limit(QUOTES + 1).count()
    if n > QUOTES:
        raise ValueError(f"more than {QUOTES} quotes of fewer than five words")
    return long_.unionByName(docs.join(F.broadcast(short), F.contains("x", "y")).select("doc_id", "item_id")) if n else long_
