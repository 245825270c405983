"""Exact quantiles by counts of ranges: no buffer holds all values.

1. A sketch of bounded size gives each group two edges around each wanted quantile, sure to bracket it (``ACCURACY`` bounds the sketch's error in ranks).
2. One aggregation counts the values below the lower edge and those in the bracket.
3. Only values in a bracket, a few in ``ACCURACY`` of all, are kept, as (value, count).
4. Their counts are summed up along the value, in ``PIECES`` ranges with carry, and the one or two values at the wanted rank are picked and interpolated.

A group of fewer than ``ACCURACY`` values is its own bracket. Groups may be null; null values are left out; a group without values has null quantiles.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import scan
from tidemark.operators.rounds import checkpointed

ACCURACY, PIECES = 10_000, 64
#: Tasks that a group's values are dealt to.
SPREAD = 16


def quantiles(df: DataFrame, by: Sequence[str], col: str, probs: Sequence[float], out: str = "q") -> DataFrame:
    """``by`` and ``out``: an array of the linearly interpolated quantiles ``probs`` of ``col`` in double precision, exact for any number of rows."""
    # three passes read them, and must read the same last digits: edges are values, so files, not rows that are computed again where a cached block is not at hand
    own = checkpointed(df.select(F.struct(F.lit(0).alias("__one"), *[F.col(c) for c in by]).alias("__g"), F.col(col).cast("double").alias("__v")))
    slack = 3 / ACCURACY
    edges = [x for p in probs for x in (max(0.0, p - slack), min(1.0, p + slack))]
    sketch = own.groupBy("__g").agg(F.count("__v").alias("__n"), F.min("__v").alias("__min"), F.max("__v").alias("__max"), F.percentile_approx("__v", edges, ACCURACY).alias("__e"))
    sketch = checkpointed(sketch)  # a row a group
    whole = F.col("__n") < ACCURACY

    def bracket(k: int, p: float):
        place = F.lit(p) * (F.col("__n") - 1)
        low = F.when(whole | F.lit(p <= slack), F.col("__min")).otherwise(F.col("__e")[2 * k])
        high = F.when(whole | F.lit(p >= 1 - slack), F.col("__max")).otherwise(F.col("__e")[2 * k + 1])
        return F.struct(F.lit(k).alias("k"), low.alias("low"), high.alias("high"), F.floor(place).alias("at"), (place - F.floor(place)).alias("part"))

    wanted = sketch.where("__n > 0").select("__g", F.array(*[bracket(k, p) for k, p in enumerate(probs)]).alias("__t"))
    if by:  # a group may hold most rows: they are dealt to several tasks
        dealt = own.where("__v is not null").withColumn("__salt", F.pmod(F.xxhash64("__v"), F.lit(SPREAD)))
        rows = dealt.join(wanted.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1)).cast("array<long>"))), ["__g", "__salt"]).drop("__salt")
    else:  # one row
        rows = own.where("__v is not null").join(F.broadcast(wanted), "__g")
    below = rows.groupBy("__g").agg(*[F.count(F.when(F.col("__v") < F.col("__t")[k]["low"], 1)).alias(f"__below{k}") for k in range(len(probs))])
    below = below.select("__g", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"__below{k}").alias("below")) for k in range(len(probs))])).alias("__b"))
    inside = rows.withColumn("__t", F.explode(F.filter("__t", lambda t: (F.col("__v") >= t["low"]) & (F.col("__v") <= t["high"]))))
    values = inside.groupBy("__g", F.col("__t.k").alias("k"), "__v").agg(F.count(F.lit(1)).alias("__c"), F.first("__t").alias("__t"))
    width = F.col("__t.high") - F.col("__t.low")
    piece = F.when(width > 0, F.least(F.lit(PIECES - 1.0), F.floor((F.col("__v") - F.col("__t.low")) / width * PIECES))).otherwise(0)
    upto = scan.summed(values, ["__g", "k"], ["__v"], piece, "__c", "__upto")
    counted = upto.join(below.select("__g", F.col("__b.k").alias("k"), "__b.below"), ["__g", "k"]).withColumn("__upto", F.col("__upto") + F.col("below"))
    first, at = F.col("__upto") - F.col("__c"), F.col("__t.at")
    holds = lambda rank: F.max(F.when((first <= rank) & (rank < F.col("__upto")), F.col("__v")))
    picked = counted.groupBy("__g", "k").agg(holds(at).alias("a"), holds(at + 1).alias("b"), F.first("__t.part").alias("part"))
    value = F.when(F.col("part") > 0, F.col("a") * (1 - F.col("part")) + F.col("b") * F.col("part")).otherwise(F.col("a"))
    rows = picked.groupBy("__g").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", value.alias("v")))), lambda x: x["v"]).alias(out))
    return sketch.select("__g").join(rows, "__g", "left").select(*[F.col(f"__g.{c}").alias(c) for c in by], out)
