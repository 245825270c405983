"""As-of, tolerance and interval joins without range joins: unions ordered by time, and scans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators import scan


def _both(left: DataFrame, right: DataFrame, by: Sequence[str], left_on: str, right_on: str, tie: Sequence[str], right_first: bool) -> tuple[DataFrame, list[str], list[str]]:
    rcols = [c for c in right.columns if c not in by]
    lcols = [c for c in left.columns if c not in by]
    r = right.select(*by, F.col(right_on).alias("__t"), F.lit(0 if right_first else 1).alias("__side"), F.struct(*[F.col(c) for c in tie] or [F.lit(0)]).alias("__tie"), F.struct(*[F.col(c) for c in rcols]).alias("__r"))
    l = left.select(*by, F.col(left_on).alias("__t"), F.lit(1 if right_first else 0).alias("__side"), F.struct(*[F.col(c) for c in lcols]).alias("__l"))
    return r.unionByName(l, allowMissingColumns=True), lcols, rcols


def _found(both: DataFrame, by: Sequence[str], lcols: list[str], rcols: list[str], how: str, bucket: Column | None) -> DataFrame:
    if bucket is None:  # numbers have no width of their own: one bucket
        bucket = scan.days("__t") if dict(both.dtypes)["__t"].startswith(("date", "timestamp")) else F.lit(0)
    found = scan.running(both, by, ["__t", "__side", "__tie"], bucket, "__r", "__m", how).where("__l is not null")
    return found.select(*by, *[F.col(f"__l.{c}").alias(c) for c in lcols], *[F.col(f"__m.{c}").alias(c) for c in rcols])


def asof(left: DataFrame, right: DataFrame, by: Sequence[str], left_on: str, right_on: str, tie: Sequence[str] = (), inclusive: bool = True, bucket: Column | None = None) -> DataFrame:
    """``left`` with the columns of the latest ``right`` row at or before ``left_on`` (before it, unless ``inclusive``).

    Equal times: the last in order of ``tie``, which alone goes on to the scan. Both sides are one sequence by time, scanned in buckets (by default of days) with carry, so that a key with most rows is no
    single task. ``bucket``: another expression on the time, ``__t``, that never falls as it rises;
    times that are numbers have one bucket without it.
    """
    if tie:  # rows of one time are one row before anything is shuffled
        rest = [c for c in right.columns if c not in (*by, right_on)]
        last = right.groupBy(*by, right_on).agg(F.max_by(F.struct(*rest), F.struct(*tie)).alias("__x"))
        right = last.select(*[c if c in (*by, right_on) else F.col(f"__x.{c}").alias(c) for c in right.columns])
    both, lcols, rcols = _both(left, right, by, left_on, right_on, tie, inclusive)
    return _found(both, by, lcols, rcols, "last", bucket)


def asof_forward(left: DataFrame, right: DataFrame, by: Sequence[str], left_on: str, right_on: str, inclusive: bool = True, bucket: Column | None = None) -> DataFrame:
    """``left`` with the columns of the earliest ``right`` row at or after ``left_on``."""
    both, lcols, rcols = _both(left, right, by, left_on, right_on, (), not inclusive)
    return _found(both, by, lcols, rcols, "next", bucket)


def active_views(views: DataFrame, at: DataFrame, max_age: int = 120) -> DataFrame:
    """The latest view of each (rebal_date, ticker) of ``at``; a latest view that is too old is dropped, and no older one replaces it."""
    found = asof(at, views, ["ticker"], "rebal_date", "view_date", ["seq"])
    return found.where(F.datediff("rebal_date", "view_date") <= max_age)


def within_days(left: DataFrame, right: DataFrame, by: Sequence[str], left_on: str, right_on: str, days: int, position: str, key: Sequence[str]) -> DataFrame:
    """``left`` (unique by ``key``) with the first ``right`` row, in order of ``position``, within ``days`` of it; unmatched rows go.

    The band is an equi-join: dates are cut into bins as wide as the band, and a right row goes to its bin and both neighbours.
    """
    width = 2 * days + 1
    bin_ = lambda c: F.floor(F.datediff(F.col(c), F.lit("1970-01-01").cast("date")) / width)
    l = left.withColumn("__bin", bin_(left_on))
    r = right.withColumn("__bin", F.explode(F.array(*[bin_(right_on) + i for i in (-1, 0, 1)])))
    joined = l.join(r, [*by, "__bin"]).where(F.abs(F.datediff(left_on, right_on)) <= days)
    w = Window.partitionBy(*key).orderBy(position)
    return joined.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k", "__bin")


def split_factor(ranges: DataFrame, splits: DataFrame) -> DataFrame:
    """``ranges`` (ticker, since, until) with the product of num / den of the splits in (since, until]; 1 without any. den = 0 is skipped."""
    ok = splits.where("den <> 0").select(F.col("ticker").alias("__t"), F.col("date").alias("__d"), F.try_divide("num", "den").alias("__f"))
    joined = ranges.join(ok, (F.col("ticker") == F.col("__t")) & (F.col("__d") > F.col("since")) & (F.col("__d") <= F.col("until")), "left")
    return joined.groupBy("ticker", "since", "until").agg(F.coalesce(F.product("__f"), F.lit(1.0)).alias("factor"))
