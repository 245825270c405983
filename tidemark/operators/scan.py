"""Segmented scans with carry: windows along a key's rows without one task for the whole key.

A key's rows are cut into buckets that follow one another in the order of the scan. Windows run within (key, bucket); a summary of each
bucket (its count, its last value, its least value) is one aggregation, and a window over a key's few summaries says what
all earlier buckets hold together: the carry, which is joined to the bucket's rows and applied. Tasks number keys times buckets, not keys.

Frames of a fixed number of rows need no carry but a margin: rows are numbered, cut into blocks of ``SIZE`` numbers, and each block borrows the
rows before and after it that its frames reach into.

Keys may be null (nulls are one key). Null times come first and are in the first bucket.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

#: Rows of a block; days of a bucket of dates.
SIZE, DAYS = 512, 92


def days(col: str | Column, width: int = DAYS) -> Column:
    """The bucket of a date or timestamp: runs of ``width`` days."""
    return F.floor(F.datediff(F.col(col) if isinstance(col, str) else col, F.lit("1970-01-01").cast("date")) / width)


def keyed(df: DataFrame, by: Sequence[str], bucket: Column) -> DataFrame:
    """``df`` with __key (a struct, so that null keys meet) and __b, which is never null."""
    return df.withColumns({"__key": F.struct(*[F.col(c) for c in by]), "__b": F.coalesce(bucket.cast("long"), F.lit(-(1 << 40)))})


def carried(own: DataFrame, parts: dict[str, tuple[Column, Callable[[Column], Column]]], reverse: bool = False) -> DataFrame:
    """__key, __b and for each part what the buckets before (after, if ``reverse``) hold together. A part: a bucket's summary, and how summaries are merged."""
    summary = own.groupBy("__key", "__b").agg(*[c.alias(k) for k, (c, _) in parts.items()])
    before = Window.partitionBy("__key").orderBy(F.col("__b").desc() if reverse else F.col("__b").asc()).rowsBetween(Window.unboundedPreceding, -1)
    return summary.select("__key", "__b", *[merge(F.col(k)).over(before).alias(k) for k, (_, merge) in parts.items()])


def numbered(df: DataFrame, by: Sequence[str], order: Sequence[str], bucket: Column, out: str = "n") -> DataFrame:
    """``df`` with ``out``: 1, 2, 3, … along ``order`` within ``by``."""
    own = keyed(df, by, bucket)
    carry = carried(own, {"__c": (F.count(F.lit(1)), F.sum)})
    place = F.row_number().over(Window.partitionBy("__key", "__b").orderBy(*order))
    return own.withColumn(out, place).join(carry, ["__key", "__b"]).withColumn(out, F.col(out) + F.coalesce("__c", F.lit(0))).drop("__key", "__b", "__c")


def running(df: DataFrame, by: Sequence[str], order: Sequence[str], bucket: Column, col: str, out: str, how: str = "last", previous: str | None = None) -> DataFrame:
    """``df`` with ``out`` over all rows up to and including a row's own: the ``last`` value of ``col`` that is not null, or the ``least`` one; ``next``: the first not null
    from a row on. ``previous``: also that of the row before (null for a key's first)."""
    own = keyed(df, by, bucket)
    rows = Window.partitionBy("__key", "__b").orderBy(*order)
    there = F.when(F.col(col).isNotNull(), F.struct(*[F.col(c) for c in order]))
    if how == "least":
        within, part, both = F.min(col).over(rows.rowsBetween(Window.unboundedPreceding, 0)), (F.min(col), F.min), F.least
    elif how == "last":
        within, part, both = F.last(col, ignorenulls=True).over(rows.rowsBetween(Window.unboundedPreceding, 0)), (F.max_by(col, there), lambda c: F.last(c, ignorenulls=True)), F.coalesce
    else:
        # the order turned round: a frame that ends at a row grows with it, one that begins there is read again for every row
        back = Window.partitionBy("__key", "__b").orderBy(*[F.col(c).desc() for c in order])
        within, part, both = F.last(col, ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0)), (F.min_by(col, there), lambda c: F.last(c, ignorenulls=True)), F.coalesce
    carry = carried(own, {"__c": part}, reverse=how == "next")
    found = own.withColumn("__w", within).join(carry, ["__key", "__b"]).withColumn(out, both("__w", "__c"))
    if previous:
        found = found.withColumn(previous, F.when(F.row_number().over(rows) == 1, F.col("__c")).otherwise(F.lag(out).over(rows)))
    return found.drop("__key", "__b", "__c", "__w")


def summed(df: DataFrame, by: Sequence[str], order: Sequence[str], bucket: Column, col: str, out: str) -> DataFrame:
    """``df`` with ``out``: the sum of ``col`` over all rows up to and including a row's own, which ``order`` must make distinct."""
    own = keyed(df, by, bucket)
    rows = Window.partitionBy("__key", "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    carry = carried(own, {"__s": (F.sum(col), F.sum)})
    return own.withColumn(out, F.sum(col).over(rows)).join(carry, ["__key", "__b"]).withColumn(out, F.col(out) + F.coalesce("__s", F.lit(0))).drop("__key", "__b", "__s")


def framed(df: DataFrame, by: Sequence[str], number: str, steps: Sequence[Callable[[WindowSpec], dict[str, Column]]], back: int = 0, ahead: int = 0, size: int = SIZE) -> DataFrame:
    """``df`` with the columns of ``steps``, one after the other: each takes a window along ``number`` (distinct within ``by``) and may look, all steps
    together, at ``back`` rows before a row's own and ``ahead`` after it, if numbers have no gaps."""
    at = F.col(number)
    blocks = F.sequence(F.floor((at - ahead) / size), F.floor((at + back) / size))
    each = df.withColumns({"__key": F.struct(*[F.col(c) for c in by]), "__b": F.explode(blocks)})
    w = Window.partitionBy("__key", "__b").orderBy(number)
    for step in steps:
        each = each.withColumns(step(w))
    return each.where(F.col("__b") == F.floor(at / size)).drop("__key", "__b")
