"""Point-in-time fundamentals: estimates matched to reported quarters, surprises, facts latest by form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import scalars as s
from tidemark.operators import asof, scan


def matched_quarters(quarters: DataFrame, estimates: DataFrame, days: int = 5) -> DataFrame:
    """``quarters`` (ticker, pos, date, ...) with the first of ``estimates`` (ticker, epos, edate, ...), in file order, within ``days``; others go."""
    return asof.within_days(quarters, estimates, ["ticker"], "date", "edate", days, "epos", ["ticker", "pos"])


def latest_reported(at: DataFrame, matched: DataFrame) -> DataFrame:
    """For each (ticker, view_date) of ``at`` the first matched quarter in file order that was filed strictly before it.

    Quarters and dates are one sequence by time, and the least quarter so far is a running minimum: a row of each, not a row a pair.
    """
    cols = [c for c in matched.columns if c not in ("ticker", "view_date")]
    order = ["pos", *[c for c in cols if c != "pos"]]
    q = matched.select("ticker", F.col("filing_date").alias("__t"), F.lit(1).alias("__side"), F.struct(*order).alias("__q"))
    a = at.select("ticker", F.col("view_date").alias("__t"), F.lit(0).alias("__side"), F.struct(*[F.col(c) for c in at.columns]).alias("__a"))
    both = q.unionByName(a, allowMissingColumns=True)
    found = scan.running(both, ["ticker"], ["__t", "__side"], scan.days("__t"), "__q", "__m", "least").where("__a is not null and __m is not null")
    return found.select(*[F.col(f"__a.{c}").alias(c) for c in at.columns], *[F.col(f"__m.{c}").alias(c) for c in cols])


def surprises(df: DataFrame, limit: float = 200.0) -> DataFrame:
    """Columns eps, eps_avg, eps_high, eps_low, revenue, revenue_avg become eps_surprise, dispersion, revenue_surprise and amounts in
    billions; where the EPS surprise is beyond ``limit``, all of EPS and the revenue surprise are NULL."""
    raw = s.surprise_pct(F.col("eps"), F.col("eps_avg"))
    own = df.withColumn("__raw", raw)
    cut = lambda c: s.unless_extreme(F.col(c), F.col("__raw"), limit)
    own = own.withColumn("revenue_surprise", s.unless_extreme(s.revenue_surprise_pct(F.col("revenue"), F.col("revenue_avg")), F.col("__raw"), limit))
    for c in ("eps", "eps_avg", "eps_high", "eps_low"):
        own = own.withColumn(c, cut(c))
    own = own.withColumn("eps_surprise", cut("__raw")).withColumn("dispersion", s.dispersion(F.col("eps_high"), F.col("eps_low"), F.col("eps_avg")))
    return own.withColumn("revenue_bn", s.billions(F.col("revenue"))).withColumn("revenue_avg_bn", s.billions(F.col("revenue_avg"))).drop("__raw")


def z_score(df: DataFrame, by: str, col: str, out: str) -> DataFrame:
    """Cross-sectional z with the population deviation; 0 where there is none."""
    w = Window.partitionBy(by)
    z = F.try_divide(F.col(col) - F.avg(col).over(w), F.nullif(F.stddev_pop(col).over(w), F.lit(0.0)))
    return df.withColumn(out, F.coalesce(z, F.lit(0.0)))


def z_to_bps(z):
    return F.bround(F.greatest(F.lit(-300.0), F.least(F.lit(300.0), z * 100))).cast("int")
