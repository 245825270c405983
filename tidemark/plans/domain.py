"""The domain's tables, mapped onto the star-schema tables: assets are brands, prices are smoothed line prices, views are orders."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators import asof, backtest, calendar, panel
from tidemark.operators.rounds import checkpointed

SPAN = (date(1995, 1, 1), date(2001, 12, 31))


#: Bytes of an Arrow batch: rows may be long texts, and Python holds a batch and what it makes of it.
BATCH = 8 << 20


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    unset = f"{BATCH + 1}b"
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", unset) == unset:  # the session names no bound of its own
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{BATCH}b")
    return spark.read.parquet(f"{sf}/{name}.parquet")


def universe(spark: SparkSession, sf: str) -> DataFrame:
    """ticker, ord."""
    names = table(spark, sf, "part").select(F.col("p_brand").alias("ticker")).distinct()
    return names.withColumn("ord", F.row_number().over(Window.orderBy("ticker")))  # a row an asset


def raw_prices(spark: SparkSession, sf: str) -> DataFrame:
    """ticker, date, px: a brand's mean line price of a day."""
    li = table(spark, sf, "lineitem").select("l_partkey", F.to_date("l_shipdate").alias("date"), F.col("l_extendedprice").cast("decimal(15,2)").alias("p"))
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("ticker"))
    return li.join(part, "l_partkey").groupBy("ticker", "date").agg((F.sum("p").cast("double") / F.count(F.lit(1))).alias("px"))


def prices(spark: SparkSession, sf: str) -> DataFrame:
    """ticker, date, close: 21-row trailing mean on the dense grid, filled forward over 5 rows at most."""
    return panel.smoothed(panel.grid(checkpointed(raw_prices(spark, sf))), "px", 21, 5).select("ticker", "date", F.col("px").alias("close"))


def dim(df: DataFrame, most: int = 100_000) -> DataFrame:
    """A calendar-sized table as local rows, computed once; more than ``most`` rows stay a plan."""
    rows = df.limit(most + 1).toArrow()
    return df.sparkSession.createDataFrame(rows, df.schema) if rows.num_rows <= most else df


def rets(spark: SparkSession, sf: str) -> DataFrame:
    """Complete-case returns, as files: a query computes them once and hands them on, and no plan that reads them holds theirs."""
    return checkpointed(panel.complete_dates(panel.returns(prices(spark, sf)).where("ret is not null"), universe(spark, sf)))


def views(spark: SparkSession, sf: str) -> DataFrame:
    """ticker, view_date, view_bps, confidence, filing_type, sentiment, seq (file order)."""
    first = table(spark, sf, "lineitem").where("l_linenumber = 1").groupBy("l_orderkey").agg(F.min("l_partkey").alias("p_partkey"))
    part = table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("ticker"))
    orders = table(spark, sf, "orders")
    o = orders.select(
        F.col("o_orderkey").alias("l_orderkey"),
        F.date_add(F.to_date("o_orderdate"), 1).alias("view_date"),
        (F.pmod(F.round(F.col("o_totalprice") * 100).cast("long"), F.lit(601)) - 300).cast("int").alias("view_bps"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "high").when(F.col("o_orderpriority") == "5-LOW", "low").otherwise("medium").alias("confidence"),
        F.when(F.col("o_orderstatus") == "F", "10-K").otherwise("10-Q").alias("filing_type"),
        F.when(F.col("o_orderpriority") == "2-HIGH", "confident").when(F.col("o_orderpriority") == "3-MEDIUM", "concerned").otherwise("neutral").alias("sentiment"),
        F.col("o_orderkey").alias("seq"),
    )
    return o.join(first, "l_orderkey").join(part, "p_partkey").select("ticker", "view_date", "view_bps", "confidence", "filing_type", "sentiment", "seq")


def periods(spark: SparkSession, sf: str, r: DataFrame | None = None) -> DataFrame:
    days = (rets(spark, sf) if r is None else r).select("date").distinct()
    return dim(calendar.trade_periods(calendar.rebalance_dates(spark, *SPAN), days))


def setting(spark: SparkSession, sf: str, r: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The periods (of the returns ``r``) and the universe, each computed once for a query: what is small and used many times in its plan."""
    return periods(spark, sf, r), dim(universe(spark, sf))


def at_rebalances(p: DataFrame, u: DataFrame) -> DataFrame:
    return u.select("ticker").crossJoin(F.broadcast(p.select("rebal_date"))).select("rebal_date", "ticker")


def active(spark: SparkSession, sf: str, p: DataFrame | None = None, u: DataFrame | None = None) -> DataFrame:
    if p is None or u is None:
        p, u = setting(spark, sf)
    return asof.active_views(views(spark, sf), at_rebalances(p, u))


def weights(spark: SparkSession, sf: str, p: DataFrame | None = None, u: DataFrame | None = None) -> DataFrame:
    """strategy, rebal_date, ticker, w of the strategies that need no covariance."""
    if p is None or u is None:
        p, u = setting(spark, sf)
    a = checkpointed(active(spark, sf, p, u))
    parts = {"equal_weight": backtest.equal_weight(p, u), "top_n_views": backtest.ranked_views(p, u, a), "bottom_n_views": backtest.ranked_views(p, u, a, best=False)}
    out = None
    for name, w in parts.items():
        own = w.select(F.lit(name).alias("strategy"), "rebal_date", "ticker", "w")
        out = own if out is None else out.unionByName(own)
    return out


def backtested(spark: SparkSession, sf: str, cost_bps: float = 10.0, r: DataFrame | None = None, own: tuple[DataFrame, DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    r = rets(spark, sf) if r is None else r
    p, u = setting(spark, sf, r) if own is None else own
    return backtest.run(r, p, weights(spark, sf, p, u), u, cost_bps)
