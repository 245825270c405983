"""Queries on prices, views, the backtest and its statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators import asof, backtest, calendar, metrics, panel, stats
from tidemark.operators.rounds import checkpointed
from tidemark.plans import domain as d
from tidemark.plans.oracle import sql

Q: dict = {}
SQL: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if oracle:
            SQL[f.__name__] = oracle
        return f

    return add


def rounded(df: DataFrame, n: int = 6) -> DataFrame:
    return df.select(*[F.round(c, n).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query(sql("SELECT ticker, date, round(ln(close), 8) AS log_close FROM prices", "prices"))
def price_panel(spark: SparkSession, sf: str) -> DataFrame:
    return d.prices(spark, sf).select("ticker", "date", F.round(F.log("close"), 8).alias("log_close"))


@query(sql("SELECT ticker, date, round(ret, 6) AS ret FROM allrets", "allrets"))
def daily_returns(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(panel.returns(d.prices(spark, sf)))


@query(sql("SELECT date, count(*) AS n, round(avg(ret), 6) AS market FROM rets GROUP BY date", "rets"))
def complete_case_market(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(d.rets(spark, sf).groupBy("date").agg(F.count(F.lit(1)).alias("n"), F.avg("ret").alias("market")))


@query(
    """WITH span AS (SELECT min(o_orderdate)::DATE AS s, max(o_orderdate)::DATE AS e FROM orders), m AS (SELECT s, e, unnest(generate_series(date_trunc('month', s)::TIMESTAMP, e::TIMESTAMP, INTERVAL 1 MONTH))::DATE AS m FROM span),
d AS (SELECT s, e, 'quarterly' AS freq, last_day(m) AS d FROM m WHERE month(m) IN (3, 6, 9, 12) UNION ALL SELECT s, e, f, last_day(m) FROM m, (VALUES ('monthly_active'), ('biweekly_active')) t(f) WHERE month(m) IN (2, 3, 4, 5, 7, 8, 10, 11)
UNION ALL SELECT s, e, 'biweekly_active', m + 14 FROM m WHERE month(m) IN (2, 3, 4, 5, 7, 8, 10, 11)) SELECT DISTINCT freq, rebal_date FROM (SELECT *, (d - greatest(0, isodow(d) - 5)::INT)::DATE AS rebal_date FROM d) WHERE rebal_date BETWEEN s AND e"""
)
def rebalance_calendar(spark: SparkSession, sf: str) -> DataFrame:
    """All three frequencies over the span of the orders' dates."""
    span = d.table(spark, sf, "orders").agg(F.to_date(F.min("o_orderdate")).alias("s"), F.to_date(F.max("o_orderdate")).alias("e"))
    out = None
    for f in calendar.FREQUENCIES:
        own = calendar.rebalances_between(span, f)
        out = own if out is None else out.unionByName(own)
    return out


@query(sql("SELECT * FROM periods", "periods"))
def trade_periods(spark: SparkSession, sf: str) -> DataFrame:
    return d.periods(spark, sf)


@query(sql("SELECT rebal_date, ticker, view_date, view_bps, confidence, seq, (rebal_date - view_date)::INT AS age FROM active", "active"))
def active_views(spark: SparkSession, sf: str) -> DataFrame:
    a = d.active(spark, sf)
    return a.select("rebal_date", "ticker", "view_date", "view_bps", "confidence", "seq", F.datediff("rebal_date", "view_date").alias("age"))


@query(
    sql(
        """SELECT rebal_date, ticker, filing_type, view_date, seq FROM (SELECT p.rebal_date, v.*, row_number() OVER (PARTITION BY p.rebal_date, v.ticker, v.filing_type ORDER BY view_date DESC, seq DESC) AS k
FROM periods p JOIN views v ON v.view_date <= p.rebal_date JOIN universe USING (ticker)) WHERE k = 1""",
        "periods", "views", "universe",
    )
)
def latest_by_form(spark: SparkSession, sf: str) -> DataFrame:
    """The latest filing of each form (a prefix of the filing's type) at every rebalance."""
    forms = spark.createDataFrame([("10-K",), ("10-Q",)], "form string")
    at = d.at_rebalances(*d.setting(spark, sf)).crossJoin(F.broadcast(forms))
    v = d.views(spark, sf).join(F.broadcast(forms), F.col("filing_type").startswith(F.col("form"))).select("ticker", "form", "view_date", "seq")
    return asof.asof(at, v, ["ticker", "form"], "rebal_date", "view_date", ["seq"]).where("view_date is not null").select("rebal_date", "ticker", F.col("form").alias("filing_type"), "view_date", "seq")


@query(sql("SELECT strategy, rebal_date, ticker, round(w, 6) AS w FROM weights", "weights"))
def strategy_weights(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(d.weights(spark, sf))


@query(sql("SELECT strategy, date, round(ret, 6) AS ret FROM net", "net"))
def backtest_daily(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(d.backtested(spark, sf)[0])


METRICS = """SELECT strategy, n_days, round(g - 1, 6) AS total_return, round(ar, 6) AS ann_return, round(vol, 6) AS ann_vol, round(CASE WHEN vol = 0 THEN 0 ELSE (ar - 0.02) / vol END, 6) AS sharpe,
round(CASE WHEN down = 0 THEN 0 ELSE (ar - 0.02) / down END, 6) AS sortino, round(mdd, 6) AS max_drawdown, round(CASE WHEN mdd = 0 THEN 0 ELSE (ar - 0.02) / abs(mdd) END, 6) AS calmar FROM (
SELECT strategy, count(*) AS n_days, exp(sum(ln(1 + ret))) AS g, pow(exp(sum(ln(1 + ret))), 252.0 / count(*)) - 1 AS ar, stddev_samp(ret) * sqrt(252) AS vol,
coalesce(stddev_samp(CASE WHEN ret < pow(1.02, 1.0 / 252) - 1 THEN ret - (pow(1.02, 1.0 / 252) - 1) END), 0) * sqrt(252) AS down, min(v / peak - 1) AS mdd FROM (
SELECT *, max(v) OVER (PARTITION BY strategy ORDER BY date ROWS UNBOUNDED PRECEDING) AS peak FROM (SELECT *, exp(sum(ln(1 + ret)) OVER (PARTITION BY strategy ORDER BY date ROWS UNBOUNDED PRECEDING)) AS v FROM net)) GROUP BY strategy)"""


@query(sql(METRICS, "net"))
def backtest_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.metrics(d.backtested(spark, sf)[0]))


@query(sql("SELECT strategy, rebal_date, round(turnover, 6) AS turnover, round(turnover * 10 / 1e4, 8) AS cost FROM turns", "turns"))
def backtest_turnover(spark: SparkSession, sf: str) -> DataFrame:
    t = d.backtested(spark, sf)[1]
    return t.select("strategy", "rebal_date", F.round("turnover", 6).alias("turnover"), F.round("cost", 8).alias("cost"))


@query(sql("SELECT strategy, round(avg(turnover), 6) AS avg_turnover, round(sum(turnover) * 10 / 1e4, 6) AS total_cost, count(*) AS n FROM turns GROUP BY strategy", "turns"))
def turnover_summary(spark: SparkSession, sf: str) -> DataFrame:
    t = d.backtested(spark, sf)[1]
    return rounded(t.groupBy("strategy").agg(F.avg("turnover").alias("avg_turnover"), F.sum("cost").alias("total_cost"), F.count(F.lit(1)).alias("n")))


@query(
    sql(
        """SELECT strategy, rebal_date, round(sum(abs(w - pw)), 6) AS turnover FROM (SELECT *, lag(w) OVER (PARTITION BY strategy, ticker ORDER BY rebal_date) AS pw FROM (
SELECT x.strategy, x.rebal_date, t.ticker, coalesce(weights.w, 0) AS w FROM (SELECT DISTINCT strategy, rebal_date FROM weights) x JOIN (SELECT DISTINCT strategy, ticker FROM weights) t USING (strategy)
LEFT JOIN weights ON weights.strategy = x.strategy AND weights.rebal_date = x.rebal_date AND weights.ticker = t.ticker)) WHERE pw IS NOT NULL GROUP BY 1, 2""",
        "weights",
    )
)
def target_turnover(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(backtest.target_turnover(d.weights(spark, sf)))


@query(
    sql(
        """SELECT bps, strategy, round(pow(exp(sum(ln(1 + r))), 252.0 / count(*)) - 1, 6) AS ann_return, round((pow(exp(sum(ln(1 + r))), 252.0 / count(*)) - 1 - 0.02) / (stddev_samp(r) * sqrt(252)), 6) AS sharpe FROM (
SELECT bps, strategy, date, g - CASE WHEN is_first THEN turnover * bps / 1e4 ELSE 0 END AS r FROM gross JOIN turns USING (strategy, rebal_date) CROSS JOIN (VALUES (0), (10), (20)) c(bps)) GROUP BY bps, strategy""",
        "gross", "turns",
    )
)
def cost_sensitivity(spark: SparkSession, sf: str) -> DataFrame:
    """Sharpe under 0, 10 and 20 bps: gross returns once, costs from a small dimension."""
    r = d.rets(spark, sf)
    p, u = d.setting(spark, sf, r)
    gross, turns = d.backtested(spark, sf, 0.0, r, (p, u))
    first = gross.join(F.broadcast(p.select(F.col("trade_date").alias("date"), "rebal_date")), "date").join(turns, ["strategy", "rebal_date"]).select("strategy", "date", "turnover")
    costs = spark.createDataFrame([(0,), (10,), (20,)], "bps int")
    all_ = gross.join(first, ["strategy", "date"], "left").crossJoin(F.broadcast(costs)).withColumn("ret", F.col("ret") - F.coalesce("turnover", F.lit(0.0)) * F.col("bps") / 1e4)
    m = metrics.metrics(all_.select(F.concat_ws("/", "bps", "strategy").alias("strategy"), "date", "ret"))
    key = F.split("strategy", "/")
    return rounded(m.select(key[0].cast("int").alias("bps"), key[1].alias("strategy"), "ann_return", "sharpe"))


DIFF = "SELECT a.date, a.ret - b.ret AS x FROM net a JOIN net b ON a.date = b.date AND a.strategy = 'top_n_views' AND b.strategy = 'bottom_n_views'"


@query(sql("SELECT count(*) AS n, round(avg(x), 8) AS mean, round(avg(x) / (stddev_samp(x) / sqrt(count(*))), 6) AS t, round(pow(1 + avg(x), 252) - 1, 6) AS ann_diff FROM diff", "net", diff=DIFF))
def return_difference_test(spark: SparkSession, sf: str) -> DataFrame:
    net = d.backtested(spark, sf)[0].where("strategy <> 'equal_weight'")
    diff = net.groupBy("date").pivot("strategy", ["top_n_views", "bottom_n_views"]).agg(F.first("ret")).select((F.col("top_n_views") - F.col("bottom_n_views")).alias("x")).where("x is not null")
    t = metrics.t_test(diff, "x")
    return t.select("n", F.round("mean", 8).alias("mean"), F.round("t", 6).alias("t"), F.round(metrics.annualised_difference(F.col("mean")), 6).alias("ann_diff"))


@query(sql("SELECT date, round(max(ret) FILTER (strategy = 'equal_weight'), 6) AS equal_weight, round(max(ret) FILTER (strategy = 'top_n_views'), 6) AS top_n_views, round(max(ret) FILTER (strategy = 'bottom_n_views'), 6) AS bottom_n_views FROM net GROUP BY date", "net"))
def returns_wide(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(d.backtested(spark, sf)[0].groupBy("date").pivot("strategy", ["equal_weight", "top_n_views", "bottom_n_views"]).agg(F.first("ret")))


@query(sql("SELECT ticker, date, round(ret_1m, 6) AS ret_1m, round(ret_3m, 6) AS ret_3m, round(vol_60d, 6) AS vol_60d FROM feats", "feats"))
def price_features(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(panel.momentum(d.prices(spark, sf)))


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """Views with the return of the 63 rows from their first trading day, and its excess over the quarter's mean."""
    f = panel.forward_return(d.prices(spark, sf))
    v = d.views(spark, sf)
    # a view on a day without a trade looks forward: the first row at or after it. Views of one asset and day have one return, so days are looked up, not views
    at = asof.asof_forward(v.groupBy("ticker", "view_date").agg(F.count(F.lit(1)).alias("n")), f, ["ticker"], "view_date", "date")
    at = checkpointed(at.withColumn("q", F.to_date(F.date_trunc("quarter", "view_date"))))
    # each quarter's mean is one number in a file: sums in another order would give views of one quarter other last digits
    mean = checkpointed(at.where("fwd is not null").groupBy("q").agg((F.sum(F.col("fwd") * F.col("n")) / F.sum("n")).alias("mean")))
    known = at.join(F.broadcast(mean.withColumnRenamed("q", "__q")), F.col("q").eqNullSafe(F.col("__q")), "left").select(F.col("ticker").alias("__ticker"), F.col("view_date").alias("__day"), "date", "fwd", "q", (F.col("fwd") - F.col("mean")).alias("fwd_excess"))
    return v.join(known, F.col("ticker").eqNullSafe(F.col("__ticker")) & F.col("view_date").eqNullSafe(F.col("__day"))).drop("__ticker", "__day")


def valued(spark: SparkSession, sf: str) -> DataFrame:
    """The scored views that have a return, as files: means, edges and medians each read the same numbers."""
    return checkpointed(scored(spark, sf).where("fwd_excess is not null").select("confidence", "view_bps", "fwd_excess"))


SCORED = """SELECT v.*, f.fwd, date_trunc('quarter', v.view_date)::DATE AS q FROM views v ASOF LEFT JOIN fwd f ON v.ticker = f.ticker AND v.view_date <= f.date"""
EXCESS = "SELECT *, fwd - avg(fwd) OVER (PARTITION BY q) AS fwd_excess FROM sc"


@query(sql("SELECT ticker, view_date, seq, q, round(fwd, 6) AS fwd, round(fwd_excess, 6) AS fwd_excess FROM ex", "views", "fwd", sc=SCORED, ex=EXCESS))
def forward_returns(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(scored(spark, sf).select("ticker", "view_date", "seq", "q", "fwd", "fwd_excess"))


@query(
    sql(
        "SELECT confidence, count(*) AS n, round(avg(fwd_excess), 6) AS mean, round(median(fwd_excess), 6) AS median, round(avg(CASE WHEN view_bps <> 0 THEN (sign(view_bps) = sign(fwd_excess))::INT END), 6) AS hit FROM ex WHERE fwd_excess IS NOT NULL GROUP BY confidence",
        "views", "fwd", sc=SCORED, ex=EXCESS,
    )
)
def confidence_buckets(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(stats.buckets(valued(spark, sf), "confidence"))


TERTILE = "SELECT *, quantile_cont(view_bps::DOUBLE, 1.0/3) OVER () AS a, quantile_cont(view_bps::DOUBLE, 2.0/3) OVER () AS b FROM ex WHERE fwd_excess IS NOT NULL"


@query(
    sql(
        "SELECT CASE WHEN view_bps <= a THEN 'lo' WHEN view_bps <= b THEN 'mid' ELSE 'hi' END AS bucket, count(*) AS n, round(avg(fwd_excess), 6) AS mean, round(median(fwd_excess), 6) AS median, round(avg(CASE WHEN view_bps <> 0 THEN (sign(view_bps) = sign(fwd_excess))::INT END), 6) AS hit FROM te GROUP BY 1",
        "views", "fwd", sc=SCORED, ex=EXCESS, te=TERTILE,
    )
)
def tertile_buckets(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(stats.buckets(stats.tertiles(valued(spark, sf), "view_bps", "bucket"), "bucket"))


RANKS = """SELECT rank() OVER (ORDER BY view_bps) + (count(*) OVER (PARTITION BY view_bps) - 1) / 2.0 AS ra, rank() OVER (ORDER BY fwd_excess) + (count(*) OVER (PARTITION BY fwd_excess) - 1) / 2.0 AS rb FROM ex WHERE fwd_excess IS NOT NULL"""


@query(sql("SELECT count(*) AS n, round(corr(ra, rb), 6) AS rank_ic FROM rk", "views", "fwd", sc=SCORED, ex=EXCESS, rk=RANKS))
def rank_ic(spark: SparkSession, sf: str) -> DataFrame:
    # the excess is rounded before it is ranked only in nothing: ties must be equal numbers
    return rounded(stats.spearman(scored(spark, sf).where("fwd_excess is not null"), "view_bps", "fwd_excess"))


FACTORS = """SELECT date, avg(ret) AS mkt, avg(ret) FILTER (ord <= (SELECT count(*) FROM universe) / 2) - avg(ret) FILTER (ord > (SELECT count(*) FROM universe) / 2) AS smb FROM rets JOIN universe USING (ticker) GROUP BY date"""


def factors(r: DataFrame, u: DataFrame) -> DataFrame:
    """date, mkt, smb, alt: factor returns of the panel's own legs, from the returns ``r`` of the universe ``u``."""
    n = u.agg(F.count(F.lit(1)).alias("n"))
    r = r.join(u, "ticker").crossJoin(F.broadcast(n))
    leg = lambda c: F.avg(F.when(c, F.col("ret")))
    return r.groupBy("date").agg(
        F.avg("ret").alias("mkt"), (leg(F.col("ord") <= F.col("n") / 2) - leg(F.col("ord") > F.col("n") / 2)).alias("smb"), (leg(F.col("ord") % 2 == 0) - leg(F.col("ord") % 2 == 1)).alias("alt")
    )


@query(
    sql(
        """SELECT strategy, 'capm' AS model, count(*) AS n, round(regr_intercept(y, mkt) * 252 * 100, 6) AS alpha_pct, round(regr_slope(y, mkt), 6) AS beta_mkt, round(regr_r2(y, mkt), 6) AS r2 FROM (SELECT strategy, ret - 0.02 / 252 AS y, mkt FROM net JOIN fa USING (date)) GROUP BY strategy""",
        "net", "universe", fa=FACTORS,
    )
)
def capm(spark: SparkSession, sf: str) -> DataFrame:
    r = d.rets(spark, sf)
    own = d.setting(spark, sf, r)
    y = d.backtested(spark, sf, r=r, own=own)[0].join(factors(r, own[1]), "date").withColumn("y", F.col("ret") - 0.02 / 252)
    fit = stats.ols(y, "strategy", "y", ["mkt"])
    return rounded(fit.select("strategy", F.lit("capm").alias("model"), "n", (F.col("alpha") * 252 * 100).alias("alpha_pct"), F.col("betas")[0].alias("beta_mkt"), "r2"))


@query()
def factor_attribution(spark: SparkSession, sf: str) -> DataFrame:
    """Each strategy, and top minus bottom, on nested factor sets: alpha, t, p, stars, betas, R2."""
    r = d.rets(spark, sf)
    own = d.setting(spark, sf, r)
    net = d.backtested(spark, sf, r=r, own=own)[0]
    wide = net.where("strategy <> 'equal_weight'").groupBy("date").pivot("strategy", ["top_n_views", "bottom_n_views"]).agg(F.first("ret"))
    ls = wide.select(F.lit("long_short").alias("strategy"), "date", (F.col("top_n_views") - F.col("bottom_n_views")).alias("y")).where("y is not null")
    y = checkpointed(net.select("strategy", "date", (F.col("ret") - 0.02 / 252).alias("y")).unionByName(ls).join(factors(r, own[1]), "date"))
    out = None
    for model, names in {"capm": ["mkt"], "two": ["mkt", "smb"], "three": ["mkt", "smb", "alt"]}.items():
        fit = stats.ols(y, "strategy", "y", names).withColumn("model", F.lit(model))
        out = fit if out is None else out.unionByName(fit)
    stars = F.when(F.col("p_alpha") < 0.01, "***").when(F.col("p_alpha") < 0.05, "**").when(F.col("p_alpha") < 0.1, "*").otherwise("")
    return rounded(out.select("strategy", "model", "n", (F.col("alpha") * 252 * 100).alias("alpha_pct"), "t_alpha", "p_alpha", stars.alias("stars"), "betas", "r2"))


@query()
def sharpe_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    """95 % interval of the Sharpe ratio by resampling days, each strategy a group."""
    return rounded(stats.bootstrap_sharpe(d.backtested(spark, sf)[0]))
