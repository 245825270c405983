"""Queries on all strategies, factor models, splits of the universe, samples, review lists and coverage totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import prompts
from tidemark.functions import text as t
from tidemark.operators import alloc, annotate, backtest, coverage, evaluate, metrics, panel, sampling, stats
from tidemark.operators.rounds import checkpointed
from tidemark.plans import domain as d
from tidemark.plans import filings as f
from tidemark.plans.market import rounded
from tidemark.plans.oracle import sql

Q: dict = {}
SQL: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(fn):
        Q[fn.__name__] = fn
        if oracle:
            SQL[fn.__name__] = oracle
        return fn

    return add


# --- all strategies ---


def every_backtest(spark: SparkSession, sf: str, r: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Daily returns and rebalances of all eleven strategies; where no covariance can be had, drifted weights are kept."""
    r = d.rets(spark, sf) if r is None else r
    p, u = d.setting(spark, sf, r)
    own = checkpointed(f.allocated(spark, sf, p, u, r))
    targets = d.weights(spark, sf, p, u).unionByName(own.where("not held").select("strategy", "rebal_date", "ticker", "w"))
    return backtest.run(r, p, targets, u, held=own.where("held"))


@query()
def all_strategies(spark: SparkSession, sf: str) -> DataFrame:
    """Metrics, mean turnover and total cost of every strategy, the covariance-aware and the placebo ones too."""
    net, turns = every_backtest(spark, sf)
    cost = turns.groupBy("strategy").agg(F.avg("turnover").alias("avg_turnover"), F.sum("cost").alias("total_cost"))
    return rounded(metrics.metrics(net).join(cost, "strategy"))


# --- factor models ---

LEGS = {"smb": "ord <= n / 2", "hml": "ord % 2 = 0", "rmw": "ord % 3 = 0", "cma": "ord % 5 < 2", "mom": "ord % 7 < 3"}
MODELS = {"CAPM": ["mkt"], "FF3": ["mkt", "smb", "hml"], "FF5": ["mkt", "smb", "hml", "rmw", "cma"], "FF5+Mom": ["mkt", "smb", "hml", "rmw", "cma", "mom"]}


def panel_factors(spark: SparkSession, sf: str, r: DataFrame | None = None) -> DataFrame:
    """date, mkt and five legs of the panel's own assets: the mean return of those in a leg less that of the others."""
    u = d.dim(d.universe(spark, sf))
    r = (d.rets(spark, sf) if r is None else r).join(u, "ticker").crossJoin(F.broadcast(u.agg(F.count(F.lit(1)).alias("n"))))
    leg = lambda c: (F.avg(F.when(F.expr(c), F.col("ret"))) - F.avg(F.when(~F.expr(c), F.col("ret"))))
    return r.groupBy("date").agg(F.avg("ret").alias("mkt"), *[leg(c).alias(k) for k, c in LEGS.items()])


@query(
    "WITH " + sql("SELECT 1", "rets", "universe")[5:].rsplit("\nSELECT 1", 1)[0]
    + ", u AS (SELECT *, count(*) OVER () AS n FROM universe), r AS (SELECT date, ret, ord, n FROM rets JOIN u USING (ticker)) SELECT date, round(avg(ret), 6) AS mkt, "
    + ", ".join(f"round(avg(ret) FILTER ({c}) - avg(ret) FILTER (NOT ({c})), 6) AS {k}" for k, c in LEGS.items())
    + " FROM r GROUP BY date"
)
def factor_returns(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(panel_factors(spark, sf))


@query()
def factor_models(spark: SparkSession, sf: str) -> DataFrame:
    """Alpha (percent a year), its t, p and stars, betas and R2 of every strategy on the four model sets, and of tilted-positive minus equal weight on the largest."""
    rf = 0.02 / metrics.YEAR
    r = d.rets(spark, sf)
    net = every_backtest(spark, sf, r)[0]
    wide = net.where("strategy in ('bl_llm_tilt_pos', 'equal_weight')").groupBy("date").pivot("strategy", ["bl_llm_tilt_pos", "equal_weight"]).agg(F.first("ret"))
    apart = wide.select(F.lit("long_short").alias("strategy"), "date", (F.col("bl_llm_tilt_pos") - F.col("equal_weight")).alias("y")).where("y is not null")
    own = net.select("strategy", "date", (F.col("ret") - rf).alias("y"))
    fa = checkpointed(panel_factors(spark, sf, r))
    out = None
    for model, names in MODELS.items():
        rows = own.unionByName(apart) if model == "FF5+Mom" else own
        fit = stats.ols(rows.join(fa, "date"), "strategy", "y", names).withColumn("model", F.lit(model))
        out = fit if out is None else out.unionByName(fit)
    stars = F.when(F.col("p_alpha") < 0.01, "***").when(F.col("p_alpha") < 0.05, "**").when(F.col("p_alpha") < 0.1, "*").otherwise("")
    return rounded(out.select("strategy", "model", "n", (F.col("alpha") * 252 * 100).alias("alpha_pct"), "t_alpha", "p_alpha", stars.alias("stars"), "betas", "t_betas", "r2"))


@query(sql("SELECT ticker, date, round(ret, 6) + 0 AS ret FROM rets WHERE date <= DATE '1997-03-31'", "rets"))
def capped_returns(spark: SparkSession, sf: str) -> DataFrame:
    """Returns as a study that ends with 1996 sees them."""
    return rounded(panel.capped(d.rets(spark, sf), 1996))


@query(sql("SELECT 1", "net").rsplit("\nSELECT 1", 1)[0] + ", s AS (SELECT strategy, date, sum(ln(1 + ret)) OVER (PARTITION BY strategy ORDER BY date ROWS UNBOUNDED PRECEDING) AS v FROM net) SELECT strategy, year(date)::INT AS year, count(*) AS n, round(exp(max_by(v, date)) - 1, 6) AS to_date FROM s GROUP BY ALL")
def yearly_growth(spark: SparkSession, sf: str) -> DataFrame:
    """Growth of each strategy up to each year's last day."""
    net = d.backtested(spark, sf)[0]
    v = net.withColumn("v", F.sum(F.log1p("ret")).over(Window.partitionBy("strategy").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)))
    return rounded(v.groupBy("strategy", F.year("date").alias("year")).agg(F.count(F.lit(1)).alias("n"), (F.exp(F.max_by("v", "date")) - 1).alias("to_date")))


# --- splits ---


@query()
def random_splits(spark: SparkSession, sf: str) -> DataFrame:
    """split, ticker, ord: ten halves of the universe, drawn by one generator that goes on shuffling."""
    names = sorted(r[0] for r in d.universe(spark, sf).select("ticker").collect())  # a dimension: the draw shuffles it as one list
    return sampling.random_halves(spark, names, 10, 42)


@query()
def split_comparison(spark: SparkSession, sf: str) -> DataFrame:
    """Sharpe ratios of the best and worst views in ten random halves: mean, population deviation, wins, paired t and p."""
    r = d.rets(spark, sf)
    p, u = d.setting(spark, sf, r)
    own = random_splits(spark, sf).select("split", "ticker").join(u, "ticker")
    a = checkpointed(d.active(spark, sf, p, u))
    legs = [backtest.ranked_views(p, own, a, 3, best, ["split"]).withColumn("strategy", F.concat(F.lit(f"{name}/"), "split")) for name, best in (("top", True), ("bottom", False))]
    out = legs[0].unionByName(legs[1]).select("strategy", "rebal_date", "ticker", "w")
    net = backtest.run(r, p, out, u)[0]
    m = metrics.metrics(net).select(F.split("strategy", "/")[0].alias("name"), F.split("strategy", "/")[1].cast("int").alias("split"), "sharpe")
    wide = m.groupBy("split").pivot("name", ["top", "bottom"]).agg(F.first("sharpe"))
    return rounded(stats.paired(wide, "top", "bottom"))


# --- curves ---

CURVE = """c AS (SELECT strategy, date, exp(sum(ln(1 + ret)) OVER (PARTITION BY strategy ORDER BY date ROWS UNBOUNDED PRECEDING)) AS v FROM net), g AS (SELECT DISTINCT date FROM c WHERE strategy = 'equal_weight'),
k AS (SELECT date, strategy, last_value(v IGNORE NULLS) OVER (PARTITION BY strategy ORDER BY date ROWS UNBOUNDED PRECEDING) AS v FROM (SELECT g.date, s.strategy, c.v FROM g CROSS JOIN (SELECT DISTINCT strategy FROM c) s LEFT JOIN c ON c.date = g.date AND c.strategy = s.strategy))"""


@query(sql("SELECT 1", "net").rsplit("\nSELECT 1", 1)[0] + ", " + CURVE + " SELECT date, round(avg(v), 6) AS mean, count(v) AS n FROM k GROUP BY date")
def mean_curve(spark: SparkSession, sf: str) -> DataFrame:
    """The mean of the strategies' growth curves on the dates of one of them, filled forward."""
    net = d.backtested(spark, sf)[0]
    v = net.select("strategy", "date", F.exp(F.sum(F.log1p("ret")).over(Window.partitionBy("strategy").orderBy("date").rowsBetween(Window.unboundedPreceding, 0))).alias("v"))
    return rounded(backtest.mean_curve(v, "equal_weight"))


# --- samples ---


def _filed(spark: SparkSession, sf: str) -> DataFrame:
    o = d.table(spark, sf, "orders")
    year = F.year("o_orderdate")
    period = F.when(year <= 1994, "early").when(year <= 1996, "middle").otherwise("late")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("ticker"), F.when(F.col("o_orderstatus") == "F", "10-K").otherwise("10-Q").alias("form"), period.alias("period"), year.alias("year"))


@query()
def gold_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """90 filings: periods in proportion, a share of 22 % annual ones, distinct tickers first; tiers of 5, 15 and the rest."""
    return sampling.manifest(_filed(spark, sf), ["early", "middle", "late"])


@query(
    """WITH fk AS (SELECT o_custkey AS ticker, year(o_orderdate)::INT AS year, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey, year(o_orderdate) ORDER BY o_orderkey) AS k FROM orders WHERE o_orderstatus = 'F' AND year(o_orderdate) IN (1992, 1993, 1994, 1995)),
t AS (SELECT DISTINCT o_custkey AS ticker FROM orders ORDER BY 1 LIMIT 5) SELECT ticker, year, id FROM fk JOIN t USING (ticker) WHERE k = 1 ORDER BY ticker, year LIMIT 10"""
)
def probe_files(spark: SparkSession, sf: str) -> DataFrame:
    """Ten annual filings at most, of the first five tickers in four years: the report is the limit."""
    return sampling.probe(_filed(spark, sf).where("form = '10-K'"), "ticker", "year", "id", [1992, 1993, 1994, 1995], 5, 10, _filed(spark, sf))


# --- review of events ---


def _pairs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    c = d.table(spark, sf, "conversations").select(F.col("conv_id").alias("doc"), "turn", "role", "text", F.col("text").alias("quote"))
    return c.where("role = 'user'").withColumnRenamed("turn", "i"), c.where("role = 'assistant'").withColumnRenamed("turn", "j")


@query()
def borderline_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """The thirty pairs of lowest score within the range that a person should look at; the limit is the report."""
    events, gold = _pairs(spark, sf)
    return rounded(evaluate.borderline(evaluate.match_events(events, gold, 60.0, (50.0, 72.0)), 30))


@query()
def extra_events(spark: SparkSession, sf: str) -> DataFrame:
    """Events without a partner in the gold standard."""
    events, gold = _pairs(spark, sf)
    return evaluate.extras(events, evaluate.match_events(events, gold, 60.0)).select("doc", "i")


@query()
def most_extra(spark: SparkSession, sf: str) -> DataFrame:
    """Of each model the blind-tier document with the most extra events; failed ones are left out."""
    events, gold = _pairs(spark, sf)
    doc = F.col("doc")
    tier = F.when(doc % 5 == 0, "tier1a_tuning").when(doc % 5 == 1, "tier1b_eval").otherwise("tier2_pool")
    docs = events.select("doc").distinct().select(F.concat(F.lit("m"), doc % 3).alias("model"), "doc", tier.alias("tier"), (doc % 7 == 0).alias("failed"))
    extra = evaluate.extras(events, evaluate.match_events(events, gold, 60.0)).join(docs.select("model", "doc"), "doc")
    return evaluate.most_extras(extra, docs)


@query(f"WITH b AS ({f.BOARD}), s AS ({f.SCORE}), x AS (SELECT model, scope, round(2 * p * r / nullif(p + r, 0), 6) AS f1 FROM s WHERE scope = 'all') SELECT model, f1, row_number() OVER (ORDER BY coalesce(f1, 0) DESC, model)::INT AS place FROM x")
def leaderboard(spark: SparkSession, sf: str) -> DataFrame:
    """Models by F1, those without one last."""
    return evaluate.leaderboard(rounded(evaluate.scoreboard(f._board(spark, sf))))


# --- coverage ---

COMPLETE = f"WITH c AS ({f.COV}), m AS (SELECT company, count(DISTINCT year * 4 + quarter) AS have FROM c GROUP BY company)"


@query(
    f"""{COMPLETE}, y AS (SELECT company, count(*) FILTER (k < 3) AS short FROM (SELECT company, year, count(DISTINCT quarter) AS k FROM c GROUP BY ALL) GROUP BY company)
SELECT count(*) AS companies, sum(have)::BIGINT AS found, (count(*) * 28)::BIGINT AS expected, round(100 * sum(have) / (count(*) * 28), 6) AS pct, count(*) FILTER (have = 28) AS complete, count(*) FILTER (short > 0) AS with_short_years FROM m JOIN y USING (company)"""
)
def coverage_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Quarters found of those expected over seven years, and how many companies have all, or short years."""
    return rounded(coverage.totals(f._coverage(spark, sf), "company", 7))


@query(
    f"""WITH c AS ({f.COV}), r AS ({f.RUNS}), s AS ({f.SPANS}), l AS (
SELECT 'companies' AS list, row_number() OVER (ORDER BY companies DESC, years DESC, "start")::INT AS k, * FROM s WHERE years >= 3 UNION ALL
SELECT 'length', row_number() OVER (ORDER BY years DESC, companies DESC, "start")::INT, * FROM s WHERE companies >= 10)
SELECT list, k, "start", "end", years, companies FROM (SELECT *, row_number() OVER (PARTITION BY list, CASE list WHEN 'companies' THEN companies ELSE years END ORDER BY k) AS again FROM l WHERE k <= 15) WHERE again = 1"""
)
def distinct_periods(spark: SparkSession, sf: str) -> DataFrame:
    """The first of each number of companies, and of each length, among the top fifteen."""
    top = coverage.ranked_periods(coverage.complete_periods(f._coverage(spark, sf), "company"), 3, 10)
    return coverage.first_of_each(top).select("list", "k", "start", "end", "years", "companies")


@query("SELECT source, count(*) AS calls, sum(n_chars // 4)::BIGINT AS input_tokens, round(sum((n_chars // 4 * 0.4 + n_chars // 40 * 1.6) / 1e6), 6) AS cost FROM documents GROUP BY ROLLUP (source)")
def cost_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Calls, tokens and cost by source, and of all (NULL)."""
    from tidemark.functions import scalars as s

    n = F.expr("n_chars div 4")
    cost = s.token_cost(n, F.expr("n_chars div 40"), F.lit(0.4), F.lit(1.6))
    return rounded(d.table(spark, sf, "documents").rollup("source").agg(F.count(F.lit(1)).alias("calls"), F.sum(n).alias("input_tokens"), F.sum(cost).alias("cost")))


# --- filings as prompts, facts and incidents ---


@query()
def section_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as sections, chunked within a budget of tokens."""
    own = d.table(spark, sf, "documents").select("doc_id", F.create_map(F.lit("business"), F.reverse("text"), F.lit("mda"), F.coalesce("text", F.lit(""))).alias("s"))
    out = t.section_chunks(own.withColumn("s", F.map_filter("s", lambda k, v: v.isNotNull())), "doc_id", "s", 900, 400, 40)
    return out.select("doc_id", "pos", F.length("chunk").alias("n"), F.md5("chunk").alias("h"))


@query()
def page_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Pages with their hosts and paths dressed as nested tables, and the tables found again."""
    inner = F.concat(F.lit("<table><tr><td>Inner table of some length</td><td>"), F.coalesce("url", F.lit("")), F.lit(" and more of it</td></tr></table>"))
    page = F.concat(F.coalesce("html", F.lit("")), F.lit("<table><tr><td>Outer</td><td>"), inner, F.lit("</td></tr></table>"))
    return d.table(spark, sf, "pages").select("page_id", F.posexplode(t.html_tables(page)).alias("pos", "table"))


@query()
def filing_incidents(spark: SparkSession, sf: str) -> DataFrame:
    """Filings without sections, or without those they must have."""
    x = F.concat(F.lit("ITEM 7. MANAGEMENT'S DISCUSSION AND ANALYSIS\n"), F.col("text"), F.lit("\nITEM 8. Financial Statements"))
    own = d.table(spark, sf, "documents").select("doc_id", F.lit("10-K").alias("form"), (F.col("doc_id") % 10 + 2000).cast("int").alias("year"), t.sections(x).alias("sections"), F.lit(None).cast("string").alias("error"))
    return annotate.section_incidents(own, "doc_id")


@query()
def extracted_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Facts that the offline annotator draws from whole documents, with the filing's own metadata, and those without risk factors."""
    docs = d.table(spark, sf, "documents")
    answers = annotate.annotate(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("prompt")), "doc_id", "prompt", annotate.offline_facts, annotate.FACTS_CONTRACT)
    own = docs.select("doc_id", F.col("source").alias("ticker"), F.lit("10-K").alias("filing_type"), F.lit("2020-02-01").alias("filing_date"), F.lit("FY 2019").alias("fiscal_period"))
    f = annotate.facts(answers, own, "doc_id")
    return f.select("doc_id", "ticker", "fiscal_period", "sentiment", "risk_summary", F.size("risk_factors").alias("n_risks"), F.size("key_events").alias("n_events"), F.get("risk_factors", F.lit(0))["severity"].alias("severity"))


_P = "o_totalprice / 7.0"
_SQL_TRUTHY = lambda x, form: f"CASE WHEN coalesce({x}, 0) <> 0 THEN printf('{form}', {x}) ELSE 'N/A' END"


@query(
    f"""WITH x AS (SELECT o_orderkey AS id, 'T' || o_custkey AS ticker, o_orderdate::DATE AS view_date, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE {_P} / 1e4 END AS a, CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE -{_P} / 1e5 END AS b, o_orderpriority FROM orders)
SELECT id, md5('Company: ' || ticker || ' (Unknown), view of ' || view_date || ' after FY1999' || chr(10) || 'Annual report of N/A. Risks: 1 risk factors identified. Foremost: ' || o_orderpriority || ': ' || ticker || '. Events: ' || ticker || ', ' || o_orderpriority || chr(10)
|| 'Quarterly report of N/A. Tone: neutral - No rationale provided' || chr(10) || 'Guidance: Not provided; revenue: Not specified; earnings: Not specified' || chr(10) || 'Events: No significant events' || chr(10)
|| 'EPS ' || {_SQL_TRUTHY('a', '%.2f')} || ' against ' || {_SQL_TRUTHY('b', '%.2f')} || ', surprise ' || {_SQL_TRUTHY('a', '%+.1f')} || ' %' || chr(10)
|| 'Revenue ' || {_SQL_TRUTHY('a', '%.1f')} || ' against ' || {_SQL_TRUTHY('b', '%.1f')} || ' bn, surprise ' || {_SQL_TRUTHY('b', '%+.1f')} || ' %' || chr(10)
|| 'Analysts N/A, dispersion ' || {_SQL_TRUTHY('a * 100.0', '%.1f')} || ' %' || chr(10)
|| 'Returns ' || coalesce(printf('%+.1f', a), 'N/A') || ' % and ' || coalesce(printf('%+.1f', b), 'N/A') || ' %, volatility ' || coalesce(printf('%.1f', a), 'N/A') || ' %' || chr(10)
|| 'Answer in JSON with view_bps (-300 to 300), confidence (high, medium or low) and reasoning.') AS h FROM x"""
)
def view_prompts(spark: SparkSession, sf: str) -> DataFrame:
    """Digests of the prompts that ask for views; numbers that are missing, and zeros where they count as missing, say so."""
    o = d.table(spark, sf, "orders")
    none = lambda kind: F.lit(None).cast(kind)
    a = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice").cast("double") / 7.0 / 1e4)
    b = F.when(F.col("o_orderkey") % 5 == 0, 0.0).otherwise(-F.col("o_totalprice").cast("double") / 7.0 / 1e5)
    ticker = F.concat(F.lit("T"), F.col("o_custkey").cast("string"))
    risk = F.array(F.struct(F.col("o_orderpriority").alias("category"), F.lit("low").alias("severity"), ticker.alias("description")))
    own = o.select(
        F.col("o_orderkey").alias("id"), ticker.alias("ticker"), F.to_date("o_orderdate").alias("view_date"), F.lit("FY1999").alias("fiscal_period"), none("string").alias("sector"), none("date").alias("annual_date"), risk.alias("risks"), F.lit("").alias("risk_summary"),
        F.array(ticker, F.col("o_orderpriority")).alias("annual_events"), none("date").alias("quarterly_date"), *[none("string").alias(k) for k in ("sentiment", "rationale", "direction", "revenue_outlook", "earnings_outlook")], none("array<string>").alias("quarterly_events"),
        a.alias("eps"), b.alias("eps_avg"), a.alias("eps_surprise"), a.alias("revenue"), b.alias("revenue_avg"), b.alias("revenue_surprise"), none("int").alias("analysts"), a.alias("dispersion"), a.alias("ret_1m"), b.alias("ret_3m"), a.alias("vol_60d"),
    )
    return own.select("id", F.md5(prompts.view_prompt()).alias("h"))
