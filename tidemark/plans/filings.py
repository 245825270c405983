"""Queries on filings, facts, estimates, coverage and evaluation."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import scalars as s
from tidemark.functions import text as t
from tidemark.operators import alloc, annotate, asof, coverage, evaluate, features, grounding, stats
from tidemark.operators.small import small
from tidemark.plans import domain as d
from tidemark.plans.market import rounded
from tidemark.plans.oracle import sql
from tidemark.sources import readers, sinks
from tidemark.streaming import latest

Q: dict = {}
SQL: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if oracle:
            SQL[f.__name__] = oracle
        return f

    return add


FORM = "CASE o_orderstatus WHEN 'F' THEN '10-K' WHEN 'P' THEN '10-K/A' ELSE '10-Q' END"
MON = "month(o_orderdate)"
YR = "year(o_orderdate)"


@query(
    f"""SELECT o_orderkey, CASE WHEN {FORM} = '10-K' THEN 'FY ' || (CASE WHEN {MON} <= 3 THEN {YR} - 1 ELSE {YR} END) WHEN {MON} <= 3 THEN 'Q4 ' || ({YR} - 1) WHEN {MON} <= 6 THEN 'Q1 ' || {YR} WHEN {MON} <= 9 THEN 'Q2 ' || {YR} ELSE 'Q3 ' || {YR} END AS fiscal_period,
CASE WHEN {FORM} = '10-K' THEN {YR}::VARCHAR WHEN {FORM} <> '10-Q' THEN NULL WHEN {MON} <= 3 THEN ({YR} - 1) || '-Q4' WHEN {MON} <= 6 THEN {YR} || '-Q1' WHEN {MON} <= 9 THEN {YR} || '-Q2' ELSE {YR} || '-Q3' END AS filing_quarter, quarter(o_orderdate)::INT AS cal_quarter,
CASE WHEN {YR} BETWEEN 1991 AND 1995 THEN '1991-1995' WHEN {YR} BETWEEN 1996 AND 2000 THEN '1996-2000' WHEN {YR} BETWEEN 2001 AND 2005 THEN '2001-2005' END AS study FROM orders"""
)
def fiscal_periods(spark: SparkSession, sf: str) -> DataFrame:
    o = d.table(spark, sf, "orders").withColumn("dt", F.to_date("o_orderdate")).withColumn("form", F.when(F.col("o_orderstatus") == "F", "10-K").when(F.col("o_orderstatus") == "P", "10-K/A").otherwise("10-Q"))
    return o.select("o_orderkey", s.fiscal_period(F.col("form"), F.col("dt")).alias("fiscal_period"), s.filing_quarter(F.col("form"), F.col("dt")).alias("filing_quarter"), F.quarter("dt").alias("cal_quarter"), s.study_period(F.year("dt"), 1991, 5, 3).alias("study"))


RAWP = f"""CASE o_orderkey % 9 WHEN 0 THEN ' fy ' || {YR} WHEN 1 THEN 'Q' || quarter(o_orderdate) || ' ' || {YR} WHEN 2 THEN 'q' || quarter(o_orderdate) || {YR} WHEN 3 THEN 'FY' || {YR} WHEN 4 THEN 'Half ' || {YR}
WHEN 5 THEN NULL WHEN 6 THEN '' WHEN 7 THEN 'fy  ' || {YR} || ' (est.)' ELSE 'q' || quarter(o_orderdate) || ' fy ' || {YR} END"""


@query(
    f"""SELECT o_orderkey, CASE WHEN coalesce(p, '') = '' THEN 'Unknown' WHEN u LIKE 'FY%' THEN replace(u, 'FY ', 'FY') WHEN regexp_matches(u, '^Q[1-4]') THEN CASE WHEN contains(v, '_') THEN v ELSE v[:2] || '_' || v[3:] END ELSE p END AS period
FROM (SELECT *, replace(u, u[:2] || ' ', u[:2] || '_') AS v FROM (SELECT o_orderkey, p, upper(trim(p)) AS u FROM (SELECT o_orderkey, {RAWP} AS p FROM orders)))"""
)
def normalised_periods(spark: SparkSession, sf: str) -> DataFrame:
    o = d.table(spark, sf, "orders")
    y, q = F.year("o_orderdate").cast("string"), F.quarter("o_orderdate").cast("string")
    k = F.col("o_orderkey") % 9
    p = F.when(k == 0, F.concat(F.lit(" fy "), y)).when(k == 1, F.concat(F.lit("Q"), q, F.lit(" "), y)).when(k == 2, F.concat(F.lit("q"), q, y)).when(k == 3, F.concat(F.lit("FY"), y)).when(k == 4, F.concat(F.lit("Half "), y))
    p = p.when(k == 5, F.lit(None)).when(k == 6, "").when(k == 7, F.concat(F.lit("fy  "), y, F.lit(" (est.)"))).otherwise(F.concat(F.lit("q"), q, F.lit(" fy "), y))
    return o.select("o_orderkey", s.normalise_period(p).alias("period"))


@query(
    """SELECT o_orderkey, CASE WHEN translate(lower(trim(substr(o_orderpriority, 3))), ' -', '__') IN ('high', 'medium', 'low') THEN translate(lower(trim(substr(o_orderpriority, 3))), ' -', '__') ELSE 'medium' END AS severity,
CASE WHEN lower(trim(substr(o_orderpriority, 3))) IN ('high', 'medium', 'low') THEN lower(trim(substr(o_orderpriority, 3))) ELSE 'medium' END AS confidence,
CASE WHEN substr(o_orderpriority, 3) = 'NOT SPECIFIED' THEN NULL ELSE substr(o_orderpriority, 3) END AS cleaned,
greatest(-300, least(300, trunc((o_totalprice - 100000) / 100)::INT))::INT AS truncated, greatest(-300, least(300, round_even((o_totalprice - 100000) / 100, 0)::INT))::INT AS rounded FROM orders"""
)
def coercions(spark: SparkSession, sf: str) -> DataFrame:
    p = F.substring("o_orderpriority", 3, 100)
    v = (F.col("o_totalprice") - 100000) / 100
    cleaned = s.clean_null(F.when(p == "NOT SPECIFIED", "N/A").otherwise(p))
    return d.table(spark, sf, "orders").select("o_orderkey", s.coerce(p, s.SEVERITIES, "medium").alias("severity"), s.coerce_confidence(p).alias("confidence"), cleaned.alias("cleaned"), s.clamp_int(v).alias("truncated"), s.clamp_round(v).alias("rounded"))


def _quarters(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    e = d.table(spark, sf, "events")
    q = e.where("event_type = 'purchase'").select(F.col("user_id").alias("ticker"), (-F.col("event_id")).alias("pos"), F.to_date("ts").alias("date"), F.date_add(F.to_date("ts"), 1).alias("filing_date"), F.col("value").alias("eps"), (F.col("value") * 1e9).alias("revenue"))
    est = e.where("event_type = 'signup'").select(F.col("user_id").alias("ticker"), F.col("event_id").alias("epos"), F.to_date("ts").alias("edate"), F.col("value").alias("eps_avg"), (F.col("value") * 1.2).alias("eps_high"), (F.col("value") * 0.9).alias("eps_low"), (F.col("value") * 2e9).alias("revenue_avg"))
    return q, est


QTR = "SELECT user_id AS ticker, -event_id AS pos, ts::DATE AS date, ts::DATE + 1 AS filing_date, value AS eps, value * 1e9 AS revenue FROM events WHERE event_type = 'purchase'"
EST = "SELECT user_id AS ticker, event_id AS epos, ts::DATE AS edate, value AS eps_avg, value * 1.2 AS eps_high, value * 0.9 AS eps_low, value * 2e9 AS revenue_avg FROM events WHERE event_type = 'signup'"
MATCH = "SELECT * EXCLUDE (k) FROM (SELECT q.*, e.* EXCLUDE (ticker), row_number() OVER (PARTITION BY q.ticker, q.pos ORDER BY epos) AS k FROM q JOIN e ON q.ticker = e.ticker AND abs(q.date - e.edate) <= 5) WHERE k = 1"
SUR = "SELECT *, (eps - eps_avg) / nullif(abs(eps_avg), 0) * 100 AS raw FROM m"
SURPRISE = """SELECT ticker, pos, epos, round(CASE WHEN abs(raw) > 200 THEN NULL ELSE raw END, 6) AS eps_surprise, round(CASE WHEN abs(raw) > 200 OR revenue = 0 THEN NULL ELSE (revenue - revenue_avg) / nullif(abs(revenue_avg), 0) * 100 END, 6) AS revenue_surprise,
round(CASE WHEN abs(raw) > 200 THEN NULL ELSE (eps_high - eps_low) / nullif(abs(eps_avg), 0) END, 6) AS dispersion, round(nullif(revenue, 0) / 1e9, 6) AS revenue_bn"""


@query(f"WITH q AS ({QTR}), e AS ({EST}), m AS ({MATCH}), s AS ({SUR}) {SURPRISE} FROM s")
def earnings_surprise(spark: SparkSession, sf: str) -> DataFrame:
    """Quarters with the first estimate within five days, and their surprises."""
    m = features.surprises(features.matched_quarters(*_quarters(spark, sf)))
    return rounded(m.select("ticker", "pos", "epos", "eps_surprise", "revenue_surprise", "dispersion", "revenue_bn"))


@query(
    f"""WITH q AS ({QTR}), e AS ({EST}), m AS ({MATCH}), s AS ({SUR}), x AS ({SURPRISE}, filing_date FROM s), v AS (SELECT DISTINCT user_id AS ticker, view_date FROM events, (VALUES (DATE '2024-01-15'), (DATE '2024-01-31')) t(view_date))
SELECT ticker, view_date, pos, eps_surprise FROM (SELECT v.ticker, v.view_date, x.pos, x.eps_surprise, row_number() OVER (PARTITION BY v.ticker, v.view_date ORDER BY x.pos) AS k FROM v JOIN x ON v.ticker = x.ticker AND x.filing_date < v.view_date) WHERE k = 1"""
)
def latest_surprise(spark: SparkSession, sf: str) -> DataFrame:
    m = features.surprises(features.matched_quarters(*_quarters(spark, sf)))
    days = spark.createDataFrame([(date(2024, 1, 15),), (date(2024, 1, 31),)], "view_date date")
    at = d.table(spark, sf, "events").select(F.col("user_id").alias("ticker")).distinct().crossJoin(F.broadcast(days))
    return rounded(features.latest_reported(at, m).select("ticker", "view_date", "pos", "eps_surprise"))


@query(sql("""SELECT seq, round(b * (CASE WHEN disp > 0.3 THEN 1.5 ELSE 1 END) * (CASE WHEN sentiment IN ('confident', 'concerned') THEN 0.8 ELSE 1 END), 6) AS sigma, round(b * b, 6) AS omega,
CASE WHEN b <= 0.015 THEN 'high' WHEN b <= 0.04 THEN 'medium' ELSE 'low' END AS back FROM (SELECT *, CASE confidence WHEN 'high' THEN 0.01 WHEN 'low' THEN 0.05 ELSE 0.03 END AS b, abs(view_bps) / 600.0 AS disp FROM views)""", "views"))  # fmt: skip
def sigma_calibration(spark: SparkSession, sf: str) -> DataFrame:
    v = d.views(spark, sf).withColumn("disp", F.abs("view_bps") / 600.0)
    b = s.sigma(F.col("confidence"))
    return rounded(v.select("seq", s.calibrated_sigma(F.col("confidence"), F.col("disp"), F.col("sentiment")).alias("sigma"), (b * b).alias("omega"), s.sigma_to_confidence(b).alias("back")))


# A small lexicon that occurs in the test documents.
LEXICON = [(w, 1) for w in ("the", "die", "la", "el", "une", "and")] + [(w, -1) for w in ("of", "und", "de", "que", "not", "in")]
LEX_SQL = ", ".join(f"('{w}', {p})" for w, p in LEXICON)
TONE = f"""SELECT doc_id, source, lang, count(w) AS n_words, count(*) FILTER (p > 0) AS pos, count(*) FILTER (p < 0) AS neg FROM (SELECT doc_id, source, lang, unnest(CASE WHEN len(ws) = 0 THEN [NULL] ELSE ws END) AS w FROM
(SELECT *, regexp_extract_all(lower(text), '\\p{{L}}+') AS ws FROM documents)) LEFT JOIN (VALUES {LEX_SQL}) l(word, p) ON word = w GROUP BY ALL"""


def _tone(spark: SparkSession, sf: str) -> DataFrame:
    docs = d.table(spark, sf, "documents")
    c = t.lexicon_counts(docs, "doc_id", "text", spark.createDataFrame(LEXICON, "word string, polarity int"))
    own = docs.select("doc_id", "source", "lang").join(c, "doc_id")
    return own.withColumn("tone", s.tone(F.col("pos"), F.col("neg")))


@query(f"WITH c AS ({TONE}) SELECT doc_id, n_words, pos, neg, round(coalesce((pos - neg) / nullif(pos + neg, 0), 0), 6) AS tone, CASE WHEN pos > neg THEN 'positive' WHEN pos < neg THEN 'negative' ELSE 'neutral' END AS label FROM c")
def lexicon_tone(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_tone(spark, sf).select("doc_id", "n_words", "pos", "neg", "tone", s.tone_label(F.col("tone")).alias("label")))


@query(
    f"""WITH c AS ({TONE}), tn AS (SELECT *, coalesce((pos - neg) / nullif(pos + neg, 0), 0) AS tone FROM c), z AS (SELECT *, coalesce((tone - avg(tone) OVER p) / nullif(stddev_pop(tone) OVER p, 0), 0) AS z FROM tn WINDOW p AS (PARTITION BY source, lang))
SELECT doc_id, round(z, 6) AS z, round_even(greatest(-300, least(300, round(z * 100, 9))), 0)::INT AS view_bps FROM z"""
)
def tone_views(spark: SparkSession, sf: str) -> DataFrame:
    """Cross-sectional z of tone as basis points; the product is rounded to nine digits first, so that sums in another order give the same integer."""
    z = features.z_score(_tone(spark, sf).withColumn("k", F.concat_ws("/", "source", "lang")), "k", "tone", "z")
    return z.select("doc_id", F.round("z", 6).alias("z"), features.z_to_bps(F.round(F.col("z") * 100, 9) / 100).alias("view_bps"))


@query()
def stemmed_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Words of the lexicon's stems, as the published baseline counts them."""
    docs = d.table(spark, sf, "documents")
    return t.lexicon_counts(docs, "doc_id", "text", spark.createDataFrame(LEXICON, "word string, polarity int"), stems=True)


@query("SELECT event_id, round(coalesce(nullif(CASE event_id % 3 WHEN 0 THEN 0 WHEN 1 THEN NULL ELSE value END, 0), value * 1.1), 6) AS eps FROM events")
def diluted_eps(spark: SparkSession, sf: str) -> DataFrame:
    """Diluted earnings a share, the basic ones where these are missing or zero."""
    i = F.col("event_id") % 3
    diluted = F.when(i == 0, 0.0).when(i == 2, F.col("value"))
    return rounded(d.table(spark, sf, "events").select("event_id", s.first_nonzero(diluted, F.col("value") * 1.1).alias("eps")))


@query("SELECT o_orderkey AS seq, round((((round(o_totalprice * 100)::BIGINT % 601) + 601) % 601 - 300) / 10000.0, 6) AS target FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_linenumber = 1)")
def view_targets(spark: SparkSession, sf: str) -> DataFrame:
    """Views as expected returns."""
    return rounded(d.views(spark, sf).select("seq", s.from_bps(F.col("view_bps")).alias("target")))


def _coverage(spark: SparkSession, sf: str) -> DataFrame:
    o = d.table(spark, sf, "orders")
    return o.select(F.col("o_custkey").alias("company"), F.to_date("o_orderdate").alias("date"), F.year("o_orderdate").alias("year"), F.quarter("o_orderdate").alias("quarter"))


COV = "SELECT o_custkey AS company, o_orderdate::DATE AS date, year(o_orderdate)::INT AS year, quarter(o_orderdate)::INT AS quarter FROM orders"


@query(f"WITH c AS ({COV}) SELECT company, year, count(DISTINCT quarter) AS n_quarters, count(DISTINCT quarter) < 3 AS short FROM c GROUP BY company, year")
def coverage_by_year(spark: SparkSession, sf: str) -> DataFrame:
    return coverage.quarters_by_year(_coverage(spark, sf), "company")


@query(f"WITH c AS ({COV}) SELECT company, y::INT AS year, q::INT AS quarter FROM (SELECT DISTINCT company FROM c) CROSS JOIN range(1995, 2002) a(y) CROSS JOIN range(1, 5) b(q) EXCEPT SELECT company, year, quarter FROM c")
def missing_quarters(spark: SparkSession, sf: str) -> DataFrame:
    return coverage.missing(_coverage(spark, sf), "company", 1995, 2001)


@query(f"WITH c AS ({COV}) SELECT company, after, until, (until - after)::INT AS days FROM (SELECT company, lag(date) OVER (PARTITION BY company ORDER BY date) AS after, date AS until FROM c) WHERE until - after > 90")
def date_gaps(spark: SparkSession, sf: str) -> DataFrame:
    return coverage.gaps(_coverage(spark, sf), "company", "date", 90)


RUNS = "SELECT company, min(year) AS first, max(year) AS last, count(*) AS n FROM (SELECT company, year, year - row_number() OVER (PARTITION BY company ORDER BY year) AS g FROM (SELECT DISTINCT company, year FROM c)) GROUP BY company, g"
SPANS = 'SELECT s."start", s."end", count(*) AS companies, (s."end" - s."start" + 1)::INT AS years FROM (SELECT a.y AS "start", b.y AS "end" FROM (SELECT DISTINCT year AS y FROM c) a JOIN (SELECT DISTINCT year AS y FROM c) b ON a.y <= b.y) s JOIN r ON r.first <= s."start" AND r.last >= s."end" GROUP BY 1, 2'


@query(f"WITH c AS ({COV}) {RUNS}")
def year_runs(spark: SparkSession, sf: str) -> DataFrame:
    return coverage.year_runs(_coverage(spark, sf), "company")


@query(f'WITH c AS ({COV}), r AS ({RUNS}), s AS ({SPANS}) SELECT "start", "end", companies, years, companies * years AS score FROM s')
def complete_periods(spark: SparkSession, sf: str) -> DataFrame:
    return coverage.complete_periods(_coverage(spark, sf), "company")


@query(
    f"""WITH c AS ({COV}), r AS ({RUNS}), s0 AS ({SPANS}), s AS (SELECT *, companies * years AS score FROM s0), l AS (
SELECT 'companies' AS list, row_number() OVER (ORDER BY companies DESC, years DESC, "start")::INT AS k, *, 15 AS n FROM s WHERE years >= 3 UNION ALL
SELECT 'length', row_number() OVER (ORDER BY years DESC, companies DESC, "start")::INT, *, 15 FROM s WHERE companies >= 10 UNION ALL
SELECT 'score', row_number() OVER (ORDER BY score DESC, years DESC, "start")::INT, *, 10 FROM s WHERE years >= 3 AND companies >= 10) SELECT list, k, "start", "end", years, companies, score FROM l WHERE k <= n"""
)
def ranked_periods(spark: SparkSession, sf: str) -> DataFrame:
    return coverage.ranked_periods(coverage.complete_periods(_coverage(spark, sf), "company"), 3, 10)


@query()
def balanced_selection(spark: SparkSession, sf: str) -> DataFrame:
    """100 customers, by segment quotas, alternately in two portfolios."""
    c = d.table(spark, sf, "customer").select("c_name", "c_mktsegment")
    return coverage.alternate(coverage.balanced(c, "c_mktsegment", "c_name", 100), "c_mktsegment", "c_name")


@query("SELECT o_orderkey, o_orderpriority, o_orderstatus, k FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority, o_orderstatus ORDER BY md5(o_orderkey || '|20260829'), o_orderkey) AS k FROM orders) WHERE k <= 5")
def stratified_sample(spark: SparkSession, sf: str) -> DataFrame:
    o = d.table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    return coverage.stratified(o, ["o_orderpriority", "o_orderstatus"], "o_orderkey", 5)


def _board(spark: SparkSession, sf: str) -> DataFrame:
    docs = d.table(spark, sf, "documents").join(d.table(spark, sf, "labels"), "doc_id")
    n = F.col("n_chars")
    return docs.select(
        F.col("source").alias("model"), F.when(F.col("doc_id") % 5 == 0, "blind").otherwise("pool").alias("tier"), (n < 300).alias("failed"), (n % 7).alias("n_events"), (n % 5).alias("n_gold"), F.least(n % 7, n % 5).alias("n_matched"), (n % 11).alias("n_quotes"), (n % 11 - F.col("toxic") * (n % 11 > 0).cast("int")).alias("n_grounded")
    )


BOARD = """SELECT source AS model, CASE WHEN doc_id % 5 = 0 THEN 'blind' ELSE 'pool' END AS tier, n_chars < 300 AS failed, n_chars % 7 AS ne, n_chars % 5 AS ng, least(n_chars % 7, n_chars % 5) AS nm, n_chars % 11 AS nq,
n_chars % 11 - toxic * (n_chars % 11 > 0)::INT AS nr FROM documents JOIN labels USING (doc_id)"""
SCORE = """SELECT model, coalesce(tier, 'all') AS scope, count(*) AS n_docs, avg((NOT failed)::INT) AS success, coalesce(sum(nm) FILTER (NOT failed), 0) / nullif(sum(ne) FILTER (NOT failed), 0) AS p, coalesce(sum(nm) FILTER (NOT failed), 0) / nullif(sum(ng), 0) AS r,
coalesce(sum(nr) FILTER (NOT failed), 0) / nullif(sum(nq) FILTER (NOT failed), 0) AS g FROM b GROUP BY GROUPING SETS ((model, tier), (model))"""


@query(f"WITH b AS ({BOARD}), s AS ({SCORE}) SELECT model, scope, n_docs, round(success, 6) AS success, round(p, 6) AS precision, round(r, 6) AS recall, round(g, 6) AS grounding, round(2 * p * r / nullif(p + r, 0), 6) AS f1, round(2 * g * r / nullif(g + r, 0), 6) AS f1_grounding FROM s")
def scoreboard(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(evaluate.scoreboard(_board(spark, sf)))


def _turns(spark: SparkSession, sf: str) -> DataFrame:
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)))
    return d.table(spark, sf, "conversations").select("conv_id", "turn", "role", words.alias("words"))


@query(
    """WITH c AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '\\p{L}+')) AS w FROM conversations), p AS (SELECT a.conv_id, a.turn AS run_a, b.turn AS run_b, len(list_intersect(a.w, b.w)) AS i, len(a.w) AS n, len(b.w) AS m FROM c a JOIN c b ON a.conv_id = b.conv_id AND a.turn < b.turn)
SELECT conv_id, run_a, run_b, round(CASE WHEN n + m - i = 0 THEN 1 ELSE i / (n + m - i) END, 6) AS jaccard FROM p"""
)
def run_agreement(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(evaluate.run_pairs(_turns(spark, sf), "conv_id", "turn", "words"))


@query("SELECT count(*) AS n_docs, round(avg((k = 1)::INT), 6) AS agreement FROM (SELECT user_id, date_trunc('day', ts) AS dd, count(event_type) AS n, count(DISTINCT event_type) AS k FROM events GROUP BY ALL HAVING count(event_type) = 3)")
def label_agreement(spark: SparkSession, sf: str) -> DataFrame:
    e = d.table(spark, sf, "events").select(F.struct("user_id", F.to_date("ts").alias("d")).alias("k"), "event_type")
    return rounded(evaluate.agreement(e, "k", "event_type", 3))


@query("SELECT user_id, count(*) AS n, round(stddev_pop(value), 6) AS sd, count(DISTINCT sign(value - 50)) = 1 AS same_sign FROM events GROUP BY user_id")
def run_spread(spark: SparkSession, sf: str) -> DataFrame:
    e = d.table(spark, sf, "events")
    return rounded(e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.stddev_pop("value").alias("sd"), (F.count_distinct(F.signum(F.col("value") - 50)) == 1).alias("same_sign")))


@query("""SELECT doc_id, md5(trim(v)) AS h, md5(trim(CASE WHEN length(v) > 300 THEN substr(v, 1, 300) || '...' ELSE v END)) AS h_short FROM (
SELECT doc_id, regexp_replace(regexp_replace(x, '\\s+', ' ', 'g'), '(?i)\\d+\\s*Table of Contents', '', 'g') AS v FROM (SELECT doc_id, text || ' 12 TABLE OF contents 7table of Contents ' || text AS x FROM documents))""")
def cleaned_text(spark: SparkSession, sf: str) -> DataFrame:
    """Digests of whole cleaned texts, with the mark of a page's foot between two copies, and of the optional truncation."""
    x = F.concat(F.col("text"), F.lit(" 12 TABLE OF contents 7table of Contents "), F.col("text"))
    return d.table(spark, sf, "documents").select("doc_id", F.md5(t.clean_text(x)).alias("h"), F.md5(t.clean_text(x, 300)).alias("h_short"))


_FROM, _TO = "".join(t.PLAIN), "".join(t.PLAIN.values()).replace("'", "''")
NORM = f"trim(regexp_replace(lower(translate(translate({{c}}, '{_FROM}', '{_TO}'), '{t.DROPPED}', '')), '\\s+', ' ', 'g'))"


@query(f"SELECT d.doc_id, b.item_id FROM (SELECT doc_id, {NORM.format(c='text')} AS x FROM documents) d JOIN (SELECT item_id, {NORM.format(c='text')} AS y FROM benchmark) b ON length(y) > 0 AND contains(x, y)")
def exact_quotes(spark: SparkSession, sf: str) -> DataFrame:
    """Quotes that stand in a document word for word, found by the words within them."""
    quotes = d.table(spark, sf, "benchmark").select("item_id", t.normalise(F.col("text")).alias("y"))
    docs = d.table(spark, sf, "documents").select("doc_id", t.normalise(F.col("text")).alias("x"))
    return grounding.containing(docs, quotes).select("doc_id", "item_id")


def _facts(spark: SparkSession, sf: str) -> DataFrame:
    """Quotes cut from documents, some of them altered, and what kind of fact they carry."""
    docs = d.table(spark, sf, "documents")
    k = F.col("doc_id") % 4
    cut = F.substring("text", 50, 120)
    quote = F.when(k == 0, cut).when(k == 1, F.regexp_replace(cut, "e", "é")).when(k == 2, F.reverse(cut)).otherwise(F.lit(""))
    kind = F.when(F.col("doc_id") % 3 == 0, "guidance").when(F.col("doc_id") % 3 == 1, "risk").otherwise("event")
    return docs.select("doc_id", kind.alias("kind"), quote.alias("quote"), F.col("text").alias("doc"))


@query()
def grounded_quotes(spark: SparkSession, sf: str) -> DataFrame:
    g = grounding.grounded(_facts(spark, sf))
    return rounded(g.select("doc_id", "kind", "grounded", "score", "method"))


@query()
def grounding_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(grounding.summary(grounding.grounded(_facts(spark, sf), scores=False), "kind"))


@query()
def kept_facts(spark: SparkSession, sf: str) -> DataFrame:
    return grounding.kept_facts(grounding.grounded(_facts(spark, sf), scores=False)).select("doc_id", "kind", "quote", "method")


@query("SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events")
def lenient_json(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("props")
    i = F.col("event_id") % 3
    wrapped = F.when(i == 0, p).when(i == 1, F.concat(F.lit("Here it is:\n```json\n"), p, F.lit("\n```\n"))).otherwise(F.concat(F.lit("Answer: "), p, F.lit(" - done")))
    return d.table(spark, sf, "events").select("event_id", t.lenient_json(wrapped, "struct<k:bigint>")["k"].alias("k"))


CHUNKS = """WITH RECURSIVE x AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS (SELECT doc_id, t, length(t) AS n FROM x),
c AS (SELECT doc_id, t, n, 0 AS pos, 0 AS a, CASE WHEN n <= 1000 THEN n WHEN 1000 < n AND instr(reverse(t[801:1000]), ' .') > 0 THEN 1000 - instr(reverse(t[801:1000]), ' .') ELSE 1000 END AS b FROM f
UNION ALL SELECT doc_id, t, n, pos + 1, s, CASE WHEN s + 1000 < n AND instr(reverse(t[s + 801:s + 1000]), ' .') > 0 THEN s + 1000 - instr(reverse(t[s + 801:s + 1000]), ' .') ELSE s + 1000 END FROM (SELECT *, b - 100 AS s FROM c WHERE n > 1000) WHERE s < n)
SELECT doc_id, pos, length(t[a + 1:b]) AS n, md5(t[a + 1:b]) AS h FROM c"""


@query(CHUNKS)
def char_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return t.chunked(d.table(spark, sf, "documents"), "doc_id", "text", 1000, 100).select("doc_id", "pos", F.length("chunk").alias("n"), F.md5("chunk").alias("h"))


TOKENS = """WITH RECURSIVE f AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) // 4 AS total FROM documents),
c AS (SELECT doc_id, t, total, 0 AS pos, 0::BIGINT AS s, CASE WHEN 0 + 400 < total AND instr(reverse(t[4 * 0 + 1281:4 * 0 + 1600]), ' .') > 0 THEN 4 * 0 + 1600 - instr(reverse(t[4 * 0 + 1281:4 * 0 + 1600]), ' .') ELSE 4 * least(0 + 400, total + 1) END AS e FROM f WHERE total > 400
UNION ALL SELECT doc_id, t, total, pos + 1, n, CASE WHEN n + 400 < total AND instr(reverse(t[4 * n + 1281:4 * n + 1600]), ' .') > 0 THEN 4 * n + 1600 - instr(reverse(t[4 * n + 1281:4 * n + 1600]), ' .') ELSE 4 * least(n + 400, total + 1) END FROM (SELECT *, s + greatest(1, length(t[4 * s + 1:e]) // 4 - 40) AS n FROM c) WHERE n < total - 40)
SELECT doc_id, pos, length(x) AS n, md5(x) AS h FROM (SELECT doc_id, pos, regexp_replace(t[4 * s + 1:e], '^\\s+|\\s+$', '', 'g') AS x FROM c) UNION ALL SELECT doc_id, 0, length(t), md5(t) FROM f WHERE total <= 400"""


@query(TOKENS)
def token_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return t.chunked(d.table(spark, sf, "documents"), "doc_id", "text", 400, 40, tokens=True).select("doc_id", "pos", F.length("chunk").alias("n"), F.md5("chunk").alias("h"))


@query()
def vocabulary_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks by the tokens of a public vocabulary."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return t.chunked(d.table(spark, sf, "documents"), "doc_id", "text", 400, 40, path=path).select("doc_id", "pos", F.length("chunk").alias("n"), F.md5("chunk").alias("h"))


@query(
    """WITH p AS (SELECT source, doc_id, n_chars // 4 AS tokens, ['mda', 'risk_factors', 'liquidity', 'business'][(doc_id % 4 + 1)::INT] AS section FROM documents), q AS (SELECT source, section, sum(tokens)::BIGINT AS tokens FROM p GROUP BY ALL),
w AS (SELECT *, list_position(['mda', 'risk_factors', 'liquidity', 'business'], section) AS o, 20000 - coalesce(sum(tokens) OVER (PARTITION BY source ORDER BY list_position(['mda', 'risk_factors', 'liquidity', 'business'], section) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lft FROM q),
x AS (SELECT *, max((tokens > lft AND lft < 500)::INT) OVER (PARTITION BY source ORDER BY o ROWS UNBOUNDED PRECEDING) AS ended FROM w)
SELECT source, section, tokens, greatest(0, CASE WHEN ended = 1 THEN 0 ELSE least(tokens, lft) END)::BIGINT AS take FROM x"""
)
def section_budget(spark: SparkSession, sf: str) -> DataFrame:
    names = F.array(*[F.lit(x) for x in ("mda", "risk_factors", "liquidity", "business")])
    p = d.table(spark, sf, "documents").select("source", F.expr("n_chars div 4").alias("tokens"), F.get(names, (F.col("doc_id") % 4).cast("int")).alias("section"))
    return t.budgeted(p.groupBy("source", "section").agg(F.sum("tokens").alias("tokens")), "source", 20_000).select("source", "section", "tokens", "take")


@query()
def html_text(spark: SparkSession, sf: str) -> DataFrame:
    return d.table(spark, sf, "pages").select("page_id", t.html_to_text("html").alias("x")).select("page_id", F.length("x").alias("n"), F.md5("x").alias("h"), t.looks_like_toc(F.col("x")).alias("toc"))


@query()
def filing_sections(spark: SparkSession, sf: str) -> DataFrame:
    """Documents dressed as filings, cut into their sections again, with what is missing."""
    x = F.concat(F.lit("ITEM 1A. RISK FACTORS\n"), F.col("text"), F.lit("\nITEM 7. MANAGEMENT'S DISCUSSION AND ANALYSIS\n"), F.reverse("text"), F.lit("\nITEM 8. Financial Statements"))
    own = d.table(spark, sf, "documents").select("doc_id", t.sections(x).alias("s"))
    return own.select("doc_id", F.array_sort(F.map_keys("s")).alias("found"), t.missing_sections(F.lit("10-K"), F.lit(2010), F.col("s")).alias("missing"), F.length(F.col("s")["mda"]).alias("n_mda"))


@query()
def matched_events(spark: SparkSession, sf: str) -> DataFrame:
    """Turns of users against turns of assistants, greedily one to one; a turn's text is its description and its quote."""
    c = d.table(spark, sf, "conversations").select(F.col("conv_id").alias("doc"), "turn", "role", "text", F.col("text").alias("quote"))
    return rounded(evaluate.match_events(c.where("role = 'user'").withColumnRenamed("turn", "i"), c.where("role = 'assistant'").withColumnRenamed("turn", "j"), 60.0))


@query("SELECT user_id AS ticker, since, until, round(coalesce(exp(sum(ln(f))), 1), 6) AS factor FROM (SELECT DISTINCT user_id, DATE '2024-01-05' AS since, DATE '2024-01-20' AS until FROM events) r LEFT JOIN (SELECT user_id AS u, ts::DATE AS dd, (event_id % 3 + 1) / nullif(event_id % 2, 0)::DOUBLE AS f FROM events WHERE event_type = 'error' AND event_id % 2 <> 0) x ON u = user_id AND dd > since AND dd <= until GROUP BY ALL")
def split_factors(spark: SparkSession, sf: str) -> DataFrame:
    e = d.table(spark, sf, "events")
    r = e.select(F.col("user_id").alias("ticker")).distinct().withColumns({"since": F.lit(date(2024, 1, 5)), "until": F.lit(date(2024, 1, 20))})
    x = e.where("event_type = 'error'").select(F.col("user_id").alias("ticker"), F.to_date("ts").alias("date"), (F.col("event_id") % 3 + 1).cast("double").alias("num"), (F.col("event_id") % 2).cast("double").alias("den"))
    return rounded(asof.split_factor(r, x))


@query("SELECT o_orderkey, (o_orderdate::DATE + INTERVAL 2 YEAR)::DATE AS later FROM orders WHERE o_orderdate::DATE BETWEEN DATE '1996-01-31' AND DATE '1997-02-28'")
def date_filter(spark: SparkSession, sf: str) -> DataFrame:
    o = d.table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").cast("string").alias("when"))
    own = readers.between(o, "when", date(1996, 1, 31), date(1997, 2, 28))
    return own.select("o_orderkey", s.add_years(F.substring("when", 1, 10).cast("date"), 2).alias("later"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def resume_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Orders that a sink of returned ones lacks."""
    done = d.table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return sinks.todo(d.table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), done, ["o_orderkey"])


@query("SELECT o_orderkey, abs(o_totalprice) <= 200000 AS kept FROM orders")
def recomputed_keys(spark: SparkSession, sf: str) -> DataFrame:
    o = d.table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    stay, again = sinks.recompute(o, o, F.abs("o_totalprice") > 200000, ["o_orderkey"])
    return stay.select("o_orderkey", F.lit(True).alias("kept")).unionByName(again.select("o_orderkey", F.lit(False).alias("kept")))


@query("SELECT doc_id, round((n_chars // 4 * 0.4 + n_chars // 40 * 1.6) / 1e6, 9) AS cost, CASE WHEN n_chars % 3 = 0 THEN 'N/A' ELSE (n_chars % 3)::VARCHAR || '%' END AS label FROM documents")
def token_costs(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("n_chars")
    cost = s.token_cost(F.expr("n_chars div 4"), F.expr("n_chars div 40"), F.lit(0.4), F.lit(1.6))
    return d.table(spark, sf, "documents").select("doc_id", F.round(cost, 9).alias("cost"), s.or_na(n % 3, "%", zero_is_missing=True).alias("label"))


@query(sql("SELECT ticker, count(ret) AS n, round(avg(ret), 8) AS mean, round(stddev_samp(ret), 6) AS sd, round(min(ret), 6) AS lo, round(max(ret), 6) AS hi, round(quantile_cont(ret, 0.05), 6) AS p5, round(quantile_cont(ret, 0.95), 6) AS p95 FROM rets GROUP BY ticker", "rets"))
def ensemble_summary(spark: SparkSession, sf: str) -> DataFrame:
    x = stats.summary(d.rets(spark, sf), "ticker", "ret")
    return x.select("ticker", "n", F.round("mean", 8).alias("mean"), *[F.round(c, 6).alias(c) for c in ("sd", "lo", "hi", "p5", "p95")])


@query(
    sql(
        """SELECT a.rebal_date, a.ticker AS a, b.ticker AS b, round(covar_samp(a.ret, b.ret) * 252, 6) AS cov FROM w a JOIN w b ON a.rebal_date = b.rebal_date AND a.date = b.date AND a.ticker <= b.ticker GROUP BY 1, 2, 3""",
        "rets", "periods", w="SELECT rebal_date, date, ticker, ret FROM (SELECT p.rebal_date, r.*, dense_rank() OVER (PARTITION BY p.rebal_date ORDER BY r.date DESC) AS k FROM periods p JOIN rets r ON r.date <= p.rebal_date) WHERE k <= 252",
    )
)
def rolling_covariance(spark: SparkSession, sf: str) -> DataFrame:
    r = d.rets(spark, sf)
    return rounded(alloc.covariance(alloc.moments(r, d.periods(spark, sf, r))))


def allocated(spark: SparkSession, sf: str, p: DataFrame | None = None, u: DataFrame | None = None, r: DataFrame | None = None) -> DataFrame:
    """strategy, rebal_date, ticker, w, held of the strategies that ``alloc`` knows."""
    r = d.rets(spark, sf) if r is None else r
    if p is None or u is None:
        p, u = d.setting(spark, sf, r)
    sums = alloc.moments(r, p)
    return alloc.allocate(sums, d.at_rebalances(p, u), _sigma_views(spark, sf, p, u), [*alloc.STRATEGIES, *alloc.FREE])


def _sigma_views(spark: SparkSession, sf: str, p: DataFrame | None = None, u: DataFrame | None = None) -> DataFrame:
    a = d.active(spark, sf, p, u)
    return a.select("rebal_date", "ticker", "view_bps", "confidence", s.calibrated_sigma(F.col("confidence"), F.lit(None).cast("double"), F.col("sentiment")).alias("sigma"))


@query()
def allocations(spark: SparkSession, sf: str) -> DataFrame:
    """Weights of every covariance-aware and placebo strategy."""
    return rounded(allocated(spark, sf))


@query()
def annotated_views(spark: SparkSession, sf: str) -> DataFrame:
    docs = d.table(spark, sf, "documents").select("doc_id", F.concat(F.lit("Give a view on: "), F.col("text")).alias("prompt"))
    return annotate.views(annotate.annotate(docs, "doc_id", "prompt"), "doc_id")


@query()
def one_stage_views(spark: SparkSession, sf: str) -> DataFrame:
    """Views drawn from whole documents in one step, with their quotes held against the text."""
    docs = d.table(spark, sf, "documents").select("doc_id", "text")
    return annotate.one_stage(annotate.annotate(docs, "doc_id", "text", annotate.offline_one_stage), docs, "doc_id")


@query(sql("SELECT ticker, (DATE '1970-01-01' + (90 * (date_diff('day', DATE '1970-01-01', view_date) // 90))::INT)::DATE AS start, arg_max(view_bps, (view_date, seq)) AS view_bps, count(*) AS n FROM views GROUP BY 1, 2", "views"))
def latest_views_by_window(spark: SparkSession, sf: str) -> DataFrame:
    return latest.latest_by_window(d.views(spark, sf))


@query(sql("SELECT filing_type, confidence, count(*) AS n, min(view_bps) AS lo, max(view_bps) AS hi, round(avg(view_bps), 6) AS mean FROM views GROUP BY ALL", "views"))
def confidence_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(d.views(spark, sf).groupBy("filing_type", "confidence").agg(F.count(F.lit(1)).alias("n"), F.min("view_bps").alias("lo"), F.max("view_bps").alias("hi"), F.avg("view_bps").alias("mean")))


@query("SELECT c_custkey, coalesce(r_name, 'Unknown') AS sector, row_number() OVER (PARTITION BY r_name ORDER BY c_acctbal DESC, c_custkey) AS k FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_nationkey % 5 <> 0 LEFT JOIN region ON n_regionkey = r_regionkey")
def sector_lookup(spark: SparkSession, sf: str) -> DataFrame:
    n = d.dim(d.table(spark, sf, "nation").where("n_nationkey % 5 <> 0").join(d.table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name"))
    own = d.table(spark, sf, "customer").join(small(n), F.col("c_nationkey") == F.col("n_nationkey"), "left").withColumn("sector", F.coalesce("r_name", F.lit("Unknown")))
    k = F.row_number().over(Window.partitionBy("sector").orderBy(F.col("c_acctbal").desc(), "c_custkey"))
    return own.select("c_custkey", "sector", k.cast("long").alias("k"))
