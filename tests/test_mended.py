"""Cases derived by hand from the rules of the domain: what earlier versions had wrong."""

from __future__ import annotations

import random
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalars as s
from tidemark.functions import text as t
from tidemark.operators import alloc, coverage, evaluate, features, grounding, sampling, stats
from tidemark.sources import readers, sinks


def column(spark, values, f, kind="string"):
    d = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in d.orderBy("i").select(f(F.col("v"))).collect()]


def test_periods(spark):
    d = spark.createDataFrame([("10-K", date(2020, 2, 1)), ("10-K/A", date(2020, 2, 1)), ("8-K", date(2020, 5, 1)), (None, date(2020, 8, 1)), ("10-K", None)], "f string, d date")
    assert [r[0] for r in d.select(s.fiscal_period(F.col("f"), F.col("d"))).collect()] == ["FY 2019", "Q4 2019", "Q1 2020", "Q2 2020", "Unknown"]
    assert [r[0] for r in d.select(s.filing_quarter(F.col("f"), F.col("d"))).collect()] == ["2020", None, None, None, None]
    given = [None, "", " fy 2023", "FY2023", "fy  2023 est", "Q1 2024", "q12024", "Q3_2020", "q4  2021", "Half 2020", "Q5 2020"]
    assert column(spark, given, s.normalise_period) == ["Unknown", "Unknown", "FY2023", "FY2023", "FY 2023 EST", "Q1_2024", "Q1_2024", "Q3_2020", "Q4_ 2021", "Half 2020", "Q5 2020"]


def test_sentiment_in_any_case(spark):
    got = column(spark, ["Confident", "CONCERNED", "neutral", None], lambda c: s.calibrated_sigma(F.lit("high"), F.lit(None).cast("double"), c))
    assert got == pytest.approx([0.008, 0.008, 0.01, 0.01])


def test_cleaned_text_in_any_case(spark):
    assert column(spark, ["a 12 TABLE OF CONTENTS b", "x 3table of contents"], t.clean_text) == ["a  b", "x"]


def test_chunks():
    assert t.char_chunks("", 10, 2) == [""] and t.char_chunks("x" * 10, 10, 2) == ["x" * 10]
    x = "".join(chr(97 + i % 26) for i in range(1850))
    got = t.char_chunks(x, 1000, 100)
    assert [len(c) for c in got] == [1000, 950, 50] and got[2] == x[1800:] and got[1] == x[900:]
    assert len(t.char_chunks("y" * 1800, 1000, 100)) == 2
    assert all(c == c.strip() for c in t.token_chunks("word word. " * 4000, 400, 40))


def test_budget(spark):
    rows = [("a", "mda", 9_700), ("a", "risk_factors", 200), ("a", "liquidity", 300), ("a", "business", 5), ("b", "mda", 9_000), ("b", "risk_factors", 5_000), ("b", "liquidity", 10)]
    d = spark.createDataFrame(rows, "k string, section string, tokens long")
    got = {(r.k, r.section): r["take"] for r in t.budgeted(d, "k", 10_000).collect()}
    assert got == {("a", "mda"): 9_700, ("a", "risk_factors"): 200, ("a", "liquidity"): 0, ("a", "business"): 0, ("b", "mda"): 9_000, ("b", "risk_factors"): 1_000, ("b", "liquidity"): 0}


def test_tables(spark):
    cell = "a cell of some length indeed"
    page = f"<table><tr><td>{cell}</td><td>{cell} &amp; more<table><tr><td>inner {cell}</td><td>again {cell}</td></tr></table></td></tr></table><table><tr><td>tiny</td></tr></table>"
    got = column(spark, [page, None, ""], t.html_tables)
    inner = f"inner {cell} | again {cell}"
    assert got == [[f"{cell} | {cell} & more | {inner}", inner], [], []]


def test_placebo_strategies():
    n, rng = 12, np.random.default_rng(0)
    x = rng.normal(0, 0.01, (300, n))
    cov, mean = alloc.sample_cov(alloc.Moments.of(x)), x.mean(0)
    assert cov == pytest.approx(np.cov(x, rowvar=False) * 252)
    import pandas as pd

    v = pd.DataFrame({"ticker": list("abc"), "at": [0, 1, 2], "view_bps": [50, 20, -10], "confidence": ["medium"] * 3, "sigma": [0.03] * 3})
    drawn = np.random.default_rng(7).normal(0, 84.5 / 10000, n)
    base = np.full(n, 1 / n)
    mu = alloc.posterior(cov, alloc.prior(cov, base), np.arange(n), drawn, np.full(n, 0.03**2))
    assert alloc.STRATEGIES["random_views"](mean, cov, v, 7) == pytest.approx(alloc.mean_variance(mu, cov))
    at = np.random.default_rng(7).choice(n, 2, replace=False)
    mu = alloc.posterior(cov, alloc.prior(cov, base), at, np.array([50, 20]) / 1e4, np.full(2, 0.03**2))
    assert alloc.STRATEGIES["shuffled_views"](mean, cov, v, 7) == pytest.approx(alloc.tilt(mu, base))


def test_ranks_by_ranges(spark):
    rng = random.Random(3)
    v = [rng.choice([rng.random(), rng.randrange(20)]) * 1.0 for _ in range(500)]
    d = spark.createDataFrame([(i, x) for i, x in enumerate(v)], "i int, x double")
    got = {r.i: r.rk for r in stats.average_rank(d, "x", "rk", 7).collect()}
    assert got == {i: sum(y < x for y in v) + (sum(y == x for y in v) + 1) / 2 for i, x in enumerate(v)}


def test_latest_reported_equals_a_join(spark):
    rng = random.Random(4)
    day = lambda: date(2020, 1, 1 + rng.randrange(28))
    m = [(rng.choice("ab"), i, day(), float(i)) for i in range(30)]
    at = [(k, date(2020, 1, x)) for k in "abc" for x in (1, 10, 20, 28)]
    got = features.latest_reported(spark.createDataFrame(at, "ticker string, view_date date"), spark.createDataFrame(m, "ticker string, pos int, filing_date date, eps double"))
    want = {}
    for k, x in at:
        ok = [r for r in m if r[0] == k and r[2] < x]
        if ok:
            want[k, x] = min(ok, key=lambda r: r[1])[1]
    assert {(r.ticker, r.view_date): r.pos for r in got.collect()} == want


def test_containing_equals_a_scan(spark):
    rng = random.Random(5)
    word = lambda: rng.choice(["aa", "ab", "ba", "c", "dd"])
    docs = [(i, " ".join(word() for _ in range(rng.randrange(40)))) for i in range(60)]
    quotes = [(j, docs[j][1][rng.randrange(5) : rng.randrange(8, 40)].strip()) for j in range(40)] + [(90, ""), (91, "a b"), (92, "zz zz zz zz zz")]
    got = grounding.containing(spark.createDataFrame(docs, "doc_id int, x string"), spark.createDataFrame(quotes, "item_id int, y string")).collect()
    assert sorted(map(tuple, got)) == sorted((i, j) for i, x in docs for j, y in quotes if y and y in x)


def test_greedy_with_a_range_to_look_at():
    scores = [(90.0, 0, 0), (70.0, 1, 0), (65.0, 1, 1), (55.0, 2, 2), (52.0, 2, 1), (20.0, 3, 3)]
    assert evaluate.greedy(scores, 60.0) == [(0, 0, 90.0), (1, 1, 65.0)]
    assert evaluate.greedy(scores, 60.0, (50.0, 72.0)) == [(0, 0, 90.0, True, False), (1, 1, 65.0, True, True), (2, 2, 55.0, False, True)]


def test_paired_test(spark):
    d = spark.createDataFrame([(1.0, 0.5), (2.0, 1.0), (3.0, 3.5), (None, 1.0), (5.0, 4.0)], "a double, b double")
    r = stats.paired(d, "a", "b").first()
    x = np.array([0.5, 1.0, -0.5, 1.0])
    assert (r.n, r.wins) == (4, 3) and r.t == pytest.approx(x.mean() / (x.std(ddof=1) / 2)) and r["diff"] == pytest.approx(0.5)
    assert r.p == pytest.approx(0.2522153, abs=1e-6)


def test_manifest_equals_a_draw_over_all_rows(spark):
    import hashlib

    rng = random.Random(6)
    rows = [(i, f"t{rng.randrange(70)}", rng.choice(["10-K", "10-Q", "10-Q"]), rng.choice(["p", "q", "r", "other"])) for i in range(600)]
    got = sampling.manifest(spark.createDataFrame(rows, "id long, ticker string, form string, period string"), ["p", "q", "r"], 40).collect()
    pool = sorted((hashlib.md5(f"{r[0]}|20260829".encode()).hexdigest(), *r) for r in rows if r[3] != "other")
    sizes = {p: sum(r[4] == p for r in pool) for p in "pqr"}
    want = sampling.chosen([r[1:] for r in pool], sampling.quota(sizes, list("pqr"), 40), list("pqr"), 0.22)
    assert {r.id for r in got} == {r[0] for r in want} and len(got) == 40
    assert [sum(r.tier == k for r in got) for k in ("tuning", "evaluation", "pool")] == [5, 15, 20]


def test_portfolios_of_one_size(spark):
    names = [("a", f"a{i}") for i in range(3)] + [("b", f"b{i}") for i in range(5)] + [("c", f"c{i}") for i in range(2)]
    got = coverage.alternate(spark.createDataFrame(names, "s string, n string"), "s", "n").collect()
    one, two = ({r.n for r in got if r.portfolio == k} for k in (1, 2))
    # in turn: a0 a2 b0 b2 b4 c0 against a1 b1 b3 c1; the last of the larger one moves
    assert one == {"a0", "a2", "b0", "b2", "b4"} and two == {"a1", "b1", "b3", "c1", "c0"}


# --- readers and sinks ---


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def test_readers(spark, tmp_path):
    put(tmp_path / "views.csv", "ticker,view_date,fiscal_period,filing_type,view_bps,confidence,sentiment,eps_surprise\nA,2020-01-02,FY 2019,10-K,50,high,neutral,\n")
    r = readers.views(spark, f"{tmp_path}/views.csv").first()
    assert (r.ticker, r.view_date, r.view_bps, r.eps_surprise) == ("A", date(2020, 1, 2), 50, None)
    put(tmp_path / "facts/1.json", '{"ticker": "A", "filing_date": "2020-01-02", "filing_type": "10-K",\n "key_events": [{"event_type": "x", "description": "d"}]}')
    put(tmp_path / "facts/2.json", '{"ticker": "B", ')
    put(tmp_path / "facts/3.json", '{"ticker": "C", "filing_type": "10-K"}')
    assert [(r.ticker, r.key_events[0].description) for r in readers.facts(spark, f"{tmp_path}/facts").collect()] == [("A", "d")]
    put(tmp_path / "data/A/income.json", '{"quarterly": [{"date": "2020-03-31", "eps": 1.5}, {"date": "2019-12-31", "eps": null}]}')
    assert [(r.ticker, r.pos, r.date, r.eps) for r in readers.income(spark, f"{tmp_path}/data/*/income.json").orderBy("pos").collect()] == [("A", 0, "2020-03-31", 1.5), ("A", 1, "2019-12-31", None)]
    put(tmp_path / "data/A/estimates.json", '[{"date": "2020-01-01", "epsAvg": 1.0}, {"date": "2020-04-01"}]')
    assert [(r.ticker, r.pos, r.epsAvg) for r in readers.json_rows(spark, f"{tmp_path}/data/*/estimates.json", "date:string,epsAvg:double").orderBy("pos").collect()] == [("A", 0, 1.0), ("A", 1, None)]
    put(tmp_path / "sp.csv", "Symbol,GICS Sector\nA,Tech\nB,Energy\nA,Health\n")
    assert {r.ticker: r.sector for r in readers.constituents(spark, f"{tmp_path}/sp.csv").collect()} == {"A": "Health", "B": "Energy"}
    put(tmp_path / "incidents.jsonl", '{"timestamp": "t", "ticker": "A", "incident_type": "llm_error", "message": "m", "details": {"k": "v"}}\n')
    assert readers.incidents(spark, f"{tmp_path}/incidents.jsonl").first().details == {"k": "v"}
    five = spark.createDataFrame([(date(2020, 1, 2), 0.1), (date(2020, 1, 3), 0.2)], "date date, mkt double")
    mom = spark.createDataFrame([(date(2020, 1, 3), 0.3)], "date date, mom double")
    assert [tuple(r) for r in readers.factors(five, mom).collect()] == [(date(2020, 1, 3), 0.2, 0.3)]
    last = readers.last_of(spark.createDataFrame([("a", 1), ("a", 3), ("b", 2)], "k string, v int"), ["k"], ["v"])
    assert sorted(map(tuple, last.collect())) == [("a", 3), ("b", 2)]


def test_returns_and_runs(spark, tmp_path):
    put(tmp_path / "core/daily_returns.csv", "date,equal_weight,bl_llm\n2020-01-02,0.01,\n2020-01-03,0.02,0.5\n")
    got = sorted(map(tuple, readers.returns(spark, str(tmp_path), "core").collect()))
    assert got == [("bl_llm", date(2020, 1, 3), 0.5), ("equal_weight", date(2020, 1, 2), 0.01), ("equal_weight", date(2020, 1, 3), 0.02)]
    with pytest.raises(FileNotFoundError):
        readers.returns(spark, str(tmp_path), "holdout")
    put(tmp_path / "gold/001.json", '{"id": "a", "tier": "pool", "events": [{"description": "x"}, {"description": "y"}]}')
    put(tmp_path / "gold/notes.json", '{"id": "zz"}')
    put(tmp_path / "run/001.json", '{"doc_id": "a", "facts": {"key_events": [{"description": "x"}]}}')
    put(tmp_path / "run/002.json", '{"doc_id": "other", "facts": null}')
    put(tmp_path / "gold/002.json", '{"id": "b", "tier": "blind", "events": []}')
    put(tmp_path / "run/003.json", '{"doc_id": "b", "facts": null}')
    gold = readers.gold(spark, f"{tmp_path}/gold")
    assert sorted(r.doc_id for r in gold.collect()) == ["a", "b"]
    runs = {r.doc_id: (r.tier, r.failed, len(r.key_events or [])) for r in readers.runs(spark, f"{tmp_path}/run", gold).collect()}
    assert runs == {"a": ("pool", False, 1), "b": ("blind", True, 0)}


def test_sinks(spark, tmp_path):
    v = spark.createDataFrame([("B", date(2020, 1, 1), 1), ("A", date(2020, 2, 1), 2), ("A", date(2020, 1, 1), 3)], "ticker string, view_date date, view_bps int")
    sinks.summary_csv(v, f"{tmp_path}/summary")
    text = "".join(p.read_text() for p in sorted((tmp_path / "summary").glob("*.csv")))
    assert [x.split(",")[0] + x.split(",")[2] for x in text.splitlines()[1:]] == ["A3", "A2", "B1"]
    sinks.json_lines(v, f"{tmp_path}/lines")
    sinks.json_lines(v, f"{tmp_path}/lines")
    assert spark.read.json(f"{tmp_path}/lines").count() == 6
    m = spark.createDataFrame([("top", 0.5, None), ("low", 0.25, 1.0)], "strategy string, sharpe double, x double")
    sinks.nested_json(m, f"{tmp_path}/metrics.json", ["strategy"])
    import json

    assert json.loads((tmp_path / "metrics.json").read_text()) == {"top": {"sharpe": 0.5, "x": None}, "low": {"sharpe": 0.25, "x": 1.0}}
    assert sinks.markdown(m.orderBy("strategy")) == "| strategy | sharpe | x |\n|---|---|---|\n| low | 0.250 | 1.000 |\n| top | 0.500 | - |"


# --- annotators, prompts, the market source ---


def test_contracts():
    from tidemark.operators import annotate as a

    slept = []
    c = a.Contract(4, (a.Transient, ValueError), 5.0, 10.0, True, slept.append)
    answers = iter(["", "{bad", '{"x": 1}'])
    assert a.call_once(lambda p: next(answers), "p", c) == ('{"x": 1}', None) and slept == [5.0, 5.0]
    slept.clear()
    assert a.call_once(lambda p: "", "p", c) == (None, "Transient: empty answer") and slept == [5.0, 5.0, 8.0]
    calls = []

    def cut(p):
        calls.append(p)
        raise a.Truncated("cut")

    assert a.call_once(cut, "p", a.FACTS_CONTRACT) == (None, "Truncated: cut") and len(calls) == 1
    assert a.call_once(lambda p: "{bad", "p", a.FACTS_CONTRACT) == ("{bad", None)
    assert [a.FACTS_CONTRACT.wait(i) for i in range(1, 8)] == [10, 10, 10, 16, 32, 64, 120] and a.VIEWS_CONTRACT.tries == 5
    now = [0.0]
    pace = a.Pace(20, sleep=lambda s: now.__setitem__(0, now[0] + s), clock=lambda: now[0])
    for _ in range(4):
        pace.wait()
    assert now[0] == pytest.approx(9.0)


def test_facts_and_all_incidents(spark):
    from tidemark.operators import annotate as a

    raw = '{"ticker": "WRONG", "risk_factors": [{"category": "m", "severity": "N/A", "source_quote": "q"}], "risk_summary": "null", "sentiment": "Confident", "key_events": []}'
    d = spark.createDataFrame([(1, "```json\n" + raw + "\n```", None), (2, "{bad", None), (3, None, "Transient: x"), (4, '{"risk_factors": []}', None)], "id int, raw string, error string")
    f = spark.createDataFrame([(i, "T", "10-K", "2020-02-01", "FY 2019") for i in range(1, 5)], "id int, ticker string, filing_type string, filing_date string, fiscal_period string")
    got = {r.id: r for r in a.facts(d, f, "id").collect()}
    assert set(got) == {1, 4} and got[1].ticker == "T" and got[1].risk_summary is None and got[1].risk_factors[0].severity is None and got[1].fiscal_period == "FY 2019"
    from tidemark.sources.readers import FACTS

    kinds = {(r.id, r.incident_type) for r in a.incidents(d, "id", f"struct<{FACTS.replace(' array', ':array').replace(' string', ':string').replace(' struct', ':struct')}>").collect()}
    assert kinds == {(2, "json_decode_error"), (3, "llm_error")}
    parsed = spark.createDataFrame([(1, "10-K", 2010, {"mda": "x"}, None), (2, "10-Q", 2010, {}, None), (3, "10-Q", 2010, {"mda": "x"}, None), (4, "10-K", 2010, None, "boom")], "id int, form string, year int, sections map<string,string>, error string")
    assert {(r.id, r.incident_type) for r in a.section_incidents(parsed, "id").collect()} == {(1, "missing_sections"), (2, "no_sections"), (4, "extraction_error")}
    left = a.fact_incidents(a.facts(d, f, "id"), spark.createDataFrame([(1, "q")], "id int, quote string"), "id")
    assert {(r.id, r.incident_type) for r in left.collect()} == {(4, "empty_risk_factors"), (1, "ungrounded_fact")}


def test_prompt_says_what_is_missing(spark):
    from tidemark.functions import prompts

    risk = "array<struct<category:string,severity:string,description:string>>"
    schema = (
        f"ticker string, view_date date, fiscal_period string, sector string, annual_date date, risks {risk}, risk_summary string, annual_events array<string>, quarterly_date date, sentiment string, rationale string, direction string, "
        "revenue_outlook string, earnings_outlook string, quarterly_events array<string>, eps double, eps_avg double, eps_surprise double, revenue double, revenue_avg double, revenue_surprise double, analysts int, dispersion double, ret_1m double, ret_3m double, vol_60d double"
    )
    full = ("A", date(2020, 2, 3), "FY2019", "Tech", date(2020, 2, 1), [("a", "low", "x" * 200), ("b", "high", "y"), ("c", "high", "z")], "", [f"e{i}" for i in range(7)], None, None, "", "up", None, "", [], 1.234, 0.0, -0.04, 12.34, None, 3.21, 7, 0.256, 0.0, -1.26, None)
    none = ("B", date(2020, 2, 3), "FY2019", None, None, None, None, None, None, None, None, None, None, None, None, *[None] * 11)
    a, b = (r[0].split("\n") for r in spark.createDataFrame([full, none], schema).select(prompts.view_prompt()).collect())
    assert a[0] == "Company: A (Tech), view of 2020-02-03 after FY2019"
    assert a[1] == "Annual report of 2020-02-01. Risks: 3 risk factors identified. Foremost: b: y; c: z. Events: e0, e1, e2, e3, e4"
    assert a[2] == "Quarterly report of N/A. Tone: neutral - No rationale provided" and a[3] == "Guidance: up; revenue: Not specified; earnings: Not specified"
    assert a[5] == "EPS 1.23 against N/A, surprise -0.0 %" and a[6] == "Revenue 12.3 against N/A bn, surprise +3.2 %" and a[7] == "Analysts 7, dispersion 25.6 %"
    assert a[8] == "Returns +0.0 % and -1.3 %, volatility N/A %"
    assert b[1] == "Annual report of N/A. Risks: No significant risks identified. Foremost: N/A. Events: No significant events" and b[8] == "Returns N/A % and N/A %, volatility N/A %"


def test_market_client():
    from tidemark.sources import market_api as m

    slept, asked = [], []
    now = [0.0]

    def fetch(endpoint, params):
        asked.append(params.get("page"))
        return (429, None) if len(asked) == 2 else m.made_up(endpoint, params)

    def sleep(s):
        slept.append(s)
        now[0] += s

    c = m.Client(fetch, 60, 9.0, sleep=sleep, clock=lambda: now[0])
    rows = c.rows("filings", {"symbol": "A", "from": "2018-01-01", "to": "2020-12-31"}, True)
    assert len(rows) == 12 and asked == [0, 1, 1, 2, 3] and 9.0 in slept and [r["date"] for r in rows] == sorted(r["date"] for r in rows)
    assert m.Client(lambda e, p: (200, {"No": "Data"})).rows("report", {}) == []
    with pytest.raises(RuntimeError):
        m.Client(lambda e, p: (500, None)).ask("x", {})
    with pytest.raises(RuntimeError):
        m.Client(lambda e, p: (429, None), sleep=lambda s: None, tries=2).ask("x", {})


def test_market_source(spark):
    from tidemark.sources import market_api as m

    spark.dataSource.register(m.MarketData)
    before = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        read = lambda **o: spark.read.format("market_data").options(symbols="A,B", pushdown="true", start="2019-01-01", end="2020-12-31", **o).load()
        f = read(dataset="filings", form="10-K")
        assert sorted((r.ticker, str(r.date)) for r in f.collect()) == [(s, f"{y}-01-01") for s in "AB" for y in (2019, 2020)]
        p = read().where("date >= date'2020-03-02' and date < date'2020-03-05' and ticker = 'A'")
        assert sorted(str(r.date) for r in p.collect()) == ["2020-03-02", "2020-03-03", "2020-03-04"] and {r.ticker for r in p.collect()} == {"A"}
        for name in m.ENDPOINTS:
            assert read(dataset=name).count() > 0
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", before)


def test_pushed_filters_narrow_the_request():
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThanOrEqual

    from tidemark.sources import market_api as m

    r = m.PushedReader({"symbols": "A,B", "start": "2019-01-01", "end": "2020-12-31"}, ["date"])
    kept = list(r.pushFilters([GreaterThan(("date",), date(2019, 6, 1)), LessThanOrEqual(("date",), date(2019, 7, 1)), EqualTo(("ticker",), "B"), In(("ticker",), ("A",))]))
    assert (r.start, r.end, [p.name for p in r.partitions()]) == (date(2019, 6, 2), date(2019, 7, 1), ["B"]) and len(kept) == 1


def test_sections_within_a_budget():
    parts = {"business": "b" * 4000, "mda": "m" * 8000, "risk_factors": "r" * 2000}
    assert t.chunk_sections({}) == [] and t.chunk_sections({"x": "y"}) == []
    got = t.chunk_sections({"mda": "m" * 40}, 100, 50, 5)
    assert got == ["[SECTION: MDA]\n\n" + "m" * 40]
    # 2,000 tokens of mda in pieces of 800 with 40 of overlap: 800 + 800 + 480, and 4 of the marker; 500 of risk factors do not fit in what is left of 2,400
    got = t.chunk_sections(parts, 2400, 800, 40)
    assert [len(x) for x in got] == [3200 + 16, 3200, 1920] and got[0].startswith("[SECTION: MDA]\n\n")
    got = t.chunk_sections(parts, 2700, 800, 40)
    assert [x[:14] for x in got if x[0] == "["] == ["[SECTION: MDA]", "[SECTION: RISK"] and len(got) == 4
    assert [t.n_tokens(x) for x in t.chunk_sections(parts)] == [2004, 506, 1005]
