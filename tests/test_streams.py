"""The stream of views against the batch answer, and the market source's partitions and offsets."""

from __future__ import annotations

import random
from datetime import date, timedelta

import pytest

from tidemark.operators import asof
from tidemark.sources import market_api
from tidemark.streaming import latest

VIEWS = "ticker string, view_date date, seq long, view_bps int"


@pytest.fixture()
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(key)


def stream(spark, tmp_path, batches, delay):
    """Each batch is a file and a micro-batch; what came out, in order of the batches."""
    out = []
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, VIEWS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        q = latest.latest_views(spark.readStream.schema(VIEWS).parquet(f"{tmp_path}/in"), delay)
        q = q.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").trigger(availableNow=True).start(f"{tmp_path}/out")
        q.awaitTermination(120)
        now = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect()))
        out.append([r for r in now if r not in [x for o in out for x in o]])
    return out


def test_stream_of_views_equals_the_batch_answer(rocks, tmp_path):
    rng = random.Random(1)
    d0 = date(2020, 1, 1)
    views = [(rng.choice("ABC"), d0 + timedelta(rng.randrange(100)), i, rng.randrange(-300, 300)) for i in range(60)]
    batches = [views[:25], views[20:45], views[10:60]]  # rows come late, and again
    rows = [r for b in stream(rocks, tmp_path, batches, "200 days") for r in b]
    last = {}
    for t, day, seq, bps, active in rows:
        assert active
        last[t] = max(last.get(t, (d0, -1, 0)), (day, seq, bps))
    at = rocks.createDataFrame([(t, d0 + timedelta(110)) for t in "ABC"], "ticker string, rebal_date date")
    want = {r.ticker: (r.view_date, r.seq, r.view_bps) for r in asof.active_views(rocks.createDataFrame(views, VIEWS), at).collect()}
    assert last == want


def test_views_go_stale_after_their_days(rocks, tmp_path):
    d = lambda k: date(2020, 1, 1) + timedelta(k)
    out = stream(rocks, tmp_path, [[("A", d(0), 1, 10), ("B", d(100), 2, 20)], [("B", d(120), 3, 30)], [("C", d(121), 4, 40)], [("C", d(122), 5, 50)], [("A", d(123), 6, 60)]], "0 days")
    flat = [r for b in out for r in b]
    assert ("A", d(0), 1, 10, True) in flat and ("A", d(0), 1, 10, False) in flat
    stale = next(k for k, b in enumerate(out) if ("A", d(0), 1, 10, False) in b)
    assert stale >= 2  # day 120 is still within, the watermark passes day 121 later
    assert ("A", d(123), 6, 60, True) in flat and not any(r[0] in "BC" and not r[4] for r in flat)
    assert [r[2] for r in flat if r[0] == "B"] == [2, 3]


def test_one_symbol_is_many_partitions(spark):
    spark.dataSource.register(market_api.MarketData)
    own = {"symbols": "AA,BB", "start": "2018-01-01", "end": "2020-12-31", "per_minute": "1e9"}
    for dataset in ("prices", "filings", "income"):
        whole = spark.read.format("market_data").options(**own, dataset=dataset, span_days="5000").load()
        cut = spark.read.format("market_data").options(**own, dataset=dataset, span_days="100").load()
        assert whole.rdd.getNumPartitions() == 2 and cut.rdd.getNumPartitions() == 2 * 11
        assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, cut.collect())) and whole.count() > 20
    parts = market_api.ranges(["AA"], date(2020, 1, 1), date(2020, 1, 10), 4)
    assert [(p.since.day, p.until.day) for p in parts] == [(1, 4), (5, 8), (9, 10)] and market_api.ranges(["AA"], date(2020, 1, 2), date(2020, 1, 1), 4) == []


def test_stream_of_prices_reads_every_day_once(spark, tmp_path):
    spark.dataSource.register(market_api.MarketData)
    own = {"symbols": "AA,BB", "start": "2020-01-01", "span_days": "7", "per_minute": "1e9"}
    for end in ("2020-01-20", "2020-01-20", "2020-02-10"):  # the second finds nothing new
        q = spark.readStream.format("market_data").options(**own, end=end).load().writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/cp").trigger(once=True).start(f"{tmp_path}/out")
        q.awaitTermination(120)
        assert q.exception() is None
        want = spark.read.format("market_data").options(**own, end=end).load()
        assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect())) == sorted(map(tuple, want.collect()))
