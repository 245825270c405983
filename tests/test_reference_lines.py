"""Values worked out by hand from the published code's lines, sinks that survive a crash, draws that any task can make."""

from __future__ import annotations

import hashlib
import json
import math
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import scalars as s
from tidemark.functions import text as t
from tidemark.operators import annotate, evaluate, stats
from tidemark.sources import readers, sinks


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def test_gold_files_carry_id(spark, tmp_path):
    put(tmp_path / "gold/01_a.json", '{"id": "AA_10-K_2010", "ticker": "AA", "tier": "tier1b_eval", "events": [{"event_type": "other", "description": "d", "impact": "x", "source_quote": "q"}]}')
    put(tmp_path / "gold/manifest.json", '{"id": "no"}')
    put(tmp_path / "run/01_a.json", '{"doc_id": "AA_10-K_2010", "facts": {"key_events": [{"description": "e"}, {"description": "f"}]}}')
    put(tmp_path / "run/02_b.json", '{"doc_id": "elsewhere", "facts": null}')
    gold = readers.gold(spark, f"{tmp_path}/gold")
    assert [(r.doc_id, r.tier, r.events[0].source_quote) for r in gold.collect()] == [("AA_10-K_2010", "tier1b_eval", "q")]
    assert [(r.doc_id, r.failed, len(r.key_events)) for r in readers.runs(spark, f"{tmp_path}/run", gold).collect()] == [("AA_10-K_2010", False, 2)]


def test_a_text_within_one_chunk_is_itself():
    assert t.token_chunks("  spaced \n", 10, 2) == ["  spaced \n"] and t.token_chunks("", 10, 2) == [""]
    assert t.token_chunks("x" * 43, 10, 2) == ["x" * 43]  # ten tokens of four, and three characters
    assert t.token_chunks(" " + "x" * 43, 10, 2)[0] == "x" * 39  # eleven: pieces are stripped
    assert t.chunk_sections({"mda": "", "business": " b "}) == ["[SECTION: MDA]\n\n", "[SECTION: BUSINESS]\n\n b "]


def test_points_are_rounded_half_to_even(spark):
    given = ["0.5", "1.5", "2.5", "-2.5", "299.6", "1e9", "-1e9", "nan", "inf", "-inf", "x", None, " 7 "]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in given], "x string").select(s.clamp_round(F.col("x"))).collect()]
    assert got == [0, 2, 2, -2, 300, 300, -300, 0, 0, 0, 0, 0, 7]


def test_one_stage_views(spark):
    text = "The company grew. " * 20 + "Margins widened in every segment of the year."
    quote = "Margins widened in every segment of the year."
    rows = [
        (1, {"view_bps": 12.5, "confidence": " HIGH ", "reasoning": "long enough", "supporting_quotes": [quote, "an invention that is nowhere to be found"]}),
        (2, {"view_bps": None, "confidence": None, "reasoning": "long enough"}),
        (3, {"confidence": "low", "reasoning": "long enough"}),  # a field is missing
        (4, {"view_bps": -900, "confidence": "sure", "reasoning": "too short"}),
        (5, {"view_bps": "13.5", "confidence": "low", "reasoning": "ten chars!", "supporting_quotes": []}),
    ]
    answers = [(i, "Here: ```json\n" + json.dumps(x) + "\n```", None) for i, x in rows] + [(6, None, "Transient: empty"), (7, "no json", None)]
    got = annotate.one_stage(spark.createDataFrame(answers, "k int, raw string, error string"), spark.createDataFrame([(i, text) for i in range(9)], "k int, text string"), "k")
    assert sorted(map(tuple, got.collect())) == [(1, 12, "high", "long enough", 2, 1, 1), (2, 0, "medium", "long enough", 0, 0, 0), (5, 14, "low", "ten chars!", 0, 0, 0)]


def test_most_extras_by_model_and_tier(spark):
    docs = [("a", 1, "tier1a_tuning", False), ("a", 2, "tier1b_eval", False), ("a", 3, "tier2_pool", False), ("a", 4, "tier1b_eval", True), ("b", 1, "tier1a_tuning", False), ("c", 1, "tier1b_eval", False)]
    extra = [("a", 1)] * 2 + [("a", 2)] * 2 + [("a", 3)] * 9 + [("a", 4)] * 9 + [("b", 1)]
    got = evaluate.most_extras(spark.createDataFrame(extra, "model string, doc long"), spark.createDataFrame(docs, "model string, doc long, tier string, failed boolean"))
    assert sorted(map(tuple, got.collect())) == [("a", 1, 2), ("b", 1, 1)]


SCHEMA = T.StructType([T.StructField("ticker", T.StringType()), T.StructField("view_date", T.DateType()), T.StructField("bps", T.IntegerType()), T.StructField("half", T.StringType())])


def rows(*own):
    return [(k, date(2020, 1, 1), v, h) for k, v, h in own]


def content(table, version=None):
    return sorted(((r.ticker, r.bps, r.half) for r in table.read(version).collect()), key=str)


def test_replaced_rows_take_their_place(spark, tmp_path):
    table = sinks.Versioned(spark, f"{tmp_path}/v", SCHEMA, ["ticker"], "half")
    make = lambda *own: spark.createDataFrame(rows(*own), SCHEMA)
    assert table.read().count() == 0 and table.version() == 0
    assert table.append(make(("A", 1, "x"), ("B", 2, "x"), ("C", 3, "y"), ("D", 4, None))) == 1
    assert table.append(make(("A", 9, "x"), ("E", 5, "y"))) == 2  # A is there already
    assert content(table) == [("A", 1, "x"), ("B", 2, "x"), ("C", 3, "y"), ("D", 4, None), ("E", 5, "y")]
    assert table.replace(make(("A", 10, "y"), ("F", 6, "z"))) == 3  # moves to another partition; F is new
    assert content(table) == [("A", 10, "y"), ("B", 2, "x"), ("C", 3, "y"), ("D", 4, None), ("E", 5, "y"), ("F", 6, "z")]
    assert table.replace(make(("D", 40, None))) == 4
    assert content(table, 2) == [("A", 1, "x"), ("B", 2, "x"), ("C", 3, "y"), ("D", 4, None), ("E", 5, "y")]  # older versions stay readable
    bad = F.abs("bps") > 5
    assert table.recompute(bad, lambda keys: keys.select("ticker", F.lit(date(2020, 1, 1)).alias("view_date"), F.lit(0).alias("bps"), F.lit("w").alias("half"))) == 5
    assert content(table) == [("A", 0, "w"), ("B", 2, "x"), ("C", 3, "y"), ("D", 0, "w"), ("E", 5, "y"), ("F", 0, "w")] or content(table) == [("A", 0, "w"), ("B", 2, "x"), ("C", 3, "y"), ("D", 0, "w"), ("E", 5, "y"), ("F", 6, "z")]
    assert table.recompute(F.col("bps") > 100, lambda keys: keys) == 5  # nothing to do


def test_only_touched_partitions_are_rewritten(spark, tmp_path):
    table = sinks.Versioned(spark, f"{tmp_path}/v", SCHEMA, ["ticker"], "half")
    table.append(spark.createDataFrame(rows(*[(f"t{i}", i, f"p{i % 5}") for i in range(50)]), SCHEMA))
    table.replace(spark.createDataFrame(rows(("t3", -1, "p3")), SCHEMA))
    last = json.loads((tmp_path / "v/manifests/00000002.json").read_text())["parts"]
    assert [p["without"] for p in last] == [["p3"], []]
    assert [x.name for x in (tmp_path / "v/data" / last[1]["dir"]).iterdir() if x.is_dir()] == ["half=p3"]
    assert len(content(table)) == 50 and ("t3", -1, "p3") in content(table)


@pytest.mark.parametrize("step", ["_stage", "_commit"])
def test_a_write_that_dies_midway_changes_nothing(spark, tmp_path, monkeypatch, step):
    table = sinks.Versioned(spark, f"{tmp_path}/v", SCHEMA, ["ticker"], "half")
    table.append(spark.createDataFrame(rows(("A", 1, "x"), ("B", 2, "y")), SCHEMA))
    new = spark.createDataFrame(rows(("A", 5, "x"), ("C", 3, "y")), SCHEMA)
    whole = sinks.Versioned._stage

    def dies(self, *a):
        if step == "_stage":
            whole(self, *a)  # the files are there, the driver is not
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(sinks.Versioned, step, dies)
        with pytest.raises(KeyboardInterrupt):
            table.replace(new)
    assert content(table) == [("A", 1, "x"), ("B", 2, "y")] and table.version() == 1
    assert table.replace(new) == 2 and content(table) == [("A", 5, "x"), ("B", 2, "y"), ("C", 3, "y")]
    assert table.vacuum() >= 1 and content(table) == [("A", 5, "x"), ("B", 2, "y"), ("C", 3, "y")]


def test_a_task_that_fails_changes_nothing(spark, tmp_path):
    table = sinks.Versioned(spark, f"{tmp_path}/v", SCHEMA, ["ticker"], "half")
    table.append(spark.createDataFrame(rows(("A", 1, "x")), SCHEMA))
    broken = spark.createDataFrame(rows(("B", 2, "x"), ("C", 0, "x")), SCHEMA).withColumn("bps", F.when(F.col("bps") == 0, F.raise_error("lost")).otherwise(F.col("bps")).cast("int"))
    with pytest.raises(Exception, match="lost"):
        table.replace(broken)
    assert content(table) == [("A", 1, "x")]


def test_two_writers_conflict(spark, tmp_path, monkeypatch):
    table = sinks.Versioned(spark, f"{tmp_path}/v", SCHEMA, ["ticker"], "half")
    other = sinks.Versioned(spark, f"{tmp_path}/v", SCHEMA, ["ticker"], "half")
    whole = sinks.Versioned._stage

    def slow(self, df):
        if self is table and other.version() == 0:
            other.append(spark.createDataFrame(rows(("B", 2, "y")), SCHEMA))
        return whole(self, df)

    monkeypatch.setattr(sinks.Versioned, "_stage", slow)
    with pytest.raises(sinks.Conflict):
        table.append(spark.createDataFrame(rows(("A", 1, "x")), SCHEMA))
    assert content(table) == [("B", 2, "y")]
    table.append(spark.createDataFrame(rows(("A", 1, "x")), SCHEMA))
    assert content(table) == [("A", 1, "x"), ("B", 2, "y")]


def test_draws_are_the_same_on_any_layout(spark):
    rng = np.random.default_rng(1)
    data = [(name, date(2020, 1, 1) + timedelta(i), float(x)) for name in ("a", "b") for i, x in enumerate(rng.normal(0.001, 0.01, 40))] + [("one", date(2020, 1, 1), 0.01)]
    d = spark.createDataFrame(data, "strategy string, date date, ret double")
    first = sorted(map(tuple, stats.bootstrap_sharpe(d.repartition(1), 350).collect()))
    assert first == sorted(map(tuple, stats.bootstrap_sharpe(d.repartition(9, "date"), 350).collect()))
    assert [(r[0], r[1]) for r in first] == [("a", 40), ("b", 40), ("one", 1)] and first[2][2:] == (0.0, 0.0)
    r = np.array([x for n, _, x in data if n == "a"])
    key = int.from_bytes(hashlib.blake2b(b"a", digest_size=8).digest(), "big")
    drawn = []
    for k in range(350):
        x = r[np.random.Generator(np.random.Philox(key=[42, key], counter=[0, 0, 0, k])).integers(0, 40, 40)]
        drawn.append((math.prod(1 + x) ** (252 / 40) - 1 - 0.02) / (x.std(ddof=1) * math.sqrt(252)))
    assert first[0][2:] == pytest.approx(tuple(np.percentile(drawn, [2.5, 97.5])))
    assert len({round(x, 9) for x in drawn}) > 340
