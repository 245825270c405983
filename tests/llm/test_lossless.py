"""Rows and links that must not be lost, and tables that must not stay."""

from __future__ import annotations

import os
import random
import subprocess
import sys

import corpus_pipeline
import pytest

from tests.llm.test_llm import DOC, brute, docs, prose
from tidemark.llm import common, decontamination, jaccard_join, warc
from tidemark.llm.registry import queries


def test_clean_judges_every_row_by_its_own_text(spark):
    rng = random.Random(1)
    item = prose(rng, 30, 5000, "b")
    leak, rows = prose(rng, 10) + " " + item, []
    rows += [(None, leak)] + [(None, prose(rng, 30)) for _ in range(20)] + [(5, leak), (5, prose(rng, 30)), (6, prose(rng, 30))]
    rows += [(7, None), (None, None), (8, ""), (9, leak), (9, leak)]
    d = spark.createDataFrame([(i, x, "en", "s", 1, 2) for i, x in rows], "doc_id long, text string, lang string, source string, item_id long, __text int".replace("__text", "at"))
    bench = spark.createDataFrame([(0, item), (None, item)], "item_id long, text string")
    got = decontamination.clean(d, bench)
    assert got.columns == d.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(((i, x) for i, x in rows if x != leak), key=str)


def test_clean_deals_out_a_text_that_many_share(spark, monkeypatch):
    monkeypatch.setattr(common, "SPREAD", 2)
    rng = random.Random(2)
    item, same = prose(rng, 30, 5000, "b"), prose(rng, 30)
    d = docs(spark, [*[item] * 300, *[same] * 300, *(prose(rng, 30) for _ in range(50))])
    got = {r.doc_id for r in decontamination.clean(d, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert got == set(range(300, 650))


def test_clean_equals_its_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    rng = random.Random(3)
    items = [prose(rng, 20, 5000, "b"), "three short words", ""]
    texts = [prose(rng, 40) + (" " + items[i % 3] if i % 4 == 0 else "") for i in range(60)] + [None, ""]
    d, bench = docs(spark, texts), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    con = duckdb.connect()
    con.register("documents", d.toPandas())
    con.register("benchmark", bench.toPandas())
    want = {r[0] for r in con.execute(decontamination.CLEAN).fetchall()}
    assert {r.doc_id for r in decontamination.clean(d, bench).collect()} == want and 0 < len(want) < len(texts)
    assert corpus_pipeline.STAGE_SQL == {"benchmark decontamination": decontamination.CLEAN}


@pytest.mark.parametrize("width", [1, 2])
def test_links_of_classes_whose_cut_keys_meet(spark, monkeypatch, width):
    """With keys of a byte or two nearly every pair of classes meets."""
    made = jaccard_join.Packing.__init__

    def short(self, *a):
        made(self, *a)
        self.key_bytes = width

    monkeypatch.setattr(jaccard_join.Packing, "__init__", short)
    rng = random.Random(4)
    texts = []
    for _ in range(250):
        w = prose(rng, 81, 3000).split()
        texts.append(" ".join(w))
        w[rng.randrange(81)] = "other"
        texts.append(" ".join(w))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs(spark, texts)).collect()}
    want = brute(texts, 3, 90)
    assert got == want and sum(c != i for i, (_, c) in got.items()) > 100


def files(folder):
    return sorted(os.path.join(a, f) for a, _, fs in os.walk(folder) for f in fs)


def test_only_results_stay_and_go_when_released(spark, tmp_path):
    """Every query's scratch tables are gone when it returns; its result goes with ``release``."""
    rng = random.Random(5)
    texts = [prose(rng, 60) for _ in range(40)]
    rows = [(i, texts[i % 40] + (" more" if i > 40 else ""), "en" if i % 2 else "fr", "s", 1) for i in range(60)]
    spark.createDataFrame(rows, DOC).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, int(i % 3 == 0)) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, texts[0])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, f"http://a{i}.net/x", f"<p>{x}</p>") for i, x in enumerate(texts)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([(i, [rng.random() for _ in range(8)], 1) for i in range(300)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    common.release()
    top = common.shared_dir(spark).removeprefix("file:").replace("//", "/")
    before = set(files(f"{top}/tidemark"))  # of other drivers
    for name, query in queries().items():
        out = query(spark, str(tmp_path))
        left = {os.path.relpath(f, f"{top}/tidemark").split("/")[0] for f in {*files(f"{top}/tidemark")} - before}
        assert len(left) <= 1, (name, left)  # the result, which is read from now on
        assert out.count() >= 0
        common.release()
        assert {*files(f"{top}/tidemark")} <= before, name


def test_archives_stay_where_they_are_asked_for(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/", "x"), (2, None, None)], "page_id long, url string, html string")
    assert warc.archived(pages, f"file://{tmp_path}/kept").count() == 2
    assert [f for f in files(tmp_path) if f.endswith(".warc.gz")]


def test_a_driver_that_ends_leaves_nothing(tmp_path):
    spark = f"SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').config('spark.checkpoint.dir', 'file://{tmp_path}/shared').getOrCreate()"
    code = f"from pyspark.sql import SparkSession\nfrom tidemark.llm.common import materialise\ns = {spark}\nassert materialise(s.range(3), 'x').count() == 3\ns.stop()"
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120, cwd=os.path.dirname(corpus_pipeline.__file__), capture_output=True)
    assert files(f"{tmp_path}/shared") == []
