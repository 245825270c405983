"""Null ids, repeated rows, ties, long texts, clashing columns; plain versions of the learners."""

from __future__ import annotations

import math
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.test_llm import DOC, docs, prose
from tidemark.llm import bpe, common, decontamination, language_id, multi_index, sharding, toxicity, url_filter, warc
from tidemark.llm.textbuf import Words, pieces, utf8


def test_shared_folder_is_asked_for_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()

    with pytest.raises(ValueError):
        common.shared_dir(Session())


def test_scratch_tables_go(spark):
    import os

    with common.Work(spark) as work:
        work.save(spark.range(5), "x")
        path = work.paths["x"].removeprefix("file://")
        assert os.path.exists(path)
        work.save(spark.range(6), "x")
        assert not os.path.exists(path)
        path = work.paths["x"].removeprefix("file://")
    assert not os.path.exists(path)


# --- toxicity ---


def plain_ftrl(rows, epochs, alpha, l1):
    """One coordinate at a time, in dictionaries."""
    z, n = {}, {}

    def weight(i):
        pen = 0.0 if i == "bias" else l1
        zi = z.get(i, 0.0)
        return 0.0 if abs(zi) <= pen else (math.copysign(pen, zi) - zi) / ((toxicity.BETA + math.sqrt(n.get(i, 0.0))) / alpha + toxicity.L2)

    for _ in range(epochs):
        for x, y in rows:
            x = {**x, "bias": 1.0}
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in x.items())))
            for i, v in x.items():
                g = (p - y) * v
                sigma = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / alpha
                z[i] = z.get(i, 0.0) + g - sigma * w[i]
                n[i] = n.get(i, 0.0) + g * g
    return {i: weight(i) for i in z}


def test_ftrl_equals_a_plain_loop():
    rng = random.Random(1)
    rows = [({rng.randrange(50): float(rng.randrange(1, 4)) for _ in range(6)}, rng.randrange(2)) for _ in range(120)]
    arrays = [(np.array(list(x), np.int64), np.array(list(x.values())), y) for x, y in rows]
    bias, idx, w = toxicity.ftrl(arrays, 3, 0.4, 0.7)
    want = plain_ftrl(rows, 3, 0.4, 0.7)
    assert bias == pytest.approx(want.pop("bias")) and dict(zip(idx.tolist(), w)) == pytest.approx({i: v for i, v in want.items() if v})


def test_toxicity_odd_rows(spark):
    rng = random.Random(2)
    long_ = prose(rng, 30_000) + " vile" * 40
    rows = [(None, "vile words", "x"), (1, "vile words", "x"), (1, "vile words", "x"), (1, "other", "x"), (2, "", "x"), (3, None, "x"), (4, long_, "x"), (5, "a b", "x")]
    d = spark.createDataFrame(rows, "doc_id long, text string, score string").withColumn("extra", F.lit(1))
    lab = spark.createDataFrame([(1, 1, 1), (1, 1, 0), (None, 1, 1), (4, 0, None), (2, 1, 0)], "doc_id long, quality int, toxic int")
    got = toxicity.scored(d, toxicity.train(d, lab))
    assert got.columns == ["doc_id", "text", "extra", "score"]
    s = [r.score for r in got.orderBy(F.col("doc_id").asc_nulls_first(), "text").collect()]
    assert len(s) == 8 and all(0 <= x <= 1 for x in s)
    by = {(r.doc_id, r.text): r.score for r in got.collect()}
    assert by[None, "vile words"] == by[1, "vile words"] and by[2, ""] == by[3, None]
    # a score of exactly one half is predicted 1, and rejected
    half = [(-1, 0.0)]
    assert {r.score for r in toxicity.scored(d, half).collect()} == {0.5}
    one = spark.createDataFrame([(None, "x", "y")], "doc_id long, text string, score string")
    assert toxicity.reject(one, lab.limit(0)).columns == one.columns


def test_training_is_bounded_by_ids(spark):
    d = spark.createDataFrame([(7, f"text {i}") for i in range(500)] + [(i, "calm words") for i in range(8, 40)], "doc_id long, text string")
    lab = spark.createDataFrame([(i, 1, int(i == 7)) for i in range(7, 40)], "doc_id long, quality int, toxic int")
    first, second = (toxicity.train(x, lab, 30) for x in (d, d.repartition(7)))
    assert first == second


# --- language ---


def test_letters_of_all_planes(spark):
    rare = ["\U00030000\U00030001", "\U0002fffd", "� 12", "ǆ", "", None, "!!"]
    texts = [prose(random.Random(i), 30, 200, "en") for i in range(60)] + [prose(random.Random(i), 30, 200, "ö") for i in range(60)]
    rows = [(i, x, "en" if i < 60 else "de", "s", 0) for i, x in enumerate(texts)]
    rows += [(1000 + i, "žluťoučký kůň úpěl ďábelské ódy " * 3, "cs", "s", 0) for i in range(8)]
    model = language_id.train(spark.createDataFrame(rows, DOC), sample=40)
    assert set(model.langs) == {"en", "de", "cs"}
    assert sum(map(len, model.live)) < 3 * (1 << language_id.BITS) // 4  # what is sent is sparse
    d = spark.createDataFrame([(i, x) for i, x in enumerate(rare)] + [(50, "žluťoučký kůň"), (None, "žluťoučký kůň"), (50, "žluťoučký kůň")], "doc_id long, text string").withColumn("score", F.lit("x")).withColumn("lang_pred", F.lit(1))
    got = language_id.identified(d, model).collect()
    by = {(r.doc_id, r.text): r.lang_pred for r in got}
    assert by[0, rare[0]] != "und" and by[3, "ǆ"] != "und"
    assert [by[i, rare[i]] for i in (1, 2, 4, 5, 6)] == ["und"] * 5 and all(r.score == 0 for r in got if r.lang_pred == "und")
    assert {r.lang_pred for r in got if r.text == "žluťoučký kůň"} == {"cs"} and len(got) == 10


def test_language_ties_and_long_texts(spark):
    w = np.zeros((1 << language_id.BITS, 2))
    m = language_id.Model(["aa", "bb"], w, np.zeros(2), 1.0)
    d = spark.createDataFrame([(1, "x"), (2, "word " * 60_000)], "doc_id long, text string")
    assert {(r.lang_pred, r.score) for r in language_id.identified(d, m).collect()} == {("aa", 0.5)}


def test_language_features_by_a_plain_loop():
    text = "Ab, c9é"
    data, off = utf8(pa.array([text], pa.string()))
    by, at, letter = language_id.grams(data, off, 0, 1)
    assert [len(g) for g in by] == [7, 6, 5] and at.tolist() == [0, 7] and letter.tolist() == [c.isalpha() for c in text]
    same = language_id.grams(*utf8(pa.array([text.upper().replace("9", "#")], pa.string())), 0, 1)[0]
    assert all((a == b).all() for a, b in zip(by, same, strict=True))  # case and kinds of non-letters do not count


# --- decontamination ---


def test_decontamination_of_long_texts_and_clashing_columns(spark):
    rng = random.Random(9)
    item = prose(rng, 25, 5000, "b")
    long_ = prose(rng, 25_000, 9000) + " " + item + " " + prose(rng, 25_000, 9000)
    d = docs(spark, [long_, item, prose(rng, 30)]).withColumn("toks", F.lit(1)).withColumn("seed", F.lit(2)).withColumn("item", F.lit(3))
    bench = spark.createDataFrame([(1, item, 5), (1, item, 6)], "item_id long, text string, j int")
    got = {r.doc_id: (r.matched_words, r["at"]) for r in decontamination.contamination(d, bench).collect()}
    assert got == {0: (25, 25_000), 1: (25, 0)}
    assert [r.doc_id for r in decontamination.clean(d, bench).collect()] == [2]


def test_decontamination_equals_its_sql(spark, tmp_path):
    rng = random.Random(10)
    items = [prose(rng, n, 900, "b") for n in (1, 5, 8, 12, 20, 40)]
    texts = [None, ""]
    for x in items * 6:
        w = x.split()
        for _ in range(rng.randrange(0, 1 + len(w) // 3)):
            w[rng.randrange(len(w))] = f"s{rng.randrange(99)}"
        texts.append(prose(rng, 12) + " " + " ".join(w) + " " + prose(rng, 5))
    d, b = docs(spark, texts), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    con = duckdb.connect()
    for name, df in (("documents", d), ("benchmark", b)):
        df.write.parquet(f"{tmp_path}/{name}")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}/*.parquet')")
    want = con.execute(decontamination.ORACLE).fetchall()
    got = [tuple(r) for r in decontamination.contamination(d, b).select("doc_id", "item_id", "item_words", "matched_words", "share", "at", "overlap").collect()]
    assert sorted(got) == sorted(want) and len(got) > 20


# --- sharding, WARC, URL filter, BPE, vectors ---


def test_sharding_and_warc_equal_their_sql(spark, tmp_path):
    d = docs(spark, [None, "", "a", "a", "é" * 50, "text " * 300, *[f"t{i}" for i in range(60)]])
    pages = spark.createDataFrame([(1, "u", "x"), (2, "u", "x"), (3, None, None), (4, "u", ""), (5, "v", "é")], "page_id long, url string, html string")
    con = duckdb.connect()
    for name, df in (("documents", d), ("pages", pages)):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    cols = ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    assert sorted(tuple(r) for r in sharding.op6_sharding(spark, str(tmp_path)).select(*cols).collect()) == sorted(con.execute(f"SELECT {', '.join(cols)} FROM ({sharding.ORACLE})").fetchall())
    cols = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted((tuple(r) for r in warc.op7_warc(spark, str(tmp_path)).select(*cols).collect()), key=str) == sorted(con.execute(f"SELECT {', '.join(cols)} FROM ({warc.ORACLE})").fetchall(), key=str)


def test_sharding_of_repeated_ids_and_rows(spark):
    rows = [(7, "same")] * 300 + [(7, f"text {i}") for i in range(300)] + [(None, "x")] * 3 + [(None, None)] * 2
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit("clash")).withColumn("size", F.lit("clash"))
    got = sharding.shard_documents(d).collect()
    assert len(got) == len(rows) and len({r.shard for r in got if r.doc_id == 7}) == 1 and len({r.shard for r in got if r.doc_id is None}) == 1
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def test_revisits_are_held_against_their_responses(spark):
    kinds = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    good = [(1, 4, "A", "response", None), (2, 4, "A", "revisit", 1), (None, 0, "E", "response", None), (None, 0, "E", "revisit", None)]
    assert warc.verified(spark.createDataFrame(good, kinds)).count() == 4
    for bad in ((3, 4, "B", "revisit", 1), (3, 5, "A", "revisit", 1), (3, 4, "A", "revisit", 9)):
        with pytest.raises(warc.Damaged):
            warc.verified(spark.createDataFrame([*good, bad], kinds))


def test_warc_of_repeated_rows_after_a_shuffle(spark):
    rows = [(1, "u", "same")] * 5 + [(1, "v", "same"), (0, "u", "same"), (None, None, "z"), (None, None, "z"), (2, "w", "long " * 50_000)]
    p = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1)).withColumn("key", F.lit(2)).repartition(3)
    m = common.materialise(warc.write(p, common.scratch(spark, "warc")), "manifest")
    got = warc.verified(common.materialise(warc.contents(m), "records")).collect()
    assert len(got) == len(rows) and sum(r.record_type == "response" for r in got) == 3
    assert {r.refers_to for r in got if r.record_type == "revisit" and r.payload_bytes == 4} == {1}


def test_url_filter_of_repeated_and_clashing_rows(spark):
    p = spark.createDataFrame([(1, "http://a.net/x"), (1, "http://a.net/x"), (None, "http://a.net/x"), (2, None)], "page_id long, url string").withColumn("html", F.lit("")).withColumn("host", F.lit("clash"))
    assert sorted((str(r.page_id), r.verdict) for r in url_filter.judge(p).collect()) == [("1", "block"), ("1", "block"), ("2", "allow"), ("None", "block")]


def test_bpe_with_clashing_columns(spark):
    d = spark.createDataFrame([(1, "Hello wörld", "x")], "doc_id long, text string, ids string").withColumn("n_tokens", F.lit("y"))
    got = bpe.encoded(d)
    assert got.columns.count("ids") == 1 and bpe.codec(bpe.vocabulary()).decode(got.first().ids) == "Hello wörld".encode()
    assert bpe.encoded(d, digests=True).columns.count("n_tokens") == 1


def test_words_are_the_same_in_any_piece():
    rng = random.Random(3)
    texts = [prose(rng, rng.randrange(50)) for _ in range(40)] + ["x" * 400_000]
    data, off = utf8(pa.array(texts, pa.string()))
    kind = toxicity.KINDS
    whole = [Words(data, off, i, i + 1, kind).hash.tolist() for i in range(len(texts))]
    for a, b in pieces(off, 700):
        w = Words(data, off, a, b, kind)
        for i in range(b - a):
            assert w.hash[w.first[i] : w.first[i + 1]].tolist() == whole[a + i]


def test_multi_index_with_clashing_columns_and_ties(spark):
    rows = [(i, [float(i % 3), 1.0]) for i in range(9)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("v", F.lit(1)).withColumn("cell", F.lit(2))
    got = sorted((r.rank, r.vec_id, r.score) for r in multi_index.search(d, d.where("vec_id = 0")).collect())
    assert got == [(1, 3, 0.0), (2, 6, 0.0), (3, 1, 1.0), (4, 4, 1.0), (5, 7, 1.0), (6, 2, 2.0), (7, 5, 2.0), (8, 8, 2.0)]



def test_bytes_that_are_no_utf8_are_read_as_a_replacement(spark):
    d = spark.createDataFrame([(1, bytearray(b"\xffA")), (2, bytearray("déjà vu".encode())), (3, None), (4, bytearray(b"ok \xc3"))], "doc_id long, raw binary").selectExpr("doc_id", "cast(raw as string) as text")
    got = {r.doc_id: r.ids for r in bpe.encoded(d).collect()}
    codec = bpe.codec(bpe.vocabulary())
    assert {i: codec.decode(x).decode() for i, x in got.items()} == {1: "\ufffdA", 2: "déjà vu", 3: "", 4: "ok \ufffd"}
    assert got == {i: codec.encode(x) for i, x in {1: "\ufffdA", 2: "déjà vu", 3: "", 4: "ok \ufffd"}.items()}
