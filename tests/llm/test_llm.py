"""The training-data operators against brute force, exact round trips and planted cases."""

from __future__ import annotations

import base64
import collections
import hashlib
import io
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import bpe, decontamination, html_extraction, jaccard_join, language_id, multi_index, sharding, toxicity, url_filter, warc
from tidemark.llm.common import dealt_join, materialise, scratch
from tidemark.llm.graph import components

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, lang="en"):
    return spark.createDataFrame([(i, x, lang, "s", len(x or "")) for i, x in enumerate(texts)], DOC)


def prose(rng, n, vocab=400, tag="w"):
    return " ".join(f"{tag}{rng.randrange(vocab)}" for _ in range(n))


# --- sharding ---


def test_sharding_moves_rows_only_into_the_new_shard(spark):
    d = docs(spark, [None, "", "é" * 3, *["same"] * 3000]).unionByName(spark.createDataFrame([(None, "x", None, None, None)], DOC))
    got = sharding.shard_documents(d).collect()
    assert len(got) == 3004 and all(r.grown_shard in (r.shard, 40) for r in got)
    assert 20 < sum(r.grown_shard == 40 for r in got) < 160
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert set(by) == set(range(40)) and all(sorted(v) == list(range(len(v))) for v in by.values())
    one = {r.doc_id: r for r in got}
    assert one[0].size == 16 and one[2].size == 22 and one[2].text_crc32 == zlib.crc32("ééé".encode())
    assert sharding.shard_documents(d.limit(0)).count() == 0


def test_sharding_follows_weights_and_confines_changes(spark):
    a = sharding.Topology.regular(20, 5, 2)
    w = [1.0] * 20
    w[3] = 4.0
    b = sharding.Topology.regular(20, 5, 2, w)
    d = spark.range(4000).withColumn("k", F.col("id").cast("string"))
    r = sharding.locate(sharding.locate(d, F.col("k"), a, "x"), F.col("k"), b, "y").collect()
    moved = [(q.x, q.y) for q in r if q.x != q.y]
    assert all(y < 10 for _, y in moved)  # only into the region whose weight grew
    assert all(y == 3 for x, y in moved if x < 5)  # in its rack, only into the shard
    assert sum(q.y == 3 for q in r) == pytest.approx(4000 * 4 / 23, rel=0.25)


def test_sharding_equals_its_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    d = docs(spark, [f"text {i}" for i in range(500)])
    con = duckdb.connect()
    con.register("documents", d.toPandas())
    want = sorted(con.execute(sharding.ORACLE).fetchall())
    got = sorted((r.doc_id, r.size, r.text_crc32, r.law, r.shard, r.slot, r.grown_shard) for r in sharding.shard_documents(d).collect())
    assert got == want


# --- url filter ---


def test_url_filter(spark):
    urls = ["http://A.example.NET/en/1", "https://x.net", "https://x.net/", "http://notnet/a", "http://example.com/de/", "http://example.com/de", "http://q.org/fr/x?y#z", "http://q.org?a=/fr/", None, "", "no scheme", "http://net/", "ftp://u@h.net:80/p#q", "http:///x"]
    p = spark.createDataFrame([(i, u, "") for i, u in enumerate(urls)], "page_id long, url string, html string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(p).collect()}
    assert got[0] == ("a.example.net", "/en/1", "example.net/en/", "allow")
    assert got[1] == ("x.net", "", None, "allow") and got[2] == ("x.net", "/", "net/", "block")
    assert got[3] == ("notnet", "/a", None, "allow") and got[4][2:] == ("example.com/de/", "block") and got[5][2:] == (None, "allow")
    assert got[6] == ("q.org", "/fr/x", "org/fr/", "allow") and got[7] == ("q.org", "", None, "allow")
    assert got[8] == got[9] == got[10] == ("", "", None, "allow") and got[11][2] == "net/" and got[12] == ("u@h.net:80", "/p", None, "allow")
    assert url_filter.judge(p.limit(0)).count() == 0


def test_cascade_is_exact_on_its_universe(spark):
    every = [f"key{i}" for i in range(3000)]
    listed = set(every[::7])
    u = spark.createDataFrame([(k,) for k in every], "key string")
    c = url_filter.build(spark.createDataFrame([(k,) for k in sorted(listed)], "key string"), u)
    assert {r.key for r in u.where(c.listed(F.col("key"))).collect()} == listed and len(c.levels) > 1
    assert url_filter.build(u.limit(0), u).levels == ()


# --- decontamination ---


def test_decontamination_tolerates_substitutions(spark):
    rng = random.Random(1)
    items = [prose(rng, 40, 5000, "b"), prose(rng, 9, 5000, "c"), None, "", "few words"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    sub = items[0].split()
    for i in range(3, 40, 6):
        sub[i] = "changed"
    texts = [prose(rng, 300), prose(rng, 50) + " " + items[0].upper() + ". " + prose(rng, 50), prose(rng, 20) + " " + " ".join(sub), prose(rng, 30) + " " + items[1], " ".join(items[0].split()[:12]), None, "", " ".join(items[0].split()[8:])]
    got = {(r.doc_id, r.item_id): r for r in decontamination.contamination(docs(spark, texts), bench).collect()}
    assert set(got) == {(1, 0), (2, 0), (3, 1), (7, 0)}
    assert got[1, 0].share == 1.0 and got[1, 0]["at"] == 50 and got[2, 0].matched_words == 33 and got[7, 0]["at"] == -8
    assert decontamination.contamination(docs(spark, []), bench).count() == 0 and decontamination.contamination(docs(spark, texts), bench.limit(0)).count() == 0
    assert sorted(r.doc_id for r in decontamination.clean(docs(spark, texts), bench).collect()) == [0, 4, 5, 6]


def test_decontamination_by_shuffle_is_the_same(spark, monkeypatch):
    rng = random.Random(2)
    item = prose(rng, 30, 5000, "b")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    d = docs(spark, [prose(rng, 100), prose(rng, 30) + " " + item])
    want = decontamination.contamination(d, bench).collect()
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", 1)
    assert decontamination.contamination(d, bench).collect() == want and len(want) == 1


# --- Jaccard join ---


def brute(texts, n, num, den=100):
    sets = {}
    for i, x in enumerate(texts):
        w = [y for y in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), x or "")) if y]
        sets[i] = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in sets:
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return {i: (len(sets[i]), root(i)) for i in sets}


@pytest.mark.parametrize(("n", "num", "parts"), [(3, 90, 3), (5, 80, 2)])
def test_jaccard_components_equal_brute_force(spark, n, num, parts):
    rng = random.Random(n)
    texts = [None, "", "one", "one", "One two", "a b c", " a\tb\x0bc ", "x\0y z q", "x\0y z q"]
    for size in (8, 12, 20, 35, 60, 150):
        base = prose(rng, size).split()
        for _ in range(12):
            w = base.copy()
            for _ in range(rng.randrange(0, max(2, size // 12))):
                w[rng.randrange(len(w))] = f"n{rng.randrange(99)}"
            texts.append(" ".join(w))
        texts += [" ".join(base[: size - 1])] * 2
    common = prose(rng, 60)
    texts += [common + " " + prose(rng, 10, 9000, "u") for _ in range(25)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs(spark, texts), n, num, 100, parts).collect()}
    assert got == brute(texts, n, num)
    kept = {r.doc_id for r in jaccard_join.one_of_each(docs(spark, texts), n, num, 100, parts).collect()}
    assert kept == {i for i, (_, c) in brute(texts, n, num).items() if i == c}


def test_jaccard_blocks_and_empty(spark, monkeypatch):
    rng = random.Random(9)
    base = prose(rng, 80).split()
    texts = []
    for _ in range(60):
        w = base.copy()
        for _ in range(rng.randrange(1, 5)):
            w[rng.randrange(80)] = f"n{rng.randrange(999)}"
        texts.append(" ".join(w))
    monkeypatch.setattr(jaccard_join, "BLOCK", 7)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs(spark, texts)).collect()}
    assert got == brute(texts, 3, 90)
    assert jaccard_join.jaccard_components(docs(spark, [])).count() == 0


def test_jaccard_signatures_of_many_classes_are_dealt_out(spark, monkeypatch):
    rng = random.Random(12)
    base = prose(rng, 60).split()
    texts = [prose(rng, 40, 9000, "u") for _ in range(10)]
    for _ in range(50):
        w = base.copy()
        for _ in range(rng.randrange(0, 3)):
            w[rng.randrange(60)] = f"n{rng.randrange(999)}"
        texts.append(" ".join(w))
    texts.append(prose(rng, 30_000, 9000, "l"))
    texts.append(" ".join([*texts[-1].split()[:29_000], "changed"]))
    want = brute(texts, 5, 80)
    monkeypatch.setattr(jaccard_join, "MANY", 3)
    monkeypatch.setattr(jaccard_join, "PACK", 500)
    d = docs(spark, texts).repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(d, 5, 80).collect()}
    assert got == want and got[61][1] == 60


def test_one_of_each_judges_rows_by_their_texts(spark):
    rng = random.Random(13)
    a, b, c = (prose(rng, 50) for _ in range(3))
    near = " ".join([*a.split()[:-1], "changed"])
    rows = [(1, a, 7), (5, a, 7), (5, b, 7), (5, b, 7), (9, near, 7), (3, c, 7), (3, c.upper(), 7), (None, a, 7), (None, a, 7), (4, "", 7), (4, None, 7), (4, "", 7)]
    d = spark.createDataFrame(rows, "doc_id long, text string, digest long").withColumn("rep", F.lit("x"))
    got = sorted(map(tuple, jaccard_join.one_of_each(d).select("doc_id", "text").collect()), key=str)
    stays = [x for x in got if x[0] == 3]
    assert jaccard_join.one_of_each(d).columns == d.columns and len(stays) == 1 and stays[0][1].lower() == c
    assert [x for x in got if x[0] != 3] == sorted([(1, a), (5, b), (None, a), (None, a), (4, ""), (4, None), (4, "")], key=str)


def test_hot_keys_join_alike(spark):
    left = spark.createDataFrame([(1 if i % 3 else i, i) for i in range(4000)] + [(None, -1)], "k long, i long")
    right = spark.createDataFrame([(k, k * 2) for k in range(0, 4000, 2)] + [(1, 2)], "k long, v long")
    for how in ("inner", "left", "left_anti"):
        got = sorted(map(str, dealt_join(left, right, "k", how).collect()))
        assert got == sorted(map(str, left.join(right, "k", how).collect())) and got


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 140)] + [(7, 7), (999, 999)]
    up = {x: x for e in links for x in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        p, q = sorted((root(a), root(b)))
        up[q] = p
    got = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.node: r.comp for r in got} == {x: root(x) for x in up} and len(got) == len(up)


# --- nearest neighbours ---


def test_multi_index(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 8))
    x[100:140] = x[100]
    vec = [(i, [float(np.float32(v)) for v in r]) for i, r in enumerate(x)]
    vec += [(1000, None), (1001, [0.0] * 8), (1002, [float("nan")] + [1.0] * 7), (1003, [None] + [1.0] * 7), (1100, [float("inf")] * 8)]
    d = spark.createDataFrame(vec, "vec_id long, embedding array<float>")
    got = multi_index.search(d, d.where("vec_id % 100 = 0")).collect()
    m = np.array([v for _, v in vec[:300]])
    assert {r.query_id for r in got} == {0, 100, 200}
    for q in (0, 100, 200):
        dist = np.sqrt(np.square(m - m[q]).sum(1))
        want = [i for i in np.lexsort((np.arange(300), dist)) if i != q][:10]
        own = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [o[1] for o in own] == want and [o[2] for o in own] == [dist[i] for i in want]
    assert multi_index.search(d.limit(0), d).count() == 0


# --- WARC ---


def test_warc_round_trip(spark):
    rows = [(1, "http://a", "same"), (5, None, "same"), (3, "http://b\r\n", "same"), (7, "u", None), (8, "u", ""), (9, "u", "é" * 5000), (2, "http://a", "other")]
    p = spark.createDataFrame(rows, "page_id long, url string, html string")
    m = materialise(warc.write(p, scratch(spark, "warc")), "manifest")
    got = {r.page_id: tuple(r)[1:] for r in warc.contents(m).collect()}
    sha = lambda x: base64.b32encode(hashlib.sha1(x.encode()).digest()).decode()
    assert got[5] == (4, sha("same"), "response", None) and got[1] == (4, sha("same"), "revisit", 5) and got[3][2:] == ("revisit", 5)
    assert got[8] == (0, sha(""), "response", None) and got[7] == (0, sha(""), "revisit", 8) and got[9][:2] == (10000, sha("é" * 5000)) and got[2][2] == "response"
    assert warc.contents(materialise(warc.write(p.limit(0), scratch(spark, "warc")), "manifest")).count() == 0


def test_warc_reader_detects_damage():
    good = warc.record(1, "u", b"body", warc.digest(b"body"), None, False)
    assert [b for _, b in warc.read(io.BytesIO(good * 3))] == [b"body"] * 3
    with pytest.raises(warc.Damaged):
        list(warc.read(io.BytesIO(good + good[:-9])))
    with pytest.raises(warc.Damaged):
        list(warc.read(io.BytesIO(warc.record(1, "u", b"body", warc.digest(b"else"), None, False))))


# --- BPE ---


def test_bpe_equals_the_library(spark):
    tiktoken = pytest.importorskip("tiktoken")
    P = pytest.importorskip("public_tokenizers")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(1)
    letters = list(" \n\t'''srvtmdle  abZé1²٣!?-— 　\x1c\x85中😀")
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 50))) for _ in range(1500)] + ["a" * 5000, "'ll've're'x", " " * 400, "", "<|endoftext|>"]
    own = bpe.codec(bpe.vocabulary())
    for x in texts:
        ids = own.encode(x)
        assert ids == enc.encode_ordinary(x) and own.decode(ids) == x.encode()
    spans = own.offsets(own.encode("Hello wörld"))
    assert spans[0][0] == 0 and spans[-1][1] == len("Hello wörld".encode())
    d = docs(spark, [None, *texts])
    for r in bpe.encoded(d.select("doc_id", "text"), digests=True).collect():
        ids = enc.encode_ordinary(r.text or "")
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest() and r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    assert bpe.encoded(d.limit(0)).count() == 0 and bpe.encoded(d.where("doc_id = 0")).first().ids == []


def test_scan_of_composed_functions_equals_a_loop():
    rng = np.random.default_rng(2)
    for n in (0, 1, 5, 63, 64, 65, 1000):
        cls = rng.integers(0, 11, n).astype(np.uint8)
        s, want = bpe.NONE, []
        for c in cls:
            s = int(bpe.F_[c, s])
            want.append(s)
        assert bpe.states(cls, 8).tolist() == want
        assert bpe.states(np.full(n, bpe.QUOTE, np.uint8), 1).tolist() == [bpe.APOS if i % 2 == 0 and i == 0 else bpe.S_OTHER for i in range(n)]


# --- classifiers ---


def test_toxicity_learns_and_survives_odd_rows(spark):
    rng = random.Random(5)
    texts, y = [None, "", "!!!"], [0, 0, 0]
    for i in range(400):
        bad = i % 4 == 0
        w = prose(rng, 60).split()
        for _ in range(3 * bad):
            w[rng.randrange(60)] = rng.choice(["vile", "awful", "nasty"])
        texts.append(" ".join(w))
        y.append(int(bad))
    d = docs(spark, texts)
    lab = spark.createDataFrame([(i, 1, v) for i, v in enumerate(y)] + [(5, 1, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.score for r in toxicity.scored(d.select("doc_id", "text"), toxicity.train(d, lab)).collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i] >= 0.5) == bool(y[i]) for i in held]) > 0.9 and all(0 <= v <= 1 for v in got.values())
    assert set(toxicity.reject(d.withColumn("score", F.lit("x")), lab).columns) == {*d.columns, "score"}
    assert toxicity.scored(d.select("doc_id", "text"), toxicity.train(d, lab.limit(0))).where("score >= 0.5").count() == 0
    assert toxicity.scored(d.limit(0).select("doc_id", "text"), [(-1, 0.0)]).count() == 0


def test_language_id(spark):
    rng = random.Random(6)
    kinds = {"aa": "abcde", "bb": "defgh", "cç": "çéèàb"}
    rows = [(i, " ".join("".join(rng.choice(a) for _ in range(rng.randint(2, 7))) for _ in range(40)).title(), k, "s", 0) for i, (k, a) in enumerate(list(kinds.items()) * 60)]
    odd = [(1000, None, "aa", "s", 0), (1001, "", "aa", "s", 0), (1002, "123 !!", "bb", "s", 0), (1003, "abc cab bead", None, "s", 0)]
    d = spark.createDataFrame(rows + odd, DOC)
    got = {r.doc_id: r for r in language_id.identified(d.select("doc_id", "text"), language_id.train(d)).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert np.mean([got[r[0]].lang_pred == r[2] for r in held]) > 0.95
    assert all(got[i].lang_pred == "und" for i in (1000, 1001, 1002)) and got[1003].lang_pred in kinds and all(0 <= r.score <= 1 for r in got.values())
    assert language_id.accept(d).columns == d.columns
    assert language_id.identified(d.select("doc_id", "text"), language_id.train(d.limit(0))).where("lang_pred <> 'und'").count() == 0


# --- HTML ---


def test_html_extraction():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header class="site"><h1>Site</h1><nav><a href=x>Home</a></nav></header>
<div class="cookie-notice">We use cookies.</div><div id="content"><h1>Title &amp; more</h1><p>First   para, with <a href=y>a link</a> and text.<p>Second.<div class="advert">Buy now</div>
<ul><li>point one is here<li>point two</ul><script>if(a<b)document.write("<p>x</p>")</script><form><label>Name</label><input></form></div><aside>Related stories</aside>
<section class="comments"><article><p>User: a long and well written comment, indeed.</p></article></section><!-- <p>not</p> --><footer>&copy; 2024</footer>"""
    assert html_extraction.extract(page) == "Title & more\n\nFirst para, with a link and text.\n\nSecond.\n\npoint one is here\n\npoint two"
    assert html_extraction.extract(None) == html_extraction.extract("") == html_extraction.extract("<script>x") == ""
    assert html_extraction.extract("Only words, without any tags at all, make one block.") == "Only words, without any tags at all, make one block."


def test_min_cut_is_the_least_labelling():
    rng = random.Random(8)
    for _ in range(60):
        n = rng.randint(1, 7)
        gain = [rng.uniform(-3, 3) for _ in range(n)]
        e = [(a, b, rng.uniform(0, 2)) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.5]
        cost = lambda lab: sum(abs(g) for g, x in zip(gain, lab) if (g > 0) != x) + sum(w for a, b, w in e if lab[a] != lab[b])  # noqa: B023, E731
        best = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert cost(html_extraction.min_cut(gain, e)) == pytest.approx(best)


def test_html_query_on_odd_tables(spark):
    p = spark.createDataFrame([(1, None, None), (2, "u", "<article><p>Hello there, dear reader.</p></article><nav>Menu</nav>"), (2, "u", "")], "page_id long, url string, html string")
    w = html_extraction.train(p)
    got = sorted((r.page_id, r.text, r.n_chars) for r in html_extraction.extracted(p.withColumn("text", F.lit("clash")), w).collect())
    assert got == [(1, "", 0), (2, "", 0), (2, "Hello there, dear reader.", 25)]
    assert html_extraction.extracted(p.limit(0), html_extraction.train(p.limit(0))).count() == 0


PROSE = "<p>Ordinary prose that goes on for a while, with commas and all.</p><p>A second paragraph of the same kind, which says little.</p>"
TEXT = "Ordinary prose that goes on for a while, with commas and all.\n\nA second paragraph of the same kind, which says little."


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f'<div class="content has-sidebar">{PROSE}</div>', TEXT),
        (f'<article class="post tags-news"><h1 class="header">A title</h1>{PROSE}</article>', "A title\n\n" + TEXT),
        (f'<div class="article-body ad-free">{PROSE}</div>', TEXT),
        (f'<form id=aspnet><div class=menu><a>x</a></div><div id=main>{PROSE}</div><div class="sidebar">Some links</div></form>', TEXT),
        (f'<div id=wrap class="sidebar"><h2>My post</h2>{PROSE}<div class="comments"><p>User: I like this text very much, it is long, well done.</p></div></div>', "My post\n\n" + TEXT),
        (f'<main>{PROSE}<p class="alert">It may be out of date, as it was written some years ago.</p></main><div class="related-posts"><p>Another story, which is teased here at some length, is this.</p></div>', TEXT + "\n\nIt may be out of date, as it was written some years ago."),
        (f'<table><tr><td><a href=a>One</a><a href=b>Two</a></td><td><h1>Old</h1>{PROSE}</td></tr></table><div id="footer">Made by hand.</div>', "Old\n\n" + TEXT),
        ("<article><p>The formula <math><mi>x</mi><mo>=</mo><mn>1</mn></math> is short, and it is part of the text.</p></article>", "The formula x=1 is short, and it is part of the text."),
    ],
)
def test_html_of_other_templates(page, want):
    whole = f"<html><body><nav><a href=/>Home</a> <a href=/about>About us</a></nav>{page}<footer>© 2024 Some site</footer></body></html>"
    assert html_extraction.extract(whole) == want


def test_html_cut_is_near_linear_and_training_is_bounded(spark):
    import time

    rng = random.Random(3)
    page = "".join(f"<div>{'word ' * rng.randrange(1, 12)}.</div><div><a href=x>{'link ' * rng.randrange(1, 5)}</a></div>" for _ in range(10_000))
    began = time.perf_counter()
    html_extraction.extract(page)
    assert time.perf_counter() - began < 15
    p = spark.createDataFrame([(7, "u", f"<article><p>Text number {i}, of some length.</p></article><nav>Menu {i}</nav>") for i in range(300)], "page_id long, url string, html string")
    assert len(html_extraction.train(p, sample=20).weights) == html_extraction.N_FEATURES


def test_multi_index_recall_on_part_of_the_rows(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(200, 16))
    x = (centres[rng.integers(0, 200, 20_000)] + 0.5 * rng.normal(size=(20_000, 16))).astype(np.float32).astype(float)
    d = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    got = {}
    for r in multi_index.search(d, d.where("vec_id % 200 = 0")).collect():
        got.setdefault(r.query_id, {})[r.vec_id] = r.score
    hits = 0
    for q in range(0, 20_000, 200):
        dist = np.sqrt(np.square(x - x[q]).sum(1))
        near = [i for i in np.lexsort((np.arange(len(x)), dist)) if i != q][:10]
        assert len(got[q]) == 10 and all(got[q][v] == dist[v] for v in got[q])
        hits += len(set(near) & set(got[q]))
    assert hits / 1000 >= 0.9


def test_multi_index_stops_before_all_cells():
    rng = np.random.default_rng(4)
    da, db, sizes = rng.random(40), rng.random(30), rng.integers(0, 5, 1200)
    total = (da[:, None] + db[None, :]).ravel()
    rows = multi_index.by_first(sizes, 30)
    for want in (1, 50, 700, int(sizes.sum())):
        far = multi_index.walk(da, db, rows, want)
        assert sizes[total <= far].sum() >= want and sizes[total < far].sum() < want
    assert multi_index.walk(da, db, rows, 10**9) == total[sizes > 0].max()


def test_multi_index_repeated_ids_and_pieces(spark, monkeypatch):
    monkeypatch.setattr(multi_index, "PIECE", 16)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 6))
    rows = [(i, r.tolist()) for i, r in enumerate(x)] + [(0, x[0].tolist()), (0, x[7].tolist()), (5, x[9].tolist())] + [(1000 + i, x[50].tolist()) for i in range(200)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = multi_index.search(d, d.where("vec_id in (0, 60)")).collect()
    assert len(got) == 30 and sorted(r.rank for r in got if r.query_id == 60) == list(range(1, 11))
    mine = np.sqrt(np.square(x - x[60]).sum(1))
    every = sorted([(float(np.sqrt(np.square(np.array(v) - x[60]).sum())), i) for i, v in rows if i != 60])[:10]
    assert [(r.score, r.vec_id) for r in sorted((r for r in got if r.query_id == 60), key=lambda r: r.rank)] == every and len(mine) == 400
