"""Merkle manifest against a plain recursion, and its SQL."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest

from tidemark.llm import merkle as M
from tidemark.llm.common import Work
from tidemark.llm.registry import queries

DOC = "doc_id long, text string, lang string, source string, n_chars long, leaf string, tree int, at string"


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([M.sha(*out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
    return out


def siblings(tree, at):
    out = []
    for level in tree[:-1]:
        a = at - at % 8
        out.append(("".join(level[a:at]), "".join(level[at + 1 : a + 8])))
        at //= 8
    return out


def digest(row, text):
    doc_id, _, lang, source, n_chars = row
    enc = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    return M.sha(*map(enc, (doc_id, source, lang, n_chars, text)))


def expected(rows):
    langs = {}
    for r in rows:
        langs.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, digest(r, r[1]), r))
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: levels([y[2] for y in sorted(langs[x], key=lambda y: y[:3])]) for x in order}
    top = levels([trees[x][-1][0] for x in order])
    root, out = top[-1][0], []
    for place, x in enumerate(order):
        for at, (*_, leaf, r) in enumerate(sorted(langs[x], key=lambda y: y[:3])):
            path = siblings(trees[x], at) + siblings(top, place)
            node = leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[1] is not None:
                node = digest(r, "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1]))
            for a, b in path:
                node = M.sha(a, node, b)
            out.append((r[0], leaf, trees[x][-1][0], root, M.sha(*(a + b for a, b in path)), node, node == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("fan, tall", [(8, 1), (8, 2), (2, 1), (2, 2), (3, 3)])
def test_traversal_emits_every_path(fan, tall):
    for n in [*range(1, 40), 64, 65, 100]:
        leaves = [M.sha(str(i)) for i in range(n)]
        for height in {M.levels_of(n, fan), M.levels_of(n, fan) + 2}:
            tree = [leaves]
            for _ in range(height):
                tree.append([M.sha(*tree[-1][i : i + fan]) for i in range(0, len(tree[-1]), fan)])
            for at, (root, path) in enumerate(M.traverse(leaves, height, fan, tall)):
                assert root == tree[-1][0] and len(path) == height
                want, k = [], at
                for level in tree[:-1]:
                    a = k - k % fan
                    want.append(("".join(level[a:k]), "".join(level[k + 1 : a + fan])))
                    k //= fan
                assert path == want


def rows_of(n, langs, rng):
    return [(i, f"Text {rng.random()} É", rng.choice(langs), "s", i) for i in range(n)]


@pytest.mark.parametrize("case", ["one", "small", "large", "langs", "odd"])
def test_query_equals_recursion_and_sql(spark, tmp_path, case):
    rng = random.Random(3)
    rows = {
        "one": [(7, "Only", "en", "s", 4)],
        "small": rows_of(9, ["en"], rng),
        "large": rows_of(9000, ["en", "en", "en", "de", None], rng),
        "langs": [(i, "A b", f"l{i % 70}é", None, None) for i in range(400)],
        "odd": [(None, "A", None, None, None), (None, None, "", "s", 1), (None, "A", None, None, None), (3, "X", "en", "s", 1), (3, "X", "en", "s", 1), (3, "Y" * 100_000, "en", "s", 1), (4, "", "en", "", 0), (5, None, "ü", "s", -1)],
    }[case]
    d = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], DOC)
    d.repartition(5, "text").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries()["op11_merkle_manifest"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    want = expected(rows)
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert case != "large" or 0 < sum(not r[-1] for r in want) < len(want)
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(con.execute(M.ORACLE).fetchall(), key=str) == want


def test_empty_and_nothing_left_behind(spark, tmp_path):
    spark.createDataFrame([], DOC).write.parquet(f"{tmp_path}/documents.parquet")
    assert queries()["op11_merkle_manifest"](spark, str(tmp_path)).count() == 0
    assert M.sha() == hashlib.sha256(b"").hexdigest()


def test_paths_prove_membership(spark):
    leaves = spark.createDataFrame([(i, "en", M.sha(str(i))) for i in range(700)], "doc_id long, lang string, leaf string")
    with Work(spark) as work:
        got = M.proofs(work.save(leaves, "leaves"), work).withColumn("again", M.folded("leaf", "path")).collect()
    assert len(got) == 700 and all(r.again == r.root for r in got) and len({r.root for r in got}) == 1
