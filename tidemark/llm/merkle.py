"""Merkle manifest of a dataset, with an authentication path for every row.

``H`` is the lower-case hexadecimal SHA-256 of its inputs' bytes joined, digests as text. A row's leaf is H of its fields, each as byte
count, ``:`` and value, or ``-`` for null. The leaves of one language ascend by id; while a level has several nodes, each ``FAN``
consecutive ones (the last run: fewer, even one) become their H. The languages' last nodes, in order, give the root likewise.

Places come from a range sort that is written once: a part's counts, summed over the parts before, say where its rows begin, so no
language is one window. Each aligned block of ``FAN ** HEIGHT`` leaves is one fractal traversal, which emits the paths of its leaves one after the
other: for each layer of ``TALL`` levels it keeps the existing subtree, that of the present leaf, and the desired one to its
right, which takes one leaf a step, so that it is complete when it is entered. Memory is the leaves of a block and two subtrees of each layer. The blocks' last nodes then climb level by level over all
blocks (each a table an eighth as large), the paths descend the same tables and are appended to the rows' own.

A leaf is checked by folding: it stands between its siblings to the left and to the right, their H between the next ones, up to the root.

Cases: null ids come first, equal ids in the order of their leaves, and rows that are equal take places of their own; null texts, sources, languages
and counts are ``-``; null is a language of its own and comes first; a single row's leaf is its subroot, and a single language's subroot the root, with no siblings, so that
the proof is H of nothing; a null id is not tampered with; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import Work, materialise, table, widened
from tidemark.llm.sharding import _crc_table
from tidemark.llm.textbuf import trimmed

#: Children of a node; levels of a block; levels of a layer of its traversal.
FAN, HEIGHT, TALL = 8, 3, 1
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "path array<struct<left: string, right: string>>"
_PATH = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def sha(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(col: str | Column) -> Column:
    c = (F.col(col) if isinstance(col, str) else col).cast("string")
    return F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))


def leaf(text: str | Column = "text") -> Column:
    """The digest of a row's fields, with ``text`` in place of its own."""
    return F.sha2(F.concat(*[field(text if c == "text" else c) for c in COLUMNS]), 256)


def joined(digests: Column) -> Column:
    return F.array_join(digests, "")


class Subtree:
    """The nodes of ``tall`` levels, the lowest ``base`` levels above the leaves, filled leaf by leaf."""

    def __init__(self, base: int, tall: int, fan: int) -> None:
        self.base, self.tall, self.fan = base, tall, fan
        self.levels: list[list[str]] = [[] for _ in range(tall)]
        self.open: list[list[str]] = [[] for _ in range(base + tall)]
        self.root = ""

    def add(self, digest: str, level: int = 0) -> None:
        """Takes a node, and closes the run that it fills."""
        if level == self.base + self.tall:
            self.root = digest
            return
        if level >= self.base:
            self.levels[level - self.base].append(digest)
        run = self.open[level]
        run.append(digest)
        if len(run) == self.fan:
            self.open[level] = []
            self.add(sha(*run), level + 1)

    def close(self) -> None:
        """No leaf follows: runs that are not full become nodes as they are."""
        for level in range(self.base + self.tall):
            if run := self.open[level]:
                self.open[level] = []
                self.add(sha(*run), level + 1)

    def run(self, at: int, level: int) -> tuple[list[str], int]:
        """The run that holds the ancestor of leaf ``at`` on ``level``, and its place there."""
        place = at % self.fan ** (self.base + self.tall) // self.fan**level
        own = place % self.fan
        return self.levels[level - self.base][place - own : place - own + self.fan], own


def traverse(leaves: Sequence[str], height: int, fan: int = FAN, tall: int = TALL) -> Iterator[tuple[str, list[tuple[str, str]]]]:
    """For one leaf after the other the root and its path: level by level the joined siblings to the left and to the right."""
    n, layers = len(leaves), [(base, min(tall, height - base)) for base in range(0, height, tall)]
    exist, desire = [], []
    for base, levels in layers:
        first, size = Subtree(base, levels, fan), fan ** (base + levels)
        for digest in leaves[:size]:
            first.add(digest)
        if n <= size:
            first.close()
        exist.append(first)
        desire.append(Subtree(base, levels, fan))
    root = exist[-1].root if exist else leaves[0]
    for at in range(n):
        path = []
        for k, (base, levels) in enumerate(layers):
            size = fan ** (base + levels)
            if at and at % size == 0:  # the desired subtree is complete by now
                exist[k], desire[k] = desire[k], Subtree(base, levels, fan)
            if at + size < n:
                desire[k].add(leaves[at + size])
                if at + size == n - 1:
                    desire[k].close()
            for level in range(base, base + levels):
                run, own = exist[k].run(at, level)
                path.append(("".join(run[:own]), "".join(run[own + 1 :])))
        yield root, path


def levels_of(n: int, fan: int = FAN) -> int:
    """Levels below the last node of ``n`` leaves."""
    k = 0
    while n > 1:
        n, k = -(-n // fan), k + 1
    return k


def placed(rows: DataFrame, order: Sequence[str], work: Work, name: str) -> DataFrame:
    """``rows`` with ``at`` (from 0, by ``order`` within ``tree``) and ``n`` (rows of the tree). ``rows`` must come from a table: equal rows are told apart by where they stand in it."""
    low = (1 << 33) - 1  # a part's own count, in the ids that Spark gives
    spread = rows.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange("tree", *order, "__tie").sortWithinPartitions("tree", *order, "__tie").drop("__tie")
    spread = spread.withColumn("__id", F.monotonically_increasing_id())
    spread = work.save(spread.withColumns({"__part": F.shiftright("__id", 33), "__own": F.col("__id").bitwiseAND(F.lit(low))}).drop("__id"), name)
    counts = spread.groupBy("tree", "__part").agg(F.count(F.lit(1)).alias("__n"), F.min("__own").alias("__first"))
    tree = Window.partitionBy("tree")
    before = tree.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("tree", "__part", (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).alias("__start"), F.sum("__n").over(tree).alias("n"))
    starts = work.save(starts, f"{name}-starts")  # a row for each tree and part at most: Spark sees its size and broadcasts it where it is small
    return spread.join(starts, ["tree", "__part"]).withColumn("at", F.col("__start") + F.col("__own")).drop("__part", "__own", "__start")


def block_paths(rows: DataFrame, height: int = HEIGHT) -> DataFrame:
    """``rows`` (tree, at, n, leaf, more) with ``block``, ``node`` (the block's last node) and ``path`` from the leaf to it. A tree that fits into one block ends where one node is left."""
    size = FAN**height
    blocks = rows.withColumn("block", F.floor(F.col("at") / size)).repartition("tree", "block").sortWithinPartitions("tree", "block", "at")
    names = blocks.columns

    def emit(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        """One block, whose rows may come from several batches."""
        own = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        n = own.column("n")[0].as_py()
        found = list(traverse(own.column("leaf").to_pylist(), height if n > size else levels_of(n)))
        paths = [[{"left": a, "right": b} for a, b in path] for _, path in found]
        return pa.RecordBatch.from_arrays([*own.columns, pa.array([x for x, _ in found], pa.string()), pa.array(paths, _PATH)], names=[*names, "node", "path"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for batch in batches:
            keys = zip(batch.column("tree").to_pylist(), batch.column("block").to_pylist(), strict=True)
            at = 0
            for key, same in groupby(keys):
                if held and key != last:
                    yield emit(held)
                    held = []
                k = sum(1 for _ in same)
                held.append(batch.slice(at, k))
                last, at = key, at + k
        if held:
            yield emit(held)

    return blocks.mapInArrow(trimmed(run), widened(blocks, f"node string, {PATH}"))


def climb(nodes: DataFrame, work: Work, name: str) -> DataFrame:
    """tree, at, path, top of every node (tree, at, n, digest): its way to its tree's last node. A table each level, an eighth as large as the one below."""
    levels = [work.save(nodes.select("tree", "at", "n", "digest"), f"{name}-0")]
    while (levels[-1].agg(F.max("n")).first()[0] or 0) > 1:
        runs = levels[-1].where("n > 1").groupBy("tree", F.floor(F.col("at") / FAN).alias("at"), F.ceil(F.col("n") / FAN).alias("n"))
        runs = runs.agg(F.array_sort(F.collect_list(F.struct("at", "digest"))).alias("run"))  # ``FAN`` nodes at most
        up = runs.select("tree", "at", "n", F.sha2(joined(F.transform("run", lambda x: x["digest"])), 256).alias("digest"), "run")
        levels.append(work.save(up, f"{name}-{len(levels)}"))
    done = lambda level: level.where("n = 1").select("tree", "at", F.expr(f"cast(array() as {PATH.partition(' ')[2]})").alias("path"), F.col("digest").alias("top"))
    down = done(levels[-1])
    for level in range(len(levels) - 2, -1, -1):
        above = levels[level + 1].select("tree", "at", "run").join(down, ["tree", "at"]).select("tree", "run", "path", "top", F.explode("run").alias("own"))
        side = lambda keep: joined(F.transform(F.filter("run", keep), lambda x: x["digest"]))
        step = F.struct(side(lambda x: x["at"] < F.col("own.at")).alias("left"), side(lambda x: x["at"] > F.col("own.at")).alias("right"))
        down = above.select("tree", F.col("own.at").alias("at"), F.concat(F.array(step), F.col("path")).alias("path"), "top").unionByName(done(levels[level]))
        down = work.save(down, f"{name}-down-{level}")
    return down


def proofs(leaves: DataFrame, work: Work) -> DataFrame:
    """``leaves`` (doc_id, lang, leaf, more) with path (from the leaf to the root), subroot and root. Read from tables that ``work`` owns."""
    rows = leaves.withColumn("tree", F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")))  # null first, then by bytes
    paths = work.save(block_paths(placed(rows, ["doc_id", "leaf"], work, "leaves")), "paths")
    blocks = paths.where(F.col("at") % FAN**HEIGHT == 0).select("tree", F.col("block").alias("at"), F.ceil(F.col("n") / FAN**HEIGHT).alias("n"), F.col("node").alias("digest"))
    upper = climb(blocks, work, "blocks")
    subroots = work.save(upper.where("at = 0").select(F.lit("").alias("tree"), F.col("tree").alias("language"), F.col("top").alias("digest")), "subroots")
    subroots = work.save(placed(subroots, ["language"], work, "languages"), "languages-placed")
    last = subroots.join(climb(subroots, work, "root"), ["tree", "at"]).select(F.col("language").alias("tree"), F.col("path").alias("last"), F.col("top").alias("root"))
    upper = upper.join(last, "tree").select("tree", F.col("at").alias("block"), F.concat("path", "last").alias("upper"), F.col("top").alias("subroot"), "root")
    upper = work.save(upper, "upper")
    out = paths.join(upper, ["tree", "block"]).withColumn("path", F.concat("path", "upper"))
    return out.drop("tree", "block", "at", "n", "node", "upper")


def folded(leaf_: str | Column, path: str) -> Column:
    """The root that a leaf and its path give."""
    start = F.col(leaf_) if isinstance(leaf_, str) else leaf_
    return F.aggregate(path, start, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    upper = "".join(map(chr, range(65, 91)))
    tampered = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 3 == 0
    leaves = docs.select("doc_id", "lang", leaf().alias("leaf"), F.when(tampered, leaf(F.translate("text", upper, upper.lower()))).alias("given"))
    with Work(spark) as work:
        out = proofs(work.save(leaves, "given"), work)
        proof = F.sha2(joined(F.transform("path", lambda s: F.concat(s["left"], s["right"]))), 256)
        out = out.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), folded(F.coalesce("given", "leaf"), "path").alias("folded_root"))
        return materialise(out.withColumn("verified", F.col("folded_root") == F.col("root")), "merkle")


def _oracle(deep: int = 7, wide: int = 3) -> str:
    """The same by windows, level by level: languages of up to ``FAN ** deep`` rows, up to ``FAN ** wide`` languages."""
    size = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
    row = lambda text: f"sha256({' || '.join(size(text if c == 'text' else c) for c in COLUMNS)})"
    upper = "".join(map(chr, range(65, 91)))
    parts = [
        f"tab AS (SELECT {_crc_table()}::UBIGINT[] AS t)",
        "ids AS (SELECT *, xor(4294967295::UBIGINT, list_reduce(list_transform(regexp_extract_all(hex(encode(doc_id::VARCHAR)), '..'), lambda x: ('0x' || x)::UBIGINT), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255)::INT + 1]), 4294967295::UBIGINT)) AS crc FROM documents, tab)",
        f"lower AS (SELECT *, translate(text, '{upper}', '{upper.lower()}') AS low FROM ids)",
        f"d AS (SELECT doc_id, coalesce('=' || lang, '') AS tree, {row('text')} AS leaf, CASE WHEN crc % 3 = 0 THEN {row('low')} ELSE {row('text')} END AS given FROM lower)",
        "a0 AS (SELECT tree, doc_id, leaf, given, leaf AS digest, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM d)",
    ]

    def rise(name: str, levels: int) -> None:
        for k in range(levels):
            run = "PARTITION BY tree, pos // 8 ORDER BY pos"
            parts.append(f"{name}s{k} AS (SELECT tree, pos, n, coalesce(string_agg(digest, '') OVER ({run} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(digest, '') OVER ({run} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name}{k})")
            parts.append(f"{name}{k + 1} AS (SELECT tree, pos // 8 AS pos, (n + 7) // 8 AS n, CASE WHEN n > 1 THEN sha256(string_agg(digest, '' ORDER BY pos)) ELSE min(digest) END AS digest FROM {name}{k} GROUP BY tree, pos // 8, n)")

    def fold(source: str, name: str, levels: int, at: str, tree: str) -> str:
        for k in range(levels):
            parts.append(f"{name}f{k} AS (SELECT x.* EXCLUDE (fold, proof), CASE WHEN s.n > 1 THEN sha256(s.l || x.fold || s.r) ELSE x.fold END AS fold, x.proof || s.l || s.r AS proof FROM {source} x JOIN {name}s{k} s ON s.tree = {tree} AND s.pos = x.{at} // {8**k})")
            source = f"{name}f{k}"
        return source

    rise("a", deep)
    parts.append(f"b0 AS (SELECT '' AS tree, tree AS language, digest, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM a{deep})")
    rise("b", wide)
    parts.append("start AS (SELECT a0.tree, a0.pos, b0.pos AS place, doc_id, leaf, b0.digest AS subroot, given AS fold, '' AS proof FROM a0 JOIN b0 ON b0.language = a0.tree)")
    end = fold(fold("start", "a", deep, "pos", "x.tree"), "b", wide, "place", "''")
    return f"WITH {', '.join(parts)} SELECT doc_id, leaf, subroot, b{wide}.digest AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = b{wide}.digest AS verified FROM {end}, b{wide}"


ORACLE = _oracle()
