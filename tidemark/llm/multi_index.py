"""Approximate nearest neighbours by an inverted multi-index.

Vectors are cut into two halves and each half is quantised by its own codebook (k-means on a bounded sample), so a row
belongs to one of ``k * k`` cells. For a query the two lists of centroids are ordered by distance, and a heap walks the
pairs by the sum of both distances, nearest first, until the cells passed hold enough rows (the cells' sizes
are known). The rows of those cells are reranked by their exact distance in double precision.
How many are enough is measured, not set: ``PROBES`` vectors are searched by brute force in one scan, and the walk goes on until its cells hold as many rows as
it takes to reach the share ``REACH`` of their true neighbours.

Every valid row is indexed; equal vectors are one entry that carries its ``top + 1`` smallest ids, as later ones can
never be among the ``top`` nearest: a vector that a third of all rows repeat costs one entry. The codebooks are fitted
on ``SAMPLE`` rows at most, those that hash lowest; codebooks and cell sizes (``k * k`` numbers) are all that
the driver holds of the index. Entries lie in pieces of neighbouring cells; a query goes once to each piece that has a cell it passes, with the sum
of distances at which its walk ended, from which the task knows the cells. Only (query, id, distance) of each piece's best ``top`` goes on.

Cases: null vectors, zero vectors and those with null or non-finite components take no part, as queries or rows; vectors
of another length than most of the sample take no part either; an id repeated with another vector is an entry, and a query, of its own, and
equal rows count once; ties go to the smaller id; where fewer candidates are passed than asked for, the walk goes on until cells run out; tables of any size are
searched alike; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import Work, materialise, table
from tidemark.llm.textbuf import trimmed

#: Vectors that the codebooks are fitted on, most centroids of a half, rounds of fitting.
SAMPLE, CENTROIDS, ROUNDS = 20_000, 1024, 8
TOP = 10
#: Share of the true neighbours of ``PROBES`` vectors that must lie in the cells passed by a query. They hold ``FLOOR`` times as many rows as are asked for at least.
REACH, PROBES, FLOOR = 0.97, 100, 10
#: Entries of a piece, and queries of a group: what one task holds of either, about; entries times queries that are compared at a time.
PIECE, GROUP, AT_ONCE = 4096, 2048, 1 << 21
#: Queries that a task walks for, about, and tasks at most.
WALKS, TASKS = 32, 10_000


def valid(df: DataFrame) -> DataFrame:
    """vec_id, v (array of double) of the vectors that take part."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    ok = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return df.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("v is not null and vec_id is not null").where(ok)


def kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Lloyd's rounds from distinct rows in a fixed random order; empty centroids stay."""
    x = np.unique(x, axis=0)
    rng = np.random.default_rng(7)
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        at = nearest(x, c)
        n = np.bincount(at, minlength=len(c))
        sums = np.stack([np.bincount(at, column, minlength=len(c)) for column in x.T], 1) if x.shape[1] else np.zeros_like(c)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x), np.int64)
    for i in range(0, len(x), 4096):
        out[i : i + 4096] = (np.square(c).sum(1) - 2 * x[i : i + 4096] @ c.T).argmin(1)
    return out


def apart(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of one half of a query to its centroids."""
    return np.square(c - q).sum(1)


def by_first(sizes: np.ndarray, width: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For every centroid of the first half those of the second with which it has rows, and their numbers."""
    return [(np.flatnonzero(row), row[row > 0]) for row in sizes.reshape(-1, width)]


def walk(da: np.ndarray, db: np.ndarray, rows: list[tuple[np.ndarray, np.ndarray]], want: int) -> float:
    """Centroid pairs that have rows by da[i] + db[j], nearest first from a heap, until those passed hold ``want`` rows: the last one's sum.

    The heap has a place in each list of pairs of one first centroid; a list is ordered when the walk comes to where it may begin.
    """
    a, low = np.argsort(da, kind="stable").tolist(), float(db.min())
    sums: dict[int, list[float]] = {}
    held: dict[int, list[int]] = {}
    heap, have, last = [(float(da[a[0]]) + low, 0, -1)], 0, 0.0
    while heap and have < want:
        s, k, at = heap[0]
        if at < 0:
            j, n = rows[a[k]]
            if len(j):
                order = np.argsort(db[j], kind="stable")
                sums[k], held[k] = (da[a[k]] + db[j[order]]).tolist(), n[order].tolist()
                heapq.heapreplace(heap, (sums[k][0], k, 0))
            else:
                heapq.heappop(heap)
            if k + 1 < len(a):
                heapq.heappush(heap, (float(da[a[k + 1]]) + low, k + 1, -1))
            continue
        have, last = have + held[k][at], s
        if at + 1 < len(sums[k]):
            heapq.heapreplace(heap, (sums[k][at + 1], k, at + 1))
        else:
            heapq.heappop(heap)
    return last


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(col.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(col), dim)


def _nearest_cells(index: DataFrame, probes: np.ndarray, top: int) -> list[tuple[int, int]]:
    """(probe, cell) of the ``top`` entries nearest to each probe, its own vector left out, by brute force: one scan."""
    sent = index.sparkSession.sparkContext.broadcast(probes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = sent.value
        best: list[list[tuple[float, int]]] = [[] for _ in p]
        for batch in batches:
            m, cell = _matrix(batch.column("v"), p.shape[1]), batch.column("cell").to_numpy()
            for s in range(0, len(m), 4096):
                part = m[s : s + 4096]
                d = np.square(part).sum(1)[None, :] - 2 * p @ part.T
                for i, row in enumerate(d):
                    near = np.argpartition(row, top)[: top + 1] if len(row) > top + 1 else np.arange(len(row))
                    best[i] = heapq.nsmallest(top + 1, [*best[i], *zip(row[near].tolist(), cell[s + near].tolist(), strict=True)])
        flat = [(i, d, c) for i, l in enumerate(best) for d, c in l]
        yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in flat], t) for k, t in enumerate((pa.int32(), pa.float64(), pa.int32()))], names=["probe", "d", "cell"])

    order = Window.partitionBy("probe").orderBy("d", "cell")
    found = index.select("v", "cell").mapInArrow(trimmed(run), "probe int, d double, cell int").withColumn("r", F.row_number().over(order)).where((F.col("r") > 1) & (F.col("r") <= top + 1))
    return [(r["probe"], r["cell"]) for r in found.select("probe", "cell").collect()]  # ``PROBES`` times ``top`` rows


def reach(index: DataFrame, x: np.ndarray, books: tuple[np.ndarray, np.ndarray], half: int, sizes: np.ndarray, top: int, share: float = REACH) -> int:
    """Rows that a query's cells must hold, so that ``share`` of the true neighbours of the probes ``x`` lie in theirs."""
    rows = []
    found = _nearest_cells(index, x, top)
    for i, q in enumerate(x):
        total = (apart(q[:half], books[0])[:, None] + apart(q[half:], books[1])[None, :]).ravel()
        order = np.argsort(total, kind="stable")
        passed = np.zeros(len(order), np.int64)
        passed[order] = np.cumsum(sizes[order])
        rows += [int(passed[c]) for p, c in found if p == i]
    return int(np.quantile(rows, share, method="higher")) if rows else 0


def search(df: DataFrame, queries: DataFrame, top: int = TOP, k: int | None = None, sample: int = SAMPLE, share: float = REACH) -> DataFrame:
    """query_id, rank, vec_id, score: of each of ``queries`` (vec_id, embedding) its ``top`` nearest rows of ``df`` found, rows of its own id left out.

    ``k``: centroids of a half; by default some twice the root of the number of vectors. Nothing here is tuned by hand to a table: how far a
    query goes is measured on ``PROBES`` of its vectors.
    """
    with Work(df.sparkSession) as work:
        return materialise(_search(df, queries, work, top, k, sample, share), "nearest")


def _search(df: DataFrame, queries: DataFrame, work: Work, top: int, k: int | None, sample: int, share: float) -> DataFrame:
    spark = df.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = valid(df)
    low = rows.select(F.xxhash64("vec_id", "v").alias("h"), "v").orderBy("h").limit(sample).select("v").toArrow().column("v").combine_chunks()
    if not len(low):
        return empty
    lens = np.diff(low.offsets.to_numpy())
    dim = int(np.bincount(lens).argmax())
    x = _matrix(low.filter(pa.array(lens == dim)), dim)
    rows = rows.where(F.size("v") == dim)
    # equal vectors: the smallest ids of each piece first, so that no task holds all ids of a vector
    piece = Window.partitionBy("v", "s").orderBy("vec_id")
    few = rows.withColumn("s", F.pmod(F.xxhash64("vec_id"), F.lit(64))).withColumn("r", F.dense_rank().over(piece)).where(F.col("r") <= top + 1)
    one = few.groupBy("v").agg(F.slice(F.array_distinct(F.sort_array(F.collect_list("vec_id"))), 1, top + 1).alias("ids"))
    half = max(1, dim // 2)
    one = work.save(one, "vectors")
    count = one.count()
    k = k or min(CENTROIDS, 1 << round(math.log2(max(2.0, 2.2 * math.sqrt(count)))))
    books = (kmeans(x[:, :half], k), kmeans(x[:, half:], k) if dim > 1 else np.zeros((1, 0)))
    sent = spark.sparkContext.broadcast((books, dim, half))

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (ca, cb), d, h = sent.value
        for batch in batches:
            m = _matrix(batch.column("v"), d)
            if len(m):
                cell = nearest(m[:, :h], ca) * len(cb) + nearest(m[:, h:], cb)
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), *batch.columns], names=["cell", *batch.schema.names])

    index = work.save(one.mapInArrow(trimmed(entries), "cell int, v array<double>, ids array<long>"), "index")
    work.drop("vectors")
    cells = len(books[0]) * len(books[1])
    sizes = np.zeros(cells, np.int64)
    for r in index.groupBy("cell").count().collect():  # k * k rows at most
        sizes[r["cell"]] = r["count"]
    want = max(FLOOR * top, reach(index, x[np.random.default_rng(11).permutation(len(x))[:PROBES]], books, half, sizes, top, share))
    # pieces: runs of cells of about PIECE rows; a cell that holds more is split
    piece_of = (np.cumsum(sizes) - sizes) // PIECE
    splits = {int(p): int(-(-n // (2 * PIECE))) for p, n in enumerate(np.bincount(piece_of, sizes)) if n > 2 * PIECE}
    plan = spark.sparkContext.broadcast((sizes, piece_of, splits, want))

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (ca, cb), d, h = sent.value
        sizes, piece_of, splits, want = plan.value
        held, live = by_first(sizes, len(cb)), sizes > 0
        for batch in batches:
            row, to, limit = [], [], []
            for i, q in enumerate(_matrix(batch.column("v"), d)):
                da, db = apart(q[:h], ca), apart(q[h:], cb)
                far = walk(da, db, held, want) * (1 + 1e-12)
                mine = np.unique(piece_of[((da[:, None] + db[None, :]) <= far).ravel() & live])
                own = [(int(p), s) for p in mine for s in range(splits.get(int(p), 1))]
                row += [i] * len(own)
                to += own
                limit += [far] * len(own)
            took = batch.take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in to], pa.int32()), pa.array([s for _, s in to], pa.int32()), took.column("vec_id"), took.column("v"), pa.array(limit, pa.float64())], names=["piece", "split", "query_id", "q", "far"])

    own = valid(queries).where(F.size("v") == dim).distinct()
    asking = own.count()
    asked = own.repartition(max(1, min(TASKS, -(-asking // WALKS)))).mapInArrow(trimmed(passed), "piece int, split int, query_id long, q array<double>, far double")
    asked = asked.withColumn("g", F.pmod(F.xxhash64("query_id", "q"), F.lit(max(1, -(-asking // GROUP)))))
    tasks = max(1, min(TASKS, int(piece_of.max(initial=0)) + 1 + sum(splits.values())))
    qs = asked.repartition(tasks, "piece", "split").groupBy("piece", "split", "g").agg(F.collect_list(F.struct("query_id", "q", "far")).alias("qs"))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, piece_of, splits, _ = plan.value
        for batch in batches:
            cell = batch.column("cell").to_numpy()
            p = piece_of[cell]
            n = np.array([splits.get(int(y), 1) for y in p], np.int64)
            first = batch.column("ids").values.to_numpy()[batch.column("ids").offsets.to_numpy()[:-1]]
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array((first * 0x9E3779B1 >> 7) % n, pa.int32()), *batch.columns], names=["piece", "split", *batch.schema.names])

    es = index.mapInArrow(trimmed(dealt), "piece int, split int, cell int, v array<double>, ids array<long>").repartition(tasks, "piece", "split").groupBy("piece", "split").agg(F.collect_list(F.struct("cell", "v", "ids")).alias("es"))

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row is a group of queries and a piece of entries: each query's best of the piece, exactly."""
        (ca, cb), d, h = sent.value
        for batch in batches:
            for left, right in zip(batch.column("qs"), batch.column("es"), strict=True):
                qs, es = left.values, right.values
                qm, em, cell = _matrix(qs.field("q"), d), _matrix(es.field("v"), d), es.field("cell").to_numpy()
                qid, far = qs.field("query_id").to_numpy(), qs.field("far").to_numpy()
                ids = es.field("ids")
                begin, flat = ids.offsets.to_numpy(), ids.values.to_numpy()
                first, second, norm = cell // len(cb), cell % len(cb), np.square(em).sum(1)
                out: list[tuple[int, int, int, float]] = []
                step = max(1, AT_ONCE // max(1, len(em)))
                for s in range(0, len(qm), step):
                    q = qm[s : s + step]
                    da = np.stack([apart(x[:h], ca) for x in q])
                    db = np.stack([apart(x[h:], cb) for x in q])
                    near = norm[None, :] - 2 * q @ em.T
                    near[da[:, first] + db[:, second] > far[s : s + step, None]] = np.inf
                    for i, line in enumerate(near):
                        if len(line) > top + 1:
                            edge = np.partition(line, top)[top]
                            at = np.flatnonzero(line <= edge + 1e-9 * (1 + abs(edge))) if np.isfinite(edge) else np.flatnonzero(np.isfinite(line))
                        else:
                            at = np.flatnonzero(np.isfinite(line))
                        dist = np.sqrt(np.square(em[at] - q[i]).sum(1))
                        pairs = [(float(x), int(v)) for x, e in zip(dist, at, strict=True) for v in flat[begin[e] : begin[e + 1]] if v != qid[s + i]]
                        out += [(s + i, int(qid[s + i]), v, x) for x, v in heapq.nsmallest(top, pairs)]
                took = pa.array([o[0] for o in out], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([o[1] for o in out], pa.int64()), qs.field("q").take(took), pa.array([o[2] for o in out], pa.int64()), pa.array([o[3] for o in out], pa.float64())], names=["query_id", "q", "vec_id", "score"])

    met = qs.join(es, ["piece", "split"]).select("qs", "es").mapInArrow(trimmed(rerank), "query_id long, q array<double>, vec_id long, score double")
    order = Window.partitionBy("query_id", "q").orderBy("score", "vec_id")
    ranked = met.withColumn("q", F.xxhash64("q")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op3_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where("vec_id % 100 = 0"))
