"""Sharding by a hierarchical weighted hash tree, on DataFrame functions alone.

A topology is regions of racks of shards, each shard with a weight; a rack weighs what its shards
weigh, a region what its racks weigh. A row descends from the root: at every level each child draws
``-ln(u) / weight`` with ``u`` in (0, 1) taken from a hash of the row's key and the child's name, and
the smallest draw wins. So a child receives rows in proportion to its weight, and a change of one
weight moves rows only into or out of the subtree that holds it: draws of all other children of a
node stay as they were.

``grow`` hangs new shards under a region of their own. Their region is a new child of the root, all
other weights are unchanged, and therefore a row either stays where it was or goes to the new shard.

Cases: a null key draws as the text ``null``; a null text has 0 bytes and the CRC of no bytes;
repeated rows land on one shard and get slots of their own; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import table


@dataclass(frozen=True)
class Shard:
    shard: int
    weight: float = 1.0


@dataclass(frozen=True)
class Topology:
    """regions[i] = (name, racks); racks[j] = (name, shards)."""

    regions: tuple[tuple[str, tuple[tuple[str, tuple[Shard, ...]], ...]], ...]

    @staticmethod
    def regular(n_shards: int, per_rack: int = 5, racks_per_region: int = 4, weights: Sequence[float] | None = None) -> Topology:
        shards = [Shard(i, 1.0 if weights is None else float(weights[i])) for i in range(n_shards)]
        racks = [(f"k{i // per_rack}", tuple(shards[i : i + per_rack])) for i in range(0, n_shards, per_rack)]
        regions = [(f"r{i // racks_per_region}", tuple(racks[i : i + racks_per_region])) for i in range(0, len(racks), racks_per_region)]
        return Topology(tuple(regions))

    def grow(self, shard: int, weight: float = 1.0) -> Topology:
        """One more shard, in a region of its own; rows move only into it."""
        return Topology((*self.regions, (f"r{len(self.regions)}", (("k0", (Shard(shard, weight),)),))))


#: Hash draws take the first 13 hexadecimal digits of an MD5: 52 bits, exact in a double.
_BITS = 16**13


def draw(key: Column, node: Column, weight: Column) -> Column:
    """Weighted hash draw of ``node`` for ``key``; smallest wins. Weight 0 never wins."""
    u = (F.conv(F.substring(F.md5(F.concat_ws("|", key, node)), 1, 13), 16, 10).cast("double") + 0.5) / float(_BITS)
    return F.when(weight > 0, -F.log(u) / weight).otherwise(F.lit(float("inf")))


def _weight(x) -> float:
    return x.weight if isinstance(x, Shard) else sum(_weight(y) for y in x[1])


def _descend(key: Column, prefix: Column, weights: list[float], base: Column | None, fan: int) -> Column:
    """Index (from 0) of the winning child among ``fan`` children named ``prefix`` + index. Their
    weights stand in ``weights`` from ``base`` on; ties go to the earlier child."""
    table_ = F.array(*[F.lit(float(w)) for w in weights])
    at = F.lit(0) if base is None else base
    draws = [F.struct(draw(key, F.concat(prefix, F.lit(str(i))), F.element_at(table_, (at + i + 1).cast("int"))).alias("d"), F.lit(i).alias("i")) for i in range(fan)]
    return (draws[0] if fan == 1 else F.least(*draws))["i"]


def locate(df: DataFrame, key: Column, topology: Topology, out: str) -> DataFrame:
    """Adds column ``out``: the shard that ``key`` descends to. The child names and weights of a level
    are looked up by the branch taken, so a row draws once for each child of one region, one rack."""
    regions = topology.regions
    racks = max(len(r) for _, r in regions)
    leaves = max(len(s) for _, r in regions for _, s in r)
    at_region, at_rack = f"__{out}_region", f"__{out}_rack"
    w_rack = [_weight(r[j]) if j < len(r) else 0.0 for _, r in regions for j in range(racks)]
    every = [(r[j][1][k] if j < len(r) and k < len(r[j][1]) else Shard(-1, 0.0)) for _, r in regions for j in range(racks) for k in range(leaves)]
    df = df.withColumn(at_region, _descend(key, F.lit("r"), [_weight(x) for x in regions], None, len(regions)))
    df = df.withColumn(at_rack, _descend(key, F.concat(F.lit("r"), F.col(at_region).cast("string"), F.lit("k")), w_rack, F.col(at_region) * racks, racks))
    base = (F.col(at_region) * racks + F.col(at_rack)) * leaves
    name = F.concat(F.lit("r"), F.col(at_region).cast("string"), F.lit("k"), F.col(at_rack).cast("string"), F.lit("s"))
    leaf = _descend(key, name, [s.weight for s in every], base, leaves)
    ids = F.array(*[F.lit(s.shard) for s in every])
    return df.withColumn(out, F.element_at(ids, (base + leaf + 1).cast("int"))).drop(at_region, at_rack)


def slots(df: DataFrame, shard: str, order: Sequence[str], out: str, block: Column, count: str) -> DataFrame:
    """Adds ``out``: 0, 1, 2, … without gaps in each shard, by (block, order); a row of ``df`` stands for ``count`` equal ones, and comes as many times.

    ``block`` deals each shard's rows to pieces, so that no task sorts a whole shard; the
    pieces' counts (shards x blocks rows at most) are summed up before them and joined back.
    """
    df = df.withColumn("__block", block)
    counts = df.groupBy(shard, "__block").agg(F.sum(count).alias("__n"))
    before = Window.partitionBy(shard).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col(shard).alias("__s"), F.col("__block").alias("__b"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    own = Window.partitionBy(shard, "__block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ranked = df.withColumn("__k", F.coalesce(F.sum(count).over(own), F.lit(0)))
    joined = ranked.join(F.broadcast(starts), (F.col(shard) == F.col("__s")) & (F.col("__block") == F.col("__b")))
    joined = joined.withColumn("__i", F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1)))
    return joined.withColumn(out, (F.col("__start") + F.col("__k") + F.col("__i")).cast("long")).drop("__s", "__b", "__start", "__k", "__i", "__block")


#: Pieces of each shard that get their slots apart; 40 shards x 256 counts are the most that is broadcast.
BLOCKS = 256
SHARDS = 40


def shard_documents(docs: DataFrame, n_shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard. Law ``key``: only doc_id and the
    topology decide. ``slot`` orders a shard by (MD5 byte of key and CRC, doc_id, text_crc32, size). Rows equal in these are one until
    their slots are known, so that neither a repeated id nor a repeated row fills one task."""
    topology = Topology.regular(n_shards)
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    text = F.coalesce(F.col("text"), F.lit(""))
    small = docs.select("doc_id", (F.octet_length(text).cast("long") + 16).alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), key.alias("__key"))
    small = small.groupBy("doc_id", "size", "text_crc32", "__key").agg(F.count(F.lit(1)).alias("__c"))
    placed = locate(locate(small, F.col("__key"), topology, "shard"), F.col("__key"), topology.grow(n_shards), "grown_shard")
    block = F.conv(F.substring(F.md5(F.concat_ws("|", "__key", F.col("text_crc32").cast("string"))), 31, 2), 16, 10).cast("int") % BLOCKS
    out = slots(placed, "shard", ["doc_id", "text_crc32", "size"], "slot", block, "__c")
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))


_U = "((('0x' || substr(md5(k || '|' || {node}), 1, 13))::BIGINT + 0.5) / 4503599627370496.0)"


def _crc_table() -> str:
    """The 256 remainders of the reflected polynomial of CRC-32, by its rule."""
    out = []
    for i in range(256):
        for _ in range(8):
            i = (i >> 1) ^ (0xEDB88320 if i & 1 else 0)
        out.append(i)
    return "[" + ", ".join(map(str, out)) + "]"


def _oracle() -> str:
    """The same descent in DuckDB, for 40 equal shards as 2 regions of 4 racks of 5 and one more; the CRC-32 byte by byte; slots by one window."""
    u = lambda node: _U.format(node=node)
    return f"""
WITH tab AS (SELECT {_crc_table()}::UBIGINT[] AS t),
crc AS (SELECT doc_id, text, xor(4294967295::UBIGINT, list_reduce(list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::UBIGINT), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255)::INT + 1]), 4294967295::UBIGINT))::BIGINT AS text_crc32 FROM documents, tab),
d AS (SELECT doc_id, strlen(coalesce(text, '')) + 16 AS size, text_crc32, coalesce(doc_id::VARCHAR, 'null') AS k FROM crc),
r AS (SELECT *, CASE WHEN -ln({u("'r0'")}) / 20 <= -ln({u("'r1'")}) / 20 THEN 0 ELSE 1 END AS a,
             least(-ln({u("'r0'")}) / 20, -ln({u("'r1'")}) / 20) AS best, -ln({u("'r2'")}) AS own FROM d),
kk AS (SELECT r.*, (SELECT arg_min(j, -ln({u("'r' || a || 'k' || j")})) FROM range(4) t(j)) AS b FROM r),
ss AS (SELECT kk.*, (SELECT arg_min(j, -ln({u("'r' || a || 'k' || b || 's' || j")})) FROM range(5) t(j)) AS c FROM kk)
SELECT doc_id, size, text_crc32, 'key' AS law, (a * 20 + b * 5 + c)::INT AS shard,
       row_number() OVER (PARTITION BY a, b, c ORDER BY ('0x' || substr(md5(k || '|' || text_crc32), 31, 2))::INT, doc_id NULLS FIRST, text_crc32, size) - 1 AS slot,
       (CASE WHEN own < best THEN 40 ELSE a * 20 + b * 5 + c END)::INT AS grown_shard FROM ss
"""


ORACLE = _oracle()
