"""Connected components over a table of links, for graphs of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Work, dealt_join, materialise


def _joined(edges: DataFrame) -> DataFrame:
    """Each (a, b) with m, the least of a and all its b; rows of a node with very many links are dealt to several tasks."""
    least = edges.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    return dealt_join(edges, least, "a")


def components(links: DataFrame, most: int = 60, keep: Work | None = None, name: str = "components") -> DataFrame:
    """node, comp (the least node that it is connected with) of every node in ``links`` (a, b).

    Alternates large-star and small-star steps until nothing changes: logarithmically many rounds, each written to the
    shared folder in place of the one before; the result is a table of ``keep``, if given. Self-links count as nodes of their own; null ends are left out; an empty table has no nodes.
    """
    spark = links.sparkSession
    with Work(spark) as work:
        links = work.save(links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a is not null and b is not null").distinct(), "given")
        edges = work.save(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
        last = None
        for _ in range(most):
            both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
            large = work.save(_joined(both).where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large")
            down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
            step = _joined(down).select(F.explode(F.array(F.struct(F.col("b").alias("x"), "m"), F.struct(F.col("a").alias("x"), "m"))).alias("s"))
            edges = work.save(step.select(F.col("s.x").alias("a"), F.col("s.m").alias("b")).where("a <> b").distinct(), "links")
            now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
            if now == last:
                break
            last = now
        else:
            raise RuntimeError(f"components still change after {most} rounds")
        roots = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("comp"))
        found = edges.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(roots)
        alone = links.where("a = b").select(F.col("a").alias("node"))
        alone = alone.join(found.select("node"), "node", "left_anti").select("node", F.col("node").alias("comp"))
        found = found.unionByName(alone)
        return materialise(found, name) if keep is None else keep.save(found, name)
