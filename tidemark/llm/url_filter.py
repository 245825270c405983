"""URL filter: a cascade of Bloom filters that is exact over the corpus's own keys.

A rule is ``host/path-prefix`` with a verdict. A url's keys are all strings ``suffix-of-host +
prefix-of-path`` for prefix lengths that rules have; a rule fits iff it is one of the url's keys. Level
1 holds the rules' keys; level 2 those keys of the corpus that level 1 takes wrongly; level 3 the
rules' keys that level 2 takes wrongly, and so on until a level takes none wrongly. A key is listed iff
the first level that refuses it is an even one (or the cascade ends after an odd one). That is exact for every key of
the universe the cascade was built over, and the universe here is every key of every page, so the
verdict needs no join: a url carries its keys, and the cascade, a few hundred bits a rule, is a literal.

The size of level 1 follows the rules, its error rate the universe (``p = rules / keys`` at most), so
what it takes wrongly is about as many keys as there are rules: no level grows with the corpus.

Cases: a null url or one without ``://`` has empty host and path and no keys; an empty path fits no
rule, as every rule's path begins with ``/``; repeated urls are judged alike; the longest rule wins;
where none fits, the verdict is the method's: allow.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import Work, table

#: The rules in force: key -> verdict.
RULES: Mapping[str, str] = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null or no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.substr(rest, F.length(host) + 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lower, F.lit("")), F.coalesce(F.regexp_extract(path, r"^([^?#]*)", 1), F.lit(""))


def keys_of(host: Column, path: Column, lengths: list[int]) -> Column:
    """All (host suffix + path prefix) keys of a url; ``lengths``: of the rules' paths."""
    parts = F.split(host, r"\.", -1)
    n = F.size(parts)
    suffixes = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(parts, i, n - i + 1), "."))
    heads = F.filter(F.array(*[F.when(F.length(path) >= k, F.substring(path, 1, k)) for k in lengths]), lambda x: x.isNotNull())
    return F.when(F.length(host) == 0, F.array().cast("array<string>")).otherwise(
        F.flatten(F.transform(suffixes, lambda s: F.transform(heads, lambda p: F.concat(s, p))))
    )


@dataclass(frozen=True)
class Level:
    bits: int
    hashes: int
    words: tuple[int, ...]

    def has(self, key: Column, level: int) -> Column:
        """Whether this filter takes ``key``; its bits are a literal array of longs."""
        words = F.lit(list(self.words)).cast("array<long>") if self.words else F.array().cast("array<long>")
        out = F.lit(True)
        for p in positions(key, level, self.bits, self.hashes):
            word = F.element_at(words, (F.shiftright(p, 6) + 1).cast("int"))
            out = out & (F.getbit(word, (p % 64).cast("int")) == 1)
        return out


def positions(key: Column, level: int, bits: int, hashes: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(level), F.lit(j)), F.lit(bits).cast("long")) for j in range(hashes)]


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Level, ...]

    def listed(self, key: Column) -> Column:
        """Exact membership for keys of the universe it was built over."""
        out = F.lit(len(self.levels) % 2 == 1)
        for i in range(len(self.levels) - 1, -1, -1):
            out = F.when(self.levels[i].has(key, i), out).otherwise(F.lit(i % 2 == 1))
        return out


def _fill(keys: DataFrame, level: int, n: int, p: float) -> Level:
    """A filter over column ``key`` of ``keys`` (``n`` rows) at error rate ``p``. Its words are summed
    up in Spark; only bits/64 of them, bounded by the rules, reach the driver."""
    bits = max(64, 64 * math.ceil(n * -math.log(p) / math.log(2) ** 2 / 64))
    k = max(1, round(bits / max(n, 1) * math.log(2)))
    k = min(k, 16)
    at = keys.select(F.explode(F.array(*positions(F.col("key"), level, bits, k))).alias("p"))
    words = at.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("p") % 64).cast("int"))).alias("v")).collect()
    by = {r["w"]: r["v"] for r in words}
    return Level(bits, k, tuple(by.get(i, 0) for i in range(bits // 64)))


def build(listed: DataFrame, universe: DataFrame, max_levels: int = 32) -> Cascade:
    """Cascade over ``listed.key`` that is exact on ``universe.key``; both distinct inside. The universe is scanned once, and each level's errors are a table."""
    with Work(universe.sparkSession) as work:
        listed = work.save(listed.select("key").where("key is not null").distinct(), "listed")
        universe = universe.select("key").where("key is not null").distinct()
        n = listed.count()
        if n == 0:
            return Cascade(())
        outside = work.save(universe.join(listed, "key", "left_anti"), "others")
        size = n + outside.count()
        p = max(1e-9, min(0.5, n * math.sqrt(0.5) / max(size, 1)))
        levels: list[Level] = []
        inside, have = listed, n
        for i in range(max_levels):
            level = _fill(inside, i, have, p if i == 0 else 0.5)
            levels.append(level)
            wrong = work.save(outside.where(level.has(F.col("key"), i)), f"wrong{i}")
            have = wrong.count()
            if have == 0:
                return Cascade(tuple(levels))
            inside, outside = wrong, inside
    raise RuntimeError(f"the cascade still errs after {max_levels} levels")


def judge(pages: DataFrame, rules: Mapping[str, str] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict of every page."""
    spark = pages.sparkSession
    lengths = sorted({len(r) - r.index("/") for r in rules})
    host, path = host_and_path(F.col("url"))
    split = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("keys", keys_of(F.col("host"), F.col("path"), lengths))
    listed = spark.createDataFrame(list(rules.items()), "key string, verdict string")
    cascade = build(listed, split.select(F.explode("keys").alias("key")))
    blocked = build(listed.where("verdict = 'block'"), listed)  # a second one tells the rules that block from the others
    hits = F.filter("keys", cascade.listed)
    longest = F.array_max(F.transform(hits, lambda k: F.struct(F.length(k).alias("n"), k.alias("k"))))["k"]
    verdict = F.when(F.col("rule").isNotNull() & blocked.listed(F.col("rule")), "block").otherwise("allow")
    return split.withColumn("rule", longest).select("page_id", "host", "path", "rule", verdict.alias("verdict"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


ORACLE = r"""
WITH s AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(substr(rest, length(regexp_extract(rest, '^([^/?#]*)', 1)) + 1), '^([^?#]*)', 1) AS path FROM s),
r(rule, verdict) AS (VALUES ('net/', 'block'), ('example.net/en/', 'allow'), ('example.com/de/', 'block'), ('org/fr/', 'allow')),
m AS (SELECT h.page_id, h.host, h.path, r.rule, r.verdict,
             row_number() OVER (PARTITION BY h.page_id, h.host, h.path ORDER BY length(r.rule) DESC NULLS LAST) AS k
      FROM h LEFT JOIN r ON (h.host = split_part(r.rule, '/', 1) OR ends_with(h.host, '.' || split_part(r.rule, '/', 1)))
                        AND starts_with(h.path, substr(r.rule, instr(r.rule, '/'))))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1
"""
