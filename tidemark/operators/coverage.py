"""Coverage of filings: missing quarters, gaps, runs of years, balanced and stratified selections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.small import small

#: Sectors of a quota, which is computed by the driver.
MOST = 100_000


def year_runs(df: DataFrame, by: str) -> DataFrame:
    """by, first, last, n: runs of consecutive years."""
    w = Window.partitionBy(by).orderBy("year")
    island = df.select(by, "year").distinct().withColumn("g", F.col("year") - F.row_number().over(w))
    return island.groupBy(by, "g").agg(F.min("year").alias("first"), F.max("year").alias("last"), F.count(F.lit(1)).alias("n")).drop("g")


def gaps(df: DataFrame, by: str, date: str, days: int = 7) -> DataFrame:
    """by, after, until, days: consecutive dates more than ``days`` apart."""
    w = Window.partitionBy(by).orderBy(date)
    own = df.select(by, F.lag(date).over(w).alias("after"), F.col(date).alias("until"))
    return own.withColumn("days", F.datediff("until", "after")).where(F.col("days") > days)


def quarters_by_year(df: DataFrame, by: str) -> DataFrame:
    """by, year, n_quarters, short (fewer than three)."""
    return df.groupBy(by, "year").agg(F.count_distinct("quarter").alias("n_quarters")).withColumn("short", F.col("n_quarters") < 3)


def missing(df: DataFrame, by: str, first: int, last: int) -> DataFrame:
    """by, year, quarter that the grid of all quarters has and ``df`` has not."""
    years = F.explode(F.sequence(F.lit(first), F.lit(last)))
    grid = df.select(by).distinct().withColumn("year", years).withColumn("quarter", F.explode(F.sequence(F.lit(1), F.lit(4))))
    return grid.join(df.select(by, "year", "quarter").distinct(), [by, "year", "quarter"], "left_anti")


def totals(df: DataFrame, by: str, years: int) -> DataFrame:
    """companies, found, expected, pct, complete, with_short_years over distinct quarters."""
    per = df.groupBy(by, "year").agg(F.count_distinct("quarter").alias("k")).groupBy(by).agg(F.sum("k").alias("have"), F.count(F.when(F.col("k") < 3, 1)).alias("short"))
    n = F.count(F.lit(1))
    out = per.agg(n.alias("companies"), F.sum("have").alias("found"), (n * 4 * years).alias("expected"), F.count(F.when(F.col("have") == 4 * years, 1)).alias("complete"), F.count(F.when(F.col("short") > 0, 1)).alias("with_short_years"))
    return out.withColumn("pct", F.try_divide(100.0 * F.col("found"), F.col("expected")))


def first_of_each(ranked: DataFrame) -> DataFrame:
    """Of a ranked list the first row of each number of companies, or of each length."""
    own = ranked.where("list in ('companies', 'length')")
    w = Window.partitionBy("list", F.when(F.col("list") == "companies", F.col("companies")).otherwise(F.col("years"))).orderBy("k")
    return own.withColumn("__again", F.row_number().over(w)).where("__again = 1").drop("__again")


def complete_periods(df: DataFrame, by: str) -> DataFrame:
    """start, end, years, companies, score: for all spans, how many ``by`` have every year of it (relational division by runs)."""
    runs = year_runs(df, by)
    spans = runs.select(F.explode(F.sequence("first", "last")).alias("start"), F.col("last")).select("start", F.explode(F.sequence("start", "last")).alias("end"))
    out = spans.groupBy("start", "end").agg(F.count(F.lit(1)).alias("companies")).withColumn("years", F.col("end") - F.col("start") + 1)
    return out.withColumn("score", F.col("years") * F.col("companies"))


def ranked_periods(periods: DataFrame, min_years: int = 5, min_companies: int = 10, limits: tuple[int, int, int] = (15, 15, 10)) -> DataFrame:
    """list, k, start, end, years, companies, score: by companies, by length and by score."""
    orders = {
        "companies": (F.col("years") >= min_years, [F.col("companies").desc(), F.col("years").desc(), F.col("start")], limits[0]),
        "length": (F.col("companies") >= min_companies, [F.col("years").desc(), F.col("companies").desc(), F.col("start")], limits[1]),
        "score": ((F.col("years") >= min_years) & (F.col("companies") >= min_companies), [F.col("score").desc(), F.col("years").desc(), F.col("start")], limits[2]),
    }
    out = None
    for name, (cond, order, n) in orders.items():
        top = periods.where(cond).orderBy(*order).limit(n)  # the limit is the report
        own = top.select(F.lit(name).alias("list"), F.row_number().over(Window.orderBy(*order)).cast("int").alias("k"), "start", "end", "years", "companies", "score")
        out = own if out is None else out.unionByName(own)
    return out


def quotas(sizes: dict[str, int], total: int = 100, floor: int = 2) -> dict[str, int]:
    """Share of each sector, at least ``floor`` and at most its size; then one more (or fewer) in turn, largest first, until they sum up."""
    everything = sum(sizes.values())
    order = sorted(sizes, key=lambda k: (-sizes[k], k))
    q = {k: min(sizes[k], max(floor, int(sizes[k] / everything * total))) for k in order}
    while sum(q.values()) < min(total, everything):
        for k in order:
            if sum(q.values()) < total and q[k] < sizes[k]:
                q[k] += 1
    while sum(q.values()) > total and any(v > floor for v in q.values()):
        for k in reversed(order):
            if sum(q.values()) > total and q[k] > floor:
                q[k] -= 1
    return q


def balanced(df: DataFrame, sector: str, name: str, total: int = 100) -> DataFrame:
    """The first names of every sector, alphabetically, as many as its quota. Sectors are a small dimension."""
    rows = df.groupBy(sector).count().limit(MOST + 1).collect()
    if len(rows) > MOST:
        raise ValueError(f"more than {MOST} sectors")
    sizes = {r[0]: r[1] for r in rows}
    q = df.sparkSession.createDataFrame(list(quotas(sizes, total).items()), "__s string, __q int") if sizes else None
    if q is None:
        return df
    k = F.row_number().over(Window.partitionBy(sector).orderBy(name))
    return df.withColumn("__k", k).join(small(q), F.col(sector) == F.col("__s")).where("__k <= __q").drop("__s", "__q", "__k")


def alternate(df: DataFrame, by: str, name: str) -> DataFrame:
    """portfolio 1 or 2, in turn within ``by``; then the last of the larger one move until both have half. ``df`` is a selection, a small table."""
    k = F.row_number().over(Window.partitionBy(by).orderBy(name))
    own = df.withColumn("portfolio", F.when(k % 2 == 1, 1).otherwise(2))
    back = Window.partitionBy("portfolio").orderBy(F.col(by).desc(), F.col(name).desc())
    sizes = own.withColumn("__back", F.row_number().over(back)).withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy("portfolio")))
    half = F.floor(F.count(F.lit(1)).over(Window.partitionBy(F.lit(1))) / 2)
    moves = (F.col("__n") > half) & (F.col("__back") <= F.col("__n") - half) & (F.col("__all") % 2 == 0)
    return sizes.withColumn("__all", F.count(F.lit(1)).over(Window.partitionBy(F.lit(1)))).withColumn("portfolio", F.when(moves, 3 - F.col("portfolio")).otherwise(F.col("portfolio"))).drop("__back", "__n", "__all")


def stratified(df: DataFrame, strata: list[str], key: str, n: int, seed: str = "20260829") -> DataFrame:
    """``n`` rows of each stratum, by a hash of key and seed: the same rows on any cluster."""
    w = Window.partitionBy(*strata).orderBy(F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(seed))), key)
    return df.withColumn("k", F.row_number().over(w).cast("long")).where(F.col("k") <= n)
