"""Sinks that can be resumed: keys that are there already are left out, chosen ones are recomputed."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def existing(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The sink's rows, none where it is not there yet."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    there = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def todo(df: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    return df.join(done.select(*key).distinct(), key, "left_anti")


def append_new(df: DataFrame, path: str, key: list[str]) -> None:
    """Appends the rows whose keys the sink lacks."""
    spark = df.sparkSession
    todo(df, existing(spark, path, df.schema), key).write.mode("append").parquet(path)


def recompute(df: DataFrame, done: DataFrame, bad, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows that stay, rows of ``df`` to be written anew): those of ``done`` where ``bad`` holds are made again. ``Versioned.recompute`` puts them in their place."""
    stay = done.where(~F.coalesce(bad, F.lit(False)))
    return stay, todo(df, stay, key)


class Conflict(RuntimeError):
    """Another writer has committed meanwhile."""


class Versioned:
    """A table of Parquet files below ``path``, partitioned by one column, whose content is what its last manifest names.

    A write puts its files into a fresh folder below ``data`` first, and counts once ``manifests/<version>.json`` has been renamed into place: a job that dies midway
    leaves the table as it was, and a reader of an older version keeps reading it. A manifest lists the folders, and of each the partitions that later writes have
    replaced. Replacing rows rewrites the partitions that hold their keys, and no others. A rename must fail where its target exists, as on HDFS and local disks.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, key: list[str], by: str) -> None:
        self.spark, self.path, self.schema, self.key, self.by = spark, path.rstrip("/"), schema, key, by
        self._jvm = spark.sparkContext._jvm

    def _p(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self):
        return self._p(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> int:
        """0 where nothing has been committed."""
        fs, p = self._fs(), self._p(f"{self.path}/manifests")
        names = [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []
        return max((int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0].isdigit()), default=0)

    def _parts(self, version: int) -> list[dict]:
        if not version:
            return []
        source = self._fs().open(self._p(f"{self.path}/manifests/{version:08d}.json"))
        try:
            return json.loads(bytes(source.readAllBytes()).decode())["parts"]
        finally:
            source.close()

    def _commit(self, parts: list[dict], base: int) -> int:
        own = f"{self.path}/manifests/.{uuid.uuid4().hex}"
        _put(self.spark, own, json.dumps({"parts": parts}))
        to = self._p(f"{self.path}/manifests/{base + 1:08d}.json")
        if self._fs().exists(to) or not self._fs().rename(self._p(own), to):
            self._fs().delete(self._p(own), False)
            raise Conflict(f"{self.path}: version {base + 1} is there already")
        return base + 1

    def _stage(self, df: DataFrame) -> str:
        """Writes files that no manifest names yet."""
        own = uuid.uuid4().hex
        df.select(*self.schema.names).repartition(self.by).write.partitionBy(self.by).parquet(f"{self.path}/data/{own}")
        return own

    def read(self, version: int | None = None) -> DataFrame:
        out = self.spark.createDataFrame([], self.schema)
        for part in self._parts(self.version() if version is None else version):
            rows = self.spark.read.schema(self.schema).parquet(f"{self.path}/data/{part['dir']}").select(*self.schema.names)
            for gone in part["without"]:  # partition filters: their files are not opened
                rows = rows.where(~F.col(self.by).eqNullSafe(F.lit(gone).cast(self.schema[self.by].dataType)))
            out = out.unionByName(rows)
        return out

    def append(self, df: DataFrame) -> int:
        """Adds the rows whose keys the table lacks; the new version."""
        base = self.version()
        new = todo(df, self.read(base), self.key)
        return self._commit([*self._parts(base), {"dir": self._stage(new), "without": []}], base)

    def replace(self, df: DataFrame) -> int:
        """Puts ``df`` in place of the rows with its keys, and adds those that are new; the new version. The partitions it touches come to the driver: names, not rows."""
        base = self.version()
        before, keys = self.read(base), df.select(*self.key).distinct()
        old = before.join(keys, self.key, "left_semi").select(self.by).distinct()
        touched = [r[0] for r in old.unionByName(df.select(self.by).distinct()).distinct().collect()]
        stay = before.where(F.col(self.by).isin([x for x in touched if x is not None]) | (F.col(self.by).isNull() if None in touched else F.lit(False))).join(keys, self.key, "left_anti")
        own = self._stage(stay.unionByName(df.select(*self.schema.names)))
        names = [None if x is None else str(x) for x in touched]
        parts = [{"dir": p["dir"], "without": sorted({*p["without"], *names}, key=str)} for p in self._parts(base)]
        return self._commit([*parts, {"dir": own, "without": []}], base)

    def recompute(self, bad, make) -> int:
        """Replaces the rows where ``bad`` holds by ``make`` of their keys; the version, a new one if there were any."""
        keys = self.read().where(F.coalesce(bad, F.lit(False))).select(*self.key).distinct()
        return self.version() if keys.isEmpty() else self.replace(make(keys))

    def vacuum(self) -> int:
        """Removes the folders that the last version does not name; how many. Readers of older versions lose them."""
        named = {p["dir"] for p in self._parts(self.version())}
        fs, top = self._fs(), self._p(f"{self.path}/data")
        gone = [x.getPath() for x in fs.listStatus(top) if x.getPath().getName() not in named] if fs.exists(top) else []
        for p in gone:
            fs.delete(p, True)
        return len(gone)


def summary_csv(df: DataFrame, path: str) -> None:
    """Views by ticker and date, as sorted CSV files with a header: in the order of their names they are one table, however large."""
    df.orderBy("ticker", "view_date").write.mode("overwrite").option("header", True).csv(path)


def json_lines(df: DataFrame, path: str, mode: str = "append") -> None:
    df.write.mode(mode).json(path)


#: Rows of a report that is rendered by the driver.
REPORT = 10_000


def _report(df: DataFrame) -> list:
    rows = df.limit(REPORT + 1).collect()
    if len(rows) > REPORT:
        raise ValueError(f"a report has {REPORT} rows at most")
    return rows


def _put(spark: SparkSession, path: str, text: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def nested_json(df: DataFrame, path: str, keys: list[str]) -> None:
    """One JSON object, nested by ``keys``: metrics by strategy, models by strategy and factor set, a manifest's documents by id."""
    out: dict = {}
    for row in _report(df):
        own, r = out, row.asDict(recursive=True)
        for k in keys:
            own = own.setdefault(str(r.pop(k)), {})
        own.update(r)
    _put(df.sparkSession, path, json.dumps(out, indent=2, default=str))


def markdown(df: DataFrame) -> str:
    """A Markdown table; numbers with three digits, none as a dash."""
    say = lambda v: "-" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v)
    lines = [df.columns, ["---"] * len(df.columns), *[[say(v) for v in r] for r in _report(df)]]
    return "\n".join("| " + " | ".join(x) + " |" if x[0] != "---" else "|" + "|".join(x) + "|" for x in lines)
