"""What the operators share: the shared work folder, scratch tables and their removal, joins on hot keys, text columns."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import contextmanager
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Frees the shuffle files of a job as soon as it has ended: what it wrote is a finished table by then.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of an Arrow batch.
BATCH = 8 << 20
#: A key with more than a share of 1 / HOT of a table's rows is hot (so there are at most HOT); its rows are dealt to SPREAD tasks.
HOT, SPREAD = 200, 32


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local session (tests, one machine) that names none gets a temporary folder; a cluster must name one.
    """
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if conf:
        return conf.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    have = spark.conf.get("tidemark.shared.dir", None)
    if not have:
        have = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("tidemark.shared.dir", have)
        spark.sparkContext.setCheckpointDir(have)
    return have


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/tidemark/{name}-{uuid.uuid4().hex}"


@contextmanager
def freeing(spark: SparkSession) -> Iterator[None]:
    """Jobs in this block free their shuffle files when they end."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def _write(df: DataFrame, path: str) -> DataFrame:
    spark = df.sparkSession
    with freeing(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Results that live on in the shared folder, until ``release`` or the end of the driver.
_RESULTS: list[tuple[object, object, str]] = []


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage is cut, and a lost
    executor costs nothing that was finished. The table stays as long as its reader may need it (see ``release``); ``Work`` removes its own."""
    spark = df.sparkSession
    path = scratch(spark, name)
    _RESULTS.append((spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), path))
    return _write(df, path)


def results() -> int:
    """How many results there are."""
    return len(_RESULTS)


def release(first: int = 0, stay: int = 0) -> None:
    """Removes the results that ``materialise`` has left since there were ``first`` of them, but for the last ``stay``: DataFrames that read them are at
    their end. Called when the driver's Python ends."""
    gone = _RESULTS[first : len(_RESULTS) - stay]
    del _RESULTS[first : len(_RESULTS) - stay]
    for result in gone:
        try:
            _delete(*result)
        except Exception:  # noqa: BLE001  the JVM is gone: nothing can be removed any more
            break


atexit.register(release)


class Work:
    """Scratch tables of one operator; those still there are removed at the end of the block."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, {}

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """``materialise``, and ``name`` replaces the table that had it before."""
        path = scratch(self.spark, name)
        out = _write(df, path)
        self.drop(name)
        self.paths[name] = path
        return out

    def folder(self, name: str) -> str:
        """A fresh path, for files of any kind."""
        self.drop(name)
        self.paths[name] = scratch(self.spark, name)
        return self.paths[name]

    def drop(self, *names: str) -> None:
        for name in names:
            if name in self.paths:
                drop_path(self.spark, self.paths.pop(name))

    def __enter__(self) -> Work:
        return self

    def __exit__(self, *_: object) -> None:
        self.drop(*list(self.paths))


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a finished scratch table through the file system that owns the path."""
    _delete(spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), path)


def _delete(jvm, conf, path: str) -> None:
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(conf).delete(p, True)


def dealt_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``left.join(right, key, how)`` for ``how`` inner, left or left_anti, with the rows of hot keys of ``left`` dealt to several tasks.

    ``left`` must be cheap to read twice (a written table). At most ``HOT`` keys can each have more than a share of 1 / ``HOT`` of
    its rows; these keys alone come to the driver. Their rows in ``right`` are repeated ``SPREAD`` times, one for each task.
    """
    spark = left.sparkSession
    with freeing(spark):
        sizes = left.where(F.col(key).isNotNull()).groupBy(key).count().where(F.col("count") > 10 * SPREAD)
        top = sizes.orderBy(F.col("count").desc()).limit(HOT).collect()  # no more keys than that can be hot
        share = left.count() / HOT if top else 0
    hot = [r[0] for r in top if r[1] > share]
    if not hot:
        return left.join(right, key, how)
    salt = F.pmod(F.xxhash64(*left.columns), F.lit(SPREAD)).cast("int")
    dealt = left.withColumn("__salt", F.when(F.col(key).isin(hot), salt).otherwise(0))
    every = F.when(F.col(key).isin(hot), F.sequence(F.lit(0), F.lit(SPREAD - 1))).otherwise(F.array(F.lit(0)))
    return dealt.join(right.withColumn("__salt", F.explode(every)), [key, "__salt"], how).drop("__salt")


def widened(df: DataFrame, ddl: str) -> T.StructType:
    """The schema of ``df`` with further columns."""
    return T.StructType([*df.schema.fields, *T.StructType.fromDDL(ddl).fields])


def lean(spark: SparkSession) -> None:
    """Arrow batches of ``BATCH`` bytes at most, unless the session names a bound of its own: rows may be long texts."""
    unset = f"{BATCH + 1}b"
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", unset) == unset:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{BATCH}b")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    lean(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(col: str | Column, n: int) -> Column:
    """crc32 of an id's decimal text, modulo ``n``; null ids count as the text ``''``."""
    c = F.col(col) if isinstance(col, str) else col
    return F.crc32(F.encode(F.coalesce(c.cast("string"), F.lit("")), "UTF-8")) % F.lit(n)
