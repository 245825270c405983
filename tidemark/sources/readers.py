"""Readers with explicit schemas; keys come from paths."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

VIEWS = "ticker string, view_date date, fiscal_period string, filing_type string, view_bps int, confidence string, sentiment string, eps_surprise double"
FACTS = (
    "ticker string, filing_date string, filing_type string, fiscal_period string, "
    "risk_factors array<struct<category:string,severity:string,description:string,is_new:boolean,source_quote:string>>, risk_summary string, "
    "guidance struct<direction:string,statement:string,revenue_outlook:string,earnings_outlook:string,source_quote:string>, sentiment string, sentiment_rationale string, "
    "key_events array<struct<event_type:string,description:string,impact:string,source_quote:string>>, competitive_position string, extraction_confidence string, "
    "grounding struct<schema_version:string,total_facts:int,grounded:int,dropped:int,threshold:double>"
)
QUARTER = "struct<filingDate:string,date:string,fiscalYear:string,period:string,epsDiluted:double,eps:double,revenue:double>"
INCIDENTS = "timestamp string, ticker string, filing_date string, filing_type string, incident_type string, message string, details map<string,string>"


def _name() -> F.Column:
    return F.col("_metadata.file_path")


def prices(spark: SparkSession, pattern: str) -> DataFrame:
    """ticker (the folder), date, close of ``<ticker>/prices.csv`` files; other columns are not read."""
    head = spark.read.option("header", True).csv(pattern)
    return head.select(F.regexp_extract(_name(), r"([^/]+)/[^/]+$", 1).alias("ticker"), F.col("date").try_cast("date").alias("date"), F.col("close").try_cast("double").alias("close")).where("date is not null")


def views(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(VIEWS).option("header", True).csv(path)


def facts(spark: SparkSession, path: str) -> DataFrame:
    """One document a file; broken files, and facts without date or type, are left out."""
    own = spark.read.schema(FACTS + ", _corrupt_record string").option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    return own.where("_corrupt_record is null and filing_date is not null and filing_type is not null").drop("_corrupt_record")


def income(spark: SparkSession, path: str) -> DataFrame:
    """ticker (the folder), pos (file order), and the quarterly rows."""
    own = spark.read.schema(f"quarterly array<{QUARTER}>").option("multiLine", True).json(path)
    return own.select(F.regexp_extract(_name(), r"([^/]+)/[^/]+$", 1).alias("ticker"), F.posexplode("quarterly").alias("pos", "q")).select("ticker", "pos", "q.*")


def json_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON arrays of objects, one file a ticker (the folder), with pos in file order."""
    own = spark.read.text(path, wholetext=True).select(_name().alias("f"), F.from_json("value", f"array<struct<{schema}>>").alias("a"))
    return own.select(F.regexp_extract("f", r"([^/]+)/[^/]+$", 1).alias("ticker"), F.posexplode("a").alias("pos", "r")).select("ticker", "pos", "r.*")


def filings(spark: SparkSession, pattern: str) -> DataFrame:
    """ticker, form, filing_date, html of ``<ticker>/<form>_<date>.html``; bytes that are no UTF-8 are replaced."""
    raw = spark.read.text(pattern, wholetext=True)
    f = _name()
    own = raw.select(
        F.regexp_extract(f, r"([^/]+)/[^/]+$", 1).alias("ticker"), F.regexp_extract(f, r"(10-[KQ])_", 1).alias("form"), F.regexp_extract(f, r"_(\d{4}-\d{2}-\d{2})", 1).try_cast("date").alias("filing_date"), F.col("value").alias("html")
    )
    return own.where("form <> '' and filing_date is not null")


def universe(spark: SparkSession, text: str) -> DataFrame:
    """ticker, subset, ord of a list such as ``core:`` followed by ``- X`` lines; a plain ``tickers:`` list is one subset."""
    rows, subset = [], None
    for line in text.splitlines():
        line = line.split("#")[0].rstrip()
        if line.strip().endswith(":"):
            subset = line.strip()[:-1]
        elif line.strip().startswith("- ") and subset in ("core", "holdout", "tickers"):
            rows.append((line.strip()[2:].strip("'\""), subset, len(rows)))
    return spark.createDataFrame(rows, "ticker string, subset string, ord int")


def constituents(spark: SparkSession, path: str) -> DataFrame:
    """ticker, sector; the last of duplicates stays."""
    own = spark.read.option("header", True).csv(path).select(F.col("Symbol").alias("ticker"), F.col("`GICS Sector`").alias("sector"), F.monotonically_increasing_id().alias("i"))
    return own.groupBy("ticker").agg(F.max_by("sector", "i").alias("sector"))


def factor_file(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """date and ``names`` (as decimals) of a text file whose table is the first run of lines that begin with a digit."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("i", "line"))
    own = lines.withColumn("is_row", F.col("line").rlike(r"^\s*\d"))
    first = own.where("is_row").agg(F.min("i").alias("a"))
    stop = own.crossJoin(F.broadcast(first)).where("not is_row and i > a").agg(F.min("i").alias("b"))
    rows = own.where("is_row").crossJoin(F.broadcast(stop)).where("b is null or i < b").withColumn("c", F.split(F.trim("line"), r"\s*,\s*"))
    return rows.select(F.try_to_date(F.col("c")[0], "yyyyMMdd").alias("date"), *[(F.col("c")[k + 1].try_cast("double") / 100).alias(n) for k, n in enumerate(names)]).where("date is not null")


def factors(five: DataFrame, momentum: DataFrame) -> DataFrame:
    return five.join(momentum, "date")


def incidents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INCIDENTS).json(path)


def between(df: DataFrame, field: str, start: date, end: date) -> DataFrame:
    """Rows whose field's first ten characters are a date in [start, end]."""
    return df.where(F.substring(F.col(field), 1, 10).try_cast("date").between(F.lit(start), F.lit(end)))


def last_of(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")


def returns(spark: SparkSession, folder: str, subset: str) -> DataFrame:
    """strategy, date, ret of ``<folder>/<subset>/daily_returns.csv``, whose columns are strategies; days without a value are left out."""
    path = f"{folder}/{subset}/daily_returns.csv"
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        raise FileNotFoundError(path)
    wide = spark.read.option("header", True).csv(path)
    names = [c for c in wide.columns if c != "date"]
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("strategy"), F.col(f"`{c}`").try_cast("double").alias("ret")) for c in names]))
    return wide.select(F.col("date").try_cast("date").alias("date"), each.alias("r")).select("r.strategy", "date", "r.ret").where("ret is not null and date is not null")


EVENTS = "array<struct<event_type:string,description:string,impact:string,source_quote:string>>"


def _numbered(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", "[0-9]*.json").json(folder)


def gold(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, tier, events: the gold standard, a file a document whose name begins with a digit and whose key is ``id``."""
    return _numbered(spark, folder, f"id string, tier string, events {EVENTS}").where("id is not null").withColumnRenamed("id", "doc_id")


def runs(spark: SparkSession, folder: str, standard: DataFrame) -> DataFrame:
    """doc_id, tier, events, key_events, failed of a model's run; documents outside the gold standard are left out, and no facts are a failure."""
    own = _numbered(spark, folder, f"doc_id string, facts struct<key_events:{EVENTS}>")
    return standard.join(own.select("doc_id", F.col("facts.key_events").alias("key_events"), F.col("facts").isNull().alias("failed")), "doc_id")
