"""External annotators as a pluggable map: prompts in, parsed and coerced answers out, with a deterministic offline stand-in."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import scalars as s
from tidemark.functions import text as t
from tidemark.operators import grounding
from tidemark.sources.readers import FACTS

Annotator = Callable[[str], str]


class Transient(RuntimeError):
    """A failure that is worth another try: rate limits, lost connections, empty answers."""


class Truncated(RuntimeError):
    """An answer that was cut off: the same call would be cut off again."""


@dataclass(frozen=True)
class Contract:
    """How often a call is tried, on what, and how long it waits between tries: doubling from two seconds, within bounds."""

    tries: int = 5
    retry: tuple[type[BaseException], ...] = (Transient,)
    least: float = 5.0
    most: float = 60.0
    #: Whether the answer is parsed within the try, so that bad JSON is tried again where ``retry`` has ValueError.
    parse: bool = False
    sleep: Callable[[float], None] = field(default=time.sleep, compare=False)

    def wait(self, attempt: int) -> float:
        return min(self.most, max(self.least, 2.0 * 2 ** (attempt - 1)))


#: Facts: only what passes by itself is tried again, seven times. Views: bad JSON too, five times.
FACTS_CONTRACT = Contract(7, (Transient,), 10.0, 120.0)
VIEWS_CONTRACT = Contract(5, (Transient, ValueError), 5.0, 60.0, True)


class Pace:
    """At most ``per_minute`` calls a minute: each waits until the interval since the last one is over."""

    def __init__(self, per_minute: float, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic) -> None:
        self.interval, self.sleep, self.clock, self.last = 60.0 / per_minute, sleep, clock, -1e18

    def wait(self) -> None:
        left = self.interval - (self.clock() - self.last)
        if left > 0:
            self.sleep(left)
        self.last = self.clock()


def offline(prompt: str) -> str:
    """A view drawn from the prompt's digest."""
    d = hashlib.blake2b(prompt.encode(), digest_size=4).digest()
    return json.dumps({"view_bps": d[0] * 256 % 601 - 300 + d[1] % 7, "confidence": ("high", "medium", "low", "Sure")[d[2] % 4], "reasoning": "offline"})


def offline_facts(prompt: str) -> str:
    """Facts drawn from the prompt's digest: one event and, of three prompts in four, one risk, both quoting the prompt's end."""
    d = hashlib.blake2b(prompt.encode(), digest_size=4).digest()
    quote = prompt[-80:]
    risks = [{"category": "market", "severity": ("high", "low", "N/A")[d[1] % 3], "description": "A risk.", "source_quote": quote}] if d[0] % 4 else []
    return json.dumps({"risk_factors": risks, "risk_summary": "null", "sentiment": ("Confident", "neutral")[d[2] % 2], "key_events": [{"event_type": "other", "description": "An event.", "impact": "None", "source_quote": quote}]})


def call_once(call: Annotator, prompt: str, contract: Contract) -> tuple[str | None, str | None]:
    """(answer, error) under a contract."""
    for i in range(1, contract.tries + 1):
        try:
            answer = call(prompt)
            if not answer:
                raise Transient("empty answer")
            if contract.parse:
                json.loads(answer)
            return answer, None
        except contract.retry as e:
            if i == contract.tries:
                return None, f"{type(e).__name__}: {e}"
            contract.sleep(contract.wait(i))
        except Exception as e:  # an answer that cannot be had: the row carries it on
            return None, f"{type(e).__name__}: {e}"
    return None, "no try"


def annotate(df: DataFrame, key: str, prompt: str, call: Annotator = offline, contract: Contract = Contract(), per_minute: float | None = None) -> DataFrame:
    """key, raw, error: the answer of every prompt; what fails under the contract has an error and no answer.

    With ``per_minute``, the rows are dealt to as many partitions as they have, and each keeps to its share of the rate, so that all together
    never pass it; every task of a stage counts as running.
    """
    kind = dict(df.dtypes)[key]
    parts = df.sparkSession.sparkContext.defaultParallelism
    own = df.select(key, prompt) if per_minute is None else df.select(key, prompt).repartition(parts)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pace = Pace(per_minute / parts) if per_minute else None
        for p in it:
            got = []
            for x in p[prompt]:
                if pace:
                    pace.wait()
                got.append(call_once(call, x or "", contract))
            yield pd.DataFrame({key: p[key], "raw": [g[0] for g in got], "error": [g[1] for g in got]})

    return own.mapInPandas(run, f"{key} {kind}, raw string, error string")


VIEW = "struct<view_bps:double,confidence:string,reasoning:string>"


def views(answers: DataFrame, key: str) -> DataFrame:
    """key, view_bps, confidence, reasoning: lenient parse, clamps and coercions; short reasons are replaced."""
    own = answers.where("error is null").withColumn("v", t.lenient_json(F.col("raw"), VIEW)).where("v is not null")
    reason = F.when(F.length("v.reasoning") >= 20, F.col("v.reasoning")).otherwise("No reason was given for this view.")
    return own.select(key, s.clamp_int(F.col("v.view_bps")).alias("view_bps"), s.coerce_confidence(F.col("v.confidence")).alias("confidence"), reason.alias("reasoning"))


ONE_STAGE = "struct<view_bps:string,confidence:string,reasoning:string,supporting_quotes:array<string>>"


def one_stage(answers: DataFrame, filings: DataFrame, key: str, least: int = 10) -> DataFrame:
    """key, view_bps, confidence, reasoning, total_quotes, grounded, dropped: views that are drawn from a filing in one step.

    Points are rounded half to even and bounded, 0 where they are no number. An answer fails that lacks one of the three fields, or whose reasoning has fewer than ``least``
    characters. Quotes are held against the filing's text (``filings``: key, text).
    """
    own = answers.where("error is null").withColumns({"v": t.lenient_json(F.col("raw"), ONE_STAGE), "__has": F.map_keys(t.lenient_json(F.col("raw"), "map<string,string>"))})
    own = own.where(F.col("v").isNotNull() & F.array_contains("__has", "view_bps") & F.array_contains("__has", "confidence") & (F.length("v.reasoning") >= least))
    view = own.select(key, s.clamp_round(F.col("v.view_bps")).alias("view_bps"), s.coerce_confidence(F.col("v.confidence")).alias("confidence"), F.col("v.reasoning").alias("reasoning"), F.coalesce("v.supporting_quotes", F.array().cast("array<string>")).alias("__quotes"))
    quotes = view.select(key, F.explode("__quotes").alias("quote")).join(filings.select(key, F.col("text").alias("doc")), key)
    counts = grounding.grounded(quotes, scores=False).groupBy(key).agg(F.sum(F.col("grounded").cast("int")).alias("grounded"))
    out = view.join(counts, key, "left").withColumns({"total_quotes": F.size("__quotes"), "grounded": F.coalesce(F.col("grounded").cast("int"), F.lit(0))})
    return out.select(key, "view_bps", "confidence", "reasoning", "total_quotes", "grounded", (F.col("total_quotes") - F.col("grounded")).alias("dropped"))


def offline_one_stage(prompt: str) -> str:
    """A view drawn from the prompt's digest, with one quote of its end and, one time in two, one that it does not hold."""
    d = hashlib.blake2b(prompt.encode(), digest_size=4).digest()
    bps = (d[0] * 3 - 380.5, str(d[0]), "none")[d[1] % 3]
    return json.dumps({"view_bps": bps, "confidence": (" High", "medium", "sure")[d[2] % 3], "reasoning": "offline reasons" if d[3] % 8 else "short", "supporting_quotes": [prompt[-60:], "words that stand nowhere in any text at all"][: 1 + d[3] % 2]})


def cleaned(c: Column, kind: T.DataType) -> Column:
    """``c`` with NULL for every string, at any depth, that only says so."""
    if isinstance(kind, T.StringType):
        return s.clean_null(c)
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[cleaned(c[f.name], f.dataType).alias(f.name) for f in kind.fields]))
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: cleaned(x, kind.elementType))
    return c


def facts(answers: DataFrame, filings: DataFrame, key: str) -> DataFrame:
    """``key`` and the fields of facts: parsed, cleaned, with the filing's own ticker, form, date and period in place of what the answer says.

    ``filings``: key, ticker, filing_type, filing_date, fiscal_period. Answers that failed or do not parse are left out (see ``incidents``).
    """
    own = {"ticker", "filing_type", "filing_date", "fiscal_period"}
    schema = T.StructType([f for f in T.StructType.fromDDL(FACTS).fields if f.name not in own])
    got = answers.where("error is null").withColumn("f", t.lenient_json(F.col("raw"), schema.simpleString())).where("f is not null")
    got = got.select(key, *[cleaned(F.col("f")[f.name], f.dataType).alias(f.name) for f in schema.fields])
    return filings.select(key, *sorted(own)).join(got, key)


def incidents(answers: DataFrame, key: str, schema: str = VIEW) -> DataFrame:
    """key, incident_type, message of what failed: the call, or the parse."""
    bad = F.when(F.col("error").isNotNull(), "llm_error").when(t.lenient_json(F.col("raw"), schema).isNull(), "json_decode_error")
    return answers.withColumn("incident_type", bad).where("incident_type is not null").select(key, "incident_type", F.coalesce("error", "raw").alias("message"))


def section_incidents(parsed: DataFrame, key: str) -> DataFrame:
    """key, incident_type, message of filings (key, form, year, sections: a map, error) without sections, without those they must have, or that failed."""
    missing = t.missing_sections(F.col("form"), F.col("year"), F.col("sections"))
    kind = F.when(F.col("error").isNotNull(), "extraction_error").when(F.size(F.map_keys("sections")) <= 0, "no_sections").when(F.size(missing) > 0, "missing_sections")
    message = F.when(F.col("error").isNotNull(), F.col("error")).when(F.size(F.map_keys("sections")) <= 0, "no section was found").otherwise(F.concat(F.lit("missing: "), F.array_join(missing, ", ")))
    return parsed.withColumn("incident_type", kind).where("incident_type is not null").select(key, "incident_type", message.alias("message"))


def fact_incidents(found: DataFrame, dropped: DataFrame, key: str) -> DataFrame:
    """key, incident_type, message of facts without risk factors, and of ungrounded facts (``dropped``: key, quote)."""
    empty = found.where(F.coalesce(F.size("risk_factors"), F.lit(0)) <= 0).select(key, F.lit("empty_risk_factors").alias("incident_type"), F.lit("no risk factor").alias("message"))
    return empty.unionByName(dropped.select(key, F.lit("ungrounded_fact").alias("incident_type"), F.col("quote").alias("message")))
