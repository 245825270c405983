"""Views as a stream: the latest of each ticker and when it goes stale. An extension: the batch operators need none of it."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Days after which a view is stale (as in the batch operators).
TTL = 120
_DAY = 86_400_000


def latest_by_window(views: DataFrame, ttl: str = "120 days", width: str = "90 days") -> DataFrame:
    """ticker, window start, view_bps of the last view: append mode, state is dropped behind the watermark."""
    own = views.withColumn("ts", F.col("view_date").cast("timestamp")).withWatermark("ts", ttl)
    g = own.groupBy(F.window("ts", width), "ticker").agg(F.max_by("view_bps", F.struct("ts", "seq")).alias("view_bps"), F.count(F.lit(1)).alias("n"))
    return g.select("ticker", F.col("window.start").cast("date").alias("start"), "view_bps", "n")


class LatestView(StatefulProcessor):
    """A ticker's state is its latest view, by date and then position, and a timer on the day after which it is stale. Rows that repeat or come late change nothing;
    of rows that come together only the latest is told."""

    def __init__(self, ttl: int) -> None:
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("latest", "day long, seq long, view_bps int")

    def _stale(self, day: int) -> int:
        return (day + self.ttl + 1) * _DAY

    def _row(self, key: tuple, state: tuple, active: bool) -> pd.DataFrame:
        day = datetime.fromtimestamp(state[0] * 86_400, timezone.utc).date()
        return pd.DataFrame({"ticker": [key[0]], "view_date": [day], "seq": [state[1]], "view_bps": [state[2]], "active": [active]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  Spark's names
        have = self.state.get() if self.state.exists() else None
        best = have
        for p in rows:
            own = p.sort_values(["day", "seq"]).iloc[-1]
            if best is None or (int(own.day), int(own.seq)) > (best[0], best[1]):
                best = (int(own.day), int(own.seq), int(own.view_bps))
        if best is not None and (have is None or best != tuple(have)):
            if have is not None:
                self.handle.deleteTimer(self._stale(have[0]))
            self.state.update(best)
            self.handle.registerTimer(self._stale(best[0]))
            yield self._row(key, best, True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.state.exists():
            have = self.state.get()
            if self._stale(have[0]) <= expiredTimerInfo.getExpiryTimeInMs():
                self.state.clear()
                yield self._row(key, have, False)

    def close(self) -> None:
        pass


def latest_views(views: DataFrame, delay: str = "0 days", ttl: int = TTL) -> DataFrame:
    """ticker, view_date, seq, view_bps, active: a row when a ticker has a later view than before, and one, not active, when its view goes stale: ``ttl`` days after it, by the watermark of all views.

    ``views``: a stream of ticker, view_date, seq, view_bps; rows later than ``delay`` behind the latest may be left out. Needs the RocksDB state store.
    """
    own = views.select("ticker", F.unix_date("view_date").cast("long").alias("day"), F.col("seq").cast("long").alias("seq"), F.col("view_bps").cast("int").alias("view_bps"))
    # state, timers and watermark go by UTC days, whatever the session's zone
    own = own.withColumn("ts", F.timestamp_seconds(F.col("day") * 86_400)).withWatermark("ts", delay)
    return own.groupBy("ticker").transformWithStateInPandas(LatestView(ttl), "ticker string, view_date date, seq long, view_bps int, active boolean", "Append", "EventTime")
