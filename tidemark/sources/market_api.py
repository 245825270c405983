"""A market-data source for ``spark.read.format`` and ``spark.readStream.format``: a partition for each symbol and range of dates, dates pushed down. The fetcher is pluggable; the one here makes answers up.

Datasets: prices, filings, estimates, market_cap, grades, income, balance, cash_flow, splits, report. A client asks an endpoint, keeps to a rate, waits
and asks again when it is told to slow down, goes through pages until one is empty, and takes an answer that is no list for none.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterable, Iterator
from datetime import date, timedelta

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

#: (endpoint, parameters) -> (status, answer)
Fetch = Callable[[str, dict], tuple[int, object]]

ENDPOINTS = {
    "prices": ("price-history", "ticker string, date date, close double"),
    "filings": ("filings", "ticker string, date date, form string, link string"),
    "estimates": ("estimates", "ticker string, date date, eps_avg double, eps_high double, eps_low double, revenue_avg double"),
    "market_cap": ("market-cap", "ticker string, date date, market_cap double"),
    "grades": ("grades", "ticker string, date date, grade string"),
    "income": ("income", "ticker string, date date, period string, eps double, revenue double"),
    "balance": ("balance", "ticker string, date date, period string, assets double, liabilities double"),
    "cash_flow": ("cash-flow", "ticker string, date date, period string, free_cash_flow double"),
    "splits": ("splits", "ticker string, date date, numerator double, denominator double"),
    "report": ("report", "ticker string, date date, sections int"),
}
PAGED = ("filings",)


def draw(*key: object, of: int = 10_000) -> int:
    return int.from_bytes(hashlib.blake2b("|".join(map(str, key)).encode(), digest_size=4).digest(), "big") % of


def made_up(endpoint: str, params: dict) -> tuple[int, object]:
    """Answers from digests of symbol and day: weekdays for prices, a quarter's first day for the rest; filings come in pages of four."""
    symbol, d, end = params["symbol"], date.fromisoformat(params["from"]), date.fromisoformat(params["to"])
    days = [d + timedelta(i) for i in range((end - d).days + 1)]
    if endpoint == "price-history":
        rows = [{"date": str(x), "close": 50 + int.from_bytes(hashlib.blake2b(f"{symbol}{x}".encode(), digest_size=4).digest(), "big") % 10_000 / 100} for x in days if x.weekday() < 5]
        return 200, {"historical": rows[::-1]}
    quarters = [x for x in days if x.day == 1 and x.month % 3 == 1]
    if endpoint == "filings":
        rows = [{"date": str(x), "form": "10-K" if x.month == 1 else "10-Q", "link": f"{symbol}/{x}"} for x in quarters]
        return 200, rows[4 * params["page"] : 4 * params["page"] + 4]
    n = lambda x, k: draw(symbol, endpoint, x, k) / 100
    of = {
        "estimates": lambda x: {"eps_avg": n(x, 0), "eps_high": n(x, 0) + 1, "eps_low": n(x, 0) - 1, "revenue_avg": n(x, 1) * 1e9},
        "market-cap": lambda x: {"market_cap": n(x, 0) * 1e9},
        "grades": lambda x: {"grade": ("buy", "hold", "sell")[draw(symbol, x, of=3)]},
        "income": lambda x: {"period": f"Q{(x.month + 2) // 3}", "eps": n(x, 0), "revenue": n(x, 1) * 1e9},
        "balance": lambda x: {"period": f"Q{(x.month + 2) // 3}", "assets": n(x, 0), "liabilities": n(x, 1)},
        "cash-flow": lambda x: {"period": f"Q{(x.month + 2) // 3}", "free_cash_flow": n(x, 0)},
        "splits": lambda x: {"numerator": 1.0 + draw(symbol, x, of=3), "denominator": 1.0},
        "report": lambda x: {"sections": draw(symbol, x, of=20)},
    }[endpoint]
    return 200, [{"date": str(x), **of(x)} for x in quarters]


class Client:
    """Asks ``fetch``; ``per_minute`` calls at most, a call that is answered 429 once more after a pause, ``tries`` times."""

    def __init__(self, fetch: Fetch = made_up, per_minute: float = 700, pause: float = 60.0, tries: int = 5, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic) -> None:
        self.fetch, self.interval, self.pause, self.tries, self.sleep, self.clock, self.next = fetch, 60.0 / per_minute, pause, tries, sleep, clock, -1e18

    def ask(self, endpoint: str, params: dict) -> object:
        for _ in range(self.tries):
            left = self.next - self.clock()
            if left > 0:
                self.sleep(left)
            self.next = self.clock() + self.interval
            status, body = self.fetch(endpoint, params)
            if status == 429:
                self.sleep(self.pause)
            elif status >= 400:
                raise RuntimeError(f"{endpoint}: status {status}")
            else:
                return body
        raise RuntimeError(f"{endpoint}: still told to slow down after {self.tries} calls")

    def rows(self, endpoint: str, params: dict, paged: bool = False) -> list[dict]:
        """The answer's rows by date; an answer in an envelope is opened, and one that is no list has none."""
        out, page = [], 0
        while True:
            body = self.ask(endpoint, params | ({"page": page} if paged else {}))
            body = body.get("historical") if isinstance(body, dict) else body
            out += body if isinstance(body, list) else []
            page += 1
            if not paged or not body:
                return sorted(out, key=lambda r: r["date"])


class Symbol(InputPartition):
    """One symbol's dates ``since`` to ``until``."""

    def __init__(self, name: str, since: date, until: date) -> None:
        self.name, self.since, self.until = name, since, until


def ranges(symbols: Iterable[str], start: date, end: date, days: int) -> list[Symbol]:
    """Partitions of at most ``days`` days each, so that one symbol's pages are not one task."""
    out = []
    while start <= end:
        until = min(end, start + timedelta(days - 1))
        out += [Symbol(s, start, until) for s in symbols]
        start = until + timedelta(1)
    return out


class MarketData(DataSource):
    """Options: dataset (prices), symbols (comma-separated), start, end, form (filings), per_minute, span_days (of a partition, 366), pushdown (see ``PushedReader``)."""

    #: Replaced in tests and by users with a fetcher of their own.
    fetch: Fetch = staticmethod(made_up)

    @classmethod
    def name(cls) -> str:
        return "market_data"

    def schema(self) -> str:
        return ENDPOINTS[self.options.get("dataset", "prices")][1]

    def reader(self, schema) -> DataSourceReader:
        kind = PushedReader if self.options.get("pushdown", "false").lower() == "true" else MarketReader
        return kind(self.options, [f.name for f in schema.fields], type(self).fetch)

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802  Spark's name
        return MarketStream(self.options, [f.name for f in schema.fields], type(self).fetch)


class MarketPrices(MarketData):
    """The prices alone."""

    @classmethod
    def name(cls) -> str:
        return "market_prices"


class Asking:
    """What readers of batches and streams share."""

    def __init__(self, options, names: list[str], fetch: Fetch = made_up) -> None:
        self.dataset, self.names, self.fetch = options.get("dataset", "prices"), names, fetch
        self.symbols = [x for x in options.get("symbols", "").split(",") if x]
        self.start, self.end = date.fromisoformat(options["start"]), date.fromisoformat(options["end"])
        self.form, self.per_minute, self.days, self.parts = options.get("form"), float(options.get("per_minute", 700)), int(options.get("span_days", 366)), 1

    def between(self, start: date, end: date) -> list[InputPartition]:
        out = ranges(self.symbols, start, end, self.days)
        self.parts = max(1, len(out))
        return out

    def read(self, partition: Symbol) -> Iterator[tuple]:
        endpoint, _ = ENDPOINTS[self.dataset]
        params = {"symbol": partition.name, "from": str(partition.since), "to": str(partition.until)}
        for r in Client(self.fetch, self.per_minute / self.parts).rows(endpoint, params, self.dataset in PAGED):
            if self.form is None or r.get("form") == self.form:
                own = {**r, "ticker": partition.name, "date": date.fromisoformat(r["date"])}
                yield tuple(own.get(n) for n in self.names)


class MarketReader(Asking, DataSourceReader):
    def partitions(self) -> list[InputPartition]:
        return self.between(self.start, self.end)


class MarketStream(Asking, DataSourceStreamReader):
    """Days as offsets: a batch holds the days from the last offset up to today, or to the option ``end`` if that comes first, cut as in a batch read."""

    today = staticmethod(date.today)

    def initialOffset(self) -> dict:  # noqa: N802  Spark's name
        return {"day": str(self.start)}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"day": str(max(self.start, min(self.end, self.today()) + timedelta(1)))}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return self.between(date.fromisoformat(start["day"]), date.fromisoformat(end["day"]) - timedelta(1))

    def commit(self, end: dict) -> None:
        """What has been read can be asked for again at any time: nothing is held."""


class PushedReader(MarketReader):
    """Takes filters; Spark allows it only where ``spark.sql.python.filterPushdown.enabled`` is set."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Bounds of the date and single symbols narrow what is asked for; the others are Spark's."""
        one = timedelta(1)
        for f in filters:
            kind, column, value = type(f), getattr(f, "attribute", None), getattr(f, "value", None)
            if column == ("date",) and kind in (GreaterThanOrEqual, GreaterThan, EqualTo, LessThanOrEqual, LessThan):
                if kind in (GreaterThanOrEqual, GreaterThan, EqualTo):
                    self.start = max(self.start, value + one if kind is GreaterThan else value)
                if kind in (LessThanOrEqual, LessThan, EqualTo):
                    self.end = min(self.end, value - one if kind is LessThan else value)
            elif column == ("ticker",) and kind is EqualTo:
                self.symbols = [s for s in self.symbols if s == value]
            else:
                yield f
