"""All queries of the library, with their SQL equivalents."""

from __future__ import annotations

from tidemark.plans import filings, market, studies

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _part in (market, filings, studies):
    QUERIES |= _part.Q
    ORACLES |= _part.SQL
