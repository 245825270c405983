"""Scalar rules as column expressions: periods, coercions, surprises, clamps, sigmas, prices of tokens."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The categories that facts may carry.
RISK_CATEGORIES = (
    "competition", "regulatory", "supply_chain", "cybersecurity", "macroeconomic", "market", "credit", "liquidity", "operational", "financial",
    "investment", "legal", "environmental", "geopolitical", "technology", "reputation", "strategic", "labor", "other",
)
SEVERITIES = ("high", "medium", "low")
SENTIMENTS = ("confident", "optimistic", "neutral", "cautious", "concerned")
CONFIDENCES = ("high", "medium", "low")
NULL_STRINGS = ("null", "none", "n/a", "na", "")
SIGMA = {"high": 0.01, "medium": 0.03, "low": 0.05}


def from_bps(c: Column) -> Column:
    return c / F.lit(1e4)


def clamp_int(c: Column, low: int = -300, high: int = 300) -> Column:
    """Truncated towards zero, then bounded."""
    return F.greatest(F.lit(low), F.least(F.lit(high), c.cast("double").cast("int")))


def clamp_round(c: Column, low: int = -300, high: int = 300) -> Column:
    """Rounded half to even and bounded; 0 where it is no number, or none that is finite."""
    d = c.try_cast("double")
    d = F.when(F.abs(d) < float("inf"), d).otherwise(0.0)
    return F.greatest(F.lit(low), F.least(F.lit(high), F.bround(F.greatest(F.lit(-1e6), F.least(F.lit(1e6), d))).cast("int")))


def coerce(c: Column, allowed: Sequence[str], default: str | None) -> Column:
    """Trimmed, lower-cased, blanks and hyphens as underscores; the default where it is none of ``allowed``."""
    v = F.translate(F.lower(F.trim(c)), " -", "__")
    return F.when(v.isin(*allowed), v).otherwise(F.lit(default))


def coerce_confidence(c: Column) -> Column:
    v = F.lower(F.trim(c))
    return F.when(v.isin(*CONFIDENCES), v).otherwise("medium")


def clean_null(c: Column) -> Column:
    """NULL for the strings that mean it; not trimmed first."""
    return F.when(F.lower(c).isin(*NULL_STRINGS), None).otherwise(c)


def fiscal_period(form: Column, d: Column) -> Column:
    """The period a filing reports on, from its form and date; every form but ``10-K`` is quarterly, ``Unknown`` where the date is none."""
    y, m = F.year(d), F.month(d)
    say = lambda label, year: F.concat(F.lit(label), year.cast("string"))
    k = F.when(m <= 3, say("FY ", y - 1)).otherwise(say("FY ", y))
    q = F.when(m <= 3, say("Q4 ", y - 1)).when(m <= 6, say("Q1 ", y)).when(m <= 9, say("Q2 ", y)).otherwise(say("Q3 ", y))
    return F.coalesce(F.when(form.eqNullSafe(F.lit("10-K")), k).otherwise(q), F.lit("Unknown"))


def filing_quarter(form: Column, d: Column) -> Column:
    """``YYYY-Qn`` of a ``10-Q``, the year of a ``10-K``; NULL for other forms."""
    y, m = F.year(d), F.month(d)
    say = lambda year, n: F.concat(year.cast("string"), F.lit(f"-Q{n}"))
    q = F.when(m <= 3, say(y - 1, 4)).when(m <= 6, say(y, 1)).when(m <= 9, say(y, 2)).otherwise(say(y, 3))
    return F.when(form == "10-K", y.cast("string")).when(form == "10-Q", q)


def normalise_period(c: Column) -> Column:
    """``FY 2023`` -> ``FY2023``, ``Q1 2024`` and ``Q12024`` -> ``Q1_2024``, ``Unknown`` for none; what begins otherwise as it came.

    What begins so is trimmed and upper-cased; of a year's one blank is left out after each ``FY``, of a quarter's the first blank is the underscore.
    """
    u = F.upper(F.regexp_replace(c, r"^\s+|\s+$", ""))
    one = F.regexp_replace(u, r"FY ", "FY")
    quarter = F.lit(None).cast("string")
    for q in ("Q1", "Q2", "Q3", "Q4"):
        v = F.regexp_replace(u, f"{q} ", f"{q}_")
        quarter = F.when(u.startswith(q), F.when(v.contains("_"), v).otherwise(F.concat(F.left(v, F.lit(2)), F.lit("_"), F.substring(v, 3, 1 << 30)))).otherwise(quarter)
    return F.when(F.coalesce(c, F.lit("")) == "", "Unknown").when(u.startswith("FY"), one).otherwise(F.coalesce(quarter, c))


def study_period(year: Column, first: int = 2006, width: int = 5, n: int = 4) -> Column:
    out = F.lit(None).cast("string")
    for i in range(n):
        out = F.when(year.between(first + i * width, first + (i + 1) * width - 1), f"{first + i * width}-{first + (i + 1) * width - 1}").otherwise(out)
    return out


def surprise_pct(actual: Column, estimate: Column) -> Column:
    """(a - e) / |e| * 100; NULL if e is 0 or NULL."""
    return F.try_divide(actual - estimate, F.nullif(F.abs(estimate), F.lit(0.0))) * 100


def revenue_surprise_pct(actual: Column, estimate: Column) -> Column:
    return F.when(actual != 0, surprise_pct(actual, estimate))


def unless_extreme(c: Column, surprise: Column, limit: float = 200.0) -> Column:
    """NULL where the surprise is beyond ``limit`` percent."""
    return F.when(F.coalesce(F.abs(surprise) > limit, F.lit(False)), None).otherwise(c)


def dispersion(high: Column, low: Column, avg: Column) -> Column:
    return F.try_divide(high - low, F.nullif(F.abs(avg), F.lit(0.0)))


def billions(c: Column) -> Column:
    """0 counts as missing."""
    return F.nullif(c, F.lit(0.0)) / 1e9


def first_nonzero(a: Column, b: Column) -> Column:
    return F.coalesce(F.nullif(a, F.lit(0.0)), b)


def sigma(confidence: Column) -> Column:
    out = F.lit(SIGMA["medium"])
    for k, v in SIGMA.items():
        out = F.when(confidence == k, v).otherwise(out)
    return out


def calibrated_sigma(confidence: Column, disp: Column, sentiment: Column) -> Column:
    """x 1.5 where analysts disagree (dispersion over 0.3), x 0.8 where the tone, in any case of letters, is pronounced."""
    wide = F.when(F.coalesce(disp > 0.3, F.lit(False)), 1.5).otherwise(1.0)
    sure = F.when(F.coalesce(F.lower(sentiment).isin("confident", "concerned"), F.lit(False)), 0.8).otherwise(1.0)
    return sigma(confidence) * wide * sure


def sigma_to_confidence(s: Column) -> Column:
    return F.when(s <= 0.015, "high").when(s <= 0.04, "medium").otherwise("low")


def tone(pos: Column, neg: Column) -> Column:
    return F.coalesce(F.try_divide(pos - neg, pos + neg), F.lit(0.0))


def tone_label(t: Column) -> Column:
    return F.when(t > 0, "positive").when(t < 0, "negative").otherwise("neutral")


def token_cost(tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column) -> Column:
    """Prices are per million tokens."""
    return (tokens_in * price_in + tokens_out * price_out) / 1e6


def or_na(c: Column, suffix: str = "", zero_is_missing: bool = False, digits: int | None = None) -> Column:
    v = F.nullif(c, F.lit(0.0)) if zero_is_missing else c
    text = v.cast("string") if digits is None else F.format_string(f"%.{digits}f", v)
    return F.when(v.isNull(), "N/A" if zero_is_missing else "n/a").otherwise(F.concat(text, F.lit(suffix)))


def add_years(d: Column, n: int) -> Column:
    """29 February goes to the 28th."""
    return F.add_months(d, 12 * n)
