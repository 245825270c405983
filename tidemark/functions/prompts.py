"""Prompts as column expressions: what is missing says so."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NA = "N/A"
#: Numbers whose whole part is a long for certain.
LARGE = 1e18


def fixed(c: Column, form: str) -> Column:
    """``c`` in ``form`` (``%.1f`` or ``%.2f``, with ``+`` if wanted) as C formats it: by the number's exact binary value, halves to even. The JVM rounds the shortest decimals that give the number
    (2.675 is a little less than that). Other forms are the JVM's.

    The product of the fraction by the power of ten is split into a double and its exact error, so that what lies beside a half is told from it.
    """
    digits = {"%.1f": 1, "%+.1f": 1, "%.2f": 2, "%+.2f": 2}.get(form)
    if digits is None:
        return F.format_string(form, c)
    x, ten = F.abs(c.cast("double")), 10**digits
    rest = x - F.floor(x)
    split = rest * F.lit(134217729.0)
    high = split - (split - rest)
    product = rest * F.lit(float(ten))
    error = (high * F.lit(float(ten)) - product) + (rest - high) * F.lit(float(ten))
    below = F.floor(product)
    beyond = (product - below - F.lit(0.5)) + error
    n = below + F.when((beyond > 0) | ((beyond == 0) & (below % 2 == 1)), 1).otherwise(0)
    sign = F.when(c < 0, "-").otherwise("+" if "+" in form else "")
    text = F.concat(sign, (F.floor(x) + F.when(n == ten, 1).otherwise(0)).cast("string"), F.lit("."), F.lpad((n % ten).cast("string"), digits, "0"))
    return F.when((x > 0) & (x < LARGE), text).otherwise(F.format_string(form, c))


def truthy(c: Column, form: str, scale: float | None = None) -> Column:
    """The number in ``form``; ``N/A`` for none, and for 0."""
    return F.when(F.coalesce(c, F.lit(0)) != 0, fixed(c if scale is None else c * scale, form)).otherwise(NA)


def given(c: Column, form: str) -> Column:
    """The number in ``form``; ``N/A`` for none only."""
    return F.coalesce(F.when(c.isNotNull(), fixed(c, form)), F.lit(NA))


def text_or(c: Column, default: str) -> Column:
    return F.when(F.coalesce(c, F.lit("")) != "", c).otherwise(default)


def top_risks(risks: Column) -> Column:
    """The first three severe risks, or, without any, the first three: category and 100 characters of each."""
    severe = F.filter(risks, lambda r: r["severity"] == "high")
    three = F.slice(F.when(F.size(severe) > 0, severe).otherwise(risks), 1, 3)
    said = F.transform(three, lambda r: F.concat(r["category"], F.lit(": "), F.left(r["description"], F.lit(100))))
    return F.when(F.coalesce(F.size(risks), F.lit(0)) > 0, F.array_join(said, "; ")).otherwise(NA)


def events(c: Column) -> Column:
    """The first five."""
    return F.when(F.coalesce(F.size(c), F.lit(0)) > 0, F.array_join(F.slice(c, 1, 5), ", ")).otherwise("No significant events")


def view_prompt() -> Column:
    """The question for a view, of the columns ticker, view_date, fiscal_period, sector, annual_date, risks, risk_summary, annual_events, quarterly_date,
    sentiment, rationale, direction, revenue_outlook, earnings_outlook, quarterly_events, eps, eps_avg, eps_surprise, revenue, revenue_avg, revenue_surprise,
    analysts, dispersion, ret_1m, ret_3m and vol_60d."""
    c = F.col
    n = F.coalesce(F.size("risks"), F.lit(0))
    summary = F.when(n <= 0, "No significant risks identified").otherwise(F.when(F.coalesce(c("risk_summary"), F.lit("")) != "", c("risk_summary")).otherwise(F.concat(n.cast("string"), F.lit(" risk factors identified"))))
    lines = [
        ["Company: ", c("ticker"), " (", text_or(c("sector"), "Unknown"), "), view of ", c("view_date").cast("string"), " after ", c("fiscal_period")],
        ["Annual report of ", text_or(c("annual_date").cast("string"), NA), ". Risks: ", summary, ". Foremost: ", top_risks(c("risks")), ". Events: ", events(c("annual_events"))],
        ["Quarterly report of ", text_or(c("quarterly_date").cast("string"), NA), ". Tone: ", text_or(c("sentiment"), "neutral"), " - ", text_or(c("rationale"), "No rationale provided")],
        ["Guidance: ", text_or(c("direction"), "Not provided"), "; revenue: ", text_or(c("revenue_outlook"), "Not specified"), "; earnings: ", text_or(c("earnings_outlook"), "Not specified")],
        ["Events: ", events(c("quarterly_events"))],
        ["EPS ", truthy(c("eps"), "%.2f"), " against ", truthy(c("eps_avg"), "%.2f"), ", surprise ", truthy(c("eps_surprise"), "%+.1f"), " %"],
        ["Revenue ", truthy(c("revenue"), "%.1f"), " against ", truthy(c("revenue_avg"), "%.1f"), " bn, surprise ", truthy(c("revenue_surprise"), "%+.1f"), " %"],
        ["Analysts ", truthy(c("analysts"), "%d"), ", dispersion ", truthy(c("dispersion"), "%.1f", 100.0), " %"],
        ["Returns ", given(c("ret_1m"), "%+.1f"), " % and ", given(c("ret_3m"), "%+.1f"), " %, volatility ", given(c("vol_60d"), "%.1f"), " %"],
        ["Answer in JSON with view_bps (-300 to 300), confidence (high, medium or low) and reasoning."],
    ]
    return F.concat_ws("\n", *[F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in line]) for line in lines])
