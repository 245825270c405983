"""The domain's tables as DuckDB common table expressions, for the queries' SQL equivalents."""

from __future__ import annotations

W = "PARTITION BY ticker ORDER BY date"

#: name -> (needs, body)
CTE: dict[str, tuple[list[str], str]] = {
    "raw": ([], "SELECT p_brand AS ticker, l_shipdate::DATE AS date, sum(l_extendedprice::DECIMAL(15,2))::DOUBLE / count(*) AS px FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2"),
    "universe": ([], "SELECT ticker, row_number() OVER (ORDER BY ticker) AS ord FROM (SELECT DISTINCT p_brand AS ticker FROM part)"),
    "dense": (["raw"], "SELECT t.ticker, d.date, raw.px FROM (SELECT DISTINCT date FROM raw) d CROSS JOIN (SELECT DISTINCT ticker FROM raw) t LEFT JOIN raw ON raw.ticker = t.ticker AND raw.date = d.date"),
    "smooth": (["dense"], f"SELECT ticker, date, avg(px) OVER ({W} ROWS BETWEEN 20 PRECEDING AND CURRENT ROW) AS c FROM dense"),
    "prices": (["smooth"], f"SELECT ticker, date, last_value(c IGNORE NULLS) OVER ({W} ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS close FROM smooth"),
    "padded": (["prices"], f"SELECT ticker, date, last_value(close IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p FROM prices"),
    "allrets": (["padded"], f"SELECT ticker, date, p / nullif(lag(p) OVER ({W}), 0) - 1 AS ret FROM padded"),
    "rets": (["allrets", "universe"], "SELECT * FROM allrets WHERE ret IS NOT NULL AND date IN (SELECT date FROM allrets GROUP BY date HAVING count(ret) = (SELECT count(*) FROM universe))"),
    "views": (
        [],
        """SELECT p_brand AS ticker, o_orderdate::DATE + 1 AS view_date, (((round(o_totalprice * 100)::BIGINT % 601) + 601) % 601 - 300)::INT AS view_bps,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'high' WHEN '5-LOW' THEN 'low' ELSE 'medium' END AS confidence,
    CASE o_orderstatus WHEN 'F' THEN '10-K' ELSE '10-Q' END AS filing_type,
    CASE o_orderpriority WHEN '2-HIGH' THEN 'confident' WHEN '3-MEDIUM' THEN 'concerned' ELSE 'neutral' END AS sentiment, o_orderkey AS seq
    FROM orders JOIN (SELECT l_orderkey, min(l_partkey) AS pk FROM lineitem WHERE l_linenumber = 1 GROUP BY 1) f ON f.l_orderkey = o_orderkey JOIN part ON p_partkey = pk""",
    ),
    "rebal": (
        [],
        """SELECT DISTINCT (d - greatest(0, isodow(d) - 5)::INT)::DATE AS rebal_date FROM (SELECT last_day(m::DATE) AS d FROM range(TIMESTAMP '1995-01-01', TIMESTAMP '2002-01-01', INTERVAL 1 MONTH) t(m) WHERE month(m) IN (3, 6, 9, 12))
    WHERE d - greatest(0, isodow(d) - 5)::INT BETWEEN DATE '1995-01-01' AND DATE '2001-12-31'""",
    ),
    "days": (["rets"], "SELECT DISTINCT date FROM rets"),
    "periods": (
        ["rebal", "days"],
        """SELECT rebal_date, trade_date, until FROM (SELECT *, coalesce(lead(trade_date) OVER (ORDER BY rebal_date), (SELECT max(date) FROM days)) AS until FROM (
    SELECT rebal_date, (SELECT min(date) FROM days WHERE date > rebal_date) AS trade_date, (SELECT count(*) FROM days WHERE date <= rebal_date) AS n FROM rebal) WHERE trade_date IS NOT NULL AND n > 0) WHERE n >= 262""",
    ),
    "active": (
        ["views", "periods", "universe"],
        """SELECT * EXCLUDE (k) FROM (SELECT p.rebal_date, v.*, row_number() OVER (PARTITION BY p.rebal_date, v.ticker ORDER BY view_date DESC, seq DESC) AS k
    FROM periods p JOIN views v ON v.view_date <= p.rebal_date JOIN universe USING (ticker)) WHERE k = 1 AND rebal_date - view_date <= 120""",
    ),
    "ew": (["periods", "universe"], "SELECT rebal_date, ticker, 1.0::DOUBLE / (SELECT count(*) FROM universe) AS w FROM periods CROSS JOIN universe"),
    "topn": (
        ["active", "universe", "ew"],
        """SELECT rebal_date, ticker, 1.0::DOUBLE / count(*) OVER (PARTITION BY rebal_date) AS w FROM (SELECT *, row_number() OVER (PARTITION BY rebal_date ORDER BY view_bps DESC, ord) AS k FROM active JOIN universe USING (ticker)) WHERE k <= 10
    UNION ALL SELECT * FROM ew WHERE rebal_date NOT IN (SELECT rebal_date FROM active)""",
    ),
    "botn": (
        ["active", "universe", "ew"],
        """SELECT rebal_date, ticker, 1.0::DOUBLE / count(*) OVER (PARTITION BY rebal_date) AS w FROM (SELECT *, row_number() OVER (PARTITION BY rebal_date ORDER BY view_bps, ord) AS k FROM active JOIN universe USING (ticker)) WHERE k <= 10
    UNION ALL SELECT * FROM ew WHERE rebal_date NOT IN (SELECT rebal_date FROM active)""",
    ),
    "weights": (["ew", "topn", "botn"], "SELECT 'equal_weight' AS strategy, * FROM ew UNION ALL SELECT 'top_n_views', * FROM topn UNION ALL SELECT 'bottom_n_views', * FROM botn"),
    "held": (
        ["rets", "periods", "weights"],
        """SELECT strategy, rebal_date, ticker, date, w * exp(sum(ln(1 + ret)) OVER (PARTITION BY strategy, rebal_date, ticker ORDER BY date ROWS UNBOUNDED PRECEDING)) AS wg
    FROM rets JOIN periods ON date >= trade_date AND date < until JOIN weights USING (rebal_date, ticker) WHERE w <> 0""",
    ),
    "value": (["held"], "SELECT strategy, rebal_date, date, sum(wg) AS v FROM held GROUP BY ALL"),
    "gross": (["value"], "SELECT strategy, rebal_date, date, v / coalesce(lag(v) OVER p, 1) - 1 AS g, row_number() OVER p = 1 AS is_first FROM value WINDOW p AS (PARTITION BY strategy, rebal_date ORDER BY date)"),
    "wend": (
        ["held", "value"],
        """SELECT strategy, rebal_date, ticker, wg / v AS we FROM held JOIN value USING (strategy, rebal_date, date) WHERE (strategy, rebal_date, date) IN (SELECT (strategy, rebal_date, max(date)) FROM value GROUP BY strategy, rebal_date)""",
    ),
    "ran": (["value"], "SELECT strategy, rebal_date, lag(rebal_date) OVER (PARTITION BY strategy ORDER BY rebal_date) AS prev FROM (SELECT DISTINCT strategy, rebal_date FROM value)"),
    "turns": (
        ["ran", "wend", "weights", "universe"],
        """SELECT strategy, rebal_date, sum(abs(coalesce(w, 0) - coalesce(o, 0))) AS turnover FROM (
    SELECT coalesce(a.strategy, b.strategy) AS strategy, coalesce(a.rebal_date, b.rebal_date) AS rebal_date, w, o FROM (SELECT weights.* FROM weights JOIN ran USING (strategy, rebal_date)) a FULL JOIN
    (SELECT ran.strategy, ran.rebal_date, wend.ticker, we AS o FROM ran JOIN wend ON wend.strategy = ran.strategy AND wend.rebal_date = ran.prev UNION ALL SELECT strategy, rebal_date, ticker, 1.0::DOUBLE / (SELECT count(*) FROM universe) FROM ran CROSS JOIN universe WHERE prev IS NULL) b
    ON a.strategy = b.strategy AND a.rebal_date = b.rebal_date AND a.ticker = b.ticker) GROUP BY ALL""",
    ),
    "net": (["gross", "turns"], "SELECT strategy, date, g - CASE WHEN is_first THEN turnover * 10 / 1e4 ELSE 0 END AS ret FROM gross JOIN turns USING (strategy, rebal_date)"),
    "feats": (
        ["prices"],
        f"""SELECT ticker, date, CASE WHEN n >= 63 THEN close / lag(close, 21) OVER p * 100 - 100 END AS ret_1m, CASE WHEN n >= 64 THEN close / lag(close, 63) OVER p * 100 - 100 END AS ret_3m,
    CASE WHEN n >= 63 THEN stddev_samp(r) OVER ({W} ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) * sqrt(252) * 100 END AS vol_60d
    FROM (SELECT *, row_number() OVER ({W}) AS n, close / lag(close) OVER ({W}) - 1 AS r FROM prices WHERE close IS NOT NULL) WINDOW p AS ({W})""",
    ),
    "fwd": (["prices"], f"SELECT ticker, date, CASE WHEN close > 0 THEN lead(close, 63) OVER ({W}) / close - 1 END AS fwd FROM prices WHERE close IS NOT NULL"),
    "scored": (
        ["views", "fwd"],
        """SELECT ticker, view_date, seq, view_bps, confidence, fwd, date_trunc('quarter', view_date)::DATE AS q,
    fwd - avg(fwd) OVER (PARTITION BY date_trunc('quarter', view_date)) AS fwd_excess FROM views ASOF LEFT JOIN fwd ON views.ticker = fwd.ticker AND fwd.date >= views.view_date""".replace("SELECT ticker", "SELECT views.ticker"),
    ),
}


def sql(final: str, *needs: str, **own: str) -> str:
    """``final`` after the named tables and those they need; ``own``: further ones, in order."""
    done: dict[str, str] = {}

    def add(name: str) -> None:
        if name not in done:
            for x in CTE[name][0]:
                add(x)
            done[name] = CTE[name][1]

    for name in needs:
        add(name)
    done |= own
    return "WITH " + ",\n".join(f"{k} AS ({v})" for k, v in done.items()) + "\n" + final
