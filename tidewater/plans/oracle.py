"""SQL twins of the adapters, and helpers that write window expressions."""

from __future__ import annotations

BARS = """
bars AS (
  SELECT l_suppkey AS ticker, CAST(date_trunc('week', l_shipdate) AS DATE) AS date,
         arg_min(l_extendedprice / l_quantity, (l_shipdate, l_orderkey, l_linenumber, l_extendedprice / l_quantity)) AS open,
         max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
         CAST(sum(CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT)) AS DOUBLE) / 100 / sum(l_quantity) AS close, CAST(sum(CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT)) AS DOUBLE) / 100 AS volume
  FROM lineitem WHERE l_quantity > 0 GROUP BY 1, 2)"""

PANEL = f"""{BARS},
dense AS (
  SELECT g.date, g.ticker, last_value(open IGNORE NULLS) OVER w AS open, last_value(high IGNORE NULLS) OVER w AS high, last_value(low IGNORE NULLS) OVER w AS low,
         last_value(close IGNORE NULLS) OVER w AS close, volume
  FROM (SELECT ticker, date FROM (SELECT DISTINCT ticker FROM bars), (SELECT DISTINCT date FROM bars)) g LEFT JOIN bars b ON b.ticker = g.ticker AND b.date = g.date
  WINDOW w AS (PARTITION BY g.ticker ORDER BY g.date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
panel AS (SELECT *, round(close / lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1, 9) AS ret FROM dense)"""

MARKET = """
weekly AS (SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS date, CAST(sum(CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT)) AS DOUBLE) / 100 / sum(l_quantity) AS level, CAST(sum(CAST(floor(l_tax * 100 + 0.5) AS BIGINT)) AS DOUBLE) / 100 / count(l_tax) / 52 AS rate FROM lineitem WHERE l_quantity > 0 GROUP BY 1),
market AS (SELECT *, round(level / lag(level) OVER (ORDER BY date) - 1, 9) AS mret FROM weekly)"""

FILINGS = """
base AS (SELECT o_custkey AS company, CAST(o_orderdate AS DATE) AS filing_date, o_orderkey AS filing_id, o_orderstatus, o_totalprice, o_orderpriority,
                last_day(CAST(CAST(o_orderdate AS DATE) - INTERVAL 2 MONTH AS DATE)) AS period_end FROM orders),
filings AS (SELECT company, period_end, filing_date, row_number() OVER (PARTITION BY company, period_end ORDER BY filing_date, filing_id) AS version,
                   CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'DFP' ELSE 'ITR' END AS doc_type,
                   CASE WHEN o_orderstatus = 'F' THEN o_totalprice END AS net_income, CASE WHEN o_orderstatus = 'O' THEN o_totalprice END AS equity,
                   CASE WHEN o_orderstatus = 'P' THEN o_totalprice END AS shares, filing_id FROM base)"""

SPLITS = """
splits AS (SELECT l_suppkey AS ticker, CAST(l_shipdate AS DATE) AS ex_date, max(l_quantity) AS factor FROM lineitem
           WHERE l_returnflag = 'A' AND l_linenumber = 1 AND l_quantity IN (2, 3, 4, 5, 10) GROUP BY 1, 2)"""

CASH = """
cash AS (SELECT l_suppkey AS ticker, CAST(l_shipdate AS DATE) AS ex_date, round(sum(l_discount * l_extendedprice / l_quantity), 6) AS value FROM lineitem
         WHERE l_returnflag = 'R' AND l_quantity > 0 GROUP BY 1, 2)"""

PNL = """
pnl AS (SELECT user_id AS account, CAST(ts AS DATE) AS period, round(sum(CASE WHEN event_type IN ('error', 'view') THEN -value ELSE value END), 6) AS pnl, round(sum(value), 6) AS sales FROM events GROUP BY 1, 2)"""


def roll(fn: str, x: str, n: int, least: int | None = None, key: str = "ticker") -> str:
    call = fn.format(x) if "{" in fn else f"{fn}({x})"
    f = f"OVER (PARTITION BY {key} ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {f} >= {n if least is None else least} THEN {call} {f} END"


def lag(x: str, n: int = 1, key: str = "ticker") -> str:
    return f"lag({x}, {n}) OVER (PARTITION BY {key} ORDER BY date)"


def pct_rank(x: str, across: str) -> str:
    return (f"CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY {across} ORDER BY {x} NULLS LAST) + (count(*) OVER (PARTITION BY {across}, {x}) - 1) / 2.0) "
            f"/ count({x}) OVER (PARTITION BY {across}) END")


def corr(x: str, y: str) -> str:
    """Over rows where both are known; the caller filters."""
    return f"covar_samp({x}, {y}) / nullif(stddev_samp({x}) * stddev_samp({y}), 0)"
