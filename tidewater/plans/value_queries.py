"""Two-leg value: financial companies and all others ranked each by their own multiple, and the blend that nests the book.

Stand-in: every fifth company has no EBITDA, as banks have none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import fundamentals as fu
from ..operators import identity, index
from . import adapters as a
from . import index_queries as ix
from . import sweep_queries
from .oracle import pct_rank
from .registry import half_up, query

# Rows of the median turnover, its floor scaled to the given tables, names needed to start, chosen names.
WINDOW, MIN_VOLUME, LEAST, N, MAX_AGE, MIN_ROE, MAX_PE = 42, 10_000.0, 5, 20, 180, 0.08, 20.0


def figures(spark, sf) -> DataFrame:
    """Filings with EBITDA, net debt and revenue, and income with the period it is from."""
    priority = a.table(spark, sf, "orders").select(F.col("o_orderkey").alias("filing_id"), "o_orderpriority", "o_totalprice")
    f = ix.filings(spark, sf).join(priority, "filing_id").withColumns({k: F.when(F.col("o_orderpriority") == v, F.col("o_totalprice")) for k, v in sweep_queries.FIGURES.items()})
    return f.withColumns({"ebitda": F.when(F.col("root") % 5 != 0, F.col("ebitda")), "earned": F.when(F.col("net_income").isNotNull(), F.col("period_end"))})


def two_legs(spark, sf) -> DataFrame:
    """(date, ticker, leg, cheap, place) on the first dates from the 15th of April, June, September and December on."""
    panel = a.panel(spark, sf).select("date", "ticker", half_up("close").alias("close"), "volume")
    ends = identity.mid_quarter_dates(panel.select("date").distinct()).withColumnRenamed("rebalance", "end")
    f = figures(spark, sf)
    passed = index.constituents(index.at_dates(panel, ends, WINDOW), ix.classes(spark, sf), f, a.share_events(spark, sf), 0.0, MIN_VOLUME, earnings=False)
    known = fu.known_on(passed.withColumn("market_cap", half_up("market_cap", 2)), f, ["ebitda", "net_debt", "revenue", "earned"], key="root")
    companies = known.withColumnRenamed("earned", "period_end")
    chosen = index.two_legs(companies, MAX_AGE, MIN_ROE, MAX_PE, N)
    return index.started(chosen, LEAST)


MID = "SELECT min(date) AS td, min(k) AS last FROM idays WHERE month(date) IN (4, 6, 9, 12) AND day(date) >= 15 GROUP BY date_trunc('month', date)"
TWO_LEGS = f"""{ix.valued_sql(MID, WINDOW, MIN_VOLUME, False)},
tf AS (SELECT company % 25 AS root, filing_date, f.version, filing_id, CASE WHEN net_income IS NOT NULL THEN period_end END AS earned, CASE WHEN o_orderpriority = '5-LOW' AND company % 25 % 5 <> 0 THEN o_totalprice END AS ebitda,
  CASE WHEN o_orderpriority = '2-HIGH' THEN o_totalprice END AS net_debt, CASE WHEN o_orderpriority = '3-MEDIUM' THEN o_totalprice END AS revenue FROM filings f JOIN orders ON o_orderkey = filing_id),
td0 AS (SELECT root, filing_date, {", ".join(f"arg_max({m}, (version, filing_id)) FILTER (WHERE {m} IS NOT NULL) AS {m}" for m in ("earned", "ebitda", "net_debt", "revenue"))} FROM tf GROUP BY 1, 2),
tk AS (SELECT v.date, v.root, v.ticker, round(v.market_cap, 2) AS cap, v.net_income, v.equity, v.net_income / nullif(v.equity, 0) AS roe, {", ".join(f"CASE WHEN v.date - {m}_.filing_date <= 400 THEN {m}_.{m} END AS {m}" for m in ("earned", "ebitda", "net_debt", "revenue"))}
  FROM (SELECT * FROM iv WHERE median_volume >= market_cap * 1e-5 AND market_cap > 0) v
  {" ".join(f"ASOF LEFT JOIN (SELECT * FROM td0 WHERE {m} IS NOT NULL) {m}_ ON {m}_.root = v.root AND v.date >= {m}_.filing_date" for m in ("earned", "ebitda", "net_debt", "revenue"))}),
tm AS (SELECT *, cap / nullif(net_income * 1000, 0) AS pe, cap / nullif(equity * 1000, 0) AS pb, ebitda IS NULL OR NOT coalesce(revenue > 0, false) AS financial FROM tk WHERE date - earned <= {MAX_AGE}),
ts AS (SELECT *, CASE WHEN financial THEN 'book' ELSE 'yield' END AS leg, round(CASE WHEN financial THEN -(pe + pb) ELSE ebitda * 1000 / nullif(cap + coalesce(net_debt, 0) * 1000, 0) END, 12) AS score FROM tm WHERE pe > 0 AND (financial OR ebitda > 0)),
tr AS (SELECT *, {pct_rank('score', 'date, leg')} AS cheap FROM ts),
tp AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY cheap DESC, ticker) AS place FROM tr WHERE roe >= {MIN_ROE} AND pe <= {MAX_PE}),
legs AS (SELECT date, ticker, leg, cheap, place FROM tp WHERE place <= {N} AND date >= (SELECT min(date) FROM (SELECT date FROM tp WHERE place <= {N} GROUP BY 1 HAVING count(*) >= {LEAST})))"""


@query("two_leg_value", f"WITH {TWO_LEGS} SELECT date, ticker, leg, round(cheap, 6) AS cheap, place FROM legs")
def two_leg_value(spark, sf):
    return two_legs(spark, sf).select("date", "ticker", "leg", half_up("cheap").alias("cheap"), "place")


@query("portfolio_value_thirds", f"""WITH {TWO_LEGS}, hold AS (SELECT td AS date FROM iends), held AS (SELECT date, ticker, count(*) OVER (PARTITION BY date) AS n FROM legs)
SELECT date, CAST(ticker AS VARCHAR) AS asset, round(1.0 / 3 / n, 6) AS weight FROM held UNION ALL SELECT DISTINCT date, unnest(['cash', 'market']), round(1.0 / 3, 6) FROM held
UNION ALL SELECT date, 'cash', round(1.0, 6) FROM hold WHERE date NOT IN (SELECT date FROM held)""")
def portfolio_value_thirds(spark, sf):
    """A third in the two-leg value names, a third in the market, a third in cash, on the names' own calendar; all in cash on dates without names."""
    third = F.lit(1.0 / 3)
    names = two_legs(spark, sf).select("date", F.col("ticker").cast("string").alias("asset")).withColumn("weight", third / F.count(F.lit(1)).over(Window.partitionBy("date")))
    alive = names.select("date").distinct()
    rest = alive.select("date", F.explode(F.array(F.lit("cash"), F.lit("market"))).alias("asset"), third.alias("weight"))
    days = a.market(spark, sf).select("date", F.row_number().over(Window.orderBy("date")).alias("k"))  # one row a week
    calendar = identity.mid_quarter_dates(days.select("date")).withColumnRenamed("rebalance", "date").join(days.filter(F.col("k") >= WINDOW), "date", "left_semi")
    idle = calendar.join(alive, "date", "left_anti").select("date", F.lit("cash"), F.lit(1.0))
    return names.union(rest).union(idle).select("date", "asset", half_up("weight").alias("weight"))
