"""The capitalisation-weighted index over the weekly panel: constituents, weights, level.

Stand-ins: a company's tickers take the share classes 3, 4, 5, 6 in turn, later ones are units; every other filing splits its share count by class.
Floors are scaled to the given tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import grid, index, portfolio
from . import adapters as a
from .oracle import FILINGS, PANEL, SPLITS
from .registry import half_up, query

# Rows of the median turnover; floors of market value and turnover; names needed to start; the common part of a split share count.
WINDOW, MIN_CAP, MIN_VOLUME, LEAST, COMMON = 63, 5e7, 30_000.0, 10, 0.6


def classes(spark, sf) -> DataFrame:
    """(ticker, root, share_class)."""
    place = F.row_number().over(Window.partitionBy("root").orderBy("ticker"))
    return a.roots(spark, sf).withColumn("n", place).select("ticker", "root", F.when(F.col("n") <= 4, (F.col("n") + 2).cast("string")).otherwise("11").alias("share_class"))


def filings(spark, sf) -> DataFrame:
    split = F.col("filing_id") % 2 == 0
    f = a.filings(spark, sf).withColumn("root", (F.col("company") % 25).cast("int"))
    return f.withColumns({"shares_common": F.when(split, F.col("shares") * COMMON), "shares_preferred": F.when(split, F.col("shares") * (1 - COMMON))})


def members(spark, sf) -> DataFrame:
    """(date, root, ticker, market_cap, median_volume, net_income, equity, roe, weight) at quarter ends, once there are enough."""
    panel = a.panel(spark, sf).select("date", "ticker", half_up("close").alias("close"), "volume")
    quotes = index.at_rebalances(panel, lambda d: grid.period_end(d, "QE"), WINDOW)
    passed = index.constituents(quotes, classes(spark, sf), filings(spark, sf), a.share_events(spark, sf), MIN_CAP, MIN_VOLUME)
    return portfolio.proportional_weights(index.started(passed, LEAST), "market_cap")


def valued_sql(ends: str, rows: int, least: float, earnings: bool = True) -> str:
    """CTEs that end in ``iv``: companies with a market value, and with earnings if asked for, at the dates of ``ends``, a query (td, last) over the numbered days ``idays``."""
    return f"""{PANEL}, {FILINGS}, {SPLITS},
ip AS (SELECT date, ticker, round(close, 6) AS close, coalesce(volume, 0) AS volume FROM dense),
idays AS (SELECT date, row_number() OVER (ORDER BY date) AS k FROM (SELECT DISTINCT date FROM ip)),
iends AS (SELECT td, last FROM ({ends}) WHERE last >= {rows}),
iq AS (SELECT td AS date, ticker, quantile_cont(volume, 0.5) AS median_volume, arg_max(close, ip.date) AS close FROM iends JOIN idays ON idays.k > last - {rows} AND idays.k <= last JOIN ip ON ip.date = idays.date GROUP BY 1, 2),
icl AS (SELECT s_suppkey AS ticker, s_nationkey AS root, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS n FROM supplier),
ij AS (SELECT iq.*, root, max(CASE WHEN n = 1 THEN close END) OVER c AS common, coalesce(max(CASE WHEN n = 2 THEN close END) OVER c, max(CASE WHEN n = 3 THEN close END) OVER c, max(CASE WHEN n = 4 THEN close END) OVER c) AS preferred,
  row_number() OVER (PARTITION BY date, root ORDER BY median_volume DESC, ticker DESC) AS place FROM iq JOIN icl USING (ticker) WHERE close > 0 WINDOW c AS (PARTITION BY date, root)),
ic AS (SELECT * FROM ij WHERE place = 1 AND median_volume > {least}),
ifl AS (SELECT company % 25 AS root, filing_date, arg_max(net_income, (version, filing_id)) FILTER (WHERE net_income IS NOT NULL) AS ni, arg_max(equity, (version, filing_id)) FILTER (WHERE equity IS NOT NULL) AS eq,
  arg_max({{'s': shares, 'id': filing_id, 'p': period_end}}, (version, filing_id)) FILTER (WHERE shares IS NOT NULL) AS counts FROM filings GROUP BY 1, 2),
ik AS (SELECT ic.*, CASE WHEN ic.date - n.filing_date <= 400 THEN n.ni END AS net_income, CASE WHEN ic.date - e.filing_date <= 400 THEN e.eq END AS equity, CASE WHEN ic.date - s.filing_date <= 400 THEN s.counts END AS counts FROM ic
  ASOF LEFT JOIN (SELECT * FROM ifl WHERE ni IS NOT NULL) n ON n.root = ic.root AND ic.date >= n.filing_date
  ASOF LEFT JOIN (SELECT * FROM ifl WHERE eq IS NOT NULL) e ON e.root = ic.root AND ic.date >= e.filing_date
  ASOF LEFT JOIN (SELECT * FROM ifl WHERE counts IS NOT NULL) s ON s.root = ic.root AND ic.date >= s.filing_date),
im AS (SELECT date, root, ticker, close, median_volume, common, preferred, net_income, equity, counts.s AS shares, counts.id % 2 = 0 AS split,
  coalesce((SELECT product(factor) FROM splits x WHERE x.ticker = ik.ticker AND x.ex_date > counts.p AND x.ex_date <= ik.date), 1) AS multiplier FROM ik WHERE counts.s > 0 {'AND net_income > 0 AND equity > 0' if earnings else ''}),
iv AS (SELECT *, multiplier * CASE WHEN split THEN shares * {COMMON} * coalesce(common, preferred, close) + shares * {1 - COMMON} * coalesce(preferred, common, close) ELSE shares * close END AS market_cap FROM im)"""


QUARTERS = "SELECT max(date) AS td, max(k) AS last FROM idays GROUP BY date_trunc('quarter', date)"
CONSTITUENTS = f"""{valued_sql(QUARTERS, WINDOW, MIN_VOLUME)},
passed AS (SELECT * FROM iv WHERE median_volume >= market_cap * 1e-5 AND market_cap > {MIN_CAP}),
members AS (SELECT *, net_income / equity AS roe, market_cap / sum(market_cap) OVER (PARTITION BY date) AS weight FROM passed WHERE date >= (SELECT min(date) FROM (SELECT date FROM passed GROUP BY 1 HAVING count(*) >= {LEAST})))"""


@query("index_constituents", f"WITH {CONSTITUENTS} SELECT date, root, ticker, round(market_cap / 1e6, 4) AS market_cap_m, round(median_volume, 2) AS median_volume, round(roe, 6) AS roe, round(weight, 6) AS weight FROM members")
def index_constituents(spark, sf):
    m = members(spark, sf)
    return m.select("date", "root", "ticker", half_up(F.col("market_cap") / 1e6, 4).alias("market_cap_m"), half_up("median_volume", 2).alias("median_volume"), half_up("roe").alias("roe"), half_up("weight").alias("weight"))


@query("constituent_counts", f"WITH {CONSTITUENTS}, n AS (SELECT date, count(DISTINCT root) AS n FROM members GROUP BY 1) SELECT year(date) AS year, round(avg(n), 6) AS mean, min(n) AS least, max(n) AS most FROM n GROUP BY 1")
def constituent_counts(spark, sf):
    n = members(spark, sf).groupBy("date").agg(F.countDistinct("root").alias("n"))
    return n.groupBy(F.year("date").alias("year")).agg(half_up(F.avg("n")).alias("mean"), F.min("n").alias("least"), F.max("n").alias("most"))


@query("constituent_weight_stats", f"WITH {CONSTITUENTS} SELECT root, round(arg_max(weight, date), 6) AS last, round(avg(weight), 6) AS mean, round(stddev_samp(weight), 6) AS deviation FROM members GROUP BY 1")
def constituent_weight_stats(spark, sf):
    return members(spark, sf).groupBy("root").agg(half_up(F.max_by("weight", "date")).alias("last"), half_up(F.avg("weight")).alias("mean"), half_up(F.stddev_samp("weight")).alias("deviation"))


@query("cap_weighted_index", f"""WITH {CONSTITUENTS}, r AS (SELECT date, lead(date) OVER (ORDER BY date) AS until FROM (SELECT DISTINCT date FROM members)),
held AS (SELECT r.date AS period, m.ticker, m.weight, p.date, p.close FROM r JOIN members m ON m.date = r.date JOIN ip p ON p.ticker = m.ticker AND p.date >= r.date AND (until IS NULL OR p.date <= until)),
g AS (SELECT period, ticker, any_value(weight) AS weight, arg_max(close, date) / arg_min(close, date) AS growth FROM held GROUP BY 1, 2),
growths AS (SELECT period, sum(weight * growth) AS growth FROM g GROUP BY 1)
SELECT period, round(growth, 6) AS growth, round(log10(product(growth) OVER (ORDER BY period)), 6) AS level_log10 FROM growths""")
def cap_weighted_index(spark, sf):
    """Growth of each quarter's constituents from one rebalance to the next, and the chained level."""
    m = members(spark, sf).select("date", "ticker", "weight")
    spans = m.select("date").distinct().select(F.col("date").alias("period"), F.lead("date").over(Window.orderBy("date")).alias("until"))  # one row a quarter
    prices = a.panel(spark, sf).select("ticker", "date", half_up("close").alias("close"))
    held = prices.join(F.broadcast(spans), (F.col("date") >= F.col("period")) & (F.col("until").isNull() | (F.col("date") <= F.col("until")))).select("period", "ticker", "date", "close")
    growth = portfolio.index_level(held, m.withColumnRenamed("date", "period"))
    level = F.log10(F.product("growth").over(Window.orderBy("period").rowsBetween(Window.unboundedPreceding, 0)))  # one row a quarter
    return growth.select("period", half_up("growth").alias("growth"), half_up(level).alias("level_log10"))


@query("index_holdings", f"WITH {CONSTITUENTS} SELECT date AS rebalance_date, root, ticker, round(market_cap / 1e6, 4) AS market_cap_m, round(median_volume, 0) AS median_volume, round(roe, 4) AS roe, round(weight, 6) AS weight_market_cap, round(1.0 / count(*) OVER (PARTITION BY date), 6) AS weight_equal FROM members")
def index_holdings(spark, sf):
    """Every rebalance's holdings under both weightings, as they are exported."""
    m = portfolio.equal_weights(members(spark, sf).withColumnRenamed("weight", "by_cap"))
    return m.select(
        F.col("date").alias("rebalance_date"), "root", "ticker", half_up(F.col("market_cap") / 1e6, 4).alias("market_cap_m"), half_up("median_volume", 0).alias("median_volume"),
        half_up("roe", 4).alias("roe"), half_up("by_cap").alias("weight_market_cap"), half_up("weight").alias("weight_equal"),
    )
