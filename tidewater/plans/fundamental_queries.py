"""Queries over filings, events and adjusted prices."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as c
from ..operators import adjust, grid
from ..operators import fundamentals as fu
from . import adapters as a
from .oracle import BARS, CASH, FILINGS, PANEL, SPLITS, lag
from .registry import half_up, query, rounded


def company_dates(spark, sf):
    """Quarter ends for every company with filings."""
    f = a.filings(spark, sf)
    ends = grid.calendar(f.select(F.col("filing_date").alias("date")), "QE")
    return f.select("company").distinct().crossJoin(F.broadcast(ends.agg(F.collect_set("period").alias("_e")))).select("company", F.explode("_e").alias("date"))


DAY = """day AS (SELECT company, filing_date, arg_max(net_income, (version, filing_id)) FILTER (WHERE net_income IS NOT NULL) AS net_income,
arg_max(equity, (version, filing_id)) FILTER (WHERE equity IS NOT NULL) AS equity, arg_max(shares, (version, filing_id)) FILTER (WHERE shares IS NOT NULL) AS shares FROM filings GROUP BY 1, 2)"""
DATES = """span AS (SELECT min(filing_date) AS a, max(filing_date) AS b FROM filings),
ends AS (SELECT DISTINCT last_day(CAST(date_trunc('quarter', d) + INTERVAL 2 MONTH AS DATE)) AS date FROM (SELECT unnest(generate_series(a, b, INTERVAL 1 DAY))::DATE AS d FROM span)),
dates AS (SELECT company, date FROM (SELECT DISTINCT company FROM filings), ends)"""


def asof_sql(metric: str) -> str:
    return f"""(SELECT d.company, d.date, x.{metric} AS v, x.filing_date AS at FROM dates d ASOF LEFT JOIN (SELECT company, filing_date, {metric} FROM day WHERE {metric} IS NOT NULL) x ON x.company = d.company AND d.date >= x.filing_date)"""


@query("pit_metrics", f"""WITH {FILINGS}, {DAY}, {DATES}
SELECT n.company, n.date, CASE WHEN n.date - n.at <= 400 THEN n.v END AS net_income, CASE WHEN e.date - e.at <= 400 THEN e.v END AS equity, CASE WHEN s.date - s.at <= 400 THEN s.v END AS shares
FROM {asof_sql('net_income')} n JOIN {asof_sql('equity')} e USING (company, date) JOIN {asof_sql('shares')} s USING (company, date)""")
def pit_metrics(spark, sf):
    return fu.known_on(company_dates(spark, sf), a.filings(spark, sf), ["net_income", "equity", "shares"]).select("company", "date", "net_income", "equity", "shares")


@query("latest_filing", f"WITH {FILINGS} SELECT company, period_end, filing_date, version, doc_type, filing_id FROM filings QUALIFY row_number() OVER (PARTITION BY company, period_end ORDER BY version DESC, filing_date DESC) = 1")
def latest_filing(spark, sf):
    return fu.latest_version(a.filings(spark, sf), ["company", "period_end"], ["version", "filing_date"]).select("company", "period_end", "filing_date", "version", "doc_type", "filing_id")


@query("shares_propagated", f"""WITH {FILINGS}, s AS (SELECT company, filing_date AS d, arg_max(shares, version) AS found FROM filings WHERE shares > 0 GROUP BY 1, 2)
SELECT f.filing_id, f.company, f.filing_date, coalesce(f.shares, s.found) AS shares FROM filings f ASOF LEFT JOIN s ON s.company = f.company AND f.filing_date >= s.d""")
def shares_propagated(spark, sf):
    f = a.filings(spark, sf)
    s = f.filter("shares > 0").groupBy("company", "filing_date").agg(F.max_by("shares", "version").alias("shares"), F.max("version").alias("version"))
    return fu.propagate_shares(f.select("filing_id", "company", "filing_date", "shares"), s).select("filing_id", "company", "filing_date", "shares")


@query("statement_pivot", f"""WITH {FILINGS} SELECT company, year(period_end) AS fiscal_year, arg_max(net_income, (filing_date, filing_id)) FILTER (WHERE net_income IS NOT NULL) AS net_income, arg_max(equity, (filing_date, filing_id)) FILTER (WHERE equity IS NOT NULL) AS equity,
arg_max(shares, (filing_date, filing_id)) FILTER (WHERE shares IS NOT NULL) AS shares FROM filings GROUP BY 1, 2""")
def statement_pivot(spark, sf):
    f = a.filings(spark, sf).withColumn("fiscal_year", F.year("period_end"))
    latest = lambda m: F.max_by(m, F.when(F.col(m).isNotNull(), F.struct("filing_date", "filing_id"))).alias(m)
    return f.groupBy("company", "fiscal_year").agg(latest("net_income"), latest("equity"), latest("shares"))


QUARTERLY = f"""{FILINGS}, q AS (SELECT company, year(period_end) AS fiscal_year, CASE month(period_end) WHEN 3 THEN 1 WHEN 6 THEN 2 WHEN 9 THEN 3 END AS quarter, filing_date, version, filing_id, coalesce(net_income, equity, shares) AS net_income
FROM filings WHERE month(period_end) IN (3, 6, 9, 12))"""


@query("trailing_twelve_months", f"""WITH {QUARTERLY}, l AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY company, fiscal_year, quarter ORDER BY version DESC, filing_date DESC) = 1),
ann AS (SELECT company, fiscal_year + 1 AS fy, filing_date AS d, arg_max(net_income, version) AS v FROM q WHERE quarter IS NULL GROUP BY 1, 2, 3), itr AS (SELECT company, fiscal_year + 1 AS fy, quarter AS k, filing_date AS d, arg_max(net_income, version) AS v FROM q WHERE quarter IS NOT NULL GROUP BY 1, 2, 3, 4)
SELECT l.filing_id, l.company, l.fiscal_year, l.quarter, round(CASE WHEN l.quarter IS NULL THEN l.net_income ELSE l.net_income + ann.v - itr.v END, 4) AS ttm FROM l ASOF LEFT JOIN ann ON ann.company = l.company AND ann.fy = l.fiscal_year AND l.filing_date >= ann.d
ASOF LEFT JOIN itr ON itr.company = l.company AND itr.fy = l.fiscal_year AND itr.k = l.quarter AND l.filing_date >= itr.d""")
def trailing_twelve_months(spark, sf):
    m = F.month("period_end")
    f = a.filings(spark, sf).filter(m.isin(3, 6, 9, 12)).withColumn("fiscal_year", F.year("period_end")).withColumn("quarter", F.when(m != 12, (m / 3).cast("int"))).withColumn("net_income", F.coalesce("net_income", "equity", "shares"))
    # of one day's versions the last counts
    day = f.groupBy("company", "fiscal_year", "quarter", "filing_date").agg(F.max("version").alias("version"), F.max_by("net_income", "version").alias("net_income"), F.max_by("filing_id", "version").alias("filing_id"))
    return fu.trailing_twelve_months(day).select("filing_id", "company", "fiscal_year", "quarter", half_up("ttm", 4).alias("ttm"))


@query("monthly_snapshot", f"""WITH {FILINGS}, {DAY}, span AS (SELECT min(filing_date) AS a, max(filing_date) AS b FROM filings), ends AS (SELECT DISTINCT last_day(d) AS date FROM (SELECT unnest(generate_series(a, b, INTERVAL 1 DAY))::DATE AS d FROM span)),
dates AS (SELECT company, date FROM (SELECT DISTINCT company FROM filings), ends), m AS (SELECT n.company, n.date AS month_end, CASE WHEN n.date - n.at <= 400 THEN n.v END AS net_income, CASE WHEN e.date - e.at <= 400 THEN e.v END AS equity
FROM {asof_sql('net_income')} n JOIN {asof_sql('equity')} e USING (company, date)) SELECT * FROM m WHERE net_income IS NOT NULL OR equity IS NOT NULL""")
def monthly_snapshot(spark, sf):
    f = a.filings(spark, sf)
    months = grid.calendar(f.select(F.col("filing_date").alias("date")), "ME")
    return fu.monthly_snapshot(f, months, ["net_income", "equity"]).select("company", "month_end", "net_income", "equity")


@query("valuation_ratios", f"""WITH {FILINGS}, x AS (SELECT company, filing_date, net_income, equity, shares, lag(net_income) OVER w AS n0 FROM filings WINDOW w AS (PARTITION BY company ORDER BY filing_date, filing_id)),
y AS (SELECT company, arg_max(net_income, (filing_date)) FILTER (WHERE net_income IS NOT NULL) AS ni, arg_max(equity, filing_date) FILTER (WHERE equity IS NOT NULL) AS eq, arg_max(shares, filing_date) FILTER (WHERE shares IS NOT NULL) AS sh FROM (SELECT company, filing_date, max(net_income) AS net_income, max(equity) AS equity, max(shares) AS shares FROM filings GROUP BY 1, 2) GROUP BY 1)
SELECT company, round(CASE WHEN sh > 0 AND ni > 0 THEN 10.0 * sh / (ni * 1000) END, 6) AS pe, round(CASE WHEN sh > 0 AND eq > 0 THEN 10.0 * sh / (eq * 1000) END, 6) AS pb, round(CASE WHEN eq > 0 THEN ni / eq END, 6) AS roe, round(CASE WHEN sh > 0 THEN ni * 1000 / (10.0 * sh) END, 6) AS earnings_yield FROM y""")
def valuation_ratios(spark, sf):
    f = a.filings(spark, sf).groupBy("company", "filing_date").agg(*(F.max(m).alias(m) for m in ("net_income", "equity", "shares")))
    latest = f.groupBy("company").agg(*(F.max_by(m, F.when(F.col(m).isNotNull(), F.col("filing_date"))).alias(m) for m in ("net_income", "equity", "shares")))
    wide = latest.withColumn("close", F.lit(10.0)).withColumns({m: F.lit(None).cast("double") for m in ("net_debt", "ebitda", "total_assets", "revenue")})
    return rounded(fu.quality_ratios(fu.valuation(wide)), "company", "pe", "pb", "roe", "earnings_yield")


@query("sector_members", """WITH f AS (SELECT o_custkey AS company, CAST(o_orderdate AS DATE) AS ref_date, max(o_orderpriority) AS sector FROM orders GROUP BY 1, 2), d AS (SELECT DISTINCT company, DATE '1999-12-31' AS date FROM f)
SELECT d.company, d.date, coalesce(regexp_matches(f.sector, '(?i)urgent|high'), false) AS member FROM d ASOF LEFT JOIN f ON f.company = d.company AND d.date >= f.ref_date""")
def sector_members(spark, sf):
    h = a.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("company"), F.to_date("o_orderdate").alias("ref_date")).agg(F.max("o_orderpriority").alias("sector"))
    dates = h.select("company").distinct().withColumn("date", F.lit("1999-12-31").cast("date"))
    return fu.member_as_of(dates, h, ["Urgent", "High"]).select("company", "date", "member")


@query("survivors", """WITH last AS (SELECT s_nationkey AS root, max(CAST(l_shipdate AS DATE)) AS delisted FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_quantity > 49 AND l_discount > 0.08 GROUP BY 1)
SELECT s_suppkey AS ticker, s_nationkey AS root FROM supplier WHERE s_nationkey NOT IN (SELECT root FROM last WHERE delisted < DATE '2001-06-01')""")
def survivors(spark, sf):
    tickers = a.roots(spark, sf)
    items = a.table(spark, sf, "lineitem").filter("l_quantity > 49 and l_discount > 0.08").join(tickers, F.col("l_suppkey") == F.col("ticker"))
    register = items.groupBy("root").agg(F.max(F.to_date("l_shipdate")).alias("delisting_date"))
    return fu.survivors(tickers, register, "2001-06-01").select("ticker", "root")


@query("split_factors", f"WITH {SPLITS} SELECT ticker, ex_date, factor, round(1 / factor, 6) AS split_factor FROM splits WHERE 1 / factor BETWEEN 0.001 AND 1000")
def split_factors(spark, sf):
    return rounded(adjust.split_factors(a.share_events(spark, sf)), "ticker", "ex_date", "factor", "split_factor")


ADJUSTED = f"""{BARS}, {SPLITS}, ev AS (SELECT ticker, ex_date, round(1 / factor, 10) AS f FROM splits),
ex AS (SELECT b.ticker, b.date, list(f ORDER BY ex_date DESC) FILTER (WHERE f IS NOT NULL) AS fs FROM bars b LEFT JOIN ev ON ev.ticker = b.ticker AND ev.ex_date > b.date GROUP BY 1, 2),
adj AS (SELECT b.*, CASE WHEN fs IS NULL THEN 1.0 ELSE list_reduce(fs, lambda acc, f: greatest(least(acc * f, 1e5), 1e-5), 1.0) END AS p FROM bars b JOIN ex USING (ticker, date))"""


@query("split_adjusted_bars", f"WITH {ADJUSTED} SELECT ticker, date, round(p * 1e6, 4) AS product, round(open * p, 6) AS open, round(close * p, 6) AS close FROM adj")
def split_adjusted_bars(spark, sf):
    x = adjust.back_adjust(a.bars(spark, sf), adjust.split_factors(a.share_events(spark, sf)))
    return x.select("ticker", "date", half_up(F.col("split_product") * 1e6, 4).alias("product"), half_up("split_adj_open").alias("open"), half_up("split_adj_close").alias("close"))


@query("dividend_factors", f"""WITH {BARS}, {CASH} SELECT c.ticker, c.ex_date, c.value, round(b.close, 6) AS prior_close, round(1 - value / b.close, 6) AS dividend_factor FROM cash c ASOF JOIN bars b ON b.ticker = c.ticker AND c.ex_date > b.date WHERE value > 0 AND b.close > 0 AND value < 0.9 * b.close""")
def dividend_factors(spark, sf):
    return rounded(adjust.dividend_factors(a.cash_events(spark, sf), a.bars(spark, sf)), "ticker", "ex_date", "value", "prior_close", "dividend_factor")


@query("total_adjusted_bars")
def total_adjusted_bars(spark, sf):
    x = adjust.total_adjust(a.bars(spark, sf), a.share_events(spark, sf), a.cash_events(spark, sf))
    return rounded(x, "ticker", "date", "split_adj_close", "adj_close")


NS = "[2, 3, 4, 5, 6, 8, 10, 15, 20, 25, 50, 100]"


@query("detected_splits", f"""WITH {BARS}, {SPLITS}, k AS (SELECT DISTINCT ticker, ex_date FROM splits),
j AS (SELECT b.ticker, b.date, close / {lag('close').replace('PARTITION BY ticker ORDER BY date', 'PARTITION BY b.ticker ORDER BY b.date')} AS r, max(CASE WHEN k.ticker IS NOT NULL THEN 1 END) OVER (PARTITION BY b.ticker ORDER BY b.date ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS known FROM bars b LEFT JOIN k ON k.ticker = b.ticker AND k.ex_date = b.date),
f AS (SELECT *, list_filter({NS}, lambda n: abs(r * n - 1) <= 0.08) AS fwd, list_filter({NS}, lambda n: abs(r / n - 1) <= 0.08) AS rev FROM j WHERE (r < 0.55 OR r > 1.8) AND known IS NULL)
SELECT ticker, date AS ex_date, CASE WHEN len(fwd) > 0 THEN 'STOCK_SPLIT' ELSE 'REVERSE_SPLIT' END AS action, round(CASE WHEN len(fwd) > 0 THEN fwd[1] ELSE 1.0 / rev[1] END, 6) AS factor, round(r, 6) AS price_ratio FROM f WHERE len(fwd) > 0 OR len(rev) > 0""")
def detected_splits(spark, sf):
    return rounded(adjust.detect_splits(a.bars(spark, sf), a.share_events(spark, sf)), "ticker", "ex_date", "action", "factor", "price_ratio")


@query("validated_actions", f"""WITH {BARS}, {SPLITS}, n AS (SELECT s.ticker, s.ex_date, s.factor, (SELECT arg_max(close, date) FROM bars b WHERE b.ticker = s.ticker AND date < s.ex_date AND date >= s.ex_date - 7) AS before, (SELECT arg_min(close, date) FROM bars b WHERE b.ticker = s.ticker AND date >= s.ex_date AND date <= s.ex_date + 7) AS after FROM splits s),
v AS (SELECT *, ln(after / before) AS seen, -ln(factor) AS expected, list_filter({NS}, lambda n: abs(after / before * n - 1) <= 0.05) AS fwd, list_filter({NS}, lambda n: abs(after / before / n - 1) <= 0.05) AS rev FROM n),
j AS (SELECT *, CASE WHEN seen IS NULL OR abs(seen - expected) <= ln(1.35) THEN 'KEEP' WHEN abs(seen) <= ln(1.35) THEN 'DROP' WHEN len(fwd) > 0 OR len(rev) > 0 THEN 'CORRECTED' ELSE 'KEEP' END AS verdict FROM v)
SELECT ticker, ex_date, CASE WHEN verdict = 'CORRECTED' AND len(fwd) = 0 THEN 'REVERSE_SPLIT' ELSE 'STOCK_SPLIT' END AS action, round(CASE WHEN verdict <> 'CORRECTED' THEN factor WHEN len(fwd) > 0 THEN fwd[1] ELSE 1.0 / rev[1] END, 6) AS factor,
round(before, 6) AS close_before, round(after, 6) AS close_after, verdict FROM j""")
def validated_actions(spark, sf):
    return rounded(adjust.validate(a.share_events(spark, sf), a.bars(spark, sf)), "ticker", "ex_date", "action", "factor", "close_before", "close_after", "verdict")


@query("share_multipliers", f"""WITH {BARS}, {SPLITS}, m AS (SELECT DISTINCT ticker, last_day(date) AS month_end FROM bars), p AS (SELECT ticker, month_end, CAST(month_end - INTERVAL 12 MONTH AS DATE) AS since FROM m)
SELECT p.ticker, month_end, since, round(coalesce(product(factor), 1), 4) AS multiplier FROM p LEFT JOIN splits s ON s.ticker = p.ticker AND s.ex_date > since AND s.ex_date <= month_end GROUP BY 1, 2, 3""")
def share_multipliers(spark, sf):
    months = a.bars(spark, sf).select("ticker", F.last_day("date").alias("month_end")).distinct().withColumn("since", F.add_months("month_end", -12))
    return adjust.share_multiplier(months, a.share_events(spark, sf), "since", "month_end").select("ticker", "month_end", "since", half_up("multiplier", 4).alias("multiplier"))


@query("repaired_panel")
def repaired_panel(spark, sf):
    p = a.panel(spark, sf).withColumn("raw_close", F.col("close"))
    return rounded(adjust.repair_unrecorded(p), "ticker", "date", "close", "repaired", "split_here")


@query("dividend_yield_12m", f"""WITH {PANEL}, {CASH}, mc AS (SELECT ticker, last_day(date) AS period, arg_max(close, date) FILTER (WHERE close IS NOT NULL) AS close FROM panel GROUP BY 1, 2), md AS (SELECT ticker, last_day(ex_date) AS period, sum(value) AS paid FROM cash GROUP BY 1, 2)
SELECT ticker, period, round(sum(coalesce(paid, 0)) OVER (PARTITION BY ticker ORDER BY period ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) / close, 6) AS dividend_yield FROM mc LEFT JOIN md USING (ticker, period)""")
def dividend_yield_12m(spark, sf):
    closes = grid.resample(a.panel(spark, sf), "ME", last=["close"])
    paid = grid.resample(a.cash_events(spark, sf).withColumnRenamed("ex_date", "date"), "ME", total=["value"])
    w = c.by_time("ticker", "period").rowsBetween(-11, 0)
    return closes.join(paid, ["ticker", "period"], "left").select("ticker", "period", half_up(F.sum(F.coalesce("value_sum", F.lit(0.0))).over(w) / F.col("close")).alias("dividend_yield"))


@query("regular_payers", f"""WITH {CASH}, y AS (SELECT ticker, count(DISTINCT floor((DATE '2001-12-31' - ex_date) / 365)) AS years FROM cash WHERE ex_date > DATE '1998-12-31' AND value > 0 AND ex_date <= DATE '2001-12-31' AND floor((DATE '2001-12-31' - ex_date) / 365) < 3 GROUP BY 1) SELECT ticker, years FROM y WHERE years >= 2""")
def regular_payers(spark, sf):
    back = F.floor(F.datediff(F.lit("2001-12-31").cast("date"), "ex_date") / 365)
    paid = a.cash_events(spark, sf).filter("value > 0 and ex_date > '1998-12-31' and ex_date <= '2001-12-31'").filter(back < 3)
    return paid.groupBy("ticker").agg(F.countDistinct(back).alias("years")).filter("years >= 2")
