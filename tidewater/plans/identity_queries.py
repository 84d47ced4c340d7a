"""Identity, statement assembly, calendars and audits over the given tables.

Suppliers stand for tickers: a root of four characters by nation, and a class number by supplier; parts stand for securities.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as c
from ..operators import identity as i
from ..operators import portfolio
from . import adapters as a
from .oracle import BARS, MARKET, PANEL, SPLITS, lag, pct_rank, roll
from .portfolio_queries import SIGNALS, signals
from .registry import half_up, query, rounded

# The class numbers that suppliers take in turn.
NUMBERS = ("3", "4", "5", "6", "11", "34")
TICKERS = f"""tickers AS (SELECT s_suppkey, s_nationkey, 'T' || lpad(CAST(s_nationkey AS VARCHAR), 3, '0') || ([{', '.join(repr(n) for n in NUMBERS)}])[s_suppkey % 6 + 1] AS ticker FROM supplier)"""
QUOTES = f"""{TICKERS}, quotes AS (SELECT ticker, s_nationkey AS company, CAST(l_shipdate AS DATE) AS date, CASE WHEN l_partkey % 50 = 0 THEN 'UNKNOWN' ELSE 'BRT' || lpad(CAST(s_nationkey AS VARCHAR), 3, '0') || CASE l_partkey % 3 WHEN 0 THEN 'ACNOR' WHEN 1 THEN 'ACNPR' ELSE 'CDAM' END || CAST(l_partkey % 10 AS VARCHAR) END AS isin,
  CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT) AS volume FROM lineitem JOIN tickers ON s_suppkey = l_suppkey)"""


def tickers(spark, sf):
    number = F.element_at(F.array(*map(F.lit, NUMBERS)), (F.col("s_suppkey") % 6 + 1).cast("int"))
    root = F.concat(F.lit("T"), F.lpad(F.col("s_nationkey").cast("string"), 3, "0"))
    return a.table(spark, sf, "supplier").select("s_suppkey", "s_nationkey", F.concat(root, number).alias("ticker"))


def quotes(spark, sf):
    """(ticker, company, date, isin, volume in cents): line items as quotes."""
    kind = F.when(F.col("l_partkey") % 3 == 0, "ACNOR").when(F.col("l_partkey") % 3 == 1, "ACNPR").otherwise("CDAM")
    isin = F.concat(F.lit("BRT"), F.lpad(F.col("s_nationkey").cast("string"), 3, "0"), kind, (F.col("l_partkey") % 10).cast("string"))
    items = a.table(spark, sf, "lineitem").join(tickers(spark, sf), F.col("l_suppkey") == F.col("s_suppkey"))
    return items.select("ticker", F.col("s_nationkey").alias("company"), F.to_date("l_shipdate").alias("date"), F.when(F.col("l_partkey") % 50 == 0, "UNKNOWN").otherwise(isin).alias("isin"), F.floor(F.col("l_extendedprice") * 100 + 0.5).alias("volume"))


@query("share_classes", f"""WITH {TICKERS} SELECT ticker, substr(ticker, 1, 4) AS root, CASE substr(ticker, 5) WHEN '3' THEN 'ON' WHEN '4' THEN 'PN' WHEN '5' THEN 'PNA' WHEN '6' THEN 'PNB' WHEN '11' THEN 'UNIT' END AS share_class, substr(ticker, 5) = '3' AS is_primary FROM tickers""")
def share_classes(spark, sf):
    return tickers(spark, sf).select("ticker", i.root_of("ticker").alias("root"), i.share_class("ticker").alias("share_class"), i.is_primary("ticker").alias("is_primary"))


@query("latest_isins", f"WITH {QUOTES} SELECT ticker, arg_max(isin, (date, isin)) AS isin FROM quotes WHERE isin <> 'UNKNOWN' GROUP BY 1")
def latest_isins(spark, sf):
    return i.latest_isin(quotes(spark, sf))


@query("identity_map", f"""WITH {QUOTES} SELECT ticker, isin, min(date) AS first_seen, max(date) AS last_seen, CASE substr(ticker, 5) WHEN '3' THEN 'ON' WHEN '4' THEN 'PN' WHEN '5' THEN 'PNA' WHEN '6' THEN 'PNB' WHEN '11' THEN 'UNIT' END AS share_class, substr(ticker, 5) = '3' AS is_primary FROM quotes GROUP BY 1, 2""")
def identity_map(spark, sf):
    return i.identity_map(quotes(spark, sf))


@query("isin_tickers", f"""WITH {QUOTES}, k AS (SELECT DISTINCT isin, substr(isin, 3, 4) AS root, CASE WHEN contains(substr(isin, 7, 5), 'OR') THEN 'ON' WHEN contains(substr(isin, 7, 5), 'PR') THEN 'PN' ELSE 'ON' END AS wanted FROM quotes WHERE length(isin) >= 8),
m AS (SELECT isin, ticker, row_number() OVER (PARTITION BY isin ORDER BY CASE WHEN (wanted = 'ON' AND ticker LIKE '%3') OR (wanted = 'PN' AND right(ticker, 1) IN ('4', '5', '6')) THEN 0 ELSE 1 END, ticker) AS n FROM k JOIN (SELECT DISTINCT ticker FROM tickers) t ON substr(t.ticker, 1, 4) = k.root)
SELECT isin, ticker FROM m WHERE n = 1""")
def isin_tickers(spark, sf):
    return i.isin_tickers(quotes(spark, sf).select("isin").distinct(), tickers(spark, sf))


@query("most_traded_tickers", f"WITH {QUOTES}, m AS (SELECT company, ticker, avg(volume) AS v FROM quotes GROUP BY 1, 2) SELECT company, ticker, round(v, 2) AS mean_volume FROM m QUALIFY row_number() OVER (PARTITION BY company ORDER BY v DESC, ticker) = 1")
def most_traded_tickers(spark, sf):
    return i.most_traded(quotes(spark, sf)).select("company", "ticker", half_up("mean_volume", 2).alias("mean_volume"))


@query("share_totals", """WITH x AS (SELECT o_custkey AS company, CAST(o_orderdate AS DATE) AS date, sum(CASE WHEN o_orderstatus = 'P' THEN -1 ELSE CAST(floor(o_totalprice) AS BIGINT) END) AS s FROM orders GROUP BY 1, 2) SELECT company, date, CASE WHEN s > 0 THEN s END AS shares FROM x""")
def share_totals(spark, sf):
    o = a.table(spark, sf, "orders").select(F.col("o_custkey").alias("company"), F.to_date("o_orderdate").alias("date"), F.when(F.col("o_orderstatus") == "P", F.lit(-1)).otherwise(F.floor("o_totalprice")).alias("shares"))
    return i.share_totals(o, ["company", "date"])


@query("bulk_updated_customers", """SELECT c_custkey, coalesce(o.best, c_acctbal) AS c_acctbal, coalesce(o.segment, c_mktsegment) AS c_mktsegment FROM customer LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS best, max(o_orderpriority) AS segment FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) o ON o_custkey = c_custkey""")
def bulk_updated_customers(spark, sf):
    source = a.table(spark, sf, "orders").filter("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("c_acctbal"), F.max("o_orderpriority").alias("c_mktsegment"))
    return i.bulk_update(a.table(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_mktsegment"), source, ["c_custkey"], ["c_acctbal", "c_mktsegment"], order=["c_acctbal"])


@query("merged_statements", """WITH x AS (SELECT o_custkey AS company, CAST(o_orderdate AS DATE) AS period, o_orderstatus AS s, sum(CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT)) AS v FROM orders GROUP BY 1, 2, 3), f AS (SELECT company, period, v AS income FROM x WHERE s = 'F'), o AS (SELECT company, period, v AS assets FROM x WHERE s = 'O'), p AS (SELECT company, period, v AS equity FROM x WHERE s = 'P'),
m AS (SELECT * FROM f FULL JOIN o USING (company, period) FULL JOIN p USING (company, period)), r AS (SELECT o_custkey AS company, CAST(o_orderdate AS DATE) AS period, max(o_orderkey) AS receipt FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1, 2)
SELECT company, period, CASE WHEN company % 2 = 0 THEN income / 1000.0 ELSE CAST(income AS DOUBLE) END AS income, assets, equity, receipt, CAST(strftime(period, '%Y%m%d') AS INTEGER) AS version FROM m LEFT JOIN r USING (company, period)""")
def merged_statements(spark, sf):
    """Three statements merged on their keys, receipts joined, amounts brought to one scale, versions from dates."""
    o = a.table(spark, sf, "orders").withColumns({"company": F.col("o_custkey"), "period": F.to_date("o_orderdate")})
    part = lambda s, name: o.filter(F.col("o_orderstatus") == s).groupBy("company", "period").agg(F.sum(F.floor(F.col("o_totalprice") * 100 + 0.5)).alias(name))
    m = i.merge_statements(part("F", "income"), part("O", "assets"), part("P", "equity"), keys=["company", "period"])
    receipts = o.filter("o_orderpriority = '1-URGENT'").groupBy("company", "period").agg(F.max("o_orderkey").alias("receipt"))
    code = F.when(F.col("company") % 2 == 0, "01").otherwise("02")
    return m.join(receipts, ["company", "period"], "left").select("company", "period", i.scaled(F.col("income").cast("double"), code).alias("income"), "assets", "equity", "receipt", i.version_of("period").alias("version"))


@query("volume_units", f"""WITH {QUOTES}, l AS (SELECT ticker, volume, row_number() OVER (PARTITION BY ticker ORDER BY date DESC, volume) AS n FROM (SELECT ticker, date, sum(volume) AS volume FROM quotes GROUP BY 1, 2)), m AS (SELECT max(m) AS most FROM (SELECT ticker, quantile_cont(volume, 0.5) AS m FROM l WHERE n <= 63 GROUP BY 1))
SELECT ticker, date, CAST(CASE WHEN most < 5e7 THEN 100 * v ELSE v END AS BIGINT) AS volume FROM (SELECT ticker, date, sum(volume) AS v FROM quotes GROUP BY 1, 2), m""")
def volume_units(spark, sf):
    daily = quotes(spark, sf).groupBy("ticker", "date").agg(F.sum("volume").alias("volume"))
    return i.volume_in_hundreds(daily).select("ticker", "date", F.col("volume").cast("bigint").alias("volume"))


@query("ever_urgent", "SELECT DISTINCT o_custkey AS company FROM orders WHERE lower(o_orderpriority) LIKE '%urgent%' OR lower(o_orderpriority) LIKE '%high%'")
def ever_urgent(spark, sf):
    return i.ever_member(a.table(spark, sf, "orders").select(F.col("o_custkey").alias("company"), F.col("o_orderpriority").alias("sector")), ["Urgent", "HIGH"])


@query("active_names", """WITH r AS (SELECT o_custkey AS company, min(CAST(o_orderdate AS DATE)) AS listing_date, CASE WHEN max(CAST(o_orderdate AS DATE)) < DATE '2000-01-01' THEN max(CAST(o_orderdate AS DATE)) END AS delisting_date FROM orders GROUP BY 1) SELECT company, listing_date FROM r WHERE listing_date <= DATE '1998-06-30' AND (delisting_date IS NULL OR delisting_date > DATE '1998-06-30')""")
def active_names(spark, sf):
    day = F.to_date("o_orderdate")
    r = a.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("company")).agg(F.min(day).alias("listing_date"), F.when(F.max(day) < "2000-01-01", F.max(day)).alias("delisting_date"))
    return i.active_on(r, "1998-06-30").select("company", "listing_date")


@query("rebalance_calendars", """WITH d AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS date FROM lineitem), q AS (SELECT date_trunc('quarter', date) AS q, max(date) AS r FROM d GROUP BY 1), m AS (SELECT min(date) AS r FROM d WHERE month(date) IN (4, 6, 9, 12) AND day(date) >= 15 GROUP BY date_trunc('month', date))
SELECT 'quarter' AS calendar, r AS rebalance FROM q WHERE q < (SELECT max(q) FROM q) UNION ALL SELECT 'mid', r FROM m""")
def rebalance_calendars(spark, sf):
    d = a.table(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("date")).distinct()
    return i.completed_quarters(d).select(F.lit("quarter").alias("calendar"), "rebalance").union(i.mid_quarter_dates(d).select(F.lit("mid"), "rebalance"))


@query("inception_gate", f"WITH {SIGNALS}, n AS (SELECT date, count(*) FILTER (WHERE adtv >= 150000) AS n FROM signals GROUP BY 1) SELECT date, n, max(CASE WHEN n >= 5 THEN 1 ELSE 0 END) OVER (ORDER BY date) = 1 AS started FROM n")
def inception_gate(spark, sf):
    return i.inception(signals(spark, sf).groupBy("date").agg(F.count_if(F.coalesce(F.col("adtv") >= 150000, F.lit(False))).alias("n")), 5)


@query("last_trading_dates", f"WITH {PANEL} SELECT ticker, max(CASE WHEN volume > 0 THEN date END) AS last_traded FROM panel GROUP BY 1")
def last_trading_dates(spark, sf):
    return a.panel(spark, sf).groupBy("ticker").agg(F.max(F.when(F.col("volume") > 0, F.col("date"))).alias("last_traded"))


@query("reversal_gates", f"""WITH {PANEL}, w AS (SELECT date, ticker, ret, CASE WHEN count(*) OVER f >= 20 THEN avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END) OVER f END AS wr, {roll('avg', 'abs(ret)', 14)} AS move FROM panel WINDOW f AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
r AS (SELECT date, ticker, wr / ({roll('avg', 'wr', 60)} + 1e-8) AS wins, move / nullif({roll('avg', 'move', 60)}, 0) AS moves FROM w) SELECT date, ticker, round(wins, 6) AS wins, round(moves, 6) AS moves, coalesce(round(wins, 6), 1) < 1.5 AND coalesce(round(moves, 6), 1) < 2.0 AS passes FROM r""")
def reversal_gates(spark, sf):
    """Win rate and mean absolute move against their own 60-row means: names that trend or swing beyond them do not pass."""
    w = c.by_time()
    p = a.panel(spark, sf).select("date", "ticker", c.win_rate("ret", 20, w).alias("wr"), c.roll_mean(F.abs("ret"), 14, w).alias("move"))
    r = p.select("date", "ticker", half_up(c.ratio("wr", c.roll_mean("wr", 60, w) + 1e-8)).alias("wins"), half_up(c.ratio("move", F.nullif(c.roll_mean("move", 60, w), F.lit(0.0)))).alias("moves"))
    return r.withColumn("passes", (F.coalesce("wins", F.lit(1.0)) < 1.5) & (F.coalesce("moves", F.lit(1.0)) < 2.0))


@query("action_table_audit", f"""WITH {SPLITS}, {BARS} SELECT 'extreme_factor' AS rule, count(*) FILTER (WHERE factor > 8 OR factor < 0.1) AS count FROM splits UNION ALL SELECT 'bad_factor', count(*) FILTER (WHERE factor IS NULL OR factor <= 0) FROM splits
UNION ALL SELECT 'orphan', count(*) FROM splits s WHERE NOT EXISTS (SELECT 1 FROM bars b WHERE b.ticker = s.ticker AND b.close > 0) UNION ALL SELECT 'repeated', count(*) FROM (SELECT ticker, ex_date FROM splits GROUP BY 1, 2 HAVING count(*) > 1)""")
def action_table_audit(spark, sf):
    e = a.share_events(spark, sf)
    rules = e.agg(F.count_if(F.coalesce((F.col("factor") > 8) | (F.col("factor") < 0.1), F.lit(False))).alias("extreme_factor"), F.count_if(F.col("factor").isNull() | (F.col("factor") <= 0)).alias("bad_factor"))
    orphans = e.join(a.bars(spark, sf).filter("close > 0").select("ticker").distinct(), "ticker", "left_anti").agg(F.count("*").alias("count"))
    twice = e.groupBy("ticker", "ex_date").count().filter("count > 1").agg(F.count("*").alias("count"))
    out = rules.select(F.explode(F.create_map(F.lit("extreme_factor"), "extreme_factor", F.lit("bad_factor"), "bad_factor")).alias("rule", "count"))
    return out.union(orphans.select(F.lit("orphan"), "count")).union(twice.select(F.lit("repeated"), "count"))


@query("common_keys", f"""WITH {PANEL}, {MARKET}, l AS (SELECT DISTINCT date FROM panel WHERE ret IS NOT NULL), r AS (SELECT DISTINCT date FROM market WHERE mret > 0), u AS (SELECT date FROM l UNION SELECT date FROM r) SELECT date, date IN (SELECT date FROM l) AND date IN (SELECT date FROM r) AS in_both FROM u""")
def common_keys(spark, sf):
    """Union of two date sets, and which dates are in their intersection."""
    left, right = a.panel(spark, sf).filter("ret is not null").select("date"), a.market(spark, sf).filter("mret > 0").select("date")
    both = left.intersect(right).withColumn("in_both", F.lit(True))
    return left.union(right).distinct().join(both, "date", "left").select("date", F.coalesce("in_both", F.lit(False)).alias("in_both"))


@query("ewma_returns_shifted", f"""WITH {PANEL}, k AS (SELECT date, ticker, ret, row_number() OVER (PARTITION BY ticker ORDER BY date) AS k FROM panel), e AS (SELECT date, ticker, k, CASE WHEN count(ret) OVER h >= 12 THEN sum(ret * pow(13.0 / 11.0, k)) OVER h / sum(CASE WHEN ret IS NOT NULL THEN pow(13.0 / 11.0, k) END) OVER h END AS m FROM k WINDOW h AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT date, ticker, round({lag('m')}, 6) AS mean FROM e""")
def ewma_returns_shifted(spark, sf):
    """Exponentially weighted mean of returns as known one row before."""
    from ..functions.ewm import ewm

    return ewm(a.panel(spark, sf).select("date", "ticker", "ret"), "ret", 12).select("date", "ticker", half_up(c.shift("ret_ewm_mean", 1, c.by_time())).alias("mean"))
