"""Composed portfolios on fundamentals and regimes, the research matrix and the discovery report."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import columns as c
from ..operators import discovery as d
from ..operators import fundamentals as fu
from ..operators import grid, portfolio
from . import adapters as a
from .discovery_queries import IC, ic, measured
from .discovery_queries import FEATURES
from .oracle import CASH, FILINGS, MARKET, PANEL, lag, pct_rank, roll
from .portfolio_queries import SIGNALS, signals
from .registry import half_up, query, rounded

VALUE = f"""{SIGNALS}, {FILINGS}, rf AS (SELECT company % 25 AS root, filing_date, arg_max(net_income, (version, filing_id)) FILTER (WHERE net_income IS NOT NULL) AS ni, arg_max(equity, (version, filing_id)) FILTER (WHERE equity IS NOT NULL) AS eq,
arg_max(shares, (version, filing_id)) FILTER (WHERE shares IS NOT NULL) AS sh FROM filings GROUP BY 1, 2),
k AS (SELECT DISTINCT root, date FROM signals),
k1 AS (SELECT k.root, k.date, CASE WHEN k.date - r.filing_date <= 400 THEN r.ni END AS net_income FROM k ASOF LEFT JOIN (SELECT * FROM rf WHERE ni IS NOT NULL) r ON r.root = k.root AND k.date >= r.filing_date),
k2 AS (SELECT k.root, k.date, CASE WHEN k.date - r.filing_date <= 400 THEN r.eq END AS equity FROM k ASOF LEFT JOIN (SELECT * FROM rf WHERE eq IS NOT NULL) r ON r.root = k.root AND k.date >= r.filing_date),
k3 AS (SELECT k.root, k.date, CASE WHEN k.date - r.filing_date <= 400 THEN r.sh END AS shares FROM k ASOF LEFT JOIN (SELECT * FROM rf WHERE sh IS NOT NULL) r ON r.root = k.root AND k.date >= r.filing_date),
val AS (SELECT s.date, s.ticker, s.root, s.close, s.adtv, s.dist, net_income, equity, shares, CASE WHEN close > 0 AND shares > 0 THEN round(close * shares, 4) END AS cap,
CASE WHEN close > 0 AND shares > 0 AND net_income > 0 THEN round(close * shares / (net_income * 1000), 9) END AS pe, CASE WHEN close > 0 AND shares > 0 AND equity > 0 THEN round(close * shares / (equity * 1000), 9) END AS pb,
CASE WHEN equity > 0 THEN round(net_income / equity, 9) END AS roe FROM signals s JOIN k1 USING (root, date) JOIN k2 USING (root, date) JOIN k3 USING (root, date))"""


def value(spark, sf):
    """The signal panel with each root's metrics as known on the date, market capitalisation, P/E, P/B and return on equity."""
    s = signals(spark, sf)
    f = a.filings(spark, sf).withColumn("root", (F.col("company") % 25).cast("int"))
    known = fu.known_on(s.select("root", "date").distinct(), f, ["net_income", "equity", "shares"], key="root")
    v = s.join(known, ["root", "date"]).withColumns({m: F.lit(None).cast("double") for m in ("net_debt", "ebitda", "total_assets", "revenue")})
    v = fu.quality_ratios(fu.valuation(v))
    cap = F.when((F.col("close") > 0) & (F.col("shares") > 0), F.col("close") * F.col("shares"))
    return v.select("date", "ticker", "root", "close", "adtv", "dist", "net_income", "equity", "shares", half_up(cap, 4).alias("cap"), half_up("pe", 9).alias("pe"), half_up("pb", 9).alias("pb"), half_up("roe", 9).alias("roe"))


@query("value_panel", f"WITH {VALUE} SELECT date, ticker, root, round(cap, 2) AS cap, round(pe, 6) AS pe, round(pb, 6) AS pb, round(roe, 6) AS roe FROM val")
def value_panel(spark, sf):
    return value(spark, sf).select("date", "ticker", "root", half_up("cap", 2).alias("cap"), half_up("pe").alias("pe"), half_up("pb").alias("pb"), half_up("roe").alias("roe"))


def held_value_sql(signal: str, eligible: str, order: str) -> str:
    return f"""WITH {VALUE}, seen AS (SELECT date, ticker, root, {lag(signal)} AS sig, {lag('adtv')} AS adtv, lag(CASE WHEN {eligible} THEN 1 ELSE 0 END) OVER (PARTITION BY ticker ORDER BY date) AS ok FROM val),
names AS (SELECT * FROM seen WHERE ok = 1 AND sig IS NOT NULL QUALIFY row_number() OVER (PARTITION BY date, root ORDER BY coalesce(adtv, -1) DESC, ticker) = 1),
ranked AS (SELECT *, count(*) OVER (PARTITION BY date) AS n, row_number() OVER (PARTITION BY date ORDER BY sig {order}, ticker) AS k FROM names)
SELECT date, ticker, round(1.0 / count(*) OVER (PARTITION BY date), 6) AS weight FROM ranked WHERE n >= 5 AND k <= greatest(5, CAST(floor(n * 0.2) AS INTEGER))"""


# The composed value portfolios as (signal, eligibility, larger is better).
VALUE_BOOKS = {
    "top_market_cap": ("cap", "coalesce(adtv >= 100000, false)", True),
    "quality_momentum": ("dist", "coalesce(net_income > 0, false) AND coalesce(equity > 0, false)", True),
}
for _name, (_signal, _eligible, _down) in VALUE_BOOKS.items():
    query(f"portfolio_{_name}", held_value_sql(_signal, _eligible, "DESC" if _down else "ASC"))(
        lambda spark, sf, n=_name: rounded(portfolio.rank_and_hold(value(spark, sf), VALUE_BOOKS[n][0], F.expr(VALUE_BOOKS[n][1]), pct=0.2, descending=VALUE_BOOKS[n][2]), "date", "ticker", "weight")
    )


@query("dual_momentum", f"""WITH {SIGNALS}, s AS (SELECT date, lag(level, 1) OVER (ORDER BY date) / lag(level, 27) OVER (ORDER BY date) - 1 AS mm FROM market), t AS (SELECT date, avg(mom) AS pm FROM signals GROUP BY 1), l AS (SELECT t.date, mm, lag(pm) OVER (ORDER BY t.date) AS pm FROM t JOIN s USING (date))
SELECT date, CASE WHEN greatest(coalesce(mm, -9), coalesce(pm, -9)) <= 0 THEN 'cash' WHEN coalesce(mm, -9) >= coalesce(pm, -9) THEN 'market' ELSE 'panel' END AS held FROM l""")
def dual_momentum(spark, sf):
    o = Window.orderBy("date")  # one row a week
    s = a.market(spark, sf).select("date", (c.ratio(F.lag("level", 1).over(o), F.lag("level", 27).over(o)) - 1).alias("mm"))
    t = signals(spark, sf).groupBy("date").agg(F.avg("mom").alias("pm")).join(s, "date").withColumn("pm", F.lag("pm").over(o))
    mm, pm = F.coalesce("mm", F.lit(-9.0)), F.coalesce("pm", F.lit(-9.0))
    return t.select("date", F.when(F.greatest(mm, pm) <= 0, "cash").when(mm >= pm, "market").otherwise("panel").alias("held"))


@query("research_matrix", f"""WITH {FEATURES}, p AS (PIVOT features ON feature IN ('mom13', 'mom4', 'vol13', 'drawdown26', 'volume4', 'range4') USING first(value) GROUP BY date, ticker), f AS (SELECT date, ticker, lead(close, 4) OVER (PARTITION BY ticker ORDER BY date) / close - 1 AS fwd FROM panel),
y AS (SELECT date, ticker, round(fwd, 9) AS fwd FROM f WHERE fwd IS NOT NULL), t AS (SELECT *, CASE WHEN fwd > quantile_cont(fwd, 0.5) OVER (PARTITION BY date) THEN 1 ELSE 0 END AS beats FROM y)
SELECT p.date, p.ticker, round(mom13, 6) AS mom13, round(mom4, 6) AS mom4, round(vol13, 6) AS vol13, round(drawdown26, 6) AS drawdown26, round(volume4, 4) AS volume4, round(range4, 6) AS range4, beats FROM p JOIN t ON t.date = p.date AND t.ticker = p.ticker
WHERE mom13 IS NOT NULL AND mom4 IS NOT NULL AND vol13 IS NOT NULL AND drawdown26 IS NOT NULL AND volume4 IS NOT NULL AND range4 IS NOT NULL""")
def research_matrix(spark, sf):
    names = ["mom13", "mom4", "vol13", "drawdown26", "volume4", "range4"]
    wide = measured(a.panel(spark, sf), [4]).withColumn("forward", half_up("forward_4", 9))
    median = F.percentile("forward", F.lit(0.5)).over(Window.partitionBy("date"))
    known = wide.withColumn("beats", (F.col("forward") > median).cast("int")).dropna(subset=[*names, "forward"])
    return known.select("date", "ticker", *(half_up(n, 4 if n == "volume4" else 6).alias(n) for n in names), "beats")


@query("discovery_report", f"""WITH {IC}, r AS (SELECT *, dense_rank() OVER (PARTITION BY horizon ORDER BY date) AS n FROM ic), k AS (SELECT horizon, greatest(1, CAST(floor(max(n) * 0.7) AS INTEGER)) AS cut FROM r GROUP BY 1), s AS (SELECT feature, r.horizon, avg(ic) / nullif(stddev_samp(ic), 0) AS ir, avg(ic) FILTER (WHERE n <= cut) AS train, avg(ic) FILTER (WHERE n > cut) AS test FROM r JOIN k ON k.horizon = r.horizon GROUP BY 1, 2)
SELECT horizon, feature, row_number() OVER (PARTITION BY horizon ORDER BY round(abs(ir), 6) DESC, feature) AS place, CASE WHEN train <> 0 AND test / train < 0.5 THEN 1 ELSE 0 END AS overfit FROM s""")
def discovery_report(spark, sf):
    s = d.ic_summary(ic(spark, sf)).withColumn("s", half_up(F.abs("ic_ir")))
    place = F.row_number().over(Window.partitionBy("horizon").orderBy(F.desc("s"), "feature"))
    return s.select("horizon", "feature", place.alias("place"), c.flag(F.try_divide(F.col("test_ic"), F.nullif(F.col("train_ic"), F.lit(0.0))) < 0.5).alias("overfit"))


@query("dividend_score", f"""WITH {PANEL}, {CASH}, mc AS (SELECT ticker, last_day(date) AS period, arg_max(close, date) FILTER (WHERE close IS NOT NULL) AS close FROM panel GROUP BY 1, 2), md AS (SELECT ticker, last_day(ex_date) AS period, sum(value) AS paid FROM cash GROUP BY 1, 2),
y AS (SELECT ticker, period, round(sum(coalesce(paid, 0)) OVER (PARTITION BY ticker ORDER BY period ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) / close, 9) AS y FROM mc LEFT JOIN md USING (ticker, period)),
k AS (SELECT ticker, period, y, avg(y) OVER w + stddev_samp(y) OVER w AS cap FROM y WINDOW w AS (PARTITION BY ticker ORDER BY period ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)),
c AS (SELECT ticker, period, CASE WHEN y IS NOT NULL AND cap IS NOT NULL THEN least(y, cap) END AS c0, lag(y, 12) OVER w AS y1, lag(cap, 12) OVER w AS k1, lag(y, 24) OVER w AS y2, lag(cap, 24) OVER w AS k2 FROM k WINDOW w AS (PARTITION BY ticker ORDER BY period))
SELECT ticker, period, round((c0 + CASE WHEN y1 IS NOT NULL AND k1 IS NOT NULL THEN least(y1, k1) END + CASE WHEN y2 IS NOT NULL AND k2 IS NOT NULL THEN least(y2, k2) END) / 3, 6) AS score FROM c""")
def dividend_score(spark, sf):
    """Mean of the trailing yields now, one and two years ago, each at most its five-year mean plus one deviation."""
    w = c.by_time("ticker", "period")
    closes = grid.resample(a.panel(spark, sf), "ME", last=["close"])
    paid = grid.resample(a.cash_events(spark, sf).withColumnRenamed("ex_date", "date"), "ME", total=["value"])
    y = closes.join(paid, ["ticker", "period"], "left").withColumn("y", half_up(F.sum(F.coalesce("value_sum", F.lit(0.0))).over(c.frame(w, 12)) / F.col("close"), 9))
    cap = F.avg("y").over(c.frame(w, 60)) + F.stddev_samp("y").over(c.frame(w, 60))
    y = y.withColumn("cap", cap).withColumn("c", F.when(F.col("y").isNotNull() & F.col("cap").isNotNull(), F.least("y", "cap")))
    return y.select("ticker", "period", half_up((F.col("c") + F.lag("c", 12).over(w) + F.lag("c", 24).over(w)) / 3).alias("score"))


# The sign that each feature's IC is expected to have.
EXPECTED = {"mom13": 1, "mom4": 1, "vol13": -1, "drawdown26": 1, "volume4": 1, "range4": -1}


@query("signal_guard", f"""WITH {IC}, x AS (SELECT * FROM (VALUES {', '.join(map(repr, EXPECTED.items()))}) t(feature, expected)), s AS (SELECT feature, date, avg(ic) OVER (PARTITION BY feature ORDER BY date ROWS BETWEEN 51 PRECEDING AND CURRENT ROW) AS m, row_number() OVER (PARTITION BY feature ORDER BY date) AS n FROM ic WHERE horizon = 13),
q AS (SELECT feature, date, CASE WHEN round(m, 9) * expected < 0 THEN 1 ELSE 0 END AS against FROM s JOIN x USING (feature) WHERE n % 13 = 0),
a AS (SELECT feature, date, CASE WHEN against = 1 AND lag(against) OVER (PARTITION BY feature ORDER BY date) = 1 THEN 0 ELSE 1 END AS active FROM q), w AS (SELECT *, sum(active) OVER d AS live, count(*) OVER d AS n FROM a WINDOW d AS (PARTITION BY date))
SELECT feature, date, active, round(CASE WHEN live = 0 THEN 1.0 / n WHEN active = 1 THEN 1.0 / n + (n - live) * (1.0 / n) / live ELSE 0 END, 6) AS weight FROM w""")
def signal_guard(spark, sf):
    """Each quarter a feature's trailing IC is held against the sign expected of it: two checks against it running switch it off, the first that agrees
    switches it on again.  Its weight is dealt to the others; if none is left all keep their own."""
    w, day = c.by_time("feature"), Window.partitionBy("date")
    expected = spark.createDataFrame(list(EXPECTED.items()), "feature string, expected int")
    s = ic(spark, sf).filter("horizon = 13").withColumns({"m": half_up(F.avg("ic").over(c.frame(w, 52)), 9), "n": F.row_number().over(w)}).filter("n % 13 = 0").join(F.broadcast(expected), "feature")
    s = s.withColumn("against", c.flag(F.col("m") * F.col("expected") < 0))
    s = s.withColumn("active", F.when((F.col("against") == 1) & (F.lag("against").over(w) == 1), 0).otherwise(1)).withColumns({"live": F.sum("active").over(day), "k": F.count(F.lit(1)).over(day)})
    own = 1.0 / F.col("k")
    weight = F.when(F.col("live") == 0, own).when(F.col("active") == 1, own + (F.col("k") - F.col("live")) * own / F.col("live")).otherwise(0.0)
    return s.select("feature", "date", "active", half_up(weight).alias("weight"))


@query("portfolio_easing_switch", f"""WITH {MARKET}, x AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, coalesce(lag(rate, 1) OVER (ORDER BY date) < lag(rate, 4) OVER (ORDER BY date), false) AS easing FROM market)
SELECT date, CASE WHEN easing THEN 'market' ELSE 'cash' END AS asset, CAST(1 AS DOUBLE) AS weight FROM x WHERE i >= 5""")
def portfolio_easing_switch(spark, sf):
    """All in the market while the rate one row back is under that four rows back, else all in cash."""
    o = Window.orderBy("date")  # one row a week
    m = a.market(spark, sf).select("date", (F.row_number().over(o) - 1).alias("i"), F.coalesce(F.lag("rate", 1).over(o) < F.lag("rate", 4).over(o), F.lit(False)).alias("easing"))
    return m.filter("i >= 5").select("date", F.when(F.col("easing"), "market").otherwise("cash").alias("asset"), F.lit(1.0).alias("weight"))


@query("portfolio_two_buckets", f"""WITH {MARKET}, orders_w AS (SELECT CAST(date_trunc('week', o_orderdate) AS DATE) AS date, CAST(sum(CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT)) AS DOUBLE) / 100 / count(*) AS level FROM orders GROUP BY 1),
l AS (SELECT 'market' AS asset, date, level FROM market UNION ALL SELECT 'orders', date, level FROM orders_w), d AS (SELECT asset, date, round(level / {roll('avg', 'level', 26, key='asset')} - 1, 9) AS dist FROM l), s AS (SELECT asset, date, {lag('dist', key='asset')} AS dist FROM d),
b AS (SELECT date, CASE WHEN dist > 0 THEN asset ELSE 'cash' END AS asset FROM s) SELECT date, asset, CAST(sum(0.5) AS DOUBLE) AS weight FROM b GROUP BY 1, 2""")
def portfolio_two_buckets(spark, sf):
    """Each of two series owns half: it holds it while it stood above its 26-row mean a row before, else that half is in cash."""
    o = a.table(spark, sf, "orders").groupBy(F.to_date(F.date_trunc("week", "o_orderdate")).alias("date")).agg((F.sum(F.floor(F.col("o_totalprice") * 100 + 0.5)) / 100 / F.count("*")).alias("level"))
    levels = a.market(spark, sf).select(F.lit("market").alias("asset"), "date", "level").union(o.select(F.lit("orders"), "date", "level"))
    w = c.by_time("asset")
    d = levels.withColumn("dist", half_up(c.ratio("level", c.roll_mean("level", 26, w)) - 1, 9)).select("asset", "date", F.lag("dist").over(w).alias("dist"))
    return d.select("date", F.when(F.col("dist") > 0, F.col("asset")).otherwise("cash").alias("asset")).groupBy("date", "asset").agg(F.sum(F.lit(0.5)).alias("weight"))
