"""Queries that select, weight and measure portfolios: the composed ones are rows of parameters."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import columns as c
from ..operators import metrics, portfolio
from . import adapters as a
from .oracle import BARS, MARKET, PANEL, PNL, lag, pct_rank, roll
from .registry import half_up, query, rounded

W = c.by_time  # called where it is used: a window needs a session

SIGNALS = f"""{PANEL}, {MARKET},
s0 AS (SELECT p.date, p.ticker, s_nationkey AS root, close, ret, round({roll('avg', 'volume', 13, 4).replace('PARTITION BY ticker', 'PARTITION BY p.ticker')}, 4) AS adtv,
  round({lag('close', 1)} / {lag('close', 13)} - 1, 9) AS mom, round({roll('stddev_samp', 'ret', 13)}, 9) AS vol, round({roll('avg', 'ret', 13)}, 9) AS mean,
  round(avg(CASE WHEN coalesce(ret > 0, false) THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 12 PRECEDING AND CURRENT ROW), 9) AS win,
  round(close / {roll('avg', 'close', 26, 13)} - 1, 9) AS dist FROM panel p JOIN supplier ON s_suppkey = ticker),
signals AS (SELECT *, -vol AS low_vol, round(mean / nullif(vol, 0), 9) AS sharpe, -dist AS reversion, round(0.5 * ({pct_rank('mom', 'date')}) + 0.5 * ({pct_rank('-vol', 'date')}), 9) AS multi, round(win - abs(mom), 9) AS frog FROM s0)"""


def signals(spark, sf):
    """The panel with one column per named signal, company roots and average volume."""
    p = a.panel(spark, sf).join(F.broadcast(a.roots(spark, sf)), "ticker")  # roots: one row a ticker, as the panel's tickers are few against its rows
    s = p.select(
        "date", "ticker", "root", "close", "ret", half_up(c.roll_mean("volume", 13, W(), 4), 4).alias("adtv"), half_up(c.ratio(c.shift("close", 1, W()), c.shift("close", 13, W())) - 1, 9).alias("mom"),
        half_up(c.roll_std("ret", 13, W()), 9).alias("vol"), half_up(c.roll_mean("ret", 13, W()), 9).alias("mean"), half_up(c.win_rate("ret", 13, W(), 1), 9).alias("win"), half_up(c.ratio("close", c.roll_mean("close", 26, W(), 13)) - 1, 9).alias("dist"),
    )
    s = s.withColumns({"low_vol": -F.col("vol"), "sharpe": half_up(F.try_divide(F.col("mean"), F.nullif(F.col("vol"), F.lit(0.0))), 9), "reversion": -F.col("dist"), "frog": half_up(F.col("win") - F.abs("mom"), 9)})
    return s.withColumn("multi", half_up(0.5 * c.pct_rank("mom", ["date"]) + 0.5 * c.pct_rank("low_vol", ["date"]), 9))


@query("named_signals", f"WITH {SIGNALS} SELECT date, ticker, root, round(adtv, 4) AS adtv, round(mom, 6) AS mom, round(low_vol, 6) AS low_vol, round(sharpe, 6) AS sharpe, round(win, 6) AS win, round(reversion, 6) AS reversion, round(multi, 6) AS multi FROM signals")
def named_signals(spark, sf):
    s = signals(spark, sf)
    return s.select("date", "ticker", "root", half_up("adtv", 4).alias("adtv"), *(half_up(k).alias(k) for k in ("mom", "low_vol", "sharpe", "win", "reversion", "multi")))


def hold_sql(signal: str, pct: float, eligible: str, weighting: str = "equal", order: str = "DESC") -> str:
    w = "1.0 / count(*) OVER (PARTITION BY date)" if weighting == "equal" else "adtv / sum(adtv) OVER (PARTITION BY date)"
    return f"""WITH {SIGNALS}, seen AS (SELECT date, ticker, root, {lag(signal)} AS sig, {lag('adtv')} AS adtv, lag(CASE WHEN {eligible} THEN 1 ELSE 0 END) OVER (PARTITION BY ticker ORDER BY date) AS ok FROM signals),
names AS (SELECT * FROM seen WHERE ok = 1 AND sig IS NOT NULL QUALIFY row_number() OVER (PARTITION BY date, root ORDER BY coalesce(adtv, -1) DESC, ticker) = 1),
ranked AS (SELECT *, count(*) OVER (PARTITION BY date) AS n, row_number() OVER (PARTITION BY date ORDER BY sig {order}, ticker) AS k FROM names),
held AS (SELECT * FROM ranked WHERE n >= 5 AND k <= greatest(5, CAST(floor(n * {pct}) AS INTEGER)))
SELECT date, ticker, round({w}, 6) AS weight FROM held"""


LIQUID = "coalesce(adtv >= 100000, false)"
# Weekly books of liquid names as (signal, share held, eligibility, weighting): the sleeves that the queries below combine and measure.
RANK_AND_HOLD = {
    "low_vol": ("low_vol", 0.1, LIQUID, "equal"),
    "momentum_sharpe": ("sharpe", 0.1, LIQUID, "equal"),
    "multifactor": ("multi", 0.1, LIQUID, "equal"),
    "high_turnover": ("adtv", 0.1, "coalesce(dist > 0, false)", "adtv"),
}


def held(spark, sf, name):
    signal, pct, eligible, weighting = RANK_AND_HOLD[name]
    return portfolio.rank_and_hold(signals(spark, sf), signal, F.expr(eligible), pct=pct, weighting=weighting)


for _name, (_signal, _pct, _eligible, _weighting) in RANK_AND_HOLD.items():
    query(f"weekly_{_name}", hold_sql(_signal, _pct, _eligible, _weighting))(lambda spark, sf, n=_name: rounded(held(spark, sf, n), "date", "ticker", "weight"))


@query("best_class_per_root", f"WITH {SIGNALS} SELECT date, root, ticker FROM signals WHERE close IS NOT NULL QUALIFY row_number() OVER (PARTITION BY date, root ORDER BY coalesce(adtv, -1) DESC, ticker) = 1")
def best_class_per_root(spark, sf):
    return portfolio.best_per_root(signals(spark, sf).filter("close is not null")).select("date", "root", "ticker")


@query("merged_classes", f"""WITH {SIGNALS}, w AS (SELECT date, root, ticker, adtv, 1.0 / count(*) OVER (PARTITION BY date) AS weight FROM signals WHERE mom > 0)
SELECT date, root, round(sum(weight), 6) AS weight, arg_max(ticker, (coalesce(adtv, -1), -ticker)) AS ticker FROM w GROUP BY 1, 2""")
def merged_classes(spark, sf):
    return rounded(portfolio.merge_classes(portfolio.equal_weights(signals(spark, sf).filter("mom > 0"))), "date", "root", "weight", "ticker")


@query("bottom_by_volatility", f"WITH {SIGNALS}, r AS (SELECT date, ticker, vol, count(*) OVER (PARTITION BY date) AS n, row_number() OVER (PARTITION BY date ORDER BY vol, ticker) AS place FROM signals WHERE vol IS NOT NULL) SELECT date, ticker, place FROM r WHERE place <= greatest(5, CAST(floor(n * 0.33) AS INTEGER))")
def bottom_by_volatility(spark, sf):
    return portfolio.top(signals(spark, sf), "vol", pct=0.33, least_held=5, descending=False).select("date", "ticker", "place")


@query("capped_cap_weights", f"""WITH {SIGNALS}, w AS (SELECT date, ticker, adtv / sum(adtv) OVER (PARTITION BY date) AS w FROM signals WHERE adtv > 0), o AS (SELECT *, row_number() OVER d - 1 AS k, coalesce(sum(w) OVER (PARTITION BY date ORDER BY w DESC, ticker ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM w WINDOW d AS (PARTITION BY date ORDER BY w DESC, ticker)),
f AS (SELECT *, (1 - k * 0.02) / nullif(1 - b, 0) AS scale FROM o), m AS (SELECT *, min(CASE WHEN w * scale <= 0.02 * (1 + 1e-12) AND scale >= 0 THEN k END) OVER (PARTITION BY date) AS first FROM f)
SELECT date, ticker, round(CASE WHEN first IS NULL OR k < first THEN 0.02 ELSE w * (1 - first * 0.02) / (1 - (SELECT 0) - max(CASE WHEN k = first THEN b END) OVER (PARTITION BY date)) END, 6) AS weight FROM m""")
def capped_cap_weights(spark, sf):
    return rounded(portfolio.capped_weights(signals(spark, sf), "adtv", 0.02), "date", "ticker", "weight")


CAPPED_INVERSE = f"""WITH {SIGNALS}, w AS (SELECT date, ticker, (1 / vol) / sum(1 / vol) OVER (PARTITION BY date) AS w FROM signals WHERE vol > 0), o AS (SELECT *, row_number() OVER d - 1 AS k, coalesce(sum(w) OVER (PARTITION BY date ORDER BY w DESC, ticker ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM w WINDOW d AS (PARTITION BY date ORDER BY w DESC, ticker)),
f AS (SELECT *, (1 - k * 0.05) / nullif(1 - b, 0) AS scale FROM o), m AS (SELECT *, min(CASE WHEN w * scale <= 0.05 * (1 + 1e-12) AND scale >= 0 THEN k END) OVER (PARTITION BY date) AS first FROM f),
c AS (SELECT date, ticker, CASE WHEN first IS NULL OR k < first THEN 0.05 ELSE w * (1 - first * 0.05) / (1 - max(CASE WHEN k = first THEN b END) OVER (PARTITION BY date)) END AS weight FROM m)"""


@query("inverse_vol_capped", f"{CAPPED_INVERSE} SELECT date, ticker, round(weight, 6) AS weight FROM c")
def inverse_vol_capped(spark, sf):
    """Weights in inverse proportion to volatility, none over the cap; where names times cap stay under one, so does their sum."""
    s = signals(spark, sf).filter("vol > 0").withColumn("inv", 1 / F.col("vol"))
    return rounded(portfolio.capped_weights(s, "inv", 0.05), "date", "ticker", "weight")


@query("inverse_vol_capped_full", f"{CAPPED_INVERSE} SELECT date, ticker, round(weight / sum(weight) OVER (PARTITION BY date), 6) AS weight FROM c")
def inverse_vol_capped_full(spark, sf):
    """As before, scaled to a sum of one."""
    s = signals(spark, sf).filter("vol > 0").withColumn("inv", 1 / F.col("vol"))
    return rounded(portfolio.capped_weights(s, "inv", 0.05, renormalise=True), "date", "ticker", "weight")


@query("blended_weights", f"""WITH {SIGNALS}, t AS (SELECT date, ticker, adtv, multi FROM signals WHERE adtv > 0 AND multi > 0) SELECT date, ticker, round(0.5 * adtv / sum(adtv) OVER (PARTITION BY date) + 0.5 * multi / sum(multi) OVER (PARTITION BY date), 6) AS weight FROM t""")
def blended_weights(spark, sf):
    s = signals(spark, sf).filter("adtv > 0 and multi > 0")
    return s.select("date", "ticker", half_up(portfolio.blend(c.share("adtv", ["date"]), c.share("multi", ["date"]))).alias("weight"))


@query("regime_share", f"""WITH {MARKET}, x AS (SELECT date, lag(rate, 1) OVER o < lag(rate, 4) OVER o AS easing, lag(level, 1) OVER o > avg(level) OVER (ORDER BY date ROWS BETWEEN 40 PRECEDING AND 1 PRECEDING) AS up FROM market WINDOW o AS (ORDER BY date))
SELECT date, CAST(CASE WHEN coalesce(easing AND up, false) THEN 0.2 WHEN coalesce(easing OR up, false) THEN 0.1 ELSE 0.0 END AS DOUBLE) AS held_share, CASE WHEN coalesce(easing AND up, false) THEN false WHEN coalesce(easing OR up, false) THEN false ELSE true END AS parked FROM x""")
def regime_share(spark, sf):
    o = Window.orderBy("date")  # one row a week
    m = a.market(spark, sf).withColumn("easing", F.lag("rate", 1).over(o) < F.lag("rate", 4).over(o)).withColumn("up", F.lag("level", 1).over(o) > F.avg("level").over(o.rowsBetween(-40, -1)))
    e, u = F.col("easing"), F.col("up")
    return portfolio.regime(m, [(e & u, 0.2, False), (e | u, 0.1, False)], (0.0, True)).select("date", "held_share", "parked")


@query("sticky_books", f"""WITH {SIGNALS}, r AS (SELECT date, ticker, count(*) OVER (PARTITION BY date) AS n, row_number() OVER (PARTITION BY date ORDER BY mom DESC, ticker) AS k FROM signals WHERE mom > 0.5), sel AS (SELECT date, list(ticker) AS book FROM r WHERE n >= 20 AND k <= 10 GROUP BY 1),
c AS (SELECT date, last_value(book IGNORE NULLS) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS book FROM (SELECT DISTINCT date FROM panel) LEFT JOIN sel USING (date)) SELECT date, unnest(book) AS ticker FROM c WHERE book IS NOT NULL""")
def sticky_books(spark, sf):
    s = signals(spark, sf)
    chosen = portfolio.top(s.filter("mom > 0.5"), "mom", n=10, least_names=20)
    return portfolio.sticky(chosen.select("date", "ticker"), s.select("date").distinct())


SLEEVE_BOOKS = ("low_vol", "momentum_sharpe", "multifactor")


def sleeve_returns(spark, sf):
    """(date, sleeve, ret): three books and cash.

    The books share eligibility and weighting and differ in their signal, so the signals are computed once and a book is part of every later key.
    """
    w = W()
    seen = signals(spark, sf).withColumn("ok", F.expr(LIQUID)).select(
        "date", "ticker", "root", "ret", F.lag("adtv").over(w).alias("adtv"), F.lag("ok").over(w).alias("ok"), *(F.lag(RANK_AND_HOLD[n][0]).over(w).alias(f"_{n}") for n in SLEEVE_BOOKS)
    )
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("sleeve"), F.col(f"_{n}").alias("signal")) for n in SLEEVE_BOOKS)))
    names = seen.select("date", "ticker", "root", "ret", "adtv", "ok", each.alias("e")).select("date", "ticker", "root", "ret", "adtv", "ok", "e.sleeve", "e.signal").filter("ok and signal is not null")
    best = portfolio.best_per_root(names, ("sleeve", "date", "root"))
    held = portfolio.equal_weights(portfolio.top(best, "signal", pct=0.1, least_names=5, least_held=5, across=("sleeve", "date")), ("sleeve", "date"))
    books = held.groupBy("date", "sleeve").agg(half_up(F.sum(F.col("weight") * F.coalesce("ret", F.lit(0.0))), 9).alias("ret"))
    return books.union(a.market(spark, sf).select("date", F.lit("cash").alias("sleeve"), F.col("rate").alias("ret")))


def book_sql(name: str) -> str:
    signal, pct, eligible, weighting = RANK_AND_HOLD[name]
    body = hold_sql(signal, pct, eligible, weighting)
    inner = body[len(f"WITH {SIGNALS}, ") :].replace("seen", f"seen_{name}").replace("names", f"names_{name}").replace("ranked", f"ranked_{name}").replace("held", f"held_{name}")
    ctes, final = inner.rsplit("\nSELECT", 1)
    return f"{ctes}, {name} AS (SELECT{final.replace('round(', '(').replace(', 6)', ')')})"


SLEEVES = f"""{SIGNALS}, {', '.join(book_sql(n) for n in ('low_vol', 'momentum_sharpe', 'multifactor'))},
sleeves AS ({' UNION ALL '.join(f"SELECT b.date, '{n}' AS sleeve, round(sum(weight * coalesce(p.ret, 0)), 9) AS ret FROM {n} b JOIN panel p ON p.date = b.date AND p.ticker = b.ticker GROUP BY 1" for n in ('low_vol', 'momentum_sharpe', 'multifactor'))}
UNION ALL SELECT date, 'cash', rate FROM market)"""


@query("sleeve_returns", f"WITH {SLEEVES} SELECT date, sleeve, round(ret, 6) AS ret FROM sleeves")
def sleeve_returns_query(spark, sf):
    return rounded(sleeve_returns(spark, sf), "date", "sleeve", "ret")


@query("strategy_summary", f"""WITH {SLEEVES}, g AS (SELECT *, product(1 + ret) OVER (PARTITION BY sleeve ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM sleeves WHERE ret IS NOT NULL), d AS (SELECT *, cum / greatest(max(cum) OVER (PARTITION BY sleeve ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1) - 1 AS dd FROM g),
t AS (SELECT sleeve, count(ret) AS periods, product(1 + ret) - 1 AS total_return, stddev_samp(ret) * sqrt(52) AS volatility, avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(52) AS sharpe, min(dd) AS max_drawdown FROM d GROUP BY 1),
a AS (SELECT *, CASE WHEN total_return > -1 THEN pow(1 + total_return, 52.0 / periods) - 1 END AS annual_return FROM t)
SELECT sleeve, periods, round(log10(1 + total_return), 6) AS total_log10, round(log10(1 + annual_return), 6) AS annual_log10, round(volatility, 6) AS volatility, round(sharpe, 6) AS sharpe, round(max_drawdown, 6) AS max_drawdown,
round(log10(CASE WHEN annual_return > 0 THEN annual_return END / nullif(abs(max_drawdown), 0)), 6) AS calmar_log10 FROM a""")
def strategy_summary(spark, sf):
    """Growth, annual return and Calmar ratio as logarithms: the given prices move so much that the numbers themselves fill no double's digits alike."""
    m = metrics.summary(sleeve_returns(spark, sf), "sleeve")
    calmar = F.log10(F.when(F.col("annual_return") > 0, F.col("calmar")))
    m = m.withColumns({"total_log10": F.log10(1 + F.col("total_return")), "annual_log10": F.log10(1 + F.col("annual_return")), "calmar_log10": calmar})
    return rounded(m, "sleeve", "periods", "total_log10", "annual_log10", "volatility", "sharpe", "max_drawdown", "calmar_log10")


@query("strategy_correlations", f"""WITH {SLEEVES} SELECT x.sleeve AS a, y.sleeve AS b, count(*) AS n, round(covar_samp(x.ret, y.ret) / nullif(stddev_samp(x.ret) * stddev_samp(y.ret), 0), 6) AS corr FROM sleeves x JOIN sleeves y ON x.date = y.date AND x.sleeve <= y.sleeve GROUP BY 1, 2""")
def strategy_correlations(spark, sf):
    return rounded(metrics.correlations(sleeve_returns(spark, sf), "sleeve"), "a", "b", "n", "corr")


@query("rolling_sharpe", f"""WITH {SLEEVES} SELECT sleeve, date, round(CASE WHEN count(ret) OVER w >= 36 THEN coalesce(avg(ret) OVER w / nullif(stddev_samp(ret) OVER w, 0), 0) * sqrt(52) END, 5) AS rolling_sharpe FROM sleeves WHERE sleeve <> 'cash' WINDOW w AS (PARTITION BY sleeve ORDER BY date ROWS BETWEEN 35 PRECEDING AND CURRENT ROW)""")
def rolling_sharpe(spark, sf):
    return metrics.rolling_sharpe(sleeve_returns(spark, sf).filter("sleeve <> 'cash'"), 36, "sleeve").select("sleeve", "date", half_up("rolling_sharpe", 5).alias("rolling_sharpe"))


@query("period_summary", f"""WITH {SLEEVES}, p AS (SELECT * FROM (VALUES ('early', DATE '1995-01-01', DATE '1997-12-31'), ('late', DATE '1998-01-01', DATE '2001-12-31')) t(name, a, b)) SELECT sleeve, name, count(ret) AS periods, round(stddev_samp(ret) * sqrt(52), 6) AS volatility FROM sleeves JOIN p ON date BETWEEN a AND b WHERE ret IS NOT NULL GROUP BY 1, 2""")
def period_summary(spark, sf):
    p = spark.sql("select * from values ('early', date'1995-01-01', date'1997-12-31'), ('late', date'1998-01-01', date'2001-12-31') t(name, start, end)")
    return rounded(metrics.by_period(sleeve_returns(spark, sf), p, "sleeve"), "sleeve", "name", "periods", "volatility")


@query("inverse_vol_sleeves", f"""WITH {SLEEVES}, v AS (SELECT date, sleeve, nullif(CASE WHEN count(ret) OVER w >= 2 THEN stddev_samp(ret) OVER w END, 0) AS vol FROM sleeves WHERE sleeve <> 'cash' WINDOW w AS (PARTITION BY sleeve ORDER BY date ROWS BETWEEN 36 PRECEDING AND 1 PRECEDING)),
f AS (SELECT date, sleeve, coalesce(vol, avg(vol) OVER (PARTITION BY date)) AS vol FROM v) SELECT date, sleeve, round((1 / vol) / sum(1 / vol) OVER (PARTITION BY date), 6) AS weight FROM f WHERE vol IS NOT NULL""")
def inverse_vol_sleeves(spark, sf):
    return rounded(portfolio.inverse_vol_sleeves(sleeve_returns(spark, sf).filter("sleeve <> 'cash'")), "date", "sleeve", "weight")


def sharpe_sql(with_cash: bool) -> str:
    own = "" if with_cash else "WHERE sleeve <> 'cash'"
    return f"""WITH {SLEEVES}, own AS (SELECT * FROM sleeves {own}), grid AS (SELECT date, sleeve FROM (SELECT DISTINCT date FROM own), (SELECT DISTINCT sleeve FROM own)),
x AS (SELECT g.date, g.sleeve, o.ret FROM grid g LEFT JOIN own o ON o.date = g.date AND o.sleeve = g.sleeve),
t AS (SELECT date, sleeve, count(*) OVER w AS rows, round(CASE WHEN count(ret) OVER w >= 3 AND stddev_samp(ret) OVER w > 0 THEN avg(ret) OVER w / stddev_samp(ret) OVER w * sqrt(12) ELSE 0 END, 9) AS s FROM x WINDOW w AS (PARTITION BY sleeve ORDER BY date ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, s >= 0 AS ok, sum(CASE WHEN s >= 0 THEN s ELSE 0 END) OVER d AS total, sum(CASE WHEN s >= 0 THEN 1 ELSE 0 END) OVER d AS n_ok, count(*) OVER d AS n FROM t WINDOW d AS (PARTITION BY date)),
v AS (SELECT date, sleeve, CASE WHEN rows < 3 THEN 1.0 / n WHEN n_ok = 0 THEN CASE WHEN sleeve = 'cash' THEN 1.0 ELSE 0.0 END WHEN NOT ok THEN 0.0 WHEN total = 0 THEN 1.0 / n_ok ELSE s / total END AS weight FROM c),
e AS (SELECT * FROM v {"" if with_cash else "UNION ALL SELECT DISTINCT date, 'cash', 1.0 FROM c WHERE rows >= 3 AND n_ok = 0"})
SELECT date, sleeve, round(weight, 6) AS weight FROM e"""


@query("rolling_sharpe_sleeves", sharpe_sql(True))
def rolling_sharpe_sleeves(spark, sf):
    return rounded(portfolio.rolling_sharpe_sleeves(sleeve_returns(spark, sf)), "date", "sleeve", "weight")


@query("rolling_sharpe_books", sharpe_sql(False))
def rolling_sharpe_books(spark, sf):
    """The same among the books alone; cash holds everything on dates on which they all fail."""
    return rounded(portfolio.rolling_sharpe_sleeves(sleeve_returns(spark, sf).filter("sleeve <> 'cash'")), "date", "sleeve", "weight")


# The share of equity by (rates easing, market calm).
BUDGET = {(True, True): 0.8, (True, False): 0.5, (False, True): 0.3, (False, False): 0.0}


@query("regime_budgets", f"""WITH {SLEEVES}, m AS (SELECT date, coalesce(lag(rate, 1) OVER o < lag(rate, 4) OVER o, false) AS easing, coalesce(lag(level, 1) OVER o > avg(level) OVER (ORDER BY date ROWS BETWEEN 26 PRECEDING AND 1 PRECEDING), false) AS calm FROM market WINDOW o AS (ORDER BY date)),
b AS (SELECT date, CASE WHEN easing AND calm THEN 0.8 WHEN easing THEN 0.5 WHEN calm THEN 0.3 ELSE 0.0 END AS equity FROM m), k AS (SELECT date, sleeve, count(*) OVER (PARTITION BY date) AS n FROM sleeves WHERE sleeve <> 'cash')
SELECT b.date, sleeve, round(equity / n, 6) AS weight FROM b JOIN k USING (date) WHERE equity > 0 UNION ALL SELECT b.date, 'cash', round(CASE WHEN b.date IN (SELECT date FROM k) THEN 1 - equity ELSE 1.0 END, 6) FROM b""")
def regime_budgets(spark, sf):
    """Equity's share by the two-flag table, dealt equally to the date's books; cash takes the rest, and all where no book lives."""
    o = Window.orderBy("date")  # one row a week
    m = a.market(spark, sf).select("date", (F.lag("rate", 1).over(o) < F.lag("rate", 4).over(o)).alias("easing"), (F.lag("level", 1).over(o) > F.avg("level").over(o.rowsBetween(-26, -1))).alias("calm"))
    return rounded(portfolio.regime_budgets(sleeve_returns(spark, sf).filter("sleeve <> 'cash'"), m, BUDGET), "date", "sleeve", "weight")


@query("vol_target_exposure", f"""WITH {MARKET}, v AS (SELECT date, CASE WHEN count(mret) OVER w >= 13 THEN stddev_samp(mret) OVER w * sqrt(52) END AS vol FROM market WINDOW w AS (ORDER BY date ROWS BETWEEN 13 PRECEDING AND 1 PRECEDING))
SELECT date, round(CASE WHEN vol IS NOT NULL AND vol <> 0 THEN greatest(least(0.2 / vol, 1), 0) END, 6) AS exposure FROM v""")
def vol_target_exposure(spark, sf):
    v = portfolio.vol_target(a.market(spark, sf).withColumnRenamed("mret", "ret"), 0.2, 13)
    return v.select("date", half_up(F.when(F.count("ret").over(Window.orderBy("date").rowsBetween(-13, -1)) >= 13, F.col("exposure"))).alias("exposure"))


@query("portfolio_turnover", f"""WITH {SIGNALS}, {book_sql('low_vol')}, d AS (SELECT date, lead(date) OVER (ORDER BY date) AS next FROM (SELECT DISTINCT date FROM panel)), e AS (SELECT date, ticker, weight FROM low_vol UNION ALL SELECT next, ticker, -weight FROM low_vol JOIN d USING (date) WHERE next IS NOT NULL)
SELECT date, round(sum(abs(w)), 6) AS turnover FROM (SELECT date, ticker, sum(weight) AS w FROM e GROUP BY 1, 2) GROUP BY 1""")
def portfolio_turnover(spark, sf):
    return rounded(portfolio.turnover(held(spark, sf, "low_vol"), a.panel(spark, sf)), "date", "turnover")


NAV = f"""{SIGNALS}, {book_sql('low_vol')}, f AS (SELECT min(date) AS date FROM (SELECT DISTINCT date FROM low_vol) GROUP BY date_trunc('month', date)), r AS (SELECT date AS r, lead(date) OVER (ORDER BY date) AS until FROM f),
days AS (SELECT r, d.date FROM (SELECT DISTINCT date FROM panel) d JOIN r ON d.date > r AND (until IS NULL OR d.date <= until)),
h AS (SELECT days.r, days.date, b.ticker, b.weight, 1 + coalesce(greatest(least(p.ret, 5.0), -0.9), 0) AS g FROM days JOIN low_vol b ON b.date = days.r LEFT JOIN panel p ON p.date = days.date AND p.ticker = b.ticker),
v AS (SELECT r, date, weight, weight * product(g) OVER (PARTITION BY r, ticker ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v FROM h),
s AS (SELECT r, date, sum(v) + 1 - sum(weight) AS inside FROM v GROUP BY 1, 2), e AS (SELECT r, arg_max(inside, date) AS fin FROM s GROUP BY 1),
c AS (SELECT r, coalesce(product(fin) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS start FROM e)"""


@query("drifted_nav", f"""WITH {NAV} SELECT date, round(log10(start * inside), 6) AS nav_log10 FROM s JOIN c USING (r)""")
def drifted_nav(spark, sf):
    """The low-volatility book rebalanced on each month's first date that has one."""
    return nav(spark, sf).select("date", half_up(F.log10("nav")).alias("nav_log10"))


def nav(spark, sf):
    book = held(spark, sf, "low_vol")
    firsts = book.groupBy(F.trunc("date", "month")).agg(F.min("date").alias("date")).select("date")
    return metrics.drifted_nav(book.join(F.broadcast(firsts), "date"), a.panel(spark, sf))  # dates: one row a month


@query("nav_metric_row", f"""WITH {NAV}, path AS (SELECT date, start * inside AS value FROM s JOIN c USING (r)), pd AS (SELECT min(value / peak - 1) AS dd FROM (SELECT value, max(value) OVER (ORDER BY date) AS peak FROM path)),
me AS (SELECT last_day(date) AS date, arg_max(value, date) AS value FROM path GROUP BY 1), mr AS (SELECT round(value / lag(value) OVER (ORDER BY date) - 1, 9) AS ret FROM me),
t AS (SELECT count(ret) AS periods, product(1 + ret) AS total, stddev_samp(ret) AS sd, avg(ret) AS mean FROM mr WHERE ret IS NOT NULL)
SELECT periods, round(log10(pow(total, 12.0 / periods)), 5) AS annual_log10, round(sd * sqrt(12), 5) AS volatility, round(mean / nullif(sd, 0) * sqrt(12), 5) AS sharpe, round(dd, 6) AS max_drawdown FROM t, pd""")
def nav_metric_row(spark, sf):
    """Monthly returns of the book above, with the drawdown of its daily path."""
    path = nav(spark, sf).select(F.lit("low_vol").alias("strategy"), "date", F.col("nav").alias("value"))
    ends = path.groupBy("strategy", F.last_day("date").alias("date")).agg(F.max_by("value", "date").alias("value"))
    returns = ends.withColumn("ret", half_up(c.pct_change("value", 1, c.by_time("strategy")), 9))
    m = metrics.metric_row(returns, path)
    return m.select("periods", half_up(F.log10(1 + F.col("annual_return")), 5).alias("annual_log10"), half_up("volatility", 5).alias("volatility"), half_up("sharpe", 5).alias("sharpe"), half_up("max_drawdown").alias("max_drawdown"))


@query("index_level", f"""WITH {BARS}, p AS (SELECT CAST(date_trunc('quarter', date) AS DATE) AS period, ticker, date, close, volume FROM bars), m AS (SELECT period, ticker, sum(volume) / sum(sum(volume)) OVER (PARTITION BY period) AS weight, arg_min(close, date) AS base, max(date) AS ends FROM p GROUP BY 1, 2),
a AS (SELECT m.*, cut FROM m JOIN (SELECT DISTINCT period, ends AS cut FROM m) c ON c.period = m.period AND m.ends >= cut), x AS (SELECT a.period, a.ticker, weight, base, cut, p.close AS price FROM a ASOF JOIN p ON p.period = a.period AND p.ticker = a.ticker AND a.cut >= p.date),
y AS (SELECT *, coalesce(lag(price) OVER (PARTITION BY period, ticker ORDER BY cut), base) AS start FROM x), g AS (SELECT period, cut, sum(weight * price / base) / nullif(sum(weight * start / base), 0) AS g FROM y GROUP BY 1, 2)
SELECT period, round(product(g), 6) AS growth FROM g GROUP BY 1""")
def index_level(spark, sf):
    p = a.bars(spark, sf).withColumn("period", F.trunc("date", "quarter"))
    members = p.groupBy("period", "ticker").agg(F.sum("volume").alias("v")).withColumn("weight", c.share("v", ["period"])).select("period", "ticker", "weight")
    return rounded(portfolio.index_level(p.select("period", "ticker", "date", "close"), members), "period", "growth")


@query("tax_carry_forward", f"""WITH RECURSIVE {PNL}, n AS (SELECT *, row_number() OVER (PARTITION BY account ORDER BY period) AS i FROM pnl),
walk AS (SELECT account, period, i, pnl, sales, CAST(0 AS DOUBLE) AS carried, CASE WHEN sales > 20 OR pnl < 0 THEN greatest(0, -pnl) ELSE 0 END AS after FROM n WHERE i = 1
UNION ALL SELECT n.account, n.period, n.i, n.pnl, n.sales, w.after, CASE WHEN n.sales > 20 OR n.pnl < 0 THEN greatest(0, w.after - n.pnl) ELSE w.after END FROM walk w JOIN n ON n.account = w.account AND n.i = w.i + 1)
SELECT account, period, round(carried, 4) AS carried, round(CASE WHEN pnl > 0 AND sales > 20 THEN 0.15 * greatest(0, pnl - carried) ELSE 0 END, 4) AS tax FROM walk""")
def tax_carry_forward(spark, sf):
    return metrics.loss_carry_forward(a.pnl(spark, sf), 0.15, 20.0).select("account", "period", half_up("carried", 4).alias("carried"), half_up("tax", 4).alias("tax"))


@query("contribution_nav", f"""WITH RECURSIVE {MARKET}, n AS (SELECT date, coalesce(mret, 0) AS r, row_number() OVER (ORDER BY date) AS i FROM market), walk AS (SELECT date, i, 1000.0 * (1 + r) + 10 AS nav FROM n WHERE i = 1 UNION ALL SELECT n.date, n.i, w.nav * (1 + n.r) + 10 FROM walk w JOIN n ON n.i = w.i + 1) SELECT date, round(nav, 3) AS nav FROM walk""")
def contribution_nav(spark, sf):
    m = a.market(spark, sf).select("date", F.lit("m").alias("strategy"), F.col("mret").alias("ret"), F.lit(10.0).alias("contribution"))
    return metrics.contribution_nav(m, 1000.0).select("date", half_up("nav", 3).alias("nav"))


@query("underinvested", f"WITH {SIGNALS}, w AS (SELECT date, multi / count(*) OVER (PARTITION BY date) AS weight FROM signals WHERE multi > 0.3) SELECT date, round(sum(weight), 8) AS invested FROM w GROUP BY 1 HAVING sum(weight) > 0 AND sum(weight) < 1 - 1e-4")
def underinvested(spark, sf):
    w = signals(spark, sf).filter("multi > 0.3").withColumn("weight", F.col("multi") / F.count("*").over(Window.partitionBy("date")))
    return metrics.underinvested(w).select("date", half_up("invested", 8).alias("invested"))


@query("leverage_grid", f"WITH {MARKET}, l AS (SELECT unnest([1.0, 1.5, 2.0]) AS leverage) SELECT date, CAST(leverage AS DOUBLE) AS leverage, round(leverage * mret - (leverage - 1) * (rate + 0.02 / 52), 6) AS ret FROM market CROSS JOIN l")
def leverage_grid(spark, sf):
    m = a.market(spark, sf).withColumn("leverage", F.explode(F.array(F.lit(1.0), F.lit(1.5), F.lit(2.0))))
    return m.select("date", "leverage", half_up(F.col("leverage") * F.col("mret") - (F.col("leverage") - 1) * (F.col("rate") + 0.02 / 52)).alias("ret"))
