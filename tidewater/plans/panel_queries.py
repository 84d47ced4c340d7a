"""Queries over the dense panel: time-axis windows, cross-sections, market series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as c
from ..functions.ewm import ewm
from ..operators import grid
from . import adapters as a
from .oracle import BARS, MARKET, PANEL, lag, pct_rank, roll
from .registry import half_up, query, rounded

W = c.by_time  # called where it is used: a window needs a session
AMIHUD = "abs(ret) / nullif(volume, 0)"


@query("momentum_rank", f"""WITH {PANEL}, m AS (SELECT date, ticker, round({lag('close', 1)} / {lag('close', 13)} - 1, 9) AS mom FROM panel)
SELECT date, ticker, round(mom, 6) AS mom, round({pct_rank('mom', 'date')}, 6) AS mom_rank FROM m""")
def momentum_rank(spark, sf):
    m = a.panel(spark, sf).withColumn("mom", half_up(c.ratio(c.shift("close", 1, W()), c.shift("close", 13, W())) - 1, 9))
    return rounded(m.withColumn("mom_rank", c.pct_rank("mom", ["date"])), "date", "ticker", "mom", "mom_rank")


@query("panel_dense", f"WITH {PANEL} SELECT date, ticker, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, round(volume, 6) AS volume, round(ret, 6) AS ret FROM panel")
def panel_dense(spark, sf):
    return rounded(a.panel(spark, sf), "date", "ticker", "open", "high", "low", "close", "volume", "ret")


@query("calendar_ends", """WITH d AS (SELECT unnest(generate_series(min(CAST(l_shipdate AS DATE)), max(CAST(l_shipdate AS DATE)), INTERVAL 1 DAY))::DATE AS d FROM lineitem),
x AS (SELECT 'ME' AS rule, last_day(d) AS period FROM d UNION SELECT 'QE', last_day(CAST(date_trunc('quarter', d) + INTERVAL 2 MONTH AS DATE)) FROM d UNION SELECT 'W-FRI', CAST(d + CAST((12 - isodow(d)) % 7 AS INTEGER) AS DATE) FROM d)
SELECT rule, period FROM x""")
def calendar_ends(spark, sf):
    days = a.table(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("date"))
    parts = [grid.calendar(days, r).select(F.lit(r).alias("rule"), "period") for r in ("ME", "QE", "W-FRI")]
    return parts[0].union(parts[1]).union(parts[2])


@query("resample_monthly", f"""WITH {PANEL} SELECT ticker, last_day(date) AS period, round(arg_max(close, date) FILTER (WHERE close IS NOT NULL), 6) AS close, round(avg(volume), 6) AS volume_mean,
round(sum(volume), 6) AS volume_sum, round(product(1 + coalesce(ret, 0)) - 1, 6) AS ret_compound FROM panel GROUP BY 1, 2""")
def resample_monthly(spark, sf):
    r = grid.resample(a.panel(spark, sf), "ME", last=["close"], mean=["volume"], total=["volume"], compound=["ret"])
    return rounded(r, "ticker", "period", "close", "volume_mean", "volume_sum", "ret_compound")


@query("at_rebalance", f"""WITH {PANEL}, m AS (SELECT ticker, last_day(date) AS period, arg_max(close, date) FILTER (WHERE close IS NOT NULL) AS close FROM panel GROUP BY 1, 2)
SELECT ticker, period, round(last_value(close IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS close FROM m""")
def at_rebalance(spark, sf):
    p = a.panel(spark, sf)
    monthly = grid.resample(p, "ME", last=["close"])
    dates = monthly.select("ticker", "period")
    return rounded(grid.as_of(dates, monthly.withColumnRenamed("period", "at"), "ticker", "period", "at", ["close"]), "ticker", "period", "close")


@query("shift_change_diff", f"""WITH {PANEL} SELECT date, ticker, round({lag('close', 4)}, 6) AS lag4, round(lead(close, 4) OVER (PARTITION BY ticker ORDER BY date), 6) AS lead4, round(close / {lag('close', 13)} - 1, 6) AS change13,
round(close - {lag('close', 4)}, 6) AS diff4, round(ln(close), 6) AS log_close, CASE WHEN ret > 0 THEN round(ret, 6) END AS gain, round(CASE WHEN ret IS NOT NULL THEN greatest(least(ret, 0.1), -0.1) END, 6) AS clipped FROM panel""")
def shift_change_diff(spark, sf):
    p = a.panel(spark, sf).select("date", "ticker", c.shift("close", 4, W()).alias("lag4"), c.shift("close", -4, W()).alias("lead4"), c.pct_change("close", 13, W()).alias("change13"), c.diff("close", 4, W()).alias("diff4"), c.log("close").alias("log_close"), c.where("ret", F.col("ret") > 0).alias("gain"), c.clip("ret", -0.1, 0.1).alias("clipped"))
    return rounded(p, *p.columns)


@query("rolling_basic", f"""WITH {PANEL} SELECT date, ticker, round({roll('sum', 'ret', 13)}, 6) AS sum13, round({roll('avg', 'ret', 13)}, 6) AS mean13, round({roll('stddev_samp', 'ret', 13)}, 6) AS std13,
round({roll('var_samp', 'ret', 13)}, 6) AS var13, round({roll('min', 'close', 13)}, 6) AS min13, round({roll('max', 'close', 13)}, 6) AS max13 FROM panel""")
def rolling_basic(spark, sf):
    p = a.panel(spark, sf).select("date", "ticker", c.roll_sum("ret", 13, W()).alias("sum13"), c.roll_mean("ret", 13, W()).alias("mean13"), c.roll_std("ret", 13, W()).alias("std13"), c.roll_var("ret", 13, W()).alias("var13"), c.roll_min("close", 13, W()).alias("min13"), c.roll_max("close", 13, W()).alias("max13"))
    return rounded(p, *p.columns)


@query("rolling_median", f"WITH {PANEL} SELECT date, ticker, round({roll('quantile_cont({}, 0.5)', 'close', 13)}, 6) AS median13, round({roll('quantile_cont({}, 0.5)', 'volume', 13, 5)}, 6) AS volume13 FROM panel")
def rolling_median(spark, sf):
    p = a.panel(spark, sf).select("date", "ticker", c.roll_median("close", 13, W()).alias("median13"), c.roll_median("volume", 13, W(), 5).alias("volume13"))
    return rounded(p, *p.columns)


@query("rolling_skew_kurt", f"WITH {PANEL} SELECT date, ticker, round({roll('skewness', 'ret', 26, 13)}, 5) AS skew26, round({roll('kurtosis', 'ret', 26, 13)}, 5) AS kurt26 FROM panel")
def rolling_skew_kurt(spark, sf):
    p = a.panel(spark, sf).select("date", "ticker", half_up(c.roll_skew("ret", 26, W(), 13), 5).alias("skew26"), half_up(c.roll_kurt("ret", 26, W(), 13), 5).alias("kurt26"))
    return p


@query("ewm_moments", f"""WITH {PANEL}, n AS (SELECT date, ticker, close, row_number() OVER (PARTITION BY ticker ORDER BY date) AS i FROM panel),
x AS (SELECT date, ticker, i, close, count(close) OVER w AS k, sum(close * pow(1.0 - 2.0 / 14, -i)) OVER w AS s, sum(CASE WHEN close IS NOT NULL THEN pow(1.0 - 2.0 / 14, -i) END) OVER w AS t
FROM n WINDOW w AS (PARTITION BY ticker ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) SELECT date, ticker, round(CASE WHEN k >= 13 THEN s / t END, 5) AS ewm13 FROM x""")
def ewm_moments(spark, sf):
    return ewm(a.panel(spark, sf).select("date", "ticker", "close"), "close", 13).select("date", "ticker", half_up("close_ewm_mean", 5).alias("ewm13"))


@query("trend_signals", f"""WITH {PANEL}, x AS (SELECT date, ticker, close, {roll('avg', 'close', 40, 20)} AS ma40, {roll('max', 'close', 52, 1)} AS top52, {roll('avg', 'close', 10, 5)} AS ma10, {lag('close', 52)} AS year_ago FROM panel)
SELECT date, ticker, round(close / ma40 - 1, 6) AS ma_distance, round(close / top52 - 1, 6) AS drawdown52, round(close / ma10, 6) AS ratio_to_mean10, CASE WHEN coalesce(close > ma40, false) THEN 1 ELSE 0 END AS above_ma40,
round(close / year_ago - 1, 6) AS yoy, round(close - year_ago, 6) AS yoy_delta FROM x""")
def trend_signals(spark, sf):
    ma40, top = c.roll_mean("close", 40, W(), 20), c.roll_max("close", 52, W(), 1)
    p = a.panel(spark, sf).select("date", "ticker", (c.ratio("close", ma40) - 1).alias("ma_distance"), (c.ratio("close", top) - 1).alias("drawdown52"), c.ratio("close", c.roll_mean("close", 10, W(), 5)).alias("ratio_to_mean10"), c.flag(F.col("close") > ma40).alias("above_ma40"), c.pct_change("close", 52, W()).alias("yoy"), c.diff("close", 52, W()).alias("yoy_delta"))
    return rounded(p, *p.columns)


@query("risk_signals", f"""WITH {PANEL}, x AS (SELECT date, ticker, ret, {roll('stddev_samp', 'ret', 13)} AS vol, {roll('avg', 'ret', 13)} AS m, {roll('max', 'ret', 13)} AS best, {roll('min', 'ret', 13)} AS worst,
{roll('avg', '((high - low) / nullif(close, 0))', 13, 7)} AS hl, avg(CASE WHEN coalesce(ret > 0, false) THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS wr,
count(*) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS n FROM panel)
SELECT date, ticker, round({lag('vol')}, 6) AS vol, round({lag('best')}, 6) AS best, round({lag('worst')}, 6) AS worst, round((ret - m) / nullif(vol, 0), 6) AS z, round(hl, 6) AS range_mean, round(CASE WHEN n >= 13 THEN wr END, 6) AS win_rate FROM x""")
def risk_signals(spark, sf):
    x = a.panel(spark, sf).select("date", "ticker", "ret", c.roll_std("ret", 13, W()).alias("vol"), c.roll_mean("ret", 13, W()).alias("m"), c.roll_max("ret", 13, W()).alias("best"), c.roll_min("ret", 13, W()).alias("worst"), c.roll_mean(c.ratio(F.col("high") - F.col("low"), "close"), 13, W(), 7).alias("range_mean"), c.win_rate("ret", 13, W()).alias("win_rate"))
    x = x.select("date", "ticker", *(c.shift(k, 1, W()).alias(k) for k in ("vol", "best", "worst")), F.try_divide(F.col("ret") - F.col("m"), F.nullif(F.col("vol"), F.lit(0.0))).alias("z"), "range_mean", "win_rate")
    return rounded(x, *x.columns)


@query("volume_signals", f"""WITH {PANEL}, x AS (SELECT date, ticker, volume, abs(ret) / nullif(volume, 0) AS impact, {roll('avg', 'volume', 26, 13)} AS m, {roll('stddev_samp', 'volume', 26, 13)} AS s, {roll('avg', 'volume', 4, 2)} AS short FROM panel)
SELECT date, ticker, round((volume - m) / nullif(s, 0), 6) AS volume_z, round(short / nullif(m, 0), 6) AS volume_ratio, round({roll('avg', 'impact', 26, 13)} * 1e6, 6) AS amihud FROM x""")
def volume_signals(spark, sf):
    p = a.panel(spark, sf).withColumn("impact", F.try_divide(F.abs("ret"), F.nullif(F.col("volume"), F.lit(0.0))))
    m, s = c.roll_mean("volume", 26, W(), 13), c.roll_std("volume", 26, W(), 13)
    x = p.select("date", "ticker", F.try_divide(F.col("volume") - m, F.nullif(s, F.lit(0.0))).alias("volume_z"), F.try_divide(c.roll_mean("volume", 4, W(), 2), F.nullif(m, F.lit(0.0))).alias("volume_ratio"), (c.roll_mean("impact", 26, W(), 13) * 1e6).alias("amihud"))
    return rounded(x, *x.columns)


@query("beta_autocorr", f"""WITH {PANEL}, {MARKET}, x AS (SELECT p.date, ticker, CASE WHEN ret IS NOT NULL AND mret IS NOT NULL THEN ret END AS r, CASE WHEN ret IS NOT NULL AND mret IS NOT NULL THEN mret END AS m FROM panel p LEFT JOIN market USING (date)),
y AS (SELECT *, {lag('r')} AS l FROM x), z AS (SELECT *, CASE WHEN l IS NOT NULL THEN r END AS r2, CASE WHEN r IS NOT NULL THEN l END AS l2 FROM y)
SELECT date, ticker, round(CASE WHEN count(m) OVER w >= 16 THEN covar_samp(r, m) OVER w / nullif(var_samp(m) OVER w, 0) END, 6) AS beta26, round(CASE WHEN count(l2) OVER w >= 13 THEN covar_samp(r2, l2) OVER w / nullif(var_samp(l2) OVER w, 0) END, 6) AS autocorr26
FROM z WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 25 PRECEDING AND CURRENT ROW)""")
def beta_autocorr(spark, sf):
    p = a.panel(spark, sf).join(F.broadcast(a.market(spark, sf)), "date", "left")
    both = F.col("ret").isNotNull() & F.col("mret").isNotNull()
    p = p.withColumn("r", F.when(both, F.col("ret"))).withColumn("l", F.lag("r").over(W()))
    x = p.select("date", "ticker", c.roll_beta("r", "mret", 26, W(), 16).alias("beta26"), c.roll_beta("r", "l", 26, W(), 13).alias("autocorr26"))
    return rounded(x, *x.columns)


@query("market_series", f"""WITH {MARKET} SELECT date, round(level, 6) AS level, round(rate, 9) AS rate, round(mret, 6) AS mret, round(stddev_samp(mret) OVER (ORDER BY date ROWS BETWEEN 12 PRECEDING AND CURRENT ROW), 6) AS vol13,
round(product(1 + rate) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1, 6) AS cum_rate, CASE WHEN coalesce(lag(rate, 1) OVER (ORDER BY date) < lag(rate, 4) OVER (ORDER BY date), false) THEN 1 ELSE 0 END AS easing FROM market""")
def market_series(spark, sf):
    w = Window.orderBy("date")  # one row a week for the whole market
    m = a.market(spark, sf).select("date", half_up("level", 6).alias("level"), half_up("rate", 9).alias("rate"), half_up("mret", 6).alias("mret"), half_up(F.stddev_samp("mret").over(w.rowsBetween(-12, 0)), 6).alias("vol13"), half_up(F.product(1 + F.col("rate")).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1, 6).alias("cum_rate"), c.flag(F.lag("rate", 1).over(w) < F.lag("rate", 4).over(w)).alias("easing"))
    return m


@query("glitch_flags", f"""WITH {PANEL}, x AS (SELECT date, ticker, ret, CASE WHEN coalesce(ret > 1 OR ret < -0.45, false) THEN 1 ELSE 0 END AS g FROM panel), y AS (SELECT *, {roll('max', 'g', 12)} AS has_glitch FROM x)
SELECT date, ticker, has_glitch, CASE WHEN coalesce(has_glitch, 0) <> 1 THEN round(ret, 6) END AS masked, count(ret) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS history FROM y""")
def glitch_flags(spark, sf):
    x = a.panel(spark, sf).withColumn("g", c.flag((F.col("ret") > 1) | (F.col("ret") < -0.45))).withColumn("has_glitch", c.roll_max("g", 12, W()))
    return x.select("date", "ticker", "has_glitch", half_up(c.mask_glitch("ret", "has_glitch"), 6).alias("masked"), F.count("ret").over(c.history(W())).alias("history"))


@query("forward_returns", f"""WITH {PANEL}, h AS (SELECT unnest([5, 10, 20, 60]) AS horizon), x AS (SELECT date, ticker, 5 AS horizon, lead(close, 5) OVER w / close - 1 AS f FROM panel WINDOW w AS (PARTITION BY ticker ORDER BY date)
UNION ALL SELECT date, ticker, 10, lead(close, 10) OVER w / close - 1 FROM panel WINDOW w AS (PARTITION BY ticker ORDER BY date) UNION ALL SELECT date, ticker, 20, lead(close, 20) OVER w / close - 1 FROM panel WINDOW w AS (PARTITION BY ticker ORDER BY date)
UNION ALL SELECT date, ticker, 60, lead(close, 60) OVER w / close - 1 FROM panel WINDOW w AS (PARTITION BY ticker ORDER BY date)), y AS (SELECT date, ticker, horizon, round(f, 9) AS f FROM x WHERE f IS NOT NULL)
SELECT date, ticker, horizon, round(f, 6) AS forward, CASE WHEN f > quantile_cont(f, 0.5) OVER (PARTITION BY date, horizon) THEN 1 ELSE 0 END AS beats_median, CASE WHEN f > 0 THEN 1 ELSE 0 END AS is_positive FROM y""")
def forward_returns(spark, sf):
    from ..operators.discovery import binary_targets
    from ..operators.discovery import forward_returns as forward

    f = forward(a.panel(spark, sf), [5, 10, 20, 60]).withColumn("forward", half_up("forward", 9))
    return binary_targets(f).select("date", "ticker", "horizon", half_up("forward", 6).alias("forward"), "beats_median", "is_positive")


@query("cross_section", f"""WITH {PANEL} SELECT date, ticker, round({pct_rank('ret', 'date')}, 6) AS rank, round((ret - avg(ret) OVER d) / nullif(stddev_samp(ret) OVER d, 0), 5) AS zscore, round(ret - avg(ret) OVER d, 6) AS demeaned,
CASE WHEN volume <= quantile_cont(volume, 0.5) OVER d THEN 1 ELSE 0 END AS small, CASE WHEN volume >= quantile_cont(volume, 0.25) OVER d THEN 1 ELSE 0 END AS above_floor FROM panel WINDOW d AS (PARTITION BY date)""")
def cross_section(spark, sf):
    p = a.panel(spark, sf)
    return p.select("date", "ticker", half_up(c.pct_rank("ret", ["date"]), 6).alias("rank"), half_up(c.zscore("ret", ["date"]), 5).alias("zscore"), half_up(c.demean("ret", ["date"]), 6).alias("demeaned"), c.flag(F.col("volume") <= c.quantile("volume", 0.5, ["date"])).alias("small"), c.flag(F.col("volume") >= c.quantile("volume", 0.25, ["date"])).alias("above_floor"))


@query("universe_mask", f"""WITH {PANEL} SELECT date, ticker, CASE WHEN coalesce({roll('avg', 'volume', 20, 10)} >= 100000, false) AND coalesce(close >= 1, false) AND count(close) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) >= 100 THEN 1 ELSE 0 END AS in_universe FROM panel""")
def universe_mask(spark, sf):
    ok = F.coalesce(c.roll_mean("volume", 20, W(), 10) >= 100_000, F.lit(False)) & F.coalesce(F.col("close") >= 1, F.lit(False)) & (F.count("close").over(c.history(W())) >= 100)
    return a.panel(spark, sf).select("date", "ticker", c.flag(ok).alias("in_universe"))


@query("price_drops", f"WITH {BARS}, x AS (SELECT date, ticker, close, {lag('close')} AS prior FROM bars) SELECT date, ticker, round(close, 6) AS close, round(prior, 6) AS prior, round(close / prior, 6) AS ratio FROM x WHERE close / prior < 0.4 ORDER BY close / prior, ticker, date LIMIT 20")
def price_drops(spark, sf):
    x = a.bars(spark, sf).withColumn("prior", F.lag("close").over(W())).withColumn("r", c.ratio("close", "prior")).filter("r < 0.4")
    return x.orderBy("r", "ticker", "date").limit(20).select("date", "ticker", half_up("close").alias("close"), half_up("prior").alias("prior"), half_up("r").alias("ratio"))


@query("liquidity_median", f"WITH {PANEL}, x AS (SELECT date, ticker, coalesce(volume, 0) AS v FROM panel) SELECT date, ticker, round({roll('quantile_cont({}, 0.5)', 'v', 26)}, 6) AS adtv FROM x")
def liquidity_median(spark, sf):
    return a.panel(spark, sf).withColumn("v", F.coalesce("volume", F.lit(0.0))).select("date", "ticker", half_up(c.roll_median("v", 26, W()), 6).alias("adtv"))


@query("expanding_percentile", f"""WITH {MARKET}, x AS (SELECT date, level, row_number() OVER (ORDER BY date) AS n FROM market)
SELECT a.date, round(CASE WHEN a.n >= 12 THEN avg(CASE WHEN a.level >= b.level THEN 1.0 ELSE 0.0 END) END, 6) AS percentile FROM x a JOIN x b ON b.n <= a.n GROUP BY a.date, a.n""")
def expanding_percentile(spark, sf):
    h = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)  # one row a week for the whole market
    m = a.market(spark, sf).withColumn("past", F.collect_list("level").over(h))
    share = F.size(F.filter("past", lambda v: v <= F.col("level"))) / F.size("past")
    return m.select("date", half_up(F.when(F.size("past") >= 12, share), 6).alias("percentile"))


@query("true_range", f"""WITH {PANEL}, x AS (SELECT date, ticker, close, high, low, {lag('close')} AS pc, row_number() OVER (PARTITION BY ticker ORDER BY date) AS i FROM panel),
y AS (SELECT *, CASE WHEN pc IS NOT NULL THEN greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr FROM x),
z AS (SELECT date, ticker, close, count(tr) OVER w AS k, sum(tr * pow(1 - 2.0 / 15, -i)) OVER w AS s, sum(CASE WHEN tr IS NOT NULL THEN pow(1 - 2.0 / 15, -i) END) OVER w AS t FROM y WINDOW w AS (PARTITION BY ticker ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT date, ticker, round(CASE WHEN k >= 14 THEN s / t END / close, 5) AS atr FROM z""")
def true_range(spark, sf):
    pc = F.lag("close").over(W())
    x = a.panel(spark, sf).withColumn("tr", F.when(pc.isNotNull(), F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - pc), F.abs(F.col("low") - pc))))
    return ewm(x.select("date", "ticker", "close", "tr"), "tr", 14).select("date", "ticker", half_up(c.ratio("tr_ewm_mean", "close"), 5).alias("atr"))


EWMA = "sum({}) OVER h / sum(CASE WHEN sq IS NOT NULL THEN pow(14.0 / 12.0, k) END) OVER h"


@query("ewma_volatility", f"""WITH {PANEL}, x AS (SELECT date, ticker, ret * ret AS sq, row_number() OVER (PARTITION BY ticker ORDER BY date) AS k FROM panel),
m AS (SELECT date, ticker, count(sq) OVER h AS n, {EWMA.format('sq * pow(14.0 / 12.0, k)')} AS mean, {EWMA.format('sq * sq * pow(14.0 / 12.0, k)')} AS square, sum(CASE WHEN sq IS NOT NULL THEN pow(14.0 / 12.0, k) END) OVER h AS w, sum(CASE WHEN sq IS NOT NULL THEN pow(14.0 / 12.0, 2 * k) END) OVER h AS v
  FROM x WINDOW h AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT date, ticker, round(CASE WHEN n >= 13 THEN sqrt(52 * mean) END, 6) AS ewma_vol, round(CASE WHEN n >= 13 THEN sqrt(greatest(square - mean * mean, 0) * w * w / nullif(w * w - v, 0)) END, 5) AS sq_std FROM m""")
def ewma_volatility(spark, sf) -> DataFrame:
    x = a.panel(spark, sf).withColumn("sq", F.col("ret") * F.col("ret"))
    return ewm(x.select("date", "ticker", "sq", "ret"), "sq", 13).select("date", "ticker", half_up(F.sqrt(52 * F.col("sq_ewm_mean")), 6).alias("ewma_vol"), half_up("sq_ewm_std", 5).alias("sq_std"))
