"""The rank-and-hold portfolios on a month-end grid: one engine, one row of parameters each.

Daily bars become month-end closes, mean daily turnover and daily-derived levels; signals are expressions over those.  Everything a
book reads stands one row before its month: signal, turnover and price; regime flags at their own offsets.

A line item's unit price is drawn at random, so a close of its own would jump by several times each month and every name would count as
a glitch.  The close is therefore the mean price of the last 63 days, weighted by quantity.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as c
from ..functions.ewm import ewm
from ..functions.prefix import Rolling
from ..operators import fundamentals as fu
from ..operators import portfolio
from . import adapters as a
from .oracle import BARS, FILINGS, MARKET, PANEL, lag, pct_rank, roll
from .registry import half_up, query

# Fixed values of the specs; turnover floors are scaled to the given tables (mean daily turnover of a supplier is about 40,000).
MIN_ADTV, MIN_ADTV_SMALL, MIN_PRICE = 30_000.0, 3_000.0, 1.0


@dataclass(frozen=True)
class Spec:
    """One portfolio: the signal's column, its first row, how names are chosen, and the regime table."""

    signal: str
    start: int
    top_pct: float | None = 0.10
    top_n: int | None = None
    min_names: int = 5
    min_hold: int | None = None
    min_adtv: float = MIN_ADTV
    low: float | None = None
    high: float | None = None
    small: bool = False
    one_class: bool = False
    sticky: bool = False
    regime: tuple[tuple[str, float | None, bool], ...] | None = None  # (condition over flags, share held, park), first true one

    @property
    def least(self) -> int:
        return self.min_names if self.min_hold is None else self.min_hold


EASY_CALM = (("easing and not stressed", 0.15, False), ("not easing and not stressed", 0.10, False), ("easing and stressed", 0.05, False), ("true", None, True))
SPECS = {
    "adaptive_low_vol": Spec("blended_vol", 13, regime=EASY_CALM),
    "cdi_ma200": Spec("above", 13, top_pct=1.0, min_names=1, regime=(("easing", 1.0, False), ("true", None, True))),
    "frog_in_pan": Spec("frog", 14),
    "low_pe": Spec("yield_e", 1, top_pct=None, top_n=10, min_names=3, low=1 / 30, high=1.0, one_class=True),
    "low_vol": Spec("low_vol", 13),
    "momentum_sharpe": Spec("sharpe", 14),
    "multifactor": Spec("composite", 14),
    "regime_switching": Spec("composite", 14, regime=(("above_ma", None, False), ("true", None, True))),
    "research_multifactor": Spec("research", 14, regime=(("int(easing) + int(calm) + int(uptrend) >= 2", None, False), ("true", None, True))),
    "simple_mean_reversion": Spec("loser", 2, sticky=True),
    "smallcap_momentum": Spec("mom6", 8, top_pct=0.20, min_adtv=MIN_ADTV_SMALL, small=True),
    "value_quality": Spec("value_quality", 1, top_pct=0.20, min_names=3, one_class=True),
    "volume_breakout": Spec("accelerating", 8, sticky=True),
    "win_rate_mean_rev": Spec("band_loser", 6, min_names=1, min_hold=5),
}


def days(spark, sf) -> DataFrame:
    """(date, ticker, volume, close, ret, range): every trading day of every ticker; daily windows are differences of running sums."""
    w = c.by_time()
    daily = a.panel(spark, sf, "day").select("date", "ticker", "volume", "close", half_up(c.ratio(F.col("high") - F.col("low"), "close"), 9).alias("range"))
    traded = Rolling(daily, {"volume": F.col("volume"), "quantity": c.ratio("volume", "close")})
    priced = traded.select("date", "ticker", "volume", "range", traded.ratio("volume", "quantity", 63, 1).alias("known"))
    priced = priced.select("date", "ticker", "volume", "range", F.last("known", ignorenulls=True).over(c.history(w)).alias("close"))
    return priced.withColumn("ret", half_up(c.pct_change("close", 1, w), 9))


def months(spark, sf) -> DataFrame:
    """(date, i, ticker, root, px, adtv, ...): month-end closes and levels, numbered by month.

    What a book does not read is never computed, since nothing here hides a column from the planner.
    """
    d = days(spark, sf)
    levels = Rolling(d.withColumn("move", F.abs("ret")), {"close": F.col("close"), "win": c.flag(F.col("ret") > 0)})
    d = levels.select("date", "ticker", "close", "volume", "move", levels.mean("close", 200).alias("ma"), levels.mean("win", 20).alias("wr"))
    rates = Rolling(d, {"wr": F.col("wr")})
    d = ewm(rates.select(*d.columns, rates.mean("wr", 60).alias("wr60")), "move", 14)
    last = lambda x: F.max_by(x, "date").alias(x)
    m = d.groupBy("ticker", F.last_day("date").alias("month")).agg(
        F.max_by("close", "date").alias("px"), half_up(F.avg("volume"), 4).alias("adtv"), last("ma"), last("wr"), last("wr60"), half_up(F.max_by("move_ewm_mean", "date"), 9).alias("atr")
    )
    t = Window.partitionBy("ticker").orderBy("month")
    m = m.withColumns({"i": F.row_number().over(t) - 1, "ret": half_up(c.pct_change("px", 1, t), 9)})  # the grid is dense, so every ticker has every month
    m = m.join(a.roots(spark, sf), "ticker")
    past = lambda f, x, n: f(c.shift(x, 1, t), n, t)
    log_ret = F.when(F.col("ret") > -1, F.log1p("ret"))
    odd = ((F.col("ret") > 1.0) | (F.col("ret") < -0.9)).cast("double")
    m = m.withColumns({"log_ret": log_ret, "odd": F.coalesce(odd, F.lit(0.0)), "rises": F.when(F.col("ret").isNotNull(), c.flag(F.col("ret") > 0).cast("double"))})
    jump = F.coalesce(((F.col("ret") > 1.0) | (F.col("ret") < -0.45)).cast("double"), F.lit(0.0))
    return m.select(
        F.col("month").alias("date"), "i", "ticker", "root", "px", "adtv", "ret", "atr", c.rolling(F.max, jump, 12, t).alias("glitch"),
        half_up(past(c.roll_sum, "log_ret", 12), 9).alias("mom12"),
        half_up(past(c.roll_sum, "log_ret", 6), 9).alias("mom6_raw"),
        half_up(past(c.roll_sum, "rises", 12), 9).alias("rises12"),
        half_up(past(c.roll_std, "ret", 12), 9).alias("vol12_past"),
        *(half_up(c.roll_std("ret", n, t), 9).alias(f"vol{n}") for n in (12, 5, 2)),
        past(c.roll_max, "odd", 12).alias("odd12"), past(c.roll_max, "odd", 6).alias("odd6"), c.shift("ret", 1, t).alias("ret_past"),
        half_up(c.ratio(c.shift("adtv", 1, t), past(c.roll_mean, "adtv", 6)), 9).alias("speed"),
        half_up(c.ratio("px", "ma") - 1, 9).alias("dist"),
        half_up(c.ratio("wr", F.col("wr60") + 1e-8), 9).alias("wins"),
    )


def root_months(spark, sf) -> DataFrame:
    """(root, date): every company and every month of the panel."""
    traded = a.table(spark, sf, "lineitem").filter("l_quantity > 0").select(F.last_day("l_shipdate").alias("date")).distinct()
    calendar = traded.agg(F.collect_set("date").alias("dates"))  # one row
    return a.roots(spark, sf).select("root").distinct().crossJoin(F.broadcast(calendar)).select("root", F.explode("dates").alias("date"))


def named(spark, sf) -> DataFrame:
    """The months with one column per signal, larger being better."""
    m = months(spark, sf)
    f = a.filings(spark, sf).withColumn("root", (F.col("company") % 25).cast("int"))
    known = fu.known_on(root_months(spark, sf), f, ["net_income", "equity", "shares"], key="root")
    m = m.join(known, ["root", "date"], "left")
    rank = lambda x: c.pct_rank(x, ["date"])
    unmasked = F.coalesce("glitch", F.lit(0.0)) != 1
    kept = lambda x: F.when(unmasked, x)
    cap = F.when((F.col("px") > 0) & (F.col("shares") > 0), F.col("px") * F.col("shares"))
    m = m.withColumns({
        "pe": half_up(F.when(F.col("net_income") > 0, cap / (F.col("net_income") * 1000)), 9), "pb": half_up(F.when(F.col("equity") > 0, cap / (F.col("equity") * 1000)), 9),
        "roe": half_up(F.when(F.col("equity") > 0, F.col("net_income") / F.col("equity")), 9), "mom_kept": kept(F.col("mom12")), "calm_kept": kept(-F.col("vol12_past")),
    }).withColumn("cheap", F.when((F.col("pb") <= 5.0) & (F.col("pb") > 0), F.col("pb")))
    frog = 0.5 * rank("mom12") + 0.5 * rank("rises12")
    research = 0.2 * rank("dist") + 0.2 * rank(-F.col("vol5")) + 0.2 * rank(-F.col("atr")) + 0.2 * rank(-F.col("vol2")) + 0.2 * rank("adtv")
    loser = F.when((F.col("ret") <= 1.0) & (F.col("ret") >= -0.9), -F.col("ret"))
    in_band = (F.col("glitch") == 0) & (F.col("wins") >= 0.75) & (F.col("wins") <= 1.25)
    return m.select(
        "date", "i", "ticker", "root", "px", "adtv", kept(-(0.5 * F.col("vol5") + 0.5 * F.col("vol2"))).alias("blended_vol"), F.when(unmasked & (F.col("dist") > 0), 1.0).alias("above"),
        half_up(F.when(F.coalesce("odd12", F.lit(0.0)) != 1, frog), 9).alias("frog"), half_up(F.try_divide(F.lit(1.0), F.nullif("pe", F.lit(0.0))), 9).alias("yield_e"), kept(-F.col("vol12")).alias("low_vol"),
        half_up(kept(F.try_divide(F.col("mom12"), F.nullif("vol12_past", F.lit(0.0)))), 9).alias("sharpe"), half_up(0.5 * rank("mom_kept") + 0.5 * rank("calm_kept"), 9).alias("composite"),
        half_up(kept(research), 9).alias("research"), loser.alias("loser"), kept(F.col("mom6_raw")).alias("mom6"), half_up(c.nan_add(0.5 * (1.0 - rank("cheap")), 0.5 * rank("roe")), 9).alias("value_quality"),
        F.when((F.col("ret_past") > 0) & (F.coalesce("odd6", F.lit(0.0)) != 1), F.col("speed")).alias("accelerating"), F.when(in_band, -F.col("ret")).alias("band_loser"),
    )


def flags(spark, sf) -> DataFrame:
    """(date, i, easing, stressed, calm, uptrend, above_ma): one row a month, each flag as a book of that month may read it."""
    o = Window.orderBy("date")  # one row a day, and below one a month
    d = a.market(spark, sf, "day", 252).select("date", "level", "rate", c.roll_std("mret", 20, o).alias("vol"), (c.ratio("level", F.lag("level", 20).over(o)) - 1).alias("gain"))
    last = lambda x: half_up(F.max_by(x, "date"), 9).alias(x)
    m = d.groupBy(F.last_day("date").alias("date")).agg(last("level"), half_up(F.product(1 + F.col("rate")) - 1, 12).alias("cash"), last("vol"), last("gain")).withColumn("i", F.row_number().over(o) - 1)
    earlier = m.select(F.col("i").alias("j"), F.col("vol").alias("other"))
    ranked = m.join(F.broadcast(earlier), F.col("j") <= F.col("i")).groupBy("i").agg(  # months against months
        F.when(F.count("other") >= 12, F.sum(c.flag(F.col("vol") >= F.col("other"))) / F.count("*")).alias("rank")
    )
    m = m.join(F.broadcast(ranked), "i")
    seen = lambda x, n: F.coalesce(F.lag(x, n).over(o), F.lit(False))
    m = m.withColumns({"ma": c.rolling(F.avg, "level", 10, o), "down": F.lag("cash", 1).over(o) < F.lag("cash", 4).over(o)})
    m = m.withColumns({"is_calm": F.col("rank") <= 0.70, "is_stressed": F.col("rank") > 0.70, "is_up": F.col("gain") > 0, "is_above": F.col("level") > half_up("ma", 9)})
    return m.select("date", "i", seen("down", 0).alias("easing"), seen("is_stressed", 1).alias("stressed"), seen("is_calm", 1).alias("calm"), seen("is_up", 1).alias("uptrend"), seen("is_above", 1).alias("above_ma"))


def book(spark, sf, name: str) -> DataFrame:
    """(date, asset, weight) of a spec: ticker numbers as text, and cash."""
    return books(named(spark, sf), flags(spark, sf), SPECS[name])


def books(panel: DataFrame, regime: DataFrame, spec: Spec) -> DataFrame:
    """The spec's books over ``panel`` (date, i, ticker, root, px, adtv and its signal), with ``regime`` (date, i, flags)."""
    t = Window.partitionBy("ticker").orderBy("i")
    rules = spec.regime or (("true", None, False),)
    share, parked = F.lit(spec.top_pct).cast("double"), F.lit(True)
    for cond, pct, park in reversed(rules):
        yes: Column = F.expr(cond)
        share, parked = F.when(yes, F.lit(pct if pct is not None else spec.top_pct)).otherwise(share), F.when(yes, F.lit(park)).otherwise(parked)
    plan = regime.filter(F.col("i") >= spec.start).select("i", "date", share.alias("share"), parked.alias("parked"))
    seen = panel.select("i", "date", "ticker", "root", *(F.lag(x, 1).over(t).alias(y) for x, y in ((spec.signal, "sig"), ("adtv", "adtv"), ("px", "px"))))
    names = seen.filter((F.col("i") >= spec.start) & (F.col("adtv") >= spec.min_adtv) & (F.col("px") >= MIN_PRICE) & F.col("sig").isNotNull())
    if spec.low is not None:
        names = names.filter(F.col("sig").between(spec.low, spec.high))
    if spec.small:
        names = names.withColumn("middle", c.quantile("adtv", 0.5, ["i"])).filter("adtv <= middle").drop("middle")
    if spec.one_class:
        names = portfolio.best_per_root(names, ("i", "root"))
    month = Window.partitionBy("i")
    ranked = names.join(F.broadcast(plan.select("i", "share", "parked")), "i").filter("not parked").withColumn("n", F.count(F.lit(1)).over(month)).withColumn("k", F.row_number().over(month.orderBy(F.desc("sig"), "ticker")))
    size = F.lit(spec.top_n) if spec.top_n else F.greatest(F.lit(spec.least), F.floor(F.col("n") * F.col("share")).cast("int"))
    chosen = ranked.filter((F.col("n") >= spec.min_names) & (F.col("k") <= size)).select("date", F.col("ticker").cast("string").alias("asset"))
    if spec.sticky:
        chosen = portfolio.sticky(chosen.withColumnRenamed("asset", "ticker"), plan.select("date")).withColumnRenamed("ticker", "asset")
    out = portfolio.equal_weights(chosen).select("date", "asset", "weight")
    if spec.regime:
        idle = plan.join(out.select("date").distinct(), "date", "left_anti")  # parked, or too few names
        out = out.union(idle.select("date", F.lit("cash"), F.lit(1.0)))
    return out


# ---- the same in SQL, written from the specs

DAILY = f"{BARS}, {PANEL.split(BARS + ',')[1]}".replace("'week'", "'day'")
DAILY_MARKET = MARKET.replace("'week'", "'day'").replace("/ 52", "/ 252")
MONTHS = f"""{DAILY}, {DAILY_MARKET}, {FILINGS},
p0 AS (SELECT date, ticker, volume, round(sum(volume) OVER q / sum(volume / close) OVER q, 6) AS known FROM panel WINDOW q AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 62 PRECEDING AND CURRENT ROW)),
p1 AS (SELECT date, ticker, volume, last_value(known IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS close FROM p0),
priced AS (SELECT *, round(close / {lag('close')} - 1, 9) AS ret FROM p1),
d1 AS (SELECT date, ticker, close, volume, abs(ret) AS move, {roll('avg', 'close', 200)} AS ma, avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END) OVER f20 AS wr0, count(*) OVER f20 AS n20, row_number() OVER (PARTITION BY ticker ORDER BY date) AS k
  FROM priced WINDOW f20 AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
d2 AS (SELECT *, CASE WHEN n20 >= 20 THEN wr0 END AS wr FROM d1),
d3 AS (SELECT *, {roll('avg', 'wr', 60)} AS wr60, CASE WHEN count(move) OVER h >= 14 THEN sum(move * pow(15.0 / 13.0, k)) OVER h / sum(CASE WHEN move IS NOT NULL THEN pow(15.0 / 13.0, k) END) OVER h END AS atr
  FROM d2 WINDOW h AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
m0 AS (SELECT ticker, last_day(date) AS date, arg_max_null(close, date) AS px, round(avg(volume), 4) AS adtv, arg_max_null(ma, date) AS ma, arg_max_null(wr, date) AS wr, arg_max_null(wr60, date) AS wr60, round(arg_max_null(atr, date), 9) AS atr FROM d3 GROUP BY 1, 2),
m1 AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) - 1 AS i, round(px / {lag('px')} - 1, 9) AS ret FROM m0),
m2 AS (SELECT m1.*, s_nationkey AS root, CASE WHEN ret > -1 THEN ln(1 + ret) END AS log_ret, CASE WHEN ret > 1 OR ret < -0.9 THEN 1.0 ELSE 0.0 END AS odd, CASE WHEN ret > 1 OR ret < -0.45 THEN 1.0 ELSE 0.0 END AS jump,
  CASE WHEN ret > 0 THEN 1.0 WHEN ret IS NOT NULL THEN 0.0 END AS rises FROM m1 JOIN supplier ON s_suppkey = ticker),
m3 AS (SELECT *, {lag('log_ret')} AS log_past, {lag('rises')} AS rises_past, {lag('ret')} AS ret_past, {lag('odd')} AS odd_past, {lag('adtv')} AS adtv_past FROM m2),
m4 AS (SELECT date, i, ticker, root, px, adtv, ret, atr, {roll('max', 'jump', 12)} AS glitch, round({roll('sum', 'log_past', 12)}, 9) AS mom12, round({roll('sum', 'log_past', 6)}, 9) AS mom6, round({roll('sum', 'rises_past', 12)}, 9) AS rises12,
  round({roll('stddev_samp', 'ret_past', 12)}, 9) AS vol12p, round({roll('stddev_samp', 'ret', 12)}, 9) AS vol12, round({roll('stddev_samp', 'ret', 5)}, 9) AS vol5, round({roll('stddev_samp', 'ret', 2)}, 9) AS vol2,
  {roll('max', 'odd_past', 12)} AS odd12, {roll('max', 'odd_past', 6)} AS odd6, ret_past, round(adtv_past / {roll('avg', 'adtv_past', 6)}, 9) AS speed, round(px / ma - 1, 9) AS dist, round(wr / (wr60 + 1e-8), 9) AS wins FROM m3),
rf AS (SELECT company % 25 AS root, filing_date, arg_max(net_income, (version, filing_id)) FILTER (WHERE net_income IS NOT NULL) AS ni, arg_max(equity, (version, filing_id)) FILTER (WHERE equity IS NOT NULL) AS eq,
  arg_max(shares, (version, filing_id)) FILTER (WHERE shares IS NOT NULL) AS sh FROM filings GROUP BY 1, 2),
kd AS (SELECT DISTINCT root, date FROM m4),
k1 AS (SELECT kd.root, kd.date, CASE WHEN kd.date - r.filing_date <= 400 THEN r.ni END AS ni FROM kd ASOF LEFT JOIN (SELECT * FROM rf WHERE ni IS NOT NULL) r ON r.root = kd.root AND kd.date >= r.filing_date),
k2 AS (SELECT kd.root, kd.date, CASE WHEN kd.date - r.filing_date <= 400 THEN r.eq END AS eq FROM kd ASOF LEFT JOIN (SELECT * FROM rf WHERE eq IS NOT NULL) r ON r.root = kd.root AND kd.date >= r.filing_date),
k3 AS (SELECT kd.root, kd.date, CASE WHEN kd.date - r.filing_date <= 400 THEN r.sh END AS sh FROM kd ASOF LEFT JOIN (SELECT * FROM rf WHERE sh IS NOT NULL) r ON r.root = kd.root AND kd.date >= r.filing_date),
m5 AS (SELECT m4.*, CASE WHEN px > 0 AND sh > 0 AND ni > 0 THEN round(px * sh / (ni * 1000), 9) END AS pe, CASE WHEN px > 0 AND sh > 0 AND eq > 0 THEN round(px * sh / (eq * 1000), 9) END AS pb, CASE WHEN eq > 0 THEN round(ni / eq, 9) END AS roe,
  coalesce(glitch, 0) <> 1 AS clean FROM m4 JOIN k1 USING (root, date) JOIN k2 USING (root, date) JOIN k3 USING (root, date)),
m6 AS (SELECT *, CASE WHEN clean THEN mom12 END AS momk, CASE WHEN clean THEN -vol12p END AS calmk, CASE WHEN pb <= 5 AND pb > 0 THEN pb END AS cheap, -vol5 AS nv5, -vol2 AS nv2, -atr AS natr FROM m5),
m7 AS (SELECT *, {pct_rank('mom12', 'date')} AS r_mom, {pct_rank('rises12', 'date')} AS r_rise, {pct_rank('momk', 'date')} AS r_momk, {pct_rank('calmk', 'date')} AS r_calmk, {pct_rank('dist', 'date')} AS r_dist, {pct_rank('nv5', 'date')} AS r_v5,
  {pct_rank('natr', 'date')} AS r_atr, {pct_rank('nv2', 'date')} AS r_v2, {pct_rank('adtv', 'date')} AS r_adtv, {pct_rank('cheap', 'date')} AS r_cheap, {pct_rank('roe', 'date')} AS r_roe FROM m6),
named AS (SELECT date, i, ticker, root, px, adtv, CASE WHEN clean THEN -(0.5 * vol5 + 0.5 * vol2) END AS blended_vol, CASE WHEN clean AND dist > 0 THEN 1.0 END AS above, CASE WHEN coalesce(odd12, 0) <> 1 THEN round(0.5 * r_mom + 0.5 * r_rise, 9) END AS frog,
  round(1.0 / nullif(pe, 0), 9) AS yield_e, CASE WHEN clean THEN -vol12 END AS low_vol, CASE WHEN clean THEN round(mom12 / nullif(vol12p, 0), 9) END AS sharpe, round(0.5 * r_momk + 0.5 * r_calmk, 9) AS composite,
  CASE WHEN clean THEN round(0.2 * r_dist + 0.2 * r_v5 + 0.2 * r_atr + 0.2 * r_v2 + 0.2 * r_adtv, 9) END AS research, CASE WHEN ret <= 1 AND ret >= -0.9 THEN -ret END AS loser, CASE WHEN clean THEN mom6 END AS mom6,
  CASE WHEN r_cheap IS NOT NULL OR r_roe IS NOT NULL THEN round(coalesce(0.5 * (1 - r_cheap), 0) + coalesce(0.5 * r_roe, 0), 9) END AS value_quality,
  CASE WHEN ret_past > 0 AND coalesce(odd6, 0) <> 1 THEN speed END AS accelerating, CASE WHEN glitch = 0 AND wins BETWEEN 0.75 AND 1.25 THEN -ret END AS band_loser FROM m7),
f0 AS (SELECT date, level, rate, CASE WHEN count(mret) OVER w >= 20 THEN stddev_samp(mret) OVER w END AS vol, level / lag(level, 20) OVER (ORDER BY date) - 1 AS gain FROM market WINDOW w AS (ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
f1 AS (SELECT last_day(date) AS date, round(arg_max_null(level, date), 9) AS level, round(product(1 + rate) - 1, 12) AS cash, round(arg_max_null(vol, date), 9) AS vol, round(arg_max_null(gain, date), 9) AS gain FROM f0 GROUP BY 1),
f2 AS (SELECT *, row_number() OVER (ORDER BY date) - 1 AS i, round(CASE WHEN count(level) OVER t >= 10 THEN avg(level) OVER t END, 9) AS ma, lag(cash, 1) OVER (ORDER BY date) < lag(cash, 4) OVER (ORDER BY date) AS down FROM f1 WINDOW t AS (ORDER BY date ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)),
f3 AS (SELECT a.i, CASE WHEN count(b.vol) >= 12 THEN sum(CASE WHEN a.vol >= b.vol THEN 1 ELSE 0 END) / count(*) END AS rank FROM f2 a JOIN f2 b ON b.i <= a.i GROUP BY 1),
flags AS (SELECT date, i, coalesce(down, false) AS easing, coalesce(lag(rank > 0.70) OVER o, false) AS stressed, coalesce(lag(rank <= 0.70) OVER o, false) AS calm, coalesce(lag(gain > 0) OVER o, false) AS uptrend, coalesce(lag(level > ma) OVER o, false) AS above_ma
  FROM f2 JOIN f3 USING (i) WINDOW o AS (ORDER BY i))"""


def book_sql(spec: Spec, at: str = "") -> str:
    """CTEs that end in ``book<at>`` (date, asset, weight)."""
    rules = spec.regime or (("true", None, False),)
    own = "NULL" if spec.top_pct is None else spec.top_pct
    cases = " ".join(f"WHEN {cond.replace('int(', '(1 * cast(').replace(')', ' AS INTEGER))') if 'int(' in cond else cond} THEN {{}}" for cond, _, _ in rules)
    share = f"CASE {cases.format(*(own if p is None else p for _, p, _ in rules))} END"
    parked = f"CASE {cases.format(*(str(k).lower() for _, _, k in rules))} ELSE true END"
    band = f"AND sig BETWEEN {spec.low!r} AND {spec.high!r}" if spec.low is not None else ""
    small = "QUALIFY adtv <= quantile_cont(adtv, 0.5) OVER (PARTITION BY i)" if spec.small else ""
    one = "QUALIFY row_number() OVER (PARTITION BY i, root ORDER BY coalesce(adtv, -1) DESC, ticker) = 1" if spec.one_class else ""
    size = spec.top_n or f"greatest({spec.least}, CAST(floor(n * share) AS INTEGER))"
    chosen = f"SELECT date, CAST(ticker AS VARCHAR) AS asset FROM ranked{at} WHERE n >= {spec.min_names} AND k <= {size}"
    held = f"chosen{at} AS ({chosen})"
    if spec.sticky:
        held = f"""first{at} AS ({chosen}), lists{at} AS (SELECT date, list(asset) AS l FROM first{at} GROUP BY 1), carried{at} AS (SELECT p.date, last_value(l IGNORE NULLS) OVER (ORDER BY p.date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS l FROM plan{at} p LEFT JOIN lists{at} USING (date)),
chosen{at} AS (SELECT date, unnest(l) AS asset FROM carried{at} WHERE l IS NOT NULL)"""
    idle = f" UNION ALL SELECT date, 'cash', 1.0 FROM plan{at} WHERE date NOT IN (SELECT date FROM chosen{at})" if spec.regime else ""
    return f"""plan{at} AS (SELECT i, date, {share} AS share, {parked} AS parked FROM flags WHERE i >= {spec.start}),
seen{at} AS (SELECT i, date, ticker, root, {lag(spec.signal)} AS sig, {lag('adtv')} AS adtv, {lag('px')} AS px FROM named),
able{at} AS (SELECT * FROM seen{at} WHERE i >= {spec.start} AND adtv >= {spec.min_adtv} AND px >= {MIN_PRICE} AND sig IS NOT NULL {band}),
fit{at} AS (SELECT * FROM able{at} {small}), single{at} AS (SELECT * FROM fit{at} {one}),
ranked{at} AS (SELECT s.*, share, count(*) OVER (PARTITION BY s.i) AS n, row_number() OVER (PARTITION BY s.i ORDER BY sig DESC, ticker) AS k FROM single{at} s JOIN plan{at} p ON p.i = s.i WHERE NOT parked), {held},
book{at} AS (SELECT date, asset, 1.0 / count(*) OVER (PARTITION BY date) AS weight FROM chosen{at}{idle})"""


def spec_sql(name: str) -> str:
    return f"WITH {MONTHS}, {book_sql(SPECS[name])} SELECT date, asset, round(weight, 6) AS weight FROM book"


for _name in SPECS:
    query(f"portfolio_{_name}", spec_sql(_name))(lambda spark, sf, n=_name: book(spark, sf, n).select("date", "asset", half_up("weight").alias("weight")))
