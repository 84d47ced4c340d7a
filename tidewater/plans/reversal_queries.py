"""Mean reversion: four sub-scores at month ends from daily windows, and the long and short book that they choose."""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as c
from ..functions.prefix import UNIT
from . import adapters as a
from . import spec_queries as specs
from .oracle import lag, pct_rank
from .registry import half_up, query
from .sleeve_queries import PRICED

# First month, gates, shares of names, gross exposures.  The short leg and partial exposure in bad regimes are switched on.
START, WINS, SWINGS, LIQUID, LONG, SHORT, SHORT_GROSS, RISK_OFF, LEAST, LEAST_SHORT = 14, 1.5, 2.0, 0.20, 0.20, 0.20, 0.20, 0.30, 5, 3


def running(x: np.ndarray, n: int) -> np.ndarray:
    """Sum of the last n whole numbers."""
    total = np.append(0, np.cumsum(x))
    return total[1:] - total[np.maximum(np.arange(1, len(x) + 1) - n, 0)]


def trailing(x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Count and sum of the known ones of the last n whole numbers, exactly."""
    there = ~np.isnan(x)
    return running(there.astype(np.int64), n), running(np.where(there, x, 0.0).astype(np.int64), n)


def products(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """Sum of the products of the last n whole numbers; they are cut at 20 bits, so that what is summed stays whole."""
    (a, b), (d, e) = (np.divmod(np.where(np.isnan(v), 0.0, v).astype(np.int64), 1 << 20) for v in (x, y))
    return running(a * d, n) * 2.0**40 + running(a * e + b * d, n) * 2.0**20 + running(b * e, n)


def held(x: np.ndarray) -> np.ndarray:
    """The last known value."""
    last = np.maximum.accumulate(np.where(np.isnan(x), -1, np.arange(len(x))))
    return np.where(last >= 0, x[last], np.nan)


def before(x: np.ndarray, n: int = 1) -> np.ndarray:
    return np.append(np.full(n, np.nan), x)[: len(x)]


def over(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.where(y != 0, x / np.where(y != 0, y, 1.0), np.nan)


def nearest(x: np.ndarray, n: int = 9) -> np.ndarray:
    """As half_up rounds."""
    return np.floor(x * 10.0**n + 0.5) / 10.0**n


def whole_ratio(a: np.ndarray, b: np.ndarray, digits: int, known: np.ndarray) -> np.ndarray:
    """a / b of whole numbers, rounded half up to digits; exact where doubles cannot tell a half from what is next to it."""
    b = np.where(known, b, 1)
    x = np.where(known, a, 0) / b * 10.0**digits
    out = np.floor(x + 0.5)
    for k in np.flatnonzero(np.abs(x - np.floor(x) - 0.5) < 1e-4 + np.abs(x) * 1e-14):
        out[k] = (2 * int(a[k]) * 10**digits + int(b[k])) // (2 * int(b[k]))
    return np.where(known, out / 10.0**digits, np.nan)


def variance(x: np.ndarray, n: int) -> np.ndarray:
    """Of the last n whole numbers; missing where over half of them are."""
    k, total = trailing(x, n)
    square = k * products(x, x, n)
    top = square - total * 1.0 * total
    for i in np.flatnonzero((top < 1e-6 * square) & (k > 1)):  # values nearly alike
        v = x[max(0, i + 1 - n) : i + 1]
        v = v[~np.isnan(v)]
        top[i] = k[i] * np.sum((v - v.mean()) ** 2) if v.max() > v.min() else 0.0
    return np.where(k >= max(n // 2, 2), top / np.maximum(k * (k - 1), 1), np.nan)


def autocorrelation(x: np.ndarray, n: int) -> np.ndarray:
    """Covariance with the row before over the variance; missing where the last n do not vary or over half of them are missing."""
    past = before(x)
    pair = ~np.isnan(x) & ~np.isnan(past)
    now, past = np.where(pair, x, np.nan), np.where(pair, past, np.nan)
    (k, s), (_, t) = trailing(now, n), trailing(past, n)
    cov = (k * products(now, past, n) - s * 1.0 * t) / np.maximum(k * (k - 1), 1)
    return np.where(k >= max(n // 2, 2), over(cov, variance(x, n)), np.nan)


LAST = ("vol20", "hlr", "vol_ratio", "ret60", "ac20", "ac60", "range_ratio", "wins", "swings")


def month_levels(bars: Mapping[str, np.ndarray], starts: np.ndarray, days: int) -> dict[str, np.ndarray]:
    """px, adtv and the measures of LAST at each month's end, from one ticker's bars at days 0 to ``days`` - 1; ``starts``: each month's first day."""
    high, low, close, volume = (np.full(days, np.nan) for _ in range(4))
    for name, x in (("high", high), ("low", low), ("close", close), ("volume", volume)):
        x[np.asarray(bars["_k"], int)] = np.asarray(bars[name], float)
    high, low, close = held(high), held(low), held(close)
    span, digit = nearest(over(high - low, close)), 1e9
    paid, quantity = np.rint(volume / UNIT), np.rint(over(volume, close) / UNIT)
    (n, money), (k, pieces) = trailing(paid, 63), trailing(quantity, 63)
    close = held(whole_ratio(money, pieces, 6, (n > 0) & (k > 0) & (pieces != 0)))
    ret = nearest(over(close, before(close)) - 1)
    units, win = np.rint(ret * digit), np.where(ret > 0, 1.0, 0.0)

    def mean(x: np.ndarray, n: int, least: int, unit: int = 1) -> np.ndarray:
        """Of whole billionths, or of counts where ``unit`` is a billion, rounded to billionths."""
        k, total = trailing(x, n)
        return whole_ratio(total * unit, k * 10**9, 9, k >= least)

    def own(x: np.ndarray, more: float = 0.0) -> np.ndarray:
        k, total = trailing(np.rint(x * digit), 60)
        return over(x, np.where(k >= 30, total / np.maximum(k, 1) / digit, np.nan) + more)

    hlr, wr = before(mean(np.rint(span * digit), 20, 10)), mean(win, 20, 10, 10**9)
    vol20, vol60 = (before(nearest(np.sqrt(variance(units, n)) / digit)) for n in (20, 60))
    atr = nearest(pd.Series(np.abs(ret)).ewm(span=14, min_periods=14).mean().to_numpy())
    made = {
        "vol20": vol20, "hlr": hlr, "vol_ratio": over(vol60, vol20), "ret60": over(close, before(close, 60)) - 1, "ac20": before(nearest(autocorrelation(units, 20))), "ac60": before(nearest(autocorrelation(units, 60))),
        "range_ratio": own(hlr), "wins": own(wr, 1e-8), "swings": own(atr),
    }
    ends = np.append(starts[1:], days) - 1
    at = {x: np.maximum.accumulate(np.where(np.isnan(v), -1, np.arange(days)))[ends] for x, v in made.items()}
    cents = np.rint(volume * 100)
    k, total = np.add.reduceat((~np.isnan(cents)).astype(np.int64), starts), np.add.reduceat(np.where(np.isnan(cents), 0.0, cents).astype(np.int64), starts)
    return {"px": close[ends], "adtv": whole_ratio(total, k * 100, 4, k > 0)} | {x: nearest(np.where(at[x] >= starts, made[x][at[x]], np.nan)) for x in LAST}


def levels(spark, sf) -> DataFrame:
    """(date, i, ticker, px, adtv, glitch, vol20, hlr, vol_ratio, ret60, ac20, ac60, range_ratio, wins, swings) at month ends.

    Bars are shuffled once, by ticker, and a ticker's dense days live only while its months are made: four in five of them have no bar.
    The calendar, one row a day, is gathered first.
    """
    w = c.by_time()
    bars = a.bars(spark, sf, "day", together=True).select("ticker", F.unix_date("date").alias("day"), "high", "low", "close", "volume")
    traded = a.table(spark, sf, "lineitem").filter("l_quantity > 0").select(F.unix_date(F.to_date("l_shipdate")).alias("day")).distinct()
    dates = np.array([r["day"] for r in traded.filter("day is not null").orderBy("day").collect()], int)
    months, starts = np.unique(dates.astype("datetime64[D]").astype("datetime64[M]"), return_index=True)
    ends = ((months + 1).astype("datetime64[D]") - 1).astype("int32")

    def of_ticker(rows: pa.Table) -> pa.Table:
        ticker, day = rows["ticker"][0], rows["day"].to_numpy().astype(float)
        dated = ~np.isnan(day) & ticker.is_valid
        mine = {x: rows[x].to_numpy()[dated] for x in ("high", "low", "close", "volume")} | {"_k": np.searchsorted(dates, day[dated])}
        made = month_levels(mine, starts, len(dates))
        return pa.table({"ticker": pa.repeat(ticker, len(ends)), "day": ends, **{x: pa.array(v, from_pandas=True) for x, v in made.items()}})

    kind = bars.schema["ticker"].dataType.simpleString()
    schema = f"ticker {kind}, day int, px double, adtv double, {', '.join(f'{x} double' for x in LAST)}"
    out = bars.groupBy("ticker").applyInArrow(of_ticker, schema) if len(dates) else spark.createDataFrame([], schema)
    out = out.select("ticker", F.date_from_unix_date("day").alias("date"), "px", "adtv", *LAST)
    out = out.withColumns({"i": F.row_number().over(w) - 1, "ret": half_up(c.pct_change("px", 1, w), 9)})
    jump = F.coalesce(((F.col("ret") > 1.0) | (F.col("ret") < -0.45)).cast("double"), F.lit(0.0))
    return out.withColumn("glitch", c.rolling(F.max, jump, 12, w)).drop("ret")


def cash(spark, sf) -> DataFrame:
    """(date, paid, tightening): cash's return over 63 days at month ends, and whether it rose in the month.  One row a month."""
    o = Window.orderBy("date")
    d = a.market(spark, sf, "day", 252).select("date", F.product(1 + F.coalesce("rate", F.lit(0.0))).over(o.rowsBetween(Window.unboundedPreceding, 0)).alias("grown"))
    m = d.select("date", c.pct_change("grown", 63, o).alias("paid")).groupBy(F.last_day("date").alias("date")).agg(half_up(F.max_by("paid", "date"), 12).alias("paid"))
    return m.select("date", "paid", F.coalesce(F.col("paid") > F.lag("paid").over(o), F.lit(False)).alias("tightening"))


def scores(spark, sf) -> DataFrame:
    """``levels`` plus sub_a (calm ranges and short against long volatility), sub_b (return over cash), sub_c (autocorrelations), sub_d (range against its own mean), and alpha."""
    rank = lambda k: c.pct_rank(k, ["date"])
    m = levels(spark, sf).join(F.broadcast(cash(spark, sf).select("date", "paid")), "date")
    m = m.withColumn("excess", half_up(c.ratio("ret60", F.nullif("paid", F.lit(0.0))), 6))
    m = m.withColumns({"sub_a": (rank(-F.col("hlr")) + rank(-F.col("vol_ratio"))) / 2, "sub_b": rank("excess"), "sub_c": (rank(-F.col("ac60")) + rank(-F.col("ac20"))) / 2, "sub_d": rank(-F.col("range_ratio"))})
    alpha = half_up(0.25 * F.col("sub_a") + 0.25 * F.col("sub_b") + 0.25 * F.col("sub_c") + 0.25 * F.col("sub_d"), 9)
    return m.withColumn("alpha", F.when(F.coalesce("glitch", F.lit(0.0)) != 1, alpha))


def book(spark, sf) -> DataFrame:
    """(date, asset, weight): a long leg in inverse proportion to volatility, a short leg without its names, and cash.

    All is read one month before, but for the two gates, which are the month's own.  In a bad regime the long leg shrinks, the short one goes and cash takes
    the rest; with fewer than five names all is cash.
    """
    t, month = c.by_time(), Window.partitionBy("date")
    regime = specs.flags(spark, sf).join(cash(spark, sf), "date").select("date", "i", (~(F.col("tightening") | F.col("stressed"))).alias("good")).filter(F.col("i") >= START)
    s = scores(spark, sf)
    seen = s.select("date", "ticker", "wins", "swings", *(F.lag(k).over(t).alias(k) for k in ("alpha", "adtv", "px", "vol20")))
    seen = seen.withColumn("liquid", c.pct_rank("adtv", ["date"])).join(F.broadcast(regime), "date")
    able = seen.filter((F.col("adtv") >= specs.MIN_ADTV) & (F.col("px") >= specs.MIN_PRICE) & (F.col("liquid") >= LIQUID) & F.col("alpha").isNotNull())
    able = able.withColumn("n", F.count(F.lit(1)).over(month)).filter((F.col("n") >= LEAST) & (F.coalesce("wins", F.lit(1.0)) < WINS) & (F.coalesce("swings", F.lit(1.0)) < SWINGS))
    ranked = able.withColumns({"n": F.count(F.lit(1)).over(month), "top": F.row_number().over(month.orderBy(F.desc("alpha"), "ticker")), "bottom": F.row_number().over(month.orderBy("alpha", "ticker"))}).filter(F.col("n") >= LEAST)
    is_long = F.col("top") <= F.greatest(F.lit(LEAST), F.floor(F.col("n") * LONG).cast("int"))
    is_short = ~is_long & F.col("good") & (F.col("bottom") <= F.greatest(F.lit(LEAST_SHORT), F.floor(F.col("n") * SHORT).cast("int")))
    calm = F.when(F.col("vol20") > 0, 1 / F.col("vol20"))
    asset = F.col("ticker").cast("string").alias("asset")
    gross = F.when(F.col("good"), 1.0).otherwise(RISK_OFF)
    longs = ranked.filter(is_long).withColumn("share", F.coalesce(calm / F.sum(calm).over(month), F.when(F.count(calm).over(month) == 0, 1 / F.count(F.lit(1)).over(month))))
    shorts = ranked.filter(is_short).select("date", asset, (F.lit(-SHORT_GROSS) / F.count(F.lit(1)).over(month)).alias("weight"))
    held = ranked.select("date").distinct()
    idle = regime.join(held, "date", "left_anti").select("date", F.lit("cash"), F.lit(1.0))
    partial = regime.filter("not good").join(held, "date", "left_semi").select("date", F.lit("cash"), F.lit(1 - RISK_OFF))
    return longs.filter("share is not null").select("date", asset, (F.col("share") * gross).alias("weight")).union(shorts).union(partial).union(idle)


# ---- the same in SQL


def frame(n: int) -> str:
    return f"OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def least(x: str, fn: str, n: int, k: int) -> str:
    return f"CASE WHEN count({x}) {frame(n)} >= {k} THEN {fn} {frame(n)} END"


def auto_sql(n: int) -> str:
    return f"CASE WHEN count(past2) {frame(n)} >= {n // 2} AND max(ret) {frame(n)} > min(ret) {frame(n)} THEN covar_samp(now2, past2) {frame(n)} / ({least('ret', 'var_samp(ret)', n, n // 2)}) END"


SCORES = f"""{PRICED},
v0 AS (SELECT p.*, round((d.high - d.low) / d.close, 9) AS range, lag(p.ret) OVER (PARTITION BY p.ticker ORDER BY p.date) AS past, row_number() OVER (PARTITION BY p.ticker ORDER BY p.date) AS k FROM priced p JOIN panel d ON d.ticker = p.ticker AND d.date = p.date),
v1 AS (SELECT *, CASE WHEN past IS NOT NULL THEN ret END AS now2, CASE WHEN ret IS NOT NULL THEN past END AS past2, abs(ret) AS move, CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END AS win FROM v0),
v2 AS (SELECT date, ticker, close, volume, close / {lag('close', 60)} - 1 AS ret60, {least('range', 'avg(range)', 20, 10)} AS hlr, CASE WHEN max(ret) {frame(20)} = min(ret) {frame(20)} AND count(ret) {frame(20)} >= 10 THEN 0 ELSE {least('ret', 'stddev_samp(ret)', 20, 10)} END AS vol20,
  {least('ret', 'stddev_samp(ret)', 60, 30)} AS vol60, {auto_sql(20)} AS ac20, {auto_sql(60)} AS ac60, round({least('win', 'avg(win)', 20, 10)}, 9) AS wr,
  round(CASE WHEN count(move) OVER h >= 14 THEN sum(move * pow(15.0 / 13.0, k)) OVER h / sum(CASE WHEN move IS NOT NULL THEN pow(15.0 / 13.0, k) END) OVER h END, 9) AS atr FROM v1 WINDOW h AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
v3 AS (SELECT date, ticker, close, volume, ret60, wr, atr, {", ".join(f"round({lag(k)}, 9) AS {k}" for k in ("hlr", "vol20", "vol60", "ac20", "ac60"))} FROM v2),
v4 AS (SELECT *, vol60 / nullif(vol20, 0) AS vol_ratio, hlr / nullif({least('hlr', 'avg(hlr)', 60, 30)}, 0) AS range_ratio, wr / nullif({least('wr', 'avg(wr)', 60, 30)} + 1e-8, 0) AS wins, atr / nullif({least('atr', 'avg(atr)', 60, 30)}, 0) AS swings FROM v3),
v5 AS (SELECT ticker, last_day(date) AS date, arg_max_null(close, date) AS px, round(avg(volume), 4) AS adtv, {", ".join(f"round(arg_max({k}, date) FILTER (WHERE {k} IS NOT NULL), 9) AS {k}" for k in LAST)} FROM v4 GROUP BY 1, 2),
v6 AS (SELECT *, CASE WHEN round(px / {lag('px')} - 1, 9) > 1 OR round(px / {lag('px')} - 1, 9) < -0.45 THEN 1.0 ELSE 0.0 END AS jump FROM v5),
v7 AS (SELECT *, {least('jump', 'max(jump)', 12, 12)} AS glitch FROM v6),
cs0 AS (SELECT date, product(1 + coalesce(rate, 0)) OVER (ORDER BY date) AS grown FROM market),
cs1 AS (SELECT date, grown / lag(grown, 63) OVER (ORDER BY date) - 1 AS paid FROM cs0),
cs2 AS (SELECT last_day(date) AS date, round(arg_max_null(paid, date), 12) AS paid FROM cs1 GROUP BY 1),
cs AS (SELECT date, paid, coalesce(paid > lag(paid) OVER (ORDER BY date), false) AS tightening FROM cs2),
v8 AS (SELECT v7.*, round(ret60 / nullif(paid, 0), 6) AS excess, -hlr AS n_hlr, -vol_ratio AS n_ratio, -ac60 AS n60, -ac20 AS n20, -range_ratio AS n_range FROM v7 JOIN cs USING (date)),
v9 AS (SELECT *, ({pct_rank('n_hlr', 'date')} + {pct_rank('n_ratio', 'date')}) / 2 AS sub_a, {pct_rank('excess', 'date')} AS sub_b, ({pct_rank('n60', 'date')} + {pct_rank('n20', 'date')}) / 2 AS sub_c, {pct_rank('n_range', 'date')} AS sub_d FROM v8),
scores AS (SELECT *, CASE WHEN coalesce(glitch, 0) <> 1 THEN round(0.25 * sub_a + 0.25 * sub_b + 0.25 * sub_c + 0.25 * sub_d, 9) END AS alpha FROM v9)"""


@query("mean_reversion_composite", f"WITH {SCORES} SELECT date, ticker, round(sub_a, 6) AS sub_a, round(sub_b, 6) AS sub_b, round(sub_c, 6) AS sub_c, round(sub_d, 6) AS sub_d, round(alpha, 6) AS alpha FROM scores")
def mean_reversion_composite(spark, sf):
    return scores(spark, sf).select("date", "ticker", *(half_up(k).alias(k) for k in ("sub_a", "sub_b", "sub_c", "sub_d", "alpha")))


REGIME = specs.MONTHS[specs.MONTHS.index("f0 AS") :]


@query("portfolio_mean_reversion", f"""WITH {SCORES}, {REGIME}, rg AS (SELECT f.date, i, NOT (tightening OR stressed) AS good FROM flags f JOIN cs USING (date) WHERE i >= {START}),
b0 AS (SELECT date, ticker, wins, swings, {lag('alpha')} AS alpha, {lag('adtv')} AS adtv, {lag('px')} AS px, {lag('vol20')} AS vol20 FROM scores),
b1 AS (SELECT b0.*, good, {pct_rank('adtv', 'b0.date')} AS liquid FROM b0 JOIN rg ON rg.date = b0.date),
b2 AS (SELECT *, count(*) OVER (PARTITION BY date) AS n0 FROM b1 WHERE adtv >= {specs.MIN_ADTV} AND px >= {specs.MIN_PRICE} AND liquid >= {LIQUID} AND alpha IS NOT NULL),
b3 AS (SELECT *, count(*) OVER d AS n, row_number() OVER (PARTITION BY date ORDER BY alpha DESC, ticker) AS top, row_number() OVER (PARTITION BY date ORDER BY alpha, ticker) AS bottom FROM b2 WHERE n0 >= {LEAST} AND coalesce(wins, 1) < {WINS} AND coalesce(swings, 1) < {SWINGS} WINDOW d AS (PARTITION BY date)),
b4 AS (SELECT *, top <= greatest({LEAST}, CAST(floor(n * {LONG}) AS INTEGER)) AS is_long, bottom <= greatest({LEAST_SHORT}, CAST(floor(n * {SHORT}) AS INTEGER)) AS low, CASE WHEN vol20 > 0 THEN 1 / vol20 END AS calm FROM b3 WHERE n >= {LEAST}),
longs AS (SELECT date, ticker, (CASE WHEN count(calm) OVER d = 0 THEN 1.0 / count(*) OVER d ELSE calm / sum(calm) OVER d END) * CASE WHEN good THEN 1.0 ELSE {RISK_OFF} END AS weight FROM b4 WHERE is_long WINDOW d AS (PARTITION BY date)),
shorts AS (SELECT date, ticker, {-SHORT_GROSS} / count(*) OVER (PARTITION BY date) AS weight FROM b4 WHERE low AND NOT is_long AND good),
book AS (SELECT date, CAST(ticker AS VARCHAR) AS asset, weight FROM longs WHERE weight IS NOT NULL UNION ALL SELECT date, CAST(ticker AS VARCHAR), weight FROM shorts
  UNION ALL SELECT date, 'cash', CASE WHEN date IN (SELECT date FROM b4) THEN {1 - RISK_OFF} ELSE 1.0 END FROM rg WHERE NOT good OR date NOT IN (SELECT date FROM b4))
SELECT date, asset, round(weight, 6) AS weight FROM book""")
def portfolio_mean_reversion(spark, sf):
    return book(spark, sf).select("date", "asset", half_up("weight").alias("weight"))
