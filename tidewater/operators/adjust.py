"""Price adjustment for splits and dividends, split detection and validation.

An instrument's share events are few (tens over decades), so they travel as one array per instrument and every bar
folds the later ones; bars are never multiplied by events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import by_time, flag, frame, ratio
from .grid import as_of, nearest_in_window

# Bounds and ratios of plausible share events.
LEAST_FACTOR, MOST_FACTOR = 1 / 1000, 1000.0
LEAST_CUMULATIVE, MOST_CUMULATIVE = 1e-5, 1e5
SPLIT_RATIOS = [2, 3, 4, 5, 6, 8, 10, 15, 20, 25, 50, 100]


def split_factors(actions: DataFrame) -> DataFrame:
    """Price factor of each share event: 1/f of a split or reverse split, 1/(1 + f/100) of a bonus; implausible ones go."""
    f = F.when(F.col("action") == "BONUS_SHARES", ratio(F.lit(1.0), 1 + F.col("factor") / 100)).otherwise(ratio(F.lit(1.0), F.col("factor")))
    return actions.withColumn("split_factor", F.round(f, 10)).filter((F.col("factor") > 0) & F.col("split_factor").between(LEAST_FACTOR, MOST_FACTOR))


def later_product(bars: DataFrame, events: DataFrame, factor: str, out: str, clamp: bool, key: str = "ticker") -> DataFrame:
    """``bars`` plus the product of the factors of events after each bar, newest first, clamped at every step if asked."""
    listed = events.groupBy(key).agg(F.reverse(F.array_sort(F.collect_list(F.struct("ex_date", F.col(factor).alias("f"))))).alias("_events"))
    step = lambda acc, e: acc * e.f
    if clamp:
        step = lambda acc, e: F.greatest(F.least(acc * e.f, F.lit(MOST_CUMULATIVE)), F.lit(LEAST_CUMULATIVE))
    later = F.filter("_events", lambda e: e.ex_date > F.col("date"))
    return bars.join(listed, key, "left").withColumn(out, F.when(F.col("_events").isNull(), F.lit(1.0)).otherwise(F.aggregate(later, F.lit(1.0), step))).drop("_events")


def back_adjust(bars: DataFrame, factors: DataFrame, key: str = "ticker") -> DataFrame:
    """``bars`` plus split_adj_open/high/low/close: prices times the clamped product of later split factors."""
    out = later_product(bars, factors, "split_factor", "split_product", True, key)
    return out.withColumns({f"split_adj_{c}": F.col(c) * F.col("split_product") for c in ("open", "high", "low", "close")})


def dividend_factors(events: DataFrame, bars: DataFrame, key: str = "ticker") -> DataFrame:
    """Events plus dividend_factor = 1 - value / last close strictly before the ex-date; over 90 % of the price, or none: dropped."""
    prior = as_of(events, bars.select(key, "date", F.col("close").alias("prior_close")), key, "ex_date", "date", ["prior_close"], strict=True)
    return prior.filter((F.col("value") > 0) & (F.col("prior_close") > 0) & (F.col("value") < 0.9 * F.col("prior_close"))).withColumn("dividend_factor", 1 - F.col("value") / F.col("prior_close"))


def checked_actions(actions: DataFrame, bars: DataFrame, key: str = "ticker") -> DataFrame:
    """``actions`` without those that a changed quotation factor expresses already or that no price move shows, factors corrected to the moves."""
    if "quotation_factor" in bars.columns:
        actions = drop_redundant(actions, bars, key=key)
    return validate(actions, bars, key=key).filter("verdict <> 'DROP'").select(*actions.columns)


def total_adjust(bars: DataFrame, actions: DataFrame, cash: DataFrame, key: str = "ticker") -> DataFrame:
    """Split- and dividend-adjusted bars by actions that hold against the prices: adj_close, which falls back to the split-adjusted close where it is implausible."""
    split = back_adjust(bars, split_factors(checked_actions(actions, bars, key)), key)
    both = later_product(split, dividend_factors(cash, bars, key), "dividend_factor", "dividend_product", False, key)
    adj = F.col("split_adj_close") * F.col("dividend_product")
    sane = adj.isNotNull() & (F.abs(F.try_divide(adj, F.nullif(F.col("close"), F.lit(0.0)))) <= 1e5)
    return both.withColumn("adj_close", F.when(sane, adj).otherwise(F.col("split_adj_close")))


def snap(r: Column, slack: float) -> Column:
    """The first plausible split ratio within ``slack`` of a price ratio: 1/n (a split) before n (a reverse one); else NULL."""
    choices = F.array(*(F.struct(F.lit(1.0 / n).alias("price"), F.lit(float(n)).alias("factor"), F.lit("STOCK_SPLIT").alias("action")) for n in SPLIT_RATIOS), *(F.struct(F.lit(float(n)).alias("price"), F.lit(1.0 / n).alias("factor"), F.lit("REVERSE_SPLIT").alias("action")) for n in SPLIT_RATIOS))
    fits = F.filter(choices, lambda c: F.abs(r / c.price - 1) <= slack)
    return F.when(F.size(fits) > 0, fits[0])


def detect_splits(bars: DataFrame, actions: DataFrame, low: float = 0.55, high: float = 1.8, slack: float = 0.08, key: str = "ticker") -> DataFrame:
    """Share events that the prices show and no action explains.

    A close outside [low, high] times the one before counts, unless an action's ex-date is this bar's date or one of the five
    bars' before, or a change of the quotation factor explains it; it must then fit a split ratio.
    """
    w = by_time(key)
    known = actions.select(key, F.col("ex_date").alias("date"), F.lit(1).alias("_known")).distinct()
    r = ratio("close", F.lag("close").over(w))
    factor_change = ratio(F.col("quotation_factor").cast("double"), F.lag("quotation_factor").over(w)) if "quotation_factor" in bars.columns else F.lit(1.0)
    jumps = bars.filter("close > 0").join(known, [key, "date"], "left").select(key, "date", r.alias("r"), F.max("_known").over(frame(w, 6)).alias("explained"), factor_change.alias("qf"))
    unexplained = F.col("explained").isNull() & ~flag((F.col("qf") != 1) & (F.abs(F.col("r") * F.col("qf") - 1) <= slack)).cast("boolean")
    return jumps.filter(((F.col("r") < low) | (F.col("r") > high)) & unexplained).withColumn("fit", snap(F.col("r"), slack)).filter("fit is not null").select(
        key, F.col("date").alias("ex_date"), F.col("fit.action").alias("action"), F.col("fit.factor").alias("factor"), F.lit("DETECTED").alias("source"), F.col("r").alias("price_ratio")
    )


def drop_redundant(actions: DataFrame, bars: DataFrame, days: int = 5, slack: float = 0.15, key: str = "ticker") -> DataFrame:
    """Actions without those that a change of the quotation factor within ``days`` expresses already."""
    change = ratio(F.col("quotation_factor").cast("double"), F.lag("quotation_factor").over(by_time(key)))
    changes = bars.select(key, F.col("date").alias("_d"), change.alias("_change")).filter("_change <> 1")
    near = F.abs(F.datediff("ex_date", "_d")) <= days
    same = (F.abs(F.col("factor") / F.col("_change") - 1) <= slack) | (F.abs(F.col("factor") * F.col("_change") - 1) <= slack)
    return actions.join(changes.withColumnRenamed(key, "_k"), (F.col(key) == F.col("_k")) & near & same, "left_anti")


def validate(actions: DataFrame, bars: DataFrame, tolerance: float = 1.35, snap_slack: float = 0.05, key: str = "ticker") -> DataFrame:
    """Share events held against the closes around them: verdict KEEP, DROP (no move) or CORRECTED (factor snapped to the move).

    An event without closes on both sides is kept; one whose move fits no ratio is kept as well.
    """
    near = nearest_in_window(split_factors(actions), bars, key, "ex_date")
    seen = F.ln(F.try_divide(F.col("close_after"), F.nullif(F.col("close_before"), F.lit(0.0))))
    expected, band = F.ln("split_factor"), F.ln(F.lit(tolerance))
    fit = snap(F.exp(seen), snap_slack)
    verdict = F.when(seen.isNull() | (F.abs(seen - expected) <= band), "KEEP").when(F.abs(seen) <= band, "DROP").when(fit.isNotNull(), "CORRECTED").otherwise("KEEP")
    out = near.withColumn("verdict", verdict).withColumn("fit", fit)
    corrected = F.col("verdict") == "CORRECTED"
    return out.withColumn("factor", F.when(corrected, F.col("fit.factor")).otherwise(F.col("factor"))).withColumn("action", F.when(corrected, F.col("fit.action")).otherwise(F.col("action"))).drop("fit", "split_factor")


def share_multiplier(rows: DataFrame, actions: DataFrame, start: str, end: str, key: str = "ticker") -> DataFrame:
    """``rows`` plus multiplier: product of the factors of events with start < ex_date <= end.

    Cumulative factors are looked up at both ends, so an interval of any length costs two as-of joins and no range join.
    """
    growth = F.exp(F.sum(F.ln("factor")).over(by_time(key, "ex_date").rangeBetween(Window.unboundedPreceding, 0)))
    steps = actions.filter("factor > 0").select(key, "ex_date", growth.alias("_growth")).distinct()
    at_end = as_of(rows, steps.withColumnRenamed("_growth", "_end"), key, end, "ex_date", ["_end"])
    both = as_of(at_end, steps.withColumnRenamed("_growth", "_start"), key, start, "ex_date", ["_start"])
    return both.withColumn("multiplier", F.coalesce("_end", F.lit(1.0)) / F.coalesce("_start", F.lit(1.0))).drop("_end", "_start")


# Fixed values of the repair: ratios that count as splits, how closely, and the bounds on levels and volume around one.
REPAIR_RATIOS, REPAIR_SLACK, REPAIR_AGREE, REPAIR_LEVELS, REPAIR_VOLUME = (2, 3, 4, 5, 8, 10), 0.04, 0.05, (0.6, 1.5), 3


def repair_unrecorded(panel: DataFrame, key: str = "ticker") -> DataFrame:
    """``panel`` (close adjusted, raw_close, volume) plus repaired: closes before an unrecorded split scaled to the level after it.

    A split shows where adjusted and raw ratios agree within 5 %, are near 1/n or n (n of 2, 3, 4, 5, 8, 10; 4 %), the medians of the five rows
    before and after stay in [0.6, 1.5] of the levels at the jump, and the day's volume is under three times its trailing median of 20.
    """
    w = by_time(key)
    r, raw = ratio("close", F.lag("close").over(w)), ratio("raw_close", F.lag("raw_close").over(w))
    median = lambda c, a, b: F.percentile(F.col(c), F.lit(0.5)).over(w.rowsBetween(a, b))
    ns = F.array(*(F.lit(x) for n in REPAIR_RATIOS for x in (1.0 / n, float(n))))
    x = panel.withColumns({"_r": r, "_raw": raw, "_after": ratio(median("close", 1, 5), "close"), "_before": ratio(median("close", -6, -2), F.lag("close").over(w)), "_usual": F.when(F.count("volume").over(w.rowsBetween(-20, -1)) >= 5, median("volume", -20, -1))})
    is_split = (
        (F.abs(F.col("_r") / F.col("_raw") - 1) <= REPAIR_AGREE) & F.exists(ns, lambda n: F.abs(F.col("_r") / n - 1) <= REPAIR_SLACK)
        & F.col("_after").between(*REPAIR_LEVELS) & F.col("_before").between(*REPAIR_LEVELS) & (F.coalesce("volume", F.lit(0.0)) < REPAIR_VOLUME * F.col("_usual"))
    )
    x = x.withColumn("_factor", F.when(F.coalesce(is_split, F.lit(False)), F.col("_r")).otherwise(1.0))
    later = F.product("_factor").over(w.rowsBetween(1, Window.unboundedFollowing))
    return x.withColumn("repaired", F.col("close") * F.coalesce(later, F.lit(1.0))).withColumn("split_here", F.col("_factor") != 1.0).drop("_r", "_raw", "_after", "_before", "_usual", "_factor")
