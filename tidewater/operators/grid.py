"""Dense panels, calendars and as-of joins.

A panel has one row for every (date, instrument) of the calendar, so that counting rows is counting dates.  The
calendar - one row per date, so small by nature - is gathered into a single row and broadcast; bars and instruments stay distributed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import by_time, history


def densify(bars: DataFrame, measures: list[str], filled: list[str], key: str = "ticker", time: str = "date") -> DataFrame:
    """Every date for every key; the ``filled`` measures carry their last value forward, the others stay missing.

    A bar holds until its key's next one, and a key's first bar also makes the dates before it, without values.  So bars are shuffled by key and
    then spread over the dates: no dense row is shuffled or joined.
    """
    calendar = bars.agg(F.sort_array(F.collect_set(time)).alias("_dates"))
    places = calendar.select(F.posexplode("_dates").alias("_k", time))  # from 0
    placed = bars.select(key, time, *measures).join(F.broadcast(places), time, "left").withColumn("_k", F.coalesce(F.col("_k") + 1, F.lit(0)))  # 0: no date
    there = (F.col("_k") > 0) & F.col(key).isNotNull()
    placed = placed.select(key, "_k", *(F.when(there, F.col(m)).alias(m) for m in measures))
    w = by_time(key, "_k")
    known = placed.select(
        key, "_k", F.lag("_k").over(w).alias("_past"), F.lead("_k").over(w).alias("_next"),
        *(F.last(m, ignorenulls=True).over(history(w)).alias(m) if m in filled else F.col(m) for m in measures),
    ).crossJoin(F.broadcast(calendar))
    start = F.when(F.col("_past").isNull(), F.lit(1)).otherwise(F.greatest("_k", F.lit(1)))
    stop = F.when(F.col("_next").isNull(), F.size("_dates")).otherwise(F.greatest(F.col("_next") - 1, F.col("_k")))
    spread = known.withColumns({"_start": start, "_stop": stop}).withColumn("_at", F.explode(F.when(F.col("_stop") >= F.col("_start"), F.sequence("_start", "_stop"))))
    held = lambda m: F.when(F.col("_at") >= F.col("_k") if m in filled else F.col("_at") == F.col("_k"), F.col(m)).alias(m)
    return spread.select(F.element_at("_dates", F.col("_at")).alias(time), key, *(held(m) for m in measures))


def period_end(date: str | Column, rule: str) -> Column:
    """Last calendar day of the date's month (ME) or quarter (QE), or its week's Friday (W-FRI)."""
    d = F.col(date) if isinstance(date, str) else date
    if rule == "ME":
        return F.last_day(d)
    if rule == "QE":
        return F.last_day(F.add_months(F.trunc(d, "quarter"), 2))
    if rule == "W-FRI":
        return F.date_add(d, F.pmod(F.lit(6) - F.dayofweek(d), F.lit(7)).cast("int"))
    raise ValueError(f"unknown calendar {rule}")


def calendar(df: DataFrame, rule: str, time: str = "date") -> DataFrame:
    """(period): every period end from the first to the last observed date."""
    span = df.agg(F.min(time).alias("a"), F.max(time).alias("b")).filter("a is not null")
    return span.select(F.explode(F.sequence("a", "b")).alias("d")).select(period_end("d", rule).alias("period")).distinct()


def resample(df: DataFrame, rule: str, last: list[str] = (), mean: list[str] = (), total: list[str] = (), compound: list[str] = (), key: str = "ticker", time: str = "date") -> DataFrame:
    """Per key and period: last known value, mean, sum, and compounded return of the named measures."""
    aggs = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(time))).alias(c) for c in last]
    aggs += [F.avg(c).alias(f"{c}_mean") for c in mean] + [F.sum(c).alias(f"{c}_sum") for c in total]
    aggs += [(F.product(1 + F.coalesce(F.col(c), F.lit(0.0))) - 1).alias(f"{c}_compound") for c in compound]
    return df.groupBy(key, period_end(time, rule).alias("period")).agg(*aggs)


def as_of(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, values: list[str], strict: bool = False, expire_days: int | None = None) -> DataFrame:
    """``left`` plus, for each row, ``right``'s values at the last right_time not after (strict: before) left_time.

    Both sides are stacked in one window per key, so the cost is one shuffle whatever the number of matches.  Each value is
    the last known one on its own; with ``expire_days`` a value older than that is NULL.
    """
    carried = [c for c in left.columns if c not in (key,)]
    stacked = left.select(F.col(key), F.col(left_time).alias("_t"), F.lit(0 if strict else 1).alias("_side"), F.struct(*carried).alias("_row"), *(F.lit(None).cast(right.schema[v].dataType).alias(f"_{v}") for v in values))
    events = right.select(F.col(key), F.col(right_time).alias("_t"), F.lit(1 if strict else 0).alias("_side"), F.lit(None).cast(stacked.schema["_row"].dataType).alias("_row"), *(F.col(v).alias(f"_{v}") for v in values))
    w = Window.partitionBy(key).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    known = stacked.unionByName(events)
    for v in values:
        known = known.withColumn(f"_{v}", F.last(F.when(F.col(f"_{v}").isNotNull(), F.struct(F.col(f"_{v}").alias("v"), F.col("_t").alias("at"))), ignorenulls=True).over(w))
    fresh = lambda v: F.col(f"_{v}.v") if expire_days is None else F.when(F.datediff(F.col("_t"), F.col(f"_{v}.at")) <= expire_days, F.col(f"_{v}.v"))
    return known.filter("_row is not null").select(F.col(key), *(F.col(f"_row.{c}").alias(c) for c in carried), *(fresh(v).alias(v) for v in values))


def nearest_in_window(actions: DataFrame, bars: DataFrame, key: str, at: str, days: int = 7) -> DataFrame:
    """``actions`` plus close_before, the last close in [at - days, at), and close_after, the first in [at, at + days].

    Dates are cut into cells of ``days`` and each action meets the three cells around it, an equi-join, before the range test.
    """
    cell = lambda c: F.floor(F.datediff(c, F.lit("1970-01-01").cast("date")) / days)
    near = actions.withColumn("_cell", F.explode(F.sequence(cell(F.col(at)) - 1, cell(F.col(at)) + 1)))
    prices = bars.select(F.col(key), F.col("date").alias("_d"), F.col("close").alias("_close"), cell(F.col("date")).alias("_cell")).filter("_close is not null")
    gap = F.datediff("_d", F.col(at))
    met = near.join(prices, [key, "_cell"], "left")
    return met.groupBy(*actions.columns).agg(
        F.max_by("_close", F.when((gap < 0) & (gap >= -days), F.col("_d"))).alias("close_before"),
        F.min_by("_close", F.when((gap >= 0) & (gap <= days), F.col("_d"))).alias("close_after"),
    )
