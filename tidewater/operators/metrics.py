"""Performance of return and value series; ``key`` names the strategy, so any number of them is one job."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import by_time, frame, growth, history, safe_corr


def drawdown(returns: DataFrame, key: str = "strategy") -> DataFrame:
    """``returns`` plus cum (growth of one) and drawdown from its running peak of at least one."""
    w = by_time(key)
    out = returns.withColumn("cum", growth("ret", w))
    return out.withColumn("drawdown", F.col("cum") / F.greatest(F.max("cum").over(history(w)), F.lit(1.0)) - 1)


def summary(returns: DataFrame, key: str = "strategy", per_year: int = 52, rate: str | None = None) -> DataFrame:
    """Per key: periods, total, annual return, volatility, sharpe, max drawdown, calmar."""
    excess = F.col("ret") - (F.coalesce(rate, F.lit(0.0)) if rate else F.lit(0.0))
    agg = drawdown(returns.filter("ret is not null"), key).groupBy(key).agg(
        F.count("ret").alias("periods"), (F.product(1 + F.col("ret")) - 1).alias("total_return"), (F.stddev_samp("ret") * F.sqrt(F.lit(float(per_year)))).alias("volatility"),
        (F.try_divide(F.avg(excess), F.nullif(F.stddev_samp(excess), F.lit(0.0))) * F.sqrt(F.lit(float(per_year)))).alias("sharpe"), F.min("drawdown").alias("max_drawdown"),
    )
    annual = F.when(F.col("total_return") > -1, F.pow(1 + F.col("total_return"), per_year / F.col("periods")) - 1)
    return agg.withColumn("annual_return", annual).withColumn("calmar", F.try_divide(F.col("annual_return"), F.nullif(F.abs("max_drawdown"), F.lit(0.0))))


def metric_row(returns: DataFrame, values: DataFrame, key: str = "strategy", per_year: int = 12) -> DataFrame:
    """``summary`` of periodic returns, but drawdown and calmar from the path of daily ``values`` (key, date, value), which sees the lows between rebalances.

    A key without such a path keeps those of its returns.
    """
    w = by_time(key)
    peak = F.max("value").over(history(w))
    path = values.filter("value is not null").withColumn("dd", F.col("value") / peak - 1).groupBy(key).agg(F.min("dd").alias("_path"), F.count("*").alias("_n"))
    out = summary(returns, key, per_year).join(path.filter("_n > 1"), key, "left").withColumn("max_drawdown", F.coalesce("_path", "max_drawdown"))
    return out.withColumn("calmar", F.try_divide(F.col("annual_return"), F.nullif(F.abs("max_drawdown"), F.lit(0.0)))).drop("_path", "_n")


def value_returns(values: DataFrame, key: str = "strategy") -> DataFrame:
    """Returns of a value series with the period's contribution taken out."""
    w = by_time(key)
    return values.withColumn("ret", F.try_divide(F.col("value") - F.coalesce("contribution", F.lit(0.0)), F.lag("value").over(w)) - 1)


def contribution_nav(returns: DataFrame, initial: float, key: str = "strategy") -> DataFrame:
    """``returns`` (ret, contribution) plus nav of the recurrence nav * (1 + ret) + contribution, in its closed form."""
    w = by_time(key)
    g = returns.withColumn("_g", growth("ret", w))
    return g.withColumn("nav", F.col("_g") * (F.lit(initial) + F.sum(F.coalesce("contribution", F.lit(0.0)) / F.col("_g")).over(history(w)))).drop("_g")


def drifted_nav(weights: DataFrame, daily: DataFrame, key: str = "ticker") -> DataFrame:
    """(date, nav): daily value of rebalanced books; weights drift with daily returns clipped to [-0.9, 5], the rest is flat.

    Each day belongs to the last rebalance before it; growth is a product within (asset, segment), and segments chain.
    """
    dates = weights.select(F.col("date").alias("rebalance")).distinct().withColumn("until", F.lead("rebalance").over(Window.orderBy("rebalance")))
    book = weights.withColumnRenamed("date", "rebalance").join(F.broadcast(dates), "rebalance")
    days = daily.select("date").distinct().join(F.broadcast(dates), (F.col("date") > F.col("rebalance")) & (F.col("until").isNull() | (F.col("date") <= F.col("until")))).select("date", "rebalance")
    held = book.join(days, "rebalance").join(daily.select("date", key, F.greatest(F.least(F.col("ret"), F.lit(5.0)), F.lit(-0.9)).alias("ret")), ["date", key], "left")
    w = Window.partitionBy("rebalance", key).orderBy("date")
    value = held.withColumn("v", F.col("weight") * growth("ret", w)).groupBy("rebalance", "date").agg((F.sum("v") + 1 - F.sum("weight")).alias("in_segment"))
    last = value.groupBy("rebalance").agg(F.max_by("in_segment", "date").alias("end"))
    chain = last.withColumn("start_nav", F.coalesce(F.product("end").over(Window.orderBy("rebalance").rowsBetween(Window.unboundedPreceding, -1)), F.lit(1.0)))
    return value.join(chain, "rebalance").select("date", (F.col("start_nav") * F.col("in_segment")).alias("nav"))


def by_period(returns: DataFrame, periods: DataFrame, key: str = "strategy", per_year: int = 52) -> DataFrame:
    """Summary of each key within each named period (name, start, end): a small table, so it is broadcast."""
    inside = returns.join(F.broadcast(periods), F.col("date").between(F.col("start"), F.col("end"))).withColumn("_k", F.struct(key, "name"))
    return summary(inside, "_k", per_year).select(F.col(f"_k.{key}").alias(key), F.col("_k.name").alias("name"), "periods", "total_return", "volatility", "sharpe", "max_drawdown")


def rolling_sharpe(returns: DataFrame, n: int, key: str = "strategy", per_year: int = 52) -> DataFrame:
    """``returns`` plus rolling_sharpe over n periods; zero deviation gives 0."""
    f = frame(by_time(key), n)
    s = F.coalesce(F.try_divide(F.avg("ret").over(f), F.nullif(F.stddev_samp("ret").over(f), F.lit(0.0))), F.lit(0.0)) * F.sqrt(F.lit(float(per_year)))
    return returns.withColumn("rolling_sharpe", F.when(F.count("ret").over(f) >= n, s))


def correlations(returns: DataFrame, key: str = "strategy") -> DataFrame:
    """(a, b, corr) of every two series on common dates.  Pairs of series, which are few, not of rows."""
    a, b = returns.select("date", F.col(key).alias("a"), F.col("ret").alias("ra")), returns.select("date", F.col(key).alias("b"), F.col("ret").alias("rb"))
    return a.join(b, "date").filter("a <= b").groupBy("a", "b").agg(safe_corr("ra", "rb").alias("corr"), F.count("*").alias("n"))


def loss_carry_forward(pnl: DataFrame, rate: float = 0.15, exempt_sales: float = 0.0, key: str = "account") -> DataFrame:
    """``pnl`` (period, pnl, sales) plus carried (losses before the period) and tax = rate * max(0, pnl - carried) on gains.

    Carried losses are a walk reflected at zero, S - min(0, running min of S) with S the running sum of -pnl: windows only.
    Periods with sales up to the exemption are not taxed and use up nothing when they gain; their losses still count.
    """
    w = by_time(key, "period")
    counts = (F.col("sales") > exempt_sales) | (F.col("pnl") < 0)
    x = pnl.withColumn("_s", F.sum(F.when(counts, -F.col("pnl")).otherwise(0.0)).over(history(w)))
    x = x.withColumn("_cf", F.col("_s") - F.least(F.lit(0.0), F.min("_s").over(history(w))))
    x = x.withColumn("carried", F.coalesce(F.lag("_cf").over(w), F.lit(0.0)))
    tax = F.when(F.col("sales") > exempt_sales, rate * F.greatest(F.lit(0.0), F.col("pnl") - F.col("carried"))).otherwise(0.0)
    return x.withColumn("tax", F.when(F.col("pnl") > 0, tax).otherwise(0.0)).drop("_s", "_cf")


def underinvested(weights: DataFrame) -> DataFrame:
    """Dates whose weights sum to more than 0 and less than 1 - 1e-4."""
    return weights.groupBy("date").agg(F.sum("weight").alias("invested")).filter((F.col("invested") > 0) & (F.col("invested") < 1 - 1e-4))
