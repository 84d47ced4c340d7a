"""Column builders: null-safe arithmetic, time-axis windows per instrument, cross-sectional measures per date.

Missing is NULL only; ratios never raise: a zero or missing denominator gives NULL.  A time-axis builder takes the column,
the number of rows and a window that orders one instrument's dense rows; a cross-sectional one takes a window that
is partitioned by date without order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ---- elementwise


def ratio(a: str | Column, b: str | Column) -> Column:
    return F.try_divide(col(a), col(b))


def where(x: str | Column, cond: Column) -> Column:
    """x where the condition is true, NULL otherwise."""
    return F.when(cond, col(x))


def nan_add(a: str | Column, b: str | Column) -> Column:
    """Sum in which one missing side counts as zero; NULL if both are missing."""
    a, b = col(a), col(b)
    return F.when(a.isNotNull() | b.isNotNull(), F.coalesce(a, F.lit(0.0)) + F.coalesce(b, F.lit(0.0)))


def mask_glitch(x: str | Column, flag: str | Column) -> Column:
    """NULL where the flag is 1; a missing flag keeps the value."""
    return F.when(F.coalesce(col(flag), F.lit(0)) != 1, col(x))


def clip(x: str | Column, low: float, high: float) -> Column:
    x = col(x)
    return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(high)), F.lit(low)))


def log(x: str | Column) -> Column:
    x = col(x)
    return F.when(x > 0, F.ln(x))


def flag(cond: Column) -> Column:
    """1 or 0; an unknown condition is 0."""
    return F.coalesce(cond, F.lit(False)).cast("int")


def standard_lot(ticker: str | Column) -> Column:
    """Root of four characters with class 3 to 6, or with 11."""
    t = col(ticker)
    return ((F.length(t) == 5) & F.substring(t, 5, 1).isin("3", "4", "5", "6")) | ((F.length(t) == 6) & (F.substring(t, 5, 2) == "11"))


# ---- time axis


def by_time(key: str = "ticker", time: str = "date") -> WindowSpec:
    return Window.partitionBy(key).orderBy(time)


def frame(w: WindowSpec, n: int) -> WindowSpec:
    return w.rowsBetween(-(n - 1), 0)


def history(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, 0)


def rolling(fn: Callable[[Column], Column], x: str | Column, n: int, w: WindowSpec, least: int | None = None) -> Column:
    """fn over the last n rows; NULL with fewer than ``least`` (n unless given) values."""
    x, f = col(x), frame(w, n)
    return F.when(F.count(x).over(f) >= (n if least is None else least), fn(x).over(f))


def shift(x: str | Column, n: int, w: WindowSpec) -> Column:
    return F.lag(col(x), n).over(w) if n >= 0 else F.lead(col(x), -n).over(w)


def pct_change(x: str | Column, n: int, w: WindowSpec) -> Column:
    return ratio(col(x), shift(x, n, w)) - 1


def diff(x: str | Column, n: int, w: WindowSpec) -> Column:
    return col(x) - shift(x, n, w)


def roll_sum(x, n, w, least=None):
    return rolling(F.sum, x, n, w, least)


def roll_mean(x, n, w, least=None):
    return rolling(F.avg, x, n, w, least)


def roll_std(x, n, w, least=None):
    return rolling(F.stddev_samp, x, n, w, least)


def roll_var(x, n, w, least=None):
    return rolling(F.var_samp, x, n, w, least)


def roll_min(x, n, w, least=None):
    return rolling(F.min, x, n, w, least)


def roll_max(x, n, w, least=None):
    return rolling(F.max, x, n, w, least)


def roll_median(x: str | Column, n: int, w: WindowSpec, least: int | None = None) -> Column:
    return rolling(lambda c: F.percentile(c, F.lit(0.5)), x, n, w, least)


def unbiased_skew(fn: Callable[[Callable[[Column], Column]], Column], x: Column) -> Column:
    """Sample skewness from population skewness; ``fn`` applies an aggregate to x over a frame or group."""
    n = fn(F.count)
    return F.when(n >= 3, fn(F.skewness) * F.sqrt(n * (n - 1)) / (n - 2))


def roll_skew(x: str | Column, n: int, w: WindowSpec, least: int | None = None) -> Column:
    x, f = col(x), frame(w, n)
    k = F.count(x).over(f)
    return F.when((k >= (n if least is None else least)) & (k >= 3), F.skewness(x).over(f) * F.sqrt(k * (k - 1)) / (k - 2))


def roll_kurt(x: str | Column, n: int, w: WindowSpec, least: int | None = None) -> Column:
    x, f = col(x), frame(w, n)
    k = F.count(x).over(f)
    return F.when((k >= (n if least is None else least)) & (k >= 4), (k - 1) / ((k - 2) * (k - 3)) * ((k + 1) * F.kurtosis(x).over(f) + 6))


def roll_beta(y: str | Column, x: str | Column, n: int, w: WindowSpec, least: int | None = None) -> Column:
    """Slope of y on x over rows where both are known."""
    both = col(x).isNotNull() & col(y).isNotNull()
    y, x, f = F.when(both, col(y)), F.when(both, col(x)), frame(w, n)
    return F.when(F.count(x).over(f) >= (n if least is None else least), F.try_divide(F.covar_samp(y, x).over(f), F.nullif(F.var_samp(x).over(f), F.lit(0.0))))


def win_rate(r: str | Column, n: int, w: WindowSpec, least: int | None = None) -> Column:
    """Share of the last n rows with a positive value; a missing value counts as none."""
    f = frame(w, n)
    return F.when(F.count(F.lit(1)).over(f) >= (n if least is None else least), F.avg(flag(col(r) > 0)).over(f))


def growth(r: str | Column, w: WindowSpec) -> Column:
    """Cumulative product of 1 + r up to the row."""
    return F.product(1 + F.coalesce(col(r), F.lit(0.0))).over(history(w))


# ---- cross-section


def pct_rank(x: str | Column, across: list[str]) -> Column:
    """Rank as a share of the known values, ties averaged, NULL for NULL.

    Ties are the row's peers in the same ordered window, so one shuffle and one sort serve all three parts.
    """
    x = col(x)
    ordered = Window.partitionBy(*across).orderBy(x.asc_nulls_last())
    tied = ordered.rangeBetween(Window.currentRow, Window.currentRow)
    return F.when(x.isNotNull(), (F.rank().over(ordered) + (F.count(F.lit(1)).over(tied) - 1) / 2) / F.count(x).over(Window.partitionBy(*across)))


def zscore(x: str | Column, across: list[str]) -> Column:
    x, c = col(x), Window.partitionBy(*across)
    return F.try_divide(x - F.avg(x).over(c), F.nullif(F.stddev_samp(x).over(c), F.lit(0.0)))


def demean(x: str | Column, across: list[str]) -> Column:
    return col(x) - F.avg(col(x)).over(Window.partitionBy(*across))


def quantile(x: str | Column, q: float, across: list[str]) -> Column:
    """Linear-interpolated quantile of each group."""
    return F.percentile(col(x), F.lit(q)).over(Window.partitionBy(*across))


def share(x: str | Column, across: list[str]) -> Column:
    """x over its group's sum: proportional weights."""
    return F.try_divide(col(x), F.sum(col(x)).over(Window.partitionBy(*across)))


# ---- aggregates


def safe_corr(x: str | Column, y: str | Column) -> Column:
    """Correlation over pairs where both are known; NULL at zero variance."""
    both = col(x).isNotNull() & col(y).isNotNull()
    x, y = F.when(both, col(x)), F.when(both, col(y))
    return F.try_divide(F.covar_samp(x, y), F.nullif(F.stddev_samp(x) * F.stddev_samp(y), F.lit(0.0)))
