"""Selection and weighting on a long panel: one row per (date, ticker), books as non-zero weights only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import by_time, col, share
from .grid import as_of


def best_per_root(df: DataFrame, across: list[str] = ("date", "root"), liquidity: str = "adtv") -> DataFrame:
    """The most liquid ticker of each company; missing liquidity counts as -1, ties go to the smaller ticker."""
    w = Window.partitionBy(*across).orderBy(F.coalesce(liquidity, F.lit(-1.0)).desc(), "ticker")
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def merge_classes(weights: DataFrame, across: list[str] = ("date", "root")) -> DataFrame:
    """Weights of one company's classes summed onto its most liquid ticker."""
    return weights.groupBy(*across).agg(F.sum("weight").alias("weight"), F.max_by("ticker", F.struct(F.coalesce("adtv", F.lit(-1.0)), -F.col("ticker"))).alias("ticker"))


def top(df: DataFrame, signal: str, n: int | None = None, pct: float | None = None, least_names: int = 1, least_held: int = 1, descending: bool = True, across: tuple[str, ...] = ("date",)) -> DataFrame:
    """The n best by signal, or a share of them but at least ``least_held``; dates with fewer than ``least_names`` names hold none."""
    c = Window.partitionBy(*across)
    known = df.filter(F.col(signal).isNotNull())
    order = F.col(signal).desc() if descending else F.col(signal)
    size = F.lit(n) if n is not None else F.greatest(F.lit(least_held), F.floor(F.col("_names") * pct).cast("int"))
    ranked = known.withColumn("_names", F.count(F.lit(1)).over(c)).withColumn("_n", F.row_number().over(c.orderBy(order, "ticker")))
    return ranked.filter((F.col("_names") >= least_names) & (F.col("_n") <= size)).withColumnRenamed("_n", "place").drop("_names")


def equal_weights(df: DataFrame, across: tuple[str, ...] = ("date",)) -> DataFrame:
    return df.withColumn("weight", F.lit(1.0) / F.count(F.lit(1)).over(Window.partitionBy(*across)))


def proportional_weights(df: DataFrame, x: str, across: tuple[str, ...] = ("date",)) -> DataFrame:
    return df.withColumn("weight", share(x, list(across)))


def capped_weights(df: DataFrame, x: str, cap: float, renormalise: bool = False, across: tuple[str, ...] = ("date",)) -> DataFrame:
    """Weights in proportion to x, none over ``cap``, what is cut going to the others until all fit.

    In closed form: with names in order of x, the k largest are at the cap for the smallest k at which the next one's
    share of the rest fits.  Where n * cap < 1 all are at the cap, and sum to less than one unless renormalised.
    """
    c = Window.partitionBy(*across)
    down = c.orderBy(F.col("_w").desc(), "ticker")
    w = df.filter(F.col(x) > 0).withColumn("_w", share(x, list(across))).withColumn("_k", F.row_number().over(down) - 1)
    w = w.withColumn("_before", F.coalesce(F.sum("_w").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    scale = F.try_divide(1 - F.col("_k") * cap, F.nullif(1 - F.col("_before"), F.lit(0.0)))
    w = w.withColumn("_scale", scale).withColumn("_fits", (F.col("_w") * F.col("_scale") <= cap * (1 + 1e-12)) & (F.col("_scale") >= 0))
    w = w.withColumn("_first", F.min(F.when(F.col("_fits"), F.struct(F.col("_k").alias("k"), F.col("_scale").alias("scale")))).over(c))
    capped = F.col("_first").isNull() | (F.col("_k") < F.col("_first.k"))
    w = w.withColumn("weight", F.when(capped, F.lit(cap)).otherwise(F.col("_w") * F.col("_first.scale")))
    if renormalise:
        w = w.withColumn("weight", share("weight", list(across)))
    return w.drop("_w", "_k", "_before", "_scale", "_fits", "_first")


def bounded_weights(scores: DataFrame, floor: float, cap: float, across: str = "date") -> DataFrame:
    """(across, sleeve, weight): ``scores`` (across, sleeve, weight), none negative, scaled to a sum of one with every weight in [floor, cap].

    A sleeve leaves its floor at the level floor / score and meets its cap at cap / score; between such breakpoints, in their order, the sum grows by a known
    slope, so running sums find the level at which it is one.  Sleeves without a score share equally what is left when all others are at the cap.
    Bounds that n sleeves cannot meet are widened to 1 / n.
    """
    group = Window.partitionBy(across)
    x = scores.select(across, "sleeve", F.greatest(F.col("weight"), F.lit(0.0)).alias("w")).withColumn("n", F.count(F.lit(1)).over(group))
    x = x.withColumns({"w": F.when(F.sum("w").over(group) > 0, F.col("w")).otherwise(1.0), "lo": F.least(F.lit(floor), 1 / F.col("n")), "hi": F.greatest(F.lit(cap), 1 / F.col("n"))})
    known = x.filter("w > 0")
    edges = known.select(across, "n", "lo", F.explode(F.array(F.struct((F.col("lo") / F.col("w")).alias("at"), F.col("w").alias("slope"), F.col("lo").alias("less")), F.struct((F.col("hi") / F.col("w")).alias("at"), (-F.col("w")).alias("slope"), (-F.col("hi")).alias("less")))).alias("e"))
    up = Window.partitionBy(across).orderBy("e.at").rangeBetween(Window.unboundedPreceding, 0)
    edges = edges.select(across, "e.at", F.sum("e.slope").over(up).alias("slope"), (F.col("n") * F.col("lo") + F.sum("e.slope").over(up) * F.col("e.at") - F.sum("e.less").over(up)).alias("total"))
    last = edges.filter(F.col("total") <= 1 + 1e-12).groupBy(across).agg(F.max_by(F.struct("at", "slope", "total"), F.col("at")).alias("k"))
    level = F.col("k.at") + F.when(F.col("k.slope") > 1e-12, (1 - F.col("k.total")) / F.col("k.slope")).otherwise(0.0)
    y = x.join(last.select(across, level.alias("level")), across).withColumn("weight", F.greatest(F.least(F.col("w") * F.col("level"), F.col("hi")), F.col("lo")))
    rest = (1 - F.sum("weight").over(group)) / F.nullif(F.count_if(F.col("w") == 0).over(group), F.lit(0))
    return y.select(across, "sleeve", F.when(F.col("w") == 0, F.least(F.col("weight") + F.greatest(F.coalesce(rest, F.lit(0.0)), F.lit(0.0)), F.col("hi"))).otherwise(F.col("weight")).alias("weight"))


def sticky(selected: DataFrame, calendar: DataFrame) -> DataFrame:
    """Dates of the calendar without a selection keep the previous one.  ``selected``: (date, ticker); a book is a bounded list per date."""
    books = calendar.join(selected.groupBy("date").agg(F.collect_list("ticker").alias("book")), "date", "left")
    held = F.last("book", ignorenulls=True).over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0))
    return books.select("date", held.alias("book")).select("date", F.explode("book").alias("ticker"))


def rank_and_hold(panel: DataFrame, signal: str, eligible: Column, pct: float = 0.1, least_names: int = 5, least_held: int = 5, lag_periods: int = 1, weighting: str = "equal", root: str | None = "root", descending: bool = True) -> DataFrame:
    """(date, ticker, weight): everything is read ``lag_periods`` rows before the date, so no book sees its own period."""
    w = by_time()
    keep = dict.fromkeys(c for c in (signal, "adtv", root) if c)
    seen = panel.withColumn("_ok", eligible).select("date", "ticker", *(F.lag(c, lag_periods).over(w).alias(c) if c != root else F.col(c) for c in keep), F.lag("_ok", lag_periods).over(w).alias("_ok"))
    names = seen.filter(F.coalesce("_ok", F.lit(False)) & F.col(signal).isNotNull())
    if root:
        names = best_per_root(names, ("date", root))
    held = top(names, signal, pct=pct, least_names=least_names, least_held=least_held, descending=descending)
    out = equal_weights(held) if weighting == "equal" else proportional_weights(held, "adtv")
    return out.select("date", "ticker", "weight")


def regime(flags: DataFrame, rules: list[tuple[Column, float, bool]], otherwise: tuple[float, bool]) -> DataFrame:
    """``flags`` (one row a date) plus held_share and parked, from the first rule that is true; unknown is false."""
    pct, park = F.lit(otherwise[0]), F.lit(otherwise[1])
    for cond, p, k in reversed(rules):
        yes = F.coalesce(cond, F.lit(False))
        pct, park = F.when(yes, F.lit(p)).otherwise(pct), F.when(yes, F.lit(k)).otherwise(park)
    return flags.withColumns({"held_share": pct, "parked": park})


def fixed_sleeves(sleeve_live: DataFrame, weights: dict[str, float], all_or_nothing: bool = False, cash: str = "cash") -> DataFrame:
    """(date, sleeve, weight) from (date, sleeve, live): a sleeve is parked in cash until it first lives; the rest goes to cash too."""
    w = Window.partitionBy("sleeve").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    table = sleeve_live.sparkSession.createDataFrame(sorted(weights.items()), "sleeve string, target double")
    live = sleeve_live.join(F.broadcast(table), "sleeve").withColumn("live", F.max(F.coalesce("live", F.lit(False))).over(w))
    if all_or_nothing:
        live = live.withColumn("live", F.min("live").over(Window.partitionBy("date")))
    books = live.select("date", "sleeve", F.when(F.col("live"), F.col("target")).otherwise(0.0).alias("weight"))
    rest = books.groupBy("date").agg((1 - F.sum("weight")).alias("weight")).select("date", F.lit(cash).alias("sleeve"), "weight")
    return books.union(rest).groupBy("date", "sleeve").agg(F.sum("weight").alias("weight")).filter(F.abs("weight") > 1e-12)


def vol_target(returns: DataFrame, target: float, n: int, per_year: int = 52) -> DataFrame:
    """``returns`` (one row a date) plus exposure = clip(target / trailing volatility, 0, 1), from rows before; cash takes the rest."""
    w = Window.orderBy("date").rowsBetween(-n, -1)
    vol = F.when(F.count("ret").over(w) >= n, F.stddev_samp("ret").over(w) * F.sqrt(F.lit(float(per_year))))
    return returns.withColumn("exposure", F.greatest(F.least(F.try_divide(F.lit(target), F.nullif(vol, F.lit(0.0))), F.lit(1.0)), F.lit(0.0))).withColumn("cash", 1 - F.col("exposure"))


def inverse_vol_sleeves(returns: DataFrame, n: int = 36) -> DataFrame:
    """(date, sleeve, weight): weights in inverse proportion to trailing volatility before the date; zero or missing takes the mean one."""
    w = by_time("sleeve").rowsBetween(-n, -1)
    vol = returns.withColumn("vol", F.nullif(F.when(F.count("ret").over(w) >= 2, F.stddev_samp("ret").over(w)), F.lit(0.0)))
    filled = vol.withColumn("vol", F.coalesce("vol", F.avg("vol").over(Window.partitionBy("date")))).filter("vol is not null")
    return proportional_weights(filled.withColumn("_inv", 1 / F.col("vol")), "_inv").select("date", "sleeve", "weight")


def rolling_sharpe_sleeves(returns: DataFrame, n: int = 12, least: float = 0.0, per_year: int = 12, cash: str = "cash") -> DataFrame:
    """(date, sleeve, weight) in proportion to trailing Sharpe ratios over the n dates before; those under ``least`` get nothing.

    Equal weights with under three dates of history; a sleeve with under three returns or no variance scores 0; where none
    reaches ``least`` all goes to cash, whether or not it is a sleeve itself; where all that do score 0, they share equally.
    """
    grid = returns.select("date").distinct().crossJoin(F.broadcast(returns.select("sleeve").distinct()))  # a few sleeves
    w = by_time("sleeve").rowsBetween(-n, -1)
    day = Window.partitionBy("date")
    spread = F.stddev_samp("ret").over(w)
    s = F.when((F.count("ret").over(w) >= 3) & (spread > 0), F.avg("ret").over(w) / spread * F.sqrt(F.lit(float(per_year)))).otherwise(0.0)
    x = grid.join(returns.select("date", "sleeve", "ret"), ["date", "sleeve"], "left").withColumns({"_rows": F.count(F.lit(1)).over(w), "_s": F.floor(s * 1e9 + 0.5) / 1e9})
    ok = F.col("_s") >= least
    x = x.withColumns({"_n": F.count(F.lit(1)).over(day), "_ok": F.sum(ok.cast("int")).over(day), "_total": F.sum(F.when(ok, F.greatest("_s", F.lit(0.0))).otherwise(0.0)).over(day)})
    none = (F.col("_rows") >= 3) & (F.col("_ok") == 0)
    shared = F.when(~ok, 0.0).when(F.col("_total") == 0, F.lit(1.0) / F.col("_ok")).otherwise(F.greatest("_s", F.lit(0.0)) / F.col("_total"))
    weight = F.when(F.col("_rows") < 3, F.lit(1.0) / F.col("_n")).when(none, F.when(F.col("sleeve") == cash, 1.0).otherwise(0.0)).otherwise(shared)
    out = x.select("date", "sleeve", weight.alias("weight"), none.alias("_none"))
    parked = out.filter("_none").groupBy("date").agg(F.sum("weight").alias("w")).filter("w = 0").select("date", F.lit(cash).alias("sleeve"), F.lit(1.0).alias("weight"))
    return out.select("date", "sleeve", "weight").union(parked)


def regime_budgets(books: DataFrame, flags: DataFrame, budget: dict[tuple[bool, bool], float], cash: str = "cash") -> DataFrame:
    """(date, sleeve, weight): the budget of the date's (easing, calm), dealt equally to its ``books`` (date, sleeve); the rest is cash."""
    easing, calm = (F.coalesce(x, F.lit(False)) for x in ("easing", "calm"))
    equity = F.lit(budget[False, False])
    for (e, k), share_ in budget.items():
        equity = F.when((easing == e) & (calm == k), share_).otherwise(equity)
    days = flags.select("date", equity.alias("equity"))
    held = books.select("date", "sleeve").withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("date"))).join(days, "date").filter("equity > 0").select("date", "sleeve", (F.col("equity") / F.col("n")).alias("weight"))
    alive = books.select("date").distinct().withColumn("alive", F.lit(True))
    rest = days.join(alive, "date", "left").select("date", F.lit(cash).alias("sleeve"), F.when(F.col("alive"), 1 - F.col("equity")).otherwise(1.0).alias("weight"))
    return held.union(rest)


def portfolio_returns(weights: DataFrame, returns: DataFrame, lag_periods: int = 1, key: str = "ticker") -> DataFrame:
    """(date, ret): each date's returns under the weights of ``lag_periods`` dates before."""
    dates = returns.select("date").distinct().withColumn("held", F.lag("date", lag_periods).over(Window.orderBy("date")))
    book = weights.withColumnRenamed("date", "held").join(F.broadcast(dates), "held")
    return book.join(returns.select("date", key, "ret"), ["date", key]).groupBy("date").agg(F.sum(F.col("weight") * F.coalesce("ret", F.lit(0.0))).alias("ret"))


def turnover(weights: DataFrame, calendar: DataFrame, key: str = "ticker") -> DataFrame:
    """(date, turnover): sum of absolute weight changes from the book of the date before."""
    dates = calendar.select("date").distinct().withColumn("next", F.lead("date").over(Window.orderBy("date")))
    ended = weights.join(F.broadcast(dates), "date").filter("next is not null").select(F.col("next").alias("date"), key, (-F.col("weight")).alias("weight"))
    return weights.select("date", key, "weight").union(ended).groupBy("date", key).agg(F.sum("weight").alias("d")).groupBy("date").agg(F.sum(F.abs("d")).alias("turnover"))


def blend(a: str | Column, b: str | Column, part: float = 0.5) -> Column:
    """``part`` of a and the rest of b."""
    return part * col(a) + (1 - part) * col(b)


def index_level(prices: DataFrame, members: DataFrame) -> DataFrame:
    """(period, growth): buy-and-hold growth of each period's members; when one stops trading, its proceeds go to the others in proportion.

    ``members``: (period, ticker, weight); ``prices``: (period, ticker, date, close) within the period.  A period is cut where members
    end; within a segment the weights drift, and segment growths multiply.  A member counts from the first cut by which it has a price.
    """
    p = prices.join(members, ["period", "ticker"])
    ends = p.groupBy("period", "ticker").agg(F.max("date").alias("ends"))
    cuts = ends.select("period", F.col("ends").alias("cut")).distinct()
    first = p.groupBy("period", "ticker", "weight").agg(F.min_by("close", "date").alias("base"), F.max("date").alias("ends"))
    name = F.struct("period", "ticker").alias("_k")
    alive = first.join(cuts, "period").filter("ends >= cut").select(name, "period", "ticker", "weight", "base", "cut")
    at_cut = as_of(alive, p.select(name, F.col("date").alias("_d"), F.col("close").alias("price")), "_k", "cut", "_d", ["price"]).filter("price is not null")
    w = Window.partitionBy("period", "ticker").orderBy("cut")
    at_cut = at_cut.withColumn("start_price", F.coalesce(F.lag("price").over(w), F.col("base")))
    seg = at_cut.groupBy("period", "cut").agg(F.try_divide(F.sum(F.col("weight") * F.col("price") / F.col("base")), F.nullif(F.sum(F.col("weight") * F.col("start_price") / F.col("base")), F.lit(0.0))).alias("g"))
    return seg.groupBy("period").agg(F.product("g").alias("growth"))
