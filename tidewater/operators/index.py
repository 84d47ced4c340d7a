"""A capitalisation-weighted index: who belongs to it at each rebalance, at what weight, and its level."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import pct_rank
from .adjust import share_multiplier
from .fundamentals import known_on

MIN_TURNOVER = 1e-5  # fixed value: a median turnover below this share of the market value means that a share count is wrong


def at_rebalances(panel: DataFrame, rule, rows: int) -> DataFrame:
    """``at_dates`` for the last panel date of each period; ``rule`` maps the date column to its period."""
    return at_dates(panel, panel.groupBy(rule("date").alias("period")).agg(F.max("date").alias("end")).select("end"), rows)


def at_dates(panel: DataFrame, ends: DataFrame, rows: int) -> DataFrame:
    """(date, ticker, close, median_volume) at each date of ``ends`` (end), the median over the last ``rows`` dates, a missing volume being zero.

    Only rows of a window that ends at such a date are looked at: dates are numbered once, a row a date, and each date meets the few windows that hold it.
    """
    days = panel.select("date").distinct().withColumn("k", F.row_number().over(Window.orderBy("date")))  # one row a date
    last = ends.select("end").join(days, F.col("end") == F.col("date")).select("end", F.col("k").alias("last")).filter(F.col("last") >= rows)
    held = last.select("end", F.explode(F.sequence(F.col("last") - rows + 1, "last")).alias("k")).join(days, "k").select("end", "date")
    met = panel.select("date", "ticker", "close", "volume").join(F.broadcast(held), "date")
    out = met.groupBy("end", "ticker").agg(F.percentile(F.coalesce("volume", F.lit(0.0)), F.lit(0.5)).alias("median_volume"), F.max_by("close", "date").alias("close"))
    return out.select(F.col("end").alias("date"), "ticker", "close", "median_volume")


def constituents(quotes: DataFrame, classes: DataFrame, filings: DataFrame, actions: DataFrame, min_cap: float, min_volume: float, earnings: bool = True) -> DataFrame:
    """(date, root, ticker, market_cap, median_volume, net_income, equity, roe): the companies that pass at each date of ``quotes``.

    ``quotes``: (date, ticker, close, median_volume); ``classes``: (ticker, root, share_class), the class 3 for common shares, 4 to 6 for preferred ones, most senior
    first, anything else for units; ``filings``: root, filing_date, version, filing_id, period_end, net_income, equity, shares, shares_common, shares_preferred;
    ``actions``: (ticker, ex_date, factor).

    A company stands by its most liquid class.  Where the filing that gives the share count also splits it by class, each class counts at its own price, a class
    without one at its sibling's; else all shares count at the chosen class's price.  Counts are multiplied by what share events since the filing's period did to them.
    """
    q = quotes.join(classes, "ticker").filter("close > 0")
    volume = F.coalesce("median_volume", F.lit(0.0))
    company = Window.partitionBy("date", "root")
    priced = lambda s: F.max(F.when(F.col("share_class") == s, F.col("close"))).over(company)
    q = q.withColumns({"common": priced("3"), "preferred": F.coalesce(*(priced(s) for s in "456")), "volume": volume, "place": F.row_number().over(company.orderBy(volume.desc(), F.col("ticker").desc()))})
    chosen = q.filter((F.col("place") == 1) & (F.col("volume") > min_volume)).select("date", "root", "ticker", "close", "volume", "common", "preferred")
    counted = F.when(F.col("shares").isNotNull(), F.struct("shares", "shares_common", "shares_preferred", "period_end"))
    known = known_on(chosen, filings.withColumn("counts", counted), ["net_income", "equity", "counts"], key="root")
    out = known.select("*", "counts.*").filter("shares > 0")
    if earnings:
        out = out.filter("net_income > 0 and equity > 0")
    out = share_multiplier(out, actions, "period_end", "date")
    common, preferred = F.coalesce("common", "preferred"), F.coalesce("preferred", "common")
    by_class = F.when(F.col("shares_common") + F.col("shares_preferred") > 0, F.col("shares_common") * common + F.col("shares_preferred") * preferred)
    cap = F.coalesce(by_class, F.col("shares") * F.col("close")) * F.col("multiplier")
    out = out.withColumn("market_cap", cap).filter((F.col("volume") >= F.col("market_cap") * MIN_TURNOVER) & (F.col("market_cap") > min_cap))
    return out.select("date", "root", "ticker", "market_cap", F.col("volume").alias("median_volume"), "net_income", "equity", F.try_divide("net_income", "equity").alias("roe"))


def started(members: DataFrame, least: int) -> DataFrame:
    """``members`` from the first date on that has at least ``least`` of them."""
    first = members.groupBy("date").count().filter(F.col("count") >= least).agg(F.min("date").alias("first"))  # one row
    return members.join(F.broadcast(first), F.col("date") >= F.col("first")).drop("first")


def two_legs(companies: DataFrame, max_age: int = 180, min_roe: float = 0.08, max_pe: float = 20.0, n: int = 20) -> DataFrame:
    """(date, ticker, leg, cheap, place): the ``n`` cheapest clean companies of each date, two legs ranked within themselves and merged.

    ``companies``: date, ticker, market_cap, net_income, equity, roe, ebitda, net_debt, revenue (money in thousands), period_end.  Companies without EBITDA or revenue count as
    financial and rank by price to earnings plus price to book, low first; all others by EBITDA over enterprise value.  A balance older than ``max_age`` days, a loss or
    a margin that is not positive shuts a company out; one with a low return on equity or a high price to earnings is ranked but not chosen.
    That a pool of the cheapest is looked through before the rest changes nothing, as both are taken in one order.
    """
    fresh = companies.filter(F.datediff("date", "period_end") <= max_age)
    financial = F.col("ebitda").isNull() | ~F.coalesce(F.col("revenue") > 0, F.lit(False))
    pe, pb = F.try_divide("market_cap", F.col("net_income") * 1000), F.try_divide("market_cap", F.col("equity") * 1000)
    value = F.col("market_cap") + F.coalesce("net_debt", F.lit(0.0)) * 1000
    x = fresh.withColumns({"leg": F.when(financial, "book").otherwise("yield"), "pe": pe, "score": F.when(financial, -(pe + pb)).otherwise(F.try_divide(F.col("ebitda") * 1000, value))})
    x = x.filter("pe > 0").filter((F.col("leg") == "book") | (F.col("ebitda") > 0)).withColumn("score", F.floor(F.col("score") * 1e12 + 0.5) / 1e12)
    ranked = x.withColumn("cheap", pct_rank("score", ["date", "leg"]))
    clean = ranked.filter((F.col("roe") >= min_roe) & (F.col("pe") <= max_pe))
    placed = clean.withColumn("place", F.row_number().over(Window.partitionBy("date").orderBy(F.desc("cheap"), "ticker")))
    return placed.filter(F.col("place") <= n).select("date", "ticker", "leg", "cheap", "place")
