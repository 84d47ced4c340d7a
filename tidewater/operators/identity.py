"""Instruments and issuers: which ticker, class and company belong together."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import col
from .merge import keep_one

# Share classes by the number that ends a ticker.
CLASSES = {"3": "ON", "4": "PN", "5": "PNA", "6": "PNB", "11": "UNIT"}


def root_of(ticker: str | Column) -> Column:
    """The four characters that a company's tickers share; a join on it replaces a join on a prefix."""
    return F.substring(col(ticker), 1, 4)


def share_class(ticker: str | Column) -> Column:
    """Class by the number after the root; NULL for other numbers."""
    number = F.substring(col(ticker), 5, 8)
    return F.coalesce(*(F.when(number == n, name) for n, name in CLASSES.items()))


def is_primary(ticker: str | Column) -> Column:
    """Whether the ticker is its company's voting share."""
    return F.coalesce(share_class(ticker) == "ON", F.lit(False))


def isin_root(isin: str | Column) -> Column:
    return F.when(F.length(col(isin)) >= 8, F.substring(col(isin), 3, 4))


def isin_class(isin: str | Column) -> Column:
    """ON or PN by the letters in places 7 to 11; ON where neither stands there."""
    mark = F.substring(col(isin), 7, 5)
    return F.when(F.length(col(isin)) >= 8, F.when(mark.contains("OR"), "ON").when(mark.contains("PR"), "PN").otherwise("ON"))


def isin_tickers(isins: DataFrame, tickers: DataFrame) -> DataFrame:
    """(isin, ticker): for each isin the first of its root's tickers that ends as its class does, else the root's first ticker."""
    i = isins.select("isin", isin_root("isin").alias("root"), isin_class("isin").alias("wanted")).filter("root is not null").distinct()
    t = tickers.select("ticker", root_of("ticker").alias("root")).distinct()
    end = F.substring("ticker", -1, 1)
    fits = ((F.col("wanted") == "ON") & (end == "3")) | ((F.col("wanted") == "PN") & end.isin("4", "5", "6"))
    return i.join(t, "root").groupBy("isin").agg(F.min(F.struct((~fits).alias("other"), "ticker")).alias("best")).select("isin", "best.ticker")


def latest_isin(quotes: DataFrame) -> DataFrame:
    """(ticker, isin): the isin of each ticker's last dated row that has one; of one date the greater."""
    known = quotes.filter("isin is not null and isin <> 'UNKNOWN'")
    return known.groupBy("ticker").agg(F.max_by("isin", F.struct("date", "isin")).alias("isin"))


def identity_map(quotes: DataFrame) -> DataFrame:
    """(ticker, isin, first_seen, last_seen, share_class, primary) of every pair that was ever quoted."""
    seen = quotes.groupBy("ticker", "isin").agg(F.min("date").alias("first_seen"), F.max("date").alias("last_seen"))
    return seen.withColumns({"share_class": share_class("ticker"), "is_primary": is_primary("ticker")})


def most_traded(quotes: DataFrame, company: str = "company") -> DataFrame:
    """(company, ticker, mean_volume): each company's ticker of the largest mean volume; ties go to the smaller ticker."""
    mean = quotes.groupBy(company, "ticker").agg(F.avg("volume").alias("mean_volume"))
    best = Window.partitionBy(company).orderBy(F.desc("mean_volume"), "ticker")
    return mean.withColumn("n", F.row_number().over(best)).filter("n = 1").drop("n")


def share_totals(classes: DataFrame, keys: list[str], shares: str = "shares") -> DataFrame:
    """The sum over classes; zero or less counts as unknown."""
    total = F.sum(shares)
    return classes.groupBy(*keys).agg(F.when(total > 0, total).alias(shares))


def bulk_update(target: DataFrame, source: DataFrame, keys: list[str], values: list[str], order: list[str], keep_known: bool = False) -> DataFrame:
    """``target`` with ``values`` taken from the matching row of ``source``, where that has one; with ``keep_known`` only where missing.

    Of several source rows of a key the last in ``order`` counts, and of those that tie there the one with the greater values.
    """
    new = keep_one(source, keys, [*order, *values]).select(*keys, *(F.col(v).alias(f"_new_{v}") for v in values))
    pick = lambda v: F.coalesce(v, f"_new_{v}") if keep_known else F.coalesce(f"_new_{v}", v)
    return target.join(new, keys, "left").select(*(pick(c).alias(c) if c in values else F.col(c) for c in target.columns))


def scaled(amount: str | Column, code: str | Column) -> Column:
    """Amounts in thousands: code 01 is in units, 02 and unknown codes are in thousands already."""
    return F.when(col(code) == "01", col(amount) / 1000).otherwise(col(amount))


def scaled_quantity(amount: str | Column, code: str | Column) -> Column:
    """Quantities in units: code 02 is in thousands, others are in units already."""
    return F.when(col(code) == "02", col(amount) * 1000).otherwise(col(amount))


def version_of(date: str | Column) -> Column:
    """A version number that orders filings across files: the date as yyyymmdd."""
    return F.date_format(col(date), "yyyyMMdd").cast("int")


def merge_statements(*statements: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key with the columns of all statements; a key that one of them lacks keeps its row."""
    out = statements[0]
    for s in statements[1:]:
        out = out.join(s, keys, "full")
    return out


def volume_in_hundreds(quotes: DataFrame, rows: int = 63, least: float = 5e7) -> DataFrame:
    """``quotes`` with volume times 100 if no ticker's median over its last ``rows`` rows reaches ``least``."""
    last = Window.partitionBy("ticker").orderBy(F.desc("date"))
    recent = quotes.withColumn("_n", F.row_number().over(last)).filter(F.col("_n") <= rows)
    most = recent.groupBy("ticker").agg(F.percentile("volume", F.lit(0.5)).alias("m")).agg(F.max("m").alias("_most"))  # one row
    return quotes.crossJoin(F.broadcast(most)).withColumn("volume", F.when(F.col("_most") < least, F.col("volume") * 100).otherwise(F.col("volume"))).drop("_most")


def active_on(register: DataFrame, date: str) -> DataFrame:
    """Names listed by the date and not yet delisted on it."""
    day = F.lit(date).cast("date")
    return register.filter((F.col("listing_date") <= day) & (F.col("delisting_date").isNull() | (F.col("delisting_date") > day)))


def ever_member(history: DataFrame, patterns: list[str], key: str = "company") -> DataFrame:
    """Keys whose sector held one of the patterns at any time, whatever the case."""
    sector = F.lower("sector")
    found = reduce(or_, (sector.contains(p.lower()) for p in patterns))
    return history.filter(F.coalesce(found, F.lit(False))).select(key).distinct()


def completed_quarters(dates: DataFrame) -> DataFrame:
    """(rebalance): the last date of every quarter but the one that the table ends in."""
    ends = dates.groupBy(F.trunc("date", "quarter").alias("q")).agg(F.max("date").alias("rebalance"))
    return ends.withColumn("_last", F.max("q").over(Window.partitionBy())).filter("q < _last").select("rebalance")


def mid_quarter_dates(dates: DataFrame) -> DataFrame:
    """(rebalance): the first date from the 15th of April, June, September and December on."""
    return dates.filter(F.month("date").isin(4, 6, 9, 12) & (F.dayofmonth("date") >= 15)).groupBy(F.trunc("date", "month")).agg(F.min("date").alias("rebalance")).select("rebalance")


def inception(counts: DataFrame, least: int) -> DataFrame:
    """``counts`` (date, n) plus started: whether any date so far had ``least`` names."""
    w = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)  # one row a rebalance
    return counts.withColumn("started", F.max((F.col("n") >= least).cast("int")).over(w) == 1)
