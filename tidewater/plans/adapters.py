"""The engine's inputs derived from the given tables: bars, panel, market series, filings, events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import by_time, pct_change
from ..operators.grid import densify
from .registry import half_up


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def money() -> Column:
    """Sum of extended prices, added up in whole cents so that the order of rows does not matter."""
    return F.sum(F.floor(F.col("l_extendedprice") * 100 + 0.5)) / 100


def bars(spark: SparkSession, sf_dir: str, unit: str = "week", together: bool = False) -> DataFrame:
    """One bar per supplier and week (or day) from the line items' unit prices; volume is in money.

    ``together``: a supplier's items are brought together first, for what goes on by supplier; days seldom have two items to add up before."""
    p = F.col("l_extendedprice") / F.col("l_quantity")
    items = table(spark, sf_dir, "lineitem").filter("l_quantity > 0")
    items = items.repartition("l_suppkey") if together else items
    out = items.groupBy(F.col("l_suppkey").alias("ticker"), F.to_date(F.date_trunc(unit, "l_shipdate")).alias("date")).agg(
        F.min_by(p, F.struct("l_shipdate", "l_orderkey", "l_linenumber", p)).alias("open"), F.max(p).alias("high"), F.min(p).alias("low"),
        (money() / F.sum("l_quantity")).alias("close"), money().alias("volume"),
    )
    return out.select("ticker", "date", "open", "high", "low", "close", "volume")


def panel(spark: SparkSession, sf_dir: str, unit: str = "week") -> DataFrame:
    """The dense panel with ret, the return on the carried-forward close."""
    measures = ["open", "high", "low", "close", "volume"]
    dense = densify(bars(spark, sf_dir, unit), measures, measures[:-1])
    return dense.withColumn("ret", half_up(pct_change("close", 1, by_time()), 9))


def market(spark: SparkSession, sf_dir: str, unit: str = "week", per_year: int = 52) -> DataFrame:
    """(date, level, mret, rate): the whole market's unit price, its return, and the period's risk-free rate.  One row a week, or a day."""
    weekly = table(spark, sf_dir, "lineitem").filter("l_quantity > 0").groupBy(F.to_date(F.date_trunc(unit, "l_shipdate")).alias("date")).agg(
        (money() / F.sum("l_quantity")).alias("level"), (F.sum(F.floor(F.col("l_tax") * 100 + 0.5)) / 100 / F.count("l_tax") / per_year).alias("rate")
    )
    return weekly.withColumn("mret", half_up(F.try_divide(F.col("level"), F.lag("level").over(Window.orderBy("date"))) - 1, 9))


def roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ticker, root): the suppliers' nation as the issuing company."""
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("ticker"), F.col("s_nationkey").alias("root"))


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per filing version: orders as filings of the customer; each status fills another metric."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("company"), F.to_date("o_orderdate").alias("filing_date"), "o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    o = o.withColumn("period_end", F.last_day(F.add_months("filing_date", -2)))
    version = F.row_number().over(Window.partitionBy("company", "period_end").orderBy("filing_date", "o_orderkey"))
    metric = lambda s: F.when(F.col("o_orderstatus") == s, F.col("o_totalprice"))
    return o.select(
        "company", "period_end", "filing_date", version.alias("version"), F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "DFP").otherwise("ITR").alias("doc_type"),
        metric("F").alias("net_income"), metric("O").alias("equity"), metric("P").alias("shares"), F.col("o_orderkey").alias("filing_id"),
    )


def share_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(isin, ex_date, action, factor): splits of 2, 3, 4, 5, 10 for one, one a day and instrument."""
    x = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'A' and l_linenumber = 1 and l_quantity in (2, 3, 4, 5, 10)")
    return x.groupBy(F.col("l_suppkey").alias("ticker"), F.to_date("l_shipdate").alias("ex_date")).agg(F.max("l_quantity").alias("factor")).withColumn("action", F.lit("STOCK_SPLIT"))


def cash_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ticker, ex_date, value): discounts on returned goods as dividends per share."""
    x = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R' and l_quantity > 0")
    return x.groupBy(F.col("l_suppkey").alias("ticker"), F.to_date("l_shipdate").alias("ex_date")).agg(half_up(F.sum(F.col("l_discount") * F.col("l_extendedprice") / F.col("l_quantity")), 6).alias("value"))


def pnl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(account, period, pnl, sales): realised results per user and day; errors and views are losses."""
    e = table(spark, sf_dir, "events")
    signed = F.when(F.col("event_type").isin("error", "view"), -F.col("value")).otherwise(F.col("value"))
    return e.groupBy(F.col("user_id").alias("account"), F.to_date("ts").alias("period")).agg(half_up(F.sum(signed), 6).alias("pnl"), half_up(F.sum("value"), 6).alias("sales"))
