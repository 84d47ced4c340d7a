"""Fundamentals as known at month ends, kept as a table partitioned by month that late filings refresh in part."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .fundamentals import STALE_DAYS, monthly_snapshot


def touched(new_filings: DataFrame, months: DataFrame) -> DataFrame:
    """(period): the months in which a filing of ``new_filings`` (filing_date) can be the last known one: from its own to the last before it is stale."""
    dates = new_filings.select("filing_date").distinct()
    hit = (F.col("period") >= F.col("filing_date")) & (F.datediff("period", "filing_date") <= STALE_DAYS)
    return months.select("period").distinct().join(dates, hit, "left_semi")


def snapshot(filings: DataFrame, months: DataFrame, metrics: list[str], tickers: DataFrame) -> DataFrame:
    """(month_end, company, ticker, metrics): each metric as known on its own, under the company's most traded ticker of ``tickers`` (company, ticker), else its own key.

    Only filings that some of the ``months`` (period) can still know are read.
    """
    span = months.agg(F.min("period").alias("first"), F.max("period").alias("last"))  # one row
    recent = filings.join(F.broadcast(span), (F.col("filing_date") <= F.col("last")) & (F.col("filing_date") >= F.date_sub("first", STALE_DAYS))).drop("first", "last")
    made = monthly_snapshot(recent, months, metrics)
    return made.join(tickers.select("company", "ticker"), "company", "left").select("month_end", "company", F.coalesce("ticker", F.col("company").cast("string")).alias("ticker"), *metrics)


def write_snapshot(made: DataFrame, path: str) -> None:
    """Writes the months of ``made`` and leaves all others as they are."""
    made.repartition("month_end").write.partitionBy("month_end").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def refresh(filings: DataFrame, new_filings: DataFrame, months: DataFrame, metrics: list[str], tickers: DataFrame, path: str) -> None:
    """Rewrites the months that ``new_filings``, which are among ``filings``, can change."""
    write_snapshot(snapshot(filings, touched(new_filings, months), metrics, tickers), path)


def read_metrics(spark: SparkSession, path: str, metrics: list[str], first: str | None = None, last: str | None = None) -> DataFrame:
    """(month_end, ticker, metrics) of the months from ``first`` to ``last``; only their folders and the metrics' columns are read."""
    out = spark.read.parquet(path)
    if first is not None:
        out = out.filter(F.col("month_end") >= F.lit(first).cast("date"))
    if last is not None:
        out = out.filter(F.col("month_end") <= F.lit(last).cast("date"))
    return out.select("month_end", "ticker", *metrics)


def read_metric(spark: SparkSession, path: str, metric: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """(month_end, ticker, value): one metric, without the names that lack it."""
    return read_metrics(spark, path, [metric], first, last).select("month_end", "ticker", F.col(metric).alias("value")).filter("value is not null")
