"""Data-quality checks as single passes: counts per rule, then a severity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def severity(count: str | Column, warn: int = 1, error: int = 100) -> Column:
    n = F.col(count) if isinstance(count, str) else count
    return F.when(n >= error, "ERROR").when(n >= warn, "WARN").otherwise("OK")


def rule_counts(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, count) of the rows that break each rule, in one pass."""
    row = df.agg(*(F.count_if(cond).alias(name) for name, cond in rules.items()))
    return row.select(F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.col(n).alias("count")) for n in rules))).alias("e")).select("e.rule", "e.count")


def null_rates(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, null_rate)."""
    row = df.agg(*(F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns))
    return row.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("null_rate")) for c in columns))).alias("e")).select("e.column", "e.null_rate")


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("count")).filter("count > 1")


def orphans(child: DataFrame, parent: DataFrame, on: Column) -> DataFrame:
    """Child rows without a parent."""
    return child.join(parent, on, "left_anti")


def table_summary(df: DataFrame, name: str, key: str, time: str) -> DataFrame:
    """(table, rows, keys, first, last)."""
    return df.agg(F.count("*").alias("rows"), F.countDistinct(key).alias("keys"), F.min(time).alias("first"), F.max(time).alias("last")).select(F.lit(name).alias("table"), "rows", "keys", "first", "last")


def outside_span(events: DataFrame, bars: DataFrame, key: str, at: str) -> DataFrame:
    """Events before the first or after the last bar of their instrument: the spans are aggregated first, then joined."""
    spans = bars.groupBy(key).agg(F.min("date").alias("first"), F.max("date").alias("last"))
    return events.join(spans, key).filter((F.col(at) < F.col("first")) | (F.col(at) > F.col("last")))


def table_sample(df: DataFrame, order: list[str], n: int = 100) -> DataFrame:
    """The first ``n`` rows in ``order``, for a look at a table."""
    return df.orderBy(*order).limit(n)
