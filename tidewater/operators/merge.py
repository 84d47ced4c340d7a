"""Keyed merges of a table with incoming rows, and small sinks."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], order: list[str] = ()) -> DataFrame:
    """Incoming rows replace existing ones of the same key; of several incoming ones the last in ``order`` wins."""
    both = existing.withColumn("_p", F.lit(0)).unionByName(incoming.withColumn("_p", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(F.desc("_p"), *(F.col(c).desc() for c in order))
    return both.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_p", "_n")


def fill_missing(existing: DataFrame, incoming: DataFrame, keys: list[str], overwrite: list[str] = ()) -> DataFrame:
    """Existing values win and missing ones are filled; columns in ``overwrite`` take the incoming value wherever the key comes in."""
    others = [c for c in existing.columns if c not in keys]
    new = incoming.select(*keys, *(F.col(c).alias(f"_{c}") for c in others), F.lit(True).alias("_in"))
    joined = existing.join(new, keys, "full")
    pick = lambda c: F.when(F.col("_in"), F.col(f"_{c}")).otherwise(F.col(c)) if c in overwrite else F.coalesce(c, f"_{c}")
    return joined.select(*keys, *(pick(c).alias(c) for c in others))


def keep_one(df: DataFrame, keys: list[str], order: list[str], last: bool = True) -> DataFrame:
    """One row per key: the last, or the first, in ``order``."""
    w = Window.partitionBy(*keys).orderBy(*(F.col(c).desc() if last else F.col(c) for c in order))
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def replace_table(df: DataFrame, path: str) -> int:
    """Writes a validated set as the table's next version and returns its number; readers see the version before until this one is committed.

    A version is never written over: of two writers that took the same number the one that finds the other's folder fails.
    """
    spark = df.sparkSession
    try:
        last = spark.read.parquet(path).agg(F.max("version")).first()[0] or 0
    except AnalysisException:  # no version yet
        last = 0
    df.write.mode("error").parquet(f"{path}/version={last + 1}")
    return last + 1


def current_table(spark: SparkSession, path: str) -> DataFrame:
    """The latest committed version of a table that ``replace_table`` writes."""
    versions = spark.read.parquet(path)
    latest = versions.agg(F.max("version").alias("version"))  # one row, from folder names
    return versions.join(F.broadcast(latest), "version").drop("version")


def append_ic(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """IC series with new ones appended: of one (feature, horizon, date) the incoming value stays."""
    return upsert(existing, incoming, ["feature", "horizon", "date"])


def write_results(series: DataFrame, metadata: dict[str, str], path: str, run_id: str) -> None:
    """A run's named series (series, date, value) and its metadata, each in the run's own folder."""
    series.select("series", "date", "value").write.mode("overwrite").parquet(f"{path}/series/run_id={run_id}")
    series.sparkSession.createDataFrame(sorted(metadata.items()), "key string, value string").coalesce(1).write.mode("overwrite").parquet(f"{path}/metadata/run_id={run_id}")


def write_importances(importances: DataFrame, measures: DataFrame, path: str) -> None:
    """Importances as CSV and measures as JSON; both have as many rows as features or models."""
    importances.orderBy("place").coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/importances")
    measures.coalesce(1).write.mode("overwrite").json(f"{path}/measures")


def write_back(quotes: DataFrame, adjusted: DataFrame, columns: list[str], keys: tuple[str, ...] = ("ticker", "isin", "date")) -> DataFrame:
    """``quotes`` with adjusted columns set from the matching rows; a row without a match keeps what it had, NULL for a new column."""
    new = adjusted.select(*keys, *(F.col(c).alias(f"_new_{c}") for c in columns))
    old = {c: F.col(c) if c in quotes.columns else F.lit(None).cast(adjusted.schema[c].dataType) for c in columns}
    others = [c for c in quotes.columns if c not in columns]
    return quotes.join(new, list(keys), "left").select(*others, *(F.coalesce(f"_new_{c}", old[c]).alias(c) for c in columns))


def write_features(features: DataFrame, path: str) -> None:
    """Features as float32, one folder per feature, so that reading some of them prunes the rest."""
    features.withColumn("value", F.col("value").cast("float")).write.partitionBy("feature").mode("overwrite").parquet(path)


def read_features(spark, path: str, names: list[str]) -> DataFrame:
    return spark.read.parquet(path).filter(F.col("feature").isin(names))


def fingerprint(df: DataFrame, time: str, value: str) -> DataFrame:
    """One row: 16 hex digits over the number of rows, the span of dates and the number of known values."""
    x = df.agg(F.count("*").alias("rows"), F.min(time).alias("first"), F.max(time).alias("last"), F.count(value).alias("known"))
    return x.withColumn("fingerprint", F.substring(F.sha2(F.concat_ws("|", "rows", F.col("first").cast("string"), F.col("last").cast("string"), "known"), 256), 1, 16))


# What an admitted quote meets; a missing price or volume fails the first rule that asks for it.
REASONS = {"close": "close > 0", "volume": "volume > 0", "range": "high >= low", "close_outside": "close is null or low is null or high is null or close between low and high"}


def fails(rule: str) -> Column:
    return ~F.coalesce(F.expr(rule), F.lit(False))


def admit_quotes(bars: DataFrame) -> DataFrame:
    """Bars that fail none of the rules; missing ISINs become UNKNOWN, missing factors 1."""
    sane = bars.filter(~reduce(or_, map(fails, REASONS.values())))
    return sane.fillna({c: v for c, v in (("isin", "UNKNOWN"), ("quotation_factor", 1)) if c in bars.columns})


def reject_counts(bars: DataFrame) -> DataFrame:
    """(reason, count): why quotes are not admitted; a row may fail for several reasons."""
    counts = bars.agg(*(F.count_if(fails(rule)).alias(name) for name, rule in REASONS.items()))
    return counts.select(F.explode(F.create_map(*(x for name in REASONS for x in (F.lit(name), F.col(name))))).alias("reason", "count"))


def catalog(scored: DataFrame) -> DataFrame:
    """One row per feature for a JSON export: metrics per horizon as a map, ranked by the best absolute ic_ir."""
    metrics = F.struct("mean_ic", "ic_ir", "pct_positive")
    out = scored.groupBy("feature").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("horizon").cast("string").alias("horizon"), metrics.alias("metrics"))))).alias("horizons"), F.max(F.abs("ic_ir")).alias("best"))
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("best"), "feature")))  # features are hundreds
