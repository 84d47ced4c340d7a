"""Corporate actions from JSON: cash events, and share events split into usable and skipped ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .filings import local_number, parse_date

# Labels of the source and the class suffix of each kind of share.
CASH = {"DIVIDENDO": "CASH_DIVIDEND", "RENDIMENTO": "CASH_DIVIDEND", "JRS CAP PROPRIO": "JCP"}
SHARES = {"DESDOBRAMENTO": "STOCK_SPLIT", "GRUPAMENTO": "REVERSE_SPLIT", "BONIFICACAO": "BONUS_SHARES"}
REVIEW = ("CIS RED CAP", "INCORPORACAO", "RESG TOTAL RV", "CISAO")
SUFFIX = {"ON": "3", "PN": "4", "PNA": "5", "PNB": "6", "UNT": "11"}
SCHEMA = "label string, rate string, valueCash string, factor string, isinCode string, lastDatePrior string, typeStock string, tradingName string"


def read_events(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Records of files that hold one JSON array each."""
    whole = spark.read.text(paths, wholetext=True)
    return whole.select(F.explode(F.from_json("value", f"array<struct<{SCHEMA.replace(' string', ':string')}>>")).alias("e")).select("e.*")


def lookup(table: dict[str, str], c) -> Column:
    return F.create_map(*(F.lit(v) for kv in table.items() for v in kv))[c]


def cash_events(raw: DataFrame, isins: DataFrame | None = None) -> DataFrame:
    """(isin, ex_date, event_type, value): positive cash per share.  A missing ISIN is found by root and class in ``isins`` (ticker, isin)."""
    x = raw.select(
        F.nullif(F.trim("isinCode"), F.lit("")).alias("isin"), parse_date(F.col("lastDatePrior")).alias("ex_date"), lookup(CASH, F.upper(F.trim("label"))).alias("event_type"),
        local_number(F.coalesce("rate", "valueCash")).alias("value"), F.concat(F.upper(F.trim("tradingName")), lookup(SUFFIX, F.upper(F.trim("typeStock")))).alias("ticker"),
    )
    if isins is not None:
        x = x.join(isins.select("ticker", F.col("isin").alias("_isin")), "ticker", "left").withColumn("isin", F.coalesce("isin", "_isin"))
    return x.filter("isin is not null and ex_date is not null and event_type is not null and value > 0").select("isin", "ex_date", "event_type", "value")


def classify_share_events(raw: DataFrame) -> DataFrame:
    """(isin, ex_date, action, factor, reason): reason is NULL for a usable event and says why another is skipped."""
    label = F.translate(F.upper(F.trim("label")), "ÇÃÁ", "CAA")
    x = raw.select(F.col("isinCode").alias("isin"), parse_date(F.col("lastDatePrior")).alias("ex_date"), label.alias("label"), local_number(F.col("factor")).alias("factor"))
    x = x.withColumn("action", lookup(SHARES, F.col("label")))
    size = F.when(F.col("action") == "BONUS_SHARES", 1 + F.col("factor") / 100).otherwise(F.col("factor"))
    reason = (
        F.when(F.col("label") == "RESG TOTAL RV", "delisting_event").when(F.col("label").isin(*REVIEW), "needs_manual_review").when(F.col("action").isNull(), "unrecognized_label")
        .when((F.col("factor") <= 0) | ~size.between(1 / 1000, 1000.0), "extreme_factor")
    )
    return x.withColumn("reason", reason)
