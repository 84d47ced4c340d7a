"""Point-in-time fundamentals: filings as known on a date, trailing twelve months, snapshots, memberships."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import ratio
from .grid import as_of

STALE_DAYS = 400  # fixed value: a metric dies this long after its filing


def latest_version(filings: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key that is last in ``order``."""
    w = Window.partitionBy(*keys).orderBy(*(F.col(c).desc() for c in order))
    return filings.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def known_on(dates: DataFrame, filings: DataFrame, metrics: list[str], key: str = "company", time: str = "date", expire: int | None = STALE_DAYS) -> DataFrame:
    """``dates`` (key, time) plus each metric's last non-null value filed by then; of one day's filings the highest version counts."""
    day = filings.groupBy(key, "filing_date").agg(*(F.max_by(m, F.when(F.col(m).isNotNull(), F.struct("version", "filing_id"))).alias(m) for m in metrics))
    return as_of(dates, day, key, time, "filing_date", metrics, expire_days=expire)


def trailing_twelve_months(filings: DataFrame, value: str = "net_income") -> DataFrame:
    """Per annual or interim filing: ttm = the value itself, or year to date + prior annual - prior year to date, components as filed by then.

    Needs company, fiscal_year, quarter (NULL for annual), filing_date, version.  Only the latest version of each period is stamped.
    """
    annual = filings.filter("quarter is null").select("company", (F.col("fiscal_year") + 1).alias("fy"), F.col("filing_date").alias("_d"), F.col(value).alias("prior_annual"))
    interim = filings.filter("quarter is not null").select("company", (F.col("fiscal_year") + 1).alias("fy"), F.col("quarter").alias("q"), F.col("filing_date").alias("_d"), F.col(value).alias("prior_ytd"))
    rows = latest_version(filings, ["company", "fiscal_year", "quarter"], ["version", "filing_date"])
    rows = rows.withColumn("_year", F.concat_ws("|", "company", "fiscal_year")).withColumn("_quarter", F.concat_ws("|", "company", "fiscal_year", F.coalesce("quarter", F.lit(0))))
    a = annual.select(F.concat_ws("|", "company", "fy").alias("_year"), "_d", "prior_annual")
    q = interim.select(F.concat_ws("|", "company", "fy", "q").alias("_quarter"), "_d", "prior_ytd")
    both = as_of(as_of(rows, a, "_year", "filing_date", "_d", ["prior_annual"]), q, "_quarter", "filing_date", "_d", ["prior_ytd"])
    return both.withColumn("ttm", F.when(F.col("quarter").isNull(), F.col(value)).otherwise(F.col(value) + F.col("prior_annual") - F.col("prior_ytd"))).drop("_year", "_quarter")


def propagate_shares(statements: DataFrame, shares: DataFrame, key: str = "company") -> DataFrame:
    """Statements whose ``shares`` is missing get the latest count filed by their filing date."""
    found = as_of(statements, shares.filter("shares > 0").groupBy(key, F.col("filing_date").alias("_d")).agg(F.max_by("shares", "version").alias("_shares")), key, "filing_date", "_d", ["_shares"])
    return found.withColumn("shares", F.coalesce("shares", "_shares")).drop("_shares")


def spread_to_tickers(by_root: DataFrame, tickers: DataFrame) -> DataFrame:
    """A company's figures on each of its tickers."""
    return by_root.join(tickers, "root")


def monthly_snapshot(filings: DataFrame, months: DataFrame, metrics: list[str]) -> DataFrame:
    """(month_end, company, metrics): each metric as known on its own; rows with none are left out."""
    companies = filings.select("company").distinct()
    grid = companies.crossJoin(F.broadcast(months.agg(F.collect_set("period").alias("_m")))).select("company", F.explode("_m").alias("month_end"))
    return known_on(grid, filings, metrics, time="month_end").dropna("all", subset=metrics)


def member_as_of(dates: DataFrame, history: DataFrame, wanted: list[str], key: str = "company", time: str = "date") -> DataFrame:
    """``dates`` plus member: whether the sector last filed by then contains one of the wanted words, whatever the case."""
    any_of = "(?i)" + "|".join(w.replace("(", "\\(").replace(")", "\\)") for w in wanted)
    flags = history.select(key, F.col("ref_date").alias("_d"), F.col("sector").rlike(any_of).alias("member"))
    return as_of(dates, flags, key, time, "_d", ["member"]).withColumn("member", F.coalesce("member", F.lit(False)))


def survivors(tickers: DataFrame, register: DataFrame, start: str) -> DataFrame:
    """Tickers except those whose root is known and was delisted before ``start``; unknown roots stay."""
    gone = register.groupBy("root").agg(F.max(F.coalesce("delisting_date", F.lit("9999-12-31").cast("date"))).alias("_last")).filter(F.col("_last") < F.lit(start).cast("date"))
    return tickers.join(gone, "root", "left_anti")


def valuation(df: DataFrame) -> DataFrame:
    """pe, pb, ev_ebitda from close, shares, and money in thousands: NULL unless every part is positive."""
    cap = F.col("close") * F.col("shares")
    ok = (F.col("close") > 0) & (F.col("shares") > 0)
    over = lambda value, base: F.when(ok & (F.col(base) > 0), ratio(value, F.col(base) * 1000))
    return df.withColumns({"pe": over(cap, "net_income"), "pb": over(cap, "equity"), "ev_ebitda": over(cap + F.coalesce("net_debt", F.lit(0.0)) * 1000, "ebitda")})


def quality_ratios(df: DataFrame) -> DataFrame:
    """earnings_yield, roe, roa, net_margin, debt_to_equity; each with its own guard."""
    positive = lambda a, b: F.when(F.col(b) > 0, ratio(a, b))
    return df.withColumns({
        "earnings_yield": F.when((F.col("close") > 0) & (F.col("shares") > 0), ratio(F.col("net_income") * 1000, F.col("close") * F.col("shares"))),
        "roe": positive("net_income", "equity"), "roa": positive("net_income", "total_assets"), "net_margin": F.when(F.col("revenue") != 0, ratio("net_income", "revenue")), "debt_to_equity": positive("net_debt", "equity"),
    })
