"""Low-volatility and dividend sleeves on daily volatility, fixed-weight blends that nest them, and the funds the blends hold.

The close is the 63-day mean price of ``spec_queries``.  Funds stand for listed ones: the whole market's unit price, and those of the
goods with return flags A and R, which have prices from their listing dates on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as c
from ..functions.ewm import ewm
from ..functions.prefix import Rolling
from ..operators import fundamentals as fu
from ..operators import grid, portfolio
from . import adapters as a
from . import spec_queries as specs
from .oracle import CASH, lag, roll
from .portfolio_queries import SLEEVES, sleeve_returns
from .registry import half_up, query

# Fixed values of the sleeves.
SPAN, PER_YEAR, TOP_N, CAP, TARGET, WINDOW, LEAST, BOTTOM = 252, 252, 20, 0.10, 0.12, 63, 5, 0.33

# Stand-ins for listed funds: (share of the line items, listing date).
FUNDS = {"index": ("true", "1995-01-01"), "foreign": ("l_returnflag = 'A'", "1996-08-15"), "dividend": ("l_returnflag = 'R'", "1997-02-03")}

# Blends as (sleeves, calendar, all or nothing); a sleeve is a fund, cash, or a nested book on the blend's own calendar.
BLENDS = {
    "baseline_thirds": ((("fund", "index", 1 / 3), ("fund", "foreign", 1 / 3), ("cash", "cash", 1 / 3)), "ME", True),
    "divo_cdi_ivvb": ((("fund", "dividend", 1 / 3), ("cash", "cash", 1 / 3), ("fund", "foreign", 1 / 3)), "QE", False),
    "divo_ivvb_cdi_40_40_20": ((("fund", "dividend", 0.4), ("cash", "cash", 0.2), ("fund", "foreign", 0.4)), "QE", False),
    "qdl_equity_ivvb_5050": ((("book", "qdl_equity", 0.5), ("fund", "foreign", 0.5)), "QE", False),
    "qdl_ivvb_cdi_thirds": ((("book", "qdl", 1 / 3), ("fund", "foreign", 1 / 3), ("cash", "cash", 1 / 3)), "QE", False),
    "qdl_equity_ivvb_cdi_thirds": ((("book", "qdl_equity", 1 / 3), ("fund", "foreign", 1 / 3), ("cash", "cash", 1 / 3)), "QE", False),
}


def levels(spark, sf, rule: str) -> DataFrame:
    """(i, date, ticker, root, px, adtv, vol): period-end close, mean daily turnover and annual volatility, none where the last twelve periods hold a jump."""
    d = ewm(specs.days(spark, sf).withColumn("sq", F.col("ret") * F.col("ret")), "sq", SPAN)
    m = d.groupBy("ticker", grid.period_end("date", rule).alias("date")).agg(
        F.max_by("close", "date").alias("px"), half_up(F.avg("volume"), 4).alias("adtv"), half_up(F.sqrt(F.max_by("sq_ewm_mean", "date") * PER_YEAR), 9).alias("raw")
    )
    t = c.by_time()
    m = m.withColumns({"i": F.row_number().over(t) - 1, "ret": half_up(c.pct_change("px", 1, t), 9)})
    jump = F.coalesce(((F.col("ret") > 1.0) | (F.col("ret") < -0.45)).cast("double"), F.lit(0.0))
    m = m.withColumn("glitch", c.rolling(F.max, jump, 12, t))
    return m.join(a.roots(spark, sf), "ticker").select("i", "date", "ticker", "root", "px", "adtv", F.when(F.coalesce("glitch", F.lit(0.0)) != 1, F.col("raw")).alias("vol"))


def liquid(m: DataFrame) -> DataFrame:
    """(i, date, seen, ticker, root, vol): names that a book of ``date`` may hold, as they stood one period before, from the third period on."""
    t = Window.partitionBy("ticker").orderBy("i")
    before = m.select("i", "date", "ticker", "root", *(F.lag(x).over(t).alias(y) for x, y in (("date", "seen"), ("px", "px"), ("adtv", "adtv"), ("vol", "vol"))))
    return before.filter((F.col("i") >= 2) & (F.col("adtv") >= specs.MIN_ADTV) & (F.col("px") >= specs.MIN_PRICE) & (F.col("vol") > 0)).select("i", "date", "seen", "ticker", "root", "vol")


def regular(names: DataFrame, paid: DataFrame, years: int = 2) -> DataFrame:
    """``names`` of companies that paid in at least ``years`` of the three years up to ``seen``.  ``paid``: (root, ex_date).

    A year counts if the last payment by its end falls into it, so an as-of look-up for each of three edges decides.
    """
    edges = names.select("root", "seen").distinct().select("root", "seen", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.add_months("seen", -12 * k).alias("edge")) for k in range(3)))).alias("e")).select("root", "seen", "e.k", "e.edge")
    found = grid.as_of(edges, paid.select("root", "ex_date", F.col("ex_date").alias("paid")), "root", "edge", "ex_date", ["paid"])
    hits = found.groupBy("root", "seen").agg(F.count_if(F.col("paid") > F.add_months("seen", -12 * (F.col("k") + 1))).alias("years"))
    return names.join(hits.filter(F.col("years") >= years).select("root", "seen"), ["root", "seen"], "left_semi")


def sound(names: DataFrame, known: DataFrame) -> DataFrame:
    """``names`` of companies with positive income and equity as known at ``seen``.  ``known``: (root, date, net_income, equity)."""
    return names.join(known.filter("net_income > 0 and equity > 0").select("root", F.col("date").alias("seen")), ["root", "seen"], "left_semi")


def exposure(book: DataFrame, days: DataFrame, target: float, n: int = WINDOW) -> DataFrame:
    """(date, share): target over the annual volatility that the book of ``date`` (date, seen, ticker, weight) would have had over the last ``n`` days up to ``seen``, at most one.

    ``days``: (ticker, k, date, ret), k numbering the calendar.  Books reach back into a few months, so book and day meet on (ticker, month) and
    then the days are counted back from the last one.
    """
    last = days.select("date", "k").distinct()
    ends = grid_as_of(book.select("seen").distinct(), last)
    months = F.sequence(F.add_months(F.trunc("seen", "month"), -(n // 15)), F.trunc("seen", "month"), F.expr("interval 1 month"))
    wanted = book.join(ends, "seen").select("date", "ticker", "weight", "last", F.explode(months).alias("month"))
    met = wanted.join(days.select("ticker", "k", "ret", F.trunc("date", "month").alias("month")), ["ticker", "month"]).filter((F.col("k") <= F.col("last")) & (F.col("k") > F.col("last") - n))
    daily = met.groupBy("date", "k").agg(half_up(F.sum(F.col("weight") * F.coalesce("ret", F.lit(0.0))), 12).alias("ret"))
    vol = daily.groupBy("date").agg((F.stddev_samp("ret") * F.sqrt(F.lit(float(PER_YEAR)))).alias("vol"))
    return vol.select("date", F.when(F.col("vol") > 0, F.least(F.lit(target) / F.col("vol"), F.lit(1.0))).otherwise(1.0).alias("share"))


def grid_as_of(dates: DataFrame, days: DataFrame) -> DataFrame:
    """(seen, last): the number of the last day by each date; both sides have one row a date."""
    return grid.as_of(dates.withColumn("one", F.lit(1)), days.select(F.lit(1).alias("one"), "date", F.col("k").alias("last")), "one", "seen", "date", ["last"]).select("seen", "last")


def sleeve(spark, sf, rule: str) -> tuple[DataFrame, DataFrame]:
    """(book, thin): the quality-dividend low-volatility sleeve (date, seen, ticker, weight), and the dates on which fewer than five names pass."""
    m = levels(spark, sf, rule)
    paid = a.cash_events(spark, sf).filter("value > 0").join(a.roots(spark, sf), "ticker").select("root", "ex_date").distinct()
    f = a.filings(spark, sf).withColumn("root", (F.col("company") % 25).cast("int"))
    known = fu.known_on(specs.root_months(spark, sf), f, ["net_income", "equity"], key="root")
    names = sound(regular(liquid(m), paid), known).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("date")))
    best = names.filter(F.col("n") >= LEAST).withColumn("place", F.row_number().over(Window.partitionBy("date").orderBy("vol", "ticker"))).filter(F.col("place") <= TOP_N)
    book = portfolio.capped_weights(best.withColumn("calm", 1 / F.col("vol")), "calm", CAP).select("date", "seen", "ticker", "weight")
    dates = specs.flags(spark, sf).select(grid.period_end("date", rule).alias("date")).distinct()
    third = dates.withColumn("i", F.row_number().over(Window.orderBy("date")) - 1).filter("i >= 2").select("date")  # one row a period
    return book, third.join(book.select("date").distinct(), "date", "left_anti")


def qdl(spark, sf, rule: str = "QE", target: float | None = TARGET) -> DataFrame:
    """(date, asset, weight): the sleeve, scaled so that its own recent volatility meets the target, the rest in cash; without a target always whole."""
    book, thin = sleeve(spark, sf, rule)
    parked = thin.select("date", F.lit("cash").alias("asset"), F.lit(1.0).alias("weight"))
    asset = F.col("ticker").cast("string").alias("asset")
    if target is None:
        return book.select("date", asset, "weight").union(parked)
    d = specs.days(spark, sf)
    days = d.select("ticker", "date", "ret", F.row_number().over(c.by_time()).alias("k"))  # dense: a day has one number for all tickers
    share = exposure(book, days, target)
    scaled = book.join(share, "date").select("date", asset, (F.col("weight") * F.col("share")).alias("weight"))
    return scaled.union(share.select("date", F.lit("cash"), 1 - F.col("share"))).union(parked)


def low_vol_index(spark, sf) -> DataFrame:
    """(date, asset, weight): the calmest third of liquid names at month ends, in inverse proportion to volatility, ten per cent at most."""
    names = liquid(levels(spark, sf, "ME")).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("date")))
    ranked = names.filter(F.col("n") >= LEAST).withColumn("place", F.row_number().over(Window.partitionBy("date").orderBy("vol", "ticker")))
    held = ranked.filter(F.col("place") <= F.greatest(F.lit(LEAST), F.floor(F.col("n") * BOTTOM).cast("int")))
    return portfolio.capped_weights(held.withColumn("calm", 1 / F.col("vol")), "calm", CAP).select("date", F.col("ticker").cast("string").alias("asset"), "weight")


def prices(spark, sf, rule: str) -> DataFrame:
    """(date, fund, px): each fund's last price by each period end, NULL before it lists.  A few rows a period."""
    items = a.table(spark, sf, "lineitem").filter("l_quantity > 0")
    period = grid.period_end(F.to_date("l_shipdate"), rule).alias("date")
    out = None
    for fund, (which, listed) in FUNDS.items():
        day = items.filter(F.expr(which) & (F.col("l_shipdate") >= F.lit(listed).cast("date"))).groupBy(F.to_date("l_shipdate").alias("day")).agg((a.money() / F.sum("l_quantity")).alias("px"))
        last = day.groupBy(grid.period_end("day", rule).alias("date")).agg(F.max_by("px", "day").alias("px")).withColumn("fund", F.lit(fund))
        out = last if out is None else out.union(last)
    every = items.select(period).distinct().crossJoin(F.broadcast(spark.createDataFrame([(f,) for f in FUNDS], "fund string")))  # three funds
    return every.join(out, ["date", "fund"], "left").select("date", "fund", F.last("px", ignorenulls=True).over(c.history(c.by_time("fund"))).alias("px"))


TILTED, SMA, MOST, FLOOR, TILT = ("dividend", "foreign"), 200, 0.60, 0.10, 3.0  # fixed values of the trend tilts


def fund_days(spark, sf) -> DataFrame:
    """(fund, day, px) of the tilted funds."""
    items = a.table(spark, sf, "lineitem").filter("l_quantity > 0")
    out = None
    for fund in TILTED:
        which, listed = FUNDS[fund]
        day = items.filter(F.expr(which) & (F.col("l_shipdate") >= F.lit(listed).cast("date"))).groupBy(F.to_date("l_shipdate").alias("day")).agg(half_up(a.money() / F.sum("l_quantity")).alias("px")).withColumn("fund", F.lit(fund))
        out = day if out is None else out.union(day)
    return out


def distances(spark, sf) -> DataFrame:
    """(date, sleeve, dist): each tilted fund's distance from its 200-day mean at the month end before; NULL until there is one."""
    r = Rolling(fund_days(spark, sf), {"px": F.col("px")}, exact=["px"], key="fund", time="day")
    daily = r.select("fund", "day", (c.ratio("px", r.mean("px", SMA)) - 1).alias("dist"))
    last = daily.groupBy("fund", F.last_day("day").alias("date")).agg(half_up(F.max_by("dist", F.when(F.col("dist").isNotNull(), F.col("day"))), 9).alias("dist"))
    months = specs.flags(spark, sf).select("date").crossJoin(F.broadcast(spark.createDataFrame([(f,) for f in TILTED], "fund string")))  # two funds
    known = months.join(last, ["date", "fund"], "left").withColumn("dist", F.last("dist", ignorenulls=True).over(c.history(c.by_time("fund"))))
    return known.select("date", F.col("fund").alias("sleeve"), F.lag("dist").over(c.by_time("fund")).alias("dist"))


def tilt(spark, sf, absorb: bool) -> DataFrame:
    """(date, asset, weight).  ``absorb``: funds by their distance above the mean, cash by the distances below it, at most 0.6 each; else equal parts with cash,
    tilted by three times the distance, at least 0.1 each.  Without any fund that has a mean all is cash."""
    d = distances(spark, sf)
    live = d.filter("dist is not null")
    if absorb:
        own = live.select("date", "sleeve", F.greatest(F.col("dist"), F.lit(0.0)).alias("weight"))
        cash = live.groupBy("date").agg(F.sum(F.greatest(-F.col("dist"), F.lit(0.0))).alias("weight"))
        scores = own.union(cash.select("date", F.lit("cash"), "weight"))
        scores = scores.withColumn("all", F.sum("weight").over(Window.partitionBy("date"))).filter(F.col("all") > 0).drop("all")
        out = portfolio.bounded_weights(scores, 0.0, MOST)
    else:
        base = 1.0 / (F.count(F.lit(1)).over(Window.partitionBy("date")) + 1)
        own = live.select("date", "sleeve", F.greatest(base + TILT * F.col("dist"), F.lit(0.0)).alias("weight"))
        cash = live.groupBy("date").agg((1.0 / (F.count(F.lit(1)) + 1)).alias("weight"))
        scores = own.union(cash.select("date", F.lit("cash"), "weight")).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("date")))
        two, three = (portfolio.bounded_weights(scores.filter(F.col("n") == n).drop("n"), FLOOR, 1 - (n - 1) * FLOOR) for n in (2, 3))
        out = two.union(three)
    idle = d.select("date").distinct().join(out.select("date").distinct(), "date", "left_anti").select("date", F.lit("cash"), F.lit(1.0))
    return out.select("date", F.col("sleeve").alias("asset"), "weight").union(idle).filter("weight > 1e-12")


NESTED = {
    "qdl": lambda spark, sf, rule: qdl(spark, sf, rule),
    "qdl_equity": lambda spark, sf, rule: qdl(spark, sf, rule, None),
}


def blend(spark, sf, name: str) -> DataFrame:
    """(date, asset, weight): funds not yet listed are parked in cash, each alone or all together; what nested books leave free goes to cash."""
    sleeves, rule, together = BLENDS[name]
    table = spark.createDataFrame([(what, w) for kind, what, w in sleeves if kind == "fund"], "fund string, weight double")
    funds = prices(spark, sf, rule).join(F.broadcast(table), "fund")
    if together:  # from the first period in which all funds have moved
        w = c.by_time("fund")
        moved = funds.withColumn("moved", c.flag(c.ratio("px", F.lag("px").over(w)) != 1)).groupBy("date").agg(F.min("moved").alias("moved"))
        live = moved.select("date", (F.max("moved").over(Window.orderBy("date")) == 1).alias("live"))  # one row a period
    else:
        live = funds.select("date").distinct().withColumn("live", F.lit(True))
    held = funds.join(live, "date").filter("live and px is not null").select("date", F.col("fund").alias("asset"), "weight")
    for kind, what, weight in sleeves:
        if kind == "book":
            held = held.union(NESTED[what](spark, sf, rule).select("date", "asset", F.col("weight") * weight))
    every = live.select("date", F.lit("cash").alias("asset"), F.lit(0.0).alias("weight"))
    filled = held.union(every)
    cash = filled.groupBy("date").agg(F.greatest(1 - F.sum("weight"), F.lit(0.0)).alias("weight")).select("date", F.lit("cash").alias("asset"), "weight")
    return held.union(cash).groupBy("date", "asset").agg(F.sum("weight").alias("weight")).filter("weight > 1e-12")


# ---- the same in SQL

PERIOD = {"ME": "last_day({})", "QE": "last_day(CAST(date_trunc('quarter', {}) + INTERVAL 2 MONTH AS DATE))"}
PRICED = specs.MONTHS[: specs.MONTHS.index("d1 AS")].rstrip().rstrip(",")


def capped_sql(source: str, x: str, cap: float, out: str) -> str:
    """CTEs that end in ``out``: the rows of ``source`` (date, ticker, ...) with weight."""
    return f"""{out}_w AS (SELECT *, {x} / sum({x}) OVER (PARTITION BY date) AS w FROM {source}),
{out}_o AS (SELECT *, row_number() OVER d - 1 AS k, coalesce(sum(w) OVER (PARTITION BY date ORDER BY w DESC, ticker ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM {out}_w WINDOW d AS (PARTITION BY date ORDER BY w DESC, ticker)),
{out}_f AS (SELECT *, (1 - k * {cap}) / nullif(1 - b, 0) AS scale FROM {out}_o),
{out}_m AS (SELECT *, min(CASE WHEN w * scale <= {cap} * (1 + 1e-12) AND scale >= 0 THEN k END) OVER (PARTITION BY date) AS first FROM {out}_f),
{out} AS (SELECT * EXCLUDE (w, k, b, scale, first), CASE WHEN first IS NULL OR k < first THEN {cap} ELSE w * max(CASE WHEN k = first THEN scale END) OVER (PARTITION BY date) END AS weight FROM {out}_m)"""


def levels_sql(rule: str) -> str:
    return f"""l0 AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) AS k, ret * ret AS sq FROM priced),
l1 AS (SELECT *, CASE WHEN count(sq) OVER h >= {SPAN} THEN sum(sq * pow({SPAN + 1}.0 / {SPAN - 1}.0, k)) OVER h / sum(CASE WHEN sq IS NOT NULL THEN pow({SPAN + 1}.0 / {SPAN - 1}.0, k) END) OVER h END AS ew
  FROM l0 WINDOW h AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
l2 AS (SELECT ticker, {PERIOD[rule].format('date')} AS date, arg_max_null(close, date) AS px, round(avg(volume), 4) AS adtv, round(sqrt(arg_max_null(ew, date) * {PER_YEAR}), 9) AS raw FROM l1 GROUP BY 1, 2),
l3 AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) - 1 AS i, round(px / {lag('px')} - 1, 9) AS ret FROM l2),
l4 AS (SELECT *, CASE WHEN ret > 1 OR ret < -0.45 THEN 1.0 ELSE 0.0 END AS jump FROM l3),
l5 AS (SELECT *, {roll('max', 'jump', 12)} AS glitch FROM l4),
l6 AS (SELECT i, date, ticker, s_nationkey AS root, {lag('date')} AS seen, {lag('px')} AS px, {lag('adtv')} AS adtv, {lag('CASE WHEN coalesce(glitch, 0) <> 1 THEN raw END')} AS vol FROM l5 JOIN supplier ON s_suppkey = ticker),
liquid AS (SELECT i, date, seen, ticker, root, vol FROM l6 WHERE i >= 2 AND adtv >= {specs.MIN_ADTV} AND px >= {specs.MIN_PRICE} AND vol > 0)"""


KNOWN = """rf AS (SELECT company % 25 AS root, filing_date, arg_max(net_income, (version, filing_id)) FILTER (WHERE net_income IS NOT NULL) AS ni, arg_max(equity, (version, filing_id)) FILTER (WHERE equity IS NOT NULL) AS eq,
  arg_max(shares, (version, filing_id)) FILTER (WHERE shares IS NOT NULL) AS sh FROM filings GROUP BY 1, 2),
kd AS (SELECT DISTINCT s_nationkey AS root, last_day(date) AS date FROM supplier, (SELECT DISTINCT date FROM bars)),
k1 AS (SELECT kd.root, kd.date, CASE WHEN kd.date - r.filing_date <= 400 THEN r.ni END AS ni FROM kd ASOF LEFT JOIN (SELECT * FROM rf WHERE ni IS NOT NULL) r ON r.root = kd.root AND kd.date >= r.filing_date),
k2 AS (SELECT kd.root, kd.date, CASE WHEN kd.date - r.filing_date <= 400 THEN r.eq END AS eq FROM kd ASOF LEFT JOIN (SELECT * FROM rf WHERE eq IS NOT NULL) r ON r.root = kd.root AND kd.date >= r.filing_date),
k3 AS (SELECT kd.root, kd.date, CASE WHEN kd.date - r.filing_date <= 400 THEN r.sh END AS sh FROM kd ASOF LEFT JOIN (SELECT * FROM rf WHERE sh IS NOT NULL) r ON r.root = kd.root AND kd.date >= r.filing_date)"""


def regular_sql(names: str, out: str, years: int = 2) -> str:
    return f"""{out}_p AS (SELECT DISTINCT s_nationkey AS root, ex_date FROM cash JOIN supplier ON s_suppkey = ticker WHERE value > 0),
{out}_h AS (SELECT n.root, n.seen, count(DISTINCT CASE WHEN ex_date > n.seen - INTERVAL 12 MONTH THEN 0 WHEN ex_date > n.seen - INTERVAL 24 MONTH THEN 1 ELSE 2 END) AS years
  FROM (SELECT DISTINCT root, seen FROM {names}) n JOIN {out}_p p ON p.root = n.root AND p.ex_date <= n.seen AND p.ex_date > n.seen - INTERVAL 36 MONTH GROUP BY 1, 2),
{out} AS (SELECT n.* FROM {names} n JOIN {out}_h h ON h.root = n.root AND h.seen = n.seen WHERE h.years >= {years})"""


def qdl_sql(rule: str, target: float | None) -> str:
    """CTEs that end in ``qdl`` (date, asset, weight)."""
    scaled = f"""lastday AS (SELECT seen, max(k) AS last FROM (SELECT DISTINCT seen FROM sleeve) s JOIN (SELECT DISTINCT k, date FROM l0) d ON d.date <= s.seen GROUP BY 1),
window_days AS (SELECT s.date, d.k, round(sum(s.weight * coalesce(d.ret, 0)), 12) AS ret FROM sleeve s JOIN lastday e ON e.seen = s.seen JOIN l0 d ON d.ticker = s.ticker AND d.k <= e.last AND d.k > e.last - {WINDOW} GROUP BY 1, 2),
share AS (SELECT date, CASE WHEN stddev_samp(ret) > 0 THEN least({target} / (stddev_samp(ret) * sqrt({PER_YEAR})), 1.0) ELSE 1.0 END AS share FROM window_days GROUP BY 1),
full_book AS (SELECT s.date, CAST(ticker AS VARCHAR) AS asset, weight * share AS weight FROM sleeve s JOIN share USING (date) UNION ALL SELECT date, 'cash', 1 - share FROM share)"""
    whole = "full_book AS (SELECT date, CAST(ticker AS VARCHAR) AS asset, weight FROM sleeve)"
    return f"""{CASH}, {levels_sql(rule)}, {KNOWN}, {regular_sql('liquid', 'payers')},
passed AS (SELECT p.*, count(*) OVER (PARTITION BY p.date) AS n FROM payers p JOIN k1 ON k1.root = p.root AND k1.date = p.seen AND k1.ni > 0 JOIN k2 ON k2.root = p.root AND k2.date = p.seen AND k2.eq > 0),
best AS (SELECT *, 1 / vol AS calm FROM passed WHERE n >= {LEAST} QUALIFY row_number() OVER (PARTITION BY date ORDER BY vol, ticker) <= {TOP_N}),
{capped_sql('best', 'calm', CAP, 'sleeve')}, {scaled if target else whole},
qdl AS (SELECT * FROM full_book UNION ALL SELECT date, 'cash', 1.0 FROM (SELECT DISTINCT i, date FROM l6) WHERE i >= 2 AND date NOT IN (SELECT date FROM sleeve))"""


BOOK_SQL = {"qdl": (lambda rule: qdl_sql(rule, TARGET), "qdl"), "qdl_equity": (lambda rule: qdl_sql(rule, None), "qdl")}  # name to (CTEs, the one that is the book)


def blend_sql(name: str) -> str:
    sleeves, rule, together = BLENDS[name]
    nested = [what for kind, what, _ in sleeves if kind == "book"]
    own = f", {BOOK_SQL[nested[0]][0](rule)}" if nested else ""
    day = " UNION ALL ".join(
        f"SELECT '{f}' AS fund, CAST(l_shipdate AS DATE) AS day, CAST(sum(CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT)) AS DOUBLE) / 100 / sum(l_quantity) AS px FROM lineitem WHERE l_quantity > 0 AND {which} AND l_shipdate >= DATE '{listed}' GROUP BY 1, 2"
        for f, (which, listed) in FUNDS.items()
    )
    table = ", ".join(f"('{what}', {w!r})" for kind, what, w in sleeves if kind == "fund")
    live = "SELECT date, max(m) OVER (ORDER BY date) AS live FROM (SELECT date, min(moved) AS m FROM fpx GROUP BY 1)" if together else "SELECT DISTINCT date, 1 AS live FROM fpx"
    books = "".join(f" UNION ALL SELECT date, asset, weight * {w!r} FROM {BOOK_SQL[what][1]}" for kind, what, w in sleeves if kind == "book")
    return f"""WITH {PRICED}{own}, fday AS ({day}), flast AS (SELECT fund, {PERIOD[rule].format('day')} AS date, arg_max(px, day) AS px FROM fday GROUP BY 1, 2),
fgrid AS (SELECT date, fund, target FROM (SELECT DISTINCT {PERIOD[rule].format('date')} AS date FROM bars), (VALUES {table}) t(fund, target)),
ffill AS (SELECT g.*, last_value(px IGNORE NULLS) OVER (PARTITION BY g.fund ORDER BY g.date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS px FROM fgrid g LEFT JOIN flast l ON l.fund = g.fund AND l.date = g.date),
fpx AS (SELECT *, CASE WHEN px / lag(px) OVER (PARTITION BY fund ORDER BY date) <> 1 THEN 1 ELSE 0 END AS moved FROM ffill),
flive AS ({live}), parts AS (SELECT fpx.date, fund AS asset, target AS weight FROM fpx JOIN flive USING (date) WHERE live = 1 AND px IS NOT NULL{books}),
cashed AS (SELECT * FROM parts UNION ALL SELECT d.date, 'cash', greatest(1 - coalesce(sum(weight), 0), 0) FROM flive d LEFT JOIN parts p ON p.date = d.date GROUP BY 1)
SELECT date, asset, round(sum(weight), 6) AS weight FROM cashed GROUP BY 1, 2 HAVING sum(weight) > 1e-12"""


def rounded_book(book: DataFrame) -> DataFrame:
    return book.select("date", "asset", half_up("weight").alias("weight"))


for _name in BLENDS:
    query(f"portfolio_{_name}", blend_sql(_name))(lambda spark, sf, n=_name: rounded_book(blend(spark, sf, n)))


@query("portfolio_qdl", f"WITH {PRICED}, {qdl_sql('QE', TARGET)} SELECT date, asset, round(weight, 6) AS weight FROM qdl")
def portfolio_qdl(spark, sf):
    return rounded_book(qdl(spark, sf))


@query("portfolio_qdl_equity", f"WITH {PRICED}, {qdl_sql('QE', None)} SELECT date, asset, round(weight, 6) AS weight FROM qdl")
def portfolio_qdl_equity(spark, sf):
    return rounded_book(qdl(spark, sf, target=None))


@query("portfolio_low_vol_index", f"""WITH {PRICED}, {levels_sql('ME')}, counted AS (SELECT *, 1 / vol AS calm, count(*) OVER (PARTITION BY date) AS n, row_number() OVER (PARTITION BY date ORDER BY vol, ticker) AS place FROM liquid),
calmest AS (SELECT * FROM counted WHERE n >= {LEAST} AND place <= greatest({LEAST}, CAST(floor(n * {BOTTOM}) AS INTEGER))), {capped_sql('calmest', 'calm', CAP, 'book')}
SELECT date, CAST(ticker AS VARCHAR) AS asset, round(weight, 6) AS weight FROM book""")
def portfolio_low_vol_index(spark, sf):
    return rounded_book(low_vol_index(spark, sf))


def bounded_sql(source: str, lo: str, hi: str, out: str) -> str:
    """CTEs that end in ``out`` (date, sleeve, weight): ``source`` (date, sleeve, w, n) between the bounds, the level found among all breakpoints."""
    return f"""{out}_x AS (SELECT date, sleeve, n, CASE WHEN sum(w) OVER (PARTITION BY date) > 0 THEN w ELSE 1.0 END AS w, least({lo}, 1.0 / n) AS lo, greatest({hi}, 1.0 / n) AS hi FROM {source}),
{out}_e AS (SELECT date, lo / w AS edge FROM {out}_x WHERE w > 0 UNION SELECT date, hi / w FROM {out}_x WHERE w > 0),
{out}_g AS (SELECT e.date, e.edge, sum(greatest(least(x.w * e.edge, x.hi), x.lo)) AS total, sum(CASE WHEN x.w > 0 AND x.lo / x.w <= e.edge AND e.edge < x.hi / x.w THEN x.w ELSE 0 END) AS slope FROM {out}_e e JOIN {out}_x x ON x.date = e.date GROUP BY 1, 2),
{out}_l AS (SELECT date, arg_max(edge + CASE WHEN slope > 1e-12 THEN (1 - total) / slope ELSE 0 END, edge) AS level FROM {out}_g WHERE total <= 1 + 1e-12 GROUP BY 1),
{out}_y AS (SELECT x.*, greatest(least(w * level, hi), lo) AS weight FROM {out}_x x JOIN {out}_l USING (date)),
{out} AS (SELECT date, sleeve, CASE WHEN w = 0 THEN least(weight + greatest((1 - sum(weight) OVER d) / sum(CASE WHEN w = 0 THEN 1 ELSE 0 END) OVER d, 0), hi) ELSE weight END AS weight FROM {out}_y WINDOW d AS (PARTITION BY date))"""


def tilt_sql(absorb: bool) -> str:
    day = " UNION ALL ".join(
        f"SELECT '{f}' AS ticker, CAST(l_shipdate AS DATE) AS date, round(CAST(sum(CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT)) AS DOUBLE) / 100 / sum(l_quantity), 6) AS px FROM lineitem WHERE l_quantity > 0 AND {FUNDS[f][0]} AND l_shipdate >= DATE '{FUNDS[f][1]}' GROUP BY 1, 2"
        for f in TILTED
    )
    own = "greatest(dist, 0)" if absorb else f"greatest(1.0 / (count(*) OVER (PARTITION BY date) + 1) + {TILT} * dist, 0)"
    cash = "sum(greatest(-dist, 0))" if absorb else "1.0 / (count(*) + 1)"
    bounds = ("0", str(MOST)) if absorb else (str(FLOOR), f"1 - (n - 1) * {FLOOR}")
    return f"""WITH td AS ({day}), ts AS (SELECT *, px / {roll('avg', 'px', SMA)} - 1 AS dist FROM td),
tl AS (SELECT ticker, last_day(date) AS date, round(arg_max(dist, date) FILTER (WHERE dist IS NOT NULL), 9) AS dist FROM ts GROUP BY 1, 2),
tm AS (SELECT DISTINCT last_day(CAST(l_shipdate AS DATE)) AS date FROM lineitem WHERE l_quantity > 0),
tg AS (SELECT m.date, f.ticker, last_value(dist IGNORE NULLS) OVER (PARTITION BY f.ticker ORDER BY m.date) AS dist FROM tm m CROSS JOIN (VALUES {', '.join(f"('{f}')" for f in TILTED)}) f(ticker) LEFT JOIN tl ON tl.ticker = f.ticker AND tl.date = m.date),
live AS (SELECT date, ticker, dist FROM (SELECT date, ticker, {lag('dist')} AS dist FROM tg) WHERE dist IS NOT NULL),
sc AS (SELECT date, ticker AS sleeve, {own} AS w FROM live UNION ALL SELECT date, 'cash', {cash} FROM live GROUP BY 1),
sn AS (SELECT *, count(*) OVER (PARTITION BY date) AS n FROM sc QUALIFY sum(w) OVER (PARTITION BY date) > 0), {bounded_sql('sn', *bounds, 'tb')}
SELECT date, sleeve AS asset, round(weight, 6) AS weight FROM tb WHERE weight > 1e-12 UNION ALL SELECT date, 'cash', 1.0 FROM tm WHERE date NOT IN (SELECT date FROM tb)"""


@query("portfolio_tilt_absorb", tilt_sql(True))
def portfolio_tilt_absorb(spark, sf):
    return rounded_book(tilt(spark, sf, True))


@query("portfolio_tilt_floor", tilt_sql(False))
def portfolio_tilt_floor(spark, sf):
    return rounded_book(tilt(spark, sf, False))


@query("bounded_sleeves", f"""WITH {SLEEVES}, bv AS (SELECT date, sleeve, nullif(CASE WHEN count(ret) OVER w >= 2 THEN stddev_samp(ret) OVER w END, 0) AS vol FROM sleeves WHERE sleeve <> 'cash' WINDOW w AS (PARTITION BY sleeve ORDER BY date ROWS BETWEEN 36 PRECEDING AND 1 PRECEDING)),
bf AS (SELECT date, sleeve, coalesce(vol, avg(vol) OVER (PARTITION BY date)) AS vol FROM bv), bn AS (SELECT date, sleeve, 1 / vol AS w, count(*) OVER (PARTITION BY date) AS n FROM bf WHERE vol IS NOT NULL), {bounded_sql('bn', '0.2', '0.5', 'bs')}
SELECT date, sleeve, round(weight, 6) AS weight FROM bs""")
def bounded_sleeves(spark, sf):
    """Inverse-volatility sleeves, none under a fifth or over a half."""
    own = portfolio.inverse_vol_sleeves(sleeve_returns(spark, sf).filter("sleeve <> 'cash'"))
    return portfolio.bounded_weights(own, 0.2, 0.5).select("date", "sleeve", half_up("weight").alias("weight"))
