"""Dividend portfolios of chosen sectors: quality payers by market value, and real assets by market value and dividend score."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as c
from ..operators import fundamentals as fu
from ..operators import grid, index, portfolio
from . import adapters as a
from . import composed_queries, registry, sleeve_queries
from . import index_queries as ix
from . import spec_queries as specs
from .oracle import CASH, FILINGS, PANEL, lag
from .registry import half_up, query
from .sleeve_queries import KNOWN, blend, blend_sql, capped_sql, regular, regular_sql, rounded_book

# Caps per name, floors.  Stand-ins: every second company belongs to the quality sectors; filings name the sectors of the other portfolio.
QUALITY_CAP, QUALITY_LEAST, ISSUER_CAP, LOWEST, SECTORS = 0.08, 8, 0.10, 0.25, ["Urgent", "High"]


def payments(spark, sf) -> DataFrame:
    """(root, ex_date) of every payment."""
    return a.cash_events(spark, sf).filter("value > 0").join(a.roots(spark, sf), "ticker").select("root", "ex_date").distinct()


def quality(spark, sf) -> DataFrame:
    """(date, asset, weight): companies of the quality sectors that earn and pay regularly, by market value, eight per cent at most."""
    panel = a.panel(spark, sf).select("date", "ticker", half_up("close").alias("close"), "volume")
    quotes = index.at_rebalances(panel, lambda d: grid.period_end(d, "QE"), ix.WINDOW)
    passed = index.constituents(quotes, ix.classes(spark, sf), ix.filings(spark, sf), a.share_events(spark, sf), 0.0, ix.MIN_VOLUME).filter("root % 2 = 0")
    payers = regular(passed.withColumn("seen", F.col("date")), payments(spark, sf))
    held = index.started(payers, QUALITY_LEAST)
    return portfolio.capped_weights(held, "market_cap", QUALITY_CAP, renormalise=True).select("date", F.col("ticker").cast("string").alias("asset"), "weight")


QUALITY = f"""{ix.CONSTITUENTS}, {CASH}, qs AS (SELECT *, date AS seen FROM iv WHERE median_volume >= market_cap * 1e-5 AND market_cap > 0 AND root % 2 = 0), {regular_sql('qs', 'qp')},
qh AS (SELECT * FROM qp WHERE date >= (SELECT min(date) FROM (SELECT date FROM qp GROUP BY 1 HAVING count(*) >= {QUALITY_LEAST}))), {capped_sql('qh', 'market_cap', QUALITY_CAP, 'qb')}"""


@query("portfolio_besst", f"WITH {QUALITY} SELECT date, CAST(ticker AS VARCHAR) AS asset, round(weight / sum(weight) OVER (PARTITION BY date), 6) AS weight FROM qb")
def portfolio_besst(spark, sf):
    return rounded_book(quality(spark, sf))


def real_assets(spark, sf, rule: str = "QE") -> DataFrame:
    """(date, asset, weight): names whose company belongs to the sectors as last filed, above the lowest quarter by dividend score, half by market value and half by score.

    All as it stood one period before; ten per cent at most.
    """
    w = c.by_time()
    levels = a.panel(spark, sf).groupBy("ticker", grid.period_end("date", rule).alias("date")).agg(half_up(F.max_by("close", "date")).alias("px"), half_up(F.avg("volume"), 4).alias("adtv")).join(a.roots(spark, sf), "ticker")
    score = composed_queries.dividend_score(spark, sf).select("ticker", F.col("period").alias("date"), "score")
    f = a.filings(spark, sf).withColumn("root", (F.col("company") % 25).cast("int"))
    shares = fu.known_on(specs.root_months(spark, sf), f, ["shares"], key="root")
    history = a.table(spark, sf, "orders").groupBy((F.col("o_custkey") % 25).cast("int").alias("root"), F.to_date("o_orderdate").alias("ref_date")).agg(F.max("o_orderpriority").alias("sector"))
    member = fu.member_as_of(shares.select("root", "date"), history, SECTORS, key="root")
    now = levels.join(score, ["ticker", "date"], "left").join(shares, ["root", "date"], "left").join(member, ["root", "date"], "left")
    now = now.select("date", "ticker", "adtv", "score", "member", half_up(F.col("px") * F.col("shares"), 2).alias("cap"))
    seen = now.select("date", "ticker", *(F.lag(x).over(w).alias(x) for x in ("adtv", "score", "member", "cap")))
    names = seen.filter((F.col("score") > 0) & F.col("member") & (F.col("cap") > ix.MIN_CAP) & (F.col("adtv") >= ix.MIN_VOLUME)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("date"))).filter("n >= 2")
    kept = names.withColumn("cut", c.quantile("score", LOWEST, ["date"])).filter("score >= cut")
    both = kept.select("date", "ticker", portfolio.blend(c.share("cap", ["date"]), c.share("score", ["date"])).alias("mix"))
    return portfolio.capped_weights(both, "mix", ISSUER_CAP).select("date", F.col("ticker").cast("string").alias("asset"), "weight")


def real_assets_sql(rule: str) -> str:
    """CTEs that end in ``real_assets`` (date, asset, weight); they need panel, filings and bars."""
    period = sleeve_queries.PERIOD[rule].format("date")
    return f"""{KNOWN}, ra_s AS ({registry.ORACLE['dividend_score']}),
ra_l AS (SELECT ticker, {period} AS date, round(arg_max_null(close, date), 6) AS px, round(avg(volume), 4) AS adtv FROM panel GROUP BY 1, 2),
ra_h AS (SELECT o_custkey % 25 AS root, CAST(o_orderdate AS DATE) AS ref_date, max(o_orderpriority) AS sector FROM orders GROUP BY 1, 2),
ra_m AS (SELECT k.root, k.date, coalesce(regexp_matches(h.sector, '(?i)urgent|high'), false) AS member FROM kd k ASOF LEFT JOIN ra_h h ON h.root = k.root AND k.date >= h.ref_date),
ra_n AS (SELECT l.date, l.ticker, adtv, score, member, round(px * sh, 2) AS cap FROM ra_l l JOIN supplier ON s_suppkey = l.ticker LEFT JOIN ra_s s ON s.ticker = l.ticker AND s.period = l.date LEFT JOIN k3 ON k3.root = s_nationkey AND k3.date = l.date LEFT JOIN ra_m m ON m.root = s_nationkey AND m.date = l.date),
ra_p AS (SELECT date, ticker, {", ".join(f"{lag(x)} AS {x}" for x in ("adtv", "score", "member", "cap"))} FROM ra_n),
ra_f AS (SELECT *, count(*) OVER (PARTITION BY date) AS n FROM ra_p WHERE score > 0 AND member AND cap > {ix.MIN_CAP} AND adtv >= {ix.MIN_VOLUME}),
ra_q AS (SELECT *, quantile_cont(score, {LOWEST}) OVER (PARTITION BY date) AS cut FROM ra_f WHERE n >= 2),
ra_b AS (SELECT date, ticker, 0.5 * cap / sum(cap) OVER (PARTITION BY date) + 0.5 * score / sum(score) OVER (PARTITION BY date) AS mix FROM ra_q WHERE score >= cut), {capped_sql('ra_b', 'mix', ISSUER_CAP, 'ra_w')},
real_assets AS (SELECT date, CAST(ticker AS VARCHAR) AS asset, weight FROM ra_w)"""


@query("portfolio_real_assets", f"WITH {PANEL}, {FILINGS}, {real_assets_sql('QE')} SELECT date, asset, round(weight, 6) AS weight FROM real_assets")
def portfolio_real_assets(spark, sf):
    return rounded_book(real_assets(spark, sf))


# The weekly panel under the daily one's names, for the blend that nests the book.
sleeve_queries.BLENDS["teva_ivvb_cdi"] = ((("book", "real_assets", 1 / 3), ("fund", "foreign", 1 / 3), ("cash", "cash", 1 / 3)), "QE", False)
sleeve_queries.NESTED["real_assets"] = real_assets
WEEKLY = f"real_assets AS (WITH {PANEL}, {FILINGS}, {real_assets_sql('QE')} SELECT * FROM real_assets)"
sleeve_queries.BOOK_SQL["real_assets"] = (lambda rule: WEEKLY, "real_assets")


@query("portfolio_teva_ivvb_cdi", blend_sql("teva_ivvb_cdi"))
def portfolio_teva_ivvb_cdi(spark, sf):
    return rounded_book(blend(spark, sf, "teva_ivvb_cdi"))
