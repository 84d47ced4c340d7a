"""Queries that generate, score and prune features, audit tables, and merge."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import columns as c
from ..operators import audit, merge, ml
from ..operators import discovery as d
from ..operators.durable import durable
from . import adapters as a
from .oracle import BARS, FILINGS, MARKET, PANEL, SPLITS, lag, pct_rank, roll
from .registry import half_up, query, rounded

W = c.by_time  # called where it is used: a window needs a session
CATEGORY = {"mom13": "momentum", "mom4": "momentum", "vol13": "risk", "drawdown26": "risk", "volume4": "volume", "range4": "range"}

FEATURES = f"""{PANEL}, wide AS (SELECT date, ticker, round({lag('close', 1)} / {lag('close', 13)} - 1, 9) AS mom13, round(close / {lag('close', 4)} - 1, 9) AS mom4, round({roll('stddev_samp', 'ret', 13, 7)}, 9) AS vol13,
round(close / max(close) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 25 PRECEDING AND CURRENT ROW) - 1, 9) AS drawdown26, round({roll('avg', 'volume', 4, 2)}, 4) AS volume4, round({roll('avg', '((high - low) / close)', 4, 2)}, 9) AS range4 FROM panel),
features AS (UNPIVOT wide ON mom13, mom4, vol13, drawdown26, volume4, range4 INTO NAME feature VALUE value)"""
FORWARD = """forward AS (SELECT date, ticker, 4 AS horizon, lead(close, 4) OVER (PARTITION BY ticker ORDER BY date) / close - 1 AS f FROM panel UNION ALL SELECT date, ticker, 13, lead(close, 13) OVER (PARTITION BY ticker ORDER BY date) / close - 1 FROM panel)"""
IC = f"""{FEATURES}, {FORWARD}, both_known AS (SELECT feature, horizon, x.date, x.ticker, value, round(f, 9) AS f FROM features x JOIN forward y ON x.date = y.date AND x.ticker = y.ticker WHERE f IS NOT NULL),
rk AS (SELECT feature, horizon, date, {pct_rank('value', 'feature, horizon, date')} AS rx, {pct_rank('f', 'feature, horizon, date')} AS ry FROM both_known),
ic AS (SELECT feature, horizon, date, covar_samp(rx, ry) / nullif(stddev_samp(rx) * stddev_samp(ry), 0) AS ic FROM rk GROUP BY 1, 2, 3 HAVING count(*) >= 10 AND stddev_samp(rx) * stddev_samp(ry) > 0)"""


def measured(p, horizons=()):
    """(date, ticker, one column a feature, forward_<horizon>) from the panel ``p``."""
    w = W()
    return p.select(
        "date", "ticker", half_up(c.ratio(c.shift("close", 1, w), c.shift("close", 13, w)) - 1, 9).alias("mom13"), half_up(c.pct_change("close", 4, w), 9).alias("mom4"), half_up(c.roll_std("ret", 13, w, 7), 9).alias("vol13"),
        half_up(c.ratio("close", c.roll_max("close", 26, w, 1)) - 1, 9).alias("drawdown26"), half_up(c.roll_mean("volume", 4, w, 2), 4).alias("volume4"), half_up(c.roll_mean(c.ratio(F.col("high") - F.col("low"), "close"), 4, w, 2), 9).alias("range4"),
        *((c.ratio(F.lead("close", h).over(w), "close") - 1).alias(f"forward_{h}") for h in horizons),
    )


def features(spark, sf):
    return d.to_long(measured(a.panel(spark, sf)), list(CATEGORY))


def ic(spark, sf):
    wide = measured(a.panel(spark, sf), [4, 13]).withColumns({f"forward_{h}": half_up(f"forward_{h}", 9) for h in (4, 13)})
    return d.ic_by_date(wide, list(CATEGORY), {h: f"forward_{h}" for h in (4, 13)})


@query("features_level0", f"WITH {FEATURES} SELECT feature, date, ticker, round(value, 6) AS value FROM features")
def features_level0(spark, sf):
    return rounded(features(spark, sf), "feature", "date", "ticker", "value")


@query("features_level1", f"""WITH {FEATURES}, s AS (SELECT 'rank__' || feature AS feature, date, ticker, {pct_rank('value', 'feature, date')} AS value FROM features UNION ALL
SELECT 'zscore__' || feature, date, ticker, (value - avg(value) OVER g) / nullif(stddev_samp(value) OVER g, 0) FROM features WINDOW g AS (PARTITION BY feature, date)) SELECT feature, date, ticker, round(value, 5) AS value FROM s WHERE value IS NOT NULL""")
def features_level1(spark, sf):
    return d.cross_sectional(features(spark, sf)).withColumn("value", half_up("value", 5))


@query("features_level2", f"""WITH {FEATURES}, x AS (SELECT 'delta4__' || feature AS feature, date, ticker, value - lag(value, 4) OVER o AS value FROM features WINDOW o AS (PARTITION BY feature, ticker ORDER BY date)
UNION ALL SELECT 'ratio_to_mean10__' || feature, date, ticker, CASE WHEN count(value) OVER w >= 5 THEN value / nullif(avg(value) OVER w, 0) END FROM features WINDOW w AS (PARTITION BY feature, ticker ORDER BY date ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))
SELECT feature, date, ticker, round(value, 5) AS value FROM x WHERE value IS NOT NULL""")
def features_level2(spark, sf):
    return d.changes_of(measured(a.panel(spark, sf)), list(CATEGORY), 4, 10).withColumn("value", half_up("value", 5))


PAIRS = f"""WITH {FEATURES}, cats AS (SELECT * FROM (VALUES {', '.join(map(repr, CATEGORY.items()))}) t(feature, category)),
p AS (SELECT a.date, a.ticker, a.feature AS fa, b.feature AS fb, a.value AS va, b.value AS vb FROM features a JOIN features b ON a.date = b.date AND a.ticker = b.ticker AND a.feature < b.feature
  JOIN cats ca ON ca.feature = a.feature JOIN cats cb ON cb.feature = b.feature WHERE ca.category <> cb.category),
m AS (SELECT 'ratio__' || fa || '__' || fb AS feature, date, ticker, va / nullif(vb, 0) AS value FROM p UNION ALL SELECT 'product__' || fa || '__' || fb, date, ticker, va * vb FROM p UNION ALL SELECT 'diff__' || fa || '__' || fb, date, ticker, va - vb FROM p)
SELECT feature, date, ticker, value FROM m WHERE value IS NOT NULL"""


@query("feature_pairs", PAIRS)
def feature_pairs(spark, sf):
    """Every two features of different categories, whatever the size of the values; both sides combine the same rounded numbers, so results are not rounded again."""
    return d.pairs_of(measured(a.panel(spark, sf)), CATEGORY)


@query("ic_series", f"WITH {IC} SELECT feature, horizon, date, round(ic, 6) AS ic FROM ic")
def ic_series(spark, sf):
    return rounded(ic(spark, sf), "feature", "horizon", "date", "ic")


@query("ic_summary", f"""WITH {IC}, r AS (SELECT *, dense_rank() OVER (PARTITION BY horizon ORDER BY date) AS n FROM ic), k AS (SELECT horizon, greatest(1, CAST(floor(max(n) * 0.7) AS INTEGER)) AS cut, max(date) - INTERVAL 60 MONTH AS since FROM r GROUP BY 1)
SELECT feature, r.horizon, count(ic) AS n_dates, round(avg(ic), 6) AS mean_ic, round(avg(ic) / nullif(stddev_samp(ic), 0), 5) AS ic_ir, round(avg(CASE WHEN ic > 0 THEN 1.0 ELSE 0.0 END), 6) AS pct_positive, round(avg(ic) FILTER (WHERE n <= cut), 6) AS train_ic, round(avg(ic) FILTER (WHERE n > cut), 6) AS test_ic,
round(stddev_samp(ic), 6) AS sd_ic, round(avg(ic) / nullif(stddev_samp(ic), 0) * sqrt(count(ic)), 4) AS t_stat, round(avg(ic) FILTER (WHERE r.date > k.since), 6) AS recent_ic
FROM r JOIN k ON k.horizon = r.horizon GROUP BY 1, 2""")
def ic_summary(spark, sf):
    s = d.ic_summary(ic(spark, sf)).withColumn("ic_ir", half_up("ic_ir", 5))
    return s.select("feature", "horizon", "n_dates", half_up("mean_ic").alias("mean_ic"), "ic_ir", half_up("pct_positive").alias("pct_positive"), half_up("train_ic").alias("train_ic"), half_up("test_ic").alias("test_ic"), half_up("sd_ic").alias("sd_ic"), half_up("t_stat", 4).alias("t_stat"), half_up("recent_ic").alias("recent_ic"))


@query("ic_histogram", f"WITH {IC} SELECT feature, horizon, CAST(floor(round(ic, 9) / 0.05) AS BIGINT) AS bin, count(*) AS dates FROM ic GROUP BY 1, 2, 3")
def ic_histogram(spark, sf):
    """How many dates' correlations fall into each bin of a twentieth."""
    return ic(spark, sf).groupBy("feature", "horizon", F.floor(half_up("ic", 9) / 0.05).alias("bin")).agg(F.count("*").alias("dates"))


LAGS = (0, 1, 5, 20)


@query("ic_decay", f"""WITH {FEATURES}, {FORWARD}, f4 AS (SELECT date, ticker, round(f, 9) AS f FROM forward WHERE horizon = 4 AND f IS NOT NULL),
l AS ({' UNION ALL '.join(f"SELECT feature, date, ticker, {n} AS lag, lag(value, {n}) OVER (PARTITION BY feature, ticker ORDER BY date) AS value FROM features" for n in LAGS)}),
b AS (SELECT feature, lag, l.date, l.ticker, value, f FROM l JOIN f4 ON f4.date = l.date AND f4.ticker = l.ticker WHERE value IS NOT NULL),
rk AS (SELECT feature, lag, date, {pct_rank('value', 'feature, lag, date')} AS rx, {pct_rank('f', 'feature, lag, date')} AS ry FROM b),
ic AS (SELECT feature, lag, date, covar_samp(rx, ry) / nullif(stddev_samp(rx) * stddev_samp(ry), 0) AS ic FROM rk GROUP BY 1, 2, 3 HAVING count(*) >= 10 AND stddev_samp(rx) * stddev_samp(ry) > 0)
SELECT feature, lag, round(avg(ic), 6) AS ic FROM ic GROUP BY 1, 2""")
def ic_decay(spark, sf):
    """All lags in one pass: a lag is part of the feature's name.  It counts rows that have the feature."""
    wide = measured(a.panel(spark, sf), [4]).withColumn("forward_4", half_up("forward_4", 9))
    late = {f"{x}__lag{n}": F.expr(f"CASE WHEN {x} IS NOT NULL THEN {f'lag({x}, {n}) IGNORE NULLS OVER (PARTITION BY ticker ORDER BY date)' if n else x} END") for x in CATEGORY for n in LAGS}
    wide = wide.select("date", "forward_4", *(e.alias(k) for k, e in late.items()))
    name = F.split("feature", "__lag")
    return d.ic_by_date(wide, list(late), {4: "forward_4"}).groupBy(name[0].alias("feature"), name[1].cast("int").alias("lag")).agg(half_up(F.avg("ic")).alias("ic"))


@query("ic_rolling_mean", f"WITH {IC} SELECT feature, horizon, date, round(CASE WHEN count(ic) OVER w >= 26 THEN avg(ic) OVER w END, 6) AS ic52 FROM ic WINDOW w AS (PARTITION BY feature, horizon ORDER BY date ROWS BETWEEN 51 PRECEDING AND CURRENT ROW)")
def ic_rolling_mean(spark, sf):
    x = ic(spark, sf).withColumn("_k", F.concat_ws("|", "feature", "horizon"))
    return x.select("feature", "horizon", "date", half_up(c.roll_mean("ic", 52, c.by_time("_k"), 26)).alias("ic52"))


@query("feature_turnover", f"""WITH {FEATURES}, r AS (SELECT feature, date, ticker, {pct_rank('value', 'feature, date')} AS r FROM features), dt AS (SELECT feature, date, lag(date) OVER (PARTITION BY feature ORDER BY date) AS prior FROM (SELECT DISTINCT feature, date FROM features)),
b AS (SELECT r.feature, r.date, r.r AS r1, p.r AS r0 FROM r JOIN dt ON dt.feature = r.feature AND dt.date = r.date JOIN r p ON p.feature = r.feature AND p.ticker = r.ticker AND p.date = dt.prior), cc AS (SELECT feature, date, covar_samp(r1, r0) / nullif(stddev_samp(r1) * stddev_samp(r0), 0) AS c FROM b GROUP BY 1, 2) SELECT feature, round(1 - avg(c), 6) AS turnover FROM cc GROUP BY 1""")
def feature_turnover(spark, sf):
    return rounded(d.rank_turnover(features(spark, sf)), "feature", "turnover")


@query("feature_quality", f"WITH {FEATURES}, y AS (SELECT feature, date, count(value) AS n, coalesce(stddev_samp(value), 0) AS sd FROM features GROUP BY 1, 2) SELECT feature, round(1 - sum(n) / (SELECT count(*) FROM panel), 6) AS nan_rate, round(avg(CASE WHEN sd = 0 THEN 1.0 ELSE 0.0 END), 6) AS flat_rate FROM y GROUP BY 1")
def feature_quality(spark, sf):
    return rounded(d.quality(features(spark, sf), a.panel(spark, sf)), "feature", "nan_rate", "flat_rate")


@query("feature_correlations", f"""WITH {FEATURES}, dt AS (SELECT date FROM (SELECT date, row_number() OVER (ORDER BY date) AS n FROM (SELECT DISTINCT date FROM features)) WHERE n % 10 = 1), r AS (SELECT feature, date, ticker, {pct_rank('value', 'feature, date')} AS r FROM features WHERE date IN (SELECT date FROM dt)),
dc AS (SELECT x.feature AS a, y.feature AS b, x.date, covar_samp(x.r, y.r) / nullif(stddev_samp(x.r) * stddev_samp(y.r), 0) AS c FROM r x JOIN r y ON x.date = y.date AND x.ticker = y.ticker AND x.feature < y.feature GROUP BY 1, 2, 3 HAVING count(*) >= 10) SELECT a, b, round(avg(c), 6) AS corr FROM dc GROUP BY 1, 2""")
def feature_correlations(spark, sf):
    return rounded(d.rank_correlations(features(spark, sf)), "a", "b", "corr")


@query("pruned_features")
def pruned_features(spark, sf):
    s = d.ic_summary(ic(spark, sf)).filter("horizon = 13 and abs(mean_ic) >= 0.005").select("feature", "ic_ir")
    return rounded(d.greedy_dedup(s, d.rank_correlations(features(spark, sf)), 0.5), "feature", "ic_ir")


@query("feature_registry")
def feature_registry(spark, sf):
    return d.components_of(d.cross_sectional(features(spark, sf)).select("feature").distinct())


@query("category_summary", f"""WITH {IC}, s AS (SELECT feature, avg(ic) / nullif(stddev_samp(ic), 0) AS ir FROM ic WHERE horizon = 13 GROUP BY 1) SELECT CASE WHEN feature LIKE 'mom%' THEN 'momentum' WHEN feature IN ('vol13', 'drawdown26') THEN 'risk' WHEN feature = 'volume4' THEN 'volume' ELSE 'range' END AS category, count(*) AS features, round(avg(abs(ir)), 6) AS mean_abs_ir FROM s GROUP BY 1""")
def category_summary(spark, sf):
    cats = spark.createDataFrame(list(CATEGORY.items()), "feature string, category string")
    s = d.ic_summary(ic(spark, sf)).filter("horizon = 13").join(F.broadcast(cats), "feature")
    return rounded(s.groupBy("category").agg(F.count("*").alias("features"), F.avg(F.abs("ic_ir")).alias("mean_abs_ir")), "category", "features", "mean_abs_ir")


@query("feature_bands", f"WITH {FEATURES} SELECT feature, date, round(quantile_cont(value, 0.25), 6) AS low, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.75), 6) AS high FROM features GROUP BY 1, 2")
def feature_bands(spark, sf):
    p = lambda q: F.percentile("value", F.lit(q))
    return rounded(features(spark, sf).groupBy("feature", "date").agg(p(0.25).alias("low"), p(0.5).alias("median"), p(0.75).alias("high")), "feature", "date", "low", "median", "high")


MODEL_FEATURES = list(CATEGORY)
TARGETS = {"beats_median": 4, "is_positive": 4, "is_positive_13": 13}


def modelled(spark, sf, *targets: str):
    """(date, ticker, the features, one 0/1 column a target), of names that have all features; written once, since a model passes over it many times."""
    wide = measured(a.panel(spark, sf), sorted({TARGETS[t] for t in targets}))
    for t in targets:
        f = F.col(f"forward_{TARGETS[t]}")
        median = F.percentile(f, F.lit(0.5)).over(Window.partitionBy("date"))
        wide = wide.withColumn(t, (f > (median if t == "beats_median" else 0)).cast("double"))
    return durable(wide.dropna(subset=MODEL_FEATURES).select("date", "ticker", *MODEL_FEATURES, *targets))


def split(table, target: str):
    """(train, test) of the features and one target as y, cut at 70 % of the dates."""
    return ml.chronological_split(table.filter(F.col(target).isNotNull()).select("date", "ticker", *MODEL_FEATURES, F.col(target).alias("y")))


def importance(spark, table, kind: str, target: str, trees: int = 20, depth: int = 5):
    train, test = split(table, target)
    model = ml.fit(train, MODEL_FEATURES, "y", kind, trees=trees, depth=depth)
    m = ml.measures(model.transform(test), "y").select("accuracy", "auc", "precision", "recall", "f1")
    return ml.importances(model, MODEL_FEATURES, spark).crossJoin(F.broadcast(m))


@query("forest_importance")
def forest_importance(spark, sf):
    return importance(spark, modelled(spark, sf, "beats_median"), "forest", "beats_median").drop("precision", "recall", "f1")


@query("boosted_importance")
def boosted_importance(spark, sf):
    return importance(spark, modelled(spark, sf, "beats_median"), "boosted", "beats_median")


MODELS = {"forest": (200, 15), "boosted": (500, 6)}  # trees or rounds, and depth


@query("experiment_grid")
def experiment_grid(spark, sf):
    """Both kinds of model, at full size, on each of the three targets.

    Rounds of a boosted model are thousands of small jobs in a row, so its targets run side by side, and beside the forests; these are large on the driver, so one after the other.
    """
    table = modelled(spark, sf, *TARGETS)

    def rows(kind: str, *targets: str) -> list[tuple]:
        out = []
        for target in targets:
            train, test = split(table, target)
            trees, depth = MODELS[kind]
            model = ml.fit(train, MODEL_FEATURES, "y", kind, trees=trees, depth=depth)
            scored = durable(model.transform(test).select("y", "rawPrediction", "prediction"))  # measured twice
            m = ml.measures(scored, "y").select("accuracy", "auc", "precision", "recall", "f1").first()
            out += [(kind, target, *r, *m) for r in ml.importances(model, MODEL_FEATURES, spark).collect()]
        return out

    with ThreadPoolExecutor(1 + len(TARGETS)) as pool:
        running = [pool.submit(rows, "forest", *TARGETS), *(pool.submit(rows, "boosted", t) for t in TARGETS)]
        made = [r for part in running for r in part.result()]
    return spark.createDataFrame(made, "model string, target string, feature string, importance double, place int, accuracy double, auc double, precision double, recall double, f1 double")


@query("permutation_importance")
def permutation_importance(spark, sf):
    train, test = split(modelled(spark, sf, "beats_median"), "beats_median")
    return ml.permutation_importance(ml.fit(train, MODEL_FEATURES, "y", "forest", trees=20, depth=5), test, MODEL_FEATURES, "y")


@query("model_overlap")
def model_overlap(spark, sf):
    """Features among the three most important of both kinds of model."""
    train, _ = split(modelled(spark, sf, "beats_median"), "beats_median")
    forest, boosted = (ml.importances(ml.fit(train, MODEL_FEATURES, "y", kind, trees=20, depth=5), MODEL_FEATURES, spark) for kind in ("forest", "boosted"))
    return ml.overlap(forest, boosted, 3)


@query("discovery_funnel", f"""WITH {IC}, y AS (SELECT feature, date, count(value) AS n, coalesce(stddev_samp(value), 0) AS sd FROM features GROUP BY 1, 2), q AS (SELECT feature, round(1 - sum(n) / (SELECT count(*) FROM panel), 9) AS nan_rate, round(avg(CASE WHEN sd = 0 THEN 1.0 ELSE 0.0 END), 9) AS flat_rate FROM y GROUP BY 1),
p AS (SELECT feature FROM q WHERE nan_rate <= 0.3 AND flat_rate <= 0.1), i AS (SELECT feature, round(avg(ic), 9) AS m, round(avg(ic) / nullif(stddev_samp(ic), 0), 9) AS ir FROM ic WHERE horizon = 13 AND feature IN (SELECT feature FROM p) GROUP BY 1), k AS (SELECT * FROM i WHERE abs(m) >= 0.005),
c AS (SELECT feature FROM k ORDER BY abs(ir) DESC, feature LIMIT 3)
SELECT 1 AS step, 'generated' AS stage, count(DISTINCT feature) AS features FROM features UNION ALL SELECT 2, 'quality', count(*) FROM p UNION ALL SELECT 3, 'mean_ic', count(*) FROM k UNION ALL SELECT 4, 'capped', count(*) FROM c""")
def discovery_funnel(spark, sf):
    """How many features each stage of pruning leaves: values and variance, mean IC, and the cap."""
    f = features(spark, sf)
    good = d.prune_quality(d.quality(f, a.panel(spark, sf)).withColumns({x: half_up(x, 9) for x in ("nan_rate", "flat_rate")})).select("feature")
    scored = d.ic_summary(ic(spark, sf)).filter("horizon = 13").join(good, "feature").withColumns({x: half_up(x, 9) for x in ("mean_ic", "ic_ir")}).filter("abs(mean_ic) >= 0.005")
    counted = [(1, "generated", f.select("feature").distinct()), (2, "quality", good), (3, "mean_ic", scored), (4, "capped", d.capped(scored, 3))]
    out = None
    for step, stage, kept in counted:
        row = kept.agg(F.count("*").alias("features")).select(F.lit(step).alias("step"), F.lit(stage).alias("stage"), "features")
        out = row if out is None else out.union(row)
    return out


@query("quote_audit", f"WITH {BARS} SELECT 'high_below_low' AS rule, count(*) FILTER (WHERE high < low * 0.999) AS count FROM bars UNION ALL SELECT 'close_outside', count(*) FILTER (WHERE close > high * 1.001 OR close < low * 0.999) FROM bars UNION ALL SELECT 'open_outside', count(*) FILTER (WHERE open > high * 1.001 OR open < low * 0.999) FROM bars UNION ALL SELECT 'negative', count(*) FILTER (WHERE least(open, high, low, close, volume) < 0) FROM bars UNION ALL SELECT 'wide_range', count(*) FILTER (WHERE high > 3 * low) FROM bars")
def quote_audit(spark, sf):
    k = F.col
    return audit.rule_counts(a.bars(spark, sf), {"high_below_low": k("high") < k("low") * 0.999, "close_outside": (k("close") > k("high") * 1.001) | (k("close") < k("low") * 0.999), "open_outside": (k("open") > k("high") * 1.001) | (k("open") < k("low") * 0.999), "negative": F.least("open", "high", "low", "close", "volume") < 0, "wide_range": k("high") > 3 * k("low")})


@query("duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS count, CASE WHEN count(*) >= 5 THEN 'ERROR' WHEN count(*) >= 2 THEN 'WARN' ELSE 'OK' END AS severity FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(spark, sf):
    return audit.duplicates(a.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"]).withColumn("severity", audit.severity("count", 2, 5))


@query("orphan_customers", "SELECT c_custkey, c_mktsegment FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def orphan_customers(spark, sf):
    o = a.table(spark, sf, "orders").filter("o_totalprice > 400000")
    return audit.orphans(a.table(spark, sf, "customer"), o, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "c_mktsegment")


@query("covered_customers", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def covered_customers(spark, sf):
    o = a.table(spark, sf, "orders").filter("o_totalprice > 400000")
    return a.table(spark, sf, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("filing_null_rates", f"WITH {FILINGS} SELECT 'net_income' AS \"column\", round(avg(CASE WHEN net_income IS NULL THEN 1.0 ELSE 0.0 END), 6) AS null_rate FROM filings UNION ALL SELECT 'equity', round(avg(CASE WHEN equity IS NULL THEN 1.0 ELSE 0.0 END), 6) FROM filings UNION ALL SELECT 'shares', round(avg(CASE WHEN shares IS NULL THEN 1.0 ELSE 0.0 END), 6) FROM filings")
def filing_null_rates(spark, sf):
    return rounded(audit.null_rates(a.filings(spark, sf), ["net_income", "equity", "shares"]), "column", "null_rate")


@query("table_summaries", """SELECT 'lineitem' AS "table", count(*) AS rows, count(DISTINCT l_suppkey) AS keys, min(l_shipdate) AS first, max(l_shipdate) AS last FROM lineitem UNION ALL SELECT 'orders', count(*), count(DISTINCT o_custkey), min(o_orderdate), max(o_orderdate) FROM orders""")
def table_summaries(spark, sf):
    return audit.table_summary(a.table(spark, sf, "lineitem"), "lineitem", "l_suppkey", "l_shipdate").union(audit.table_summary(a.table(spark, sf, "orders"), "orders", "o_custkey", "o_orderdate"))


@query("table_sample", "SELECT l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice, l_shipdate FROM lineitem ORDER BY l_orderkey, l_linenumber, l_suppkey, l_partkey LIMIT 100")
def table_sample(spark, sf):
    sample = audit.table_sample(a.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber", "l_suppkey", "l_partkey"])
    return sample.select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")


@query("actions_outside_span", f"WITH {BARS}, {SPLITS}, s AS (SELECT ticker, min(date) AS a, max(date) AS b FROM bars GROUP BY 1) SELECT ticker, ex_date, factor FROM splits JOIN s USING (ticker) WHERE ex_date < a + 200 OR ex_date > b - 200")
def actions_outside_span(spark, sf):
    inner = a.bars(spark, sf).groupBy("ticker").agg(F.date_add(F.min("date"), 200).alias("_a"), F.date_sub(F.max("date"), 200).alias("_b"))
    ends = inner.select("ticker", F.col("_a").alias("date")).union(inner.select("ticker", F.col("_b").alias("date")))
    return audit.outside_span(a.share_events(spark, sf), ends, "ticker", "ex_date").select("ticker", "ex_date", "factor")


@query("yearly_coverage", "SELECT year(l_shipdate) AS year, count(DISTINCT CAST(l_shipdate AS DATE)) AS days, count(DISTINCT l_suppkey) AS tickers, count(*) AS rows FROM lineitem GROUP BY 1")
def yearly_coverage(spark, sf):
    return a.table(spark, sf, "lineitem").groupBy(F.year("l_shipdate").alias("year")).agg(F.countDistinct(F.to_date("l_shipdate")).alias("days"), F.countDistinct("l_suppkey").alias("tickers"), F.count("*").alias("rows"))


@query("upserted_orders", "SELECT o_custkey, o_orderpriority, o_totalprice, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END DESC, o_orderdate DESC, o_orderkey DESC) = 1")
def upserted_orders(spark, sf):
    o = a.table(spark, sf, "orders")
    return merge.upsert(o.filter("o_orderstatus <> 'F'"), o.filter("o_orderstatus = 'F'"), ["o_custkey", "o_orderpriority"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderpriority", "o_totalprice", "o_orderkey")


@query("filled_customers", """WITH x AS (SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS balance, c_mktsegment AS segment FROM customer), y AS (SELECT o_custkey AS c_custkey, max(o_totalprice) AS balance, max(o_orderpriority) AS segment FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT c_custkey, coalesce(x.balance, y.balance) AS balance, CASE WHEN y.c_custkey IS NOT NULL THEN y.segment ELSE x.segment END AS segment FROM x FULL JOIN y USING (c_custkey)""")
def filled_customers(spark, sf):
    x = a.table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("balance"), F.col("c_mktsegment").alias("segment"))
    y = a.table(spark, sf, "orders").filter("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("balance"), F.max("o_orderpriority").alias("segment"))
    return merge.fill_missing(x, y, ["c_custkey"], overwrite=["segment"])


@query("panel_fingerprint", f"WITH {PANEL}, x AS (SELECT count(*) AS rows, min(date) AS first, max(date) AS last, count(ret) AS known FROM panel) SELECT rows, first, last, known, substr(sha256(rows || '|' || first || '|' || last || '|' || known), 1, 16) AS fingerprint FROM x")
def panel_fingerprint(spark, sf):
    return merge.fingerprint(a.panel(spark, sf), "date", "ret")


@query("json_events", "SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def json_events(spark, sf):
    e = a.table(spark, sf, "events").withColumn("k", F.from_json("props", "k bigint")["k"])
    return e.groupBy("event_type", "k").agg(F.count("*").alias("n"), half_up(F.sum("value"), 4).alias("total"))


@query("deflated_threshold", f"""WITH {MARKET} SELECT date, round(level, 6) AS level, round(100000 * level / (SELECT arg_max(level, date) FROM market), 4) AS threshold FROM market""")
def deflated_threshold(spark, sf):
    m = a.market(spark, sf)
    latest = m.agg(F.max_by("level", "date").alias("now"))
    return m.crossJoin(F.broadcast(latest)).select("date", half_up("level").alias("level"), half_up(100000 * F.col("level") / F.col("now"), 4).alias("threshold"))
