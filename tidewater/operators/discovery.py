"""Feature discovery on long features (feature, date, ticker, value): scoring by rank correlation with forward returns, pruning.

``feature`` is a key like any other, so one shuffle by (feature, horizon, date) scores them all.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import by_time, pct_rank, ratio, safe_corr, zscore
from .durable import durable


def to_long(panel: DataFrame, features: list[str]) -> DataFrame:
    """Wide measures to one row per feature, without the missing ones."""
    listed = F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features))
    return panel.select("date", "ticker", F.explode(listed).alias("e")).select("e.feature", "date", "ticker", "e.value").filter("value is not null")


def cross_sectional(features: DataFrame) -> DataFrame:
    """Level one: rank and zscore of every feature per date, named rank__x and zscore__x."""
    scaled = features.withColumn("r", pct_rank("value", ["feature", "date"])).withColumn("z", zscore("value", ["feature", "date"]))
    both = F.array(F.struct(F.concat(F.lit("rank__"), "feature").alias("f"), F.col("r").alias("v")), F.struct(F.concat(F.lit("zscore__"), "feature").alias("f"), F.col("z").alias("v")))
    return scaled.select("date", "ticker", F.explode(both).alias("e")).select(F.col("e.f").alias("feature"), "date", "ticker", F.col("e.v").alias("value")).filter("value is not null")


def deltas(features: DataFrame, n: int) -> DataFrame:
    w = Window.partitionBy("feature", "ticker").orderBy("date")
    return features.select(F.concat(F.lit(f"delta{n}__"), "feature").alias("feature"), "date", "ticker", (F.col("value") - F.lag("value", n).over(w)).alias("value")).filter("value is not null")


def ratios_to_mean(features: DataFrame, n: int) -> DataFrame:
    f = Window.partitionBy("feature", "ticker").orderBy("date").rowsBetween(-(n - 1), 0)
    mean = F.when(F.count("value").over(f) >= max(3, n // 2), F.avg("value").over(f))
    return features.select(F.concat(F.lit(f"ratio_to_mean{n}__"), "feature").alias("feature"), "date", "ticker", F.try_divide(F.col("value"), F.nullif(mean, F.lit(0.0))).alias("value")).filter("value is not null")


def changes_of(wide: DataFrame, features: list[str], shift: int, n: int) -> DataFrame:
    """``deltas`` and ``ratios_to_mean`` of every feature, from one row a date and name with a column each: rows are sorted by name once and not again by feature.

    A look-back counts rows that have the feature.  So does a mean: where the last n rows lack a value it is a difference of running sums in whole billionths.
    """
    over = "OVER (PARTITION BY ticker ORDER BY date"
    history, frame = f"{over} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", f"{over} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    step = lambda df, made: df.withColumns({k: F.expr(e) for k, e in made.items()})
    sums, looked = {}, {}
    for x in features:
        sums |= {f"_s_{x}": f"sum(CAST(rint({x} * 1e9D) AS decimal(38,0))) {history}", f"_n_{x}": f"least(count({x}) {history}, {n})", f"_k_{x}": f"count({x}) {frame}", f"_m_{x}": f"avg({x}) {frame}"}
        looked |= {f"_b_{x}": f"lag(CASE WHEN {x} IS NOT NULL THEN _s_{x} END, {n}) IGNORE NULLS {over})", f"_l_{x}": f"lag({x}, {shift}) IGNORE NULLS {over})"}
    out = step(step(wide.select("date", "ticker", *features), sums), looked)
    made = {f"delta{shift}__{x}": f"{x} - _l_{x}" for x in features}
    for x in features:
        mean = f"CASE WHEN _k_{x} = _n_{x} THEN _m_{x} ELSE CAST(_s_{x} - coalesce(_b_{x}, 0) AS DOUBLE) / _n_{x} / 1e9D END"
        made[f"ratio_to_mean{n}__{x}"] = f"CASE WHEN _n_{x} >= {max(3, n // 2)} THEN try_divide({x}, nullif({mean}, 0D)) END"
    return to_long(out.select("date", "ticker", *(F.expr(e).alias(k) for k, e in made.items())), list(made))


def pairs_of(wide: DataFrame, category: dict[str, str]) -> DataFrame:
    """Ratio, product and difference of every two features of different categories, from one row a date and name with a column each: its pairs stand in one row, so nothing is joined."""
    made = []
    for x, y in combinations(sorted(category), 2):
        if category[x] != category[y]:
            values = {"ratio": F.try_divide(F.col(x), F.nullif(F.col(y), F.lit(0.0))), "product": F.col(x) * F.col(y), "diff": F.col(x) - F.col(y)}
            made += [F.struct(F.lit(f"{op}__{x}__{y}").alias("feature"), v.alias("value")) for op, v in values.items()]
    return wide.select("date", "ticker", F.explode(F.array(*made)).alias("e")).select("e.feature", "date", "ticker", "e.value").filter("value is not null")


def forward_returns(panel: DataFrame, horizons: list[int], price: str = "close") -> DataFrame:
    """(date, ticker, horizon, forward): price change over the next rows."""
    w = by_time()
    made = F.array(*(F.struct(F.lit(h).alias("horizon"), (ratio(F.lead(price, h).over(w), price) - 1).alias("forward")) for h in horizons))
    return panel.select("date", "ticker", made.alias("_m")).select("date", "ticker", F.explode("_m").alias("e")).select("date", "ticker", "e.horizon", "e.forward").filter("forward is not null")


def binary_targets(forward: DataFrame) -> DataFrame:
    """``forward`` plus beats_median (of its date) and is_positive, 0 or 1."""
    median = F.percentile("forward", F.lit(0.5)).over(Window.partitionBy("date", "horizon"))
    return forward.withColumn("beats_median", (F.col("forward") > median).cast("int")).withColumn("is_positive", (F.col("forward") > 0).cast("int"))


def ic_series(features: DataFrame, forward: DataFrame, least_names: int = 10) -> DataFrame:
    """(feature, horizon, date, ic): Spearman correlation over the names known in both, ranked anew among these."""
    both = features.join(forward, ["date", "ticker"])
    keys = ["feature", "horizon", "date"]
    ranked = both.withColumn("rx", pct_rank("value", keys)).withColumn("ry", pct_rank("forward", keys))
    return ranked.groupBy(*keys).agg(safe_corr("rx", "ry").alias("ic"), F.count("*").alias("names")).filter(f"names >= {least_names} and ic is not null").drop("names")


def centred_ranks(values: np.ndarray) -> np.ndarray:
    """Twice each value's rank, ties averaged, less its mean: whole numbers, all zero where all values are alike."""
    order, n = np.argsort(values), len(values)
    new = np.append(True, np.diff(values[order]) != 0)[:n]
    starts = np.flatnonzero(new)
    out = np.empty(n)
    out[order] = (starts + np.append(starts[1:], n) - n)[np.cumsum(new) - 1]
    return out


def rank_correlation(x: np.ndarray, y: np.ndarray) -> float:
    """Spearman's, NaN where one of them does not vary."""
    rx, ry = centred_ranks(x), centred_ranks(y)
    spread = np.sqrt(rx @ rx) * np.sqrt(ry @ ry)
    return rx @ ry / spread if spread > 0 else np.nan


def ic_by_date(wide: DataFrame, features: list[str], forwards: dict[int, str], least_names: int = 10) -> DataFrame:
    """``ic_series`` from one row a date and name, with a column each feature and each horizon's return.

    Rows are shuffled once, by date, whatever the number of features and horizons; a group is one date's names.
    """
    kind = wide.schema["date"].dataType.simpleString()

    def scored(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for horizon, target in forwards.items():
            y = rows[target].to_numpy(float)
            for feature in features:
                x = rows[feature].to_numpy(float)
                both = ~(np.isnan(x) | np.isnan(y))
                ic = rank_correlation(x[both], y[both]) if both.sum() >= least_names else np.nan
                if not np.isnan(ic):
                    out.append((feature, horizon, rows["date"].iloc[0], ic))
        return pd.DataFrame(out, columns=["feature", "horizon", "date", "ic"])

    return wide.select("date", *features, *forwards.values()).groupBy("date").applyInPandas(scored, f"feature string, horizon int, date {kind}, ic double")


def ic_summary(ic: DataFrame, train_share: float = 0.7, recent_months: int = 60) -> DataFrame:
    """Per feature and horizon: mean, deviation, ir, t-stat, share positive, means of the first 70 % of dates and the rest, and of the last five years."""
    dates = ic.groupBy("horizon").agg(F.sort_array(F.collect_set("date")).alias("d"))
    split = F.element_at("d", F.greatest(F.lit(1), F.floor(F.size("d") * train_share).cast("int")))
    dates = dates.select("horizon", split.alias("split"), F.add_months(F.element_at("d", -1), -recent_months).alias("since"))
    x = ic.join(F.broadcast(dates), "horizon")
    out = x.groupBy("feature", "horizon").agg(
        F.avg("ic").alias("mean_ic"), F.stddev_samp("ic").alias("sd_ic"), F.count("ic").alias("n_dates"), F.avg((F.col("ic") > 0).cast("double")).alias("pct_positive"),
        F.avg(F.when(F.col("date") <= F.col("split"), F.col("ic"))).alias("train_ic"), F.avg(F.when(F.col("date") > F.col("split"), F.col("ic"))).alias("test_ic"),
        F.avg(F.when(F.col("date") > F.col("since"), F.col("ic"))).alias("recent_ic"),
    )
    ir = F.try_divide(F.col("mean_ic"), F.nullif(F.col("sd_ic"), F.lit(0.0)))
    return out.withColumn("ic_ir", ir).withColumn("t_stat", ir * F.sqrt("n_dates"))


def rank_turnover(features: DataFrame) -> DataFrame:
    """(feature, turnover): one minus the mean correlation of consecutive dates' ranks over names valid on both; NULL with no such date.

    A name that has the feature's date before has it as its own last row, so its earlier rank is a look-back and not a join.
    """
    ranked = features.withColumn("r", pct_rank("value", ["feature", "date"])).select("feature", "date", "ticker", "r")
    dates = features.select("feature", "date").distinct().withColumn("prior", F.lag("date").over(Window.partitionBy("feature").orderBy("date")))
    last = F.lag(F.struct("date", "r")).over(Window.partitionBy("feature", "ticker").orderBy("date"))
    both = ranked.withColumn("_last", last).join(F.broadcast(dates), ["feature", "date"]).filter("_last.date = prior")  # one row a feature and date
    return both.groupBy("feature", "date").agg(safe_corr("r", "_last.r").alias("c")).groupBy("feature").agg((1 - F.avg("c")).alias("turnover"))


def quality(features: DataFrame, grid: DataFrame) -> DataFrame:
    """(feature, nan_rate, flat_rate): share of the grid's cells without a value, share of dates without variance."""
    days = features.groupBy("feature", "date").agg(F.count("value").alias("n"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("sd"))
    cells = grid.agg(F.count("*").alias("cells"))  # one row
    return days.crossJoin(F.broadcast(cells)).groupBy("feature").agg((1 - F.sum("n") / F.first("cells")).alias("nan_rate"), F.avg((F.col("sd") == 0).cast("double")).alias("flat_rate"))


def prune_quality(measured: DataFrame, most_missing: float = 0.3, most_flat: float = 0.1) -> DataFrame:
    """Features of ``measured`` (feature, nan_rate, flat_rate) that have enough values and vary on enough dates."""
    return measured.filter((F.col("nan_rate") <= most_missing) & (F.col("flat_rate") <= most_flat))


def capped(scored: DataFrame, most: int, score: str = "ic_ir") -> DataFrame:
    """The ``most`` features of largest absolute score; ties go to the name that comes first."""
    return scored.orderBy(F.abs(score).desc(), "feature").limit(most)


def best(scored: DataFrame, most: int, score: str = "ic_ir") -> list[str]:
    """The names of ``capped``, best first: ``most`` of them at the most."""
    return [r["feature"] for r in capped(scored, most, score).collect()]


def rank_correlations(features: DataFrame, every: int = 10, least_names: int = 10, block: int = 4096) -> DataFrame:
    """(a, b, corr): mean over every tenth date of the rank correlation of two features, a < b, with ten common names at least.

    Ranks of a date are laid out as blocks of names by features, with zero for a missing one; four matrix products of a block with itself give the counts, sums and
    products of all pairs at once.  Blocks of a date add up, so no date need fit in a task, and pairs of features are rows only at the end.  The features' names, hundreds of them, are gathered first.
    """
    features = durable(features.select("feature", "date", "ticker", "value"))  # read for its names, its dates and its values
    names = [r["feature"] for r in features.select("feature").distinct().orderBy("feature").collect()]
    place, n = {f: i for i, f in enumerate(names)}, len(names)
    dates = features.select("date").distinct().withColumn("_n", F.row_number().over(Window.orderBy("date"))).filter(F.col("_n") % every == 1).select("date")
    ranked = features.join(F.broadcast(dates), "date").withColumn("r", pct_rank("value", ["feature", "date"])).select("feature", "date", "ticker", "r")
    parts = max(1, features.select("ticker").distinct().count() // block)
    kind = features.schema["date"].dataType.simpleString()

    def products(cells: pd.DataFrame) -> pd.DataFrame:
        """One block: its sums, flattened."""
        ticker, at = pd.factorize(cells["ticker"])[0], cells["feature"].map(place).to_numpy()
        values, there = np.zeros((ticker.max() + 1, n)), np.zeros((ticker.max() + 1, n))
        values[ticker, at], there[ticker, at] = cells["r"], 1.0
        sums = (there.T @ there, values.T @ there, (values * values).T @ there, values.T @ values)
        return pd.DataFrame({"date": [cells["date"].iloc[0]], "sums": [np.concatenate([s.ravel() for s in sums])]})

    def correlations(blocks: pd.DataFrame) -> pd.DataFrame:
        """One date, from all its blocks."""
        count, a, aa, ab = np.sum(np.stack(blocks["sums"].to_list()), axis=0).reshape(4, n, n)
        with np.errstate(divide="ignore", invalid="ignore"):
            spread = np.sqrt((aa - a * a / count) * (aa.T - a.T * a.T / count))
            c = (ab - a * a.T / count) / spread
        known = (count >= least_names) & (spread > 1e-9) & np.isfinite(c)
        return pd.DataFrame({"date": [blocks["date"].iloc[0]], "sums": [np.where(known, c, 0.0).ravel()], "known": [known.ravel().astype(float)]})

    def added(days: pd.DataFrame) -> pd.DataFrame:
        """Several dates as one row."""
        return pd.DataFrame({k: [np.sum(np.stack(days[k].to_list()), axis=0)] for k in ("sums", "known")})

    split = ranked.withColumn("_part", F.pmod(F.xxhash64("ticker"), F.lit(parts)))
    blocks = split.groupBy("date", "_part").applyInPandas(products, f"date {kind}, sums array<double>")
    daily = blocks.groupBy("date").applyInPandas(correlations, f"date {kind}, sums array<double>, known array<double>")
    some = daily.groupBy(F.pmod(F.xxhash64("date"), F.lit(16)).alias("bucket")).applyInPandas(added, "sums array<double>, known array<double>")
    listed = some.select(F.posexplode(F.arrays_zip("sums", "known")).alias("at", "e")).filter("e.known > 0")
    mean = listed.groupBy("at").agg((F.sum("e.sums") / F.sum("e.known")).alias("corr"))
    name = lambda i: F.element_at(F.array(*map(F.lit, names)), (i + 1).cast("int"))
    row, column = F.floor(F.col("at") / n), F.col("at") % n
    return mean.filter(row < column).select(name(row).alias("a"), name(column).alias("b"), "corr") if names else features.select(F.col("feature").alias("a"), F.col("feature").alias("b"), F.lit(0.0).alias("corr")).limit(0)


def greedy_dedup(scored: DataFrame, correlated: DataFrame, most: float = 0.9) -> DataFrame:
    """``scored`` (feature, ic_ir) without features that correlate over ``most`` with a kept one of larger absolute ic_ir.

    Equals taking features from the best down: in each round those without an undecided better neighbour stay and their
    neighbours go.  Ties are neighbours of neither.  Rounds are few, and features are hundreds, not rows of the panel.
    """
    near, scored = correlated.filter(F.abs("corr") > most), durable(scored)
    s = scored.select("feature", F.abs("ic_ir").alias("s"))
    both = near.select("a", "b").union(near.select("b", "a")).toDF("worse", "better")
    beats = durable(both.join(s.toDF("worse", "sw"), "worse").join(s.toDF("better", "sb"), "better").filter("sw < sb").select("worse", "better"))
    undecided, kept = s.select("feature"), None
    while True:
        blocked = beats.join(undecided.withColumnRenamed("feature", "better"), "better").select(F.col("worse").alias("feature")).distinct()
        stay = durable(undecided.join(blocked, "feature", "left_anti"))
        if stay.isEmpty():
            break
        kept = stay if kept is None else kept.union(stay)
        gone = beats.join(stay.withColumnRenamed("feature", "better"), "better").select(F.col("worse").alias("feature")).distinct()
        undecided = durable(undecided.join(stay, "feature", "left_anti").join(gone, "feature", "left_anti"))
    return scored.join(kept, "feature", "left_semi") if kept is not None else scored


def components_of(features: DataFrame) -> DataFrame:
    """Registry rows of feature ids: operator, parts and a readable formula of op__a[__b], deltaN__a, ratio_to_meanN__a."""
    parts = F.split("feature", "__")
    op = F.when(F.size(parts) > 1, parts[0]).otherwise("base")
    n = F.regexp_extract(op, "(\\d+)$", 1)
    formula = (
        F.when(op == "base", F.col("feature")).when(op.startswith("delta"), F.concat(parts[1], F.lit(" - lag("), parts[1], F.lit(", "), n, F.lit(")")))
        .when(op.startswith("ratio_to_mean"), F.concat(parts[1], F.lit(" / mean("), parts[1], F.lit(", "), n, F.lit(")")))
        .when(op == "ratio", F.concat_ws(" / ", parts[1], parts[2])).when(op == "product", F.concat_ws(" * ", parts[1], parts[2])).when(op == "diff", F.concat_ws(" - ", parts[1], parts[2]))
        .otherwise(F.concat(op, F.lit("("), parts[1], F.lit(")")))
    )
    return features.select("feature", op.alias("op"), F.when(F.size(parts) > 1, F.slice(parts, 2, 2)).otherwise(parts).alias("parts"), formula.alias("formula"))
