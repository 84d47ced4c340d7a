"""Time-axis and cross-sectional operators against plain pandas, and invariants."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewater.functions import columns as c
from tidewater.functions.ewm import ewm
from tidewater.operators import discovery, grid, metrics, portfolio


@pytest.fixture(scope="module")
def wide():
    rng = np.random.default_rng(0)
    dates = pd.date_range("2020-01-31", periods=40, freq="ME")
    frame = pd.DataFrame(rng.normal(0.01, 0.06, (40, 8)), index=dates, columns=[f"T{i}" for i in range(8)])
    return frame.mask(rng.random((40, 8)) < 0.1)


@pytest.fixture(scope="module")
def long(spark, wide):
    rows = [(d.date(), t, None if pd.isna(v) else float(v)) for d, r in wide.iterrows() for t, v in r.items()]
    return spark.createDataFrame(rows, "date date, ticker string, ret double").cache()


def back(df, name):
    p = df.select("date", "ticker", name).toPandas().pivot(index="date", columns="ticker", values=name)
    return p.to_numpy(float)


@pytest.mark.parametrize("name,build,expected", [
    ("shift", lambda w: c.shift("ret", 2, w), lambda x: x.shift(2)),
    ("sum", lambda w: c.roll_sum("ret", 6, w), lambda x: x.rolling(6).sum()),
    ("mean", lambda w: c.roll_mean("ret", 6, w, 3), lambda x: x.rolling(6, min_periods=3).mean()),
    ("std", lambda w: c.roll_std("ret", 6, w, 3), lambda x: x.rolling(6, min_periods=3).std()),
    ("median", lambda w: c.roll_median("ret", 6, w, 3), lambda x: x.rolling(6, min_periods=3).median()),
    ("skew", lambda w: c.roll_skew("ret", 8, w, 5), lambda x: x.rolling(8, min_periods=5).skew()),
    ("kurt", lambda w: c.roll_kurt("ret", 8, w, 5), lambda x: x.rolling(8, min_periods=5).kurt()),
    ("min", lambda w: c.roll_min("ret", 6, w), lambda x: x.rolling(6).min()),
])
def test_rolling(long, wide, name, build, expected):
    got = back(long.withColumn("x", build(c.by_time())), "x")
    np.testing.assert_allclose(got, expected(wide).to_numpy(), rtol=1e-8, atol=1e-10)


def test_ewm(long, wide):
    out = ewm(long, "ret", 5)
    np.testing.assert_allclose(back(out, "ret_ewm_mean"), wide.ewm(span=5, adjust=True, min_periods=5).mean().to_numpy(), atol=1e-12)
    np.testing.assert_allclose(back(out, "ret_ewm_std"), wide.ewm(span=5, adjust=True, min_periods=5).std().to_numpy(), atol=1e-12)


def test_cross_section(long, wide):
    np.testing.assert_allclose(back(long.withColumn("x", c.pct_rank("ret", ["date"])), "x"), wide.rank(axis=1, pct=True).to_numpy(), atol=1e-12)
    z = wide.sub(wide.mean(axis=1), axis=0).div(wide.std(axis=1), axis=0)
    np.testing.assert_allclose(back(long.withColumn("x", c.zscore("ret", ["date"])), "x"), z.to_numpy(), atol=1e-9)
    flat = long.withColumn("x", F.lit(1.0))
    assert flat.withColumn("z", c.zscore("x", ["date"])).filter("z is not null").count() == 0


def test_ranks_average_ties(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (1, "b", 1.0), (1, "c", 3.0), (1, "d", None), (2, "a", 9.0)], "date int, ticker string, x double")
    got = {(r.date, r.ticker): r.r for r in df.withColumn("r", c.pct_rank("x", ["date"])).collect()}
    assert got == {(1, "a"): 0.5, (1, "b"): 0.5, (1, "c"): 1.0, (1, "d"): None, (2, "a"): 1.0}


def test_elementwise(spark):
    df = spark.createDataFrame([(1.0, None, 1), (None, None, 0), (2.0, 0.0, None)], "a double, b double, g int")
    got = df.select(c.nan_add("a", "b"), c.ratio("a", "b"), c.mask_glitch("a", "g"), c.clip("a", 0, 1.5), c.where("a", F.col("a") > 1)).collect()
    assert [tuple(r) for r in got] == [(1.0, None, None, 1.0, None), (None, None, None, None, None), (2.0, None, 2.0, 1.5, 2.0)]


def test_dense_panel(spark):
    d = dt.date
    bars = spark.createDataFrame([("A", d(2020, 1, 1), 1.0, 5.0), ("A", d(2020, 1, 3), 3.0, 6.0), ("B", d(2020, 1, 2), 9.0, 7.0)], "ticker string, date date, close double, volume double")
    got = {(r.ticker, r.date.day): (r.close, r.volume) for r in grid.densify(bars, ["close", "volume"], ["close"]).collect()}
    assert got == {("A", 1): (1.0, 5.0), ("A", 2): (1.0, None), ("A", 3): (3.0, 6.0), ("B", 1): (None, None), ("B", 2): (9.0, 7.0), ("B", 3): (9.0, None)}


def test_as_of(spark):
    d = dt.date
    left = spark.createDataFrame([("A", d(2020, 1, 5), 1), ("A", d(2020, 1, 10), 2), ("A", d(2021, 6, 1), 3), ("B", d(2020, 1, 5), 4)], "k string, t date, n int")
    right = spark.createDataFrame([("A", d(2020, 1, 5), 50.0), ("A", d(2020, 1, 7), None), ("A", d(2020, 1, 10), 100.0)], "k string, at date, v double")
    look = lambda **o: {r.n: r.v for r in grid.as_of(left, right, "k", "t", "at", ["v"], **o).collect()}
    assert look() == {1: 50.0, 2: 100.0, 3: 100.0, 4: None}
    assert look(strict=True) == {1: None, 2: 50.0, 3: 100.0, 4: None}
    assert look(expire_days=400) == {1: 50.0, 2: 100.0, 3: None, 4: None}


def test_capped_weights(spark):
    rng = np.random.default_rng(2)
    rows = [(k, i, float(x)) for k in range(20) for i, x in enumerate(rng.pareto(1.0, 15) + 0.01)]
    df = spark.createDataFrame(rows, "date int, ticker int, x double")
    got = portfolio.capped_weights(df, "x", 0.12).toPandas()
    for k, g in got.groupby("date"):
        w = np.array([x for d, _, x in rows if d == k])
        w /= w.sum()
        for _ in range(200):
            over = w > 0.12 + 1e-15
            if not over.any():
                break
            free = w < 0.12 - 1e-15
            extra = (w[over] - 0.12).sum()
            w[over] = 0.12
            w[free] += extra * w[free] / w[free].sum()
        np.testing.assert_allclose(g.sort_values("ticker").weight, w, atol=1e-9)
    few = portfolio.capped_weights(df.filter("ticker < 3"), "x", 0.12).groupBy("date").agg(F.sum("weight").alias("s")).toPandas()
    assert np.allclose(few.s, 0.36)


def test_books_do_not_look_ahead(spark, long):
    panel = long.withColumn("adtv", F.lit(1e6)).withColumn("root", F.col("ticker"))
    book = lambda p: {(r.date, r.ticker): r.weight for r in portfolio.rank_and_hold(p, "ret", F.lit(True), pct=0.3, least_names=3, least_held=2).collect()}
    whole, cut = book(panel), dt.date(2022, 6, 30)
    early = book(panel.filter(F.col("date") <= F.lit(cut)))
    assert early == {k: v for k, v in whole.items() if k[0] <= cut}
    for day in {d for d, _ in whole}:
        assert abs(sum(v for (d, _), v in whole.items() if d == day) - 1) < 1e-9


def test_thin_dates_hold_the_last_book_or_none(spark):
    d = spark.createDataFrame([(1,), (2,), (3,)], "date int")
    chosen = spark.createDataFrame([(1, "a"), (1, "b"), (3, "c")], "date int, ticker string")
    assert sorted(map(tuple, portfolio.sticky(chosen, d).collect())) == [(1, "a"), (1, "b"), (2, "a"), (2, "b"), (3, "c")]
    thin = spark.createDataFrame([(1, "a", 1.0), (2, "a", 1.0), (2, "b", 2.0)], "date int, ticker string, s double")
    assert {r.date for r in portfolio.top(thin, "s", n=1, least_names=2).collect()} == {2}


def test_metrics(spark):
    rng = np.random.default_rng(1)
    r = rng.normal(0, 0.1, 30)
    df = spark.createDataFrame([("s", i, float(x)) for i, x in enumerate(r)], "strategy string, date int, ret double")
    got = metrics.summary(df, per_year=12).first()
    cum = np.cumprod(1 + r)
    assert np.isclose(got.max_drawdown, (cum / np.maximum.accumulate(np.maximum(cum, 1)) - 1).min()) and np.isclose(got.total_return, cum[-1] - 1)
    assert np.isclose(got.sharpe, r.mean() / r.std(ddof=1) * np.sqrt(12))


def test_loss_carry_forward(spark):
    rng = np.random.default_rng(7)
    rows = [(a, p, float(x), float(s)) for a in range(20) for p, (x, s) in enumerate(zip(rng.normal(0, 10, 25), rng.uniform(0, 40, 25)))]
    got = {(r.account, r.period): r.tax for r in metrics.loss_carry_forward(spark.createDataFrame(rows, "account int, period int, pnl double, sales double"), 0.15, 20.0).collect()}
    carried = {}
    for a, p, x, s in rows:
        cf, tax = carried.get(a, 0.0), 0.0
        if x < 0:
            cf -= x
        elif s > 20:
            tax, cf = 0.15 * max(0.0, x - cf), max(0.0, cf - x)
        carried[a] = cf
        assert np.isclose(got[a, p], tax), (a, p)


def test_ic_needs_ten_names_and_reranks(spark):
    rng = np.random.default_rng(3)
    rows, fwd = [], []
    for day in range(6):
        for t in range(12 if day else 9):
            rows.append(("f", day, t, None if t == 11 and day == 2 else float(rng.normal())))
            fwd.append((day, t, 1, float(rng.normal())))
    f = spark.createDataFrame(rows, "feature string, date int, ticker int, value double").filter("value is not null")
    got = {r.date: r.ic for r in discovery.ic_series(f, spark.createDataFrame(fwd, "date int, ticker int, horizon int, forward double")).collect()}
    assert set(got) == {1, 2, 3, 4, 5}
    for day, ic in got.items():
        x = pd.Series({t: v for _, d, t, v in rows if d == day and v is not None})
        y = pd.Series({t: v for d, t, _, v in fwd if d == day})[x.index]
        assert np.isclose(ic, x.rank().corr(y.rank()))


def test_greedy_dedup_equals_one_by_one(spark):
    rng = np.random.default_rng(11)
    n = 14
    score = {f"f{i}": float(rng.normal()) for i in range(n)}
    pairs = [(f"f{i}", f"f{j}", float(rng.random())) for i in range(n) for j in range(i + 1, n)]
    pairs = [(min(a, b), max(a, b), x) for a, b, x in pairs]
    near = {(a, b) for a, b, x in pairs if x > 0.7} | {(b, a) for a, b, x in pairs if x > 0.7}
    kept = []
    for f in sorted(score, key=lambda k: -abs(score[k])):
        if not any((f, k) in near for k in kept):
            kept.append(f)
    got = discovery.greedy_dedup(spark.createDataFrame(list(score.items()), "feature string, ic_ir double"), spark.createDataFrame(pairs, "a string, b string, corr double"), 0.7)
    assert {r.feature for r in got.collect()} == set(kept)
